"""How filters interact: what each removes at every place of every order, and its Shapley share of all removals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, slices, staged, text_of

FILTERS = "ABCDE"  # filter i is bit i of a mask
COPY = 1 << FILTERS.index("E")
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 100, 80, 10
UPPER, SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
LATER_BYTES = bytes(range(0x80, 0xC0))  # bytes of a code point after its first one
OUTPUT = "part string, filter_order string, step int, " + ", ".join(
    f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))


def failures(text: bytes) -> int:
    """Mask of the failed filters A to D."""
    words, rest = text.split(), text.translate(None, UPPER)
    return ((len(words) < MIN_WORDS)
            | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
            | (100 * (len(text) - len(rest)) > UPPER_PERCENT * len(text.translate(None, LATER_BYTES))) << 2
            | (len(rest.translate(None, SYMBOLS)) < len(rest)) << 3)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``doc_id, part, mask, digest`` per row: failures of A to D, and the SHA-256 of the text by which copies meet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = as_bytes(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), pa.array(map(failures, texts), pa.int32(), size=len(texts)),
                 pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())], ["doc_id", "part", "mask", "digest"])

    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text_of(text_col).alias("text"))
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, part string, mask int, digest binary")


def counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``part, mask, good, toxic, n``: documents by the set of filters they fail, at most 128 rows per part.

    Copies are counted per text, part and label before texts meet, so a text in a third of the rows is a few rows by
    then. Of a text's rows those of its smallest id do not fail E; a row without id neither fails E nor makes another
    one fail. A document is good (toxic) if any row of ``labels`` with its id says so.
    """
    def said(column: str) -> Column:
        return F.coalesce(F.max(F.coalesce(F.col(column) == 1, F.lit(False))), F.lit(False))

    marks = labels.groupBy(F.col(id_col).alias("doc_id")).agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    rows = judged(docs, id_col, text_col, part_col).join(marks, "doc_id", "left").withColumns(
        {c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    kind = ["digest", "part", "mask", "good", "toxic"]
    ids = rows.groupBy(*kind, "doc_id").agg(F.count(F.lit(1)).alias("c"))
    texts = ids.groupBy(*kind).agg(
        F.sum("c").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("c")).otherwise(0)).alias("n_nameless"),
        F.min("doc_id").alias("least"), F.min_by("c", "doc_id").alias("n_least"))
    first = F.min("least").over(Window.partitionBy("digest"))
    single = F.col("n_nameless") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    either = F.array(F.struct(F.col("mask"), F.col("single").alias("n")),
                     F.struct(F.col("mask").bitwiseOR(F.lit(COPY)).alias("mask"), (F.col("n") - F.col("single")).alias("n")))
    return (texts.withColumn("first", first).withColumn("single", single)
            .select("part", "good", "toxic", F.inline(either))
            .groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")))


def removals(by_mask: dict[int, int], filters: int = len(FILTERS)) -> list[int]:
    """For each coalition of filters (a mask), how many documents it removes."""
    return [sum(n for mask, n in by_mask.items() if mask & coalition) for coalition in range(1 << filters)]


def solved(matrix: list[list[Fraction]]) -> list[Fraction]:
    """Solution of linear equations, given with the right sides as last column, by exact elimination."""
    rows, size = [list(r) for r in matrix], len(matrix)
    for i in range(size):
        pivot = next(r for r in range(i, size) if rows[r][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for r in range(size):
            if r != i and rows[r][i]:
                rows[r] = [x - rows[r][i] * y for x, y in zip(rows[r], rows[i])]
    return [r[-1] for r in rows]


def shapley_values(values: list[int], players: int) -> list[Fraction]:
    """Shapley values of a game given by the value of each coalition, as exact fractions.

    They are the weighted least-squares fit of the coalition values by sums of the members' shares, with the Shapley
    kernel (n - 1) / (C(n, s) s (n - s)) as weights, under the constraint that all shares add up to the value of the
    whole (efficiency). The normal equations with one Lagrange multiplier are solved in rationals.
    """
    whole = (1 << players) - 1
    if players == 1:
        return [Fraction(values[1] - values[0])]
    weight = {s: Fraction(players - 1, comb(players, s) * s * (players - s)) for s in range(1, players)}
    equations = []
    for i in range(players):
        inside = [(c, weight[c.bit_count()]) for c in range(1, whole) if c >> i & 1]
        left = [sum((w for c, w in inside if c >> j & 1), Fraction(0)) for j in range(players)]
        equations.append([*left, Fraction(1), sum((w * (values[c] - values[0]) for c, w in inside), Fraction(0))])
    equations.append([*[Fraction(1)] * players, Fraction(0), Fraction(values[whole] - values[0])])
    return solved(equations)[:players]


def audit_part(table: pd.DataFrame) -> pd.DataFrame:
    """All orders and steps of one part, from differences of the coalition values."""
    n, whole = len(FILTERS), (1 << len(FILTERS)) - 1
    total = int(table["n"].sum())
    everything, good, toxic = (
        removals({int(m): int(c) for m, c in part.groupby("mask")["n"].sum().items()})
        for part in (table, table[table["good"]], table[table["toxic"]]))
    orders = factorial(n)
    shares = [int(orders * s) for s in shapley_values(everything, n)]
    unique = [everything[whole] - everything[whole ^ 1 << f] for f in range(n)]
    out = []
    for order in permutations(range(n)):
        name, before = "".join(FILTERS[f] for f in order), 0
        for step, f in enumerate(order, 1):
            after = before | 1 << f
            removed = everything[after] - everything[before]
            out.append((name, step, total - everything[after], removed, everything[1 << f] - removed, unique[f],
                        good[after] - good[before], toxic[after] - toxic[before], shares[f]))
            before = after
    frame = pd.DataFrame(out, columns=["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])
    frame.insert(0, "part", table["part"].iloc[0])
    return frame


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part (null: empty string), order of the five filters and step; columns as in ``OUTPUT``.

    ``kept`` after the step, ``removed`` in it, ``redundant``: failing its filter but removed earlier, ``unique_fails``:
    failing its filter only, ``good_lost`` and ``toxic_lost``: labelled so and removed in it, ``shapley``: removals of its
    filter added up over all orders. Null texts count as empty (A fails, copies of each other); repeated rows of one id
    count each and are no copies of each other; ids without labels are neither good nor toxic; rows with extra columns
    are as good as without; an empty table gives no rows, an empty ``labels`` zeros. The tasks of the last step hold
    at most 128 counters per part.
    """
    table = staged(counts(docs, labels, id_col, text_col, part_col), "filter-counts")
    return table.groupBy("part").applyInPandas(audit_part, OUTPUT)
