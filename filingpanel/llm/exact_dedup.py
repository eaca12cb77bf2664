"""Exact duplicates: grouping by a 128-bit content hash, with the bytes compared inside each hash group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, staged, text_of


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def text_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
                 content_hash: Callable[[Column], Column] = md5_128) -> DataFrame:
    """One row per different text: hash, SHA-256 hex, id that stays, number of rows.

    The grouping key is (hash, text): rows meet by their hash and are one class only if all bytes are equal,
    so a collision splits into two classes. Copies are combined in the tasks before the shuffle; a text that
    a third of all rows share reaches its reducer once per task.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    return (
        id_text(docs, id_col, text_col)
        .groupBy(content_hash(F.col("text")).alias("h"), "text")
        .agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
                 content_hash: Callable[[Column], Column] = md5_128) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null text counts as empty. A null id never names a class while the class has another id; a class of null ids
    has a null ``keep_id``, and its rows are kept. Rows that repeat id and text are one document: they count in
    ``group_size`` and carry the same ``kept``. An empty table gives an empty result.

    Only hashes and ids travel in the join back. Both sides are plain tables there, so adaptive execution can
    split the partition of a hot class.
    """
    classes = staged(text_classes(docs, id_col, text_col, keep, content_hash), "exact-classes")
    twice = classes.groupBy("h", "text_sha256").count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError("two different texts share the 128-bit hash and the SHA-256 digest")
    rows = id_text(docs, id_col, text_col).select(
        "doc_id", content_hash(F.col("text")).alias("h"), F.sha2("text", 256).alias("text_sha256"))
    return rows.join(classes, ["h", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The documents that stay, with all their columns: one row per different text.

    The row with the smallest (or largest) id of its class stays; null ids come last; repeated rows leave one.
    Null and empty texts are one class, and the row that stays is returned as it was.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.struct(F.col(id_col).isNull() if keep == "min" else F.col(id_col).isNotNull(), F.col(id_col))
    pick = {"min": F.min_by, "max": F.max_by}[keep]
    # the text is the key already, so only the other columns are carried in the aggregate
    others = [c for c in docs.columns if c != text_col]
    carried = F.struct(F.col(f"`{text_col}`").isNull().alias("_no_text"), *[F.col(f"`{c}`") for c in others]) if others else rest
    kept = docs.groupBy(md5_128(text_of(text_col)).alias("_h"), text_of(text_col).alias("_text")).agg(
        pick(carried, order).alias("_row"))
    return kept.select(*[
        F.when(~F.col("_row._no_text"), F.col("_text")).alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c)
        for c in docs.columns
    ])
