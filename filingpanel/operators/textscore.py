"""Sentence scores: readability, sentiment, novelty and relevance.

Token arrays are built once in their own projection; all scores are built-in
expressions on them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..functions.durable import durable
from ..functions.quantiles import exact_quantiles
from ..functions.sampling import hash_rank, lowest_ranked
from ..functions.sides import measured
from .prepare import first_per_key

SENTENCE_KEY = ["accession_number", "sentence_id", "item_type"]

# Word lists the scores are defined on.
POSITIVE_WORDS = (
    "profit", "profitable", "profits", "success", "successful", "growth", "growing", "increase", "increased",
    "gain", "gains", "improve", "improved", "improvement", "strong", "strength",
)
NEGATIVE_WORDS = (
    "loss", "losses", "decline", "declined", "decrease", "decreased", "risk", "risks", "uncertainty",
    "uncertain", "litigation", "adverse", "adversely", "negative", "impairment", "failure",
)
FINANCE_WORDS = (
    "revenue", "revenues", "sales", "income", "earnings", "profit", "loss", "cash", "debt", "assets",
    "liabilities", "equity", "segment", "segments", "operations", "margin", "ebitda", "goodwill",
    "intangibles", "impairment", "acquisition",
)


def _with_words(df: DataFrame, lower: bool = False) -> DataFrame:
    df = df.withColumn("_words", tx.tokens(F.col("text")))
    return df.withColumn("_lower", F.transform("_words", F.lower)) if lower else df


def readability(df: DataFrame) -> DataFrame:
    """Word count, mean word length, Flesch and fog scores, share of complex words."""
    stats = F.aggregate(
        "_words",
        F.struct(F.lit(0).cast("long").alias("chars"), F.lit(0.0).alias("syl"), F.lit(0).cast("long").alias("complex")),
        lambda s, w: F.struct(
            (s["chars"] + F.length(w)).alias("chars"),
            (s["syl"] + F.greatest(F.lit(1.0), F.length(w) / F.lit(3.0))).alias("syl"),
            (s["complex"] + F.when(F.length(w) > 6, 1).otherwise(0)).alias("complex"),
        ),
    )
    n, floor = F.col("word_count"), F.greatest(F.col("word_count"), F.lit(1))
    return (
        _with_words(df)
        .withColumn("word_count", F.size("_words"))
        .withColumn("_s", stats)
        .withColumn("_ends", F.greatest(F.regexp_count("text", F.lit("[.!?]")), F.lit(1)))
        .withColumn("avg_word_length", F.when(n > 0, F.col("_s.chars") / n).otherwise(F.lit(0.0)))
        .withColumn("flesch_score", F.lit(206.835) - 1.015 * (n / F.col("_ends")) - 84.6 * (F.col("_s.syl") / floor))
        .withColumn("fog_index", 0.4 * (n / F.col("_ends") + 100 * (F.col("_s.complex") / floor)))
        .withColumn("complex_word_ratio", F.col("_s.complex") / floor)
        .drop("_words", "_s", "_ends")
    )


def sentiment(
    df: DataFrame, positive: Iterable[str] = POSITIVE_WORDS, negative: Iterable[str] = NEGATIVE_WORDS
) -> DataFrame:
    """Distinct positive and negative words, their difference, and its ratio to all words."""
    net = F.col("positive_word_count") - F.col("negative_word_count")
    return (
        _with_words(df, lower=True)
        .withColumn("positive_word_count", tx.keyword_hits(F.col("_lower"), positive))
        .withColumn("negative_word_count", tx.keyword_hits(F.col("_lower"), negative))
        .withColumn("sentiment_net", net)
        .withColumn("sentiment_ratio", net / F.greatest(F.size("_words"), F.lit(1)))
        .drop("_words", "_lower")
    )


def baseline_features(df: DataFrame) -> DataFrame:
    """Readability and sentiment of every sentence."""
    return sentiment(readability(df))


def token_counts(df: DataFrame, vocabulary: Iterable[str] = FINANCE_WORDS) -> DataFrame:
    """Counters the scores are built from."""
    w = F.col("_words")
    return (
        _with_words(df, lower=True)
        .withColumn("n_words", F.size(w))
        .withColumn("n_numeric", tx.numeric_tokens(w))
        .withColumn("n_capitalised", tx.capitalised_tokens(w))
        .withColumn("n_keywords", tx.keyword_hits(F.col("_lower"), vocabulary))
        .withColumn("diversity", tx.lexical_diversity(w))
        .drop("_words", "_lower")
    )


def firm_text_baselines(df: DataFrame, length_unit: str = "chars") -> DataFrame:
    """Mean sentence length and mean lexical diversity per firm."""
    if length_unit not in ("chars", "words"):
        raise ValueError(f"unknown length unit {length_unit}")
    words = _with_words(df.where(F.col("cik").isNotNull()))
    length = F.col("sentence_length") if length_unit == "chars" else F.size("_words")
    return words.groupBy("cik").agg(
        F.avg(length).alias("firm_length"), F.avg(tx.lexical_diversity(F.col("_words"))).alias("firm_diversity")
    )


def novelty_score() -> Column:
    """Novelty from the token counters and the firm baselines."""
    n = F.col("n_words")
    return (
        0.4 * F.abs(n - F.col("firm_length")) / (F.col("firm_length") + 1)
        + 0.3 * F.abs(F.col("diversity") - F.col("firm_diversity"))
        + 0.3 * ((F.col("n_numeric") + F.col("n_capitalised")) / (n + 1))
    )


def relevance_score() -> Column:
    """Relevance from position, token counters and item."""
    item = F.when(F.col("item_type") == "item7", 1.0).when(F.col("item_type") == "item1", 0.7).otherwise(0.5)
    return (
        0.3 * F.exp(-F.col("sentence_id") / 10)
        + 0.3 * F.least(F.col("n_keywords") / 5.0, F.lit(1.0))
        + 0.2 * F.least(F.col("n_numeric") / 20.0, F.lit(1.0))
        + 0.2 * item
    )


def novelty_proxy(df: DataFrame, length_unit: str = "chars", keep_text: bool = False) -> DataFrame:
    """Distance of a sentence from its firm's text baseline plus specificity; rows without cik drop out.

    Only the per-firm table is aggregated; the join with it is left to adaptive
    execution, which broadcasts it if measured small and splits a hot firm if not.
    Counters travel to the join, the text does not unless ``keep_text`` asks for it.
    """
    base = firm_text_baselines(df, length_unit)
    kept = [c for c in df.columns if keep_text or c != "text"]
    counted = token_counts(df).drop("n_keywords").select(*kept, "n_words", "n_numeric", "n_capitalised", "diversity")
    return counted.join(base, "cik").withColumn("novelty_cln", novelty_score()).select(*kept, "novelty_cln")


def relevance_proxy(df: DataFrame) -> DataFrame:
    """Position, finance words, numbers and item weight; no shuffle."""
    return token_counts(df).withColumn("relevance_kmnz", relevance_score()).select(*df.columns, "relevance_kmnz")


HOT_SHARE = 4096  # a (firm, token, year) with more than one in so many rows is dealt to several tasks


def word_counts(words: Column) -> Column:
    """Array of (token, n) of the distinct tokens of an array, from one sort."""
    def counted(w: Column) -> Column:
        last = F.filter(F.transform(w, lambda x, i: F.when((i == F.size(w) - 1) | (x != F.get(w, i + 1)), i)), lambda i: i.isNotNull())
        return vx.let(last, lambda ends: F.transform(ends, lambda end, j: F.struct(
            F.get(w, end).alias("token"), (end - F.coalesce(F.get(ends, j - 1), F.lit(-1))).alias("n"))))

    return vx.let(F.sort_array(words), counted)


def hot_keys(per_key: DataFrame, keys: list[str], share: int = HOT_SHARE) -> DataFrame:
    """``keys..., salts`` of the keys with more than one in ``share`` of all rows (column ``n_rows``): fewer than ``share`` keys,
    with the number of parts that makes each part at most that large."""
    whole = per_key.agg(F.sum("n_rows")).scalar()
    return per_key.where(F.col("n_rows") * share > whole).select(*keys, F.ceil(F.col("n_rows") * share / whole).cast("int").alias("salts"))


BLOCK_WORDS = 1 << 18  # words of the sentences that share one dictionary


def _typed(df: DataFrame, cols: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols)


def word_blocks(df: DataFrame, words: str = "words", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``block, dictionary, sentences``: sentences in blocks of about ``block_words`` words, each distinct (cik, year, token) once.

    ``words`` holds (token, n) per sentence; a sentence has the places of its words in the ``dictionary`` of the block, with
    ``n``.  Sentences of a firm and year come together as far as that leaves parts of equal size (a firm-year that is too
    large for one is split by adaptive execution), which keeps the dictionaries small; blocks are right however they are dealt.
    """
    kept = [*SENTENCE_KEY, "cik", "year"]
    rows = df.select(*kept, F.col(words)["token"].alias("token"), F.col(words)["n"].cast("array<int>").alias("n"))
    rows = rows.hint("rebalance", F.col("cik"), F.col("year")).sortWithinPartitions("cik", "year")
    schema = (f"block long, dictionary array<struct<{_typed(df, ['cik', 'year'])}, token string, c long>>, "
              f"sentences array<struct<{_typed(df, kept)}, places array<int>, n array<int>>>")

    def listed(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    def block(part: pa.Table, number: int) -> pa.RecordBatch:
        part = part.combine_chunks()
        lists = part.column("token").combine_chunks()
        flat, length = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        token, n = flat.dictionary_encode(), part.column("n").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        group = np.zeros(len(part), np.int64)
        for c in ("cik", "year"):
            codes = part.column(c).combine_chunks().dictionary_encode()
            group = group * len(codes.dictionary) + codes.indices.to_numpy(zero_copy_only=False)
        code = np.repeat(group, length) * len(token.dictionary) + token.indices.to_numpy(zero_copy_only=False)
        _, first, place = np.unique(code, return_index=True, return_inverse=True)
        sentence = pa.array(np.repeat(np.arange(len(part)), length)[first])
        named = [part.column(c).combine_chunks().take(sentence) for c in ("cik", "year")]
        total = pa.array(np.bincount(place, n, len(first)).astype(np.int64))
        dictionary = pa.StructArray.from_arrays([*named, flat.take(pa.array(first)), total], ["cik", "year", "token", "c"])
        at = pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32))
        sentences = pa.StructArray.from_arrays(
            [*[part.column(c).combine_chunks() for c in kept], pa.ListArray.from_arrays(at, pa.array(place.astype(np.int32))),
             pa.ListArray.from_arrays(at, pa.array(n))], [*kept, "places", "n"])
        return pa.RecordBatch.from_arrays([pa.array([number]), listed(dictionary), listed(sentences)], ["block", "dictionary", "sentences"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:  # sentences without words go here: a filter before would count the words twice
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column("token")), 0))
            ends = np.cumsum(pc.list_value_length(batch.column("token")).to_numpy(zero_copy_only=False))
            start, done = 0, 0
            while start < batch.num_rows:
                stop = min(int(np.searchsorted(ends, done + block_words - size)) + 1, batch.num_rows)
                held.append(batch.slice(start, stop - start))
                size, start, done = size + int(ends[stop - 1]) - done, stop, int(ends[stop - 1])
                if size >= block_words:
                    yield block(pa.Table.from_batches(held), number)
                    held, size, number = [], 0, number + 1
        if held:
            yield block(pa.Table.from_batches(held), number)

    return rows.mapInArrow(run, schema)


def surprisal_novelty(df: DataFrame, agg: str = "mean", alpha: float = 1.0) -> DataFrame:
    """Mean, sum or maximum of -log P(token | earlier years of the same firm), smoothed unigrams.

    P = (count before + alpha) / (tokens before + alpha * V), V = distinct tokens
    of the whole table.  The text is counted once, into a stored table of blocks of
    sentences with a dictionary each.  Only dictionaries are counted, joined with
    their probabilities and gathered again, one row per block, so rows of single
    words are never shuffled.  Counts per (firm, token, year) are aggregated before
    any window; the windows run over years of one (firm, token) or of one firm.
    Their exact counts name the heavy hitters, words of a firm-year with many blocks;
    these meet their probability in several parts.
    """
    if agg not in ("mean", "sum", "max"):
        raise ValueError(f"unknown aggregation {agg}")
    key = ["token", "cik", "year"]
    known = df.where(F.col("cik").isNotNull() & F.col("year").isNotNull())
    blocks = durable(word_blocks(known.select(*SENTENCE_KEY, "cik", "year", word_counts(tx.lower_tokens(F.col("text"))).alias("words"))))
    entries = blocks.select("block", F.posexplode("dictionary").alias("place", "_d")).select("block", "place", "_d.*")
    per_year = durable(entries.groupBy(*key).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n_rows")))
    w_tok = Window.partitionBy("token", "cik").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    earlier = per_year.withColumn("before", F.coalesce(F.sum("c").over(w_tok), F.lit(0)))
    w_firm = Window.partitionBy("cik").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    totals = per_year.groupBy("cik", "year").agg(F.sum("c").alias("c")).select(
        "cik", "year", F.coalesce(F.sum("c").over(w_firm), F.lit(0)).alias("total_before")
    )
    vocab = per_year.select("token").distinct().agg(F.count("*").alias("v")).scalar()
    hot = F.broadcast(durable(hot_keys(per_year, key)))  # fewer than HOT_SHARE rows
    prior = earlier.join(measured(totals), ["cik", "year"]).join(hot, key, "left").select(
        *key, F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("_salt"),
        (-F.log((F.col("before") + alpha) / (F.col("total_before") + alpha * vocab))).alias("info"),
    )
    dealt = entries.drop("c").join(hot, key, "left").withColumn(
        "_salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("block"), F.col("salts")).cast("int")))
    infos = dealt.join(prior, [*key, "_salt"]).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "info")))["info"].alias("infos"))

    def of_words(s: Column) -> Column:
        if agg == "max":
            return F.array_max(F.transform(s["places"], lambda i: F.get("infos", i)))
        products = F.zip_with(s["places"], s["n"], lambda i, n: F.get("infos", i) * n)
        return F.aggregate(products, F.lit(0.0), lambda t, x: t + x)

    kept = [*SENTENCE_KEY, "cik", "year"]
    scored = blocks.select("block", "sentences").join(infos, "block").select(F.inline(F.transform("sentences", lambda s: F.struct(
        *[s[c].alias(c) for c in kept], F.aggregate(s["n"], F.lit(0).cast("long"), lambda t, x: t + x).alias("n"), of_words(s).alias("info")))))
    total = F.sum("info")
    value = {"mean": total / F.sum("n"), "sum": total, "max": F.max("info")}[agg]
    return scored.groupBy(*kept).agg(F.sum("n").cast("long").alias("n_tokens"), value.alias("novelty_surprisal"))


def attention_relevance(
    df: DataFrame, score: str | None = None, max_sentences: int | None = None, embedding: str | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Softmax weight of each sentence in its filing; weighted mean vector per filing if asked for.

    All sentences of a filing take part; without a score each has the same weight.
    ``max_sentences`` is for models with a fixed input length: the weight then runs
    over the first sentences only (``1/max_sentences`` without a score, as a filing
    is padded to that length) and later ones get null.  Filing sums are aggregates.
    """
    if max_sentences is None:
        ranked, inside = df, F.lit(True)
    else:
        order = Window.partitionBy("accession_number").orderBy("item_type", "sentence_id")
        ranked = df.withColumn("_n", F.row_number().over(order))
        inside = F.col("_n") <= max_sentences
    if score is None and max_sentences is None:
        share = df.groupBy("accession_number").agg((F.lit(1.0) / F.count("*")).alias("relevance_kmnz"))
        weighted = df.join(share, "accession_number")
    elif score is None:
        weighted = ranked.withColumn("relevance_kmnz", F.when(inside, F.lit(1.0 / max_sentences)))
    else:
        top = ranked.where(inside).groupBy("accession_number").agg(F.max(score).alias("_top"))
        shifted = ranked.join(top, "accession_number").withColumn(
            "_e", F.when(inside, F.exp(F.col(score) - F.col("_top")))
        )
        total = shifted.groupBy("accession_number").agg(F.sum("_e").alias("_sum"))
        weighted = shifted.join(total, "accession_number").withColumn(
            "relevance_kmnz", F.col("_e") / F.col("_sum")
        )
    pooled = None
    if embedding is not None:
        from pyspark.ml.functions import array_to_vector, vector_to_array
        from pyspark.ml.stat import Summarizer

        v = array_to_vector(vx.as_double(F.col(embedding)))
        pooled = weighted.where(F.col("relevance_kmnz").isNotNull()).groupBy("accession_number").agg(
            vector_to_array(Summarizer.mean(v, F.col("relevance_kmnz"))).alias("pooled")
        )
    return weighted.select(*df.columns, "relevance_kmnz"), pooled


def attach_scores(
    df: DataFrame, novelty: DataFrame | None = None, relevance: DataFrame | None = None,
    key: list[str] | None = None,
) -> DataFrame:
    """Left-join the scores by sentence key, first row per key; a missing table gives 0.0."""
    key = key or SENTENCE_KEY
    for name, scores in (("novelty_cln", novelty), ("relevance_kmnz", relevance)):
        df = df.drop(name)
        if scores is None:
            df = df.withColumn(name, F.lit(0.0))
        else:
            df = df.join(first_per_key(scores.select(*key, name), key, [name]), key, "left")
    return df


def describe_score(df: DataFrame, col: str) -> DataFrame:
    """Count, mean, std, min, quartiles and max of one score."""
    basic = df.agg(
        F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
        F.min(col).alias("min"), F.max(col).alias("max"),
    ).withColumn("score", F.lit(col))
    quart = exact_quantiles(df, col, {"q25": 0.25, "q50": 0.5, "q75": 0.75}).select(F.struct("*")).scalar()
    return basic.withColumn("_q", quart).select(*basic.columns, "_q.*")
