"""Filing preparation: identifiers, metadata joins, sentence and span tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as tx
from ..functions.sides import measured
from ..sources.filings import cik_of_accession

DOC_KEYS = ["accession_number", "cik", "year", "filing_date", "item_type"]


def normalize_accession(df: DataFrame, accession: str = "accession_number", cik: str = "cik") -> DataFrame:
    """Numeric accession to ``cik(10 digits)-YY-ZZZZZZ``; null when missing, zero or too short."""
    digits = F.col(accession).cast("decimal(38,0)").cast("string")
    tail = F.substring(digits, -8, 8)
    ok = F.col(accession).isNotNull() & F.col(cik).isNotNull() & (F.col(accession) != 0) & (F.length(digits) >= 8)
    c = F.col(cik).cast("long").cast("string")
    padded = F.when(F.length(c) < 10, F.lpad(c, 10, "0")).otherwise(c)
    return df.withColumn(
        accession, F.when(ok, F.concat_ws("-", padded, F.substring(tail, 1, 2), F.substring(tail, 3, 6)))
    )


def with_cik(df: DataFrame, accession: str = "accession_number") -> DataFrame:
    """CIK from the accession number; an existing column is filled where null or zero."""
    parsed = cik_of_accession(F.col(accession))
    if "cik" in df.columns:
        parsed = F.when(F.col("cik").isNotNull() & (F.col("cik") != 0), F.col("cik")).otherwise(parsed)
    return df.withColumn("cik", parsed)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first by ``order``, ties by the other columns.

    An aggregate, so each map task keeps one row per key.
    """
    rest = [c for c in df.columns if c not in keys]
    ranked = order + [c for c in rest if c not in order]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*ranked)).alias("_r"))
    return first.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def consolidate_items(items: list[DataFrame], metadata: DataFrame) -> DataFrame:
    """Union of the item tables with the filing date of the metadata (left join, first date per filing).

    The dates are stored and measured first: below ``sides.MAX_BROADCAST_BYTES`` the texts are not shuffled to meet them.
    """
    docs = reduce(lambda a, b: a.unionByName(b), items)
    dates = metadata.where(F.col("accession_number").isNotNull()).groupBy("accession_number").agg(
        F.min("filing_date").alias("filing_date")
    )
    return docs.drop("filing_date").join(measured(dates), "accession_number", "left")


def date_coverage(docs: DataFrame) -> DataFrame:
    """Documents with and without a filing date."""
    return docs.agg(
        F.count("*").alias("n_documents"), F.count("filing_date").alias("n_dated"),
        F.count_if(F.col("filing_date").isNull()).alias("n_missing"),
    )


def enrich_documents(docs: DataFrame, tickers: DataFrame, filings: DataFrame) -> DataFrame:
    """One row per (cik, accession) with ticker, company name and filing date, defaults filled."""
    base = docs.select("cik", "accession_number").distinct()
    t = first_per_key(tickers.select("cik", "ticker", "company_name"), ["cik"], ["ticker", "company_name"])
    f = first_per_key(
        filings.select("accession_number", "filing_date"), ["accession_number"], ["filing_date"]
    )
    return (
        base.join(t, "cik", "left").join(f, "accession_number", "left")
        .select(
            "cik", "accession_number",
            F.coalesce("ticker", F.lit("UNKNOWN")).alias("ticker"),
            F.coalesce("company_name", F.lit("Unknown Company")).alias("company_name"),
            F.expr("try_to_date(cast(filing_date as string), 'yyyy-MM-dd')").alias("filing_date"),
        )
    )


def enrich_sentences(df: DataFrame, meta: DataFrame) -> DataFrame:
    """Replace ticker, company name and filing date by those of the (cik, accession) metadata, measured as in
    ``consolidate_items``."""
    keys = ["cik", "accession_number"]
    new = ["ticker", "company_name", "filing_date"]
    right = first_per_key(meta.select(*keys, *new), keys, new)
    return df.drop(*new).join(measured(right), keys, "left")


def sentence_table(docs: DataFrame, min_length: int = 20) -> DataFrame:
    """One row per kept sentence; ``sentence_id`` counts the kept sentences of a document from 0."""
    keys = [c for c in ["accession_number", "cik", "ticker", "year", "filing_date", "item_type"] if c in docs.columns]
    return docs.select(
        *keys, F.posexplode(tx.sentences(F.col("text"), min_length)).alias("sentence_id", "text")
    ).withColumn("sentence_length", F.length("text").cast("int"))


def sentences_per_document(sents: DataFrame) -> DataFrame:
    """Sentence and document counts with the average per document."""
    per_doc = sents.groupBy("accession_number", "item_type").count()
    return per_doc.agg(
        F.sum("count").alias("n_sentences"), F.count("*").alias("n_documents"), F.avg("count").alias("avg_sentences")
    )


def span_table(sents: DataFrame, target_tokens: int = 80) -> DataFrame:
    """Paragraph-like spans: consecutive sentences, a new span at each ``target_tokens`` words.

    The window never exceeds the sentences of one document item.
    """
    keys = [c for c in DOC_KEYS if c in sents.columns]
    w = Window.partitionBy("accession_number", "item_type").orderBy("sentence_id")
    before = F.coalesce(F.sum("_w").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = sents.withColumn("_w", F.size(tx.tokens(F.col("text")))).withColumn(
        "paragraph_id", F.floor(before / target_tokens).cast("int")
    )
    return (
        marked.groupBy(*keys, "paragraph_id")
        .agg(
            F.sum("_w").alias("n_words"), F.count("*").alias("n_sentences"),
            F.sort_array(F.collect_list(F.struct("sentence_id", "text"))).alias("_s"),  # at most 80 one-word rows
        )
        .withColumn("text", F.array_join(F.col("_s.text"), " "))
        .drop("_s")
    )
