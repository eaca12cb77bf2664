"""From raw documents to packed token sequences, in five stages.

Each stage reads what its predecessor kept. All but the last return the columns of ``documents``:

1. quality: documents that the base rules or the certified cutoffs refuse go;
2. exact: of equal texts the one with the smallest id stays;
3. near: of each group of similar texts (five-word shingles, similarity 0.8) the one with the smallest id stays;
4. personal_data: spans are replaced by their kind in brackets, ``n_chars`` follows;
5. packing: token pieces with their place in sequences of 4096.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from filingpanel.llm import exact_dedup, packing, pii, quality, simhash
from filingpanel.llm.common import documents, staged
from filingpanel.llm.queries import WORD_BPE


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact_pii(docs, length_col="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_documents(docs, WORD_BPE)


STAGES = [("quality", good), ("exact", exact), ("near", near), ("personal_data", personal_data), ("packing", packed)]
ORACLE_SQL = None  # near duplicates and token ids are beyond SQL; tests/llm holds the rows against a direct computation


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what each keeps is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
