"""Documents to packed training sequences, in stages that each write and reread Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfcast.llm import jaccard, packing, repetition, shared, surrogates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is long enough and does not repeat itself."""
    return repetition.quality_kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 80 % joint five-word n-grams connect."""
    return jaccard.one_of_each(docs, jaccard.Join(n=5, percent=80))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to surrogates; no document goes."""
    return surrogates.with_surrogates(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token pieces with their place in a sequence."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("personal data", personal_data),
    ("best-fit packing", sequences),
]

# Tokenizers and repetition are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are written and read again."""
    docs = shared.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = shared.written(docs, f"stage-{k}")
            if k:
                shared.removed(spark, before)
    return docs
