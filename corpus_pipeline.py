"""The corpus pipeline: language ID, quality, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result to the
shared folder as Parquet and reads it back as the next stage's docs. All stages but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixelwright.llm import jaccard_join, langid, packing, quality
from pixelwright.llm.common import drop_files, lean, lean_reads, materialize, tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known and clear."""
    lean_reads(spark)
    return langid.stage(spark, docs, sf_dir)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    lean_reads(spark)
    return quality.stage(spark, docs, sf_dir)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents."""
    lean_reads(spark)
    return jaccard_join.stage(spark, docs, sf_dir)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents in training sequences."""
    lean_reads(spark)
    lean(spark)
    return packing.pack(docs.select("doc_id", "text"), "doc_id", "text", tokenizer_path(packing.VOCABULARY))


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", near_duplicates),
    ("packing", pack_sequences),
]

#: The stages hold fitted models and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; the packed pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    source = None
    for name, stage in STAGES[:-1]:
        result = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if source is not None:
            drop_files(source)
        docs = source = result
    return STAGES[-1][1](spark, docs, sf_dir)
