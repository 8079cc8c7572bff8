"""From raw documents to packed token sequences, in five stages that each work on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordforge.llm.decontamination import drop_contaminated
from recordforge.llm.near_dup import drop_near_duplicates
from recordforge.llm.packing import pack_documents
from recordforge.llm.pii import redact_pii
from recordforge.llm.quality import keep_good
from recordforge.llm.store import written

TOKENIZER = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word shingle similarity 0.8 or more: that of the least id."""
    return drop_near_duplicates(docs, shingle=5, threshold=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of a benchmark item, nor a whole shorter item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars is the new length."""
    return redact_pii(docs, length_col="n_chars")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences of 1024."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]

#: Label models, locality-sensitive hashing and packing aren't SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
