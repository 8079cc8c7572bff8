"""Token counts behind a digest cache: only texts that the cache doesn't know are encoded, each once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from importlib.metadata import version

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordforge.llm.store import join_hot, written
from recordforge.llm.tokens import encoder, read_tokenizer, text_runs
from recordforge.llm.words import tidy

CACHE_SCHEMA = "version string, digest binary, n_tokens long"


def tokenizer_version(name: str, data: bytes) -> str:
    """A digest of the tokenizer's file and of the library that reads it."""
    library = "sentencepiece" if name.endswith(".model") else "tokenizers"
    return hashlib.sha256(f"{name} {library} {version(library)} ".encode() + data).hexdigest()


def _count_task(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, data, digest = shared.value
        counter = encoder(name, data, digest)
        for batch in batches:
            for lo, texts in text_runs(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("digest").slice(lo, len(texts)), pa.array(counter.counts(texts))], names=["digest", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Count each text's tokens as the tokenizer's library does, without special tokens, truncation or padding.

    tokenizer: path of a ``.json`` or ``.model`` file, read by the driver. cache: path of a Parquet table, made if it is
    missing, of counts by tokenizer version and digest of the normalised text. Normalising turns null into the empty
    text and nothing else, for any other change could change the count. Texts that the cache lacks are encoded once
    each, whatever the number of rows that hold them, and appended to it.

    Returns one row for each row of ``docs``: its id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``. Repeated
    rows each get their count. A very long text is handled alone and whole. An empty table gives an empty result and
    appends nothing. Other columns are ignored.
    """
    spark = docs.sparkSession
    name, data = read_tokenizer(tokenizer)
    tag = tokenizer_version(name, data)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    keyed = written(rows.select("id", digest, F.octet_length("text").cast("long").alias("n_bytes")), "digests")

    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        spark.createDataFrame([], CACHE_SCHEMA).write.parquet(cache)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("version") == tag).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    misses = keyed.groupBy("digest").agg(F.min("id").alias("id")).join(stored, "digest", "left_anti")
    # One row for each missing digest: the one with its least id. The small side is hashed, so that texts aren't sorted.
    texts = rows.select("id", "text", digest).alias("t").join(misses.alias("m").hint("shuffle_hash"), (F.col("t.digest") == F.col("m.digest")) & F.col("t.id").eqNullSafe(F.col("m.id"))).select("t.digest", "t.text")
    shared = spark.sparkContext.broadcast((name, data, tag.encode()))
    known = written(stored.join(keyed.select("digest").distinct(), "digest", "left_semi"), "known")
    fresh = written(texts.mapInArrow(tidy(_count_task(shared)), "digest binary, n_tokens long").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    fresh.select(F.lit(tag).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)

    # Copies of one text can be most rows.
    out = join_hot(keyed, fresh.unionByName(known), "digest")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
