"""Written intermediate tables: they cut lineage and survive the loss of an executor."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNSET_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; a local one only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or UNSET_DIR
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for a table called ``name``, in this application's own folder."""
    return f"{shared_dir(spark)}/recordforge/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has written. What operators returned can't be read any more after that.

    A result is read when its plan runs, so that an operator can't know when its tables may go: the caller does.
    """
    _delete(spark, f"{shared_dir(spark)}/recordforge/{spark.sparkContext.applicationId}")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back with a known schema."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._recordforge_path = path
    return out


def by_position(docs: DataFrame) -> DataFrame:
    """``docs`` with columns c0, c1 and so on: Arrow tasks resolve columns by name, which fails for names with dots."""
    return docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))


def drop(*frames: DataFrame) -> None:
    """Delete written tables that no later plan reads."""
    for df in frames:
        path = getattr(df, "_recordforge_path", None)
        if path:
            _delete(df.sparkSession, path)


#: A key is hot if it holds more than one in so many rows; there are fewer hot keys than that.
HOT = 1000


def join_hot(rows: DataFrame, one: DataFrame, key: str, keys: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``one``, which has at most one row for each ``key``, where any key may hold most of the rows.

    Hot keys, fewer than HOT, are counted first; what ``one`` says of them is broadcast to their rows. All others are
    joined by a shuffle. Rows without a key or with one that isn't in ``one`` are left out. ``keys``: the rows' keys, where
    these are at hand and the rows dear to read.
    """
    counted = (rows if keys is None else keys).where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    hot = [r[0] for r in counted.where(F.col("n") * HOT > max(total, 100 * HOT)).select(key).collect()]
    if not hot:
        return rows.join(one, key)
    of = F.col(key).isin(hot)
    return rows.where(~of).join(one.where(~of), key).unionByName(rows.where(of).join(F.broadcast(one.where(of)), key))
