"""Duplicates by key: one row of each group survives, and the others are purged unless that would lose content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordforge.functions.nulls import present, sure
from recordforge.operators.matching import content_asymmetry
from recordforge.operators.ranking import survivors


def usefulness(own_media: str, foreign_media: str, placeholder: str) -> Column:
    """16 for a real cover, 8 for real hours, 4 for a taxonomy, 2 for an active outlet."""
    cover = sure(present(F.col("cover")) & F.col("cover").rlike(own_media) & ~F.col("cover").rlike(foreign_media) & ~F.col("cover").rlike(placeholder))
    points = ((cover, 16), (sure((F.col("hours_status") == "done") & (F.col("n_hours") > 0)), 8), (sure(present(F.col("industry")) & (F.col("n_categories") > 0)), 4), (sure(F.col("n_outlets") >= 1), 2))
    return sum((F.when(c, n).otherwise(0) for c, n in points), F.lit(0))


def plan(rows: DataFrame, key: str, score: Column, *, created: str = "created", id_col: str = "id") -> DataFrame:
    """What to do with each row of a group of several: (id, key, score, survivor_id, action), action keep or purge."""
    grouped = survivors(rows.where(present(F.trim(F.col(key)))).withColumn(key, F.trim(F.col(key))), key, score, created=created, id_col=id_col).where("group_size > 1")
    return grouped.select(id_col, key, "score", "survivor_id", F.when(F.col("is_survivor"), "keep").otherwise("purge").alias("action"))


def guarded(planned: DataFrame, buckets: dict[str, DataFrame], *, id_col: str = "id") -> DataFrame:
    """A plan in which rows that hold content their survivor lacks are flagged instead of purged."""
    pairs = planned.where("action = 'purge'").select(F.col("survivor_id").alias("winner"), F.col(id_col).alias("loser"))
    lost = content_asymmetry(pairs, buckets).select(F.col("loser").alias(id_col), "only_loser_has")
    out = planned.join(lost, id_col, "left").withColumn("only_loser_has", F.coalesce("only_loser_has", F.array().cast("array<string>")))
    return out.withColumn("action", F.when((F.col("action") == "purge") & (F.size("only_loser_has") > 0), "flag").otherwise(F.col("action")))


def totals(planned: DataFrame, key: str) -> DataFrame:
    return planned.agg(F.count_distinct(key).alias("groups"), F.count_if(F.col("action") == "keep").alias("kept"), F.count_if(F.col("action") == "purge").alias("purged"), F.count_if(F.col("action") == "flag").alias("flagged"))
