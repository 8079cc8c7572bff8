"""A discovery run: places that are new, near nothing known, and worth a closer look."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordforge.operators.judgement import blocked
from recordforge.operators.matching import near_existing


def candidates(places: DataFrame, known: DataFrame, processed: DataFrame, *, least_confidence: float = 0.5, metres: float = 50, least: float = 0.85) -> DataFrame:
    """Each place with ``outcome``: blocked, low_confidence, processed, duplicate or candidate; the first that holds."""
    near = near_existing(places.withColumnRenamed("source_id", "id"), known, metres=metres, least=least).select(F.col("id").alias("source_id")).distinct().withColumn("_near", F.lit(True))
    seen = processed.select("source_id").distinct().withColumn("_seen", F.lit(True))
    both = places.join(near, "source_id", "left").join(seen, "source_id", "left")
    outcome = F.when(blocked(F.col("category")), "blocked").when(~F.coalesce(F.col("confidence") >= least_confidence, F.lit(False)), "low_confidence").when(F.col("_seen"), "processed").when(F.col("_near"), "duplicate").otherwise("candidate")
    return both.withColumn("outcome", outcome).drop("_near", "_seen")


def batch(found: DataFrame, n: int) -> DataFrame:
    """The next ``n`` candidates by source id."""
    return found.where("outcome = 'candidate'").orderBy("source_id").limit(n)
