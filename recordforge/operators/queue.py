"""Job queues as tables: what is eligible, suppressed, stuck or next, each with the time as a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordforge.functions.nulls import sure
from recordforge.operators.ranking import claim, first_per


def not_in_flight(wanted: DataFrame, jobs: DataFrame) -> DataFrame:
    """Wanted (business_id, type) rows without a pending or running job of the type."""
    return wanted.join(jobs.where(F.col("status").isin("pending", "running")).select("business_id", "type").distinct(), ["business_id", "type"], "left_anti")


def suppressed(jobs: DataFrame, now: Column, *, cooldown: str = "15 minutes", span: str = "4 hours", most: int = 5) -> DataFrame:
    """(business_id, type) that shouldn't be queued: in flight, finished within the cooldown, or tried often in the span."""
    ago = lambda d: now - F.expr(f"interval {d}")
    ended = F.col("status").isin("done", "failed")
    found = jobs.groupBy("business_id", "type").agg(F.count_if(F.col("status").isin("pending", "running")).alias("flying"), F.count_if(ended & (F.col("completed") > ago(cooldown))).alias("recent"), F.count_if(ended & (F.col("completed") > ago(span))).alias("tries"))
    return found.where((F.col("flying") > 0) | (F.col("recent") > 0) | (F.col("tries") >= most)).select("business_id", "type")


def stuck(jobs: DataFrame, now: Column, *, after: str = "10 minutes", attempts: int = 3) -> DataFrame:
    """Jobs with those that run for too long pending again, if they have attempts left."""
    late = sure((F.col("status") == "running") & (F.col("claimed") < now - F.expr(f"interval {after}")) & (F.col("attempts") < attempts))
    return jobs.withColumns({"status": F.when(late, "pending").otherwise(F.col("status")), "was_reset": late})


def settle(jobs: DataFrame, outcomes: DataFrame, *, attempts: int = 3) -> DataFrame:
    """Jobs after outcomes (id, ok): done, or failed once attempts are used up, else pending."""
    both = jobs.join(outcomes.select("id", F.col("ok").alias("_ok")), "id", "left")
    return both.withColumn("status", F.when(F.col("_ok").isNull(), F.col("status")).when(F.col("_ok"), "done").when(F.col("attempts") >= attempts, "failed").otherwise("pending")).drop("_ok")


def enqueue(wanted: DataFrame, *, tier: str = "tier", start: Column) -> DataFrame:
    """Jobs tier by tier, each (business_id, type) once, in its first tier.

    ``created`` grows by tier and business id: a tier takes a day's worth of milliseconds, so that no task ranks all rows.
    """
    once = first_per(wanted, ["business_id", "type"], [F.col(tier), F.col("business_id")])
    order = F.dense_rank  # tiers are few; their rank comes from a small aggregate
    tiers = once.select(tier).distinct().withColumn("_rank", order().over(_by(tier)))
    step = F.col("_rank") * 86_400_000 + F.pmod(F.col("business_id"), F.lit(86_400_000))
    return once.join(tiers, tier).withColumn("created", F.timestamp_millis(F.unix_millis(start) + step)).drop("_rank")


def _by(tier: str):
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0)).orderBy(tier)


def throughput(jobs: DataFrame, now: Column, *, minutes: int = 15) -> DataFrame:
    """Done in the last minutes, the hourly rate, what is pending, and hours left (null: stalled)."""
    recent = F.count_if((F.col("status") == "done") & (F.col("completed") > now - F.expr(f"interval {minutes} minutes")))
    out = jobs.agg(recent.alias("recent"), F.count_if(F.col("status") == "pending").alias("pending")).withColumn("hourly", F.col("recent") * (60 // minutes))
    return out.withColumn("hours_left", F.when(F.col("hourly") > 0, F.floor(F.col("pending") / F.col("hourly"))))


def drain(done: DataFrame, ledger: DataFrame, *, key: str = "source_id", order: str = "id") -> DataFrame:
    """Finished jobs to consume: ``inserts`` for the first of each source that the ledger lacks, others are consumed only."""
    fresh = first_per(done.join(ledger.select(key).distinct(), key, "left_anti"), [key], [F.col(order)]).select(order).withColumn("_new", F.lit(True))
    return done.join(fresh, order, "left").withColumn("inserts", F.coalesce("_new", F.lit(False))).drop("_new")


def not_passed(rows: DataFrame, marker: str, pass_id: str) -> DataFrame:
    """Rows that a pass hasn't handled yet."""
    return rows.where(~F.col(marker).eqNullSafe(F.lit(pass_id)))


def latest(events: DataFrame, keys: list[str], value: str, at: str) -> DataFrame:
    """The last value of each key: progress that was written piece by piece."""
    return events.groupBy(*keys).agg(F.max_by(value, F.struct(at, value)).alias(value))


def quota(rows: DataFrame, events: DataFrame, now: Column, *, span: str = "72 hours", most: int = 12, key: str = "id") -> DataFrame:
    """How many more events each row may get: those in the span count."""
    recent = events.where(F.col("at") >= now - F.expr(f"interval {span}")).groupBy(key).agg(F.count(F.lit(1)).alias("have"))
    return rows.join(recent, key, "left").withColumn("remaining", F.greatest(F.lit(0), most - F.coalesce("have", F.lit(0)))).drop("have")


def reset(rows: DataFrame, to: str, cleared: dict[str, list[str]]) -> DataFrame:
    """Rows set back to a stage, with the columns of later stages empty."""
    return rows.withColumns({c: F.lit(None).cast(rows.schema[c].dataType) for c in cleared[to]} | {"status": F.lit(to)})


def next_batch(rows: DataFrame, jobs: DataFrame, *, window: int = 1500, n: int = 500) -> DataFrame:
    """Up to ``n`` of the first ``window`` rows by id that have a name and place and no job in flight; both limits count."""
    first = rows.orderBy("id").limit(window)
    free = first.join(jobs.where(F.col("status").isin("pending", "running")).select(F.col("business_id").alias("id")), "id", "left_anti")
    return free.where("trim(coalesce(name, '')) <> '' and trim(coalesce(place_id, '')) <> ''").orderBy("id").limit(n)


__all__ = ["claim", "drain", "enqueue", "latest", "next_batch", "not_in_flight", "not_passed", "quota", "reset", "settle", "stuck", "suppressed", "throughput"]
