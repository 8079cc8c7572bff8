"""Counts and summaries, each as one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordforge.functions.nulls import is_true, present, truthy
from recordforge.functions.text import round_half_up


def histogram(rows: DataFrame, column: str, values: list[str], *, by: list[str] | None = None) -> DataFrame:
    """How many rows have each value, values without rows as 0: one column for each value."""
    counts = [F.count_if(F.col(column) == v).alias(v) for v in values]
    return rows.groupBy(*by).agg(*counts) if by else rows.agg(*counts)


def facets(rows: DataFrame, gate: str, criteria: list[str], passes: list[str]) -> DataFrame:
    """One row: the total, how many pass each aggregate, and how many fail each criterion."""
    return rows.agg(
        F.count(F.lit(1)).alias("total"), *(F.count_if(is_true(F.col(f"{gate}.{p}"))).alias(p) for p in passes), *(F.count_if(~is_true(F.col(f"{gate}.{c}"))).alias(f"fail_{c}") for c in criteria)
    )


def freshness(rows: DataFrame, at: str) -> DataFrame:
    return rows.agg(F.min(at).alias("oldest"), F.max(at).alias("newest"), F.count(F.lit(1)).alias("total"), F.count(at).alias("computed"), (F.count(F.lit(1)) - F.count(at)).alias("missing"))


def duplicate_groups(rows: DataFrame, key: str, *, id_col: str = "id") -> DataFrame:
    """Values of a key that more than one row has, trimmed first: (key, n, first_id). Join back on the key for members."""
    return rows.where(present(F.trim(F.col(key)))).groupBy(F.trim(F.col(key)).alias(key)).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first_id")).where("n > 1")


def coverage(rows: DataFrame, place: str, published: Column, *, state: str | None = None) -> DataFrame:
    """By place (missing and empty as Unknown): total, published, pending, rate in whole percent, and a state."""
    name = F.coalesce(truthy(F.col(place)), F.lit("Unknown"))
    out = rows.groupBy(name.alias(place)).agg(F.count(F.lit(1)).alias("total"), F.count_if(published).alias("published"), *([F.min(truthy(F.col(state))).alias("state")] if state else []))
    return out.withColumns({"pending": F.greatest(F.lit(0), F.col("total") - F.col("published")), "publish_rate": round_half_up(100 * F.col("published") / F.col("total"))})


def mode(rows: DataFrame, by: list[str], value: Column, ordinal: str) -> DataFrame:
    """The most frequent value that isn't empty in each group; of several the one seen first. (by, mode, n)"""
    counts = rows.withColumn("_v", truthy(value)).where("_v is not null").groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("n"), F.min(ordinal).alias("_first"))
    return counts.groupBy(*by).agg(F.min_by(F.struct("_v", "n"), F.struct((-F.col("n")).alias("n"), "_first")).alias("_m")).select(*by, F.col("_m._v").alias("mode"), F.col("_m.n").alias("n"))


def count_by(rows: DataFrame, column: str, *, missing: str = "unknown") -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(column), F.lit(missing)).alias(column)).agg(F.count(F.lit(1)).alias("n"))


def reasons(rows: DataFrame, reason: str, *, ok: Column | None = None) -> DataFrame:
    """How many rows have each reason."""
    return rows.where(F.col(reason).isNotNull() if ok is None else ~ok).groupBy(reason).agg(F.count(F.lit(1)).alias("n"))


def mismatch_stats(rows: DataFrame, outcome: str, place: str, *, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """Counts by outcome, and the places with most mismatches."""
    return rows.groupBy(outcome).agg(F.count(F.lit(1)).alias("n")), rows.where(F.col(outcome) == "mismatch").groupBy(place).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), place).limit(top)


def summary(rows: DataFrame, **checks: Column) -> DataFrame:
    """One row: the total and how many rows meet each condition."""
    return rows.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(c).alias(name) for name, c in checks.items()))


def exclusive(rows: DataFrame, flags: list[str]) -> DataFrame:
    """One row: how many have only each flag, several, and none."""
    on = {f: is_true(F.col(f)).cast("int") for f in flags}
    n = sum(on.values(), F.lit(0))
    return rows.agg(*(F.count_if((on[f] == 1) & (n == 1)).alias(f"only_{f}") for f in flags), F.count_if(n >= 2).alias("several"), F.count_if(n == 0).alias("none"))


def transitions(rows: DataFrame, before: str, after: str) -> DataFrame:
    return rows.groupBy(before, after).agg(F.count(F.lit(1)).alias("n"))


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(present(F.col(column))).select(column).distinct().orderBy(column)


def progress(rows: DataFrame, by: list[str], done: Column, bucket: str, example: str, *, n: int = 3) -> DataFrame:
    """For each batch: rows, rows done, whether complete, and by bucket a count and its first ``n`` examples."""
    from recordforge.operators.ranking import first_per

    totals = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("done")).withColumn("complete", F.col("done") >= F.col("total"))
    some = first_per(rows, [*by, bucket], [F.col(example)], n=n).groupBy(*by, bucket).agg(F.array_sort(F.collect_list(F.col(example).cast("string"))).alias("examples"))
    counts = rows.groupBy(*by, bucket).agg(F.count(F.lit(1)).alias("in_bucket"))
    return counts.join(some, [*by, bucket]).join(totals, by)


def dashboard(rows: DataFrame, day: Column, *, at: str = "published_at") -> DataFrame:
    """Totals failed, in review, and published on a day (of the session's time zone)."""
    return summary(rows, failed=F.col("status") == "failed", in_review=F.col("status") == "review", published_today=F.to_date(at) == day)


def top_shares(rows: DataFrame, name: str, total: str, *, n: int = 8) -> DataFrame:
    """The ``n`` largest rows and their share of what is shown, in whole percent."""
    shown = rows.orderBy(F.desc(total), name).limit(n)
    return shown.select(name, total, round_half_up(100 * F.col(total) / F.sum(total).over(Window.partitionBy(F.lit(0)))).alias("share"))


def by_section(items: DataFrame, by: list[str], section: str, ordinal: str, *, default: str = "Highlights") -> DataFrame:
    """Items by section in the order first seen: (by, section, place, n)."""
    named = items.groupBy(*by, F.coalesce(truthy(F.col(section)), F.lit(default)).alias(section)).agg(F.count(F.lit(1)).alias("n"), F.min(ordinal).alias("place"))
    return named


def gap(target: Column, have: Column) -> Column:
    return F.greatest(F.lit(0), target - have)


def session_totals(sessions: DataFrame, *, live: tuple[str, ...] = ("production", "prod")) -> DataFrame:
    """One row over sessions: records, published ones, the split of these by whether the session went live, places and the rate.

    Columns: total, published, city, migrated_to (names of environments). Places count if a session of theirs has records.
    """
    gone = F.coalesce(F.arrays_overlap("migrated_to", F.array(*map(F.lit, live))), F.lit(False))
    out = sessions.agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("published"), F.lit(0)).alias("published"), F.coalesce(F.sum(F.when(gone, F.col("published"))), F.lit(0)).alias("live"),
        F.count_distinct(F.when(present(F.col("city")) & (F.col("total") > 0), F.col("city"))).alias("cities"),
    )
    rate = F.when(F.col("total") > 0, round_half_up(100 * F.col("published") / F.col("total"))).otherwise(0)
    return out.withColumns({"staging": F.greatest(F.lit(0), F.col("published") - F.col("live")), "publish_rate": rate})
