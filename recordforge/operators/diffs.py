"""Differences between two environments, and the outcome for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordforge.functions.nulls import differs, fired, is_true, present, sure


def changed(columns: list[str], *, old: str = "old", new: str = "new") -> Column:
    """Names of columns whose new value differs from the old."""
    return fired(*((c, differs(F.col(f"{old}.{c}"), F.col(f"{new}.{c}"))) for c in columns))


def overlay(stored: Column, default: Column) -> Column:
    """Set a default only where nothing is stored."""
    return F.coalesce(stored, default)


def set_missing(rows: DataFrame, defaults: dict[str, Column], protected: tuple[str, ...] = ()) -> DataFrame:
    """Defaults where a column is null; protected columns stay as they are even then. Adds ``changed_fields``."""
    free = {c: v for c, v in defaults.items() if c not in protected}
    return rows.withColumn("changed_fields", fired(*((c, F.col(c).isNull() & v.isNotNull()) for c, v in free.items()))).withColumns({c: overlay(F.col(c), v) for c, v in free.items()})


def preview(source: DataFrame, target: DataFrame, columns: list[str], *, key: str = "id", asserted: str | None = None, done: DataFrame | None = None) -> DataFrame:
    """What a sync would do: (key, outcome, changed_fields), outcome skipped, missing, assertion_failed, patched or unchanged.

    done: rows (key, version) that were synced in the same version already, and are skipped. asserted: a column that must
    be equal on both sides.
    """
    pick = lambda d, as_: d.select(key, F.struct(*{*columns, *([asserted] if asserted else [])}).alias(as_))
    both = pick(source, "new").join(pick(target, "old"), key, "left")
    if done is not None:
        both = both.join(done.select(key).distinct().withColumn("_done", F.lit(True)), key, "left")
    else:
        both = both.withColumn("_done", F.lit(False))
    fields = changed(columns)
    failed = differs(F.col(f"old.{asserted}"), F.col(f"new.{asserted}")) if asserted else F.lit(False)
    outcome = F.when(is_true(F.col("_done")), "skipped").when(F.col("old").isNull(), "missing").when(failed, "assertion_failed").when(F.size(fields) > 0, "patched").otherwise("unchanged")
    return both.select(key, outcome.alias("outcome"), F.when(outcome == "patched", fields).otherwise(F.array().cast("array<string>")).alias("changed_fields"))


def compare_address(stored: dict[str, Column], proposed: dict[str, Column]) -> Column:
    """unparsed, correct or mismatch of a proposed address and the stored one: case and spaces at the ends don't count, nor
    a proposed null."""
    norm = lambda c: F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))
    same = F.lit(True)
    for field, c in proposed.items():
        same = same & (c.isNull() | (norm(c) == norm(stored[field])))
    nothing = F.lit(True)
    for c in proposed.values():
        nothing = nothing & (norm(c) == "")
    return F.when(nothing, "unparsed").when(same, "correct").otherwise("mismatch")


def apply_proposals(rows: DataFrame, proposals: DataFrame, columns: list[str], *, key: str = "id") -> DataFrame:
    """Rows with their proposals applied: (key, outcome, before, after); outcome applied, no_proposal, not_mismatch or blank."""
    p = proposals.select(key, F.col("status").alias("_status"), F.struct(*columns).alias("_new"))
    both = rows.select(key, F.struct(*columns).alias("before")).join(p, key, "left")
    some = F.lit(False)
    for c in columns:
        some = some | sure(present(F.col(f"_new.{c}").cast("string")))
    outcome = F.when(F.col("_status").isNull(), "no_proposal").when(F.col("_status") != "mismatch", "not_mismatch").when(~some, "blank").otherwise("applied")
    after = F.struct(*(F.when(outcome == "applied", F.coalesce(F.col(f"_new.{c}"), F.col(f"before.{c}"))).otherwise(F.col(f"before.{c}")).alias(c) for c in columns))
    return both.select(key, outcome.alias("outcome"), "before", after.alias("after"))


def outlet_patch() -> tuple[dict[str, Column], Column]:
    """An outlet's repairs and the names of what they change: a point from its coordinates, arrays and counters that are
    null, and a category."""
    good = F.col("lat").between(-90, 90) & F.col("lng").between(-180, 180) & ~((F.col("lat") == 0) & (F.col("lng") == 0))
    point = F.when(sure(good), F.struct(F.col("lng").alias("lng"), F.col("lat").alias("lat"))).otherwise(F.col("location"))
    new = {"location": point, "tags": F.coalesce("tags", F.array().cast("array<string>")), "views": F.coalesce("views", F.lit(0)), "category": F.coalesce("category", F.lit("physical"))}
    return new, fired(*((c, differs(v, F.col(c))) for c, v in new.items()))


def unit_counts(outlets: DataFrame, *, parent: str = "parent_id") -> DataFrame:
    """Active physical and mobile outlets of each parent."""
    active = is_true(F.col("is_active")) & ~F.coalesce("is_deleted", F.lit(False))
    return outlets.groupBy(parent).agg(F.count_if(active & (F.col("category") == "physical")).alias("physical"), F.count_if(active & (F.col("category") == "mobile")).alias("mobile"))
