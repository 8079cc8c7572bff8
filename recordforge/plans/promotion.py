"""Promoting records from one environment to another, as reviewable plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordforge.functions.nulls import is_true, present
from recordforge.operators.diffs import preview, unit_counts
from recordforge.operators.gates import PROMOTION, Profile, evaluate, first_fail
from recordforge.operators.matching import has_any_child, merge_parent, two_tier_match
from recordforge.sources.versions import Versioned


def scope(rows: DataFrame, profile: Profile = PROMOTION) -> DataFrame:
    """Each row with ``gate`` and ``reason``, the first criterion it fails (null: it may go)."""
    return evaluate(rows, profile).withColumn("reason", first_fail())


def dry_run(rows: DataFrame, target: DataFrame, media: list[DataFrame]) -> DataFrame:
    """One row: how many are there already, would merge with a parent there, would stand alone, and have media."""
    matched = two_tier_match(rows, target)
    fresh = merge_parent(matched.where("matched_by is null").drop("matched_by"), target)
    pictured = has_any_child(fresh, media)
    there = matched.agg(F.count(F.lit(1)).alias("total"), F.count("matched_by").alias("already_there"))
    rest = pictured.agg(F.count("parent_id").alias("would_merge"), F.count_if(F.col("parent_id").isNull()).alias("standalone"), F.count_if("has_media").alias("with_media"))
    return there.join(rest)


def resolve_conflicts(rows: DataFrame, target: DataFrame, choices: DataFrame, key: str = "place_id") -> DataFrame:
    """insert for keys that the target lacks; of others what was chosen: skip (the default) or merge into the stored row."""
    there = target.where(present(F.col(key))).groupBy(key).agg(F.min("id").alias("target_id"))
    out = rows.join(there, key, "left").join(choices.select("id", "choice"), "id", "left")
    return out.withColumn("action", F.when(F.col("target_id").isNull(), "insert").when(F.col("choice") == "overwrite", "merge").otherwise("skip")).drop("choice")


def session_records(sessions: DataFrame, records: DataFrame, *, published: str = "published_id") -> DataFrame:
    """Records of some sessions, one for each published id: the first by record id."""
    own = records.join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_semi").where(F.col(published).isNotNull())
    first = own.groupBy(published).agg(F.min("id").alias("id"))
    return own.join(first, ["id", published], "left_semi")


def copy_media(items: DataFrame, ids: DataFrame) -> DataFrame:
    """A subtree of drives, folders and files under new owners: all rows get new ids, and their references follow.

    items: (id, kind, owner_id, parent_id); ids: (old_id, new_id) of owners. New ids come from hashes of old id and owner.
    """
    owned = items.join(ids.select(F.col("old_id").alias("owner_id"), F.col("new_id").alias("_owner")), "owner_id")
    made = owned.withColumn("_new", F.substring(F.sha2(F.concat_ws(":", "id", "_owner"), 256), 1, 24))
    parents = made.select(F.col("id").alias("parent_id"), F.col("_owner"), F.col("_new").alias("_parent"))
    return made.join(parents, ["parent_id", "_owner"], "left").select(F.col("_new").alias("id"), "kind", F.col("_owner").alias("owner_id"), F.col("_parent").alias("parent_id"))


def ready_to_apply(preview: DataFrame) -> DataFrame:
    """Of a preview, the rows that an apply step writes."""
    return preview.where(F.col("outcome") == "patched")


def standalone(rows: DataFrame) -> DataFrame:
    return rows.where(~is_true(F.col("is_deleted")) & F.col("parent_id").isNull())


def sync_plan(source: DataFrame, target: DataFrame, columns: list[str], outlets: DataFrame, wallets: DataFrame, markers: DataFrame, version: str, profile: Profile = PROMOTION) -> dict[str, DataFrame]:
    """What a sync would write, by table: ``patches``, ``units``, ``wallets`` and ``markers``; nothing is written here.

    Only source rows that pass the gate count, and of these none whose (id, version) is marked already. A patch has the
    columns' new values and ``changed_fields``. Units are the counts of active outlets of synced rows; a wallet is made for
    each that has none; each synced row is marked with the version.
    """
    passed = scope(source, profile).where("reason is null").select(*source.columns)
    done = markers.where(F.col("version") == version).select("id")
    seen = preview(passed, target, columns, done=done)
    synced = seen.where(F.col("outcome").isin("patched", "unchanged")).select("id")
    patches = passed.join(ready_to_apply(seen).select("id", "changed_fields"), "id").select("id", *columns, "changed_fields")
    units = unit_counts(outlets.join(synced.select(F.col("id").alias("parent_id")), "parent_id", "left_semi"))
    made = synced.join(wallets.select(F.col("owner_id").alias("id")), "id", "left_anti").select(F.col("id").alias("owner_id"), F.lit(0).alias("credits"), F.lit(100).alias("total_credits"), F.lit("active").alias("status"))
    return {"patches": patches, "units": units, "wallets": made, "markers": synced.withColumn("version", F.lit(version))}


def apply_sync(plan: dict[str, DataFrame], tables: dict[str, Versioned], *, environment: str, allowed: tuple[str, ...] = ("staging",), dry_run: bool = True) -> DataFrame:
    """Write a ``sync_plan`` to its tables (businesses, units, wallets, markers), or tell how much it would write: (table, rows, version).

    Only in an allowed environment, one at a time, as the markers' table is held meanwhile. Markers come last: a run that
    fails before them is repeated, and repeating changes nothing, as patches set values, units and markers replace their
    key's row, and a wallet is made only where there is none.
    """
    parts = {"businesses": plan["patches"].drop("changed_fields"), "units": plan["units"], "wallets": plan["wallets"], "markers": plan["markers"]}
    sizes = {name: rows.count() for name, rows in parts.items()}
    versions: dict[str, int | None] = dict.fromkeys(parts)
    if not dry_run:
        if environment not in allowed:
            raise PermissionError(f"nothing may be applied to {environment}")
        with tables["markers"].locked(environment):
            patches = parts["businesses"]
            versions["businesses"] = tables["businesses"].update(patches, [c for c in patches.columns if c != "id"])
            versions["units"] = tables["units"].merge(parts["units"])
            versions["wallets"] = tables["wallets"].insert_missing(parts["wallets"])
            versions["markers"] = tables["markers"].merge(parts["markers"])
    spark = tables["markers"].spark
    return spark.createDataFrame([(name, sizes[name], versions[name]) for name in parts], "table string, rows long, version long")
