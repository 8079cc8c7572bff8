"""What an incoming result changes on a record: each field decides for itself, and the hours decide for the record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordforge.functions import address, hours
from recordforge.functions.names import compare_names, valid_place_id
from recordforge.functions.nulls import bind, fired, present, sure


def resolve(records: DataFrame, results: DataFrame, mapping: DataFrame, *, writes_address: bool = True, default_week: Column | None = None) -> DataFrame:
    """One row for each result (id): its outcome, the status of each field, and the record's new values.

    records: id, name, place_id, week, rating, cover, industry, categories, address, city. results: id, found_name,
    found_place_id, place_note, hours_lines, rating, cover_url, category, address, error. mapping: (key, industry,
    categories) of source categories, keys normalised; rows beyond a few thousand are joined, not broadcast.

    status and reason: review with business_not_found, bot_error or name_mismatch, each of which changes nothing; else
    done if at least one day of hours was read, and review with the hours' status if not.

    hours_status: done, no_hours_captured, hours_shape or hours_no_days_parsed; days that were read go over the stored
    week. place_status: done, equals_building or not_found; place_action: corrected only if hours were read on the
    same visit and no other record has the id, else pending, collision or unchanged. A rating that is a number is always
    taken. cover_status: pending if there is no cover yet, else skipped. category_status: no_category, unmapped, or correct;
    a mapped category that differs from the record's, whatever the order, is applied. address_status: rejected if it
    can't be split into a valid street line, kept if the stored line is valid, else written; skipped where ``writes_address`` is off.
    """
    taken = records.where(present(F.col("place_id"))).groupBy(F.col("place_id").alias("_pid")).agg(F.min("id").alias("_low"), F.max("id").alias("_high"))
    own = records.select("id", F.struct("name", "place_id", "week", "rating", "cover", "industry", "categories", "address", "city").alias("old"))
    renamed = results.select("id", F.struct(*[c for c in results.columns if c != "id"]).alias("new"))
    key = F.lower(F.trim(F.regexp_replace("new.category", r"\s+", " ")))
    both = renamed.join(own, "id", "left").join(taken, F.col("new.found_place_id") == F.col("_pid"), "left").withColumn("_key", key)
    both = both.join(mapping.select(F.col("key").alias("_key"), F.struct("industry", "categories").alias("map")), "_key", "left")
    building = F.col("new.error") == "resolved_placeid_equals_building"
    both = bind(
        both, error=F.when(~building, F.col("new.error")), note=F.when(building, F.coalesce("new.place_note", F.lit("equals_building"))).otherwise(F.col("new.place_note")),
        named=compare_names(F.col("old.name"), F.col("new.found_name")), parsed=hours.parse_hours_lines(F.col("new.hours_lines")), split=address.split_formatted(F.trim("new.address")),
    )

    valid, go = F.col("_valid"), F.col("_stop").isNull()
    hours_status = F.when(F.col("parsed.kind") == "parsed", "done").when(F.col("parsed.kind") == "empty", "no_hours_captured").when(F.col("parsed.kind") == "shape", "hours_shape").otherwise("hours_no_days_parsed")
    both = bind(
        both, _stop=F.when(F.col("old").isNull(), "business_not_found").when(present(F.col("error")), F.concat(F.lit("bot_error:"), "error")).when(~F.col("named.match"), "name_mismatch"),
        _hours=hours_status, _valid=valid_place_id(F.col("new.found_place_id")), _collides=F.col("_pid").isNotNull() & ((F.col("_low") != F.col("id")) | (F.col("_high") != F.col("id"))),
        _line_ok=address.valid_street(F.col("split.street")), _old_ok=address.valid_street(F.col("old.address")),
    )
    differs = ~F.col("map.industry").eqNullSafe(F.col("old.industry")) | ~F.array_sort("map.categories").eqNullSafe(F.array_sort(F.coalesce("old.categories", F.array().cast("array<string>"))))
    both = bind(
        both, _place=F.when(valid, "done").when(F.col("note") == "equals_building", "equals_building").otherwise("not_found"),
        _action=F.when(~valid, None).when(F.col("new.found_place_id").eqNullSafe(F.col("old.place_id")), "unchanged").when(sure(F.col("_collides")), "collision").when(F.col("_hours") == "done", "corrected").otherwise("pending"),
        _cover=F.when(sure(F.col("new.cover_url").startswith("http")), F.when(present(F.col("old.cover")), "skipped").otherwise("pending")),
        _category=F.when(~present(F.trim("new.category")) | F.col("new.category").isNull(), "no_category").when(F.col("map").isNull(), "unmapped").otherwise("correct"),
        _address=F.when(~present(F.trim("new.address")) | F.col("new.address").isNull(), None).when(F.lit(not writes_address), "skipped").when(F.col("split").isNull() | ~F.col("_line_ok"), "rejected").when(F.col("_old_ok"), "kept").otherwise("written"),
        _rated=go & sure(~F.isnan("new.rating") & (F.abs("new.rating") < float("inf"))), _differs=differs,
    )
    both = bind(both, _read=go & (F.col("_hours") == "done"), _moved=go & sure(F.col("_action") == "corrected"), _applied=go & (F.col("_category") == "correct") & F.col("_differs"), _wrote=go & sure(F.col("_address") == "written"))
    read, moved, rated, applied, wrote = (F.col(c) for c in ("_read", "_moved", "_rated", "_applied", "_wrote"))
    week = hours.overlay_week(F.col("parsed.days"), F.col("old.week"), hours.office_week() if default_week is None else default_week)

    own_status = lambda c: F.when(go, F.col(c)).otherwise(F.concat(F.lit("review:"), "_stop"))
    pick = lambda when, new, old: F.when(when, new).otherwise(F.col(f"old.{old}")).alias(old)
    return both.select(
        "id", F.when(read, "done").otherwise("review").alias("status"), F.coalesce("_stop", F.when(F.col("_hours") != "done", F.concat(F.lit("review:"), "_hours"))).alias("reason"), own_status("_hours").alias("hours_status"), own_status("_place").alias("place_status"),
        F.when(go, F.col("_action")).alias("place_action"), F.when(go, F.col("_cover")).alias("cover_status"), F.when(go, F.col("_category")).alias("category_status"), F.when(go, F.col("_address")).alias("address_status"),
        fired(("week", read), ("place_id", moved), ("rating", rated), ("pending_cover", go & sure(F.col("_cover") == "pending")), ("taxonomy", applied), ("address", wrote)).alias("wrote"),
        pick(read, week, "week"), pick(moved, F.col("new.found_place_id"), "place_id"), pick(rated, F.col("new.rating"), "rating"), F.when(go & (F.col("_cover") == "pending"), F.col("new.cover_url")).alias("pending_cover"),
        pick(applied, F.col("map.industry"), "industry"), pick(applied, F.col("map.categories"), "categories"), pick(wrote, F.col("split.street"), "address"), pick(wrote & present(F.col("split.city")), F.col("split.city"), "city"),
    )


def may_overwrite_email(source: Column, stored: Column) -> Column:
    """Whether a scraped address may replace the stored one: there is none, or a scrape put it there."""
    return F.coalesce(F.trim(stored), F.lit("")).eqNullSafe(F.lit("")) | source.eqNullSafe(F.lit("website_scrape"))
