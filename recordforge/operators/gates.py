"""Quality gates: criteria of a record, in three presets, and the first that fails.

A record has the columns is_active, n_outlets, cover, hours_status, n_hours, industry, n_categories, address, city,
place_id, lat, lng, country, match, email and email_source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordforge.functions import geo
from recordforge.functions.address import street_shape
from recordforge.functions.nulls import every, is_true, present, sure
from recordforge.operators.filters import cohort

#: The order in which a record is told why it fails.
ORDER = ("active_outlet", "verified_place", "real_cover", "real_hours", "taxonomy", "valid_address", "single_place", "domestic")


@dataclass(frozen=True)
class Profile:
    """own_media, placeholder, foreign_media: patterns of cover URLs. street: whether an address must look like a street
    line. verified: whether a place that was shown to be wrong fails. filtered: count a place's rows among those that meet
    all other criteria, instead of among all."""

    own_media: str = r"(?i)media\.example"
    placeholder: str = r"(?i)/Defaults/"
    foreign_media: str = r"(?i)googleusercontent"
    street: bool = True
    verified: bool = True
    filtered: bool = False


CONSOLE, SYNC, PROMOTION = Profile(), Profile(street=False, verified=False), Profile(street=False, own_media="media\\.example", filtered=True)


def criteria(p: Profile) -> dict[str, Column]:
    """All criteria but the single place, each true or false for every row."""
    cover, address, city, country = F.col("cover"), F.trim(F.coalesce("address", F.lit(""))), F.trim(F.coalesce("city", F.lit(""))), F.lower(F.trim(F.coalesce("country", F.lit(""))))
    contact = address.rlike(r"(?i)^\s*(https?://|www\.)") | address.rlike(r"^\+?[\d\s\-().]{7,}$")
    good = (address != "") & ~contact & (city != "") & ~city.rlike("(?i)county")
    return {
        "active_outlet": is_true(F.col("is_active")) & sure(F.col("n_outlets") >= 1),
        "verified_place": ~F.col("match").eqNullSafe(F.lit(False)) if p.verified else F.lit(True),
        "real_cover": sure(present(cover) & ~cover.rlike(p.placeholder) & ~cover.rlike(p.foreign_media) & cover.rlike(p.own_media)),
        "real_hours": sure((F.col("hours_status") == "done") & (F.col("n_hours") > 0)),
        "taxonomy": sure(present(F.col("industry")) & (F.col("n_categories") > 0)),
        "valid_address": good & street_shape(F.col("address")) if p.street else good,
        "domestic": sure(~((F.col("lat") == 0) & (F.col("lng") == 0)) & country.isin("", "united states") & geo.in_box(F.col("lat"), F.col("lng"))),
        "verified_email": sure((F.col("email_source") == "website_scrape") & (F.trim(F.coalesce("email", F.lit(""))) != "")),
        "verified_name": F.lit(False),
    }


def evaluate(rows: DataFrame, p: Profile = CONSOLE) -> DataFrame:
    """Adds ``gate``: a struct of all criteria, ``pass_core`` and ``pass_all``.

    A place is single if at most one row has it, counted over its trimmed value by an aggregate that rows are joined with.
    """
    place = F.trim(F.coalesce(F.col("place_id"), F.lit("")))
    c = criteria(p)
    named = rows.withColumns({f"_{k}": v for k, v in c.items()}).withColumn("_place", F.nullif(place, F.lit("")))
    rest = [k for k in ORDER if k != "single_place"]
    met = F.lit(True)
    for k in rest:
        met = met & F.col(f"_{k}")
    counted = named.where(met) if p.filtered else named
    counts = counted.where("_place is not null").groupBy("_place").agg(F.count(F.lit(1)).alias("_n"))
    out = named.join(counts, "_place", "left").withColumn("_single_place", F.col("_place").isNotNull() & (F.coalesce("_n", F.lit(0)) <= 1))
    core = met & F.col("_single_place")
    parts = [*(F.col(f"_{k}").alias(k) for k in (*ORDER, "verified_email", "verified_name")), core.alias("pass_core"), (core & F.col("_verified_email") & F.col("_verified_name")).alias("pass_all")]
    return out.select(*rows.columns, F.struct(*parts).alias("gate"))


def first_fail(gate: str = "gate") -> Column:
    """The first criterion that fails, or null."""
    return F.coalesce(*(F.when(~is_true(F.col(f"{gate}.{k}")), F.lit(k)) for k in ORDER))


def tier(gate: str, fixable: list[str], blocking: list[str]) -> Column:
    """P1: not blocked and one deficit that can be fixed; P2: several; P3: blocked with any; passing: none; blocked: only blocked."""
    fails = lambda names: sum(((~is_true(F.col(f"{gate}.{n}"))).cast("int") for n in names), F.lit(0))
    n, b = fails(fixable), fails(blocking)
    return F.when((b == 0) & (n == 0), "passing").when((b == 0) & (n == 1), "P1").when(b == 0, "P2").when(n >= 1, "P3").otherwise("blocked")


def migration_scope(rows: DataFrame, own_media: str = r"media\.example") -> DataFrame:
    """Rows that pass the filter of a migration, with ``reason``: valid_address, single_place, domestic, or null for those that may go.

    The filter's twelve conditions are the cohort, an active outlet of an active row, an own cover (case counts), hours that
    are done and captured, industry, categories, an address, a city that is no county, a place id, and a match that isn't
    known to be wrong. A place is single if one row that passed has it; the others are all refused.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    passes = every(
        cohort(), is_true(F.col("is_active")), sure(F.col("n_outlets") >= 1), sure(F.col("cover").rlike(own_media)), sure(F.col("hours_status") == "done"), sure(F.col("n_hours") > 0), F.col("industry").isNotNull(), sure(F.col("n_categories") > 0),
        present(F.col("address")), ~sure(F.col("city").rlike("(?i)county")), present(F.col("place_id")), ~F.col("match").eqNullSafe(F.lit(False)),
    )
    own = rows.where(passes).withColumn("_place", text("place_id"))
    counts = own.where("_place <> ''").groupBy("_place").agg(F.count(F.lit(1)).alias("_n"))
    contact = text("address").rlike(r"(?i)^\s*(https?://|www\.)") | text("address").rlike(r"^\+?[\d\s\-().]{7,}$")
    country = F.lower(text("country"))
    home = sure(~((F.col("lat") == 0) & (F.col("lng") == 0)) & country.isin("", "united states") & geo.in_box(F.col("lat"), F.col("lng")))
    reason = F.when((text("address") == "") | contact | (text("city") == ""), "valid_address").when((F.col("_place") == "") | (F.coalesce("_n", F.lit(0)) > 1), "single_place").when(~home, "domestic")
    return own.join(counts, "_place", "left").select(*rows.columns, reason.alias("reason"))
