"""Rule tier of the judges, and how their decisions route a record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordforge.functions import address, geo
from recordforge.functions.names import label_name
from recordforge.functions.nulls import fired, is_true

#: Source categories that are no businesses.
BLOCKED = (
    "apartments", "apartment_building", "apartment_complex", "condominium", "residential", "residential_building", "serviced_apartments", "housing_cooperative", "community_center", "community_service_non_profit",
    "landmark_and_historical_building", "historic_site", "bridge", "mountain", "parking", "parking_lot", "parking_garage", "public_bathroom", "rest_area", "viewpoint", "monument", "cemetery",
)
#: Labels of source categories.
CATEGORY_LABELS = {
    "nail salon": "Beauty & Wellness / Nail", "spa": "Beauty & Wellness / Spa & Massage", "day spa": "Beauty & Wellness / Spa & Massage", "hair salon": "Beauty & Wellness / Hair", "barber": "Beauty & Wellness / Hair",
    "barber shop": "Beauty & Wellness / Hair", "beauty salon": "Beauty & Wellness / Beauty", "medical spa": "Beauty & Wellness / Med spa", "med spa": "Beauty & Wellness / Med spa",
    "real_estate_agent": "Local Services / Business & Professional", "professional_services": "Local Services / Business & Professional", "gas_station": "Retail & Shopping / Grocery / Market",
    "atms": "Retail & Shopping / Specialty / Boutique", "beauty_salon": "Beauty & Wellness / Beauty", "counseling_and_mental_health": "Beauty & Wellness / Wellness", "restaurant": "Food & Drink / Restaurant",
    "doctor": "Beauty & Wellness / Wellness", "pharmacy": "Retail & Shopping / Grocery / Market",
}


def blocked(category: Column) -> Column:
    """A category that is no business; a missing one is blocked too."""
    return F.coalesce(category, F.lit("")).isin("", *BLOCKED)


def category_label(raw: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in CATEGORY_LABELS.items() for x in pair))
    return F.try_element_at(table, F.lower(F.trim(F.regexp_replace(raw, r"\s+", " "))))


def category_judge(raw: Column) -> Column:
    """struct(label, confidence, source): a known category is sure, else it is left to a further tier."""
    label = category_label(raw)
    return F.struct(label.alias("label"), F.when(label.isNotNull(), 0.9).otherwise(0.0).alias("confidence"), F.when(label.isNotNull(), "rule").alias("source"))


def city_judge(formatted: Column) -> Column:
    """struct(city, confidence, reason) from a formatted address."""
    d = address.derive_city(formatted)
    return F.struct(d["city"].alias("city"), F.when(d["city"].isNotNull(), 0.95).otherwise(0.0).alias("confidence"), d["reason"].alias("reason"))


def anomaly_judge(name: Column, formatted: Column, lat: Column, lng: Column, known: Column, confirmed: Column) -> Column:
    """struct(anomalies, action, confidence) by rules; action is null if the rules can't tell."""
    abroad_text = F.lower(F.trim(F.coalesce(formatted, F.lit("")))).rlike(r",\s*(usa|united states)\s*$")
    found = fired(("junk_name", label_name(name)), ("exact_duplicate", is_true(known)), ("wrong_country", abroad_text & ~geo.in_box(lat, lng, geo.NARROW)))
    action = F.when(F.array_contains(found, "junk_name") | F.array_contains(found, "exact_duplicate"), "skip").when(is_true(confirmed) & (F.size(found) == 0), "accept")
    confidence = F.when(F.array_contains(found, "junk_name"), 0.9).when(F.array_contains(found, "exact_duplicate"), 0.95).when(action == "accept", 0.9).otherwise(0.0)
    return F.struct(found.alias("anomalies"), action.alias("action"), confidence.alias("confidence"))


def route(industry: Column, industry_confidence: Column, anomaly_action: Column, below: list[Column], *, threshold: float = 0.7) -> Column:
    """struct(action, needs_review): not_applicable before skip before accept before review."""
    any_below = F.lit(False)
    for b in below:
        any_below = any_below | is_true(b)
    skip = anomaly_action.eqNullSafe(F.lit("skip"))
    action = F.when(industry.isNull() & (industry_confidence >= threshold) & ~skip, "not_applicable").when(skip, "skip").when(anomaly_action.eqNullSafe(F.lit("accept")) & ~any_below, "accept").otherwise("review")
    return F.struct(action.alias("action"), ((action != "not_applicable") & any_below).alias("needs_review"))
