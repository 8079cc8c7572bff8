"""Record validation and transformation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordforge.functions import address, contact, hours, text
from recordforge.functions.nulls import bind, blank, fired, first_truthy, over_tasks, present, sure
from recordforge.operators.contained import area_in_text, map_categories
from recordforge.operators.matching import cascade_look_up

ISSUE = "struct<field:string,message:string,severity:string>"


def _issue(when: Column, field: str, message: str, severity: str) -> Column:
    return F.when(sure(when), F.struct(F.lit(field).alias("field"), F.lit(message).alias("message"), F.lit(severity).alias("severity")))


def _out_of_range(c: str, limit: int) -> Column:
    d = F.col(c).try_cast("double")
    return F.col(c).isNotNull() & (d.isNull() | F.isnan(d) | (F.abs(d) > limit))


def issues(kind: str, *, event_types: tuple[str, ...] = ("event", "offer", "announcement"), outlet_types: tuple[str, ...] = ("physical", "mobile", "virtual")) -> Column:
    """All that is wrong with a record of a kind, as an array of (field, message, severity)."""
    short = lambda c, n: F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) < n
    place = [_issue(_out_of_range("latitude", 90), "latitude", "invalid", "error"), _issue(_out_of_range("longitude", 180), "longitude", "invalid", "error")]
    checks = {
        "business": lambda: [
            _issue(short("name", 2), "name", "required", "error"), _issue(present(F.col("email")) & ~contact.valid_email(F.col("email")), "email", "invalid", "warning"), _issue(F.col("email").isNull(), "email", "null", "info"),
            _issue(blank(F.col("phone")), "phone", "required", "info"), *place, _issue(F.coalesce(F.size("categories"), F.lit(0)) <= 0, "categories", "required", "info"),
            _issue(present(F.col("website")) & ~F.col("website").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:\S+"), "website", "invalid", "warning"),
        ],
        "outlet": lambda: [_issue(short("name", 2), "name", "required", "error"), _issue(blank(F.col("business")), "business", "required", "error"), _issue(present(F.col("category")) & ~F.col("category").isin(*outlet_types), "category", "invalid", "warning"), *place],
        "event": lambda: [_issue(short("title", 3), "title", "required", "error"), _issue(~sure(F.col("type").isin(*event_types)), "type", "invalid", "error"), _issue(blank(F.col("business")), "business", "required", "error")],
        "menu": lambda: [_issue(short("name", 1), "name", "required", "error")],
    }
    return F.array_compact(F.array(*checks[kind]())) if kind in checks else F.array().cast(f"array<{ISSUE}>")


def status_of(found: Column) -> Column:
    """failed if any issue is an error, else validated."""
    return F.when(F.exists(found, lambda i: i["severity"] == "error"), "failed").otherwise("validated")


def curated_issues() -> Column:
    """What a curated record lacks or has in a wrong form: (field, current, suggested, risk)."""

    def found(when: Column, field: str, current: Column, suggested: Column, risk: Column | str) -> Column:
        return F.when(sure(when), F.struct(F.lit(field).alias("field"), current.cast("string").alias("current"), suggested.cast("string").alias("suggested"), (F.lit(risk) if isinstance(risk, str) else risk).alias("risk")))

    none = F.lit(None).cast("string")
    wrong = lambda c, good: present(F.col(c)) & good.isNotNull() & (good != F.col(c))
    phone, email, site = contact.us_phone(F.col("phone")), contact.normalise_email(F.col("email")), contact.website(F.col("website"))
    fetch = lambda c: found(blank(F.col(c)), c, none, F.when(present(F.col("place_id")), "fetch"), F.when(present(F.col("place_id")), "safe").otherwise("manual"))
    missing = lambda c: found(blank(F.col(c)), c, none, none, "manual")
    return F.array_compact(F.array(
        found(wrong("phone", phone), "phone", F.col("phone"), phone, "safe"), missing("phone"), found(wrong("email", email), "email", F.col("email"), email, "safe"), missing("email"),
        found(wrong("website", site), "website", F.col("website"), site, "safe"), missing("website"),
        found(F.col("tags").isNotNull() & ~text.normalise_tags(F.col("tags")).eqNullSafe(F.col("tags")), "tags", F.array_join("tags", ","), F.array_join(text.normalise_tags(F.col("tags")), ","), "safe"), found(F.col("tags").isNull(), "tags", F.lit(""), F.lit(""), "safe"),
        found(blank(F.col("country_code")), "country_code", none, F.lit("+1"), "safe"), missing("place_id"), missing("address"), missing("city"),
        found(F.coalesce("latitude", F.lit(0)).eqNullSafe(F.lit(0)) | F.coalesce("longitude", F.lit(0)).eqNullSafe(F.lit(0)), "coordinates", none, none, "manual"), fetch("logo"), fetch("cover"), found(F.col("week").isNull(), "hours", none, none, "manual"),
    ))


def auto_fixes(found: Column) -> tuple[Column, Column]:
    """Issues to fix now (safe, with a suggestion that is no sentinel) and how many are skipped."""
    good = lambda i: (i["risk"] == "safe") & i["suggested"].isNotNull() & (i["suggested"] != "fetch")
    return F.filter(found, good), F.size(F.filter(found, lambda i: ~F.coalesce(good(i), F.lit(False))))


def field_of_warning(c: Column, patterns: list[tuple[str, str]], default: str = "general") -> Column:
    """The field that the first fitting pattern names."""
    out = F.lit(default)
    for pattern, field in reversed(patterns):
        out = F.when(c.rlike(pattern), field).otherwise(out)
    return out


def transform_business(rows: DataFrame) -> DataFrame:
    """The stored form of a raw record: defaults, other names for fields, a point, digits, a checked website, clean tags."""
    out = rows.select(*((text.drop_blank_then_trim(F.col(c)).alias(c) if t == "string" else F.col(c)) for c, t in rows.dtypes))
    site = contact.website(F.col("website"))
    lat, lng = F.col("latitude").try_cast("double"), F.col("longitude").try_cast("double")
    return out.withColumns({
        "address": first_truthy(F.col("address"), F.col("address1")), "address2": F.coalesce(F.nullif("address2", F.lit("")), F.lit("")), "postal_code": first_truthy(F.col("postal_code"), F.col("zip")),
        "location": F.when((lat != 0) & (lng != 0), F.struct(lng.alias("lng"), lat.alias("lat"))), "phone": F.regexp_replace("phone", r"[^\d]", ""), "website": F.when(contact.valid_website(site), site),
        "tags": F.filter(F.transform("tags", lambda t: F.lower(F.trim(t))), lambda t: t != ""), "is_from_crawler": F.lit(True), "is_active": F.lit(True), "is_claimed": F.lit(False), "is_deleted": F.lit(False),
        "boost_order": F.coalesce("boost_order", F.lit(1000)), "views": F.coalesce("views", F.lit(0)),
    }).withColumnsRenamed({"categories": "raw_categories", "industry": "raw_industry"}).drop("address1", "zip")


def transform_outlet(rows: DataFrame) -> DataFrame:
    lat, lng = F.col("latitude").try_cast("double"), F.col("longitude").try_cast("double")
    return rows.withColumns({"location": F.when((lat != 0) & (lng != 0), F.struct(lng.alias("lng"), lat.alias("lat"))), "phone": F.regexp_replace("phone", r"[^\d]", ""), "is_from_crawler": F.lit(True), "is_active": F.lit(False), "is_deleted": F.lit(False), "views": F.coalesce("views", F.lit(0)), "serving_radius": F.coalesce("serving_radius", F.lit(60))})


def transform_event(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"status": F.lit("drafted"), "is_from_crawler": F.lit(True), "is_disabled": F.lit(False), "is_free": F.coalesce("is_free", F.lit(False)), "notify": F.coalesce("notify", F.lit(True)), "views": F.coalesce("views", F.lit(0)), "tags": F.filter(F.transform("tags", lambda t: F.lower(F.trim(t))), lambda t: t != "")})


def map_category(raw: Column, table: list[tuple[str, str, list[str]]], industry: str | None = None, default: str = "Food & Drinks") -> Column:
    """struct(industry, categories, is_fallback): the exact key, else the first key that holds or is held by the text.

    Only hits of the wanted industry count; an exact hit of another ends the search. table: (key, industry, categories), a
    short list, as each key is two conditions of the plan; ``contained.map_categories`` takes a table of any size.
    """
    key = F.lower(F.trim(raw))
    want = (industry or "").strip().lower()
    none = F.struct(F.lit(industry or default).alias("industry"), F.array().cast("array<string>").alias("categories"), F.lit(True).alias("is_fallback"))
    hit = lambda row: F.struct(F.lit(industry or row[1]).alias("industry"), F.array(*map(F.lit, row[2])).alias("categories"), F.lit(False).alias("is_fallback"))
    fits = lambda row: not want or row[1].strip().lower() == want
    out = none
    for row in reversed(table):
        if fits(row):
            out = F.when(key.contains(row[0]) | F.lit(row[0]).contains(key), hit(row)).otherwise(out)
    for row in reversed(table):
        out = F.when(key == row[0], hit(row) if fits(row) else none).otherwise(out)
    return F.when(F.coalesce(key, F.lit("")) == "", none).otherwise(out)


def adapt(rows: DataFrame, categories: DataFrame | list[tuple[str, str, list[str]]], *, areas: DataFrame | None = None, emails: DataFrame | None = None, default_state: str | None = None) -> DataFrame:
    """A scraped listing as a canonical business, with ``warnings``.

    Columns read: id, name, place_id, url, address, coordinates, phone, website, hours, category, country, rating,
    review_count, description, and as far as they are there city, state, locality and email. areas: (area, city,
    ordinal, state, area_state), a gazetteer; emails: (key, value), addresses by place id, website or domain.

    categories: the category map, a short list or a table (key, industry, categories, ordinal) of any size.

    City: the record's own, else its address's; the name of a state is none. State: the default, else that of the one
    city whose area the text names, else the record's or address's; an area's own state comes before all of these.
    Locality: the area's name, else the record's. E-mails: by place id, website, website without its last slash, domain,
    and last the record's own.

    Reading a listing is heavy, so rows are dealt over tasks first.
    """
    own = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) if c in rows.columns else F.lit("")
    either = lambda a, b: F.trim(F.when(a != "", a).otherwise(F.coalesce(b, F.lit(""))))
    out = bind(over_tasks(rows, "id"), _a=address.parse_address(F.col("address")), _p=text_point(F.col("coordinates")), _ph=contact.parse_phone(F.col("phone")), week=hours.parse_glued_hours(F.coalesce("hours", F.lit(""))))
    out = bind(out, _city=either(own("city"), F.col("_a.city")), _state=either(own("state"), F.col("_a.state_code")), _locality=own("locality"))
    out = out.withColumn("_hay", F.concat_ws(" | ", *(F.nullif(c, F.lit("")) for c in (F.col("address"), F.col("_city"), F.col("_state")))))
    if areas is None:
        none = F.lit(None).cast("string")
        out = out.withColumns({"area": none, "ambiguous": F.lit(False), "_in": none, "_over": none})
    else:
        stated = areas.groupBy(F.lower("area").alias("area"), F.col("city").alias("area_city")).agg(F.min_by("state", "ordinal").alias("_in"), F.min_by("area_state", "ordinal").alias("_over"), F.min_by("area", "ordinal").alias("_named"))
        out = area_in_text(out, areas, "_hay").join(stated, ["area", "area_city"], "left").withColumn("area", F.col("_named")).drop("_named", "area_city")
    out = bind(out, _state_code=address.state_code(F.col("_state")), _city_state=address.state_code(F.col("_city")))
    parsed_state = F.col("_state_code")
    state = F.coalesce(address.state_code(F.col("_over")), F.lit(default_state).cast("string"), F.col("_in"), parsed_state, F.lit(""))
    lat, lng = F.coalesce("_p.lat", F.lit(0.0)), F.coalesce("_p.lng", F.lit(0.0))
    out = bind(
        out, street=F.col("_a.street"), unit=F.col("_a.unit"), city=F.when(F.col("_city_state").isNull(), F.col("_city")).otherwise(""), state=state, postal_code=F.col("_a.postal_code"),
        locality=F.coalesce("area", F.nullif("_locality", F.lit(""))), country=F.coalesce(F.nullif(F.trim("country"), F.lit("")), F.col("_a.country")), latitude=lat, longitude=lng, phone_digits=F.col("_ph.phone"),
        place_id=first_truthy(contact.place_id_of(F.col("url")), F.col("place_id")), rating=F.coalesce(text.number_prefix(F.col("rating")), F.lit(0.0)), review_count=text.count_prefix(F.col("review_count")), website=contact.website(F.col("website")),
        status=F.lit(4.1), onward=F.lit(False),
    )
    out = bind(out, mapped=map_category(F.col("category"), categories)) if isinstance(categories, list) else map_categories(out, F.col("category"), categories)
    out = bind(out, tags=text.make_tags(F.col("name"), F.col("category"), F.col("street"), F.col("description")), country_code=contact.country_code(F.col("_ph.country_code"), F.col("country"), F.col("state"), F.col("latitude"), F.col("longitude")))
    listed = F.nullif(contact.split_emails(own("email")), F.array().cast("array<string>"))
    if emails is None:
        out = out.withColumn("emails", listed)
    else:
        site = F.col("website")
        out = cascade_look_up(out, emails, [F.nullif("place_id", F.lit("")), site, F.regexp_replace(site, "/$", ""), contact.host(site)], out="_found").withColumn("emails", F.coalesce("_found", listed)).drop("_found")
    found = fired(
        ("area_ambiguous", F.col("ambiguous")), ("city_is_state", (F.col("_city") != "") & F.col("_city_state").isNotNull()), ("city_unresolved", F.col("_city") == ""), ("state_invalid", (F.col("state") == "") & (F.col("_state") != "")), ("state_unresolved", (F.col("state") == "") & (F.col("_state") == "")),
        ("area_not_listed", F.col("area").isNull() & (F.col("_locality") != "")), ("category_unresolved", F.size("mapped.categories") == 0),
    )
    return out.withColumn("warnings", F.concat(found, warnings())).drop("_a", "_p", "_ph", "_city", "_state", "_locality", "_hay", "_in", "_over", "_state_code", "_city_state")


def adapt_stats(adapted: DataFrame) -> DataFrame:
    """One row that counts an import: rows processed, and those with each property or warning."""
    warned = lambda w: F.count_if(F.array_contains("warnings", w))
    return adapted.agg(
        F.count(F.lit(1)).alias("processed"), F.count_if(F.col("website").isNull()).alias("no_website"), F.count_if(F.size("emails") > 0).alias("email_matched"), F.count_if(F.coalesce(F.size("emails"), F.lit(0)) <= 0).alias("email_unmatched"),
        F.count_if(~F.col("mapped.is_fallback")).alias("category_mapped"), F.count_if("mapped.is_fallback").alias("category_fallback"), F.count_if(F.col("city") != "").alias("city_resolved"), F.count_if(F.col("city") == "").alias("city_unresolved"),
        F.count("area").alias("area_in_list"), warned("area_not_listed").alias("area_kept_custom"), warned("hours_unparsed").alias("hours_unparsed"), warned("address_invalid").alias("address_invalid"), warned("no_coordinates").alias("no_coordinates"),
        warned("no_place_id").alias("no_place_id"), warned("no_name").alias("no_name"),
    )


#: Which field a warning is shown at, by what it says; the first that fits.
WARNING_FIELDS = [("(?i)state", "state"), ("(?i)area", "area"), ("(?i)place_?id", "place_id"), ("(?i)coordinates|coords", "coordinates"), (r"(?i)\bhours\b|hours_", "week"), ("(?i)address", "address"), (r"(?i)\bname\b|no_name", "name")]


def seeded_business(rows: DataFrame, creator: str) -> DataFrame:
    """A guarded row as the business that seeding stores: ownership, flags and counters set, what is stored kept, media never invented."""
    keep = lambda c, default: F.coalesce(F.col(c), default) if c in rows.columns else default
    fixed = {"creator_type": F.lit("admin"), "creator": F.lit(creator), "authorised_user": F.lit(creator), "is_claimed": F.lit(False), "is_crawler": F.lit(True), "is_deleted": F.lit(False), "followers": F.lit(0), "views": F.lit(0), "onward": F.lit(True), "boost_order": F.lit(1000), "is_boosted": F.lit(False)}
    kept = {"is_active": keep("is_active", F.lit(True)), "is_cvb": keep("is_cvb", F.lit(False)), "rating": keep("rating", F.lit(0.0)), "review_count": keep("review_count", F.lit(0)), "cover": keep("cover", F.lit(None).cast("string")), "logo": keep("logo", F.lit(None).cast("string")), "logo_uploaded": keep("logo_uploaded", F.lit(False))}
    return rows.withColumns(fixed | kept).withColumn("unique_id", keep("unique_id", text.unique_id(F.col("name"), F.col("id"))))


def seeded_outlet(businesses: DataFrame, *, category: str = "physical") -> DataFrame:
    """The outlet of each business: (business, name, street, city, state, zip, category, location, is_active, serving_radius).

    Where the street line is empty a one-line ``address1`` is cut at its commas, and fills what else is missing.
    """
    parts = F.transform(F.split(F.coalesce("address1", F.lit("")), ","), lambda p: F.trim(p))
    cut = F.when(~present(F.col("address")) & (F.size(parts) >= 3), parts)
    state_zip = F.split(F.coalesce(F.get(cut, F.lit(2)), F.lit("")), " ")
    fill = lambda c, v: F.when(present(F.col(c)), F.col(c)).otherwise(F.coalesce(v, F.lit("")))
    whole = F.when(~present(F.col("address")) & (F.size(parts) < 3), F.col("address1"))
    return businesses.select(
        F.col("id").alias("business"), "name", fill("address", F.coalesce(F.get(cut, F.lit(0)), whole)).alias("street"), fill("city", F.get(cut, F.lit(1))).alias("city"), address.state_name(fill("state", F.get(state_zip, F.lit(0)))).alias("state"),
        fill("postal_code", F.get(state_zip, F.lit(1))).alias("zip"), F.lit(category).alias("category"), F.struct(F.col("longitude").alias("lng"), F.col("latitude").alias("lat")).alias("location"), F.lit(True).alias("is_active"), F.lit(60).alias("serving_radius"),
    )


def text_point(c: Column) -> Column:
    from recordforge.functions.geo import parse_coordinates

    return parse_coordinates(c)


def warnings() -> Column:
    """Contradictions between fields of an adapted record, and gaps in it, by name."""
    from recordforge.functions.geo import in_us

    placed = (F.col("latitude") != 0) | (F.col("longitude") != 0)
    us = placed & in_us(F.col("latitude"), F.col("longitude"))
    street, open_days = F.trim(F.coalesce("street", F.lit(""))), F.size(F.filter(F.array(*(F.col(f"week.{d}") for d in hours.DAYS)), lambda d: ~hours.closed(d)))
    said = F.trim(F.coalesce("hours", F.lit(""))) != ""
    return fired(
        ("state_outside_us", placed & address.state_code(F.col("state")).isNotNull() & ~us), ("city_digits", F.trim("city").rlike(r"^\d+$")), ("foreign_plus_one", placed & ~us & (F.col("country_code") == "+1") & present(F.trim("phone"))),
        ("no_country", blank(F.col("country")) & (present(F.col("state")) | present(F.col("city")))), ("code_unknown", F.col("country_code") == ""), ("no_name", F.length(F.trim(F.coalesce("name", F.lit("")))) < 2), ("no_place_id", blank(F.trim("place_id"))),
        ("address_invalid", (street == "") | street.rlike(r"^\+?\d[\d\s\-()]+$") | street.rlike(r"(?i)\.com|http|www\.|instagram|facebook")), ("hours_unparsed", said & (open_days == 0)), ("no_hours", ~said), ("no_coordinates", ~placed),
    )


def guard_patch(rows: DataFrame, placeholder: str) -> DataFrame:
    """What may be written: no placeholder media, a one-line address split up, no bad street line, states by name.

    Adds ``adjustments``, the names of what was changed. A null column isn't part of the patch.
    """
    media = [c for c in ("cover", "cover_thumbnail", "logo", "logo_thumbnail") if c in rows.columns]
    parts = address.split_formatted(F.col("address"))
    lined = rows.withColumn("_s", parts).withColumn("_line", F.coalesce("_s.street", "address"))
    bad = F.col("_line").isNotNull() & ~address.valid_street(F.col("_line"))
    state = F.coalesce(F.nullif("state", F.lit("")), F.col("_s.state_code"))
    changes = {c: F.when(~contact.placeholder_media(F.col(c), placeholder), F.col(c)) for c in media}
    changes |= {"address": F.when(~bad, F.col("_line")), "city": F.coalesce(F.nullif("city", F.lit("")), F.col("_s.city")), "state": address.state_name(state), "postal_code": F.coalesce(F.nullif("postal_code", F.lit("")), F.col("_s.postal_code"))}
    said = fired(*((f"dropped_{c}", contact.placeholder_media(F.col(c), placeholder)) for c in media), ("split_address", F.col("_s").isNotNull()), ("dropped_address", bad), ("normalised_state", address.state_name(state) != state))
    return lined.withColumn("adjustments", said).withColumns(changes).drop("_s", "_line")


def progress_stage(status: str, wanted: Column, new: str) -> Column:
    """A stage moves rows on that meet its condition; others keep their status."""
    return F.when(sure(wanted), new).otherwise(F.col(status))
