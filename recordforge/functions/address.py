"""Postal addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordforge.functions import geo
from recordforge.functions.nulls import let

#: States of the US and their codes.
STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware", "DC": "District of Columbia", "FL": "Florida",
    "GA": "Georgia", "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland",
    "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey",
    "NM": "New Mexico", "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island",
    "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia", "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming",
}
#: Words of street lines, of units, and the country's name at the end of an address.
STREET_WORDS = (
    "St|Street|Ave|Avenue|Rd|Road|Blvd|Boulevard|Dr|Drive|Ln|Lane|Way|Ct|Court|Pl|Place|Hwy|Highway|Pkwy|Parkway|Ter|Terrace|Cir|Circle|Sq|Square|Broadway|Turnpike|Tpke|Trail|Trl|Loop|Alley|Aly|Row|Walk|Plaza|Plz|Crossing|Xing"
)
UNIT_WORDS = "suite|ste|unit|apt|apartment|#|fl|floor|room|rm"
COUNTRY_END = r"(?i),\s*(USA|United States(?: of America)?)\s*$"
#: What a map code in front, a ZIP at the end and a state with or without ZIP look like.
MAP_CODE = r"^[A-Z0-9]{4,}\+[A-Z0-9]{2,}\s+"
ZIP_END = r"\b(\d{5}(?:-\d{4})?)\b\s*$"
STATE_ZIP = r"^([A-Z]{2}|[A-Za-z][A-Za-z\s]+?)\s+(\d{5}(?:-\d{4})?)$"
_STREET = rf"(?i)\b(?:{STREET_WORDS})\b"


def _codes() -> Column:
    return F.create_map(*(F.lit(x) for code, name in STATES.items() for x in (name.lower(), code)))


def _names() -> Column:
    return F.create_map(*(F.lit(x) for code, name in STATES.items() for x in (code, name)))


def state_code(c: Column) -> Column:
    """The two-letter code of a state's code or name; null for anything else."""
    t = F.trim(c)
    return F.when(F.length(t) == 2, F.when(F.try_element_at(_names(), F.upper(t)).isNotNull(), F.upper(t))).otherwise(F.try_element_at(_codes(), F.lower(t)))


def state_name(c: Column) -> Column:
    """The full name of a state's code; any other text as it is."""
    return F.coalesce(F.try_element_at(_names(), F.upper(F.trim(c))), c)


def is_state(c: Column) -> Column:
    return F.coalesce(state_code(c).isNotNull() | F.lower(F.trim(c)).isin("puerto rico", "pr"), F.lit(False))


def segments(c: Column) -> Column:
    """The address's parts between commas, trimmed and not empty."""
    return F.filter(F.transform(F.split(c, ","), lambda t: F.trim(t)), lambda p: p != "")


def without_country(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), COUNTRY_END, ""))


def split_formatted(c: Column) -> Column:
    """struct(street, city, state_code, postal_code) of "street, city, XX 12345[, country]", or null: it never guesses."""
    pattern = r"^([A-Za-z]{2})\s+(\d{5})(?:-\d{4})?$"

    def cut(parts: Column) -> Column:
        n, last = F.size(parts), F.try_element_at(parts, F.lit(-1))
        street = F.array_join(F.slice(parts, 1, F.greatest(n - 2, F.lit(0))), ", ")
        return F.when((n >= 3) & last.rlike(pattern), F.struct(street.alias("street"), F.try_element_at(parts, F.lit(-2)).alias("city"), F.upper(F.regexp_extract(last, pattern, 1)).alias("state_code"), F.regexp_extract(last, pattern, 2).alias("postal_code")))

    return let(segments(without_country(c)), cut)


def derive_city(c: Column) -> Column:
    """struct(city, reason): the part before "XX 12345", or why there is none."""

    def cut(parts: Column) -> Column:
        city, last = F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-1))
        reason = (
            F.when(F.trim(F.coalesce(c, F.lit(""))) == "", "empty_address").when(F.size(parts) < 2, "fewer_than_2_segments")
            .when(~last.rlike(r"^[A-Za-z]{2}\s+\d{5}(-\d{4})?$"), "no_state_zip_segment").when(city.rlike(r"^\d+$"), "numeric_derived")
        )
        return let(F.struct(reason.alias("r")), lambda x: F.struct(F.when(x["r"].isNull(), city).alias("city"), x["r"].alias("reason")))

    return let(segments(without_country(c)), cut)


def street_shape(c: Column) -> Column:
    """Looks like a street line: no state with ZIP, no country, and a house number in front or a street word."""
    t = without_country(c)
    return (t != "") & ~t.rlike(r"\b[A-Za-z]{2}\s+\d{5}(?:-\d{4})?\b") & ~t.rlike(r"(?i)\b(?:USA|United States)\b") & (t.rlike(r"^\d") | t.rlike(_STREET))


def valid_street(c: Column) -> Column:
    """A street line without phone number, URL or opening hours."""
    t = F.trim(F.coalesce(c, F.lit("")))
    phone = r"(?:\+?1[\s.\-]?)?\(?\d{3}\)?[\s.\-]?\d{3}[\s.\-]?\d{4}"
    hours = r"(?i)\b(?:Open(?:\s|·|,|$)|Closed(?:\s|·|,|$)|Hours\s*[:\-]|[0-9](?:\s?[AP]M)|Permanently\s+closed)\b"
    return (t != "") & ~t.rlike(phone) & ~t.rlike(r"(?i)\b(?:https?://|www\.)\S+") & ~t.rlike(hours) & street_shape(t)


def _contact_like(t: Column) -> Column:
    """A phone number, a URL, or a bare domain."""
    return t.rlike(r"^\+?[\d\s().-]{7,}$") | t.rlike(r"(?i)^\s*(https?://|www\.)") | (t.rlike(r"(?i)\.[a-z]{2,4}\b") & ~t.rlike(r"\d"))


def junk_street(c: Column) -> Column:
    """A street line that shouldn't be searched for; an empty one isn't junk."""
    t = F.trim(F.coalesce(c, F.lit("")))
    hours = r"(?i)\b(?:open\s+24\s+hours?|closed|hours?[:\s])"
    postal = r"^[^,]+,\s*[A-Za-z]{2}\s+\d{5}(?:-\d{4})?\s*$"
    return (t != "") & (_contact_like(t) | t.rlike(hours) | (t.rlike(postal) & ~t.rlike(_STREET)) | (~t.rlike(r"\d") & ~t.rlike(_STREET)))


def junk_city(c: Column) -> Column:
    t = F.trim(F.coalesce(c, F.lit("")))
    return (t != "") & _contact_like(t)


def search_fields(street: Column, alt_street: Column, city: Column, state: Column, postal: Column, lat: Column, lng: Column) -> Column:
    """What to search with: junk is dropped, and city and state if the point is in the US but the state isn't."""
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    line = F.when(text(street) != "", text(street)).otherwise(text(alt_street))
    foreign = geo.in_box(lat, lng) & (text(state) != "") & ~is_state(state)
    return F.struct(
        F.when(junk_street(line), "").otherwise(line).alias("street"), F.when(foreign | junk_city(city), "").otherwise(text(city)).alias("city"), F.when(foreign, "").otherwise(text(state)).alias("state"),
        text(postal).alias("postal_code"), junk_street(line).alias("dropped_street"), foreign.alias("dropped_city_state"),
    )


def parse_address(c: Column) -> Column:
    """struct(street, unit, city, state_code, postal_code, country) of a one-line address, from its end to its start.

    The ZIP anchors the end, then country, state and city follow; of the rest, parts that start with a unit word, or the
    last part's tail from such a word on, are the unit.
    """
    raw = F.coalesce(c, F.lit(""))
    plain = F.trim(F.regexp_replace(raw, MAP_CODE, ""))
    empty = F.struct(raw.alias("street"), *(F.lit("").alias(x) for x in ("unit", "city", "state_code", "postal_code", "country")))
    return F.when(F.trim(raw) == "", empty).otherwise(let(plain, lambda t: let(_ends(t), lambda e: let(_places(e), lambda p: let(_lines(p), lambda s: _address(raw, e, p, s))))))


def _chopped(t: Column) -> Column:
    return F.regexp_replace(F.trim(t), r",\s*$", "")


def _ends(t: Column) -> Column:
    """struct(work, postal, country) with ZIP and country taken off the end."""
    postal = F.struct(F.regexp_extract(t, ZIP_END, 1).alias("postal"), F.when(t.rlike(ZIP_END), _chopped(F.regexp_replace(t, ZIP_END, ""))).otherwise(t).alias("work"))
    country = lambda x: F.when(x["work"].rlike(COUNTRY_END), F.struct(_chopped(F.regexp_replace(x["work"], COUNTRY_END, "")).alias("work"), x["postal"].alias("postal"), F.lit("United States").alias("country"))).otherwise(F.struct(x["work"].alias("work"), x["postal"].alias("postal"), F.lit("").alias("country")))
    return let(postal, country)


def _drop_last(a: Column, n: int = 1) -> Column:
    return F.slice(a, 1, F.greatest(F.size(a) - n, F.lit(0)))


def _places(e: Column) -> Column:
    """struct(rest, code, zip): the parts before the state, and the state."""

    def cut(parts: Column) -> Column:
        last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
        found = F.when(last.rlike(STATE_ZIP), F.struct(F.lit(True).alias("hit"), state_code(F.regexp_extract(last, STATE_ZIP, 1)).alias("code"), F.regexp_extract(last, STATE_ZIP, 2).alias("zip"))).otherwise(F.struct(state_code(last).isNotNull().alias("hit"), state_code(last).alias("code"), F.lit("").alias("zip")))
        return let(found, lambda f: F.struct(F.when(f["hit"], _drop_last(parts)).otherwise(parts).alias("rest"), F.coalesce(f["code"], F.lit("")).alias("code"), f["zip"].alias("zip")))

    return let(segments(e["work"]), cut)


def _lines(p: Column) -> Column:
    """struct(streets, units) of the parts before the city."""
    is_unit = lambda x: x.rlike(rf"(?i)^({UNIT_WORDS})\b")
    tail = rf"(?i)^(.+?)\b((?:{UNIT_WORDS})\b.*)$"

    def peel(s: Column) -> Column:
        end = F.coalesce(F.try_element_at(s["streets"], F.lit(-1)), F.lit(""))
        street, unit = F.regexp_replace(F.regexp_extract(end, tail, 1), r"[,\s]+$", ""), F.trim(F.regexp_extract(end, tail, 2))
        return F.when(end.rlike(tail), F.struct(F.concat(_drop_last(s["streets"]), F.array(street)).alias("streets"), F.concat(F.array(unit), s["units"]).alias("units"))).otherwise(s)

    both = lambda lines: F.struct(F.filter(lines, lambda x: ~is_unit(x)).alias("streets"), F.filter(lines, is_unit).alias("units"))
    return let(_drop_last(p["rest"]), lambda lines: let(both(lines), peel))


def _address(raw: Column, e: Column, p: Column, s: Column) -> Column:
    street = F.trim(F.array_join(s["streets"], ", "))
    return F.struct(
        F.when(street != "", street).when(e["work"] != "", e["work"]).otherwise(raw).alias("street"), F.trim(F.array_join(s["units"], ", ")).alias("unit"), F.coalesce(F.try_element_at(p["rest"], F.lit(-1)), F.lit("")).alias("city"),
        p["code"].alias("state_code"), F.when(e["postal"] != "", e["postal"]).otherwise(p["zip"]).alias("postal_code"), e["country"].alias("country"),
    )
