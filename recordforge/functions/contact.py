"""Phones, URLs, e-mail addresses and media links as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordforge.functions.address import state_code
from recordforge.functions.geo import in_us

#: Calling codes by country.
CALLING_CODES = {"united states": "+1", "united states of america": "+1", "usa": "+1", "canada": "+1", "india": "+91", "united kingdom": "+44", "uk": "+44", "australia": "+61", "mexico": "+52"}
#: Patterns of a phone's code, of valid sites and addresses, of ids in map URLs, and of image hosts, here and below.
_CODE = r"^(\+\d{1,3})[\s\-.]"


#: Dialling codes of the countries that addresses name, and the box (south, north, west, east) of the one that a point alone may name.
DIAL_CODES = {
    "united states": "+1", "united states of america": "+1", "usa": "+1", "u.s.a.": "+1", "us": "+1", "india": "+91", "bharat": "+91", "canada": "+1", "united kingdom": "+44", "uk": "+44", "great britain": "+44",
    "australia": "+61", "ireland": "+353", "new zealand": "+64", "singapore": "+65", "united arab emirates": "+971", "uae": "+971",
}
COUNTRY_BOXES = {"India": (6, 36, 68, 98)}


def dial_code(country: Column) -> Column:
    """The dialling code of a country's name, or null: a country that isn't listed is never guessed."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in DIAL_CODES.items() for x in pair)), F.lower(F.trim(country)))


def country_at(lat: Column, lng: Column) -> Column:
    """The country whose box holds a finite point, or null."""
    inside = lambda b: F.coalesce(lat.between(b[0], b[1]) & lng.between(b[2], b[3]), F.lit(False))
    return F.coalesce(*(F.when(inside(b), name) for name, b in COUNTRY_BOXES.items()))


def parse_phone(c: Column) -> Column:
    """struct(country_code, phone): a code counts only if a separator follows it; the rest is digits."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.struct(F.regexp_extract(t, _CODE, 1).alias("country_code"), F.regexp_replace(F.regexp_replace(t, _CODE, ""), r"\D", "").alias("phone"))


def country_code(prefix: Column, country: Column, state: Column, lat: Column, lng: Column) -> Column:
    """The phone's own code, else +1 by any sign of the US, else the country's; blank for a foreign point, else +1."""
    known = F.create_map(*(F.lit(x) for pair in CALLING_CODES.items() for x in pair))
    name = F.lower(F.trim(F.coalesce(country, F.lit(""))))
    placed = F.coalesce((lat != 0) | (lng != 0), F.lit(False))
    american = (placed & in_us(lat, lng)) | name.isin("united states", "united states of america", "usa") | state_code(state).isNotNull()
    return F.when(F.coalesce(prefix, F.lit("")) != "", prefix).when(american, "+1").when(F.try_element_at(known, name).isNotNull(), F.try_element_at(known, name)).when(placed, "").otherwise("+1")


def us_phone(c: Column) -> Column:
    """Ten digits, a leading 1 of eleven dropped; else null."""
    d = F.regexp_replace(c, r"\D", "")
    return F.when((F.length(d) == 11) & d.startswith("1"), F.substr(d, F.lit(2))).when(F.length(d) == 10, d)


def website(c: Column) -> Column:
    """A URL with a scheme; null for a blank one."""
    t = F.trim(c)
    return F.when(t.rlike("(?i)^https?://"), t).when(t != "", F.concat(F.lit("https://"), t))


def valid_website(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^https?://.+\..+"), F.lit(False))


def host(c: Column) -> Column:
    """Lower-case host without a leading ``www.``; null if the text is no URL."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(website(c), r"^(?i:https?)://([^/?#:]+)", 1)), r"^www\.", ""), F.lit(""))


def root_domain(c: Column) -> Column:
    """The last two labels of the host."""
    return F.nullif(F.regexp_extract(host(c), r"([^.]+\.[^.]+)$", 1), F.lit(""))


def split_emails(c: Column) -> Column:
    """Addresses in a comma-separated text: those with an @ that don't end in a slash."""
    return F.filter(F.transform(F.split(c, ","), lambda t: F.trim(t)), lambda e: e.contains("@") & ~e.endswith("/"))


def valid_email(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), F.lit(False))


def normalise_email(c: Column) -> Column:
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def place_id_of(url: Column) -> Column:
    """A place's id in a map URL: after ``!19s``, else the hexadecimal id, else a ``place_id`` parameter."""
    named = F.regexp_extract(url, r"!19s([^?&/]+)", 1)
    number = F.regexp_extract(url, r"(?i)!1s0x[0-9a-f]+:0x([0-9a-f]+)", 1)
    given = F.regexp_extract(url, r"place_id[=:/](ChIJ[A-Za-z0-9_-]+)", 1)
    return F.when(named != "", named).when(number != "", F.concat(F.lit("0x"), number)).when(given != "", given)


def full_size(url: Column) -> Column:
    """An image URL without the size that its last part asks for."""
    return F.regexp_replace(url, r"=[wsh]\d+[^/]*$", "=s0")


def image_kind(url: Column) -> Column:
    """avatar, panorama, user or other, by the URL's form."""
    return F.when(url.rlike(r"/a-?/|/a/ACg8|=s\d{2}-c"), "avatar").when(url.rlike("streetviewpixels|panoid|cbk"), "panorama").when(url.rlike(r"/gps-cs|/p/AF1Qip|geougc"), "user").otherwise("other")


def placeholder_media(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(pattern), F.lit(False))
