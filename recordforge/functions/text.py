"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(c: Column) -> Column:
    """Trim as browsers do: all Unicode white space and the byte-order mark."""
    return F.regexp_replace(c, r"(?U)^[\s﻿]+|[\s﻿]+$", "")


def squeeze(c: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s﻿]+", " "))


def _plain_letters() -> tuple[str, str]:
    """Lower-case Latin letters with marks and what they are without them, by canonical decomposition."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and all(unicodedata.combining(x) for x in base[1:]):
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _PLAIN = _plain_letters()


def strip_marks(c: Column) -> Column:
    """Letters without diacritics, whether composed or followed by combining marks."""
    return F.regexp_replace(F.translate(c, _MARKED, _PLAIN), r"[̀-ͯ]", "")


def words_of(c: Column) -> Column:
    """Words of a text whose words are split by single spaces; none for the empty text."""
    return F.filter(F.split(c, " "), lambda w: w != "")


#: Words that title case keeps small.
SMALL_WORDS = ("of", "the", "and", "at", "in", "on", "for", "de", "la", "del", "du", "van", "von")


def title_case(c: Column, small: tuple[str, ...] = SMALL_WORDS) -> Column:
    """First letters upper, others lower, each part of a hyphenated word too; small words stay small unless first."""
    part = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2))))
    whole = lambda w: F.array_join(F.transform(F.split(w, "-"), part), "-")
    return F.array_join(F.transform(words_of(squeeze(c)), lambda w, i: F.when((i > 0) & F.lower(w).isin(*small), F.lower(w)).otherwise(whole(w))), " ")


def normalise_tags(tags: Column) -> Column:
    """Trimmed, lower case, spaces to hyphens; no empty ones, each once, in order."""
    return F.array_distinct(F.filter(F.transform(tags, lambda t: F.regexp_replace(F.lower(clean(t)), r"(?U)\s+", "-")), lambda t: t != ""))


#: Words that are no tags.
NAME_STOPS = ("the", "and", "for", "its")
TEXT_STOPS = ("this", "that", "with", "from", "have", "been", "were", "your", "they", "will", "about", "their")


def make_tags(name: Column, category: Column, address: Column, description: Column) -> Column:
    """Up to six tags: the city of a comma-separated address, then two words each of category, name and description."""
    empty = F.array().cast("array<string>")
    parts = F.transform(F.split(F.coalesce(address, F.lit("")), ","), lambda p: F.trim(p))
    n = F.size(parts)
    at = lambda back: F.when(n >= back, F.nullif(F.try_element_at(parts, -F.lit(back)), F.lit("")))
    city = F.when(n >= 2, F.coalesce(at(3), at(2)))
    place = F.when(city.isNotNull(), F.array(F.regexp_replace(F.lower(city), r"\s+", "-"))).otherwise(empty)
    plain = lambda c: F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s-]", ""), r"\s+"), lambda w: w != "")
    two = lambda words, least, stops: F.slice(F.filter(words, lambda w: (F.length(w) > least) & ~w.isin(*stops)), 1, 2)
    kind = F.filter(F.split(F.lower(F.coalesce(category, F.lit(""))), r"\s+"), lambda w: w != "")
    return F.slice(F.array_distinct(F.concat(place, two(kind, 2, ("",)), two(plain(name), 2, NAME_STOPS), two(plain(description), 3, TEXT_STOPS))), 1, 6)


def number_prefix(c: Column) -> Column:
    """The number that a text starts with, if any."""
    return F.regexp_extract(c, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def count_prefix(c: Column) -> Column:
    """The whole number that a text starts with, thousands separated by commas; 0 if there is none."""
    return F.coalesce(F.regexp_extract(F.regexp_replace(c, ",", ""), r"^\s*([+-]?\d+)", 1).try_cast("long"), F.lit(0).cast("long"))


def first_integer(c: Column) -> Column:
    """The first run of digits in a label, without its separators."""
    return F.regexp_replace(F.regexp_extract(c, r"(\d[\d,]*)", 1), ",", "").try_cast("long")


def round_half_up(c: Column) -> Column:
    """The nearest integer, halves towards plus infinity."""
    return F.floor(c + 0.5)


def stable_suffix(key: Column, digits: int, letters: int) -> Column:
    """Digits and capital letters derived from a key, so that an id is the same each time it is made."""
    number = lambda k, base: F.pmod(F.xxhash64(key, F.lit(k)), F.lit(base))
    return F.concat(*(number(k, 10).cast("string") for k in range(digits)), *(F.char(number(100 + k, 26) + 65) for k in range(letters)))


def unique_id(name: Column, key: Column) -> Column:
    """Four letters of a name (filled up if it has fewer), three digits and three letters."""
    letters = F.upper(F.regexp_replace(F.coalesce(name, F.lit("")), "[^A-Za-z]", ""))
    fill = stable_suffix(F.concat(F.lit("fill"), key.cast("string")), 0, 4)
    return F.concat(F.substring(F.concat(letters, fill), 1, 4), stable_suffix(key.cast("string"), 3, 3))


def human_id(prefix: str, at: Column, key: Column) -> Column:
    """prefix-yyyymmdd-suffix."""
    return F.concat(F.lit(f"{prefix}-"), F.date_format(at, "yyyyMMdd"), F.lit("-"), F.lower(stable_suffix(key.cast("string"), 2, 3)))


def relative_time(label: Column, now: Column) -> Column:
    """"3 weeks ago" as a time before ``now``; a month has 30 days and a year 365. Null if it isn't such a label."""
    said = F.lower(F.trim(label))
    n = F.coalesce(F.regexp_extract(said, r"^(\d+)\s", 1).try_cast("long"), F.when(said.rlike(r"^an?\s"), F.lit(1)))
    unit = F.regexp_extract(said, r"^(?:\d+|an?)\s+(second|minute|hour|day|week|month|year)s?\b", 1)
    sizes = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 7 * 86400, "month": 30 * 86400, "year": 365 * 86400}
    seconds = F.lit(None).cast("long")
    for name, size in sizes.items():
        seconds = F.when(unit == name, n * size).otherwise(seconds)
    seconds = F.when(said.rlike("just now|moments ago"), F.lit(0)).otherwise(seconds)
    return F.timestamp_seconds(F.unix_timestamp(now) - seconds)


def drop_blank_then_trim(c: Column) -> Column:
    """Empty texts go first and trimming comes after, so that a text of white space becomes empty and stays."""
    return F.when(c != "", F.trim(c))
