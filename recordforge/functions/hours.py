"""Opening hours: two parsers on one range routine, and checks of a stored week.

A day is struct(duration: struct(start_hour, start_minute, end_hour, end_minute), is_closed); a week is a struct of days
from Sunday on. An end before the start is a close on the next day. All day long is 0:00 to 23:59.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordforge.functions.nulls import let

DAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")
#: Short names of days.
SHORT = {"sun": "sunday", "mon": "monday", "tue": "tuesday", "tues": "tuesday", "wed": "wednesday", "weds": "wednesday", "thu": "thursday", "thur": "thursday", "thurs": "thursday", "fri": "friday", "sat": "saturday"}
DAY_TYPE = "struct<duration:struct<start_hour:int,start_minute:int,end_hour:int,end_minute:int>,is_closed:boolean>"
_TIME = r"(?:noon|midnight|\d{1,2}(?::\d{2})?(?:\s*(?:am|pm))?)"
_RANGE = rf"(?i)({_TIME})\s*-\s*({_TIME})"


def duration(start: Column, end: Column) -> Column:
    """A duration from minutes of the day."""
    part = lambda m, name: (F.floor(m / 60).cast("int").alias(f"{name}_hour"), (m % 60).cast("int").alias(f"{name}_minute"))
    return F.struct(*part(start, "start"), *part(end, "end"))


def open_day(d: Column) -> Column:
    return F.when(d.isNotNull(), F.struct(d.alias("duration"), F.lit(False).alias("is_closed")))


def closed_day() -> Column:
    return F.struct(F.lit(None).cast("struct<start_hour:int,start_minute:int,end_hour:int,end_minute:int>").alias("duration"), F.lit(True).alias("is_closed"))


def all_day() -> Column:
    return open_day(duration(F.lit(0), F.lit(23 * 60 + 59)))


def _time(t: Column) -> Column:
    """struct(hour as written, minute, half: am or pm or null); a null hour for a time that can't be."""
    pattern = r"^(\d{1,2})(?::(\d{2}))?\s*(am|pm)?$"

    def read(x: Column) -> Column:
        hour = F.when(x.isin("noon", "midnight"), 12).otherwise(F.regexp_extract(x, pattern, 1).try_cast("int"))
        minute = F.coalesce(F.regexp_extract(x, pattern, 2).try_cast("int"), F.lit(0))
        half = F.when(x == "noon", "pm").when(x == "midnight", "am").otherwise(F.nullif(F.regexp_extract(x, pattern, 3), F.lit("")))
        return F.struct(F.when(hour.between(0, 23) & minute.between(0, 59), hour).alias("hour"), minute.alias("minute"), half.alias("half"))

    return let(F.lower(F.trim(t)), read)


def _on_clock(hour: Column, half: Column) -> Column:
    return F.when((half == "pm") & (hour < 12), hour + 12).when((half == "am") & (hour == 12), 0).otherwise(hour)


def _range(text: Column, flip: str) -> Column:
    """struct(start, end) in minutes of a "time - time" text, or null.

    The end must say am or pm. A start that doesn't takes the end's half, unless it would then be after the end: with
    flip "opposite" it takes the other half, with "am" always the morning. Equal times are no range.
    """
    both = F.struct(_time(F.regexp_extract(text, _RANGE, 1)).alias("a"), _time(F.regexp_extract(text, _RANGE, 2)).alias("b"))

    def minutes(r: Column) -> Column:
        at = lambda half: _on_clock(r["a"]["hour"], half) * 60 + r["a"]["minute"]
        other = F.lit("am") if flip == "am" else F.when(r["b"]["half"] == "pm", "am").otherwise("pm")
        end = _on_clock(r["b"]["hour"], r["b"]["half"]) * 60 + r["b"]["minute"]
        start = F.when(r["a"]["half"].isNotNull(), at(r["a"]["half"])).when(at(r["b"]["half"]) > end, at(other)).otherwise(at(r["b"]["half"]))
        return F.when(r["a"]["hour"].isNotNull() & r["b"]["hour"].isNotNull() & r["b"]["half"].isNotNull(), F.struct(start.alias("start"), end.alias("end")))

    return let(let(both, minutes), lambda m: F.when(m["start"] != m["end"], m))


def _plain(c: Column) -> Column:
    """Dashes and spaces of all sorts as plain ones."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[–—‒−]", "-"), r"(?U)\s+", " "))


#: Live status that stands beside hours, in the order in which it is taken out.
STATUS = (
    r"\bopen(?:s)?\s+now\b", r"\bclos(?:ed|es|ing)\s+now\b", r"\bclos(?:es|ing)\s+soon\b", r"\bopen(?:s|ing)?\s+soon\b",
    r"\bopens?\s+(?:in|at)\s+\S+(?:\s*(?:am|pm))?", r"\bclos(?:es|ing)\s+(?:in|at)\s+\S+(?:\s*(?:am|pm))?", r"\breopens?\s+(?:in|at)\s+\S+(?:\s*(?:am|pm))?",
)


def parse_day_text(c: Column) -> Column:
    """The strict form: a day from what follows its name, or null if any part isn't understood.

    Notices and live status go first. Several ranges become one from the first start to the end of the one that starts
    last.
    """
    t = F.trim(F.lower(_plain(F.coalesce(c, F.lit("")))))
    t = F.regexp_replace(t, r"\s*hours might (?:differ|vary)\b.*$", "")
    for status in STATUS:
        t = F.regexp_replace(t, status, " ")
    t = F.regexp_replace(_plain(F.regexp_replace(t, r"\s*,?\s*\bcopy open hours\b\s*,?\s*", " ")), r"^[\s,]+|[\s,]+$", "")
    return let(t, lambda x: F.when(x == "closed", closed_day()).when(x.startswith("open 24") | (x == "24 hours"), all_day()).when(~x.rlike(r"[,(;]|holiday"), let(F.regexp_replace(x, r"(am|pm)(?=\d)", "$1 "), _strict_ranges)))


def _strict_ranges(t: Column) -> Column:
    def envelope(ranges: Column) -> Column:
        last = F.array_max(F.transform(ranges, lambda r, i: F.struct(r["start"].alias("start"), i.alias("place"), r["end"].alias("end"))))
        span = F.struct(F.array_min(F.transform(ranges, lambda r: r["start"])).alias("start"), last["end"].alias("end"))
        good = (F.size(ranges) > 0) & F.forall(ranges, lambda r: r.isNotNull())
        return F.when(good, let(span, lambda s: F.when(s["start"] != s["end"], open_day(duration(s["start"], s["end"])))))

    rest = F.trim(F.regexp_replace(t, _RANGE, " "))
    return F.when(rest == "", let(F.transform(F.regexp_extract_all(t, F.lit(_RANGE), F.lit(0)), lambda r: _range(r, "opposite")), envelope))


def parse_hours_lines(lines: Column) -> Column:
    """Lines such as "Monday: 9 AM-5 PM" to struct(ok, kind, days, unparsed, rejects).

    kind: empty, parsed or none_parsed; a null array is shape. days: a week whose unseen or unreadable days are null, so
    that stored ones stay; the last readable line of a day counts. rejects: struct(day, raw, reason) of unreadable lines.
    """
    names = F.create_map(*(F.lit(x) for pair in [*SHORT.items(), *((d, d) for d in DAYS)] for x in pair))

    def line(raw: Column) -> Column:
        cut = lambda t: F.struct(_plain(F.regexp_replace(F.regexp_extract(t, r"^([^:]*):", 1), r"\s*\([^)]*\)\s*", " ")).alias("label"), F.trim(F.regexp_replace(F.regexp_extract(t, r"^[^:]*:(.*)$", 1), r"(?i)\s*hours might (differ|vary).*$", "")).alias("said"))
        parts = let(F.regexp_replace(_plain(F.regexp_replace(_plain(raw), r"(?i)\s*,?\s*\bcopy open hours\b\s*,?\s*", " ")), r"^[\s,]+|[\s,]+$", ""), cut)

        def read(x: Column) -> Column:
            day = F.try_element_at(names, F.lower(x["label"]))
            value = F.when(day.isNotNull(), parse_day_text(x["said"]))
            found = F.struct(day.alias("day"), value.alias("value"))

            def said(f: Column) -> Column:
                reason = F.when(raw.isNull(), "non_string_entry").when((x["label"] == "") | (x["said"] == ""), "no_day_label").when(f["day"].isNull(), "unknown_day_label").when(f["value"].isNull(), "unparseable_time")
                return F.struct(F.coalesce(f["day"], F.nullif(x["label"], F.lit(""))).alias("day"), raw.alias("raw"), reason.alias("reason"), f["value"].alias("value"))

            return let(found, said)

        return let(parts, read)

    def summed(rows: Column) -> Column:
        at = lambda r, i: F.struct(r["day"].alias("day"), i.alias("at"))
        late = F.array_compact(F.transform(rows, lambda r, i: F.when(r["reason"] == "unparseable_time", at(r, i))))
        fine = F.array_compact(F.transform(rows, lambda r, i: F.when(r["reason"].isNull(), at(r, i))))
        # A day is unparsed if it has an unreadable line and no readable one after it.
        open_days = lambda m: F.array_distinct(F.transform(F.filter(m["late"], lambda u: ~F.exists(m["fine"], lambda g: (g["day"] == u["day"]) & (g["at"] > u["at"]))), lambda u: u["day"]))
        good, bad = F.filter(rows, lambda r: r["reason"].isNull()), F.filter(rows, lambda r: r["reason"].isNotNull())
        kind = F.when(F.size(rows) == 0, "empty").when(F.size(good) > 0, "parsed").otherwise("none_parsed")
        week = let(good, lambda g: F.struct(*(_last_of(g, d).alias(d) for d in DAYS)))
        return F.struct((F.size(good) > 0).alias("ok"), kind.alias("kind"), week.alias("days"), let(F.struct(late.alias("late"), fine.alias("fine")), open_days).alias("unparsed"), F.transform(bad, lambda r: F.struct(r["day"], r["raw"], r["reason"])).alias("rejects"))

    shape = F.from_json(F.lit('{"ok": false, "kind": "shape", "unparsed": [], "rejects": []}'), f"struct<ok:boolean,kind:string,days:struct<{','.join(f'{d}:{DAY_TYPE}' for d in DAYS)}>,unparsed:array<string>,rejects:array<struct<day:string,raw:string,reason:string>>>")
    return F.when(lines.isNull(), shape).otherwise(let(F.transform(lines, line), summed))


def _last_of(rows: Column, day: str) -> Column:
    return F.try_element_at(F.transform(F.filter(rows, lambda r: r["day"] == day), lambda r: r["value"]), F.lit(-1))


def parse_glued_day(c: Column) -> Column:
    """The lenient form: ranges that can't be read and text between ranges are passed over; null if no range is left.

    Several ranges become one from the earliest start to the latest end on the clock.
    """
    t = F.lower(_plain(F.coalesce(c, F.lit(""))))
    t = _plain(F.regexp_replace(F.regexp_replace(t, r"hours might (?:differ|vary)|copy open hours", " "), r"(am|pm)(?=\d)", "$1 "))
    ranges = lambda x: F.array_compact(F.transform(F.regexp_extract_all(x, F.lit(_RANGE), F.lit(0)), lambda r: _range(r, "am")))
    span = lambda rs: F.when(F.size(rs) > 0, open_day(duration(F.array_min(F.transform(rs, lambda r: r["start"])), F.array_max(F.transform(rs, lambda r: r["end"])))))
    return let(t, lambda x: F.when(x == "closed", closed_day()).when(x.rlike("open 24 hours|^24 hours$|^open 24$"), all_day()).otherwise(let(ranges(x), span)))


def parse_glued_hours(c: Column) -> Column:
    """A week from one text such as "Tuesday8 am-8 pmWednesday..."; a day that isn't there or can't be read is closed."""
    pattern = rf"(?is)({'|'.join(DAYS)})(.*?)(?={'|'.join(DAYS)}|$)"
    names, values = F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), F.regexp_extract_all(c, F.lit(pattern), F.lit(2))
    each = F.filter(F.transform(F.arrays_zip(names.alias("n"), values.alias("v")), lambda p: F.struct(F.lower(p["n"]).alias("day"), parse_glued_day(p["v"]).alias("value"))), lambda r: r["value"].isNotNull())
    return let(each, lambda rows: F.struct(*(F.coalesce(_last_of(rows, d), closed_day()).alias(d) for d in DAYS)))


def closed(day: Column) -> Column:
    """Missing, marked closed, without a duration, or 0:00 to 0:00 without being marked open."""
    d = day["duration"]
    zero = (d["start_hour"] == 0) & (d["start_minute"] == 0) & (d["end_hour"] == 0) & (d["end_minute"] == 0)
    return F.coalesce(day.isNull() | day["is_closed"].eqNullSafe(F.lit(True)) | d.isNull() | (zero & ~day["is_closed"].eqNullSafe(F.lit(False))), F.lit(False))


def placeholder_week(week: Column) -> Column:
    """Monday to Friday nine to five with a closed weekend, or all days closed."""

    def office(d: Column) -> Column:
        t = d["duration"]
        return F.coalesce(d["is_closed"].eqNullSafe(F.lit(False)) & (t["start_hour"] == 9) & (t["start_minute"] == 0) & (t["end_hour"] == 17) & (t["end_minute"] == 0), F.lit(False))

    days = lambda *names: F.array(*(week[d] for d in names))
    work = F.forall(days(*DAYS[1:6]), office) & F.forall(days("saturday", "sunday"), closed)
    return F.coalesce(week.isNotNull() & (work | F.forall(days(*DAYS), closed)), F.lit(False))


def repair_day(day: Column) -> Column:
    """An open day that ends at 24:00 or runs from 0:00 to 0:00 ends at 23:59."""
    t = day["duration"]
    zero = (t["start_hour"] == 0) & (t["start_minute"] == 0) & (t["end_hour"] == 0) & (t["end_minute"] == 0)
    odd = t.isNotNull() & ~day["is_closed"].eqNullSafe(F.lit(True)) & ((t["end_hour"] >= 24) | zero)
    return F.when(odd, open_day(duration(t["start_hour"] * 60 + t["start_minute"], F.lit(23 * 60 + 59)))).otherwise(day)


def repair_week(week: Column) -> Column:
    return let(F.transform(F.array(*(week[d] for d in DAYS)), repair_day), lambda days: F.struct(*(days[k].alias(d) for k, d in enumerate(DAYS))))


def overlay_week(parsed: Column, stored: Column, default: Column) -> Column:
    """Each day from what was parsed, else as stored, else the default."""
    return F.struct(*(F.coalesce(parsed[d], stored[d], default[d]).alias(d) for d in DAYS))


def show_day(day: Column) -> Column:
    """"09:00-17:00", "closed" or null."""
    t = day["duration"]
    return F.when(day["is_closed"], "closed").when(t.isNotNull(), F.format_string("%02d:%02d-%02d:%02d", t["start_hour"], t["start_minute"], t["end_hour"], t["end_minute"]))


def office_week() -> Column:
    nine = open_day(duration(F.lit(540), F.lit(1020)))
    return F.struct(*((closed_day() if d in ("saturday", "sunday") else nine).alias(d) for d in DAYS))
