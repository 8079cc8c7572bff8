"""Repair plans: each returns what would change and why, and leaves writing to the caller."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordforge.functions import address, geo, hours
from recordforge.functions.names import generic_name
from recordforge.functions.nulls import bind, differs, fired, is_true, not_true, present, sure
from recordforge.operators.matching import child_flags, valid_id, without_children


def resync_city(rows: DataFrame, *, street: str = "address", city: str = "city") -> DataFrame:
    """(id, city, derived, outcome): a city that differs from the one in the address is a mismatch; else match or why not."""
    d = address.derive_city(F.col(street))
    outcome = F.when(d["reason"].isNotNull(), d["reason"]).when(F.lower(F.trim(F.coalesce(city, F.lit("")))) == F.lower(d["city"]), "match").otherwise("mismatch")
    return rows.select("id", F.col(city).alias("city"), d["city"].alias("derived"), outcome.alias("outcome"))


def strip_placeholders(rows: DataFrame, pattern: str, *, cover: str = "cover") -> DataFrame:
    """(id, cover, recoverable) of rows whose cover is a placeholder; those with a place id can get a real one."""
    return rows.where(sure(F.col(cover).rlike(pattern))).select("id", F.lit(None).cast("string").alias(cover), present(F.col("place_id")).alias("recoverable"))


def split_street(rows: DataFrame, *, street: str = "address", other: str = "formatted", city: str = "city") -> DataFrame:
    """(id, outcome, new_street, city_differs) of rows whose street line holds a whole address.

    The other source is split first. outcome: split, not_needed, or unsplittable.
    """
    whole = F.coalesce(address.split_formatted(F.col(other)), address.split_formatted(F.col(street)))
    need = present(F.col(street)) & ~address.street_shape(F.col(street))
    out = rows.withColumn("_w", F.when(need, whole))
    outcome = F.when(~need, "not_needed").when(F.col("_w").isNull(), "unsplittable").otherwise("split")
    return out.select("id", outcome.alias("outcome"), F.col("_w.street").alias("new_street"), sure(differs(F.lower("_w.city"), F.lower(F.trim(city))) & F.col("_w").isNotNull()).alias("city_differs"))


def bad_timing(week: Column) -> Column:
    """Missing or a placeholder week."""
    return week.isNull() | hours.placeholder_week(week)


def missing_outlets(businesses: DataFrame, outlets: DataFrame) -> DataFrame:
    """Live businesses without a live outlet, and the outlet that would be made for each."""
    lacking = without_children(businesses.where(not_true(F.col("is_deleted"))), outlets)
    return lacking.select(F.col("id").alias("parent_id"), F.concat(F.lit("outlet-"), F.col("id").cast("string")).alias("id"), "name", F.lit("physical").alias("category"), F.lit(True).alias("is_active"))


def inactive(businesses: DataFrame, outlets: DataFrame) -> DataFrame:
    """Live businesses that aren't active, with the signals by which a person decides."""
    flagged = child_flags(businesses.where(not_true(F.col("is_deleted")) & ~is_true(F.col("is_active"))), outlets)
    return flagged.withColumn("signals", fired(("no_outlet", F.col("n_children") == 0), ("outlet_inactive", F.col("n_inactive") > 0), ("no_cover", ~present(F.col("cover"))), ("no_address", ~present(F.col("address")))))


def address_signatures(street: str = "address", city: str = "city", state: str = "state") -> Column:
    """Signs of a corrupt address: a state's name as city, digits as city, the city inside the street line, a URL or phone."""
    line, town = F.trim(F.coalesce(F.col(street), F.lit(""))), F.trim(F.coalesce(F.col(city), F.lit("")))
    return fired(
        ("city_is_state", address.is_state(town) & (F.lower(town) != "new york") & (F.lower(town) != "washington")), ("city_is_digits", town.rlike(r"^\d+$")),
        ("city_in_street", (town != "") & F.lower(line).contains(F.concat(F.lit(", "), F.lower(town)))), ("street_is_contact", (line != "") & (line.rlike(r"(?i)^\s*(https?://|www\.)") | line.rlike(r"^\+?[\d\s\-().]{7,}$"))),
    )


def cascade_counts(roots: DataFrame, chain: list[tuple[str, DataFrame, str, str]], *, root_key: str) -> DataFrame:
    """How many rows of each table hang below some roots: (table, n).

    chain: (name, table, own key, parent key), each below the one before. Counting is a dry run; ``refuse`` guards a purge.
    """
    keys = roots.select(F.col(root_key).alias("_k"))
    counts = []
    for name, table, own, parent in chain:
        below = table.join(keys.select(F.col("_k").alias(parent)), parent, "left_semi")
        counts.append(below.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n")))
        keys = below.select(F.col(own).alias("_k")).distinct()
    return reduce(DataFrame.unionByName, counts)


def refuse(roots: DataFrame, guard: Column) -> DataFrame:
    """Roots, unless any of them is guarded."""
    n = roots.where(guard).count()
    if n:
        raise ValueError(f"{n} rows are guarded against purging")
    return roots


def stage_deletes(reviews: DataFrame, menus: DataFrame, files: DataFrame, ids: DataFrame, stage: str) -> dict[str, DataFrame]:
    """Rows that undoing a stage deletes, by table."""
    own = lambda d: d.join(ids.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
    plans = {"reviews": {"reviews": own(reviews)}, "menus": {"menus": own(menus), "files": own(files).where(F.col("name").startswith("menu-"))}, "gallery": {"files": own(files).where(~F.col("name").startswith("menu-"))}}
    return plans[stage]


#: Checks of a live record, and of one that isn't published yet.
CHECKS = ("name", "address", "coords", "hours", "hours_encoding", "keys", "country_code", "cover", "taxonomy", "outlet_link", "resolve")
SEED_CHECKS = ("name", "address", "coords", "hours", "hours_encoding", "keys", "country_code", "cover", "taxonomy", "place_id")
#: Names of the country that addresses give.
US_NAMES = ("united states", "united states of america", "usa", "us", "u.s.", "u.s.a.")


def _placed() -> Column:
    return sure((F.col("latitude") != 0) | (F.col("longitude") != 0))


def _abroad() -> Column:
    return _placed() & ~geo.in_us(F.col("latitude"), F.col("longitude"))


def _foreign() -> Column:
    """A row that states another country and lies outside the US: no audit's business."""
    return (F.col("_country") != "") & ~F.col("_country").isin(*US_NAMES) & F.col("_abroad")


#: A street line that is a web address or a telephone number.
_CONTACT_LINE = (r"(?i)^\s*(https?://|www\.)", r"^\+?[\d\s\-().]{7,}$")


def _common_checks(code: Column, week: Column, encoding: Column, status: Column, onward: Column) -> list[tuple[str, Column]]:
    """Checks that both audits share, of bound columns (see ``_bound``) and values before or after a fix."""
    name, line = F.col("_name"), F.col("_line")
    return [
        ("name", (F.length(name) <= 2) | F.col("_generic")), ("address", (line == "") | line.rlike(_CONTACT_LINE[0]) | line.rlike(_CONTACT_LINE[1])),
        ("coords", ~F.col("_placed") | (F.col("_country").isin(*US_NAMES) & F.col("_abroad"))), ("hours_encoding", week.isNotNull() & encoding), ("keys", status.isNull() | onward.isNull()),
        ("country_code", ~present(code) | ((code == "+1") & F.col("_abroad"))),
    ]


def _said(checks: list[tuple[str, Column]], order: tuple[str, ...]) -> Column:
    by = dict(checks)
    return fired(*((k, by[k]) for k in order))


def _bound(rows: DataFrame) -> DataFrame:
    """Rows that are some audit's business, with what its checks name more than once: texts, places, and the week as it is and repaired."""
    trimmed = lambda c: F.trim(F.coalesce(c, F.lit("")))
    own = bind(rows, _country=F.lower(trimmed("country")), _placed=_placed(), _abroad=_abroad(), _name=trimmed("name"), _line=trimmed("address")).where(~_foreign())
    own = bind(own, _generic=generic_name(F.col("_name")), _fixed=F.when(F.col("week").isNotNull(), hours.repair_week(F.col("week"))))
    # Repairing twice tells whether a repaired week is still odd.
    return bind(own, _odd=differs(F.col("_fixed"), F.col("week")), _odd_fixed=differs(hours.repair_week(F.col("_fixed")), F.col("_fixed")), _holder=hours.placeholder_week(F.col("week")), _holder_fixed=hours.placeholder_week(F.col("_fixed")))


_BOUND = ("_country", "_placed", "_abroad", "_name", "_line", "_generic", "_fixed", "_odd", "_odd_fixed", "_holder", "_holder_fixed")


def audit(rows: DataFrame) -> DataFrame:
    """Live cohort rows, each with ``plan`` (what can be fixed), ``failed_before`` and ``failed_after`` it, and ``ready``.

    Columns read: name, address, latitude, longitude, country, country_code, week, hours_status, n_hours (lines captured),
    resolve_status, status, onward (whether the journey goes on), cover, place_id, industry, categories, outlet_ids (active
    outlets), outlets, activated, n_activated, corrupt (an outlet is marked so), is_cvb, is_crawler. Rows outside the older
    cohort flags, marked corrupt or foreign are left out. A dry run reports ``failed_before``, an applied one ``failed_after``.
    ``queue_cover``: the cover is missing or foreign and a place id to fetch one with is known.
    """
    none = F.array().cast("array<string>")
    own = _bound(rows.where(~sure(F.col("corrupt")) & (is_true(F.col("is_cvb")) | is_true(F.col("is_crawler")))))
    ids, listed, active = (F.coalesce(c, none) for c in ("outlet_ids", "outlets", "activated"))
    lacks = lambda a: F.size(F.array_except(ids, a)) > 0
    own = bind(
        own,
        _captured=sure(F.col("n_hours") > 0), _n=F.size(ids), _lacks=lacks(listed) | lacks(active), _keys=F.col("status").isNull() | F.col("onward").isNull(), _code=~present(F.col("country_code")) & ~F.col("_abroad"),
        _cover_bad=~present(F.col("cover")) | sure(F.lower("cover").contains("googleusercontent")),
        _taxonomy=valid_id(F.col("industry")).isNull() | ~sure(F.size("categories") > 0) | F.exists(F.coalesce("categories", none), lambda c: valid_id(c).isNull()),
        _encoding=F.col("week").isNotNull() & F.col("_odd"),
    )
    flag_hours = (~F.col("_captured") | F.col("_holder_fixed") | F.col("week").isNull()) & ~(F.col("hours_status").eqNullSafe(F.lit("review:no_hours_captured")) & F.col("resolve_status").eqNullSafe(F.lit("review")))
    own = bind(own, _flag=flag_hours, _link=(F.col("_n") >= 1) & (F.col("_lacks") | (F.coalesce("n_activated", F.lit(0)) < F.col("_n"))))
    plan = fired(("hours", F.col("_flag")), ("hours_encoding", F.col("_encoding")), ("keys", F.col("_keys")), ("country_code", F.col("_code")), ("outlet_link", F.col("_link")))

    def failing(fixed: bool) -> Column:
        new = lambda when, value, old: F.when(F.col(when), value).otherwise(F.col(old)) if fixed else F.col(old)
        # An unfixed week that isn't odd is the same as the repaired one.
        holder, odd = (F.col("_holder_fixed"), F.col("_odd_fixed")) if fixed else (F.col("_holder"), F.col("_odd"))
        hour_status, status = new("_flag", F.lit("review:no_hours_captured"), "hours_status"), new("_flag", F.lit("review"), "resolve_status")
        bad_link = (F.col("_n") < 1) | (F.lit(False) if fixed else F.col("_lacks") | (F.coalesce("n_activated", F.lit(0)) < 1))
        checks = _common_checks(new("_code", F.lit("+1"), "country_code"), F.col("week"), odd, new("_keys", F.coalesce("status", F.lit(4.1)), "status"), new("_keys", F.coalesce("onward", F.lit(False)), "onward"))
        checks += [
            ("hours", F.col("week").isNull() | holder | ~F.col("_captured") | ~hour_status.eqNullSafe(F.lit("done"))), ("cover", F.col("_cover_bad")), ("outlet_link", bad_link), ("resolve", ~status.eqNullSafe(F.lit("done"))),
            ("taxonomy", F.col("_taxonomy")),
        ]
        return _said(checks, CHECKS)

    out = bind(own, plan=plan, failed_before=failing(False), failed_after=failing(True), queue_cover=F.col("_cover_bad") & present(F.col("place_id")))
    return out.withColumn("ready", F.size("failed_after") == 0).drop(*_BOUND, "_captured", "_n", "_lacks", "_keys", "_code", "_cover_bad", "_taxonomy", "_encoding", "_flag", "_link")


def seed_audit(rows: DataFrame) -> DataFrame:
    """Rows before publishing, each with ``plan``, ``failed`` after it, ``pending_cover`` (a foreign cover that is replaced later) and ``ready``.

    Columns read: name, address, latitude, longitude, country, country_code, week, status, onward, cover, industry and
    categories (names, not ids), place_id. Foreign rows are left out. Outlets and resolving come with publishing.
    """
    own = bind(_bound(rows), _keys=F.col("status").isNull() | F.col("onward").isNull(), _code=~present(F.col("country_code")) & ~F.col("_abroad"))
    checks = _common_checks(F.when(F.col("_code"), "+1").otherwise(F.col("country_code")), F.col("week"), F.col("_odd_fixed"), F.coalesce("status", F.lit(4.1)), F.coalesce("onward", F.lit(False)))
    none = F.array().cast("array<string>")
    checks += [
        ("hours", F.col("week").isNull() | F.col("_holder_fixed")), ("cover", ~present(F.col("cover"))), ("place_id", ~present(F.trim("place_id")) | F.col("place_id").isNull()),
        ("taxonomy", ~present(F.trim("industry")) | F.col("industry").isNull() | ~sure(F.size("categories") > 0) | F.exists(F.coalesce("categories", none), lambda c: F.trim(F.coalesce(c, F.lit(""))) == "")),
    ]
    plan = fired(("hours_encoding", F.col("week").isNotNull() & F.col("_odd")), ("keys", F.col("_keys")), ("country_code", F.col("_code")))
    out = bind(own, plan=plan, failed=_said(checks, SEED_CHECKS), pending_cover=sure(F.lower("cover").contains("googleusercontent")))
    return out.withColumn("ready", F.size("failed") == 0).drop(*_BOUND, "_keys", "_code")


def audit_summary(audited: DataFrame, failed: str, checks: tuple[str, ...], plans: tuple[str, ...]) -> DataFrame:
    """One row: rows, ready ones, failures by check as ``fail_*`` and what a plan can fix as ``fix_*``."""
    return audited.agg(F.count(F.lit(1)).alias("total"), F.count_if("ready").alias("ready"), *(F.count_if(F.array_contains(failed, c)).alias(f"fail_{c}") for c in checks), *(F.count_if(F.array_contains("plan", p)).alias(f"fix_{p}") for p in plans))


def not_an_object(text: Column) -> Column:
    """Whether stored JSON is missing, null, unreadable or no object: what a week must not be."""
    return ~F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))


def copy_where(rows: DataFrame, guard: Column, source: str, target: str) -> DataFrame:
    """``target`` from ``source`` where the guard holds; a guard that is null doesn't."""
    return rows.withColumn(target, F.when(sure(guard), F.col(source)).otherwise(F.col(target)))


#: Columns that a store manages itself, and that no merge may carry over.
MANAGED = ("_id", "__v", "created_at", "updated_at")


def strip(rows: DataFrame, *extra: str, managed: tuple[str, ...] = MANAGED) -> DataFrame:
    """Rows without managed columns and further ones; those that aren't there are no matter."""
    return rows.drop(*managed, *extra)


def name_lines(items: DataFrame, tags: str, title: str) -> DataFrame:
    """Computed fields of a row: how many tags, how many that aren't empty, whether the title is a text of letters, and its length."""
    return items.withColumns({"n_tags": F.coalesce(F.size(tags), F.lit(0)), "n_real_tags": F.coalesce(F.size(F.filter(tags, lambda t: F.trim(t) != "")), F.lit(0)), "is_text": sure(F.col(title).rlike("[A-Za-z]")), "title_length": F.coalesce(F.length(title), F.lit(0))})


def taxonomy_apply(rows: DataFrame, proposals: DataFrame) -> DataFrame:
    """Industry and categories from a proposal, only on rows that are marked a mismatch and have one: (id, outcome, industry, categories)."""
    both = rows.join(proposals.select("id", F.col("industry").alias("_i"), F.col("categories").alias("_c")), "id", "left")
    outcome = F.when(~F.col("category_status").eqNullSafe(F.lit("mismatch")), "not_mismatch").when(~present(F.col("_i")) | ~sure(F.size("_c") > 0), "no_proposal").otherwise("applied")
    pick = lambda new, old: F.when(outcome == "applied", F.col(new)).otherwise(F.col(old))
    return both.select("id", outcome.alias("outcome"), pick("_i", "industry").alias("industry"), pick("_c", "categories").alias("categories"))


def timing_repair(rows: DataFrame) -> DataFrame:
    """Rows whose week is missing or a placeholder, with the default week that a repair would store: (id, reason, week)."""
    reason = F.when(F.col("week").isNull(), "missing").when(hours.placeholder_week(F.col("week")), "placeholder")
    return rows.select("id", reason.alias("reason"), F.when(F.col("week").isNull(), hours.office_week()).otherwise(F.col("week")).alias("week")).where("reason is not null")


def purge_plan(roots: DataFrame, chain: list[tuple[str, DataFrame, str, str]], *, root_key: str, guard: Column) -> DataFrame:
    """The keys of all rows that a purge would delete, by table: (table, key). Guarded roots keep theirs."""
    keys = roots.where(~sure(guard)).select(F.col(root_key).alias("_k"))
    out = []
    for name, table, own, parent in chain:
        below = table.join(keys.select(F.col("_k").alias(parent)).distinct(), parent, "left_semi")
        out.append(below.select(F.lit(name).alias("table"), F.col(own).cast("string").alias("key")))
        keys = below.select(F.col(own).alias("_k"))
    return reduce(DataFrame.unionByName, out)


@dataclass(frozen=True)
class Below:
    """A table that hangs below others: its rows go with any row of a parent that one of ``parents`` names, as (table, column).

    table: a DataFrame, or what reads one, which may fail. own: the column that the tables below it refer to.
    """

    name: str
    table: DataFrame | Callable[[], DataFrame]
    own: str
    parents: tuple[tuple[str, str], ...]


def _in_order(specs: list[Below], root: str) -> list[Below]:
    """Specs with each table behind its parents; a table that is its own ancestor, or has an unknown parent, is an error."""
    left, known, out = list(specs), {root}, []
    while left:
        ready = [s for s in left if all(p in known for p, _ in s.parents)]
        if not ready:
            raise ValueError(f"no order of {sorted(s.name for s in left)}: a cycle or an unknown parent")
        out += ready
        known |= {s.name for s in ready}
        left = [s for s in left if s.name not in known]
    return out


def purge_graph(roots: DataFrame, specs: list[Below], *, root_key: str, root: str = "roots", guard: Column | None = None, cut: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """What a purge of some roots takes along a graph of tables: counts (table, n, error), and each table's rows that go.

    A dry run: the counts are one plan, nothing is deleted. A table that can't be read or lacks a column counts -1, with
    the error; it takes nothing further along, and the other tables aren't affected. A row is counted once, by however
    many ways it is reached. Guarded roots refuse the purge as a whole, before any table is read.

    cut: what keeps a table's keys for those below it, such as ``lambda keys: keys.checkpoint()``; for graphs of many tables, whose
    plans would repeat those of all tables above. An error while the keys are read is then that table's, too.
    """
    if guard is not None:
        refuse(roots, guard)
    keys = {root: roots.select(F.col(root_key).alias("_k")).where("_k is not null").distinct()}
    rows: dict[str, DataFrame] = {}
    failed: list[tuple[str, int, str]] = []
    for spec in _in_order(specs, root):
        try:
            table = spec.table() if callable(spec.table) else spec.table
            # The keys of all parents that refer by one column are one set, so that each column costs one semi join.
            columns = dict.fromkeys(c for _, c in spec.parents)
            hit = F.lit(False)
            marked = table
            for k, column in enumerate(columns):
                wanted = reduce(DataFrame.unionByName, [keys[p] for p, c in spec.parents if c == column and p in keys] or [keys[root].limit(0)]).distinct()
                marked = marked.join(wanted.select(F.col("_k").alias(f"_k{k}")), F.col(column) == F.col(f"_k{k}"), "left")
                hit = hit | F.col(f"_k{k}").isNotNull()
            rows[spec.name] = marked.where(hit).select(*(table[c] for c in table.columns))
            own = rows[spec.name].select(F.col(spec.own).alias("_k")).where("_k is not null").distinct()
            keys[spec.name] = cut(own) if cut else own
        except Exception as e:
            rows.pop(spec.name, None)
            failed.append((spec.name, -1, str(e).partition("\n")[0][:200]))
    counts = [d.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n"), F.lit(None).cast("string").alias("error")) for name, d in rows.items()]
    told = roots.sparkSession.createDataFrame(failed, "table string, n long, error string")
    return reduce(DataFrame.unionByName, [*counts, told]), rows
