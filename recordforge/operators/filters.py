"""Filters that are built from optional settings, as one boolean column each."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordforge.functions.names import real_name, test_name
from recordforge.functions.nulls import blank, every, is_true, not_true, present, some, sure, tri_state


def cohort(seeded: str = "is_seeded", *legacy: str) -> Column:
    """Rows of the seeded cohort: flagged by provenance or by any older flag."""
    return some(*(is_true(F.col(c)) for c in (seeded, *(legacy or ("is_cvb", "is_crawler")))))


@dataclass(frozen=True)
class Search:
    """Settings of a search over records; what isn't set doesn't filter.

    q: a piece of any of ``q_columns``, whatever the case. among: column to allowed values. has: column to whether it must
    have a value. flags: column to the truth it must have. fails, passes: gate criteria, all of which must (not) hold; a
    criterion that is missing fails. only_cohort: rows of the cohort.
    """

    q: str | None = None
    q_columns: tuple[str, ...] = ("name", "place_id", "city", "address")
    among: dict[str, list] = field(default_factory=dict)
    has: dict[str, bool] = field(default_factory=dict)
    flags: dict[str, bool] = field(default_factory=dict)
    fails: tuple[str, ...] = ()
    passes: tuple[str, ...] = ()
    gate: str = "gate"
    only_cohort: bool = False

    def column(self) -> Column:
        text = self.q.strip().lower() if self.q else ""
        found = some(*(sure(F.lower(F.col(c)).contains(text)) for c in self.q_columns)) if text else None
        lists = [F.col(c).isin(*v) for c, v in self.among.items() if v]
        flags = [is_true(F.col(c)) if want else not_true(F.col(c)) for c, want in self.flags.items()]
        return every(
            cohort() if self.only_cohort else None, found, *map(sure, lists), *(tri_state(F.col(c), want) for c, want in self.has.items()), *flags,
            *(not_true(F.col(f"{self.gate}.{c}")) for c in self.fails), *(is_true(F.col(f"{self.gate}.{c}")) for c in self.passes),
        )


def search(rows: DataFrame, s: Search, *, duplicates_of: str | None = None) -> DataFrame:
    """Rows that the search finds; duplicates_of: only those whose value in that column occurs more than once in ``rows``."""
    out = rows.where(s.column())
    if duplicates_of is None:
        return out
    twice = rows.where(present(F.col(duplicates_of))).groupBy(duplicates_of).count().where("count > 1").select(duplicates_of)
    return out.join(twice, duplicates_of, "left_semi").select(*rows.columns)


def select_rows(rows: DataFrame, *, ids: DataFrame | None = None, chosen: Column | None = None, excluded: DataFrame | None = None, key: str = "id") -> DataFrame:
    """A selection: explicit ids, or a filter without excluded ids."""
    if ids is not None:
        return rows.join(ids.select(key).distinct(), key, "left_semi")
    out = rows if chosen is None else rows.where(chosen)
    return out if excluded is None else out.join(excluded.select(key), key, "left_anti")


def resolvable() -> Column:
    """Live cohort rows with an address, city and state and a name that may be real."""
    return every(cohort(), not_true(F.col("is_deleted")), present(F.col("address")), present(F.col("city")), present(F.col("state")), real_name(F.col("name")))


def to_retry(limit: int, *, key: str = "id"):
    """Standalone rows in review, or never resolved ones of the curated list: the first ``limit`` by id, and how many remain."""
    wanted = every(not_true(F.col("is_deleted")), sure((F.col("resolve_status") == "review") | (F.col("resolve_status").isNull() & is_true(F.col("is_cvb")) & present(F.col("place_id")))))

    def run(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        found = rows.where(wanted)
        return found.orderBy(key).limit(limit), found.agg(F.greatest(F.count(F.lit(1)) - limit, F.lit(0)).alias("remaining"))

    return run


def coverless(placeholder: str) -> Column:
    """No cover or only a placeholder, on a row that has a place id."""
    return present(F.col("place_id")) & (blank(F.col("cover")) | sure(F.col("cover").rlike(placeholder)))


def pending(status: str, wanted: str | None = None) -> Column:
    """Rows whose work isn't done: no status, or the wanted one."""
    return F.col(status).isNull() if wanted is None else sure(F.col(status) == wanted)


def in_bounds(lat: str, lng: str, south: float, north: float, west: float, east: float) -> Column:
    return F.col(lat).between(south, north) & F.col(lng).between(west, east)


def audit(*, equal: dict[str, str] | None = None, action: str | None = None, since: str | None = None, until: str | None = None, at: str = "at") -> Column:
    """Log rows: equal columns, a piece of the action, an inclusive span of time."""
    return every(
        *(sure(F.col(c) == v) for c, v in (equal or {}).items()), sure(F.lower("action").contains(action.lower())) if action else None,
        sure(F.col(at) >= F.lit(since).cast("timestamp")) if since else None, sure(F.col(at) <= F.lit(until).cast("timestamp")) if until else None,
    )


def eligible_for_queue() -> Column:
    """Whether a job of its type has what it needs."""
    named = present(F.col("name")) & present(F.col("env"))
    return sure(
        F.when(blank(F.col("business_id")), False).when(F.col("type") == "resolve", True).when(F.col("type") == "discovery", named & F.col("run_id").isNotNull())
        .when(F.col("type") == "email", named).otherwise(present(F.col("place_id")) & named)
    )


def fully_fixed() -> Column:
    """Done, no mismatch and nothing pending."""
    return sure((F.col("status") == "done") & ~F.col("check_status").eqNullSafe(F.lit("mismatch")) & (F.coalesce(F.col("n_pending"), F.lit(0)) == 0))


def junk_names() -> Column:
    return test_name(F.col("name"))


def sessions(search: str | None = None, status: str = "all") -> Column:
    """Sessions by a piece of their name, id or maker, whatever the case, and by status."""
    text = (search or "").lower()
    found = some(*(sure(F.lower(F.col(c)).contains(text)) for c in ("name", "session_id", "created_by"))) if text else None
    return every(found, sure(F.col("status") == status) if status != "all" else None)


def curated(*, city: str | None = None, state: str | None = None, industry: str | None = None, category: str | None = None, search: str | None = None, has_place: bool | None = None, incomplete: bool = False) -> Column:
    """Live rows of the curated cohort; texts are pieces, whatever the case, and are taken literally.

    incomplete: phone, e-mail, website or place id is missing or empty; any of them counts.
    """
    piece = lambda c, t: sure(F.lower(F.col(c)).contains(t.lower())) if t else None
    anywhere = some(*(piece(c, search) for c in ("name", "email", "phone"))) if search else None
    lacking = some(*(blank(F.col(c)) for c in ("phone", "email", "website", "place_id"))) if incomplete else None
    return every(
        cohort(), not_true(F.col("is_deleted")), piece("city", city), piece("state", state), sure(F.col("industry") == industry) if industry else None,
        sure(F.array_contains("categories", category)) if category else None, anywhere, tri_state(F.col("place_id"), has_place), lacking,
    )


def curated_order(by: str = "newest") -> list[Column]:
    """newest, oldest or name; anything else is newest. Ids break ties."""
    return {"oldest": [F.col("created").asc_nulls_first(), F.col("id")], "name": [F.col("name").asc_nulls_first(), F.col("id")]}.get(by, [F.col("created").desc_nulls_last(), F.col("id")])


def taxonomy_worklist(*, status: str = "mismatch", city: str | None = None, state: str | None = None, search: str | None = None, within: tuple[str, ...] = ("name", "place_id", "source_category")) -> Column:
    """Live rows that a resolve pass has given a category status; ``all`` lists each of them. ``search`` looks ``within`` those columns."""
    piece = lambda c, t: sure(F.lower(F.col(c)).contains(t.lower())) if t else None
    anywhere = some(*(piece(c, search) for c in within)) if search else None
    wanted = F.col("category_status").isNotNull() if status == "all" else sure(F.col("category_status") == status)
    return every(not_true(F.col("is_deleted")), wanted, piece("city", city), piece("state", state), anywhere)


def review_worklist(rows: DataFrame, *, status: str = "resolve") -> DataFrame:
    """Live rows in review, the last checked first; ``status`` is a struct with status and checked_at."""
    return rows.where(not_true(F.col("is_deleted")) & sure(F.col(f"{status}.status") == "review")).orderBy(F.col(f"{status}.checked_at").desc_nulls_last(), "id")


def listed(rows: DataFrame, *, only_active: bool = False, order: str = "city") -> DataFrame:
    """All rows by city, or the active ones."""
    return (rows.where(is_true(F.col("is_active"))) if only_active else rows).orderBy(order, "id")
