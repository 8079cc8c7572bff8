"""Order, pages, samples and picks of one row per group, each with a tie-break that makes it repeatable."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(rows: DataFrame, keys: list[str], order: list[Column], *, n: int = 1, place: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group; place: a column to keep the rank in."""
    name = place or "_place"
    out = rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return out if place else out.drop(name)


def survivors(rows: DataFrame, key: str, score: Column, *, created: str = "created", id_col: str = "id") -> DataFrame:
    """In each group of ``key`` the best row survives: highest score, then oldest (no date last), then id.

    Adds ``score`` and ``is_survivor``, ``group_size`` and ``survivor_id``. A group is summed up before it is shuffled, so
    that a key which holds most rows is no single task's.
    """
    scored = rows.withColumn("score", score)
    first = F.struct((-F.col("score")).alias("s"), F.col(created).isNull().alias("n"), F.col(created).alias("c"), F.col(id_col).alias("i"))
    best = scored.groupBy(key).agg(F.min_by(id_col, first).alias("survivor_id"), F.count(F.lit(1)).alias("group_size"))
    return scored.join(best, key).withColumn("is_survivor", F.col(id_col) == F.col("survivor_id"))


@dataclass(frozen=True)
class Page:
    number: int = 1
    size: int = 50
    largest: int = 200

    @property
    def rows(self) -> int:
        return min(max(self.size, 1), self.largest)

    @property
    def skip(self) -> int:
        return (max(self.number, 1) - 1) * self.rows


def page(rows: DataFrame, order: list[Column], p: Page) -> tuple[DataFrame, DataFrame]:
    """A page of rows and the totals: (rows, struct of total and pages)."""
    total = rows.agg(F.count(F.lit(1)).alias("total")).select("total", F.greatest(F.lit(1), F.ceil(F.col("total") / p.rows)).cast("long").alias("pages"))
    return rows.orderBy(*order).offset(p.skip).limit(p.rows), total


def stride_sample(rows: DataFrame, order: str, n: int, *, ranges: int = 200) -> DataFrame:
    """``n`` rows evenly spread over the order: those at floor(i * count / n). All rows if there are no more than ``n``.

    Values of ``order`` are unique. Rows are ranked within ranges whose bounds are some of the values, the same each time,
    and the ranges' sizes are added up, so that no task holds all rows.
    """
    spark = rows.sparkSession
    picked = rows.where(F.col(order).isNotNull()).select(order).orderBy(F.xxhash64(order), order).limit(ranges).collect()
    bounds = F.array(*(F.lit(r[0]) for r in sorted(picked))) if picked else F.array(F.lit(None))
    placed = rows.withColumn("_part", F.size(F.filter(bounds, lambda b: b <= F.col(order))))
    starts, total = {}, 0
    for part, size in sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()):
        starts[part], total = total, total + size
    if total <= n:
        return rows
    offsets = F.create_map(*(F.lit(x) for pair in starts.items() for x in pair))
    wanted = spark.range(n).select(F.floor(F.col("id") * total / n).alias("_rank"))
    ranked = placed.withColumn("_rank", F.try_element_at(offsets, F.col("_part")) + F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1)
    return ranked.join(wanted, "_rank", "left_semi").select(*rows.columns)


def top_n(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def best_emails(hits: DataFrame, *, site: str = "site") -> DataFrame:
    """One address for each site: by tier, then a domain that is the site's, then place. Role addresses only if there are
    no others, and then of tier C. Columns: site, email, tier, is_role, domain_matches, position."""
    only_role = F.min(F.col("is_role").cast("int")).over(Window.partitionBy(site)) == 1
    pool = hits.withColumn("_only_role", only_role).where("_only_role or not is_role").withColumn("tier", F.when(F.col("_only_role"), "C").otherwise(F.col("tier"))).drop("_only_role")
    return first_per(pool, [site], [F.col("tier"), F.col("domain_matches").desc(), F.col("position"), F.col("email")])


def contact_links(links: DataFrame, *, site: str = "site", n: int = 3) -> DataFrame:
    """Up to ``n`` links of each site that may lead to a contact page: same host, a telling path, each once, shortest first."""
    path = F.regexp_extract("link", r"^https?://[^/?#]+([^?#]*)", 1)
    telling = F.regexp_extract("link", r"^https?://[^/?#]+(.*)$", 1).rlike("(?i)contact|about|reach|team")
    found = links.withColumns({"_host": F.regexp_replace(F.lower(F.regexp_extract("link", r"^https?://([^/?#:]+)", 1)), r"^www\.", ""), "_path": path, "_key": F.lower(F.regexp_replace(F.regexp_replace("link", r"[?#].*$", ""), "/+$", ""))})
    found = found.where((F.col("_host") == F.col("host")) & telling)
    once = first_per(found, [site, "_key"], [F.col("position"), F.col("link")])
    return first_per(once, [site], [F.greatest(F.length("_path"), F.lit(1)), F.col("link")], n=n, place="place").drop("_host", "_path", "_key")


def pick_image(files: DataFrame, folders: list[str], *, parent: str = "parent") -> DataFrame:
    """One image for each parent: of the first folder in the list that has one, else the first there is."""
    order = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, folders)), F.col("folder")), F.lit(0)), F.lit(len(folders) + 1))
    return files.where("url <> ''").groupBy(parent).agg(F.min_by("url", F.struct(order, "position")).alias("url"))


def earliest(files: DataFrame, parent: str, at: str, key: str) -> DataFrame:
    return files.groupBy(parent).agg(F.min_by(key, F.struct(at, key)).alias(key))


def claim(jobs: DataFrame, n: int, *, attempts: int = 3) -> DataFrame:
    """The next ``n`` jobs to run: pending with attempts left, oldest first. A single writer must store the result."""
    return jobs.where((F.col("status") == "pending") & (F.col("attempts") < attempts)).orderBy("created", "id").limit(n).withColumns({"status": F.lit("running"), "attempts": F.col("attempts") + 1})


def tail(entries: Column, n: int) -> Column:
    """The last ``n`` elements of an array."""
    return F.when(F.size(entries) > n, F.slice(entries, -n, n)).otherwise(entries)


def cap_per(rows: DataFrame, key: str, order: list[Column], *, once: str | None = None, n: int) -> DataFrame:
    """Each value of ``once`` only where it comes first, and at most ``n`` rows for each key: the cap is what is asked for."""
    kept = rows if once is None else first_per(rows, [once], order)
    return first_per(kept, [key], order, n=n)


def first_label(rows: DataFrame, key: str, labels: dict[str, int]) -> DataFrame:
    """The value of the label that ranks first, the earliest of it, for each key. Columns: label, value, position."""
    rank = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return rows.withColumn("_rank", F.try_element_at(rank, F.col("label"))).where("_rank is not null").groupBy(key).agg(F.min_by("value", F.struct("_rank", "position")).alias("value"))
