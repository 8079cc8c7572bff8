"""Which names stand in which texts, as pieces of them: for gazetteers and category maps of any size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordforge.operators.matching import spread

#: Lengths of the beginnings by which names are looked up; a name goes by the longest that it has.
STARTS = (1, 2, 4, 8)


def contained(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct pairs (text, name) where the name stands in the text, whatever is around it.

    texts: (text), names: (name), both distinct. Texts are cut at each of their places into beginnings, which meet those of
    the names in a join; what follows is compared there. Nothing goes to all tasks, and a beginning that many texts or
    names have is spread. Null and empty names stand nowhere.
    """
    length = lambda c: F.length(c)
    start = lambda c: [F.when(length(c) >= n, n) for n in reversed(STARTS)]
    known = names.where("name <> ''").withColumn("n", F.coalesce(*start(F.col("name")))).select("name", F.substring("name", F.lit(1), F.col("n")).alias("key"))
    places = texts.where("text <> ''").select("text", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("at"))
    cut = places.select("text", "at", F.explode(F.array(*map(F.lit, STARTS))).alias("n")).where(F.col("at") + F.col("n") - 1 <= F.length("text"))
    looked = cut.select("text", "at", F.substring("text", F.col("at"), F.col("n")).alias("key")).join(known.select("key").distinct(), "key", "left_semi")
    dealt, copied = spread(looked, known, ["key"], "text", "name")
    return dealt.join(copied, ["key", "_salt"]).where(F.substring("text", F.col("at"), F.length("name")) == F.col("name")).select("text", "name").distinct()


def first_contained(rows: DataFrame, text: Column, names: DataFrame, *, sent: int = 200_000) -> DataFrame:
    """``rows`` with ``first``: of the names that stand in the text the one that comes first by (ordinal, name); null if none does.

    names: (name, ordinal), each name once. Up to ``sent`` of them go to all tasks, which read each text once for all names
    with one automaton a task; more are found by a join.
    """
    names = names.where("name <> ''")
    known = names.limit(sent + 1).collect()
    if len(known) <= sent:
        ordered = [r["name"] for r in sorted(known, key=lambda r: (r["ordinal"], r["name"]))]
        return rows.withColumn("first", _finder(rows.sparkSession.sparkContext.broadcast(ordered))(text)) if ordered else rows.withColumn("first", F.lit(None).cast("string"))
    wanted = rows.withColumn("__text", text)
    pairs = contained(wanted.select(F.col("__text").alias("text")).where("text <> ''").distinct(), names.select("name"))
    best = pairs.join(names, "name").groupBy("text").agg(F.min_by("name", F.struct("ordinal", "name")).alias("first"))
    return wanted.join(best.withColumnRenamed("text", "__text"), "__text", "left").select(*rows.columns, "first")


def _finder(shared) -> Callable:
    @F.pandas_udf("string")
    def first(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        found = ahocorasick.Automaton()
        for k, name in enumerate(shared.value):
            found.add_word(name, k)
        found.make_automaton()
        for part in texts:
            at = part.map(lambda t: min((k for _, k in found.iter(t)), default=-1) if t else -1)
            yield at.map(lambda k: shared.value[k] if k >= 0 else None).astype(object)

    return first


def map_categories(rows: DataFrame, raw: Column, table: DataFrame, *, industry: str | None = None, default: str = "Food & Drinks", sent: int = 200_000) -> DataFrame:
    """``rows`` with ``mapped``, struct(industry, categories, is_fallback): what a map of any size says of a raw category.

    table: (key, industry, categories, ordinal), keys lower case and each once. The exact key counts, else the first by
    ordinal that holds or is held by the text, whatever the case. With ``industry`` only its keys count, and an exact key
    of another ends the search. Each distinct text is looked up once: keys within it, and it within keys.
    """
    want = (industry or "").strip().lower()
    fits = F.lower(F.trim(F.col("industry"))) == want if want else F.lit(True)
    keyed = rows.withColumn("__key", F.lower(F.trim(raw)))
    texts = keyed.select(F.col("__key").alias("text")).where("text <> ''").distinct()
    usable = table.where(fits)
    held = first_contained(texts, F.col("text"), usable.select(F.col("key").alias("name"), "ordinal"), sent=sent).where("first is not null").select("text", F.col("first").alias("key"))
    holding = contained(usable.select(F.col("key").alias("text")).where("text <> ''").distinct(), texts.select(F.col("text").alias("name"))).select(F.col("name").alias("text"), F.col("text").alias("key"))
    near = held.unionByName(holding).join(usable.select("key", "ordinal"), "key").groupBy("text").agg(F.min_by("key", "ordinal").alias("near"))
    exact = texts.join(table.select(F.col("key").alias("text"), F.lit(True).alias("exact"), fits.alias("fits")), "text", "left")
    chosen = exact.join(near, "text", "left").select("text", F.when(F.col("exact"), F.when(F.col("fits"), F.col("text"))).otherwise(F.col("near")).alias("key"))
    said = chosen.join(table.select("key", F.struct((F.lit(industry) if industry else F.col("industry")).alias("industry"), "categories", F.lit(False).alias("is_fallback")).alias("hit")), "key").select(F.col("text").alias("__key"), "hit")
    none = F.struct(F.lit(industry or default).alias("industry"), F.array().cast("array<string>").alias("categories"), F.lit(True).alias("is_fallback"))
    return keyed.join(said, "__key", "left").select(*rows.columns, F.coalesce("hit", none).alias("mapped"))


def area_in_text(rows: DataFrame, areas: DataFrame, text: str, *, sent: int = 200_000) -> DataFrame:
    """The first area (by its ordinal) whose name is a piece of the text, and its city unless several cities have it.

    areas: (area, city, ordinal), a gazetteer of any size. Adds ``area``, ``area_city`` and ``ambiguous``.
    """
    names = areas.where("area <> ''").groupBy(F.lower("area").alias("name")).agg(F.min("ordinal").alias("ordinal"), F.array_sort(F.collect_set("city")).alias("__cities"))
    found = first_contained(rows, F.lower(text), names.select("name", "ordinal"), sent=sent).withColumnRenamed("first", "area")
    hit = found.join(names.select(F.col("name").alias("area"), "__cities"), "area", "left").withColumn("ambiguous", F.coalesce(F.size("__cities") > 1, F.lit(False)))
    return hit.withColumn("area_city", F.when(~F.col("ambiguous"), F.get("__cities", F.lit(0)))).select(*rows.columns, "area", "ambiguous", "area_city")
