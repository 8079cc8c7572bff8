"""Names in texts and category maps against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from recordforge.operators import contained, records


def made(seed, n, most):
    r = random.Random(seed)
    return sorted({"".join(r.choice("ab é") for _ in range(r.randrange(most))) for _ in range(n)})


def test_all_names_in_all_texts(spark):
    texts, names = made(1, 60, 25), made(2, 80, 12)
    got = {tuple(r) for r in contained.contained(spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string"), spark.createDataFrame([(n,) for n in names] + [(None,)], "name string")).collect()}
    assert got == {(t, n) for t in texts for n in names if n and n in t}


@pytest.mark.parametrize("sent", [0, 1000])
def test_first_name_and_areas(spark, sent):
    texts, names = made(3, 60, 25), [n for n in made(4, 60, 9) if n]
    order = {n: k * 7 % 13 for k, n in enumerate(names)}
    rows = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None, texts[0]])], "id int, t string")
    got = {r["id"]: r["first"] for r in contained.first_contained(rows, F.col("t"), spark.createDataFrame(list(order.items()), "name string, ordinal int"), sent=sent).collect()}
    assert got == {k: min((n for n in names if n in (t or "")), key=lambda n: (order[n], n), default=None) for k, t in enumerate([*texts, None, texts[0]])}
    areas = spark.createDataFrame([("Ab", "X", 2), ("ab", "Y", 3), ("b é", "Z", 1), ("", "Q", 0)], "area string, city string, ordinal int")
    rows = spark.createDataFrame([(1, "xx AB b"), (2, "b É ab"), (3, "none"), (4, None)], "id int, t string")
    said = sorted(tuple(r) for r in contained.area_in_text(rows, areas, "t", sent=sent).select("id", "area", "ambiguous", "area_city").collect())
    assert said == [(1, "ab", True, None), (2, "b é", False, "Z"), (3, None, False, None), (4, None, False, None)]
    assert contained.area_in_text(rows, areas.limit(0), "t", sent=sent).where("area is not null").count() == 0


@pytest.mark.parametrize("industry", [None, "Beauty"])
@pytest.mark.parametrize("sent", [0, 1000])
def test_the_table_says_what_the_list_says(spark, industry, sent):
    entries = [("coffee", "Food", ["c1"]), ("nail", "Beauty", ["n"]), ("nail salon", "Beauty", ["ns"]), ("bar and coffee", "Food", ["bc"]), ("spa", "Beauty", ["s", "t"]), ("o", "Food", [])]
    raw = ["Coffee", "nail salon", " NAIL ", "best nail salon spa", "bar", "xyz", "", None, "pa", "coffee spa", "a"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(raw)], "id int, raw string")
    table = spark.createDataFrame([(*e, k) for k, e in enumerate(entries)], "key string, industry string, categories array<string>, ordinal int")
    want = {r["id"]: r["m"] for r in rows.select("id", records.map_category(F.col("raw"), entries, industry).alias("m")).collect()}
    assert {r["id"]: r["mapped"] for r in contained.map_categories(rows, F.col("raw"), table, industry=industry, sent=sent).collect()} == want


def test_a_map_of_many_keys(spark):
    table = spark.range(50_000).selectExpr("concat('key', lpad(id, 6, '0'), ' thing') key", "'I' industry", "array('c') categories", "id ordinal")
    rows = spark.createDataFrame([(1, "big KEY012345 thing here"), (2, "ey049999"), (3, "key0"), (4, "nothing")], "id int, raw string")
    got = {r["id"]: r["mapped"]["is_fallback"] for r in contained.map_categories(rows, F.col("raw"), table).collect()}
    assert got == {1: False, 2: False, 3: False, 4: True}
