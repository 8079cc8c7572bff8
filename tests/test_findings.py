"""What reviews found, on inputs that show it."""

from tests.conftest import DATA
from tests.oracle import assert_same, connect

import __spark_entry__


def same_as_sql(spark, name, folder):
    assert_same(__spark_entry__.queries()[name](spark, folder), connect(folder), __spark_entry__.oracle_sql()[name])


def test_a_search_of_names_finds_no_place_ids(spark):
    """Place ids that hold a 7 where the name holds none begin at the customer 1600."""
    same_as_sql(spark, "taxonomy_worklist", f"{DATA}/sf0.1")


def test_texts_of_few_words_are_compared_whole(spark, monkeypatch):
    """One block of labels that share nearly all their pieces: these would make more pairs than there are, and make none now."""
    from recordforge.operators import similar

    monkeypatch.setattr(similar, "SQUARE", 50)
    rows = spark.range(400).selectExpr("'' block", "concat_ws(' ', element_at(array('large', 'small'), cast(id % 2 + 1 as int)), 'ring', concat('brand#', id % 20), id div 8) form").distinct()
    sizes = rows.groupBy("block").count().withColumnRenamed("count", "texts")
    assert similar._crowded(rows, sizes, 0.9).count() == 1
    got = [(r["a"], r["b"], round(r["similarity"], 9)) for r in similar.similar_texts(rows, 0.9).collect()]
    pairs = rows.selectExpr("form a").crossJoin(rows.selectExpr("form b")).where("a < b").selectExpr("a", "b", "round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 9) s").where("s >= 0.9").collect()
    assert len(got) == len(set(got)) and set(got) == {tuple(r) for r in pairs}


def test_pairs_of_a_key_crowded_on_both_sides_are_cut_into_squares(spark, monkeypatch):
    from recordforge.operators import matching

    monkeypatch.setattr(matching, "CROWD", 7)
    a, b = spark.range(60).selectExpr("id", "'hot' k"), spark.range(100, 150).selectExpr("id other_id", "'hot' k")
    dealt, copied = matching.spread(a, b, ["k"], "id", "other_id")
    met = dealt.join(copied, ["k", "_salt"])
    assert met.count() == met.select("id", "other_id").distinct().count() == 3000
    assert met.groupBy("_salt").count().agg({"count": "max"}).first()[0] < 600


def test_a_pair_comes_once_and_from_a_shuffle(spark):
    """Pairs that agree on several keys, nulls and blanks, and no broadcast, which would leave all pairs to one task."""
    from recordforge.operators import matching

    schema = "id int, k1 string, k2 string, k3 string"
    a = spark.createDataFrame([(1, "x", "y", "z"), (2, None, "y", "z"), (3, "", "q", "z"), (4, "x", None, None)], schema)
    b = spark.createDataFrame([(1, "x", "y", "z"), (11, "x", "y", "z"), (12, "", None, "z"), (13, "x", "y", "n")], schema)
    found = matching.or_key_match(a, b, ["k1", "k2", "k3"])
    got = sorted((r["id"], r["other_id"], ",".join(r["keys"])) for r in found.collect())
    agree = lambda p, q: ",".join(f"k{i}" for i in (1, 2, 3) if p[i] and p[i] == q[i])
    assert got == sorted((p[0], q[0], agree(p, q)) for p in map(tuple, a.collect()) for q in map(tuple, b.collect()) if p[0] != q[0] and agree(p, q))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan and "Aggregate [id" not in plan


def test_places_are_held_against_each_other_once(spark):
    """Many rows of two places: distances are of places, and names that differ by more than they may are left out."""
    from recordforge.operators import matching

    point = ("case when id % 2 = 0 then 40.0D else 40.0003D end lat", "-75.0D lng")
    a = spark.range(300).selectExpr("id", "concat('customer ', id % 10) name", *point)
    b = spark.range(200).selectExpr("id", "case when id % 3 = 0 then 'customer 1x' when id % 3 = 1 then 'remotsuc 1' else '' end name", *point)
    assert matching._near_points(a, b, 50).count() == 4
    got = {(r["id"], r["known_id"]) for r in matching.near_existing(a, b, least=0.9).collect()}
    assert got == {(i, j) for i in range(300) for j in range(200) if j % 3 == 0 and i % 10 == 1}


def test_rows_of_a_place_and_name_become_pairs_at_the_end(spark, monkeypatch):
    """Pairs came from a join of rows, each of which rounded its distance; they come from packs of ids, once those are matched."""
    from recordforge.operators import matching

    for name, n in (("CROWD", 11), ("PACK", 7), ("SMALL_PACK", 3)):
        monkeypatch.setattr(matching, name, n, raising=False)
    point = "element_at(array(0.0D, -0.0D, 89.9999D, 0.0002D), cast(id % 4 + 1 as int)) lat", "element_at(array(180.0D, -180.0D, 179.9999D), cast(id div 4 % 3 + 1 as int)) lng"
    a = spark.range(240).selectExpr("id", "element_at(array('', null, 'old mill', 'old mills'), cast(id div 12 % 4 + 1 as int)) name", *point)
    b = spark.range(1000, 1130).selectExpr("id", "element_at(array('', 'old mill'), cast(id div 12 % 2 + 1 as int)) name", *point)
    found = matching.near_existing(a, b)
    got = [(r["id"], r["known_id"], round(r["distance"], 6), round(r["similarity"], 9)) for r in found.collect()]
    far = "2 * 6371000 * asin(least(1, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))))"
    alike = "case when coalesce(a.name, '') = b.name then 1 when coalesce(a.name, '') = '' or b.name = '' then 0 else 1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)) end"
    want = spark.sql(f"select * from (select a.id, b.id known_id, {far} distance, {alike} similarity from {{a}} a cross join {{b}} b) where distance <= 50 and similarity >= 0.85", a=a, b=b)
    assert len(got) > 5000 and sorted(got) == sorted((r["id"], r["known_id"], round(r["distance"], 6), round(float(r["similarity"]), 9)) for r in want.collect())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join Inner")


def test_distances_are_rounded_place_by_place(spark, sf001):
    from recordforge.queries import tables

    for q in (tables.polar_geo_pairs, tables.grid_geo_pairs):
        plan = q(spark, sf001)._jdf.queryExecution().optimizedPlan().toString()
        assert "round(distance" not in plan.split("Join Inner")[0]


def test_heavy_rows_are_dealt_over_tasks(spark, sf001):
    """Cases fell to as many tasks as there are cases, and listings to as many as their file has row groups."""
    from recordforge.queries import rows, scalar

    plans = [d._jdf.queryExecution().toString() for d in (scalar.hours_placeholder(spark, sf001), rows.adapter(spark, sf001))]
    assert "Join Inner, (case_no" in plans[0].replace("rightHint=(strategy=broadcast)", "") and "BroadcastHashJoin [case_no" in plans[0]
    assert all("REPARTITION_BY_NUM" in p for p in plans)
    groups = scalar._rows(spark, sf001, "x string", [("a",), ("b",)]).rdd.glom().map(len).collect()
    assert len(groups) == 4 and sum(groups) == 150 and min(groups) > 20
