"""A purge over a graph of many tables against plain sets."""

import random

import pytest
from pyspark.sql import functions as F

from recordforge.operators.repair import Below, purge_graph


def test_forty_three_tables(spark):
    r = random.Random(3)
    frames, specs, plain = {}, [], {"roots": {None: None}}
    for k in range(43):
        parents = sorted({(f"t{j}" if (j := r.randrange(-1, k)) >= 0 else "roots") for _ in range(r.randrange(1, 4))}) if k else ["roots"]
        columns = tuple((p, f"p{i % 2}") for i, p in enumerate(parents))
        rows = [(1000 * k + i, r.choice([None, *range(4), *(1000 * j + i for j in range(max(k, 1)))]), r.choice([None, *(1000 * j + i for j in range(max(k, 1)))])) for i in range(12)]
        plain[f"t{k}"] = (columns, rows)
        frames[f"t{k}"] = spark.createDataFrame(rows, "id long, p0 long, p1 long")
        specs.append(Below(f"t{k}", frames[f"t{k}"], "id", columns))
    r.shuffle(specs)
    keys, want = {"roots": {0, 2}}, {}
    for k in range(43):
        columns, rows = plain[f"t{k}"]
        gone = [x for x in rows if any(x[1 if c == "p0" else 2] in keys[p] for p, c in columns)]
        keys[f"t{k}"], want[f"t{k}"] = {x[0] for x in gone}, len(gone)
    counts, _ = purge_graph(spark.createDataFrame([(0,), (2,), (None,)], "id long"), specs, root_key="id", cut=lambda d: d.checkpoint())
    found = counts.collect()
    assert [x["error"] for x in found if x["error"]] == []
    assert {x["table"]: x["n"] for x in found} == want and sum(want.values()) > 43


def test_errors_guards_and_cycles(spark):
    roots = spark.createDataFrame([(1, False), (2, True)], "id long, paid boolean")

    def broken():
        raise OSError("no such table")

    ok = Below("ok", spark.createDataFrame([(7, 1), (8, 1), (9, None)], "id long, r long"), "id", (("roots", "r"),))
    specs = [ok, Below("gone", broken, "id", (("ok", "x"),)), Below("odd", ok.table, "id", (("ok", "no_column"),)), Below("last", ok.table, "id", (("gone", "r"), ("ok", "id")))]
    counts, rows = purge_graph(roots, specs, root_key="id")
    assert {(x["table"], x["n"], x["error"] is None) for x in counts.collect()} == {("ok", 2, True), ("gone", -1, False), ("odd", -1, False), ("last", 2, True)}
    assert sorted(rows) == ["last", "ok"] and sorted(x["id"] for x in rows["last"].collect()) == [7, 8]
    with pytest.raises(ValueError, match="guarded"):
        purge_graph(roots, specs, root_key="id", guard=F.col("paid"))
    with pytest.raises(ValueError, match="cycle"):
        purge_graph(roots, [Below("a", ok.table, "id", (("b", "r"),)), Below("b", ok.table, "id", (("a", "r"),))], root_key="id")
    assert purge_graph(roots.limit(0), [ok], root_key="id")[0].first()["n"] == 0
