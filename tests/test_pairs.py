"""Pair joins against comparing all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from recordforge.functions import geo
from recordforge.operators import matching, similar


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@pytest.mark.parametrize("least", [0.6, 0.8, 0.85, 1.0])
@pytest.mark.parametrize("few", [0, 64])
def test_similar_texts_are_all_found(spark, monkeypatch, least, few):
    monkeypatch.setattr(similar, "FEW", few)
    r = random.Random(least)
    texts = {("b", "".join(r.choice("ab c") for _ in range(r.randrange(26)))) for _ in range(110)}
    for b, t in list(texts):
        for _ in range(2):
            k = r.randrange(len(t) + 1)
            texts.add((r.choice(["b", "c"]), t[:k] + r.choice(["", "x", "é"]) + t[k + r.randrange(3) :]))
    texts |= {("b", ""), ("c", ""), ("d", "alone"), (None, "b"), ("b", None)}
    got = {(x["block"], x["a"], x["b"]): x["similarity"] for x in similar.similar_texts(spark.createDataFrame(sorted(texts, key=repr), "block string, form string"), least).collect()}
    known = [t for t in texts if t[0] is not None and t[1]]
    want = {(g, a, b): 1 - edits(a, b) / max(len(a), len(b)) for g, a in known for h, b in known if g == h and a < b}
    assert got == pytest.approx({k: v for k, v in want.items() if v >= least - 1e-12})


def test_pairs_of_a_large_block_are_not_all_compared(spark):
    """Of one block of 20,000 names, many of which share words, few pairs become candidates."""
    r = random.Random(1)
    words = ["".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randrange(4, 9))) for _ in range(300)]
    rows = {f"{r.choice(words)} {r.choice(words)} {r.choice(words)} {r.choice(['grill', 'cafe', 'salon', 'market'])}" for _ in range(20_000)}
    names = spark.createDataFrame([("b", x) for x in rows], "block string, form string")
    n = names.count()
    found = similar.candidates(names, 0.85).count()
    assert found < n * n // 100, found


def test_pairs_of_rows(spark):
    rows = spark.createDataFrame([(1, "b", "one two"), (2, "b", "one two"), (3, "b", "one twp"), (4, "c", "one two"), (5, None, "one two"), (6, "b", None), (7, "b", ""), (8, "b", "")], "id int, block string, name string")
    got = {(r["id"], r["other_id"]) for r in similar.fuzzy_pairs(rows, "block", F.col("name"), least=0.8).collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (7, 8)}
    assert similar.fuzzy_pairs(rows.limit(0), "block", F.col("name")).count() == 0


def metres(a, b):
    half = lambda x, y: math.sin(math.radians(y - x) / 2) ** 2
    return 2 * geo.EARTH_M * math.asin(min(1, math.sqrt(half(a[0], b[0]) + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * half(a[1], b[1]))))


@pytest.mark.parametrize("within", [50.0, 5_000.0, 3_000_000.0])
def test_near_points_everywhere_on_earth(spark, within):
    r = random.Random(int(within))
    step = within / 111_000
    centres = [(90.0, 0.0), (-90.0, 12.0), (89.9, 180.0), (60.0, -180.0), (0.0, 179.99999), (-33.0, 0.0), (89.5, 10.0), (45.0, 90.0)]
    points = []
    for lat, lng in centres:
        for _ in range(25):
            la = max(-90.0, min(90.0, lat + r.uniform(-2, 2) * step))
            wide = min(180.0, 2 * step / max(math.cos(math.radians(la)), 1e-9))
            points.append((la, (lng + r.uniform(-1, 1) * wide + 180) % 360 - 180))
    points += [(lat, -180.0) for lat, _ in centres] + [(lat, 180.0) for lat, _ in centres]
    a, b = points[::2], points[1::2]
    frame = lambda ps: spark.createDataFrame([(k, "n", *p) for k, p in enumerate(ps)], "id int, name string, lat double, lng double")
    got = {(x["id"], x["known_id"]) for x in matching.near_existing(frame(a), frame(b), metres=within).collect()}
    assert got == {(i, j) for i, p in enumerate(a) for j, q in enumerate(b) if metres(p, q) <= within}


def test_a_row_near_a_pole_widens_no_other_cell(spark):
    rows = spark.createDataFrame([(40.0, -75.0), (40.0, -74.999), (89.9999, 0.0), (89.99995, 170.0)], "lat double, lng double")
    cells = [tuple(r["c"]) for r in rows.select(geo.cell(F.col("lat"), F.col("lng"), 50).alias("c")).collect()]
    assert cells[0] != cells[1] and cells[0][0] == cells[1][0] and {cells[2][1], cells[3][1]} <= {0, 1}


def test_metres_as_degrees():
    assert geo.lat_degrees(111_320) == 1 and geo.lng_degrees(111_320, 60) == pytest.approx(2) and geo.lng_degrees(50, 90) == geo.lat_degrees(50)
