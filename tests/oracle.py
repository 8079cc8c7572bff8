"""A query's rows beside those of its SQL in DuckDB."""

from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    """A value that compares alike whichever engine made it."""
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return round(float(v), 6) if type(v).__name__ == "Decimal" else v


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def assert_same(df, con, sql):
    names = sorted(df.columns)
    found = con.execute(sql)
    theirs = [x[0] for x in found.description]
    assert sorted(theirs) == names
    want = Counter(tuple(plain(r[theirs.index(c)]) for c in names) for r in found.fetchall())
    assert Counter(tuple(plain(r[c]) for c in names) for r in df.collect()) == want
