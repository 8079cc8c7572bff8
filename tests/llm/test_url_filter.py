"""URL verdicts against a plain version."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from recordforge.llm.url_filter import filter_urls

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
LISTED = ["https://bad.example/", "http://WORSE.example/x/y?q=1", "https://bad.example/", None, "no url", "http://deep.a.b.example", *(f"https://l{k}.listed.test/p{k}" for k in range(300))]
URLS = [
    None, "", "no url", "http://", "http:///path", "https://A.NET/x", "https://net/", "https://net", "http://fr.example.net/en/a#f", "http://example.net/EN/", "ftp://example.com/de/1?x", "http://x.org/fr/", "http://x.org/fr", "http://notnet/", "//x.net/",
    "http://bad.example/any", "http://sub.bad.example", "http://worse.example/x/y", "http://worse.example/x", "http://a.worse.example/x/y#z", "http://b.example/", "http://z.deep.a.b.example/q", "http://a://b.net/", "x\ny://bad.example\n/p", "http://l7.listed.test/p7", "http://l7.listed.test/p8", "http://x.net/" + "y" * 5000, "http://" + "a." * 3000 + "bad.example/x", "http://" + "a." * 3000 + "good.example/x",
]


def split(url):
    if "://" not in (url or ""):
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:at], rest[at:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(c.lower() if c.isascii() else c for c in host), tail[:end]


def plain(url):
    host, path = split(url)
    listed = {(h, p or "/") for h, p in map(split, LISTED) if h}
    fits = [(h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        rule, verdict = max(fits, key=lambda x: len(x[0]))
        return host, path, rule, verdict
    labels = host.split(".")
    parents = [".".join(labels[k:]) for k in range(len(labels))] if host else []
    return host, path, None, "block" if any((h, p) in listed for h in parents for p in ("/", path or "/")) else "allow"


@pytest.mark.parametrize("sent_blocks", [1 << 18, 0])
def test_verdicts(spark, sent_blocks):
    rows = list(enumerate(URLS)) + [(4, "http://bad.example/"), (4, "http://bad.example/"), (None, "http://x.net/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit("clash"), "key": F.lit(1), "hit": F.lit(None).cast("boolean")})
    listed = spark.createDataFrame([(u,) for u in LISTED], "url string").withColumn("key", F.lit(0))
    got = filter_urls(pages, listed, RULES, sent_blocks=sent_blocks).collect()
    assert Counter(tuple(r) for r in got) == Counter((i, *plain(u)) for i, u in rows)


def test_empty(spark):
    pages, listed = spark.createDataFrame([(1, "http://bad.example/")], "page_id long, url string"), spark.createDataFrame([], "url string")
    assert filter_urls(pages, listed, RULES).first()["verdict"] == "allow"
    assert filter_urls(pages.limit(0), listed, RULES).count() == 0
