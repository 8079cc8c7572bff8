"""Secret scans with DataFrame functions only: fixed patterns, and two character Markov models for the rest.

One model is of random strings, the other of ordinary identifiers; both are counted from labelled samples. A long token
is a secret if the models' log-likelihood ratio speaks for random.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: In the order that breaks ties.
KINDS = ("assign", "access", "hex", "random")
_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs of these characters reach as far as they can, so a bound on the length in the pattern is the same as one after it.
_ACCESS = r"AKIA[A-Z0-9]{16,}"
_HEX = r"[0-9a-f]{24,}"
_TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"

#: Parts of ordinary identifiers.
PARTS = (
    "get set user name value index count list array string number table column row field record data file path open close read write load save "
    "update delete insert select create build parse format convert check test valid error message result response request server client config option "
    "default current previous next first last start end begin finish time date year month day hour minute second total average maximum minimum length size "
    "width height left right center top bottom color image text label button window panel menu item group order price customer product account "
    "address email phone country city street state region address session token cache queue stack tree node edge graph matrix vector point line the and "
    "with from into over under after before between information application management development international environment"
).split()


def labelled_samples(spark: SparkSession, n: int = 6000) -> DataFrame:
    """``n`` strings of either label, made from digests of the row number: (text, random)."""
    rows = spark.range(n).withColumn("h", F.sha2(F.col("id").cast("string"), 512))
    word = lambda k: F.element_at(F.split(F.lit(" ".join(PARTS)), " "), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(PARTS))) + 1).cast("int"))
    raw = F.base64(F.unhex(F.substring("h", 1, 96)))
    random = F.element_at(F.array(raw, F.substring("h", 1, 40), F.regexp_replace(raw, "[+/]", "_"), F.upper(F.regexp_replace(raw, "[^A-Za-z0-9]", "")), F.lower(F.regexp_replace(raw, "[^A-Za-z0-9]", ""))), (F.pmod("id", F.lit(5)) + 1).cast("int"))
    parts = [word(k) for k in range(4)]
    camel = F.concat(parts[0], *(F.initcap(p) for p in parts[1:]))
    plain = F.element_at(
        F.array(F.concat_ws("_", *parts), camel, F.concat_ws("-", *parts), F.upper(F.concat_ws("_", *parts)), F.concat(*parts), F.concat_ws("/", *parts), F.concat(F.concat_ws("_", *parts[:3]), (F.col("id") % 100).cast("string"))),
        (F.pmod("id", F.lit(7)) + 1).cast("int"),
    )
    return rows.select(F.explode(F.array(F.struct(random.alias("text"), F.lit(True).alias("random")), F.struct(plain.alias("text"), F.lit(False).alias("random")))).alias("s")).select("s.*")


def train_markov(samples: DataFrame, *, smoothing: float = 0.5) -> list[float]:
    """The log-likelihood ratio of random to ordinary for each pair of ASCII characters, at 128 * first + second.

    A bigram count for each label is all that reaches the driver: at most 2 * 128 * 128 numbers. Null texts and pairs
    beyond ASCII count nothing; without samples all ratios are 0.
    """
    pairs = samples.where("text is not null and random is not null and length(text) > 1").select("random", F.explode(F.transform(F.sequence(F.lit(1), F.length("text") - 1), lambda i: F.substr("text", i, F.lit(2)))).alias("p"))
    pairs = pairs.select("random", F.ascii("p").alias("a"), F.ascii(F.substr("p", F.lit(2), F.lit(1))).alias("b")).where("a between 1 and 127 and b between 1 and 127")
    counts: dict[bool, dict[tuple[int, int], int]] = {True: {}, False: {}}
    for r in pairs.groupBy("random", "a", "b").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["random"]][r["a"], r["b"]] = r["n"]
    alphabet = [ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]
    out = [0.0] * (128 * 128)
    for a in alphabet:
        total = {k: sum(c.get((a, b), 0) for b in alphabet) + smoothing * len(alphabet) for k, c in counts.items()}
        for b in alphabet:
            p = {k: (c.get((a, b), 0) + smoothing) / total[k] for k, c in counts.items()}
            out[128 * a + b] = math.log(p[True] / p[False])
    return out


def log_ratio(text: Column, model: list[float]) -> Column:
    """The summed log-likelihood ratio of ``text``'s character pairs. The model is one literal that is folded when the plan is made."""
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in model)), ",").cast("array<double>")
    codes = F.transform(F.split(text, ""), F.ascii)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("before"))
    step = lambda s, c: F.struct((s["sum"] + F.when(s["before"] >= 0, F.get(table, s["before"] * 128 + c)).otherwise(0.0)).alias("sum"), c.alias("before"))
    return F.aggregate(codes, start, step, lambda s: s["sum"])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def _running(values: Column, both: Callable[[Column, Column], Column]) -> Column:
    """What ``both`` gives of each element and all before it, by doubling: n log n steps for n elements, and no list is copied n times."""
    step = lambda x, k: F.when(F.size(x) > _two_to(k), F.transform(x, lambda v, i: F.when(i >= _two_to(k), both(v, F.get(x, i - _two_to(k)))).otherwise(v))).otherwise(x)
    return F.aggregate(F.sequence(F.lit(0), F.lit(30)), values, step)


def _two_to(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), k)


_FOUND = "array<struct<start:long,rank:int,end:long,value:string>>"


def _spans(text: str, pattern: str, kind: str) -> Column:
    """Matches with their places, which are sums over the lengths of all matches and of what lies between them."""
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(F.col(text), pattern, -1)
    steps = F.zip_with(matches, gaps, lambda m, g: (F.length(g) + F.length(m)).cast("long"))
    own = lambda m, end: F.struct((end - F.length(m)).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), m.alias("value"))
    found = _let(F.struct(matches.alias("m"), _running(steps, lambda a, b: a + b).alias("end")), lambda x: F.transform(x["m"], lambda m, i: own(m, F.get(x["end"], i))))
    return F.when(F.col(text).rlike(pattern), found).otherwise(F.array().cast(_FOUND))


def _free(spans: Column) -> Column:
    """Sorted spans without those of the last kind that overlap another kind's.

    A span overlaps one that starts no later if the greatest end so far lies behind its start, and one that starts later
    if the least start from there on lies before its end.
    """
    far = F.lit(1 << 40)
    base = lambda s: s["rank"] < len(KINDS) - 1
    before = lambda all_: _running(F.transform(all_, lambda s: F.when(base(s), s["end"]).otherwise(F.lit(0).cast("long"))), F.greatest)
    behind = lambda all_: F.reverse(_running(F.reverse(F.transform(all_, lambda s: F.when(base(s), s["start"]).otherwise(far))), F.least))
    keep = lambda x: F.filter(x["all"], lambda s, i: base(s) | ((F.get(x["before"], i) <= s["start"]) & (F.get(x["behind"], i) >= s["end"])))
    return _let(spans, lambda all_: _let(F.struct(all_.alias("all"), before(all_).alias("before"), behind(all_).alias("behind")), keep))


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", samples: DataFrame | None = None, margin: float = 8.0) -> DataFrame:
    """Find secrets in each document.

    Returns one row for each row of ``docs``: its id and ``spans``, an array of (start, rank, end, value) in code points,
    end exclusive, by start and then kind; ``rank`` is the kind's place in KINDS. Spans of the fixed patterns always
    stay; kind ``random`` is a token of 20 or more characters that overlaps none of those and whose log-likelihood ratio
    is above ``margin``.

    A null or empty text has no spans. Repeated rows get the same spans each. A very long text takes time and memory that
    grow with its length and, by n log n, with its number of matches. An empty table gives an empty result. Other columns
    are ignored. samples: (text, random) rows to train on instead of ``labelled_samples``.
    """
    model = train_markov(labelled_samples(docs.sparkSession) if samples is None else samples)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = rows.select("id", _spans("text", _ASSIGN, "assign").alias("assign"), _spans("text", _ACCESS, "access").alias("access"), _spans("text", _HEX, "hex").alias("hex"), _spans("text", _TOKEN, "random").alias("token"))
    named = F.filter("assign", lambda s: F.length(F.regexp_extract(s["value"], _ASSIGN, 2)) >= 6)
    likely = F.filter("token", lambda t: log_ratio(t["value"], model) > margin)
    based = found.select("id", F.concat(named, "access", "hex").alias("base"), likely.alias("token"))
    spans = F.when(F.size("token") == 0, F.array_sort("base")).otherwise(_free(F.array_sort(F.concat("base", "token"))))
    return based.select(F.col("id").alias(id_col), spans.alias("spans"))


def secret_report(found: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Counts and a digest of the fixed patterns' spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["rank"] < 3)
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1)
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    counts = [count(k).alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select(id_col, *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
