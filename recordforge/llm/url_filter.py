"""URL filters with DataFrame functions only: rules, then a list behind a blocked Bloom filter and an exact join.

Each listed canonical URL sets 8 bits in one block of 256. A URL's keys are looked up in the filter first; only those
that pass go on to a hash join with the list itself, which removes false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordforge.llm.store import written

PROBES, WORDS, BITS_PER_URL = 8, 4, 16
#: A filter of up to so many blocks (40 bytes each) goes to all tasks; a larger one is joined by a shuffle of the keys.
SENT_BLOCKS = 1 << 18

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z folded) and path of a URL; both empty for null and for a text without ``://``."""
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, _URL, 1), _UPPER, _LOWER), F.regexp_extract(text, _URL, 2)


def canonical(host: Column, path: Column) -> Column:
    """A listed URL's key: host and path, where an empty path is the root."""
    return F.concat(host, F.when(path == "", "/").otherwise(path))


def lookup_keys(host: Column, path: Column, most: int) -> Column:
    """Keys under which a URL can be listed: its host or a parent domain of at most ``most`` labels, with its own path or the root."""
    labels = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - (most - 1)), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    both = F.flatten(F.transform(hosts, lambda h: F.array(F.concat(h, F.lit("/")), canonical(h, path))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(both))


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")


def _probes(key: Column) -> list[Column]:
    """Bits of a key within its block, 0 to 255."""
    h = F.xxhash64(key, F.lit(1))
    return [F.shiftrightunsigned(h, 8 * k).bitwiseAND(F.lit(255)).cast("int") for k in range(PROBES)]


def build_filter(keys: DataFrame, n_blocks: int) -> DataFrame:
    """The filter as a table (block, w0 to w3) of the blocks that have bits; ``keys`` has a column ``key``."""
    bits = keys.select(_block(F.col("key"), n_blocks).alias("block"), F.explode(F.array(*_probes(F.col("key")))).alias("bit"))
    word = lambda w: F.bit_or(F.when(F.col("bit").between(64 * w, 64 * w + 63), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit") % 64)).otherwise(F.lit(0).cast("long"))).alias(f"w{w}")
    return bits.groupBy("block").agg(*(word(w) for w in range(WORDS)))


def _all_set(key: Column, word_of) -> Column:
    out = F.lit(True)
    for p in _probes(key):
        out = out & (F.call_function("shiftrightunsigned", word_of(F.floor(p / 64).cast("int")), p % 64).bitwiseAND(F.lit(1)) == 1)
    return out


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], *, id_col: str = "page_id", url_col: str = "url", listed_col: str = "url", sent_blocks: int = SENT_BLOCKS) -> DataFrame:
    """Judge each page's URL.

    rules: (verdict, host, path); a rule fits its host and all subdomains if the URL's path starts with the rule's path,
    and the longest that fits decides. Other URLs are blocked if they, a parent domain's same path or the root of their
    host or of a parent domain are in ``listed``, else allowed. Returns one row for each row of ``pages``: its id,
    ``host``, ``path``, ``rule`` (host and path of the rule, or null) and ``verdict``.

    A null URL or one without ``://`` has neither host nor path; no rule and no listed URL fits it. Repeated and null
    listed URLs count once and not at all; an empty list blocks nothing. Repeated pages each get a row. A very long URL is
    handled whole; of a host's parents only those are looked up that have no more labels than the longest listed host. An
    empty table gives an empty result. Other columns are ignored. Keys that the filter clears aren't shuffled.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule = verdict = F.lit(None).cast("string")
    for said, of, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == of) | F.col("host").endswith(f".{of}")) & F.col("path").startswith(start)
        rule, verdict = F.when(fits, F.lit(of + start)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    rows = rows.withColumns({"rule": rule, "ruled": verdict})

    listed_host, listed_path = host_and_path(F.col(listed_col).cast("string"))
    keys = written(listed.select(listed_host.alias("h"), listed_path.alias("p")).where("h <> ''").select(canonical(F.col("h"), F.col("p")).alias("key")).distinct(), "listed")
    n, labels = keys.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(F.split(F.substring_index("key", "/", 1), r"\."))), F.lit(1))).first()
    n_blocks = max(1, -(-n * BITS_PER_URL // (64 * WORDS)))
    bloom = build_filter(keys, n_blocks)
    out_cols = (F.col("id").alias(id_col), "host", "path", "rule")
    tried = rows.where("ruled is null")
    looked = tried.select("host", "path", F.explode(lookup_keys(F.col("host"), F.col("path"), labels)).alias("key")).withColumn("block", _block(F.col("key"), n_blocks))
    passes = (F.col("block") == F.col("own")) & _all_set(F.col("key"), lambda w: F.get(F.array(*(f"w{k}" for k in range(WORDS))), w))
    known = bloom.withColumnRenamed("block", "own")
    possible = looked.join(F.broadcast(known) if n_blocks <= sent_blocks else known, passes, "left_semi").drop("block")
    blocked = possible.join(keys, "key", "left_semi").select("host", "path").distinct().withColumn("hit", F.lit(True))
    judged = tried.join(blocked, ["host", "path"], "left").select(*out_cols, F.when(F.col("hit"), "block").otherwise("allow").alias("verdict"))
    return rows.where("ruled is not null").select(*out_cols, F.col("ruled").alias("verdict")).unionByName(judged)
