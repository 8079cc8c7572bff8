"""Collocations against counting all phrases in plain dictionaries."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from recordforge.llm import phrases
from recordforge.llm.phrases import collocations, packed, unpacked

SCHEMA = "doc_id long, text string, lang string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def whole(rows, longest, least, top):
    n, f = Counter(), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                f.update((lang or "und", *words[i : i + k]) for i in range(len(words) - k + 1))
    frequent = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    covered = {(p[0], *p[i:j]) for p, a in frequent.items() for i in range(1, len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) - 1 and f[(p[0], *p[i:j])] <= a}
    out = []
    for p, a in frequent.items():
        if p not in covered:
            cuts = [(1000 * a * n[p[0]] // (f[p[:k]] * f[(p[0], *p[k:])]), k) for k in range(2, len(p))]
            score, k = min(cuts)
            out.append((p[0], " ".join(p[1:]), a, f[p[:k]], f[(p[0], *p[k:])], n[p[0]], score))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, i + 1, *r[1:]) for i, r in enumerate(own[:top])]
    return sorted(ranked)


def made(seed, n):
    r = random.Random(seed)
    vocabulary = ["the", "The", "of", "é", "日本", "a-b", "x y", "\x00z", "w"]
    fixed = ["New York City hall", "new york city", "once upon a time", "a a a a a a", "ÀB c", "e f, g"]
    out = []
    for k in range(n):
        words = [r.choice(fixed) if r.random() < 0.3 else r.choice(vocabulary) for _ in range(r.randrange(30))]
        out.append((k, "".join(w + r.choice([" ", "  ", "\t", ", ", ". ", "\n", " ", "\r\n", " ; "]) for w in words), r.choice(["en", "de", None, "und"])))
    return out + [(None, None, "en"), (n, "", None), (n, " .,\n", "xx")]


@pytest.mark.parametrize(("longest", "least", "top"), [(5, 4, 2000), (3, 2, 7), (2, 5, 2000)])
@pytest.mark.parametrize(("chunk", "most"), [(8 << 20, 1_000_000), (500, 3)])
def test_against_whole_counts(spark, longest, least, top, chunk, most):
    rows = made(longest, 250)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as n", "2 as word", "3 as `a.b`", "4 as id").repartition(5)
    got = sorted(tuple(r) for r in collocations(df, longest, least, top, chunk=chunk, most=most).collect())
    assert got == whole(rows, longest, least, top) and got


def test_words_that_hashes_confuse(monkeypatch):
    """Hashes that take all words of a text, or words of different megabytes, for one: content tells them apart."""
    text, langs = pa.array(["b A b\nb", "a c. b", "", " ", "ä;é"]), np.array([0, 1, 0, 1, 1])

    def said():
        sequence, words, lang = phrases._distinct(text, langs)
        flat = [None if i < 0 else (int(lang[i]), words[i].decode()) for i in sequence]
        return [x for k, x in enumerate(flat) if x or (k and flat[k - 1])]

    want = [(0, "b"), (0, "a"), (0, "b"), None, (0, "b"), None, (1, "a"), (1, "c"), None, (1, "b"), None, (1, "ä"), None, (1, "é"), None]
    assert said() == want
    chunks, words = phrases.chunks, phrases.words
    monkeypatch.setattr(phrases, "chunks", lambda t: chunks(t, 1))
    assert said() == want
    monkeypatch.setattr(phrases, "words", lambda *a: (w := words(*a), setattr(w, "hashes", np.zeros_like(w.hashes)))[0])
    assert said() == want
    monkeypatch.setattr(phrases, "chunks", chunks)
    assert said() == want


def test_long_text_repeated_rows_and_empty_table(spark):
    rows = [(1, "red fox " * 60_000, "en")] + [(2, "Same row here", "en")] * 5
    got = collocations(spark.createDataFrame(rows, SCHEMA), least=5).collect()
    assert {(r["phrase"], r["a"]) for r in got} >= {("same row here", 5), ("red fox red fox red", 59_998)}
    assert collocations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_packing_of_numbers():
    for x in (np.arange(5, dtype=np.int32), np.array([], dtype=np.int64), np.frombuffer(b"ab:c", np.uint8)):
        assert unpacked(packed(x)).tolist() == x.tolist() and unpacked(packed(x)).dtype == x.dtype
