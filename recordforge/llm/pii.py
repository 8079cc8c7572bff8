"""Personal data: labelers vote on candidate spans, a label model weighs the votes, and a span classifier decides.

Base spans (those of the strict patterns) always stay. Looser patterns add candidates: written-out mail addresses, IPv6
addresses, cards with other separators and national phone numbers. Labelers of three sorts vote on every candidate: its
form (regex), lists of known values (gazetteer), and the words around it (context). Expectation-maximisation estimates
their reliabilities from all candidates; its posteriors train a logistic classifier of form and votes, which decides on
the added candidates.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordforge.llm.label_model import LabelModel, fit
from recordforge.llm.store import by_position, written
from recordforge.llm.words import tidy

#: In the order that breaks ties.
KINDS = ("email", "ip", "card", "phone")
LABELERS = ("form", "check", "gazetteer", "cue", "counter_cue", "edges")
#: Characters before a candidate in which cue words count.
REACH = 48

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")  # a run of digits is tried once, from its start
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_LOOSE = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[({]\x20?(?:at|AT|@)\x20?[\])}]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[({]\x20?(?:dot|DOT|\.)\x20?[\])}]\x20?)[A-Za-z0-9-]{1,63}){1,8}")),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:.])")),
    ("card", re.compile(r"(?<![0-9./-])[0-9]{4}([./])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9./-])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z+(./-])(?:\([0-9]{2,5}\)[\x20.-]?|00[1-9][0-9]?[\x20.-]|[0-9]{3}([.-])(?=[0-9]{3}\1[0-9]{4}(?![0-9])))[0-9]{2,4}(?:[\x20.-]?[0-9]{2,4}){1,3}(?![0-9A-Za-z./-])")),
)

#: Common top-level domains; calling codes by first digits; first digits of card schemes.
DOMAINS = frozenset("com org net edu gov mil int info io co uk de fr es it nl eu us ca au ch at be br cn in jp ru se no dk fi pl pt ie nz mx ar app dev ai biz example".split())
CODES = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "64", "65", "7", "81", "82", "86", "90", "91", "351", "353", "358", "420", "971", "972")
SCHEMES = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37", "35", "36", "38", "30", "6011", "65", "64", "62", "50", "56", "57", "58")

_CUES = {
    "email": re.compile(r"(?i)\b(e-?mail|mail|contact|write|kontakt|contacto|courriel|correo|reach|from|to)\b"),
    "ip": re.compile(r"(?i)\b(ip|host|server|address|adresse|client|login|logged|from|via)\b"),
    "card": re.compile(r"(?i)\b(card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta|pan|payment)\b"),
    "phone": re.compile(r"(?i)\b(tel|telephone|phone|call|mobile|cell|fax|telefon|téléphone|teléfono|dial|whatsapp)\b"),
}
_COUNTER = re.compile(r"(?i)\b(version|release|isbn|issn|doi|order|invoice|serial|sku|build|section|figure|table|page|rfc|id|no|nr)\b[\x20.:#]*\Z|[$€£#][\x20]*\Z")


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        x = x * 2 if k % 2 else x
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The strict patterns' spans, leftmost and non-overlapping for each kind; failing matches are dropped."""
    out = []
    last, at = 0, text.find("@")
    while at >= 0:  # the local part is the run that ends at an @, so that each run is read once
        run = at
        while run > last and (text[run - 1] in "._%+-" or text[run - 1].isascii() and text[run - 1].isalnum()):
            run -= 1
        if run < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", run, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", last)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 12 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the spans cover together, in order."""
    starts, ends = [], []
    for a, b in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _loose_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the loose patterns that overlap neither a base span nor one of an earlier loose pattern."""
    taken = [(a, b) for _, a, b in base]
    out = []
    for kind, pattern in _LOOSE:
        starts, ends = _merged(taken)
        for m in pattern.finditer(text):
            k = bisect_left(starts, m.end())  # the covered pieces before it start before the match ends
            if not k or ends[k - 1] <= m.start():
                out.append((kind, m.start(), m.end()))
                taken.append(m.span())
    return out


def _votes(text: str, kind: str, start: int, end: int) -> list[int]:
    """One vote for each of LABELERS: 1 personal, -1 not, 0 abstain."""
    span, before = text[start:end], text[max(0, start - REACH) : start]
    digits = _digits(span)
    if kind == "email":
        local, _, host = re.sub(r"(?i)\x20?[\[({]\x20?(at|@)\x20?[\])}]\x20?", "@", span).partition("@")
        labels = re.sub(r"(?i)\x20?[\[({]\x20?(dot|\.)\x20?[\])}]\x20?", ".", host).split(".")
        form = 1 if ".." not in local and local[:1] not in ".%+-" and labels[-1].isalpha() and len(labels[-1]) > 1 else -1
        check = 1 if len(local) <= 64 and all(x and len(x) <= 63 and x[0] != "-" != x[-1] for x in labels) else -1
        known = 1 if labels[-1].lower() in DOMAINS else 0
    elif kind == "ip":
        parts = span.split(".")
        form = -1 if len(parts) == 4 and any(len(p) > 1 and p[0] == "0" for p in parts) else 1
        check = 1 if len(parts) == 1 or int(parts[0].lstrip("0") or 0) > 0 else -1
        known = -1 if span.startswith(("0.", "127.", "255.")) else 0
    elif kind == "card":
        form = 1 if len(digits) in (13, 14, 15, 16, 19) else -1
        check = 1 if _luhn(digits) and len(set(digits)) > 1 else -1
        known = 1 if digits.startswith(SCHEMES) else -1
    else:
        form = 1 if re.search(r"[\x20().-]", span) else 0
        check = 1 if 9 <= len(digits) <= 15 and len(set(digits)) > 2 else -1
        known = 1 if span[0] == "+" and digits.startswith(CODES) else -1 if span[0] == "+" else 0
    left, right = text[start - 1 : start], text[end : end + 1]
    edges = -1 if (left.isalnum() or right.isalnum()) else 1 if (not left or left.isspace() or left in "<([\"':;,") else 0
    return [form, check, known, 1 if _CUES[kind].search(before) else 0, -1 if _COUNTER.search(before) else 0, edges]


def _candidates(text: str) -> list[tuple[str, int, int, bool, list[int]]]:
    base = base_spans(text)
    found = [(*s, True) for s in base] + [(*s, False) for s in _loose_spans(text, base)]
    return [(k, a, b, strict, _votes(text, k, a, b)) for k, a, b, strict in sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.list_(pa.int32()))]))
#: A text without any of these has no candidate: a digit, an @ or its spelling, or two hexadecimal groups.
_NEEDED = re.compile(r"[0-9@]|[A-Fa-f]:[A-Fa-f]|(?i:[\[({]\x20?at\x20?[\])}])")


def _texts(column: pa.Array) -> Iterator[str]:
    for lo in range(0, len(column), 256):
        for t in column.slice(lo, 256).to_pylist():
            yield t or ""


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_candidates(t) if _NEEDED.search(t) else [] for t in _texts(batch.column("text"))]
        rows = [[dict(zip(("kind", "start", "end", "base", "votes"), c, strict=True)) for c in doc] for doc in found]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, _SPANS)], names=["id", "candidates"])


@dataclass(frozen=True)
class PiiModel:
    """labelers: the reliabilities that expectation-maximisation found, by kind; weights: of the span classifier."""

    labelers: dict[str, LabelModel]
    weights: np.ndarray

    def probability(self, kind: str, base: bool, votes: list[int]) -> float:
        return float(1 / (1 + np.exp(-(_vector(kind, base, votes) @ self.weights))))


def _vector(kind: str, base: bool, votes: list[int]) -> np.ndarray:
    return np.array([1.0, *(kind == k for k in KINDS), base, *(v == 1 for v in votes), *(v == -1 for v in votes)], dtype=float)


def find_candidates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its id as ``id``, and its candidate spans with the labelers' votes."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    spans = "candidates array<struct<kind:string,start:long,end:long,base:boolean,votes:array<int>>>"
    return rows.mapInArrow(tidy(_scan), f"id {rows.schema['id'].dataType.simpleString()}, {spans}")


def fit_pii(candidates: DataFrame) -> PiiModel:
    """Estimate reliabilities and train the classifier on all candidates.

    What reaches the driver is the number of candidates for each kind and vote pattern: at most 4 * 2 * 3 ** 6 counts.
    """
    one = candidates.select(F.explode("candidates").alias("c")).select("c.kind", "c.base", "c.votes")
    counted = sorted(tuple(r) for r in one.groupBy("kind", "base", "votes").agg(F.count(F.lit(1))).collect())
    labelers, vectors, targets, sizes = {}, [], [], []
    for kind in KINDS:
        own = [r for r in counted if r[0] == kind]
        votes, counts = np.array([r[2] for r in own], dtype=np.int64).reshape(len(own), len(LABELERS)), np.array([r[3] for r in own], dtype=float)
        labelers[kind] = fit(votes, counts)
        vectors += [_vector(*r[:3]) for r in own]
        targets += list(labelers[kind].posterior(votes)) if own else []
        sizes += list(counts)
    return PiiModel(labelers, _logistic(np.array(vectors).reshape(len(targets), 5 + 1 + 2 * len(LABELERS)), np.array(targets), np.array(sizes)))


def _logistic(x: np.ndarray, y: np.ndarray, counts: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights by Newton's method on soft labels; without rows they lean on the votes as a plain majority would."""
    start = np.concatenate((np.zeros(6), np.ones(len(LABELERS)), -np.ones(len(LABELERS))))
    w = start.copy()
    for _ in range(rounds if len(y) else 0):
        p = 1 / (1 + np.exp(-(x @ w)))
        gradient = x.T @ (counts * (p - y)) + ridge * (w - start)
        step = np.linalg.solve((x.T * (counts * np.maximum(p * (1 - p), 1e-6))) @ x + ridge * np.eye(len(w)), gradient)
        w -= step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _decisions(model: PiiModel, threshold: float):
    known: dict[tuple, bool] = {}

    def keep(kind: str, base: bool, votes: list[int]) -> bool:
        key = (kind, base, *votes)
        if key not in known:
            known[key] = base or model.probability(kind, base, votes) >= threshold
        return known[key]

    return keep


def _decide_task(model: PiiModel, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = _decisions(model, threshold)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in batches:
            spans = [[{x: c[x] for x in ("kind", "start", "end", "base")} for c in doc if keep(c["kind"], c["base"], c["votes"])] for doc in batch.column("candidates").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(spans, kind)], names=["id", "spans"])

    return run


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Find personal data in each document.

    Returns one row for each row of ``docs``: its id and ``spans``, an array of (kind, start, end, base) in code points,
    end exclusive, by start and then kind. ``base`` marks spans of the strict patterns; others were added by the
    classifier, and none of those overlaps another span when it is made.

    A null or empty text has no spans. Repeated rows get the same spans each. Spans of different kinds may overlap. With
    no candidates at all the model falls back to its beliefs. A very long text is handled alone, in time and memory that
    grow with its length and its number of candidates. An empty table gives an empty result. Other columns are ignored.
    """
    candidates = written(find_candidates(docs, id_col=id_col, text_col=text_col), "pii")
    kind = candidates.schema["id"].dataType.simpleString()
    out = candidates.mapInArrow(_decide_task(fit_pii(candidates), threshold), f"id {kind}, spans array<struct<kind:string,start:long,end:long,base:boolean>>")
    return out.withColumnRenamed("id", id_col)


def pii_report(found: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Counts and a digest of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["base"])
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return found.select(id_col, *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Put ``<KIND>`` in the place of each span; spans that overlap become one, named by the first."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, length_col: str | None = None) -> DataFrame:
    """``docs`` with all spans that ``find_pii`` gives replaced in the text; other columns stay as they are.

    length_col: a column to set to the new text's length in code points. A null text stays null; a very long one is
    searched whole. Repeated rows are changed alike, and an empty table stays empty. Columns may have any names.
    """
    names, docs = docs.columns, by_position(docs)
    id_col, text_col, length_col = (c and f"c{names.index(c)}" for c in (id_col, text_col, length_col))
    model = fit_pii(find_candidates(docs, id_col=id_col, text_col=text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = _decisions(model, threshold)
        for batch in batches:
            texts = []
            for i in range(len(batch)):
                t = batch.column(text_col)[i].as_py()
                if t and _NEEDED.search(t):
                    t = redact_text(t, [c[:3] for c in _candidates(t) if keep(c[0], c[3], c[4])])
                texts.append(t)
            yield batch.set_column(batch.schema.get_field_index(text_col), pa.field(text_col, pa.string()), pa.array(texts, pa.string()))

    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType) for f in docs.schema.fields])
    out = docs.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(tidy(run), schema)
    if length_col:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out.toDF(*names)
