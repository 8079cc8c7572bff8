"""Document quality by weak supervision: rules vote or abstain, a label model weighs them, and its posterior decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordforge.llm.label_model import LabelModel, fit
from recordforge.llm.store import by_position, written
from recordforge.llm.words import BASE, LOWER, NOT_SPACE, SAME, Texts, U, chunks, mix, span_hashes, tidy, windows, words

REPEAT_WORDS = 8
#: Common function words of English, German, French and Spanish.
FUNCTION_WORDS = (
    "the of and to in is that it was for on are with as at be this have from or by "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als "
    "le la les de des et un une du en que qui dans pour pas sur au par est il "
    "el los las y que del se con una su por al lo como para más o"
).split()

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_shouts", "n_bars", "n_function_words", "n_distinct_words", "n_stutters")


def _count(flags: np.ndarray, texts: Texts) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[texts.offsets])


def _distinct(keys: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """How many different keys each text has."""
    _, at = np.unique(mix(keys + doc.astype(np.uint64) * BASE), return_index=True)
    return np.bincount(doc[at], minlength=n)


def _again(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """How many spans of each text are equal to an earlier one; spans with one hash are compared byte by byte."""
    keys = span_hashes(data, starts, ends)
    order = np.lexsort((keys, doc))
    same = np.flatnonzero((keys[order[1:]] == keys[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]]))
    some = order[np.unique(np.concatenate((same, same + 1)))]
    seen: set[tuple[int, bytes]] = set()
    out = np.zeros(n, dtype=np.int64)
    for d, a, b in zip(doc[some].tolist(), starts[some].tolist(), ends[some].tolist(), strict=True):
        line = (d, data[a:b].tobytes())
        out[d] += line in seen
        seen.add(line)
    return out


def _features(texts: Texts, common: np.ndarray) -> dict[str, np.ndarray]:
    data, n = texts.data, len(texts)
    w = words(texts, NOT_SPACE, SAME)
    inside = NOT_SPACE[data]
    out = {"n_words": np.diff(w.first), "word_chars": _count(inside & ((data & 0xC0) != 0x80), texts)}
    out["n_symbols"] = _count(np.isin(data, np.frombuffer(b"#*$%&|<>", np.uint8)), texts)

    newline = data == 10
    cuts = np.unique(np.concatenate((texts.offsets[:-1], np.flatnonzero(newline) + 1)))
    starts = cuts[cuts < len(data)]
    ends = np.append(starts[1:], len(data))
    ends = np.where((ends > starts) & newline[ends - 1], ends - 1, ends) if len(starts) else ends
    seen = np.concatenate(([0], np.cumsum(inside, dtype=np.int64)))
    full = seen[ends] > seen[starts]
    starts, ends = starts[full], ends[full]
    doc = np.searchsorted(texts.offsets, starts, side="right") - 1
    out["n_lines"] = np.bincount(doc, minlength=n)
    out["n_dup_lines"] = _again(data, starts, ends, doc, n)

    runs, first = windows(w, REPEAT_WORDS, short=False)
    of = np.repeat(np.arange(n), np.diff(first))
    _, inverse, counts = np.unique(mix(runs + of.astype(np.uint64) * BASE), return_inverse=True, return_counts=True)
    again = np.flatnonzero(counts[inverse] > 1)
    at = w.first[of[again]] + again - first[of[again]]
    cover = np.zeros(len(w.starts) + 1, dtype=np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + REPEAT_WORDS, -1)
    out["n_repeat_words"] = np.bincount(w.doc[np.cumsum(cover)[:-1] > 0], minlength=n)

    upper = (data >= 65) & (data <= 90)
    out["n_letters"] = _count(upper | ((data >= 97) & (data <= 122)), texts)
    out["n_upper"] = _count(upper, texts)
    shout = data == 33
    shout[:-1] &= shout[1:]
    shout[-1:] = False
    out["n_shouts"] = _count(shout, texts)
    out["n_bars"] = _count(data == 124, texts)
    folded = words(texts, NOT_SPACE, LOWER).hashes
    out["n_function_words"] = np.bincount(w.doc[np.isin(folded, common)], minlength=n)
    out["n_distinct_words"] = _distinct(folded, w.doc, n)
    again = np.flatnonzero((folded[1:] == folded[:-1]) & (w.doc[1:] == w.doc[:-1]))
    out["n_stutters"] = np.bincount(w.doc[again], minlength=n)
    return out


def _feature_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    vocabulary = next(chunks(pa.array([" ".join(FUNCTION_WORDS)])))
    common = np.unique(words(vocabulary, NOT_SPACE, LOWER).hashes)
    for batch in batches:
        for texts in chunks(batch.column("text")):
            found = _features(texts, common)
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(texts.first, len(texts)), *(pa.array(found[x].astype(np.int64)) for x in FEATURES)], names=["id", *FEATURES])


def quality_features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts over each text: one row for each row of ``docs``, with its id as ``id``. A null text has 0 of all."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(_feature_task), f"id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"{x} long" for x in FEATURES))


def _vote(bad: Column, good: Column | None = None) -> Column:
    """Against, for, or neither; a share that has no value makes a rule abstain."""
    out = F.when(bad, -1)
    return (out if good is None else out.when(good, 1)).otherwise(0)


def rule_votes() -> dict[str, Column]:
    """Each rule's vote on a row of ``quality_features``: 1 for, -1 against, 0 abstain."""
    n = F.nullif(F.col("n_words"), F.lit(0))
    share = lambda x, of=n: F.col(x) / of
    mean, symbols, repeats, lines = share("word_chars"), share("n_symbols"), share("n_repeat_words"), F.col("n_dup_lines") / F.nullif(F.col("n_lines"), F.lit(0))
    upper, shouts, bars = share("n_upper", F.nullif(F.col("n_letters"), F.lit(0))), share("n_shouts"), share("n_bars")
    common, distinct = share("n_function_words"), share("n_distinct_words")
    return {
        "length": _vote(F.col("n_words") < 20, F.col("n_words") >= 50),
        "word_length": _vote(~mean.between(2, 15), mean.between(3, 10)),
        "symbols": _vote(symbols >= 0.25),
        "repeats": _vote(repeats >= 0.3),
        "lines": _vote(lines >= 0.4),
        "upper": _vote(upper >= 0.35),
        "shouts": _vote(shouts >= 0.15),
        "table": _vote(bars >= 0.2),
        "function_words": _vote(common <= 0.01, common >= 0.05),
        "stutters": _vote(share("n_stutters") >= 0.2),
        "variety": _vote(distinct <= 0.1, distinct >= 0.4),
    }


RULES = ("length", "word_length", "symbols", "repeats", "lines", "upper", "shouts", "table", "function_words", "stutters", "variety")


def fit_quality(features: DataFrame) -> LabelModel:
    """Estimate the rules' accuracies from the vote patterns of all rows; at most 3 ** 11 pattern counts reach the driver."""
    votes = rule_votes()
    counted = features.select(*(votes[r].alias(r) for r in RULES)).groupBy(*RULES).agg(F.count(F.lit(1)).alias("n")).collect()
    counted.sort()
    return fit(np.array([r[:-1] for r in counted], dtype=np.int64).reshape(len(counted), len(RULES)), np.array([r[-1] for r in counted], dtype=float))


def score_quality(features: DataFrame, model: LabelModel, *, threshold: float = 0.5) -> DataFrame:
    """Add ``base_failed``, ``quality`` (the posterior probability) and ``kept`` to features."""
    bias, add = model.weights()
    votes = rule_votes()
    logit = F.lit(bias)
    for j, r in enumerate(RULES):
        logit = logit + F.when(votes[r] == 1, F.lit(float(add[j, 2]))).when(votes[r] == -1, F.lit(float(add[j, 0]))).otherwise(F.lit(float(add[j, 1])))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    quality = 1 / (1 + F.exp(-logit))
    return features.withColumns({"base_failed": failed, "quality": quality}).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Judge each document's quality.

    Returns one row for each row of ``docs``: its id, the counts of ``quality_features``, ``base_failed`` (under 20 words,
    or over 30 % of words inside repeated 8-word runs), ``quality`` and ``kept``.

    A null or empty text has no words: it fails the base rules. Repeated rows are judged alike. Ratios of a text without
    words, lines or letters make their rules abstain. A very long text is handled alone and whole, in time and memory that
    grow with its length. An empty table gives an empty result. Other columns are ignored.
    """
    features = written(quality_features(docs, id_col=id_col, text_col=text_col), "quality")
    return score_quality(features, fit_quality(features), threshold=threshold).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns.

    The counts are made a second time beside the rows instead of joining on ids, which may repeat or be null. A null or
    empty text goes; a very long one is counted whole, alone; repeated rows stay or go together; an empty table stays empty.
    Columns may have any names.
    """
    names, docs = docs.columns, by_position(docs)
    id_col, text_col = (f"c{names.index(c)}" for c in (id_col, text_col))
    model = fit_quality(quality_features(docs, id_col=id_col, text_col=text_col))
    schema = docs.schema
    name = "quality_features"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([pa.nulls(len(batch), pa.int64()), batch.column(text_col).cast(pa.string())], names=["id", "text"])
            done = 0
            for found in _feature_task(iter([texts])):
                part = pa.StructArray.from_arrays([found.column(x) for x in FEATURES], names=list(FEATURES))
                own = batch.slice(done, len(found))
                done += len(found)
                yield pa.RecordBatch.from_arrays([*own.columns, part], names=[*own.schema.names, name])

    kind = ", ".join(f"{x} long" for x in FEATURES)
    with_features = docs.mapInArrow(tidy(run), T.StructType([*schema.fields, T.StructField(name, T.StructType.fromDDL(kind))]))
    features = with_features.select(F.struct(*docs.columns).alias("row"), F.col(f"{name}.*"))
    return score_quality(features, model, threshold=threshold).where("kept").select("row.*").toDF(*names)
