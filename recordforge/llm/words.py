"""Vectorised word work on Arrow text columns: no Python object is made for each word.

Texts are handled as UTF-8 bytes. A word is a run of word bytes; the tables say which bytes those are and what each is
folded to. Each word gets a 64-bit hash of its bytes, eight at a time with all bits mixed after each eight, so that equal
words have equal hashes and no pattern of repeated bytes makes different words alike.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
#: Bytes of text handled at a time; a longer text is handled alone.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _fold() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


SAME = np.arange(256, dtype=np.uint8)
#: A-Z become a-z; all else stays.
LOWER = _fold()
#: Word bytes for words between white space.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Word bytes for words of digits, letters a-z and A-Z, and all beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

#: What is kept of eight bytes where only so many are left.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
#: From this length on, what is left of a span goes through a digest of its own: numpy calls for a few bytes would be slower.
LONG = 1024


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of data[start:end] (bytes) for each span; it depends on the bytes alone, not on the place."""
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
    left = ends - starts
    out = mix((left + 1).astype(np.uint64) * BASE)
    at, live = starts, None
    for _ in range(LONG // 8):
        block = eight[at] & _FIRST[np.minimum(left, 8)]
        if live is None:
            out = mix(out ^ block)
        else:
            out[live] = mix(out[live] ^ block)
        more = np.flatnonzero(left > 8)
        if not len(more):
            return out
        live = more if live is None else live[more]
        at, left = at[more] + 8, left[more] - 8
    rest = [int.from_bytes(hashlib.blake2b(data[a : a + n].tobytes(), digest_size=8).digest(), "little") for a, n in zip(at.tolist(), left.tolist(), strict=True)]
    out[live] = mix(out[live] ^ np.array(rest, dtype=np.uint64))
    return out


def equal_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each span has the same bytes as span number ``other`` of it."""
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
    out = (left := ends - starts) == left[other]
    live = np.flatnonzero(out & (left > 0) & (other != np.arange(len(starts))))
    at, to, left = starts[live], starts[other[live]], left[live]
    for _ in range(LONG // 8):
        if not len(live):
            return out
        good = (eight[at] ^ eight[to]) & _FIRST[np.minimum(left, 8)] == 0
        out[live[~good]] = False
        more = np.flatnonzero(good & (left > 8))
        live, at, to, left = live[more], at[more] + 8, to[more] + 8, left[more] - 8
    out[live] = [bool((data[a : a + n] == data[b : b + n]).all()) for a, b, n in zip(at.tolist(), to.tolist(), left.tolist(), strict=True)]
    return out


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(task: Task) -> Task:
    """The task, after which the worker hands its free memory back: workers stay alive, and share an executor's memory with other stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return run


@dataclass
class Texts:
    """Some consecutive rows of a batch: text i is data[offsets[i]:offsets[i + 1]]; valid says which aren't null."""

    first: int
    data: np.ndarray
    offsets: np.ndarray
    valid: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[Texts]:
    """Cut a text column into runs of rows of about ``limit`` bytes; null texts are empty."""
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    filled = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(filled)
    if not n:
        return
    _, raw, data = filled.buffers()
    offsets = np.frombuffer(raw, dtype=np.int64)[filled.offset : filled.offset + n + 1]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        own = offsets[lo : hi + 1]
        yield Texts(lo, flat[own[0] : own[-1]], own - own[0], valid[lo:hi])
        lo = hi


@dataclass
class Words:
    """Words of some texts in order: text i has words first[i] to first[i + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    doc: np.ndarray


def words(texts: Texts, word: np.ndarray, fold: np.ndarray) -> Words:
    """Split texts at all bytes that aren't word bytes."""
    data, n = texts.data, len(texts.data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = word[data]
    begin, end = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    cuts = texts.offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    both = cuts[inside[cuts] & inside[cuts + 1]]
    begin[both] = end[both] = True
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end)
    first = np.searchsorted(starts, texts.offsets)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(starts, ends, span_hashes(fold[data], starts, ends), first, doc)


def windows(w: Words, k: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a text, and where each text's runs begin (one entry more than texts).

    short: a text with fewer than k words, but not none, gives one run of all its words.
    """
    count = np.diff(w.first)
    n_runs = np.maximum(count - k + 1, 0)
    if short:
        n_runs = np.where((count > 0) & (count < k), 1, n_runs)
    first = np.concatenate(([0], np.cumsum(n_runs)))
    at = np.repeat(w.first[:-1] - first[:-1], n_runs) + np.arange(first[-1])
    length = np.repeat(np.minimum(count, k), n_runs)
    out = length.astype(np.uint64) * U(0xD6E8FEB86659FD93)
    padded = np.concatenate((w.hashes, np.zeros(k, np.uint64)))
    for j in range(k):
        out = np.where(j < length, (out ^ padded[at + j]) * BASE + (out >> U(29)), out)
    return mix(out), first
