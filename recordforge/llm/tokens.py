"""Fast exact tokenisation: texts are cut where the tokenizer itself cuts them, and each unit is encoded once per worker.

A byte-level BPE never merges across the units of its splitting pattern, and a sentence-piece BPE never merges across a
place that no piece spans. So a text's ids are its units' ids in a row, and a unit that was met before needs only a
lookup. Where a tokenizer file or a text doesn't fit these rules, the library encodes the whole text.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa

from recordforge.llm.words import equal_spans, span_hashes

#: Units that a worker remembers; then it starts afresh.
MEMORY = 600_000
#: Characters that are cut and looked up at a time; a longer text is handled alone.
CHUNK = 1 << 19

_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_classes: list[np.ndarray] = []


def _class_of() -> np.ndarray:
    if not _classes:
        t = np.full(0x110000, _OTHER, dtype=np.uint8)
        for c in range(0x110000):
            k = unicodedata.category(chr(c))[0]
            if k in "LN":
                t[c] = _LETTER if k == "L" else _NUMBER
        t[_WHITE] = _SPACE
        _classes.append(t)
    return _classes[0]


def byte_bpe_starts(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the units of ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` start in consecutive texts."""
    n = len(codes)
    if not n:
        return np.empty(0, np.int64)
    kind = _class_of()[codes]
    text_start = np.zeros(n + 1, dtype=bool)
    text_start[offsets] = True
    cut = text_start[:n].copy()
    cut[1:] |= kind[1:] != kind[:-1]
    start = np.flatnonzero(cut)
    end = np.append(start[1:], n)
    out = cut
    followed = np.append(~text_start[start[1:]], False)  # by a run of the same text

    white = (kind[start] == _SPACE) & followed
    last = end[white] - 1
    joins = codes[last] == 32
    out[last] = True
    out[end[white][joins]] = False
    joined = np.zeros(n + 1, dtype=bool)
    joined[end[white][joins]] = True

    quote = followed & (codes[start] == 39) & (end - start == 1) & ~joined[start]
    quote[:-1] &= kind[start[1:]] == _LETTER
    at = np.flatnonzero(quote)
    if len(at):
        first, stop = end[at], end[at + 1]
        one = codes[first]
        two = np.where(stop - first > 1, codes[np.minimum(first + 1, n - 1)], 0)
        pair = lambda s: (one == ord(s[0])) & (two == ord(s[1]))
        took = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, np.where(pair("re") | pair("ve") | pair("ll"), 2, 0))
        first, stop, took = first[took > 0], stop[took > 0], took[took > 0]
        out[first] = False
        rest = first + took < stop
        out[(first + took)[rest]] = True
    return np.flatnonzero(out)


def piece_starts(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units start that begin with a run of spaces or are a line break, in consecutive texts."""
    n = len(codes)
    if not n:
        return np.empty(0, np.int64)
    space, line = codes == 32, codes == 10
    out = line.copy()
    out[1:] |= (space[1:] & ~space[:-1]) | line[:-1]
    out[offsets[offsets < n]] = True
    return np.flatnonzero(out)


class Units:
    """Encodes texts unit by unit. ``encode`` gives the ids of distinct units; ``starts`` cuts texts into units."""

    def __init__(self, starts: Callable[[np.ndarray, np.ndarray], np.ndarray], encode: Callable[[list[str]], list[list[int]]], memory: int = MEMORY) -> None:
        self.starts, self.encode, self.memory = starts, encode, memory
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0
        self.first, self.count = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def _add(self, keys: list[str], found: list[list[int]]) -> None:
        for key, ids in zip(keys, found, strict=True):
            slot = len(self.slots)
            if slot == len(self.first):
                self.first, self.count = (np.concatenate((x, np.empty_like(x))) for x in (self.first, self.count))
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate((self.ids, np.empty_like(self.ids)))
            self.ids[self.used : self.used + len(ids)] = ids
            self.slots[key], self.first[slot], self.count[slot] = slot, self.used, len(ids)
            self.used += len(ids)

    def _look_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The slots of all units, and each text's first unit (one entry more than texts)."""
        joined = "".join(texts)
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        starts = self.starts(codes, offsets)
        ends = np.append(starts[1:], len(codes)) if len(starts) else starts
        raw = codes.view(np.uint8)
        _, at, inverse = np.unique(span_hashes(raw, 4 * starts, 4 * ends), return_index=True, return_inverse=True)
        if equal_spans(raw, 4 * starts, 4 * ends, at[inverse]).all():
            keys = [joined[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        else:  # two units with one hash
            place: dict[str, int] = {}
            inverse = np.array([place.setdefault(joined[a:b], len(place)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
            keys = list(place)
        if len(self.slots) > self.memory:
            self._forget()
        new = [key for key in keys if key not in self.slots]
        if new:
            self._add(new, self.encode(new))
        slots = np.array([self.slots[key] for key in keys], dtype=np.int64)
        return slots[inverse], np.searchsorted(starts, offsets)

    def counts(self, texts: list[str]) -> np.ndarray:
        slots, first = self._look_up(texts)
        return np.diff(np.concatenate(([0], np.cumsum(self.count[slots])))[first])

    def all_ids(self, texts: list[str]) -> list[np.ndarray]:
        slots, first = self._look_up(texts)
        count = self.count[slots]
        total = np.concatenate(([0], np.cumsum(count)))
        ids = self.ids[np.repeat(self.first[slots] - total[:-1], count) + np.arange(total[-1])]
        return [ids[a:b] for a, b in zip(total[first[:-1]], total[first[1:]], strict=True)]


class Encoder:
    """A tokenizer file: ``.json`` for tokenizers, ``.model`` for sentencepiece. No special tokens are added."""

    def __init__(self, name: str, data: bytes) -> None:
        self.units, self.odd = None, lambda text: False
        if name.endswith(".json"):
            self._of_json(data)
        elif name.endswith(".model"):
            self._of_model(data)
        else:
            raise ValueError(f"{name}: neither .json nor .model")

    def _of_json(self, data: bytes) -> None:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_str(data.decode())
        whole.no_truncation()
        whole.no_padding()
        self.whole = lambda texts: [x.ids for x in whole.encode_batch(texts, add_special_tokens=False)]
        spec = json.loads(data)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        if not plain or spec.get("normalizer") or model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges"):
            return
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in printable)}
        added = [t["content"] for t in spec.get("added_tokens", [])]
        vocab = {t: i for t, i in model["vocab"].items() if t not in added}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ranks = [vocab.get(a + b, -1) for a, b in merges]
        if ranks != sorted(set(ranks)) or len(ranks) + 256 != len(vocab) or any(c not in byte_of for t in vocab for c in t):
            return  # ids aren't in the order of merges
        import tiktoken

        core = tiktoken.Encoding("units", pat_str=r"(?s).+", mergeable_ranks={bytes(byte_of[c] for c in t): i for t, i in vocab.items()}, special_tokens={})
        self.odd = lambda text: any(t in text for t in added)
        self.units = Units(byte_bpe_starts, lambda units: [core.encode_ordinary(u) for u in units])

    def _of_model(self, data: bytes) -> None:
        import sentencepiece

        whole = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.whole = lambda texts: whole.encode(texts, num_threads=1)
        pieces = [whole.id_to_piece(i) for i in range(whole.get_piece_size())]
        byte_fallback = sum(whole.is_byte(i) for i in range(len(pieces))) == 256
        apart = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        probe = "  ﬁ ①\t x\n\n y  Å "
        line = whole.encode("\n")
        if not byte_fallback or not apart or whole.decode(whole.encode(probe)) != probe or len(line) != 2:
            return

        def encode(units: list[str]) -> list[list[int]]:
            return [x[len(line) :] for x in whole.encode(["\n" + u for u in units], num_threads=1)]

        self.odd = lambda text: "▁" in text or "\0" in text
        self.prefix = " "
        self.units = Units(piece_starts, encode)

    prefix = ""

    def _split(self, texts: list[str]) -> Iterator[tuple[list[int], bool]]:
        """Runs of texts for one call: their numbers, and whether the library must encode them whole."""
        run, size = [], 0
        for i, t in enumerate(texts):
            if self.units is None or self.odd(t):
                yield [i], True
                continue
            if run and size + len(t) > CHUNK:
                yield run, False
                run, size = [], 0
            run.append(i)
            size += len(t)
        if run:
            yield run, False

    def _prepared(self, t: str) -> str:
        return self.prefix + t if t else t

    def counts(self, texts: list[str]) -> np.ndarray:
        """How many ids each text has."""
        out = np.zeros(len(texts), dtype=np.int64)
        for run, alone in self._split(texts):
            own = [texts[i] for i in run]
            out[run] = [len(x) for x in self.whole(own)] if alone else self.units.counts([self._prepared(t) for t in own])
        return out

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        for run, alone in self._split(texts):
            own = [texts[i] for i in run]
            found = [np.array(x, dtype=np.uint32) for x in self.whole(own)] if alone else self.units.all_ids([self._prepared(t) for t in own])
            for i, x in zip(run, found, strict=True):
                out[i] = x
        return out


_encoders: dict[bytes, Encoder] = {}


def encoder(name: str, data: bytes, digest: bytes) -> Encoder:
    """This worker's encoder for a tokenizer file; it keeps the units it has met."""
    if digest not in _encoders:
        _encoders.clear()
        _encoders[digest] = Encoder(name, data)
    return _encoders[digest]


def read_tokenizer(path: str) -> tuple[str, bytes]:
    """Name and bytes of a tokenizer file, to be sent to the tasks: a file of a few MB, whatever the input's size."""
    p = Path(path)
    return p.name, p.read_bytes()


def text_runs(column: pa.Array, rows: int = 256) -> Iterator[tuple[int, list[str]]]:
    """Some rows' texts at a time, with the first row's number; null is empty."""
    for lo in range(0, len(column), rows):
        yield lo, [t or "" for t in column.slice(lo, rows).to_pylist()]
