"""Main text of web pages: differencing with the nearest page of the host, and what markup says as a check of it.

A page is read into blocks, each with the elements that it stands in. Menus, headers, footers, forms and the like are
told by their elements, roles and class names, and go. All other blocks of all pages are held against those of the nearest
pages: the distinct pages of a host are put in the order of their paths, so that a page's neighbours are those whose URLs
are nearest; the blocks of each two neighbours are aligned by a longest common subsequence of whole texts, and what a page
shares with its neighbours is the host's template and goes. Then, if a page marks its article, that is checked: what stands
in it stays, as articles are copied too, and what doesn't goes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import sha256
from html import unescape
from zlib import compress, decompress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordforge.llm.merkle import Shape, indexed
from recordforge.llm.store import join_hot, written
from recordforge.llm.url_filter import host_and_path
from recordforge.llm.words import tidy

#: Fixed values, of HTML: elements whose content isn't text, elements without content, and elements within a line of text.
RAW = frozenset("script style noscript template iframe svg math object embed canvas audio video textarea title xmp noembed noframes plaintext".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that another start tag of the same kind ends, and within which element only.
ENDED_BY = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr", "td": "td th", "th": "td th", "option": "option"}
#: Elements, roles and words in class names or ids of what isn't main text.
FURNITURE = frozenset("nav header footer aside form menu dialog select button fieldset head".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog".split())
FURNITURE_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disclaimer disqus footer gdpr header masthead menu modal "
    "nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion related respond share sharing sidebar skip social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
ARTICLE = frozenset("article main".split())
ARTICLE_ROLES = frozenset("main article".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"[a-z0-9]+")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in RAW}

OPEN, MAIN, OTHER = 0, 1, 2


def _attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(rest)} if rest else {}


def _names(attributes: dict[str, str]) -> list[str]:
    """The words of an element's class names and id."""
    return _WORDS.findall(f"{attributes.get('class', '')} {attributes.get('id', '')}".lower())


def _furniture(tag: str, attributes: dict[str, str]) -> bool:
    if tag in FURNITURE or attributes.get("role", "").lower() in FURNITURE_ROLES:
        return True
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I):
        return True
    return tag not in ("html", "body") and not FURNITURE_WORDS.isdisjoint(_names(attributes))


def blocks(html: str) -> list[tuple[int, str]]:
    """A page's blocks in order, each with its kind: MAIN (in an article), OTHER (in furniture, or not text) or OPEN.

    A heading of an article's own header is MAIN. What is in furniture within an article is OTHER.
    """
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int, bool]] = []  # element, kind of what is in it, whether it is an article's header
    standing: Counter[str] = Counter()  # how many elements of a name are on the stack
    said: list[str] = []
    kind, header = OPEN, False

    def pop(n: int = 1) -> None:
        for _ in range(n):
            standing[stack.pop()[0]] -= 1

    def close() -> None:
        text = " ".join(unescape("".join(said)).split()) if said else ""
        said.clear()
        if text:
            out.append((MAIN if header and any(standing[h] for h in _HEADINGS) else kind, text))

    at, size = 0, len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        if not m:
            said.append(html[at:])
            break
        if m.start() > at:
            said.append(html[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            said.append(m["cdata"].replace("&", "&amp;"))
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if tag in INLINE:
            if tag == "br":
                said.append(" ")
                continue
            # One that is furniture stands like a block, as do those of its kind within it; the others leave no trace.
            if not standing[tag] and (m["end"] or not _furniture(tag, _attributes(m["rest"]))):
                continue
        close()
        if m["end"]:
            while standing[tag]:
                found = stack[-1][0] == tag
                pop()
                if found:
                    break
        elif tag in RAW:
            end = _RAW_END[tag].search(html, at)
            at = end.end() if end else size
            continue
        elif tag not in VOID:
            ends = ENDED_BY.get(tag, "").split()
            if ends and stack and stack[-1][0] in ends or tag not in INLINE and stack and stack[-1][0] == "p":
                pop()
            if tag == "body" and standing["head"]:
                pop(len(stack) - next(k for k, e in enumerate(stack) if e[0] == "head"))
            inner, in_header = (stack[-1][1], stack[-1][2]) if stack else (OPEN, False)
            attributes = _attributes(m["rest"])
            if _furniture(tag, attributes):
                in_header = inner == MAIN and (tag == "header" or "header" in _names(attributes))
                inner = OTHER
            elif inner == OPEN and (tag in ARTICLE or attributes.get("role", "").lower() in ARTICLE_ROLES):
                inner = MAIN
            stack.append((tag, inner, in_header))
            standing[tag] += 1
        kind, header = (stack[-1][1], stack[-1][2]) if stack else (OPEN, False)
    close()
    return out


def common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of a longest common subsequence of two arrays of numbers, in each of them.

    Equal ends are taken first, and numbers that only one has are left out. Rows of the table of lengths are the bits of
    one integer; a table of over TABLE bits is halved, as Hirschberg does, so that memory stays bounded.
    """
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    ia, ib = np.arange(lo, len(a) - hi), np.arange(lo, len(b) - hi)
    ia, ib = ia[np.isin(a[ia], b[ib])], ib[np.isin(b[ib], a[ia])]
    pairs = _lcs(a[ia].tolist(), b[ib].tolist())
    x, y = (np.array([p[k] for p in pairs], dtype=np.int64) for k in (0, 1))
    head, tail = np.arange(lo), np.arange(hi)
    return np.concatenate((head, ia[x], len(a) - hi + tail)), np.concatenate((head, ib[y], len(b) - hi + tail))


#: Bits of one table of lengths.
TABLE = 1 << 28


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """For each prefix of ``a``, the integer whose bit j is 0 where a common subsequence with b[:j + 1] is longer than with b[:j]."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    yield v
    for x in a:
        m = where.get(x, 0)
        u = v & m
        v = (v + u | v - u) & full
        yield v


def _lcs(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    if not a or not b:
        return []
    if len(a) * len(b) > TABLE and len(a) > 1:
        half = len(a) // 2
        front, back = (_lengths(_last(_rows(x, y)), len(b)) for x, y in ((a[:half], b), (a[half:][::-1], b[::-1])))
        cut = int(np.argmax(front + back[::-1]))
        return _lcs(a[:half], b[:cut]) + [(x + half, y + cut) for x, y in _lcs(a[half:], b[cut:])]
    rows = list(_rows(a, b))
    out, i, j = [], len(a), len(b) - 1
    while i and j >= 0:
        if rows[i] >> j & 1:
            j -= 1
        elif not rows[i - 1] >> j & 1:
            i -= 1
        else:
            out.append((i - 1, j))
            i, j = i - 1, j - 1
    return out[::-1]


def _last(rows: Iterator[int]) -> int:
    v = 0
    for v in rows:
        pass
    return v


def _lengths(row: int, size: int) -> np.ndarray:
    """Lengths of longest common subsequences with b[:0], b[:1] and so on."""
    bits = np.unpackbits(np.frombuffer(row.to_bytes(size // 8 + 1, "little"), np.uint8), bitorder="little")[:size]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _read(whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (page, url, host, path, html) read: all blocks that are no furniture, and which of them stand in a marked article.

    Either whole pages, with packed text, or what differencing needs: the host, with those that mark an article apart, path,
    digest and lines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 64  # a few pages at a time, as one may be long
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                found = [[x for x in blocks(html or "") if x[0] != OTHER] for html in part.column(4).to_pylist()]
                main = [[k == MAIN for k, _ in x] for x in found]
                trees = [("article " if any(m) else "") + (host or "") for m, host in zip(main, part.column(2).to_pylist(), strict=True)]
                texts = ["\n".join(t for _, t in x).encode() for x in found]
                digest = pa.array([sha256(tree.encode() + b"\n" + t).hexdigest() if x else None for x, tree, t in zip(found, trees, texts, strict=True)], pa.string())
                if whole:
                    packed = pa.array([compress(t) for t in texts], pa.binary())
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), packed, pa.array(main, pa.list_(pa.bool_())), digest], names=["page", "url", "packed", "main", "digest"])
                else:
                    lines = pa.array([[t for _, t in x] for x in found], pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays([pa.array(trees, pa.string()), part.column(3), digest, lines], names=["host", "path", "digest", "lines"])

    return run


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours (digest, own, next_digest, next) as one row for each of the two: which of its blocks the other shares.

    Two pages one of which has nothing of its own say nothing of a template: one is an extract or a copy of the other.
    """
    for batch in batches:
        digests, shared = [], []
        for first, own, second, other in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3), strict=True):
            a, b = (x.values.to_numpy(zero_copy_only=False) for x in (own, other))
            x, y = common(a, b)
            if len(x) < min(len(a), len(b)):
                digests += [first, second]
                shared += [x.tolist(), y.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(shared, pa.list_(pa.int32()))], names=["digest", "shared"])


def templates(pages: DataFrame) -> DataFrame:
    """Of pages (host, path, digest, own), with hashes of their blocks, which blocks each distinct one loses: (digest, gone), null if none.

    The distinct pages of a host are numbered in the order of their first paths; a page is held against the one before and
    the one behind it. A block goes if all of the two that say anything share it.
    """
    distinct = pages.groupBy("digest").agg(F.min("host").alias("tree"), F.min("path").alias("k"), F.first("own").alias("own"))
    placed = written(indexed(written(distinct.withColumn("tie", F.lit(0)), "distinct-pages"), Shape())[0].select("tree", F.col("pos").alias("place"), "digest", "own"), "page-places")
    behind = placed.select("tree", (F.col("place") - 1).alias("place"), F.col("digest").alias("next_digest"), F.col("own").alias("next"))
    pairs = placed.join(behind, ["tree", "place"]).select("digest", "own", "next_digest", "next")
    said = pairs.mapInArrow(tidy(_aligned), "digest string, shared array<int>").groupBy("digest").agg(F.collect_list("shared").alias("both"))
    gone = F.when(F.size("both") > 1, F.array_intersect(F.col("both")[0], F.col("both")[1])).otherwise(F.col("both")[0])
    return placed.select("digest").join(said.select("digest", gone.alias("gone")), "digest", "left")


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages (page, url, packed, main, gone) without the blocks that go, and how many of them differencing found to be template.

    An article that the page marks overrules what differencing says of its blocks and of those outside.
    """
    for batch in batches:
        texts, shared = [], []
        for packed, main, gone in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
            out, lines = set(gone or ()), decompress(packed).decode().split("\n") if main else []
            shared.append(len(out))
            texts.append("\n".join(t for k, t in enumerate(lines) if (main[k] if any(main) else k not in out)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(shared, pa.int64())], names=["page", "url", "text", "n_template"])


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page, url, text, n_template, n_chars) for each row: the page's main text, blocks joined by new lines; empty if there is none.

    Every page that has a block is held against its neighbours, those that mark an article against each other, as are the
    others; n_template is how many of its blocks differencing found in them.
    White space inside a block, also of ``<br>`` and references, becomes one space. A null or empty
    page has an empty text; a null URL, or one without ``://``, belongs to the host without a name. Copies of a page on a
    host count as one page, so repeated rows change nothing. Pages of one path are ordered by content. A very long page is
    read whole, in time that grows with its length. An empty table gives no rows. Other columns, whatever their names,
    have no part.
    """
    host, path = host_and_path(F.col(f"`{url_col}`").cast("string"))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page"), F.col(f"`{url_col}`").cast("string").alias("url"), host.alias("host"), path.alias("path"), F.col(f"`{html_col}`").cast("string").alias("html"))
    # Pages are read twice: their blocks' hashes are kept, but their text isn't.
    narrow = rows.mapInArrow(tidy(_read(False)), "host string, path string, digest string, lines array<string>").where("digest is not null")
    narrow = written(narrow.select("host", "path", "digest", F.transform("lines", lambda x: F.xxhash64(x)).alias("own")), "page-blocks")
    read = rows.mapInArrow(tidy(_read(True)), "page long, url string, packed binary, main array<boolean>, digest string")
    none = "none"  # of pages without blocks, which are near nothing
    said = written(templates(narrow), "page-templates").unionAll(rows.sparkSession.range(1).select(F.lit(none).alias("digest"), F.lit(None).cast("array<int>").alias("gone")))
    read, keys = read.withColumn("digest", F.coalesce("digest", F.lit(none))), narrow.select("digest")
    found = join_hot(read, said, "digest", keys).select("page", "url", "packed", "main", "gone")
    return found.mapInArrow(tidy(_rest), "page long, url string, text string, n_template long").withColumn("n_chars", F.length("text").cast("long"))
