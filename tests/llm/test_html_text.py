"""Pages' blocks, the alignment, and whole tables against differencing by plain lists."""

import random

import numpy as np
import pytest

from recordforge.llm import html_text
from recordforge.llm.html_text import MAIN, OPEN, blocks, common, main_texts


def texts(html, kind):
    return [t for k, t in blocks(html) if k == kind]


@pytest.mark.parametrize(
    ("html", "main"),
    [
        ("<nav>m</nav><article><h1>T &amp; t</h1><p><b>One<br><p>two\n\n  words&nbsp;&eacute;</article><footer>f</footer>", ["T & t", "One", "two words é"]),
        ("<article><header><h1>Head</h1><p>by me</p></header><p>x</p><footer>f</footer><aside>s</aside><p>y", ["Head", "x", "y"]),
        ('<main><div class="post ad-slot">buy</div><p>a <span class="ad">x <span>y</span> z</span> b</p><section id="comments"><p>c</p></section></main>', ["a", "b"]),
        ('<main><p title="a > b" data-id="ad">k</p><p hidden>h</p><p style="display: none">h</p><p alt="hidden class=ad">l</main>', ["k", "l"]),
        ("<article><script>if (a < b) '</p>'</script><p>x</p><style>p{}</style><!-- <p>no</p> --><![CDATA[ <raw> & ]]></article>", ["x", "<raw> &"]),
        ("<article>a<script>never closed <p>b</p>", ["a"]),
        ("<article>a &lt;p&gt; 1 < 2 &am <p>b</article", ["a <p> 1 < 2 &am", "b"]),
        ('<div role="main"><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></div><div role="navigation">n</div>', ["a", "b", "c", "d"]),
        ("<article><p>a</p></div></section></p><p>b</p></article>", ["a", "b"]),
        ("<p unclosed='x <p>lost", []),
    ],
)
def test_marked_pages(html, main):
    assert texts(html, MAIN) == main


def test_deep_and_broken_pages_take_linear_time():
    n = 50_000
    assert texts("<article>" + "<div>" * n + "<i>x</i></b></section>" * n, MAIN) == ["x"] * n
    assert texts("<article>" + "<div><i>x</i></p>" * n, MAIN) == ["x"] * n
    assert texts('<main><a "' * n, MAIN) == [] and texts("<" * n + "&" * n, OPEN) == ["<" * n + "&" * n]


def test_pages_without_marks_are_open():
    assert texts("<head><title>t</title><body><div class=menu>m</div>lead<p>one<form>f</form><div>two", OPEN) == ["lead", "one", "two"]


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("bits", [1 << 28, 20, 2])
def test_alignment_is_a_longest_common_subsequence(bits, monkeypatch):
    monkeypatch.setattr(html_text, "TABLE", bits)
    r = random.Random(bits)
    for _ in range(400):
        a, b = (np.array([r.randrange(4) for _ in range(r.randrange(14))], dtype=np.int64) for _ in range(2))
        x, y = common(a, b)
        assert len(x) == len(y) == lcs(a, b) and (a[x] == b[y]).all() and (np.diff(x) > 0).all() and (np.diff(y) > 0).all()


def test_long_pages_are_aligned_in_bounded_tables():
    a, b = np.arange(40_000), np.arange(40_000)[::-1].copy()
    b[100:30_000] = np.arange(29_900)
    x, y = common(a, b)
    assert len(x) == 29_900 and (a[x] == b[y]).all()


def page(host, path, lines):
    return f"http://{host}{path}", "".join(f"<div>{x}</div>" for x in lines)


def rows():
    """A host with a template, copies of a page, a host with one page, and a host whose pages share nothing."""
    r = random.Random(4)
    out = []
    for k in range(40):
        own = [f"story {k} line {j}" for j in range(r.randrange(1, 5))]
        out.append(page("a.example", f"/en/{k:03}", ["Home", "All news", *own[:1], "Advice of the day", *own[1:], "Contact us"]))
    out += [out[7]] * 30
    out.append(page("b.example", "/x", ["Home", "lone page"]))
    out += [page("c.example", f"/{k}", [f"only {k}", "x" * k]) for k in range(1, 5)]
    out += [("http://a.example/zz", "<nav>n</nav><article><p>Home</p><p>marked</p></article>"), (None, "<p>no url"), (None, None), ("http://a.example/none", ""), ("no scheme", "<p>odd")]
    return [(k, *x) for k, x in enumerate(out)]


def whole(table):
    """The same by lists: neighbours of the distinct pages of a host, and what a page shares with all that say something."""
    out, hosts = {}, {}
    for i, url, html in table:
        found = blocks(html or "")
        marked = [t for k, t in found if k == MAIN]
        lines = [] if marked else [t for k, t in found if k == OPEN]
        out[i] = marked
        if lines:
            host, path = (url or "").split("://", 1)[1].split("/", 1) if "://" in (url or "") else ("", "")
            hosts.setdefault(host, {}).setdefault(tuple(lines), []).append((path, i))
    for pages in hosts.values():
        order = sorted(pages, key=lambda lines: min(pages[lines])[0])
        shared = [[] for _ in order]
        for k in range(len(order) - 1):
            a, b = order[k], order[k + 1]
            common_lines = [x for x in a if x in b]
            if len(common_lines) < min(len(a), len(b)):
                shared[k].append(set(common_lines))
                shared[k + 1].append(set(common_lines))
        for lines, gone in zip(order, shared, strict=True):
            rest = [x for x in lines if not gone or not all(x in g for g in gone)]
            for _, i in pages[lines]:
                out[i] = rest
    return out


def test_templates_go_and_the_rest_stays(spark):
    table = rows()
    df = spark.createDataFrame(table, "page_id long, url string, html string").selectExpr("*", "1 as lines", "2 as `a.b`", "'x' as host", "page_id as page").repartition(5)
    got = {r["page"]: (r["url"], r["text"], r["n_chars"]) for r in main_texts(df).collect()}
    want = whole(table)
    assert got == {i: (url, "\n".join(want[i]), len("\n".join(want[i]))) for i, url, _ in table}
    assert "Home" not in got[3][1] and "story 3 line 0" in got[3][1] and got[7] == got[45] and got[70][1] == "Home\nlone page"
    assert [got[i][1] for i in (75, 76, 77, 78, 79)] == ["Home\nmarked", "no url", "", "", "odd"]


def test_repeated_rows_null_ids_and_an_empty_table(spark):
    schema = "page_id long, url string, html string"
    df = spark.createDataFrame([(None, "http://h/1", "<p>one"), (1, "http://h/1", "<p>one"), (1, "http://h/1", "<p>one"), (1, "http://h/2", "<article>" + "word " * 100_000)], schema)
    assert sorted(len(r["text"]) for r in main_texts(df).collect()) == [3, 3, 3, 499_999]
    assert main_texts(spark.createDataFrame([], schema)).collect() == []


def test_marked_pages_are_held_against_their_neighbours_too(spark):
    """Differencing finds what marked pages share; the marked article stays whole all the same, and what is outside of it goes."""
    table = [(k, f"http://m.example/{k}", f"<p>Home</p><article><p>Our news</p><p>story {k}</p></article><p>Contact</p><nav>menu</nav>") for k in range(4)]
    table += [(9, "http://m.example/9", "<p>Home</p><p>open")]
    got = {r["page"]: (r["text"], r["n_template"]) for r in main_texts(spark.createDataFrame(table, "page_id long, url string, html string")).collect()}
    assert got == {k: (f"Our news\nstory {k}", 3) for k in range(4)} | {9: ("Home\nopen", 0)}
