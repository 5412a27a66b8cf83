import random
import re
from html import unescape

import pytest

from siftwell.llm import html_text
from siftwell.llm.html_text import common, main_text, page_lines

SCHEMA = "page_id long, url string, html string, text string, host int"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", []),
        ("plain &lt;b&gt; text", ["plain <b> text"]),
        ("<p>a<br>b<p>c", ["a", "b", "c"]),
        ("<nav><a>Home</a></nav><article><h1>T &amp; U</h1><p>x\n  y<b>z</b></p></article><footer>f</footer>", ["T & U", "x yz"]),
        ("<script>var t='</p><p>no';</script><style>p{}</style><p title='a > b'>yes", ["yes"]),
        ("<!-- <p>no</p> --><div class='sidebar'><div>no</div>no</div><p>yes", ["yes"]),
        ("<div id=\"comments\"><p>no</div><form>no<input></form><p>yes", ["yes"]),
        ("<nav><ul><li>no</nav>yes", ["yes"]),
        ("<p>1 < 2 &#233; &nbsp;x", ["1 < 2 é x"]),
        ("<script>never closed <p>no", []),
    ],
)
def test_lines(html, want):
    assert [t for t, _ in page_lines(html)] == want


def test_common_is_a_longest_subsequence():
    a, b = list("xabcbdabz"), list("xbdcabaz")
    pairs = sorted(common(a, b))
    assert all(a[i] == b[j] for i, j in pairs) and all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:], strict=False))
    assert len(pairs) == 6


def test_common_is_longest_on_huge_pages():
    # Matching blocks take the long run first and lose the many short ones on both sides of it.
    run, rest = [f"r{k}" for k in range(30)], [f"s{k}" for k in range(2500)]
    a = ["x", *run, *(y for k, s in enumerate(rest) for y in (s, f"n{k}")), "y"]
    b = ["z", *(y for k, s in enumerate(rest) for y in (f"n{k}", s)), *run, "w"]
    pairs = sorted(common(a, b))
    assert all(a[i] == b[j] for i, j in pairs) and all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:], strict=False))
    assert len(pairs) == 2500


@pytest.mark.parametrize("table", [1, 8, 50])
def test_halved_tables_give_the_same_length(monkeypatch, table):
    rng = random.Random(7)
    for _ in range(150):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randrange(30))] for _ in range(2))
        monkeypatch.setattr(html_text, "TABLE", 10**6)
        want = len(common(a, b))
        monkeypatch.setattr(html_text, "TABLE", table)
        pairs = sorted(common(a, b))
        assert len(pairs) == want and all(a[i] == b[j] for i, j in pairs) and all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:], strict=False))


@pytest.mark.parametrize("partitions", ["1", "3", "8"])
def test_differencing_removes_shared_lines(spark, partitions):
    rows = [(k, f"http://h.example/{k:03d}.html?q={k}", f"<div>Menu</div><div>Own {k}</div><div>Our shop</div><p>Story {k}</p><div>Imprint</div>", "x", 1) for k in range(40)]
    rows += [(100, "http://alone.example/a", "<p>Menu</p><p>text</p>", None, None), (101, None, None, None, None), (None, "http://copy.example/1", "<p>same</p><p>copy</p>", None, None), (None, "http://copy.example/1", "<p>same</p><p>copy</p>", None, None)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = main_text(spark.createDataFrame(rows, SCHEMA).repartition(4))
        assert got.columns == ["page_id", "url", "text"]
        texts = sorted((r.page_id if r.page_id is not None else -1, r.text) for r in got.collect())
        assert texts == [(-1, "same copy"), (-1, "same copy"), *((k, f"Own {k} Story {k}") for k in range(40)), (100, "Menu text"), (101, "")]
        assert main_text(spark.createDataFrame([], SCHEMA)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("partitions", ["1", "3", "8"])
def test_copies_and_pages_of_much_furniture(spark, partitions):
    menu = [f"Menu {k}" for k in range(20)]
    page = lambda *own: "".join(f"<div>{x}</div>" for x in [*menu[:10], *own, *menu[10:]])
    rows = [(k, f"http://two.example/{k}", page(f"Own {k}", f"Story {k}"), "x", 1) for k in range(2)]
    want = [(k, f"Own {k} Story {k}") for k in range(2)]
    # Runs of copies of one URL path, with other pages before and after.
    paths = [(10, "a", "A")] + [(20 + k, "b", "B") for k in range(30)] + [(60, "c", "C"), *((70 + k, "d", "D") for k in range(5))]
    rows += [(k, f"http://run.example/{path}?v={k}", page(f"Own {own}", f"Story {own}"), "x", 1) for k, path, own in paths]
    want += [(k, f"Own {own} Story {own}") for k, _, own in paths]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = main_text(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
        assert sorted((r.page_id, r.text) for r in got) == sorted(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("partitions", ["1", "3", "8"])
def test_marks_decide_inside_and_outside_an_article(spark, partitions):
    quote = lambda k: "<p>Quoted</p>" if k in (5, 6, 7) else ""
    html = lambda k: f"<div>Menu</div><article><h1>T {k}</h1><div class='share'>Share this</div>{quote(k)}<p>A {k}</p></article><div>Body {k}</div><div>Imprint</div><article class='comment'><p>Nice {k}</article>"
    rows = [(k, f"http://h.example/{k:02d}", html(k), "x", 1) for k in range(12)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {k: f"T {k} {'Quoted ' if k in (5, 6, 7) else ''}A {k} Body {k}" for k in range(12)}


def test_whole_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r.text for r in main_text(pages).collect()}

    def article(html):
        body = re.search(r"<article>(.*?)</article>", html, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:h1|p|br)>", body)]
        return " ".join(b for b in blocks if b)

    assert got == {r.page_id: article(r.html) for r in pages.collect()}
