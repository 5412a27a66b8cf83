"""Main text of HTML pages by differencing each page against its nearest neighbours.

Pages are parsed into lines, one for each block, and each line is marked by
whether it lies in an article or main element.  Pages are then range-partitioned and sorted
by host and URL path, so that a page's nearest pages stand beside it; the lines
of neighbours are aligned by longest common subsequence, and lines that a page
shares with a neighbour are deleted.  Lines within an article stay: most of
what pages share there are quotations.  Pages with
equal lines are copies: a run of them counts as one page, compared with the
nearest page on either side that is not a copy.

A run at the border of a partition goes on or is compared beyond it in a
second pass over border runs alone, one page of two for each partition.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import shuffle_partitions, text_of

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|$)|<[!?][^>]*>?", re.S)
_SPACE = re.compile(r"\s+")
_MARK = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements whose content is text of another language, and elements that are never content.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
OUTSIDE = frozenset("head nav header footer aside form button select option label fieldset menu dialog svg canvas object audio video figcaption".split()) - {"figcaption"}
MAIN = frozenset(("article", "main"))
#: Elements that stand on the stack, because their end matters.
NESTED = OUTSIDE | MAIN | frozenset("div section ul ol dl table tbody tr td th blockquote body figure details span p".split()) - {"p", "span"}
BLOCKS = NESTED | frozenset("p h1 h2 h3 h4 h5 h6 li br hr dt dd pre address caption figcaption summary html thead tfoot".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id or role that mark furniture.
FURNITURE = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar side menu nav navbar navigation breadcrumb breadcrumbs header masthead footer cookie cookies consent notice notices alert popup modal newsletter subscribe subscription share sharing social related recommended comment comments commentlist disqus respond reply replies pagination pager toolbar search login signup complementary contentinfo".split())
TABLE = 4_000_000  # cells of a dynamic program that is held whole
_PAGE = "page_id long, url string, text string, part int, edge int"
_BORDER = "part int, edge int, host string, lines array<struct<text:string,main:boolean,shared:boolean>>"
_TEXT = "part int, edge int, text string"
_PAGE_TYPES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("part", pa.int32()), ("edge", pa.int32())])
_BORDER_TYPES = pa.schema([("part", pa.int32()), ("edge", pa.int32()), ("host", pa.string()), ("lines", pa.list_(pa.struct([("text", pa.string()), ("main", pa.bool_()), ("shared", pa.bool_())])))])
_TEXT_TYPES = pa.schema([("part", pa.int32()), ("edge", pa.int32()), ("text", pa.string())])


def page_lines(html: str) -> list[tuple[str, bool]]:
    """The visible lines of a page without furniture by its markup, and whether each lies in an article."""
    lines: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # element, is furniture, is article
    hidden = inside = 0
    held: list[str] = []
    at, raw = 0, ""

    def close() -> None:
        nonlocal held
        if held:
            text = _SPACE.sub(" ", unescape("".join(held))).strip()
            if text:
                lines.append((text, inside > 0))
            held = []

    while True:
        if raw:
            m = re.compile(rf"</{raw}[\s/>]", re.I).search(html, at)
            if not m:
                break
            at, raw = m.start(), ""
        m = _TOKEN.search(html, at)
        if not hidden:
            held.append(html[at : m.start() if m else len(html)])
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if name not in BLOCKS and name not in RAW and not (name and stack is None):
            continue
        close()
        if m[1]:
            if name in NESTED and any(s[0] == name for s in stack):
                while True:
                    top, out, main = stack.pop()
                    hidden, inside = hidden - out, inside - main
                    if top == name:
                        break
        elif name in RAW:
            raw = name if not m[3].rstrip().endswith("/") else ""
        elif name in NESTED and not m[3].rstrip().endswith("/"):
            words = {w for x in _MARK.findall(m[3]) for w in re.split(r"[^a-z]+", "".join(x).lower())} if m[3] else set()
            out = name in OUTSIDE or (name not in ("body", "main") and bool(words & FURNITURE))
            main = name in MAIN
            stack.append((name, out, main))
            hidden, inside = hidden + out, inside + main
    close()
    return lines


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of the lines of a longest common subsequence: equal ends first, then the dynamic program as far as they differ."""
    lo, pairs = 0, []
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        pairs.append((lo, lo))
        lo += 1
    end_a, end_b = len(a), len(b)
    while end_a > lo and end_b > lo and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
        pairs.append((end_a, end_b))
    known = set(a[lo:end_a]) & set(b[lo:end_b])  # other lines can't be in it
    x, y = ([i for i in range(lo, e) if s[i] in known] for s, e in ((a, end_a), (b, end_b)))
    return pairs + [(x[i], y[j]) for i, j in _longest([a[i] for i in x], [b[j] for j in y])]


def _lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` and each of the len(b) + 1 beginnings of ``b``: a row of the dynamic program as bits of one number."""
    places: dict[str, int] = {}
    for j, line in enumerate(b):
        places[line] = places.get(line, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full  # a zero where the length grows
    for line in a:
        if line in places:
            same = row & places[line]
            row = (row + same | row - same) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _longest(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence. Tables of more than TABLE cells are halved at the place where both halves' lengths add up to the most (Hirschberg)."""
    if len(a) * len(b) > TABLE and min(len(a), len(b)) > 1:
        half = len(a) // 2
        cut = int((_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
        return _longest(a[:half], b[:cut]) + [(half + i, cut + j) for i, j in _longest(a[half:], b[cut:])]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    pairs, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return pairs


class Page:
    def __init__(self, host: str, lines: list[tuple[str, bool, bool]]):
        self.host = host
        self.texts, self.main, self.shared = [x[0] for x in lines], [x[1] for x in lines], [x[2] for x in lines]

    def same(self, other: Page) -> bool:
        return self.host == other.host and self.texts == other.texts and self.main == other.main

    def compare(self, other: Page) -> None:
        """Marks in both pages the lines that they share."""
        if self.host != other.host or not self.texts or not other.texts:
            return
        for i, j in common(self.texts, other.texts):
            self.shared[i] = other.shared[j] = True

    def text(self) -> str:
        """Lines within an article, and those outside one that no neighbour shares."""
        return " ".join(t for t, m, s in zip(self.texts, self.main, self.shared, strict=True) if m or not s)

    def row(self, part: int, edge: int) -> dict:
        lines = [{"text": t, "main": m, "shared": s} for t, m, s in zip(self.texts, self.main, self.shared, strict=True)]
        return {"part": part, "edge": edge, "host": self.host, "lines": lines}


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Page, list[tuple], bool, bool]]:
    """Runs of equal pages of a sorted partition, each compared with the next: one page, ids and URLs of all, whether it is first, and last."""
    page, members, first = None, [], True
    for batch in batches:
        for *row, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            new = Page(row[2], [(t, m, False) for t, m in page_lines(html)])
            if page and not page.same(new):
                page.compare(new)
                yield page, members, first, False
                page, members, first = None, [], False
            page = page or new
            members.append((row[0], row[1]))
    if page:
        yield page, members, first, True


def _inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pages, with the text of those that aren't in the partition's first or last run. Edge is 1 for the first run, 2 for the last, 3 for an only one."""
    part = TaskContext.get().partitionId()
    for page, members, first, last in _runs(batches):
        edge = first + 2 * last
        text = None if edge else page.text()
        for i in range(0, len(members), 256):
            yield pa.RecordBatch.from_pylist([{"page_id": k, "url": u, "text": text, "part": part, "edge": edge} for k, u in members[i : i + 256]], _PAGE_TYPES)


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One page of a partition's first run and one of its last."""
    part = TaskContext.get().partitionId()
    for page, _, first, last in _runs(batches):
        if first or last:
            yield pa.RecordBatch.from_pylist([page.row(part, first + 2 * last)], _BORDER_TYPES)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of border runs, given in order: a run that ends a partition goes on in the next or is compared with the one that begins it."""
    page, members = None, []

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"part": p, "edge": e, "text": page.text()} for p, e in members], _TEXT_TYPES)

    for batch in batches:
        for r in batch.to_pylist():
            new = Page(r["host"], [(x["text"], x["main"], x["shared"]) for x in r["lines"]])
            if page:
                beyond = members[-1][0] != r["part"]
                if beyond and page.same(new):
                    page.shared = [s or t for s, t in zip(page.shared, new.shared, strict=True)]
                    members.append((r["part"], r["edge"]))
                    continue
                if beyond:
                    page.compare(new)
                yield rows()
            page, members = new, [(r["part"], r["edge"])]
    if page:
        yield rows()


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text.

    Lines are blocks with white space turned into one space and character
    references decoded; they are joined by one space in page order.  Null HTML
    is empty, and a page without main text has an empty text.  A null URL has an empty host
    and path; null ids are carried, and repeated rows are pages of their own,
    copies of each other.  Other columns are not read; an empty table gives an empty result.
    """
    url = text_of(url_col)
    bare = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        F.lower(F.regexp_extract(bare, r"^[^/?#]*", 0)).alias("host"),
        F.regexp_extract(bare, r"^[^/?#]*([^?#]*)", 1).alias("path"),
        text_of(html_col).alias("html"),
    )
    key = ["host", "path", F.col("page_id").asc_nulls_last(), "url"]
    # A fixed number of partitions, so that both passes over the one exchange have the same borders.
    ranged = rows.repartitionByRange(shuffle_partitions(pages.sparkSession), *key).sortWithinPartitions(*key)
    inner = ranged.mapInArrow(_inner, _PAGE)
    # Two rows at most for each partition, in one task: it holds one page at a time.
    edges = ranged.mapInArrow(_borders, _BORDER).repartition(1).sortWithinPartitions("part", "edge").mapInArrow(_joined, _TEXT)
    texts = F.broadcast(edges.withColumnRenamed("text", "border_text"))
    return inner.join(texts, ["part", "edge"], "left").select("page_id", "url", F.coalesce("text", "border_text").alias("text"))
