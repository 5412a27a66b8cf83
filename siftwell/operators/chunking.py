"""Cutting documents into sections.

Headings and the merging of neighbouring sections are column expressions: a
fold over a document's lines or sections in one row.  Cutting by size moves a
position through the text, which depends on each cut before, so it runs in
Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.text import BULLET, count_matches, estimate_tokens
from siftwell.operators.relational import spread

HEADING = r"^(#+)\s+(.+)$"
SECTION = "struct<title:string,text:string,level:int,layout:string>"
CHUNK = "struct<title:string,content:string,levels:array<int>>"
DEPTH = {"laws": 2, "book": 5}
PIVOT = ("paper", "manual")


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\x00]+|[\s\x00]+$", "")


def with_sections(df: DataFrame, text_col: str, name: str = "sections") -> DataFrame:
    """Adds array<struct<title, text, level, layout>> of the parts under each heading; what stands before the first one is its head. No headings, no sections.

    Lines and headings are columns of their own, so that no lambda splits the text again.
    """
    clean = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"^\x{FEFF}", "")
    df = df.withColumn("__lines", F.split(clean, r"\r?\n"))
    lines, starts = F.col("__lines"), F.col("__starts")
    # Each heading's line number; a part goes on to the next one.
    df = df.withColumn("__starts", F.filter(F.transform(lines, lambda s, i: F.when(s.rlike(HEADING), i)), lambda i: i.isNotNull()))
    joined = lambda lo, hi: _strip(F.array_join(F.slice(lines, lo + 1, F.greatest(hi - lo, F.lit(0))), "\n"))

    def part(start: Column, k: Column) -> Column:
        line = F.get(lines, start)
        end = F.coalesce(F.get(starts, k + 1), F.size(lines))
        title, level = F.trim(F.regexp_extract(line, HEADING, 2)), F.length(F.regexp_extract(line, HEADING, 1))
        own = F.struct(title.alias("title"), joined(start + 1, end).alias("text"), level.alias("level"), F.lit("text").alias("layout"))
        head = F.struct(title.alias("title"), joined(F.lit(0), start).alias("text"), level.alias("level"), F.lit("head").alias("layout"))
        return F.when(k == 0, F.array(head, own)).otherwise(F.array(own))

    return df.withColumn(name, F.filter(F.flatten(F.transform(starts, part)), lambda s: s["text"] != "")).drop("__lines", "__starts")


def _measured(own: Column, level: Column) -> Column:
    """Sections with what their token estimates are made of, and whether they begin a new chunk. The level is zipped in, as a lambda would compute it for each section."""
    ascii_ = lambda t: F.char_length(F.regexp_replace(t, r"[^\x00-\x7F]", ""))

    def one(s: Column, split: Column) -> Column:
        counts = [ascii_(s["text"]).alias("a"), (F.char_length(s["text"]) - ascii_(s["text"])).alias("n"), count_matches(s["text"], "[A-Za-z0-9_]+").alias("w")]
        return F.struct(s["title"].alias("title"), s["text"].alias("text"), s["level"].alias("level"), *counts, F.coalesce(s["level"] <= split, F.lit(False)).alias("apart"))

    return F.zip_with(own, F.array_repeat(level, F.size(own)), one)


def merged(own: Column, limit: int = 400, split_level: Column | None = None) -> Column:
    """array<struct<title, content, levels>>: neighbouring sections joined while their token estimate stays within the limit.

    The estimate of a joined text follows from three counters.  The fold keeps
    them and the places where chunks begin, and copies nothing for a section
    that joins; each chunk is then one slice. A section at or above
    ``split_level`` begins a new chunk.
    """
    split = split_level if split_level is not None else F.lit(None).cast("int")
    held = F.filter(_measured(own, split), lambda s: s["text"].rlike(r"\S"))
    state = lambda at, a, n, w, starts: F.struct(at.alias("at"), a.alias("a"), n.alias("n"), w.alias("w"), starts.alias("starts"))
    zero = F.lit(0)

    def step(out: Column, s: Column) -> Column:
        a, n, w = out["a"] + s["a"] + 2, out["n"] + s["n"], out["w"] + s["w"]
        joins = (out["at"] > 0) & ~s["apart"] & (F.ceil(a * 0.25) + n + w <= limit)
        new = state(out["at"] + 1, s["a"], s["n"], s["w"], F.concat(out["starts"], F.array(out["at"])))
        return F.when(joins, state(out["at"] + 1, a, n, w, out["starts"])).otherwise(new)

    def chunk(part: Column) -> Column:
        levels = F.filter(F.transform(part, lambda s: s["level"]), lambda x: x.isNotNull())
        return F.struct(F.get(part, zero)["title"].alias("title"), F.array_join(F.transform(part, lambda s: s["text"]), "\n\n").alias("content"), levels.alias("levels"))

    def chunks(parts: Column) -> Column:
        starts = F.aggregate(parts, state(zero, zero, zero, zero, F.array().cast("array<int>")), step, lambda out: out["starts"])
        size = lambda all_, x, i: F.coalesce(F.get(all_, i + 1), F.size(parts)) - x
        cut = lambda all_: F.transform(all_, lambda x, i: F.slice(parts, x + 1, size(all_, x, i)))
        return F.transform(_let(starts, cut), lambda part: _let(part, chunk))

    return _let(held, chunks)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_pivot_level(df: DataFrame, sections_col: str = "sections", name: str = "pivot") -> DataFrame:
    """Adds the most frequent heading level; of equally frequent ones the first seen."""
    df = df.withColumn("__levels", F.filter(F.transform(sections_col, lambda s: s["level"]), lambda x: x.isNotNull()))
    levels = F.col("__levels")
    counted = F.transform(F.array_distinct(levels), lambda v, i: F.struct(F.size(F.filter(levels, lambda x: x == v)).alias("n"), (-i).alias("i"), v.alias("v")))
    return df.withColumn(name, F.array_max(counted)["v"]).drop("__levels")


def bullet_sections(own: Column) -> Column:
    """How many sections have a list item."""
    return F.size(F.filter(own, lambda s: s["text"].rlike(BULLET)))


def with_smart_chunks(df: DataFrame, text_col: str, doc_type: str = "general", limit: int = 400, name: str = "chunks") -> DataFrame:
    """Adds the sections merged in the way of the document's type: laws and books are split at headings down to a depth, papers and manuals at the most frequent level."""
    df = with_sections(df, text_col, "__sections")
    if doc_type in PIVOT:
        df = with_pivot_level(df, "__sections", "__pivot")
    level = F.lit(DEPTH[doc_type]) if doc_type in DEPTH else F.col("__pivot") if doc_type in PIVOT else None
    return df.withColumn(name, merged(F.col("__sections"), limit, level)).drop("__sections", "__pivot")


def token_count(chunk: Column) -> Column:
    return estimate_tokens(chunk)


def cut_by_size(text: str, size: int = 2000, overlap: int = 200, least: int = 50) -> Iterator[str]:
    """Stretches of at most ``size`` characters that end with a sentence where one ends in their last fifth, each overlapping the one before."""
    at, n = 0, len(text)
    while at < n:
        end = min(at + size, n)
        if end < n:
            low = min(at + int(size * 0.8), n)
            stops = [m.end() for m in re.finditer(r"[.!?](?=\s|$)", text[low : end + 1]) if low + m.end() <= end]
            end = low + stops[-1] if stops else end
        piece = text[at:end].strip()
        if len(piece) > least:
            yield piece
        at = n if end >= n else max(end - min(overlap, len(piece)), at + 50)


def title_of(piece: str, number: int) -> str:
    """A chunk's title: its first heading, else its first sentence or line up to 100 characters."""
    if heading := re.search(r"^#+\s+(.+)$", piece, re.M):
        return heading[1].strip()
    line = piece.strip().split("\n", 1)[0].strip()
    if not line:
        return f"Section {number}"
    sentence = re.match(r".*?[.!?]", line)
    shown = sentence[0].strip() if sentence else line
    return shown[:100] + "..." if len(shown) > 100 else shown


def _bare(text: str) -> str:
    """A part without the headings that begin it."""
    return re.sub(r"\A(?:#+\s+[^\n]*(?:\n|\Z))+", "", text.strip()).strip()


def markdown_chunks(text: str | None, size: int = 2000, overlap: int = 200, levels: tuple[int, ...] = (1, 2, 3)) -> list[tuple[str | None, str]]:
    """(title, content) by headings of the given levels; the first H1 is the document's title, and what follows it goes to the first part.

    Parts over one and a half sizes are cut further; text without headings is cut by size.
    """
    body = (text or "").removeprefix("﻿")
    marks = "|".join("#" * n for n in levels)
    found = [(m.start(), m.end(), len(m[1]), m[2].strip()) for m in re.finditer(rf"^({marks})\s+(\S.*)$", body, re.M)]
    if not found:
        return [(title_of(p, k + 1), p) for k, p in enumerate(cut_by_size(body, size, overlap))]
    main = next((k for k, f in enumerate(found) if f[2] == 1), None)
    heads = [f for k, f in enumerate(found) if k != main]
    parts: list[tuple[str, str]] = []
    intro = ""
    if main is not None and (not heads or found[main][0] < heads[0][0]):
        intro = _bare(body[found[main][1] : heads[0][0] if heads else len(body)])
    bounds = sorted(f[0] for f in found)
    for start, stop, _, title in heads:
        end = next((b for b in bounds if b > start), len(body))
        content = "\n\n".join(x for x in (intro, _bare(body[stop:end])) if x)
        if content:
            parts.append((title, content))
            intro = ""
    if not parts and main is not None and (rest := _bare(body[found[main][1] :])):
        parts = [(found[main][3], rest)]
    out: list[tuple[str | None, str]] = []
    for title, content in parts:
        if len(content) > 1.5 * size:
            out += [(title if k == 0 else f"{title} (Part {k + 1})", p) for k, p in enumerate(cut_by_size(content, size, overlap))]
        else:
            out.append((title, content))
    return out


def chunk_documents(docs: DataFrame, strategy: str = "smart", id_col: str = "id", text_col: str = "content", doc_type: str = "general", limit: int = 400, size: int = 2000, overlap: int = 200, chunker: Callable[[str], list[tuple[str | None, str]]] | None = None) -> DataFrame:
    """document_id, section_number from 1, section_title, content.

    ``smart`` merges the parts under headings and cuts texts without headings
    by size; ``markdown`` splits at headings; a ``chunker`` of one's own takes a text and gives
    titles and contents. Null and empty texts have no sections.
    """
    schema = "document_id long, section_number int, section_title string, content string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = chunker or (lambda t: markdown_chunks(t, size, overlap))
        for batch in batches:
            rows = [(i, k, title, content) for i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, (title, content) in enumerate(cut(text) if text else [], 1)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["document_id", "section_number", "section_title", "content"])

    own = spread(docs.select(F.col(id_col).cast("long").alias("document_id"), F.col(text_col).alias("content")))
    if chunker or strategy == "markdown":
        return own.mapInArrow(run, schema)
    if strategy != "smart":
        raise ValueError(f"unknown strategy {strategy}")
    headed = F.col("content").rlike(r"(?m)" + HEADING)
    chunks = with_smart_chunks(own.where(headed), "content", doc_type, limit)
    # An outer generator: for others the optimizer puts a filter on the whole expression below all columns that it uses.
    chunks = chunks.select("document_id", F.posexplode_outer("chunks").alias("k", "c")).where("k is not null")
    by_heading = chunks.select("document_id", (F.col("k") + 1).cast("int").alias("section_number"), F.col("c.title").alias("section_title"), F.col("c.content").alias("content"))
    plain = own.where(~headed).mapInArrow(run, schema)
    return by_heading.unionByName(plain)
