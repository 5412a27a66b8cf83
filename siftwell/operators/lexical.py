"""Full-text search over sections: by scanning their words, or through a postings table.

A scan writes each field's words once, with blanks about each, and evaluates
the query on that text by substring tests and counts, which stay in generated
code; it needs no shuffle but the top-k, and
only columns in use are read.  The postings table holds one row for each
section, field and word; a search reads the rows of its own words, which the
layout by word makes a small part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.text import index_languages
from siftwell.operators.relational import spread
from siftwell.plans.query import All, Any, Node, Not, Term, matches, parse, padded, positive_words

K1, B = 1.2, 0.75
WEIGHTS = {"title": 1.0, "content": 0.4}
WORD = r"\p{IsHan}+|[\p{L}\p{N}_&&[^\p{IsHan}]]+"


def words(text: Column) -> Column:
    """The words of a text as the index has them: lower-case runs of letters, digits and underscores, Han as pairs of characters."""

    def parts(run: Column) -> Column:
        size = F.char_length(run)
        pairs = F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.substr(run, i, F.lit(2)))
        return F.when(run.rlike(r"^\p{IsHan}") & (size > 2), pairs).otherwise(F.array(F.lower(run)))

    return F.flatten(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), parts))


def with_words(sections: DataFrame, title: str = "section_title", content: str = "content") -> DataFrame:
    return sections.withColumns({"title_words": words(F.col(title)), "content_words": words(F.col(content))})


def padded_words(text: Column) -> Column:
    """The words of ``words`` in one text, each with a blank before and after it, so two blanks between words; two blanks are a text without words."""
    no_han = (F.octet_length(text) == F.char_length(text)) | ~text.rlike(r"\p{IsHan}")
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]*+([\p{L}\p{N}_]++)[^\p{L}\p{N}_]*+|^[^\p{L}\p{N}_]*+$", " $1 ")
    han = F.concat(F.lit(" "), F.array_join(words(text), "  "), F.lit(" "))
    return F.when(text.isNull(), "  ").when(no_han, plain).otherwise(han)


def with_padded(sections: DataFrame, title: str, content: str) -> DataFrame:
    """Adds title_words and content_words as padded text. They come out of a generator, so that a filter on them doesn't compute them anew."""
    both = F.struct(padded_words(F.col(title)).alias("title_words"), padded_words(F.col(content)).alias("content_words"))
    return spread(sections).select("*", F.inline_outer(F.array(both)))


def word_count(words_: Column) -> Column:
    """Words of a padded text."""
    return F.when(F.octet_length(words_) <= 2, 0).otherwise(F.octet_length(words_) - F.octet_length(F.replace(words_, F.lit("  "), F.lit(" "))) + 1)


def term_frequency(words_: Column, term: str) -> Column:
    """How often a padded text has a word."""
    size = len(f" {term} ".encode())
    return ((F.octet_length(words_) - F.octet_length(F.replace(words_, F.lit(f" {term} "), F.lit("")))) / size).cast("int")


def frequency_rank(terms: list[str], weights: dict[str, float] | None = None) -> Column:
    """Sum of the terms' frequencies by field weight."""
    w = weights or WEIGHTS
    parts = [term_frequency(F.col(f"{field}_words"), t) * w[field] for t in terms for field in ("title", "content") if w.get(field)]
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def search(sections: DataFrame, query: str, limit: int = 20, id_col: str = "section_id", rank: str = "bm25", weights: dict[str, float] | None = None, title: str = "section_title", content: str = "content") -> DataFrame:
    """Matching sections by rank: the columns of ``sections`` and rank_score.

    ``rank`` is ``bm25``, with statistics over all sections, or ``frequency``.
    Filters belong on ``sections`` before the search, where they reach the scan; statistics then
    cover what is left.  Ties go to the smaller id.
    """
    tree = parse(query)
    if tree is None:
        return sections.withColumn("rank_score", F.lit(0.0)).limit(0)
    held = with_padded(sections, title, content)
    match = matches(tree, F.col("title_words"), F.col("content_words"))
    terms = positive_words(tree)
    if rank == "frequency" or not terms:
        scored = held.where(match).withColumn("rank_score", frequency_rank(terms, weights))
    else:
        scored = bm25(held, match, terms, weights or WEIGHTS)
    return scored.drop("title_words", "content_words").orderBy(F.desc("rank_score"), F.asc(id_col)).limit(limit)


def quick(sections: DataFrame, query: str, limit: int = 10, id_col: str = "section_id") -> DataFrame:
    """The ids and ranks of the best sections and nothing else."""
    return search(sections, query, limit, id_col).select(id_col, "rank_score")


def search_with_snippets(sections: DataFrame, query: str, limit: int = 20, content: str = "content", **options) -> DataFrame:
    """As search, with a snippet of each of its rows. Snippets are made after the limit."""
    found = search(sections, query, limit, content=content, **options)
    return found.withColumn("snippet", highlight(F.col(content), positive_words(parse(query))))


def bm25(held: DataFrame, match: Column, terms: list[str], weights: dict[str, float]) -> DataFrame:
    """BM25 of the weighted fields; lengths and document frequencies come from one aggregate of a single row."""
    length = word_count(F.col("title_words")) + word_count(F.col("content_words"))
    has = [F.count_if(F.contains("title_words", F.lit(padded([t]))) | F.contains("content_words", F.lit(padded([t])))) for t in terms]
    stats = held.agg(F.count("*").alias("__n"), F.avg(length).alias("__avg"), F.array(*has).alias("__df"))
    out = held.where(match).crossJoin(F.broadcast(stats))
    total = F.lit(0.0)
    for k, t in enumerate(terms):
        tf = sum((term_frequency(F.col(f"{f}_words"), t) * w for f, w in weights.items()), F.lit(0.0))
        df = F.get("__df", F.lit(k))
        idf = F.log(1 + (F.col("__n") - df + 0.5) / (df + 0.5))
        total = total + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.col("__avg")))
    return out.withColumn("rank_score", total).drop("__n", "__avg", "__df")


def terms_of(tree: Node) -> list[Term]:
    if isinstance(tree, Term):
        return [tree]
    return terms_of(tree.part) if isinstance(tree, Not) else [t for p in tree.parts for t in terms_of(p)]


def postings(sections: DataFrame, id_col: str = "section_id", document_col: str = "document_id", language_col: str = "language", title: str = "section_title", content: str = "content") -> DataFrame:
    """section_id, document_id, languages, field, word, positions, frequency, length: one row per section, field and word.

    Write it partitioned or sorted by word, so that a search reads its words' files only.
    """
    held = with_words(spread(sections), title, content)
    base = [F.col(id_col).alias("section_id"), F.col(document_col).alias("document_id"), index_languages(F.col(content), F.col(language_col)).alias("languages"), (F.size("title_words") + F.size("content_words")).alias("length")]
    rows = held.select(*base, *(f"{f}_words" for f in WEIGHTS))  # before the explosion, or it is computed for each word
    names = ("section_id", "document_id", "languages", "length")
    fields = [rows.select(*names, F.lit(f).alias("field"), F.posexplode_outer(f"{f}_words").alias("position", "word")).where("position is not null") for f in WEIGHTS]
    rows = fields[0].unionByName(fields[1])
    out = rows.groupBy("section_id", "document_id", "languages", "length", "field", "word").agg(F.sort_array(F.collect_list("position")).alias("positions"))
    return out.withColumn("frequency", F.size("positions"))


def index_stats(index: DataFrame) -> DataFrame:
    """Sections and their mean length, in one row."""
    return index.groupBy("section_id").agg(F.max("length").alias("length")).agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"))


def search_index(index: DataFrame, query: str, limit: int = 20, stats: DataFrame | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """section_id and rank_score of the best sections by the postings of the query's words."""
    tree, w = parse(query), weights or WEIGHTS
    empty = index.select("section_id", F.lit(0.0).alias("rank_score")).limit(0)
    if tree is None:
        return empty
    wanted = terms_of(tree)
    if not needs_word(tree):
        raise ValueError("a query that a section without any of its words can match needs a scan")
    exact = list(dict.fromkeys(x for t in wanted if not t.prefix for x in t.words))
    prefixes = [t.words[0] for t in wanted if t.prefix]
    pick = reduce(lambda a, b: a | b, (F.startswith("word", F.lit(p)) for p in prefixes), F.col("word").isin(exact))
    hits = index.where(pick)
    frequency = hits.groupBy("word").agg(F.countDistinct("section_id").alias("df"))
    stats = stats if stats is not None else index_stats(index)
    terms = positive_words(tree)
    known = hits.join(F.broadcast(frequency.where(F.col("word").isin(terms))), "word", "left") if terms else hits.withColumn("df", F.lit(None).cast("long"))
    rows = known.groupBy("section_id").agg(F.max("length").alias("length"), F.collect_list(F.struct("field", "word", "positions", "frequency", "df")).alias("p"))
    rows = rows.where(holds(tree, F.col("p"))).crossJoin(F.broadcast(stats))
    total = F.lit(0.0)
    for t in terms:
        own = _of_word(t)
        tf = F.aggregate(own, F.lit(0.0), lambda s, x: s + x["frequency"] * F.when(x["field"] == "title", w["title"]).otherwise(w["content"]))
        df = F.coalesce(F.get(own, F.lit(0))["df"], F.lit(0))
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        total = total + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    return rows.select("section_id", total.alias("rank_score")).orderBy(F.desc("rank_score"), "section_id").limit(limit)


def _of_word(word: str) -> Column:
    return F.filter("p", lambda x: x["word"] == word)


def needs_word(tree: Node) -> bool:
    """Whether every match has at least one word of the query."""
    if isinstance(tree, Term):
        return True
    if isinstance(tree, Not):
        return False
    return any(map(needs_word, tree.parts)) if isinstance(tree, All) else all(map(needs_word, tree.parts))


def holds(tree: Node, p: Column) -> Column:
    """Whether the postings of a section, array<struct<field, word, positions, ...>>, fulfil the tree."""
    if isinstance(tree, Not):
        return ~holds(tree.part, p)
    if isinstance(tree, (All, Any)):
        parts = [holds(x, p) for x in tree.parts]
        return reduce(lambda a, b: a & b if isinstance(tree, All) else a | b, parts)
    if tree.prefix:
        return F.exists(p, lambda x: F.startswith(x["word"], F.lit(tree.words[0])))
    if len(tree.words) == 1:
        return F.exists(p, lambda x: x["word"] == tree.words[0])

    def at(word: str, field: str) -> Column:
        return F.flatten(F.transform(F.filter(p, lambda x: (x["word"] == word) & (x["field"] == field)), lambda x: x["positions"]))

    def in_field(field: str) -> Column:
        starts = at(tree.words[0], field)
        for k, word in enumerate(tree.words[1:], 1):
            shifted = F.transform(at(word, field), _minus(k))
            starts = F.array_intersect(starts, shifted)
        return F.size(starts) > 0

    return in_field("title") | in_field("content")


def _minus(k: int):
    return lambda i: i - k


def highlight(text: Column, terms: list[str], most: int = 50, least: int = 15, fragments: int = 3, start: str = "<mark>", stop: str = "</mark>") -> Column:
    """Up to ``fragments`` stretches of words about the first hits, hits marked; without hits the first ``least`` words."""
    split = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    own = F.array(*(F.lit(t) for t in terms)) if terms else F.array().cast("array<string>")
    is_hit = lambda w: F.array_contains(own, F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}_]", "")))
    width = max(least, most // fragments)
    # The window that a hit falls in; each window is shown once.
    windows = F.slice(F.array_distinct(F.transform(F.filter(F.transform(split, lambda w, i: F.when(is_hit(w), i)), lambda i: i.isNotNull()), lambda i: F.floor(i / width))), 1, fragments)
    shown = F.when(F.size(windows) > 0, windows).otherwise(F.array(F.lit(0).cast("long")))
    marked = F.transform(split, lambda w: F.when(is_hit(w), F.concat(F.lit(start), w, F.lit(stop))).otherwise(w))
    return F.array_join(F.transform(shown, lambda k: F.array_join(F.slice(marked, (k * width + 1).cast("int"), F.lit(width)), " ")), " ... ")


def suggest(sections: DataFrame, prefix: str, limit: int = 10, content: str = "content") -> DataFrame:
    """word and count of the most frequent words that begin with ``prefix``, of two characters at least."""
    own = prefix.strip().lower()
    rows = spread(sections.select(content)).select(F.explode_outer(F.filter(F.transform(F.regexp_extract_all(F.coalesce(F.col(content), F.lit("")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), F.lower), lambda w: F.startswith(w, F.lit(own)))).alias("word")).where("word is not null")
    counts = rows.groupBy("word").agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), "word").limit(limit if len(own) >= 2 else 0)


def spelling(sections: DataFrame, query: str, limit: int = 3, content: str = "content") -> DataFrame:
    """Words of the sections that begin like words of the query of three characters or more, the nearest in spelling first."""
    asked = [w for w in query.strip().lower().split() if len(w) >= 3]
    rows = spread(sections.select(content)).select(F.explode_outer(F.array_distinct(words(F.col(content)))).alias("word"))
    like = reduce(lambda a, b: a | b, (F.startswith("word", F.lit(w[:4])) for w in asked), F.lit(False))
    distance = reduce(lambda a, b: F.least(a, b), (F.levenshtein("word", F.lit(w)) for w in asked)) if len(asked) > 1 else F.levenshtein("word", F.lit(asked[0] if asked else ""))
    return rows.where(like).groupBy("word").agg(F.count("*").alias("sections")).withColumn("distance", distance).orderBy("distance", F.desc("sections"), "word").limit(limit)


def many_languages(sections: DataFrame, query: str, languages: list[str], limit: int = 20, language_col: str = "language", **options) -> DataFrame:
    """The best sections of each language, merged by rank."""
    found = [search(sections.where(F.col(language_col) == code), query, limit, **options) for code in languages]
    return reduce(DataFrame.unionByName, found).orderBy(F.desc("rank_score"), options.get("id_col", "section_id")).limit(limit)


def field_weights(values: str) -> dict[str, float]:
    """Weights of title and content from a list such as '1.0, 0.5'."""
    given = [float(x) for x in values.split(",")]
    return dict(zip(("title", "content"), given, strict=False))
