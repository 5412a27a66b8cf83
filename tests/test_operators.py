from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siftwell import errors
from siftwell.functions import text as T
from siftwell.functions.vectors import cosine, cosine_to, literal, mean
from siftwell.operators import chunking, fusion, lexical, relational, tags, vector
from siftwell.plans import answer
from siftwell.plans.engine import query_tokens
from siftwell.streaming.index import changed_sections, latest_rows, maintain, popularity

NOW = datetime(2024, 5, 1, 12)


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_cosine(spark):
    pairs = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 2.0], 0.0), ([0.0, 0.0], [1.0, 1.0], 0.0), ([], [], 0.0), ([1.0, 2.0, 3.0], [-1.0, -2.0, -3.0], -1.0), ([1.0], [1.0, 2.0], 0.0)]
    for a, b, want in pairs:
        left = literal(a) if a else F.array().cast("array<double>")
        assert value(spark, cosine(left, literal(b) if b else F.array().cast("array<double>"))) == pytest.approx(want)
        assert value(spark, cosine_to(left, b)) == pytest.approx(want)
    assert value(spark, cosine(F.lit(None).cast("array<double>"), literal([1.0]))) == 0.0


def test_mean_vectors():
    assert mean([[1.0, 3.0], [3.0, 5.0]]) == [2.0, 4.0]
    assert mean([[1.0, 0.0], [0.0, 1.0]], [0.7, 0.3]) == pytest.approx([0.7, 0.3])
    with pytest.raises(ValueError):
        mean([[1.0], [1.0, 2.0]])


def vectors(spark):
    return spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [-1.0, 0.0]), (5, None)], "id long, vector array<float>")


def test_cascade_takes_the_first_tier_with_results(spark):
    v = vectors(spark)
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(vector.cascade(v, [1.0, 0.0])) == [1, 2]
    far = v.where("id in (3, 4)")
    assert ids(vector.cascade(far, [1.0, 0.2], 10, 0.3, 0.1)) == [3]
    assert ids(vector.cascade(far.where("id = 4"), [1.0, 0.2])) == [4]
    assert ids(vector.cascade(far.where("id = 4"), [1.0, 0.2], any_nearest=False)) == []
    with pytest.raises(ValueError):
        vector.many_vectors(v, [[1.0, 0.0]], method="median")


def test_coarse_lists_find_what_a_scan_finds(spark):
    import random

    rng = random.Random(3)
    rows = [(k, [rng.gauss(5 * (k % 7 == j), 1) for j in range(7)]) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    centres = vector.centroids(df, 7)
    listed = vector.with_list(df, centres).cache()
    for q in (3, 50, 222):
        want = [r.id for r in vector.nearest(df, rows[q][1], 10).collect()]
        got = [r.id for r in vector.probe(listed, centres, rows[q][1], 10, 3).collect()]
        assert len(set(want) & set(got)) >= 9


def test_reciprocal_rank(spark):
    text = spark.createDataFrame([(1, 0.9), (2, 0.8), (3, 0.7)], "section_id long, rank_score double")
    near = spark.createDataFrame([(2, 0.9), (4, 0.8), (5, 0.7)], "section_id long, similarity double")
    both = {r.section_id: r.combined_score for r in fusion.reciprocal_rank(text, near).collect()}
    assert len(both) == 5 and both[1] == pytest.approx(1 / 61) and both[2] == pytest.approx(1 / 62 + 1 / 61) and max(both, key=both.get) == 2
    weighted = {r.section_id: r.combined_score for r in fusion.reciprocal_rank(text, near, 0.7).collect()}
    assert weighted[2] == pytest.approx(0.7 / 61 + 0.3 / 62)
    total = {r.section_id: r.combined_score for r in fusion.weighted_sum(text, near, 0.95).collect()}
    assert total[2] == pytest.approx(0.95 + 0.05 * 0.5) and total[1] == pytest.approx(0.05)
    same = spark.createDataFrame([(1, 0.0), (2, 0.0)], "section_id long, rank_score double")
    assert {r.combined_score for r in fusion.weighted_sum(same, near.limit(0), 0.5).collect()} == {0.0}
    assert fusion.reciprocal_rank(text.limit(0), near.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fusion.combine("other", text, near, 0.5)


def test_scalars():
    assert [fusion.clamp_limit(x) for x in (None, 0, 5, 1000)] == [20, 1, 5, 100]
    assert [fusion.clamp_alpha(x) for x in (-1, 0.4, 7)] == [0.0, 0.4, 1.0]
    assert [fusion.pool_size(a, b) for a, b in ((64, 20), (65, 20), (0, 40), (10, 100))] == [64, 128, 128, 128]
    assert fusion.alpha_for(0.9, "知识", "zh_cn") == 0.3 and fusion.alpha_for(0.9, "knowledge", "en") == 0.9 and fusion.alpha_for(0.9, "五个字以上", "zh") == 0.9


def test_rerank_prefers_tags(spark):
    rows = [(1, "data modeling basics", "Primer", ["sql"], 0.5, 0.5), (2, "data modeling basics", "Primer", ["data"], 0.5, 0.4), (3, "unrelated words", "x", [], 0.9, 0.9)]
    df = spark.createDataFrame(rows, "section_id long, content string, section_title string, tags array<string>, vector_score double, combined_score double")
    got = fusion.rerank(df, query_tokens("data modeling guide"), 0.95).collect()
    assert [r.section_id for r in got] == [2, 1, 3]
    assert got[0].token_score == pytest.approx((1 + 1 + 5) / 3) and got[2].rerank_score == pytest.approx(0.95 * 0.9 * 0.3)
    assert [r.section_id for r in fusion.rerank(df, [], 0.95).collect()] == [3, 1, 2]


def test_tokens(spark):
    text = "深度学习 Deep_Learning 2, 模型"
    want = ["深度学习", "深度", "度学", "学习", "deep_learning", "2", "模型"]
    assert value(spark, T.tokenize(F.lit(text))) == want == query_tokens(text)
    assert value(spark, T.tokenize(F.lit(None).cast("string"))) == []


@pytest.mark.parametrize(("text", "want"), [("", 0), ("abcd efgh", 3 + 2), ("中文", 2), ("a 中b", 1 + 1 + 2)])
def test_token_estimate(spark, text, want):
    assert value(spark, T.estimate_tokens(F.lit(text))) == want


@pytest.mark.parametrize(("name", "want"), [(None, None), ("  ", None), (" a/b  c ", "a b c"), ("x-y_z!", "x-y_z"), (" 机器/学习 ", "机器/学习")])
def test_tag_names(spark, name, want):
    assert value(spark, T.clean_tag_name(F.lit(name).cast("string"))) == want == answer.clean_tag(name)


def test_config_fallbacks(spark):
    table = {"en": "english", "default": "plain"}
    assert [value(spark, T.config_name(F.lit(c), table)) for c in ("en", "en_us", "xx")] == ["english", "english", "plain"]
    assert value(spark, T.config_name(F.lit("xx"), {"en": "english"})) == "pg_catalog.simple"
    assert value(spark, T.index_languages(F.lit("漢字漢字かな"), F.lit("en"))) == ["en", "zh", "ja"]


def sections(spark):
    rows = [(1, 10, "Ruby guide", "Ruby is a programming language", "en"), (2, 10, "Python", "Python is a language for data science", "en"), (3, 11, "Data", "data science with ruby and python", "en"), (4, 11, None, "深度学习模型", "zh"), (5, 12, "Empty", None, "en")]
    return spark.createDataFrame(rows, "section_id long, document_id long, section_title string, content string, language string")


@pytest.mark.parametrize(
    ("query", "want"),
    [("ruby", {1, 3}), ("ruby python", {1, 2, 3}), ("ruby AND python", {3}), ("language NOT ruby", {2}), ('"data science"', {2, 3}), ('"science data"', set()), ('"guide ruby"', set()), ("pro:*", {1}), ("学习", {4}), ("度学", {4}), ("NOT language", {3, 4, 5}), ("?!", set())],
)
def test_search_by_scan_and_by_postings(spark, query, want):
    own = sections(spark)
    found = lexical.search(own, query)
    assert {r.section_id for r in found.collect()} == want
    if query != "NOT language":
        indexed = lexical.search_index(lexical.postings(own), query).collect()
        assert {r.section_id for r in indexed} == want
        scores = {r.section_id: r.rank_score for r in found.collect()}
        if ":*" not in query:
            assert all(r.rank_score == pytest.approx(scores[r.section_id]) for r in indexed)
    else:
        with pytest.raises(ValueError):
            lexical.search_index(lexical.postings(own), query)


def test_highlight_and_suggestions(spark):
    own = sections(spark)
    shown = {r[0]: r[1] for r in own.select("section_id", lexical.highlight(F.col("content"), ["ruby"])).collect()}
    assert shown[1].startswith("<mark>Ruby</mark> is") and "<mark>" not in shown[2]
    assert [r.word for r in lexical.suggest(own, "Pr").collect()] == ["programming"] and lexical.suggest(own, "p").count() == 0
    assert lexical.spelling(own, "langage", 1).first().word == "language"


def test_diversify_and_pages(spark):
    rows = [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "a"), (6, "b")]
    df = spark.createDataFrame(rows, "rank int, category string")
    order = [r.rank for r in relational.interleave(df, "category", "rank").orderBy("diversified_rank").collect()]
    assert order == [1, 3, 4, 2, 6, 5]
    assert [r.rank for r in relational.preferred_first(df, "category", ["b"], "rank").orderBy("boosted_rank").collect()][:2] == [3, 6]
    page, pager = relational.page(df, [F.asc("rank")], 2, 4)
    assert [r.rank for r in page.collect()] == [5, 6] and pager["total_pages"] == 2
    assert relational.score_stats(df.limit(0), "rank").count() == 0


def tree(spark):
    return spark.createDataFrame([(1, "a", None, NOW), (2, "b", 1, NOW), (3, "c", 2, NOW), (4, "d", None, NOW)], "id long, name string, parent_id long, created_at timestamp")


def test_tag_trees(spark):
    t = tree(spark)
    assert {r.id: r.path for r in tags.paths(t).collect()} == {1: "a", 2: "a > b", 3: "a > b > c", 4: "d"}
    assert {r.descendant_id for r in tags.descendants(t, 1).collect()} == {2, 3}
    assert {(r.ancestor_id, r.distance) for r in tags.ancestors(t, 3).collect()} == {(2, 1), (1, 2)}
    assert tags.nested(t)[0]["children"][0]["children"][0]["name"] == "c"
    with pytest.raises(ValueError):
        tags.moved(t, 1, 3)
    assert {r.id: r.parent_id for r in tags.moved(t, 2, 4).collect()}[2] == 4
    grown = tags.with_hierarchy(t, {"x": {"y": ["z"]}, "a": ["b", "new"]}, NOW)
    got = {r.path for r in tags.paths(grown).collect()}
    assert {"x > y > z", "a > new", "a > b > c"} <= got and grown.count() == 8
    conflict = spark.createDataFrame([("b", 4)], "name string, parent_id long")
    assert tags.parent_conflicts(t, conflict).first().asked_parent_id == 4


def test_bridges(spark):
    bridge = spark.createDataFrame([(1, 1, NOW), (1, 2, NOW)], "section_id long, tag_id long, created_at timestamp")
    ids = lambda *x: spark.createDataFrame([(v,) for v in x], "id long")
    pairs = lambda df: {(r.section_id, r.tag_id) for r in df.collect()}
    assert pairs(tags.linked(bridge, ids(1, 2), ids(2, 3), "section_id", "tag_id", NOW)) == {(1, 1), (1, 2), (1, 3), (2, 2), (2, 3)}
    assert pairs(tags.linked(bridge, ids(1), ids(2, 3), "section_id", "tag_id", NOW, replace=True)) == {(1, 2), (1, 3)}
    assert pairs(tags.unlinked(bridge, "section_id", 1, "tag_id", [2])) == {(1, 1)} and tags.unlinked(bridge, "section_id", 1).count() == 0


MARKDOWN = "intro line\n# Title\nfirst part\n\n## One\nalpha. beta\n## Two\n- item\n### Deep\ngamma\n## Empty\n"


def test_sections_under_headings(spark):
    df = spark.createDataFrame([(1, MARKDOWN), (2, "no heading"), (3, None), (4, "")], "id long, content string")
    rows = {r.id: [(s.title, s.text, s.level, s.layout) for s in r.sections] for r in chunking.with_sections(df, "content").collect()}
    assert rows[1] == [("Title", "intro line", 1, "head"), ("Title", "first part", 1, "text"), ("One", "alpha. beta", 2, "text"), ("Two", "- item", 2, "text"), ("Deep", "gamma", 3, "text")]
    assert rows[2] == rows[3] == rows[4] == []
    pivot = chunking.with_pivot_level(chunking.with_sections(df.where("id = 1"), "content")).select("pivot", chunking.bullet_sections(F.col("sections"))).first()
    assert tuple(pivot) == (1, 1)


def greedy(parts, limit, estimate):
    out = []
    for title, text, level in parts:
        if out and estimate(out[-1][1] + "\n\n" + text) <= limit:
            out[-1] = (out[-1][0], out[-1][1] + "\n\n" + text, [*out[-1][2], level])
        else:
            out.append((title, text, [level]))
    return out


def test_merging_equals_joining_strings(spark):
    import math
    import random
    import re

    rng = random.Random(1)

    def estimate(t):
        a = sum(c < "\x80" for c in t)
        return math.ceil(a * 0.25) + len(t) - a + len(re.findall("[A-Za-z0-9_]+", t))

    docs = []
    for d in range(25):
        parts = [(f"T{k}", " ".join(rng.choice(["ab", "c_d", "é", "漢字", "1."]) for _ in range(rng.randrange(1, 60))), rng.randrange(1, 4)) for k in range(rng.randrange(1, 12))]
        docs.append((d, "\n".join(f"{'#' * lv} {t}\n{x}" for t, x, lv in parts), parts))
    df = spark.createDataFrame([(d, t) for d, t, _ in docs], "id long, content string")
    for r in chunking.with_smart_chunks(df, "content", limit=60).collect():
        assert [(c.title, c.content, c.levels) for c in r.chunks] == greedy(docs[r.id][2], 60, estimate)
    laws = chunking.with_smart_chunks(df, "content", "laws", 10**6).collect()
    for r in laws:
        levels = [lv for _, _, lv in docs[r.id][2]]
        assert len(r.chunks) == 1 + sum(lv <= 2 for lv in levels[1:])


def test_markdown_chunks():
    got = chunking.markdown_chunks("# Doc\nintro\n## A\ntext a\n## B\ntext b\n#### deep\nmore")
    assert got == [("A", "intro\n\ntext a"), ("B", "text b\n#### deep\nmore")]
    assert chunking.markdown_chunks("# Only\nbody text") == [("Only", "body text")]
    assert chunking.markdown_chunks("") == [] and chunking.markdown_chunks(None) == []
    long = "## Big\n" + "A sentence of words. " * 400
    parts = chunking.markdown_chunks(long, 1000, 100)
    assert parts[0][0] == "Big" and parts[1][0] == "Big (Part 2)" and all(len(c) <= 1000 for _, c in parts) and all(c.endswith(".") for _, c in parts)


def test_cutting_by_size():
    text = " ".join(f"Sentence number {k} ends here." for k in range(200))
    pieces = list(chunking.cut_by_size(text, 500, 50))
    assert all(50 < len(p) <= 500 for p in pieces) and all(p in text for p in pieces)
    assert set(text.split()) <= {w for p in pieces for w in p.split()}
    assert list(chunking.cut_by_size("x" * 1200, 500, 50)) and list(chunking.cut_by_size("short", 500, 50)) == []
    assert chunking.title_of("No stop here", 1) == "No stop here" and chunking.title_of("a" * 150, 1).endswith("...") and chunking.title_of("One. Two.", 1) == "One."


def test_documents_without_headings_are_cut_by_size(spark):
    df = spark.createDataFrame([(1, MARKDOWN), (2, "Plain words here. " * 300), (3, None)], "id long, content string")
    got = chunking.chunk_documents(df, "smart").collect()
    assert {r.document_id for r in got} == {1, 2} and [r.section_number for r in got if r.document_id == 1] == [1]
    own = chunking.chunk_documents(df, chunker=lambda t: [(None, t[:5])]).collect()
    assert sorted(r.content for r in own) == ["Plain", "intro"]
    with pytest.raises(ValueError):
        chunking.chunk_documents(df, "other")


def test_answers():
    assert answer.parse_summary('```json\n{"answer": "x", "confidence": 0.4}\n```') == {"answer": "x", "confidence": 0.4, "raw_response": '```json\n{"answer": "x", "confidence": 0.4}\n```'}
    assert answer.parse_summary("plain")["confidence"] == 0.8 and answer.parse_text("```\nx\n```") == "x"
    assert answer.parse_tags('{"categories": ["A!"], "content_tags": ["b", ""]}') == {"categories": ["A"], "content_tags": ["b"]}
    assert answer.parse_tags('{"categories": ["a", "b"], "content_tags": ["c" ') == {"categories": ["a", "b"], "content_tags": []}
    assert answer.parse_tags('tags "a" "b" "c" "d"') == {"categories": ["a", "b"], "content_tags": ["c", "d"]} and answer.parse_tags(None) == {"categories": [], "content_tags": []}
    assert answer.answer("q", "", str)["confidence"] == 0.0
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return "done"

    assert answer.with_retry(flaky, 3, waits.append) == "done" and waits == [2.0, 4.0]


def test_contexts(spark):
    rows = [(k, f"T{k}" if k != 2 else None, "body" if k != 3 else " ") for k in range(1, 9)]
    df = spark.createDataFrame(rows, "rank int, section_title string, content string")
    assert answer.context(df).first()[0] == "\n\n---\n\n".join(["Section: T1\nbody", "body", "Section: T4\nbody", "Section: T5\nbody"])
    long = spark.createDataFrame([(1, None, "x" * 5000)], "rank int, section_title string, content string")
    assert answer.context(long).first()[0] == "x" * 4000 + "... (truncated)" and answer.context(df.limit(0)).first()[0] == ""


def test_errors():
    assert issubclass(errors.HybridSearchError, errors.SearchError) and str(errors.VectorSearchError("x")) == "Search failed: x"
    kinds = [v for v in vars(errors).values() if isinstance(v, type) and issubclass(v, errors.EngineError)]
    assert len(kinds) >= 44


def test_streams_keep_the_index(spark, tmp_path):
    rows = [(k, 1, f"word{k} shared", f"T{k}", k, NOW, NOW) for k in range(4)]
    schema = changed_schema = "id long, document_id long, content string, section_title string, section_number int, created_at timestamp, updated_at timestamp"
    for step, part in enumerate((rows, [(1, 1, "changed text", "T1", 1, NOW, datetime(2024, 6, 1))])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        maintain(changed_sections(spark, str(tmp_path / "in")), str(tmp_path / "index"), str(tmp_path / "state")).awaitTermination()
        index = latest_rows(spark.read.parquet(str(tmp_path / "index")))
        words = {r.word for r in index.where("section_id = 1").collect()}
        assert ("changed" in words) == (step == 1) and ("word1" in words) == (step == 0)
    assert changed_schema and lexical.search_index(index, "shared").count() == 3


def test_popularity_over_time(spark):
    rows = [("a", datetime(2024, 5, 1, 10)), ("a", datetime(2024, 5, 1, 12)), ("b", datetime(2024, 5, 2, 11))]
    got = popularity(spark.createDataFrame(rows, "query string, created_at timestamp"), "24 hours", "24 hours").collect()
    assert sorted((r.query, r["count"]) for r in got) == [("a", 2), ("b", 1)]


def test_vectors_as_text(spark):
    from siftwell.functions.vectors import parsed

    rows = spark.createDataFrame([("[1, 2.5]",), ("[]",), ("no",), (None,)], "t string").select(parsed(F.col("t")).alias("v")).collect()
    assert [r.v for r in rows] == [[1.0, 2.5], [], None, None]


def test_tag_references(spark):
    from siftwell.operators.tags import resolved

    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    assert sorted(r.id for r in resolved(rows, [1, "b", "a"]).collect()) == [1, 2]
    for wrong in ([3], ["c"], [1.5]):
        with pytest.raises(ValueError):
            resolved(rows, wrong)
