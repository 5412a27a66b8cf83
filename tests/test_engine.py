import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siftwell.config import Config, SearchConfig, load
from siftwell.errors import DatabaseError, InvalidConfigError, InvalidParameterError, MissingConfigError
from siftwell.plans.engine import Engine
from siftwell.schemas import TABLES, language_configs, missing_references, repeated_keys, state_name, violations
from siftwell.sources import readers
from siftwell.sources.embeddings import embed, tally
from siftwell.sources.store import Store

NOW = datetime(2024, 5, 1, 12)
FILES = {
    "ruby.md": "# Ruby\nRuby is a programming language.\n## Gems\nGems are packages for ruby programs.",
    "python.md": "# Python\nPython is used for data science and machine learning.",
    "page.html": "<html><head><title>Cooking pasta</title><meta name='author' content='Ann'><meta name=\"keywords\" content=\"food, pasta\"></head><body><script>x</script><p>Boil water for the pasta and add salt before the pasta goes in.</p></body></html>",
}


def provider():
    """A function that counts words into a few dimensions; texts with common words are near. It is made here, so that workers get it by value."""

    def count(texts):
        out = []
        for text in texts:
            v = [0.0] * 32
            for w in text.lower().replace(".", " ").split():
                v[int(hashlib.md5(w.encode()).hexdigest(), 16) % 32] += 1.0
            out.append(v)
        return out

    return count


@pytest.fixture
def engine(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / "docs").mkdir(exist_ok=True)
        (tmp_path / "docs" / name).write_text(text)
    e = Engine(spark, Config(path=str(tmp_path / "kb"), search=SearchConfig(rerank_pool=64)), provider(), lambda prompt: '{"answer": "yes", "confidence": 0.9}', lambda: NOW)
    e.add_documents(str(tmp_path / "docs"))
    return e


def test_from_files_to_answers(engine, tmp_path):
    stats = engine.statistics()
    assert stats["document_count"] == 3 and stats["section_count"] == 3, stats
    assert stats["embedding_count"] == stats["section_count"]
    listed = engine.list_documents(per_page=2)
    assert len(listed["documents"]) == 2 and listed["total_pages"] == 2
    again = engine.add_documents(str(tmp_path / "docs"))
    assert again["failed"] == 0 and engine.statistics() == stats
    for kind in ("hybrid", "fulltext", "vector"):
        found = engine.search("ruby language", kind, 5)
        assert "error" not in found and found["results"][0]["content"].startswith("Ruby"), (kind, found)
        assert [r["rank"] for r in found["results"]] == list(range(1, found["total_count"] + 1))
    assert engine.search('"programming language" AND missing', "hybrid")["total_count"] > 0  # by vectors
    assert engine.search("x")["error"] and engine.search("x")["results"] == []
    with pytest.raises(InvalidParameterError):
        engine.search("ruby", "other")
    asked = engine.ask("what is ruby")
    assert asked["answer"] == "yes" and asked["sources"][0]["document_title"] == "Ruby"
    assert len(engine.search_logs()) >= 5 and engine.search_logs(search_type="vector")[0]["search_type"] == "vector"
    assert "ruby" in engine.suggestions("ru")


def test_search_forms_and_logs(engine, tmp_path):
    marked = engine.search_with_highlighting("ruby language")
    assert marked["results"][0]["snippet"].startswith("<mark>Ruby</mark> is a programming <mark>language")
    quick = engine.quick_search("ruby")
    assert quick and set(quick[0]) == {"section_id", "rank_score"} and engine.quick_search("x") == []
    assert engine.advanced_search("ruby", {"language": "zh"})["total_count"] == 0
    like = engine.similar_sections(quick[0]["section_id"])
    assert like[0]["section_id"] == quick[0]["section_id"] and like[0]["similarity"] == pytest.approx(1.0)
    engine.search("Ruby", "fulltext")
    logs = engine.search_logs()
    assert len({r["id"] for r in logs}) == len(logs) == 3 and all(r["id"] > 0 for r in logs)
    folder = engine.store.version("search_logs")
    engine.search("pasta", "fulltext")
    assert engine.store.version("search_logs") == folder and len(engine.search_logs()) == 4  # appended, not rewritten
    assert engine.remove_old_logs() == {"search_logs": 0} and engine.remove_old_embeddings(0) == {"embeddings": 0}


def test_ingest_replaces_a_document(engine, tmp_path):
    (tmp_path / "docs" / "ruby.md").write_text("# Ruby\nRuby is old.\n")
    assert engine.add_documents(str(tmp_path / "docs"), "ruby.md")["documents"] == 1
    texts = [r.content for r in engine.store.read("source_sections").collect()]
    assert len(texts) == 3 and not any("Gems" in t for t in texts) and any("Ruby is old" in t for t in texts)
    assert engine.statistics()["embedding_count"] == 3


def test_topic_life(engine):
    engine.create_tags(["a", "b", "c"])
    ids = {t["name"]: t["id"] for t in engine.list_tags()["tags"]}
    topic = engine.create_topic("One", "first", [ids["a"], ids["b"]])
    assert engine.get_topic(topic)["tag_ids"] == sorted([ids["a"], ids["b"]]) and engine.get_topic(99) is None
    changed = engine.update_topic(topic, name="Two", tag_ids=[ids["c"]])
    assert (changed["name"], changed["description"], changed["tag_ids"]) == ("Two", "first", [ids["c"]]) and engine.update_topic(99) is None
    assert engine.delete_topic(topic)["research_topic_tags"] == 1 and engine.list_topics()["total"] == 0


def test_tags_topics_and_removal(engine):
    doc = next(d for d in engine.list_documents()["documents"] if d["title"] == "Ruby")
    sections = [r.id for r in engine.store.read("source_sections").where(F.col("document_id") == doc["id"]).collect()]
    engine.create_tags({"code": ["ruby", "python"]})
    names = {t["name"]: t["id"] for t in engine.list_tags()["tags"]}
    engine.tag_sections(sections, [names["ruby"]])
    assert engine.search("ruby", "fulltext", filters={"tag_names": ["ruby"]})["total_count"] == len(sections)
    assert engine.search("ruby", "fulltext", filters={"tag_names": ["python"]})["total_count"] == 0
    assert engine.search("ruby", "vector", search_tags=[names["ruby"]])["results"][0]["boosted_score"] > 0
    topic = engine.create_topic("Languages", tag_ids=[names["ruby"], names["python"]])
    assert engine.add_document_to_topic(topic, doc["id"]) == {"added_sections": len(sections)}
    assert engine.add_document_to_topic(topic, doc["id"]) == {"added_sections": 0}
    assert engine.topic_recommendations(doc["id"]) == [{"research_topic_id": topic, "matching_tags": 1}]
    assert engine.list_topics()["topics"][0]["section_count"] == len(sections)
    assert engine.get_document(doc["id"])["section_count"] == len(sections) and engine.get_document("abc") is None
    gone = engine.remove_document(doc["id"])
    assert gone["source_documents"] == 1 and gone["source_sections"] == gone["embeddings"] == gone["section_tags"] == len(sections)
    assert engine.get_document(doc["id"]) is None and engine.store.read("research_topic_sections").count() == 0
    assert engine.generate_tags("text") == {"categories": [], "content_tags": []}


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.create()
    assert store.read("text_search_configs").count() == 17
    tags = lambda *rows: spark.createDataFrame([(*r, NOW) for r in rows], TABLES["tags"].schema)
    store.upsert("tags", tags((1, "a", None), (2, "b", 1)))
    store.upsert("tags", tags((2, "B", 1), (3, "c", 2)))
    assert {r.id: r.name for r in store.read("tags").collect()} == {1: "a", 2: "B", 3: "c"}
    assert store.delete("tags", F.col("id") == 1) == {"tags": 1, "section_tags": 0, "research_topic_tags": 0}
    assert {r.id: r.parent_id for r in store.read("tags").collect()} == {2: None, 3: 2}
    for change in (store.write, store.append):
        with pytest.raises(DatabaseError):
            change("tags", tags((9, " ", None)))
    assert store.vacuum("tags") >= 2 and store.read("tags").count() == 2
    assert store.insert_missing("tags", tags((3, "c", None), (4, "d", None))) == 1
    store.truncate()
    assert store.read("tags").count() == 0
    with pytest.raises(DatabaseError):
        store.read("nothing")


def test_rules(spark):
    rows = spark.createDataFrame([(1, "a", None, NOW), (2, None, 2, NOW), (2, "x" * 256, 7, NOW)], TABLES["tags"].schema)
    assert sorted(r.broken for r in violations(rows, "tags").collect()) == [["name"], ["name", "parent_id"]]
    assert repeated_keys(rows, "tags").first()["id"] == 2
    assert [r.parent_id for r in missing_references(rows, "tags", {"tags": rows}).collect()] == [7]
    assert language_configs(spark).count() == 17
    assert [spark.range(1).select(state_name(F.lit(k))).first()[0] for k in (0, 1, 2, 9)] == ["pending", "completed", "failed", None]


def test_readers(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "bad.xyz").write_bytes(b"\x00")
    docs = {r.url.rsplit("/", 1)[-1]: r for r in readers.documents(spark, str(tmp_path), converters={"xyz": lambda raw: 1 / 0}).collect()}
    assert docs["page.html"].title == "Cooking pasta" and docs["page.html"].author == "Ann" and docs["page.html"].content == "Boil water for the pasta and add salt before the pasta goes in."
    assert docs["ruby.md"].title == "Ruby" and docs["bad.xyz"].download_state == 2 and "ZeroDivisionError" in docs["bad.xyz"].error
    named = readers.documents(spark, str(tmp_path), "*.md", options={"title": "T", "metadata": {"author": "B"}}).collect()
    assert {(r.title, r.author) for r in named} == {("T", "B")}
    listed = readers.manifest(spark, [{"file": "ruby.md", "title": "R", "tags": ["x"]}, {"file": "none.md"}], str(tmp_path / "*.md"))
    assert {(r.file, r.content is None) for r in listed.collect()} == {("ruby.md", False), ("none.md", True)}
    (tmp_path / "rows.json").write_text('{"title": "a", "content": "1", "url": "u1"}\n{"title": "a", "content": "2", "url": "u0"}\n{"title": "known", "content": "3"}\n')
    known = spark.createDataFrame([("known",)], "title string")
    assert [(r.title, r.content) for r in readers.import_json(spark, str(tmp_path / "rows.json"), known).collect()] == [("a", "2")]


def test_embedding_failures_stay_with_their_rows(spark):
    rows = spark.createDataFrame([(1, "t", 1, "good"), (2, None, None, "bad"), (3, " ", 3, "fine")], "id long, section_title string, section_number int, content string")

    def picky(texts):
        if any("bad" in t for t in texts):
            raise OSError("no")
        return [[float(len(t))] for t in texts]

    done = embed(rows, picky, attempts=1)
    got = {r.source_id: (r.vector, r.error) for r in done.collect()}
    assert got[2][0] is None and "OSError" in got[2][1] and got[1] == ([float(len("Title: t\n\nSection: 1\n\ngood"))], None)
    assert tally(done).first().asDict() == {"success": 2, "failed": 1}


def test_config(tmp_path, monkeypatch):
    path = tmp_path / "c.json"
    path.write_text('{"default": {"path": "${KB:-/x}", "search": {"alpha": 0.6}}, "test": {"search": {"limit": 5}}}')
    monkeypatch.setenv("KB", "/kb")
    c = load(str(path), "test")
    assert (c.path, c.search.alpha, c.search.limit) == ("/kb", 0.6, 5)
    path.write_text('{"search": {"alpha": 3}}')
    with pytest.raises(InvalidConfigError):
        load(str(path))
    with pytest.raises(MissingConfigError):
        load(str(tmp_path / "none.json"))


def test_tag_names_filter_has_no_limit(spark):
    from siftwell.plans.engine import filtered

    ids = spark.range(10_050)
    own = ids.selectExpr("id AS section_id", "id AS tag_id")
    tag_table = ids.selectExpr("id", "'guide' AS name")
    assert filtered(ids.selectExpr("id AS section_id"), {"tag_names": ["guide"]}, own, tag_table).count() == 10_050
