"""Queries over a stored knowledge base, and over what a user changes or looks up in one, with the same in SQL.

The tables play the same parts as in ``queries``; what is written goes to a
folder of its own below ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.vectors import parsed
from siftwell.operators import fusion, lexical, logs, relational, tags, vector
from siftwell.plans.queries import FOREST, LOGS, Q0, SIM, TAGS, W, bm25_sql, forest, label_tags, query, search_logs, sections, table, tf, vector_of, vectors
from siftwell.schemas import LANGUAGE_CONFIGS
from siftwell.sources.readers import import_json
from siftwell.sources.store import Store

NOW = datetime(2024, 5, 1)


def scratch(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share; in local runs without one a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="knowledge-")
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"


def knowledge(spark: SparkSession, sf: str) -> Store:
    """Documents with one section each, their vectors and tags; ids of sections are 10 larger."""
    store = Store(spark, scratch(spark))
    docs = table(spark, sf, "documents")
    store.write("source_documents", docs.selectExpr("doc_id AS id", "concat('Document ', doc_id) AS title", "cast(null AS string) AS url", "cast(null AS string) AS author", "cast(null AS date) AS publication_date", "lang AS language", "source AS description", "1 AS download_state", "cast(null AS string) AS metadata", "cast(null AS timestamp) AS created_at", "cast(null AS timestamp) AS updated_at"))
    store.append("source_sections", docs.selectExpr("doc_id + 10 AS id", "doc_id AS document_id", "concat('Text ', coalesce(text, '')) AS content", "1 AS section_number"))
    store.append("embeddings", table(spark, sf, "embeddings").selectExpr("vec_id AS id", "vec_id + 10 AS source_id", "embedding AS vector"))
    store.append("section_tags", label_tags(spark, sf).selectExpr("section_id + 10 AS section_id", "tag_id"))
    return store


def stored_logs(spark: SparkSession, sf: str) -> Store:
    """Search logs, appended in two batches."""
    store = Store(spark, scratch(spark))
    rows = search_logs(spark, sf).withColumn("execution_time_ms", F.abs("execution_time_ms").cast("int"))
    for half in (0, 1):
        store.append("search_logs", rows.where(F.pmod("id", F.lit(2)) == half))
    return store


def counts(store: Store, *names: str) -> DataFrame:
    return relational.table_counts({name: store.read(name) for name in names})


# The store


@query("""WITH gone AS (SELECT doc_id FROM documents WHERE lang = 'de'), st AS (SELECT DISTINCT doc_id, 1 AS t FROM labels WHERE quality = 1 UNION ALL SELECT DISTINCT doc_id, 2 FROM labels WHERE toxic = 1)
    SELECT 'source_documents' AS name, count(*) AS count FROM documents WHERE lang IS DISTINCT FROM 'de' UNION ALL SELECT 'source_sections', count(*) FROM documents WHERE lang IS DISTINCT FROM 'de'
    UNION ALL SELECT 'embeddings', count(*) FROM embeddings WHERE vec_id NOT IN (FROM gone) UNION ALL SELECT 'section_tags', count(*) FROM st WHERE doc_id NOT IN (FROM gone)""")
def store_delete_cascade(spark, sf):
    store = knowledge(spark, sf)
    store.delete("source_documents", F.col("language") == "de")
    return counts(store, "source_documents", "source_sections", "embeddings", "section_tags")


@query("SELECT vec_id AS id, vec_id + 10 AS source_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def store_delete_keys(spark, sf):
    """The vectors of labelled documents' sections go."""
    store = knowledge(spark, sf)
    store.delete_keys("embeddings", table(spark, sf, "labels").selectExpr("doc_id + 10 AS source_id"), ("source_id",))
    return store.read("embeddings").select("id", "source_id")


@query(f"WITH {LOGS} SELECT id, query, search_type FROM l WHERE created_at >= (SELECT max(created_at) FROM l) - INTERVAL 7 DAY")
def store_delete_older(spark, sf):
    store = stored_logs(spark, sf)
    (last,) = store.read("search_logs").agg(F.max("created_at")).first()
    store.delete_older("search_logs", last, 7)
    return store.read("search_logs").select("id", "query", "search_type")


@query(f"WITH {FOREST} SELECT id, name, CASE WHEN parent_id >= 3 THEN parent_id END AS parent_id FROM f WHERE id >= 3")
def store_delete_parents(spark, sf):
    """Tags whose parent goes become roots."""
    store = Store(spark, scratch(spark))
    store.append("tags", forest(spark, sf))
    store.delete("tags", F.col("id") < 3)
    return store.read("tags").select("id", "name", "parent_id")


@query("SELECT s_suppkey::BIGINT AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'new ' || s_name ELSE s_name END AS name FROM supplier UNION ALL SELECT n_nationkey + 100000, n_name FROM nation")
def store_upsert(spark, sf):
    """Of rows with one key the last written stays."""
    store = Store(spark, scratch(spark))
    old = table(spark, sf, "supplier").selectExpr("cast(s_suppkey AS long) AS id", "s_name AS name")
    new = old.where("id % 3 = 0").selectExpr("id", "concat('new ', name) AS name").unionByName(table(spark, sf, "nation").selectExpr("cast(n_nationkey AS long) + 100000 AS id", "n_name AS name"))
    for rows in (old, new):
        store.upsert("tags", rows)
    return store.read("tags").select("id", "name")


@query("SELECT DISTINCT lang AS language_code, 'pg_catalog.simple' AS config_name FROM documents")
def store_configs(spark, sf):
    """Language configurations after those of the documents' languages were replaced."""
    store = Store(spark, scratch(spark))
    found = table(spark, sf, "documents").selectExpr("lang AS language_code", "'pg_catalog.simple' AS config_name", "true AS is_installed")
    store.append("text_search_configs", spark.createDataFrame([(a, b, True) for a, b in LANGUAGE_CONFIGS], "language_code string, config_name string, is_installed boolean"))
    store.upsert("text_search_configs", found)
    return relational.present(store.read("text_search_configs"), found, "language_code").select("language_code", "config_name")


@query(f"WITH {LOGS} SELECT search_type, count(*) AS count, min(id) AS first, max(id) AS last FROM l GROUP BY 1")
def store_append(spark, sf):
    return stored_logs(spark, sf).read("search_logs").groupBy("search_type").agg(F.count("*").alias("count"), F.min("id").alias("first"), F.max("id").alias("last"))


@query(f"WITH {TAGS} SELECT section_id, tag_id::BIGINT AS tag_id, (SELECT count(*) FROM st WHERE tag_id = 2) AS added FROM st")
def store_insert_missing(spark, sf):
    """Pairs that are there already aren't added or counted."""
    store, pairs = Store(spark, scratch(spark)), label_tags(spark, sf)
    store.append("section_tags", pairs.where("tag_id = 1"))
    added = store.insert_missing("section_tags", pairs)
    return store.read("section_tags").select("section_id", "tag_id", F.lit(added).cast("long").alias("added"))


@query("WITH t AS (SELECT split_part(text, chr(10), 1) AS title, 'u' || doc_id AS url, lang FROM documents WHERE text IS NOT NULL) SELECT title, min(url) AS url FROM t WHERE title NOT IN (SELECT title FROM t WHERE lang = 'fr') GROUP BY 1")
def import_rows(spark, sf):
    """Documents as JSON lines, of which titles of French ones are known."""
    rows = table(spark, sf, "documents").where("text IS NOT NULL").select(F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"), F.concat(F.lit("u"), "doc_id").alias("url"), F.col("lang").alias("language"))
    folder = scratch(spark)
    rows.write.json(folder)
    return import_json(spark, folder, rows.where("language = 'fr'")).select("title", "url")


# Search


def snippet_sql(content: str, terms: list[str]) -> str:
    """Columns of a table x with ``content``: the snippet of ``lexical.highlight``."""
    own = ", ".join(f"'{t}'" for t in terms)
    return rf"""y AS (SELECT *, string_split(trim(regexp_replace({content}, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' '), ' ') AS sp FROM x),
        z AS (SELECT *, list_transform(sp, lambda w: list_contains([{own}], lower(regexp_replace(w, '[^\p{{L}}\p{{N}}_]', '', 'g')))) AS hit FROM y),
        h AS (SELECT *, list_transform(range(len(sp)), lambda i: CASE WHEN hit[i + 1] THEN '<mark>' || sp[i + 1] || '</mark>' ELSE sp[i + 1] END) AS marked, list_sort(list_distinct(list_transform(list_filter(range(len(sp)), lambda i: hit[i + 1]), lambda i: i // 16)))[1:3] AS win FROM z),
        snip AS (SELECT *, array_to_string(list_transform(CASE WHEN len(win) > 0 THEN win ELSE [0] END, lambda k: array_to_string(marked[k * 16 + 1 : k * 16 + 16], ' ')), ' ... ') AS snippet FROM h)"""


@query(f"WITH {W}, {bm25_sql(['the', 'of'], "list_contains(cw, 'the') OR list_contains(cw, 'of') OR list_contains(tw, 'the') OR list_contains(tw, 'of')", 20)}, x AS (SELECT m.*, content FROM m JOIN s USING (section_id)), {snippet_sql('content', ['the', 'of'])} SELECT section_id, round(rank_score, 4) AS rank_score, snippet FROM snip")
def text_search_snippets(spark, sf):
    found = lexical.search_with_snippets(sections(spark, sf), "the of", 20)
    return found.select("section_id", F.round("rank_score", 4).alias("rank_score"), "snippet")


@query(f"WITH {W}, x AS (SELECT section_id, coalesce(content, '') AS content FROM s), {snippet_sql('content', ['the', 'und'])} SELECT section_id, snippet FROM snip")
def text_snippets(spark, sf):
    """Of all sections, those without a hit too."""
    return sections(spark, sf).select("section_id", lexical.highlight(F.coalesce("content", F.lit("")), ["the", "und"]).alias("snippet"))


@query(f"WITH {W}, {bm25_sql(['und'], "list_contains(cw, 'und') OR list_contains(tw, 'und')", 10)} SELECT section_id, round(rank_score, 4) AS rank_score FROM m")
def text_quick(spark, sf):
    return lexical.quick(sections(spark, sf), "und").select("section_id", F.round("rank_score", 4).alias("rank_score"))


@query(f"WITH {SIM}, t AS (SELECT * FROM v ORDER BY sim DESC, id LIMIT 100), {TAGS} SELECT id, label, round(sim, 4) AS similarity FROM t WHERE label IN (1, 2, 3) AND id IN (SELECT section_id FROM st)")
def vector_filtered_after(spark, sf):
    (q,) = vector_of(spark, sf, 0)
    found = vector.filtered_after(vectors(spark, sf), q, 100, label_tags(spark, sf).select(F.col("section_id").alias("id")), {"label": [1, 2, 3]})
    return found.select("id", "label", F.round("similarity", 4).alias("similarity"))


@query(f"WITH {SIM}, {TAGS}, t AS (SELECT * FROM v ORDER BY sim DESC, id LIMIT 50), m AS (SELECT section_id, list_sort(list(tag_id::BIGINT)) AS tags FROM st GROUP BY 1) SELECT id, round(sim * CASE WHEN tags IS NULL THEN 1 ELSE 1.2 END, 4) AS boosted_score, coalesce(array_to_string(tags, ','), '') AS matching FROM t LEFT JOIN m ON id = section_id")
def vector_boost_variant(spark, sf):
    (q,) = vector_of(spark, sf, 0)
    found = vector.boosted(vector.nearest(vectors(spark, sf), q, 50), label_tags(spark, sf), [1, 2], 1.2)
    return found.select("id", F.round("boosted_score", 4).alias("boosted_score"), F.array_join("matching_tags", ",").alias("matching"))


@query(f"WITH v AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], {Q0.replace('vec_id = 0', 'vec_id = 3')}) AS sim FROM embeddings) SELECT id, round(sim, 4) AS similarity FROM v ORDER BY sim DESC, id LIMIT 10")
def vector_cross_modal(spark, sf):
    (q,) = vector_of(spark, sf, 3)
    return vector.cross_modal(vectors(spark, sf), q).select("id", F.round("similarity", 4).alias("similarity"))


@query(f"WITH v AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], {Q0.replace('vec_id = 0', 'vec_id = 9')}) AS sim FROM embeddings) SELECT id AS section_id, round(sim, 4) AS similarity FROM v ORDER BY sim DESC, id LIMIT 5")
def section_like(spark, sf):
    own = vectors(spark, sf).withColumnRenamed("id", "section_id")
    return vector.like_section(sections(spark, sf), own, 9).select("section_id", F.round("similarity", 4).alias("similarity"))


@query(f"WITH {W}, g AS (SELECT section_id, content FROM s WHERE content IS NOT NULL AND len(content) > 20) SELECT section_id, NULL::DOUBLE AS similarity FROM s WHERE section_id <> (SELECT max(section_id) FROM g) AND contains(content, substring((SELECT content FROM g ORDER BY section_id DESC LIMIT 1), 1, 4)) ORDER BY 1 LIMIT 5")
def section_like_text(spark, sf):
    """A section without a vector: others that contain the beginning of its text, here of four characters."""
    own = sections(spark, sf)
    (last,) = own.where("content IS NOT NULL AND char_length(content) > 20").agg(F.max("section_id")).first()
    return vector.like_section(own, vectors(spark, sf).withColumnRenamed("id", "section_id").where(F.col("section_id") != last), last, shown=4)


@query("SELECT vec_id AS id, len(embedding) AS dimensions, round(list_sum(embedding::DOUBLE[]), 4) + 0.0 AS total FROM embeddings")
def vector_parsed(spark, sf):
    """Vectors written out as text and read back."""
    text = F.concat(F.lit("["), F.array_join(F.transform("vector", lambda x: x.cast("string")), ","), F.lit("]"))
    back = vectors(spark, sf).select("id", parsed(text).alias("vector"))
    return back.select("id", F.size("vector").cast("long").alias("dimensions"), (F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double")), 4) + 0.0).alias("total"))


@query(f"WITH {LOGS}, p AS (SELECT l.id, list_cosine_similarity(embedding::DOUBLE[], {Q0}) AS sim FROM l JOIN embeddings ON vec_id = l.id WHERE results_count > 0) SELECT id, round(sim, 4) AS similarity FROM p WHERE sim > 0.7 ORDER BY sim DESC, id LIMIT 10")
def log_alike(spark, sf):
    """Earlier queries with results whose vectors are near one; each query has the vector of its number."""
    (q,) = vector_of(spark, sf, 0)
    own = search_logs(spark, sf).join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("query_vector")), "id")
    return logs.alike(own, q).select("id", F.round("similarity", 4).alias("similarity"))


@query("SELECT o_orderkey AS id, o_totalprice % 500 AS asked, least(greatest(CAST(floor(o_totalprice % 500) AS INT), 1), 100) AS shown FROM orders")
def limits_clamped(spark, sf):
    """Limits that users ask for, of which a search takes 1 to 100."""
    asked = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") % 500).alias("asked"))
    return asked.withColumn("shown", F.least(F.greatest(F.floor("asked").cast("int"), F.lit(fusion.clamp_limit(-5))), F.lit(fusion.clamp_limit(10**6))))


# Lookups


@query(f"WITH {FOREST} SELECT id, name, parent_id FROM f WHERE id IN (1, 1002) OR name IN ('ASIA', 'Supplier#000000003')")
def tag_references(spark, sf):
    return tags.resolved(forest(spark, sf), [1, 1002, "ASIA", "Supplier#000000003"]).select("id", "name", "parent_id")


@query(f"WITH {FOREST}, own AS (SELECT id, parent_id FROM f WHERE id IN (100001, 100002)), up AS (SELECT f.id, f.parent_id FROM f JOIN own ON f.id = own.parent_id), top AS (SELECT f.id FROM f JOIN up ON f.id = up.parent_id) SELECT DISTINCT id, name FROM f WHERE id IN (SELECT id FROM own UNION SELECT id FROM up UNION SELECT id FROM top)")
def tag_of_section(spark, sf):
    """The tags of a section, which has two suppliers, and all above them."""
    bridge = table(spark, sf, "supplier").where("s_suppkey IN (1, 2)").selectExpr("7L AS section_id", "cast(s_suppkey AS long) + 100000 AS tag_id")
    return tags.tags_of_section(forest(spark, sf), bridge, 7, with_ancestors=True).select("id", "name")


@query(f"WITH {TAGS} SELECT section_id, array_to_string(list_sort(list(CASE tag_id WHEN 1 THEN 'quality' ELSE 'toxic' END)), ',') AS tags FROM st GROUP BY 1")
def tag_names(spark, sf):
    names = spark.createDataFrame([(1, "quality"), (2, "toxic")], "id long, name string")
    return tags.tag_lists(label_tags(spark, sf), names).select("section_id", F.array_join("tags", ",").alias("tags"))


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 1)")
def topic_by_tag(spark, sf):
    """Parts play topics, suppliers their tags."""
    topics = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    bridge = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("research_topic_id"), F.col("l_suppkey").alias("tag_id"))
    return tags.topics_by_tag(topics, bridge, 1)


@query("SELECT p_partkey AS id, p_name AS name, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS section_count FROM part WHERE contains(lower(p_name), 'cold')")
def topic_named(spark, sf):
    topics = relational.counted(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), table(spark, sf, "lineitem"), "id", "l_partkey")
    return relational.containing(topics, "COLD", "name", ignore_case=True)


@query("SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC LIMIT 25")
def newest_rows(spark, sf):
    return relational.newest(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at")), 25)


@query("SELECT event_id AS id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE")
def fresh_rows(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"))
    (last,) = rows.agg(F.max("created_at")).first()
    return relational.fresh(rows, "created_at", last, timedelta(minutes=30)).select("id")


@query("SELECT (SELECT count(*) > 0 FROM lineitem WHERE l_partkey = 3 AND l_suppkey = 1) AS linked, (SELECT count(*) > 0 FROM lineitem WHERE l_partkey = -1) AS unknown")
def existence(spark, sf):
    own = table(spark, sf, "lineitem")
    return relational.exists(own, {"l_partkey": 3, "l_suppkey": 1}, "linked").crossJoin(relational.exists(own, {"l_partkey": -1}, "unknown"))


@query(f"WITH {LOGS} SELECT count(*) AS total, round(avg(execution_time_ms), 4) AS avg_time, count(*) FILTER (coalesce(results_count, 0) > 0) AS successful, count(*) FILTER (coalesce(results_count, 0) <= 0) AS failed FROM l WHERE created_at BETWEEN (SELECT min(ts) + INTERVAL 5 DAY FROM events) AND (SELECT min(ts) + INTERVAL 12 DAY FROM events)")
def log_period_week(spark, sf):
    """The logs of a week, whatever their ids."""
    rows = search_logs(spark, sf)
    (first,) = rows.agg(F.min("created_at")).first()
    return logs.period(rows, first + timedelta(days=5), first + timedelta(days=12))


@query(f"WITH {LOGS} SELECT id, results_count FROM l WHERE results_count > 3")
def log_many_results(spark, sf):
    return logs.with_many_results(search_logs(spark, sf), 3).select("id", "results_count")
