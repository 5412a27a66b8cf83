"""Queries over the test tables, one or more for each operator, with the same in SQL.

Documents play sections: their first line is the title and their source the
category; ``quality`` and ``toxic`` labels are tags; ``events`` are search
logs; regions, nations, customers and suppliers are a forest of tags.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.functions.vectors import cosine, literal, mean
from siftwell.operators import chunking, fusion, lexical, logs, relational, tags, vector
from siftwell.plans import answer, engine
from siftwell.plans.query import relax
from siftwell.schemas import LANGUAGE_CONFIGS, violations
from siftwell.sources import embeddings as embedding_source
from siftwell.sources.readers import html_metadata
from siftwell.streaming import index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sections(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("section_id"), F.col("doc_id").alias("document_id"), F.substring_index("text", "\n", 1).alias("section_title"), F.col("text").alias("content"), F.col("lang").alias("language"), F.col("source").alias("category"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def vector_of(spark: SparkSession, sf: str, *ids: int) -> list[list[float]]:
    rows = table(spark, sf, "embeddings").where(F.col("vec_id").isin(list(ids))).select("vec_id", "embedding").collect()
    found = {r[0]: [float(x) for x in r[1]] for r in rows}
    return [found[i] for i in ids]


def label_tags(spark: SparkSession, sf: str) -> DataFrame:
    """section_id and tag_id: 1 for quality, 2 for toxic documents."""
    labels = table(spark, sf, "labels")
    on = [F.when(F.col(c) == 1, F.lit(k).cast("long")) for k, c in ((1, "quality"), (2, "toxic"))]
    return labels.select(F.col("doc_id").alias("section_id"), F.explode(F.array_compact(F.array(*on))).alias("tag_id")).distinct()


def forest(spark: SparkSession, sf: str) -> DataFrame:
    """id, name and parent_id: regions, nations below them, suppliers below those."""
    r, n, s = (table(spark, sf, t) for t in ("region", "nation", "supplier"))
    parts = [
        r.select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("long").alias("parent_id")),
        n.select((F.col("n_nationkey") + 1000).cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("parent_id")),
        s.select((F.col("s_suppkey") + 100000).cast("long").alias("id"), F.col("s_name").alias("name"), (F.col("s_nationkey") + 1000).cast("long").alias("parent_id")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def search_logs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    kind = F.element_at(F.array(F.lit("vector"), F.lit("fulltext"), F.lit("hybrid")), (F.pmod(F.col("event_id"), F.lit(3)) + 1).cast("int"))
    count = F.when(F.pmod(F.col("event_id"), F.lit(11)) == 0, F.lit(None).cast("int")).otherwise(F.pmod(F.col("event_id"), F.lit(5)).cast("int"))
    return e.select(F.col("event_id").alias("id"), F.concat_ws(" ", "event_type", F.pmod(F.col("user_id"), F.lit(20)).cast("string")).alias("query"), kind.alias("search_type"), F.col("value").alias("execution_time_ms"), count.alias("results_count"), F.col("props").alias("filters"), F.col("ts").alias("created_at"))


S = "s AS (SELECT doc_id AS section_id, doc_id AS document_id, split_part(text, chr(10), 1) AS section_title, text AS content, lang AS language, source AS category FROM documents)"
W = S + r""", w AS (SELECT *, list_transform(regexp_extract_all(section_title, '[\p{L}\p{N}_]+'), lambda x: lower(x)) AS tw, list_transform(regexp_extract_all(content, '[\p{L}\p{N}_]+'), lambda x: lower(x)) AS cw FROM s)"""
Q0 = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
SIM = f"v AS (SELECT vec_id AS id, label, list_cosine_similarity(embedding::DOUBLE[], {Q0}) AS sim FROM embeddings)"
TAGS = "st AS (SELECT DISTINCT doc_id AS section_id, 1 AS tag_id FROM labels WHERE quality = 1 UNION ALL SELECT DISTINCT doc_id, 2 FROM labels WHERE toxic = 1)"
FOREST = "f AS (SELECT r_regionkey::BIGINT AS id, r_name AS name, NULL::BIGINT AS parent_id FROM region UNION ALL SELECT n_nationkey + 1000, n_name, n_regionkey FROM nation UNION ALL SELECT s_suppkey + 100000, s_name, s_nationkey + 1000 FROM supplier)"
LOGS = "l AS (SELECT event_id AS id, event_type || ' ' || (user_id % 20)::VARCHAR AS query, ['vector', 'fulltext', 'hybrid'][(event_id % 3 + 1)::INT] AS search_type, value AS execution_time_ms, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 5 END AS results_count, props AS filters, ts AS created_at FROM events)"


def tf(word: str, field: str) -> str:
    return f"len(list_filter({field}, lambda x: x = '{word}'))"


def bm25_sql(words: list[str], match: str, limit: int = 20, where: str = "true") -> str:
    has = ", ".join(f"count(*) FILTER (list_contains(tw, '{x}') OR list_contains(cw, '{x}')) AS df{k}" for k, x in enumerate(words))
    score = " + ".join(f"ln(1 + (n - df{k} + 0.5) / (df{k} + 0.5)) * (1.0 * {tf(x, 'tw')} + 0.4 * {tf(x, 'cw')}) * 2.2 / ((1.0 * {tf(x, 'tw')} + 0.4 * {tf(x, 'cw')}) + 1.2 * (0.25 + 0.75 * (len(tw) + len(cw)) / al))" for k, x in enumerate(words))
    return f"""c AS (SELECT * FROM w WHERE {where}), g AS (SELECT count(*) AS n, avg(len(tw) + len(cw)) AS al, {has} FROM c),
        m AS (SELECT section_id, {score} AS rank_score FROM c, g WHERE {match} ORDER BY rank_score DESC, section_id LIMIT {limit})"""


# Vectors


@query(f"WITH {SIM} SELECT id, round(sim, 4) AS similarity, row_number() OVER (ORDER BY sim DESC, id) AS rank FROM v ORDER BY sim DESC, id LIMIT 10")
def vector_knn(spark, sf):
    (q,) = vector_of(spark, sf, 0)
    found = vector.rank(vector.nearest(vectors(spark, sf), q, 10))
    return found.select("id", F.round("similarity", 4).alias("similarity"), "rank")


@query(f"WITH {SIM} SELECT id, round(sim, 4) AS similarity FROM v WHERE sim > 0.2 ORDER BY sim DESC, id LIMIT 50")
def vector_range(spark, sf):
    (q,) = vector_of(spark, sf, 0)
    return vector.within(vectors(spark, sf), q, 0.8, 50).select("id", F.round("similarity", 4).alias("similarity"))


@query(f"WITH {SIM}, t AS (SELECT * FROM v ORDER BY sim DESC, id LIMIT 10), b AS (SELECT max(sim) AS m FROM t) SELECT id, round(sim, 4) AS similarity FROM t, b WHERE sim > CASE WHEN m > 0.3 THEN 0.3 WHEN m > 0.1 THEN 0.1 ELSE -2 END")
def vector_cascade(spark, sf):
    (q,) = vector_of(spark, sf, 0)
    return vector.cascade(vectors(spark, sf), q, 10).select("id", F.round("similarity", 4).alias("similarity"))


@query("WITH q AS (SELECT list(x ORDER BY k) AS q FROM (SELECT k, avg(e[k]) AS x FROM (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IN (0, 1, 2)), range(1, 65) t(k) GROUP BY k)) SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], q), 4) AS similarity FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], q) DESC, vec_id LIMIT 10")
def vector_multi_average(spark, sf):
    return vector.many_vectors(vectors(spark, sf), vector_of(spark, sf, 0, 1, 2), 10).select("id", F.round("similarity", 4).alias("similarity"))


@query("WITH q AS (SELECT list(x ORDER BY k) AS q FROM (SELECT k, sum(e[k] * CASE vec_id WHEN 0 THEN 0.7 ELSE 0.3 END) AS x FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IN (0, 1)), range(1, 65) t(k) GROUP BY k)) SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], q), 4) AS similarity FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], q) DESC, vec_id LIMIT 10")
def vector_multi_weighted(spark, sf):
    return vector.many_vectors(vectors(spark, sf), vector_of(spark, sf, 0, 1), 10, "weighted", [0.7, 0.3]).select("id", F.round("similarity", 4).alias("similarity"))


@query(f"WITH {SIM}, {TAGS}, t AS (SELECT * FROM v ORDER BY sim DESC, id LIMIT 40), m AS (SELECT section_id, count(*) AS n FROM st WHERE tag_id IN (1, 2) GROUP BY 1) SELECT id, round(sim * CASE WHEN n IS NULL THEN 1 ELSE 1.1 END, 4) AS boosted_score, coalesce(n, 0) AS matching FROM t LEFT JOIN m ON id = section_id ORDER BY sim * CASE WHEN n IS NULL THEN 1 ELSE 1.1 END DESC, id LIMIT 20")
def vector_tag_boost(spark, sf):
    (q,) = vector_of(spark, sf, 0)
    found = vector.boosted(vector.nearest(vectors(spark, sf), q, 40), label_tags(spark, sf), [1, 2], limit=20)
    return found.select("id", F.round("boosted_score", 4).alias("boosted_score"), F.size("matching_tags").alias("matching"))


@query("WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id < 5), p AS (SELECT query_id, vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], q) AS s FROM embeddings, q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM p) SELECT query_id, id, round(s, 4) AS similarity, rank FROM r WHERE rank <= 5")
def vector_for_each(spark, sf):
    asked = table(spark, sf, "embeddings").where("vec_id < 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return vector.for_each(asked, vectors(spark, sf), 5).select("query_id", "id", F.round("similarity", 4).alias("similarity"), "rank")


@query("SELECT label, k AS dimension, round(avg(e[k]), 4) + 0.0 AS mean FROM (SELECT label, embedding::DOUBLE[] AS e FROM embeddings), range(1, 65) t(k) GROUP BY ALL")
def vector_average_by_label(spark, sf):
    rows = vector.average_by(vectors(spark, sf), "label", 64).select("label", F.posexplode("mean_vector").alias("k", "m"))
    return rows.select("label", (F.col("k") + 1).alias("dimension"), (F.round("m", 4) + 0.0).alias("mean"))


@query(f"WITH {SIM} SELECT count(*) AS rows, round(sum(sim), 2) AS total, round(min(sim), 4) AS lowest FROM v")
def vector_cosine(spark, sf):
    (q,) = vector_of(spark, sf, 0)
    return vectors(spark, sf).select(cosine(F.col("vector"), literal(mean([q]))).alias("s")).agg(F.count("*").alias("rows"), F.round(F.sum("s"), 2).alias("total"), F.round(F.min("s"), 4).alias("lowest"))


@query("WITH v AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)) AS sim FROM embeddings) SELECT id, round(sim, 4) AS similarity FROM v ORDER BY sim DESC, id LIMIT 5")
def vector_like_row(spark, sf):
    return vector.like_row(vectors(spark, sf), 7).select("id", F.round("similarity", 4).alias("similarity"))


# Full text


@query(f"WITH {W}, {bm25_sql(['the', 'und', 'pour'], "list_contains(tw, 'the') OR list_contains(cw, 'the') OR list_contains(cw, 'und') OR list_contains(cw, 'pour') OR list_contains(tw, 'und') OR list_contains(tw, 'pour')")} SELECT section_id, round(rank_score, 4) AS rank_score FROM m")
def text_any_word(spark, sf):
    return lexical.search(sections(spark, sf), "the und pour").select("section_id", F.round("rank_score", 4).alias("rank_score"))


@query(f"WITH {W}, {bm25_sql(['the', 'of'], "list_contains(list_concat(tw, cw), 'the') AND list_contains(list_concat(tw, cw), 'of') AND NOT list_contains(list_concat(tw, cw), 'was')", 30)} SELECT section_id, round(rank_score, 4) AS rank_score FROM m")
def text_and_not(spark, sf):
    return lexical.search(sections(spark, sf), "the AND of NOT was", 30).select("section_id", F.round("rank_score", 4).alias("rank_score"))


@query(f"WITH {W} SELECT section_id, round(1e0 * ({tf('of', 'tw')} + {tf('the', 'tw')}) + 4e-1 * ({tf('of', 'cw')} + {tf('the', 'cw')}), 4) AS rank_score FROM w WHERE contains(' ' || array_to_string(cw, ' ') || ' ', ' of the ') OR contains(' ' || array_to_string(tw, ' ') || ' ', ' of the ') ORDER BY rank_score DESC, section_id LIMIT 20")
def text_phrase(spark, sf):
    return lexical.search(sections(spark, sf), '"of the"', rank="frequency").select("section_id", F.round("rank_score", 4).alias("rank_score"))


@query(f"WITH {W} SELECT section_id FROM w WHERE len(list_filter(list_concat(tw, cw), lambda x: starts_with(x, 'thin'))) > 0 AND len(list_filter(list_concat(tw, cw), lambda x: starts_with(x, 'on'))) > 0")
def text_prefix(spark, sf):
    return lexical.search(sections(spark, sf), "thin:* AND on:*", 1 << 30, rank="frequency").select("section_id")


@query(f"WITH {W}, {TAGS}, {bm25_sql(['the', 'is'], "list_contains(cw, 'the') OR list_contains(cw, 'is') OR list_contains(tw, 'the') OR list_contains(tw, 'is')", 10, "language = 'en' AND section_id IN (SELECT section_id FROM st WHERE tag_id = 1)")} SELECT section_id, round(rank_score, 4) AS rank_score FROM m")
def text_filtered(spark, sf):
    own = engine.filtered(sections(spark, sf), {"language": "en", "tag_ids": [1]}, label_tags(spark, sf))
    return lexical.search(own, "the is", 10).select("section_id", F.round("rank_score", 4).alias("rank_score"))


@query(f"WITH {W}, {bm25_sql(['the', 'this'], "(list_contains(cw, 'the') OR list_contains(tw, 'the')) AND (list_contains(cw, 'this') OR list_contains(tw, 'this'))", 15)} SELECT section_id, round(rank_score, 4) AS rank_score FROM m")
def text_postings(spark, sf):
    return lexical.search_index(lexical.postings(sections(spark, sf)), "the AND this", 15).select("section_id", F.round("rank_score", 4).alias("rank_score"))


@query(f"WITH {W} SELECT x.field, x.word, count(*) AS sections, sum(n)::BIGINT AS total FROM (SELECT section_id, 'title' AS field, word, count(*) AS n FROM (SELECT section_id, unnest(tw) AS word FROM w) GROUP BY ALL UNION ALL SELECT section_id, 'content', word, count(*) FROM (SELECT section_id, unnest(cw) AS word FROM w) GROUP BY ALL) x GROUP BY ALL")
def text_index_words(spark, sf):
    return lexical.postings(sections(spark, sf)).groupBy("field", "word").agg(F.count("*").alias("sections"), F.sum("frequency").alias("total"))


@query(f"WITH {W} SELECT word, count(*) AS count FROM (SELECT unnest(cw) AS word FROM w) WHERE starts_with(word, 'th') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def text_suggest(spark, sf):
    return lexical.suggest(sections(spark, sf), "TH", 10)


@query(f"WITH {W}, e AS (SELECT section_id, language, {tf('de', 'cw')} * 4e-1 + {tf('de', 'tw')} AS r FROM w WHERE list_contains(cw, 'de') OR list_contains(tw, 'de')), p AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY r DESC, section_id) AS k FROM e WHERE language IN ('fr', 'es')) SELECT section_id, language, round(r, 4) AS rank_score FROM p WHERE k <= 10 ORDER BY r DESC, section_id LIMIT 10")
def text_many_languages(spark, sf):
    return lexical.many_languages(sections(spark, sf), "de", ["fr", "es"], 10, rank="frequency").select("section_id", "language", F.round("rank_score", 4).alias("rank_score"))


@query(f"WITH {S} SELECT section_id, CASE WHEN language IN ('en', 'de', 'fr', 'es') THEN 'pg_catalog.' || CASE language WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french' ELSE 'spanish' END ELSE 'pg_catalog.simple' END AS config FROM s")
def text_config(spark, sf):
    return sections(spark, sf).select("section_id", T.config_name(F.col("language"), dict(LANGUAGE_CONFIGS)).alias("config"))


@query(None)
def text_highlight(spark, sf):
    return sections(spark, sf).select("section_id", lexical.highlight(F.col("content"), ["the", "and"]).alias("snippet"))


@query(f"WITH {W}, x AS (SELECT DISTINCT section_id, unnest(cw) AS word FROM w) SELECT word, count(*) AS sections, levenshtein(word, 'thinn')::INT AS distance FROM x WHERE starts_with(word, 'thin') GROUP BY 1 ORDER BY 3, 2 DESC, 1 LIMIT 3")
def text_spelling(spark, sf):
    return lexical.spelling(sections(spark, sf), "thinn", 3)


@query(f"WITH {W} SELECT section_id, round(1e0 * {tf('from', 'tw')} + 5e-1 * {tf('from', 'cw')}, 4) AS rank_score FROM w WHERE list_contains(tw, 'from') OR list_contains(cw, 'from') ORDER BY rank_score DESC, section_id LIMIT 25")
def text_weighted(spark, sf):
    found = lexical.search(sections(spark, sf), "from", 25, rank="frequency", weights=lexical.field_weights("1.0, 0.5"))
    return found.select("section_id", F.round("rank_score", 4).alias("rank_score"))


# Fusion

TEXT20 = f"{W}, {bm25_sql(['the', 'of'], "list_contains(cw, 'the') OR list_contains(cw, 'of') OR list_contains(tw, 'the') OR list_contains(tw, 'of')", 64)}"
PAIR = f"{TEXT20}, {SIM}, n AS (SELECT id AS section_id, sim AS similarity FROM v ORDER BY sim DESC, id LIMIT 64), tr AS (SELECT section_id, rank_score, row_number() OVER (ORDER BY rank_score DESC, section_id) AS rt FROM m), vr AS (SELECT section_id, similarity, row_number() OVER (ORDER BY similarity DESC, section_id) AS rv FROM n)"


def _pair(spark, sf) -> tuple[DataFrame, DataFrame]:
    (q,) = vector_of(spark, sf, 0)
    text = lexical.search(sections(spark, sf), "the of", 64).select("section_id", "rank_score")
    near = vector.nearest(vectors(spark, sf).withColumnRenamed("id", "section_id"), q, 64, "section_id").select("section_id", "similarity")
    return fusion.settled(text), fusion.settled(near)


@query(f"WITH {PAIR} SELECT section_id, round(coalesce(1.0 / (60 + rt), 0) + coalesce(1.0 / (60 + rv), 0), 6) AS combined_score FROM tr FULL JOIN vr USING (section_id)")
def fusion_rrf(spark, sf):
    return fusion.reciprocal_rank(*_pair(spark, sf)).select("section_id", F.round("combined_score", 6).alias("combined_score"))


@query(f"WITH {PAIR} SELECT section_id, round(0.3 * coalesce(1.0 / (60 + rt), 0) + 0.7 * coalesce(1.0 / (60 + rv), 0), 6) AS combined_score FROM tr FULL JOIN vr USING (section_id)")
def fusion_weighted_rrf(spark, sf):
    return fusion.reciprocal_rank(*_pair(spark, sf), alpha=0.7).select("section_id", F.round("combined_score", 6).alias("combined_score"))


SUM = f"{PAIR}, ts AS (SELECT section_id, rank_score, (rank_score - min(rank_score) OVER ()) / (max(rank_score) OVER () - min(rank_score) OVER ()) AS x FROM m), vs AS (SELECT section_id, similarity, (similarity - min(similarity) OVER ()) / (max(similarity) OVER () - min(similarity) OVER ()) AS y FROM n), fused AS (SELECT section_id, coalesce(rank_score, 0) AS text_score, coalesce(similarity, 0) AS vector_score, 0.95 * coalesce(y, 0) + 0.05 * coalesce(x, 0) AS combined FROM ts FULL JOIN vs USING (section_id))"


@query(f"WITH {SUM} SELECT section_id, round(text_score, 4) AS text_score, round(vector_score, 4) AS vector_score, round(combined, 4) AS combined_score FROM fused")
def fusion_weighted_sum(spark, sf):
    out = fusion.weighted_sum(*_pair(spark, sf))
    return out.select("section_id", *(F.round(c, 4).alias(c) for c in ("text_score", "vector_score", "combined_score")))


@query(f"WITH {SUM} SELECT round(min(combined), 4) AS min, round(max(combined), 4) AS max, round(avg(combined), 4) AS avg FROM fused")
def fusion_score_stats(spark, sf):
    return relational.score_stats(fusion.weighted_sum(*_pair(spark, sf)), "combined_score")


ASKED = ["the", "of", "quality"]
RERANKED = f"""{SUM}, {TAGS}, tg AS (SELECT section_id, list(CASE tag_id WHEN 1 THEN 'quality' ELSE 'toxic' END) AS tags FROM st GROUP BY 1),
    r0 AS (SELECT f.*, category, regexp_extract_all(content, '[A-Za-z0-9_]+') AS c, regexp_extract_all(section_title, '[A-Za-z0-9_]+') AS t, coalesce(tags, []) AS tags FROM fused f JOIN s USING (section_id) LEFT JOIN tg USING (section_id)),
    r1 AS (SELECT *, CASE WHEN len(c) = 0 THEN 0 ELSE (len(list_filter(c, lambda x: lower(x) IN ('the', 'of', 'quality'))) + 2 * len(list_filter(t, lambda x: lower(x) IN ('the', 'of', 'quality'))) + 5 * len(list_filter(tags, lambda x: x IN ('the', 'of', 'quality')))) / 3.0 END AS tok FROM r0),
    r2 AS (SELECT *, 0.05 * tok + 0.95 * vector_score * CASE WHEN tok <= 0 THEN 0.3 ELSE 1 END + CASE WHEN tok > 0 THEN len(list_filter(['the', 'of', 'quality'], lambda x: list_contains(tags, x))) / 3.0 ELSE 0 END AS rr FROM r1),
    rx AS (SELECT *, row_number() OVER (ORDER BY round(rr, 6) DESC, section_id) AS rank FROM r2)"""


def _reranked(spark, sf) -> DataFrame:
    fused = fusion.weighted_sum(*_pair(spark, sf))
    names = F.transform(F.sort_array(F.collect_list("tag_id")), lambda t: F.when(t == 1, "quality").otherwise("toxic"))
    lists = label_tags(spark, sf).groupBy("section_id").agg(names.alias("tags"))
    rows = sections(spark, sf).join(F.broadcast(fused), "section_id").join(lists, "section_id", "left")
    return relational.ranked(fusion.rerank(rows, ASKED, 0.95), F.desc(F.round("rerank_score", 6)), F.asc("section_id"))


@query(f"WITH {RERANKED} SELECT section_id, round(tok, 4) AS token_score, round(rr, 4) AS rerank_score, rank FROM rx")
def fusion_rerank(spark, sf):
    return _reranked(spark, sf).select("section_id", F.round("token_score", 4).alias("token_score"), F.round("rerank_score", 4).alias("rerank_score"), "rank")


@query(f"WITH {RERANKED}, z AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY rank) AS rn, min(rank) OVER (PARTITION BY category) AS fr FROM rx WHERE rank <= 40) SELECT section_id, category, row_number() OVER (ORDER BY rn, fr) AS diversified_rank FROM z")
def fusion_diversify(spark, sf):
    return relational.interleave(_reranked(spark, sf).where("rank <= 40"), "category", "rank").select("section_id", "category", "diversified_rank")


@query(f"WITH {RERANKED} SELECT section_id, row_number() OVER (ORDER BY CASE WHEN contains(category, 'src1') OR contains(category, 'src7') THEN 0 ELSE 1 END, rank) AS boosted_rank FROM rx WHERE rank <= 40")
def fusion_domain_boost(spark, sf):
    return relational.preferred_first(_reranked(spark, sf).where("rank <= 40"), "category", ["src1", "src7"], "rank").select("section_id", "boosted_rank")


HYBRID = RERANKED.replace("'of', 'quality'", "'of'").replace("/ 3.0", "/ 2.0").replace("WHEN tok <= 0 THEN 0.3 ELSE 1 END", "WHEN false THEN 0 ELSE 1 END").replace("LIMIT 64), tr", "LIMIT 64), tr")


@query(
    f"WITH {HYBRID.replace('n AS (SELECT id AS section_id, sim AS similarity FROM v ORDER BY sim DESC, id LIMIT 64)', 'n0 AS (SELECT id AS section_id, sim AS similarity FROM v ORDER BY sim DESC, id LIMIT 64), n AS (SELECT * FROM n0 WHERE similarity > (SELECT CASE WHEN max(similarity) > 0.3 THEN 0.3 WHEN max(similarity) > 0.1 THEN 0.1 ELSE -2 END FROM n0))').replace('FROM fused f JOIN', 'FROM (SELECT * FROM fused ORDER BY combined DESC, section_id LIMIT 64) f JOIN')} SELECT section_id, round(combined, 4) AS combined_score, round(rr, 4) AS rerank_score, rank FROM rx WHERE rank <= 20"
)
def hybrid_search(spark, sf):
    """The whole search: both recalls, fusion, rerank, cut."""
    (q,) = vector_of(spark, sf, 0)
    names = F.transform(F.sort_array(F.collect_list("tag_id")), lambda t: F.when(t == 1, "quality").otherwise("toxic"))
    lists = label_tags(spark, sf).groupBy("section_id").agg(names.alias("tags"))
    near = vectors(spark, sf).withColumnRenamed("id", "section_id")
    found = engine.hybrid(sections(spark, sf), near, "the of", q, tag_lists=lists)
    found = relational.ranked(found, F.desc(F.round("rerank_score", 6)), F.asc("section_id"))
    return found.select("section_id", F.round("combined_score", 4).alias("combined_score"), F.round("rerank_score", 4).alias("rerank_score"), "rank")


@query(f"WITH {SUM}, x AS (SELECT section_id, CASE WHEN round(vector_score, 4) = 0 THEN 'none' ELSE 'near' END AS kind FROM fused) SELECT kind, count(*) AS rows FROM x GROUP BY 1")
def fusion_explanation(spark, sf):
    out = fusion.weighted_sum(*_pair(spark, sf)).withColumn("e", T.explanation(F.col("combined_score"), F.col("vector_score"), F.col("text_score")))
    return out.groupBy(F.when(F.contains("e", F.lit("vector: 0.0,")), "none").otherwise("near").alias("kind")).agg(F.count("*").alias("rows"))


# Text functions


def _languages(policy: str) -> Callable:
    def run(spark, sf):
        parts = [table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), spark.createDataFrame([(-1 - k, t) for k, t in enumerate(SCRIPTS)], "id long, text string")]
        return parts[0].unionByName(parts[1]).select("id", T.detect_language(F.col("text"), policy).alias("language"))

    run.__name__ = f"language_{policy}"
    return run


SCRIPTS = ["机器学习", "機械学習のこと", "기계 학습 입문", "深度 learning", "", "   ", "あ漢漢漢漢", "カタカナ 漢字", "漢 한글한글", "!!!"]
_ROWS = "r AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-1 - k}, '{t}')" for k, t in enumerate(SCRIPTS)) + r") t(id, text)), k AS (SELECT id, text, len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]')) AS zh, len(regexp_extract_all(text, '[\x{3040}-\x{30ff}]')) AS ja, len(regexp_extract_all(text, '[\x{ac00}-\x{d7af}]')) AS ko, len(regexp_extract_all(text, '[a-zA-Z]')) AS en FROM r)"
for _policy, _case in {
    "most": "CASE WHEN zh > 0 AND zh >= greatest(ja, ko, en) THEN 'zh' WHEN ja > 0 AND ja >= greatest(ko, en) THEN 'ja' WHEN ko > 0 AND ko >= en THEN 'ko' ELSE 'en' END",
    "first": "CASE WHEN ja > 0 THEN 'ja' WHEN zh > 0 THEN 'zh' ELSE 'en' END",
    "first_han": "CASE WHEN zh > 0 THEN 'zh' WHEN ja > 0 THEN 'ja' ELSE 'en' END",
    "first_regional": "CASE WHEN ja > 0 THEN 'ja' WHEN zh > 0 THEN 'zh_cn' ELSE 'en' END",
    "first_korean": "CASE WHEN ja > 0 THEN 'ja' WHEN ko > 0 THEN 'ko' WHEN zh > 0 THEN 'zh' ELSE 'en' END",
    "ratio": "CASE WHEN zh + ja + ko = 0 THEN 'en' WHEN ja >= 0.3 * (zh + ja + ko) AND ja > zh AND ja > ko THEN 'ja' WHEN ko >= 0.3 * (zh + ja + ko) AND ko > zh THEN 'ko' ELSE 'zh' END",
}.items():
    query(f"WITH {_ROWS} SELECT id, {_case} AS language FROM k")(_languages(_policy))


@query("SELECT doc_id, ceil(0.25 * len(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')))::BIGINT + len(text) - len(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) + len(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS tokens FROM documents")
def token_estimate(spark, sf):
    return relational.spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query("SELECT token, count(*) AS count FROM (SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z0-9_]+'))) AS token FROM documents) GROUP BY 1")
def tokenized(spark, sf):
    return relational.spread(table(spark, sf, "documents").select("text")).select(F.explode_outer(T.tokenize(F.col("text"))).alias("token")).where("token is not null").groupBy("token").agg(F.count("*").alias("count"))


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS title, NULLIF(regexp_extract(html, '(?i)<meta\\s+name=[\"'']?author[\"'']?\\s+content=[\"'']?([^\"'']+)[\"'']?\\s*/?\\s*>', 1), '') AS author, len(trim(regexp_replace(regexp_replace(regexp_extract(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g'), '(?is)<body[^>]*>(.*?)(?:</body>|$)', 1), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS body_chars FROM pages")
def html_meta(spark, sf):
    return html_metadata(table(spark, sf, "pages")).select("page_id", "title", "author", F.char_length("body").alias("body_chars"))


@query("SELECT DISTINCT name, trim(regexp_replace(regexp_replace(trim(name), '[^\\w\\s\\-]', ' ', 'g'), '\\s+', ' ', 'g')) AS cleaned FROM (SELECT p_name AS name FROM part UNION ALL SELECT p_type || '/' || p_brand FROM part)")
def clean_tags(spark, sf):
    p = table(spark, sf, "part")
    names = p.select(F.col("p_name").alias("name")).unionByName(p.select(F.concat_ws("/", "p_type", "p_brand").alias("name"))).distinct()
    return names.select("name", T.clean_tag_name(F.col("name")).alias("cleaned"))


@query(f"WITH {S} SELECT section_id, CASE WHEN len(content) > 100 THEN substring(content, 1, 100) || '...' ELSE content END AS preview, len(content) AS characters, len(regexp_split_to_array(trim(regexp_replace(content, '\\s+', ' ', 'g')), ' ')) AS words FROM s")
def section_info(spark, sf):
    c = F.col("content")
    return sections(spark, sf).select("section_id", T.preview(c).alias("preview"), F.char_length(c).alias("characters"), T.word_count(c).alias("words"))


@query(f"WITH {S} SELECT section_id, md5('Title: ' || section_title || chr(10) || chr(10) || 'Section: 1' || chr(10) || chr(10) || content) AS digest FROM s")
def embedding_text(spark, sf):
    return sections(spark, sf).select("section_id", F.md5(T.section_text(F.col("section_title"), F.lit(1), F.col("content")).cast("binary")).alias("digest"))


# Relational


@query("SELECT doc_id FROM documents WHERE contains(text, 'tion the') OR contains(source, 'src1')")
def documents_like(spark, sf):
    return relational.containing(table(spark, sf, "documents"), "tion the", "text").select("doc_id").unionByName(relational.containing(table(spark, sf, "documents"), "src1", "source").select("doc_id")).distinct()


@query("SELECT doc_id FROM documents WHERE text ILIKE '%THE AND%'")
def documents_ilike(spark, sf):
    return relational.containing(table(spark, sf, "documents"), "THE AND", "text", ignore_case=True).select("doc_id")


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'de' AND source IN ('src1', 'src2', 'src3')")
def documents_by_criteria(spark, sf):
    return relational.matching(table(spark, sf, "documents"), {"lang": "de", "source": ["src1", "src2", "src3"]}).select("doc_id", "lang", "source")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 40")
def documents_page(spark, sf):
    rows, _ = relational.page(table(spark, sf, "documents"), [F.desc("n_chars"), F.asc("doc_id")], 3, 20)
    return rows.select("doc_id", "n_chars")


@query("SELECT count(*) AS total, ceil(count(*) / 20.0)::BIGINT AS total_pages FROM documents")
def documents_pager(spark, sf):
    _, pager = relational.page(table(spark, sf, "documents"), [F.asc("doc_id")], 1, 20)
    return spark.createDataFrame([(pager["total"], pager["total_pages"])], "total long, total_pages long")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) ORDER BY doc_id LIMIT 100")
def missing_embeddings(spark, sf):
    own = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return embedding_source.missing(own, vectors(spark, sf).withColumnRenamed("id", "source_id"), 100).select(F.col("id").alias("doc_id"))


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def orphan_embeddings(spark, sf):
    return relational.absent(table(spark, sf, "embeddings"), table(spark, sf, "labels"), "vec_id", "doc_id").select("vec_id")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def documents_with_tag(spark, sf):
    return relational.present(table(spark, sf, "documents"), table(spark, sf, "labels").where("quality = 1"), "doc_id").select("doc_id")


@query("SELECT o_orderkey FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS d FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON o_orderkey = l_orderkey WHERE l_orderkey IS NULL OR o_orderdate > d")
def stale_index(spark, sf):
    indexed = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("section_id")).agg(F.max("l_shipdate").alias("updated_at"))
    own = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("updated_at"))
    return relational.stale(own, indexed).select(F.col("id").alias("o_orderkey"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def upsert_latest(spark, sf):
    return relational.latest(table(spark, sf, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey")


@query("SELECT source, count(*) AS count, sum(len(text))::BIGINT AS size FROM documents GROUP BY 1")
def content_by_source(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("count"), F.sum(F.char_length("text")).alias("size"))


@query("SELECT lang AS language, count(*) AS count FROM documents GROUP BY 1")
def language_distribution(spark, sf):
    return relational.counts_by(table(spark, sf, "documents").withColumnRenamed("lang", "language"), "language")


@query("SELECT count(*) AS total, count(DISTINCT lang) AS languages, max(n_chars) AS longest FROM documents")
def index_statistics(spark, sf):
    return table(spark, sf, "documents").agg(F.count("*").alias("total"), F.countDistinct("lang").alias("languages"), F.max("n_chars").alias("longest"))


@query("SELECT 'documents' AS name, count(*) AS count FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'labels', count(*) FROM labels")
def table_statistics(spark, sf):
    return relational.table_counts({n: table(spark, sf, n) for n in ("documents", "embeddings", "labels")})


@query("SELECT c_custkey AS document, count(o_orderkey) AS total_sections, count(l_orderkey) AS embedded_sections, coalesce(round(100.0 * count(l_orderkey) / nullif(count(o_orderkey), 0), 2), 0) AS coverage FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ON o_orderkey = l_orderkey GROUP BY 1")
def embedding_coverage(spark, sf):
    docs = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    secs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document_id"))
    done = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("source_id"), F.col("l_shipdate").alias("created_at"))
    return relational.coverage(docs, secs, done).select("document", "total_sections", "embedded_sections", "coverage")


@query("SELECT doc_id, 'section_title' AS broken FROM documents WHERE n_chars > 5000")
def rule_violations(spark, sf):
    title = F.when(F.col("n_chars") > 5000, F.repeat(F.lit("x"), 501)).otherwise(F.lit("ok"))
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit(1).alias("document_id"), F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.lit("x")).alias("content"), title.alias("section_title"), "doc_id")
    return violations(rows, "source_sections").select("doc_id", F.array_join("broken", ",").alias("broken"))


# Tags and topics


@query(f"WITH {TAGS}, t AS (SELECT * FROM (VALUES (1, 'quality'), (2, 'toxic'), (3, 'unused')) t(id, name)) SELECT id, name, count(section_id) AS section_count FROM t LEFT JOIN st ON id = tag_id GROUP BY ALL")
def tag_popular(spark, sf):
    named = spark.createDataFrame([(1, "quality", None, None), (2, "toxic", None, None), (3, "unused", None, None)], "id long, name string, parent_id long, created_at timestamp")
    return tags.popular(named, label_tags(spark, sf)).select("id", "name", "section_count")


@query(f"WITH RECURSIVE {FOREST}, w AS (SELECT id, name, 0 AS depth, name AS path, id AS root_id FROM f WHERE parent_id IS NULL UNION ALL SELECT f.id, f.name, w.depth + 1, w.path || ' > ' || f.name, w.root_id FROM w JOIN f ON f.parent_id = w.id) SELECT id, name, depth, path, root_id FROM w")
def tag_paths(spark, sf):
    return tags.paths(forest(spark, sf)).select("id", "name", "depth", "path", "root_id")


@query(f"WITH RECURSIVE {FOREST}, u AS (SELECT id AS tag_id, parent_id AS ancestor_id, 1 AS distance FROM f WHERE parent_id IS NOT NULL UNION ALL SELECT u.tag_id, f.parent_id, u.distance + 1 FROM u JOIN f ON f.id = u.ancestor_id WHERE f.parent_id IS NOT NULL) SELECT * FROM u")
def tag_ancestors(spark, sf):
    return tags.ancestors(forest(spark, sf))


@query(f"WITH RECURSIVE {FOREST}, d AS (SELECT id AS descendant_id, 1 AS distance FROM f WHERE parent_id = 1 UNION ALL SELECT f.id, d.distance + 1 FROM d JOIN f ON f.parent_id = d.descendant_id) SELECT * FROM d")
def tag_descendants(spark, sf):
    return tags.descendants(forest(spark, sf), 1)


@query(f"WITH {FOREST} SELECT id, parent_id IS NULL AS is_root, EXISTS (SELECT 1 FROM f c WHERE c.parent_id = f.id) AS has_children FROM f")
def tag_flags(spark, sf):
    return tags.with_flags(forest(spark, sf)).select("id", "is_root", "has_children")


@query("WITH b AS (SELECT DISTINCT o_custkey AS t, l_partkey AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey) SELECT t AS research_topic_id, count(*) AS overlap FROM b WHERE t <> 1 AND s IN (SELECT s FROM b WHERE t = 1) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def topic_related(spark, sf):
    bridge = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("research_topic_id"), F.col("l_partkey").alias("section_id"))
    return tags.related_topics(bridge, 1)


@query("WITH tt AS (SELECT DISTINCT o_custkey AS t, l_suppkey AS tag FROM orders JOIN lineitem ON o_orderkey = l_orderkey), own AS (SELECT DISTINCT l_suppkey AS tag FROM lineitem WHERE l_orderkey = 1) SELECT t AS research_topic_id, count(DISTINCT tag) AS matching_tags FROM tt WHERE tag IN (SELECT tag FROM own) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def topic_recommend(spark, sf):
    lines = table(spark, sf, "lineitem")
    topic_tags = table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("research_topic_id"), F.col("l_suppkey").alias("tag_id"))
    bridge = lines.select(F.col("l_orderkey").alias("section_id"), F.col("l_suppkey").alias("tag_id"))
    own = lines.select(F.col("l_orderkey").alias("id"), F.col("l_orderkey").alias("document_id")).distinct()
    return tags.recommended_topics(topic_tags, bridge, own, 1)


@query(f"WITH {S}, {TAGS} SELECT section_id AS id FROM s WHERE section_id IN (SELECT section_id FROM st WHERE tag_id = 1) AND section_id IN (SELECT vec_id FROM embeddings) ORDER BY 1 LIMIT 50")
def tag_sections(spark, sf):
    own = sections(spark, sf).withColumnRenamed("section_id", "id")
    return tags.sections_with_tag(own, label_tags(spark, sf), [1], embeddings=vectors(spark, sf).withColumnRenamed("id", "source_id"), limit=50).select("id")


@query("SELECT l_suppkey AS tag_id, count(*) AS topic_count FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def topic_tag_popular(spark, sf):
    return tags.topic_tag_counts(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("tag_id")))


# Logs


@query(f"WITH {LOGS} SELECT id, execution_time_ms FROM l WHERE execution_time_ms > 100")
def log_slow(spark, sf):
    return logs.slow(search_logs(spark, sf)).select("id", "execution_time_ms")


@query(f"WITH {LOGS} SELECT query, count(*) AS count FROM l GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def log_popular(spark, sf):
    return logs.popular(search_logs(spark, sf))


@query(f"WITH {LOGS} SELECT query, count(*) AS count FROM l WHERE created_at >= (SELECT max(created_at) FROM l) - INTERVAL 1 DAY GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def log_popular_recent(spark, sf):
    rows = search_logs(spark, sf)
    return logs.popular(rows, 10, rows.agg(F.max("created_at")).first()[0])


@query(f"WITH {LOGS} SELECT search_type, round(avg(execution_time_ms), 4) AS avg_time, count(*) AS count FROM l WHERE execution_time_ms IS NOT NULL GROUP BY 1")
def log_by_type(spark, sf):
    return logs.time_by_type(search_logs(spark, sf))


@query(f"WITH {LOGS} SELECT search_type, round(min(execution_time_ms), 4) AS min, round(avg(execution_time_ms), 4) AS avg, round(max(execution_time_ms), 4) AS max, round(quantile_cont(execution_time_ms, 0.5), 4) AS p50, round(quantile_cont(execution_time_ms, 0.95), 4) AS p95, round(quantile_cont(execution_time_ms, 0.99), 4) AS p99 FROM l GROUP BY 1")
def log_latency(spark, sf):
    out = logs.latency(search_logs(spark, sf))
    return out.select("search_type", *(F.round(c, 4).alias(c) for c in out.columns[1:]))


@query(f"WITH {LOGS} SELECT count(*) AS total, round(avg(execution_time_ms), 4) AS avg_time, count(*) FILTER (coalesce(results_count, 0) > 0) AS successful, count(*) FILTER (coalesce(results_count, 0) <= 0) AS failed FROM l WHERE id BETWEEN 100 AND 800")
def log_period(spark, sf):
    rows = search_logs(spark, sf).where("id BETWEEN 100 AND 800")
    return logs.period(rows, F.lit("1900-01-01").cast("timestamp"), F.lit("2100-01-01").cast("timestamp"))


@query(f"WITH {LOGS} SELECT id FROM l WHERE results_count = 0 OR results_count IS NULL")
def log_no_results(spark, sf):
    return logs.without_results(search_logs(spark, sf)).select("id")


@query(f"WITH {LOGS} SELECT query, count(*) AS searches FROM l WHERE results_count = 0 OR results_count IS NULL GROUP BY 1 HAVING count(*) >= 2")
def log_gaps(spark, sf):
    return logs.gaps(search_logs(spark, sf)).select("query", "searches")


@query(f"WITH {LOGS} SELECT id, coalesce(results_count > 0, false) AS successful, coalesce(execution_time_ms > 100, false) AS slow, (filters ->> '$.k')::INT AS k FROM l")
def log_flags(spark, sf):
    return logs.with_flags(search_logs(spark, sf)).select("id", "successful", "slow", F.get_json_object("filters", "$.k").cast("int").alias("k"))


@query(f"WITH {LOGS} SELECT date_trunc('day', created_at) AS window_start, date_trunc('day', created_at) + INTERVAL 1 DAY AS window_end, query, count(*) AS count FROM l GROUP BY ALL")
def log_popularity(spark, sf):
    return index.popularity(search_logs(spark, sf), "1 day", "1 day")


@query(f"WITH {LOGS} SELECT id, query, search_type, created_at FROM l WHERE created_at >= (SELECT min(ts) + INTERVAL 1 DAY FROM events) AND created_at <= (SELECT min(ts) + INTERVAL 3 DAY FROM events)")
def log_export(spark, sf):
    rows = search_logs(spark, sf)
    (first,) = rows.agg(F.min("created_at")).first()
    return logs.export(rows, "", first + timedelta(days=1), first + timedelta(days=3), "rows").select("id", "query", "search_type", "created_at")


@query("WITH o AS (SELECT o_custkey AS section_id, o_orderkey % 5 AS batch, o_orderkey AS word FROM orders) SELECT o.section_id, o.batch, o.word FROM o JOIN (SELECT section_id, max(batch) AS last FROM o GROUP BY 1) x ON o.section_id = x.section_id AND o.batch = x.last")
def index_latest(spark, sf):
    """Postings written in batches: orders play rows, customers sections."""
    o = table(spark, sf, "orders")
    return index.latest_rows(o.select(F.col("o_custkey").alias("section_id"), F.pmod("o_orderkey", F.lit(5)).alias("batch"), F.col("o_orderkey").alias("word")))


# Sections, documents and their vectors


@query(f"WITH {S} SELECT section_id, d.lang AS language, d.source AS document_title FROM s LEFT JOIN (SELECT * FROM documents WHERE lang <> 'de') d ON d.doc_id = s.document_id")
def section_documents(spark, sf):
    docs = table(spark, sf, "documents").where("lang <> 'de'").select(F.col("doc_id").alias("id"), F.col("lang").alias("language"), F.col("source").alias("title"))
    return relational.with_documents(sections(spark, sf).drop("language"), docs).select("section_id", "language", "document_title")


@query(f"WITH {S} SELECT section_id AS source_id, len(CASE WHEN regexp_matches(section_title, '[^ \t\n\x0B\f\r]') THEN 'Title: ' || section_title || chr(10) || chr(10) ELSE '' END || 'Section: ' || section_id || chr(10) || chr(10) || content) AS size FROM s WHERE content IS NOT NULL")
def embedding_batches(spark, sf):
    """Batches of texts to vectors; the provider gives a text's length."""
    rows = sections(spark, sf).where("content is not null").withColumn("section_number", F.col("section_id"))
    found = embedding_source.embed(rows, lambda texts: [[float(len(t))] for t in texts], id_col="section_id")
    return found.where("error is null").select("source_id", F.get("vector", F.lit(0)).cast("long").alias("size"))


@query("SELECT count(*) FILTER (vec_id % 7 <> 0) AS success, count(*) FILTER (vec_id % 7 = 0) AS failed FROM embeddings")
def embedding_tally(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("source_id"), F.when(F.col("vec_id") % 7 == 0, "failed").alias("error"))
    return embedding_source.tally(rows)


# Chunks and answers


@query(None)
def chunk_by_size(spark, sf):
    return chunking.chunk_documents(sections(spark, sf), "markdown", "section_id", size=2000, overlap=200)


def _marked(spark, sf) -> DataFrame:
    """Documents with every second line a heading, of levels 1 to 3."""
    lines = F.split("content", "\n")
    marked = F.transform(lines, lambda x, i: F.when(i % 2 == 0, F.concat(F.repeat(F.lit("#"), (F.pmod(i / 2, F.lit(3)) + 1).cast("int")), F.lit(" "), F.substring(x, 1, 40))).otherwise(x))
    return sections(spark, sf).select("section_id", F.array_join(marked, "\n").alias("content"))


@query(None)
def chunk_headings(spark, sf):
    return chunking.with_sections(_marked(spark, sf), "content").select("section_id", F.posexplode_outer("sections").alias("k", "s")).where("k is not null").select("section_id", "k", "s.*")


@query(None)
def chunk_merge(spark, sf):
    return chunking.chunk_documents(_marked(spark, sf), "smart", "section_id")


@query(None)
def chunk_paper(spark, sf):
    return chunking.chunk_documents(_marked(spark, sf), "smart", "section_id", doc_type="paper")


@query(f"WITH {S}, x AS (SELECT string_agg('Section: ' || section_title || chr(10) || trim(content), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY section_id) AS c FROM s WHERE section_id BETWEEN 1 AND 5) SELECT CASE WHEN len(c) > 4000 THEN substring(c, 1, 4000) || '... (truncated)' ELSE c END AS context FROM x")
def answer_context(spark, sf):
    return answer.context(sections(spark, sf).withColumn("rank", F.col("section_id")).where("rank >= 1"))


@query(f"WITH {S} SELECT document_id, section_title AS document_title, section_id, category AS url FROM s WHERE section_id BETWEEN 1 AND 5")
def answer_sources(spark, sf):
    rows = sections(spark, sf).withColumn("rank", F.col("section_id")).where("rank >= 1").withColumn("similarity", F.lit(1.0))
    docs = sections(spark, sf).select(F.col("document_id").alias("id"), F.col("section_title").alias("title"), F.col("category").alias("url"))
    return answer.sources(rows, docs).select("document_id", "document_title", "section_id", "url")


@query(f"WITH {W}, {bm25_sql(['the', 'of'], "list_contains(cw, 'the') OR list_contains(cw, 'of') OR list_contains(tw, 'the') OR list_contains(tw, 'of')", 20)} SELECT section_id, round(rank_score, 4) AS rank_score FROM m")
def text_relaxed(spark, sf):
    return lexical.search(sections(spark, sf), relax('"the" AND NOT (of)'), 20).select("section_id", F.round("rank_score", 4).alias("rank_score"))
