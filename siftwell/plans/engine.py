"""The engine over a knowledge base: ingest, index, search, ask, and keep books.

A search is one plan: lexical and vector recall, each cut to a pool, fused,
reranked, cut, and joined to what is shown. Only its few result rows come to
the driver.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from datetime import UTC, date, datetime

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.config import Config
from siftwell.errors import EngineError, InvalidParameterError, InvalidQueryError
from siftwell.functions.text import clean_tag_name, detect_language, explanation
from siftwell.operators import fusion, lexical, relational, tags, vector
from siftwell.operators.chunking import chunk_documents
from siftwell.operators.logs import entry
from siftwell.plans import answer as answers
from siftwell.plans.query import parse, positive_words, relax, summary, validate
from siftwell.schemas import TABLES
from siftwell.sources import embeddings as embedding_source
from siftwell.sources import readers
from siftwell.sources.store import Store

Model = Callable[[str], str]
TYPES = ("hybrid", "vector", "fulltext")


def filtered(sections: DataFrame, filters: dict | None, section_tags: DataFrame | None = None, tag_table: DataFrame | None = None) -> DataFrame:
    """Sections by document_ids, tag_ids, tag_names, language, date_from and date_to; unknown names are passed over."""
    f = filters or {}
    if f.get("document_ids"):
        sections = sections.where(F.col("document_id").isin(list(f["document_ids"])))
    if f.get("language"):
        sections = sections.where(F.col("language") == f["language"])
    for key, keep in (("date_from", lambda c, v: c >= v), ("date_to", lambda c, v: c <= v)):
        if f.get(key) is not None:
            value = f[key]
            sections = sections.where(keep(F.col("created_at"), F.lit(datetime(value.year, value.month, value.day) if isinstance(value, date) and not isinstance(value, datetime) else value)))
    if section_tags is not None and (f.get("tag_ids") or f.get("tag_names")):
        own = section_tags
        if f.get("tag_names"):
            named = tag_table.where(F.col("name").isin(list(f["tag_names"]))).select(F.col("id").alias("__t"))
            own = own.join(named, F.col("tag_id") == F.col("__t"), "left_semi")
        if f.get("tag_ids"):
            own = own.where(F.col("tag_id").isin(list(f["tag_ids"])))
        sections = sections.join(own.select(F.col("section_id").alias("__s")), F.col("section_id") == F.col("__s"), "left_semi")
    return sections


def hybrid(sections: DataFrame, vectors: DataFrame, query: str, query_vector: list[float], limit: int = 20, alpha: float = 0.95, method: str = "weighted_sum", rerank_limit: int = 64, threshold: float = 0.3, fallback: float = 0.1, tag_lists: DataFrame | None = None, rank: str = "bm25", language: str = "en") -> DataFrame:
    """section_id, text_score, vector_score, combined_score, token_score, rerank_score and the section's columns, best first.

    ``sections`` has section_id, section_title and content; ``vectors`` has
    section_id and vector; ``tag_lists`` has section_id and tags. Filters are
    taken to have been applied to both.
    """
    limit, alpha = fusion.clamp_limit(limit), fusion.alpha_for(fusion.clamp_alpha(alpha), query, language)
    pool = fusion.pool_size(rerank_limit, limit)
    text = fusion.settled(lexical.search(sections, query, pool, rank=rank).select("section_id", "rank_score"))
    near = vector.cascade(vectors, query_vector, pool, threshold, fallback, id_col="section_id").select("section_id", "similarity")
    fused = fusion.settled(fusion.combine(method, text, fusion.settled(near), alpha).limit(pool))
    names = sections.join(F.broadcast(fused), "section_id")
    if tag_lists is not None:
        own = tag_lists.join(F.broadcast(fused.select(F.col("section_id").alias("__s"))), F.col("section_id") == F.col("__s"), "left_semi").select(F.col("section_id").alias("__t"), "tags")
        names = names.join(own, F.col("section_id") == F.col("__t"), "left").drop("__t")
    else:
        names = names.withColumn("tags", F.array().cast("array<string>"))
    return fusion.rerank(names, query_tokens(query), alpha).limit(limit)


def query_tokens(query: str) -> list[str]:
    """The query's tokens as the reranker counts them: words, and Han runs with their pairs of characters."""
    import re

    out = []
    for run in re.findall(r"[一-鿿㐀-䶿]+|[A-Za-z0-9_]+", query or ""):
        if run[0] < "㐀":
            out.append(run.lower())
        else:
            out += [run] if len(run) <= 2 else [run, *(run[i : i + 2] for i in range(len(run) - 1))]
    return out


class Engine:
    """Reads and writes one Store. ``provider`` embeds texts, ``model`` answers prompts; both are optional."""

    def __init__(self, spark: SparkSession, config: Config, provider: embedding_source.Provider | None = None, model: Model | None = None, clock: Callable[[], datetime] | None = None):
        self.spark, self.config, self.provider, self.model = spark, config, provider, model
        self.store = Store(spark, config.path)
        self.clock = clock or (lambda: datetime.now(UTC).replace(tzinfo=None))
        self.store.create()

    # Documents

    def add_documents(self, path: str, pattern: str = "*", strategy: str = "smart", doc_type: str = "general", embed: bool = True, **options) -> dict:
        """Reads files, upserts documents by url, cuts them into sections and embeds these; returns counts."""
        now = self.clock()
        read = readers.documents(self.spark, path, pattern, options=options)
        known = self.store.read("source_documents").select(F.col("id").alias("__id"), F.col("url").alias("__url"))
        found = read.join(known, F.col("url") == F.col("__url"), "left").withColumn("id", F.coalesce("__id", "id")).drop("__id", "__url")
        found = found.persist(StorageLevel.DISK_ONLY)  # several actions need it; what a lost executor held is read again
        rows = found.withColumns({"created_at": F.lit(now), "updated_at": F.lit(now), "publication_date": F.lit(options.get("publication_date")).cast("date")})
        self.store.upsert("source_documents", rows)
        c = self.config.chunk
        chunks = chunk_documents(found.where("error is null"), strategy, doc_type=doc_type, limit=c.tokens, size=c.characters, overlap=c.overlap)
        sections = chunks.withColumns({"id": F.xxhash64("document_id", "section_number"), "created_at": F.lit(now), "updated_at": F.lit(now), "section_title": F.substring("section_title", 1, 500)})
        ids = found.select(F.col("id").alias("document_id"))
        self.store.delete_keys("source_sections", ids, ("document_id",))
        self.store.upsert("source_sections", sections)
        if embed and self.provider:
            self.embed_missing()
        mine = self.store.read("source_sections").join(ids, "document_id", "left_semi")
        counts = found.agg(F.count("*").alias("documents"), F.count("error").alias("failed")).first()
        out = {"documents": counts.documents, "sections": mine.count(), "failed": counts.failed}
        found.unpersist()
        return out

    def embed_missing(self) -> dict:
        now = self.clock()
        sections = self.store.read("source_sections")
        done = embedding_source.embed(embedding_source.missing(sections, self.store.read("embeddings")), self.provider).cache()
        fresh = done.where("error is null").select(F.col("source_id").alias("id"), "source_id", "vector", F.lit(now).alias("created_at"))
        self.store.upsert("embeddings", fresh)
        out = embedding_source.tally(done).first().asDict()
        done.unpersist()
        return out

    def get_document(self, document_id) -> dict | None:
        try:
            key = int(document_id)
        except (TypeError, ValueError):
            return None
        row = self.store.read("source_documents").where(F.col("id") == key).first()
        if not row:
            return None
        return {**row.asDict(), "section_count": self.store.read("source_sections").where(F.col("document_id") == key).count()}

    def list_documents(self, page: int = 1, per_page: int = 20, search: str | None = None) -> dict:
        docs = self.store.read("source_documents")
        if search:
            docs = relational.containing(docs, search, "title", "description", ignore_case=True)
        docs = relational.counted(docs, self.store.read("source_sections"), "id", "document_id")
        rows, pager = relational.page(docs, [F.desc_nulls_last("created_at"), F.asc("id")], page, per_page)
        return {"documents": [r.asDict() for r in rows.collect()], **pager}

    def remove_document(self, document_id: int) -> dict:
        return self.store.delete("source_documents", F.col("id") == document_id)

    def remove_old_documents(self, days: int = 90) -> dict:
        return self.store.delete_older("source_documents", self.clock(), days)

    # Searching

    def _sections(self) -> DataFrame:
        own = self.store.read("source_sections").withColumnRenamed("id", "section_id")
        return relational.with_documents(own, self.store.read("source_documents"))

    def _vectors(self, sections: DataFrame) -> DataFrame:
        own = self.store.read("embeddings").select(F.col("source_id").alias("section_id"), "vector", "created_at")
        one = own.groupBy("section_id").agg(F.max_by("vector", F.coalesce("created_at", F.lit(0).cast("timestamp"))).alias("vector"))
        return one.join(sections.select(F.col("section_id").alias("__s")), F.col("section_id") == F.col("__s"), "left_semi")

    def search(self, query: str, search_type: str = "hybrid", limit: int | None = None, alpha: float | None = None, filters: dict | None = None, query_vector: list[float] | None = None, search_tags: list[int] | None = None, expected_categories: list[str] | None = None, category: str | None = None, explain: bool = False, highlight: bool = False, log: bool = True) -> dict:
        """results, total_count, score_stats, language, search_type and execution_time_ms; what fails gives no results and an error."""
        if search_type not in TYPES:
            raise InvalidParameterError(f"unknown search type {search_type}")
        began, s = time.monotonic(), self.config.search
        out = {"query": query, "search_type": search_type, "results": [], "total_count": 0, "processed_at": self.clock().isoformat()}
        try:
            text = validate(query, *s.query_length)
            out["language"] = self.spark.range(1).select(detect_language(F.lit(text), "first")).first()[0]
            count = fusion.clamp_limit(limit, s.limit, s.least_limit, s.most_limit)
            found = self._found(text, search_type, count, s.alpha if alpha is None else alpha, filters, query_vector, search_tags, out["language"])
            found = relational.ranked(found, *self._order(search_type))
            if search_type == "hybrid" and s.diversify and category in found.columns:
                found = relational.interleave(found, category, "rank").drop("rank").withColumnRenamed("diversified_rank", "rank")
            if expected_categories and s.domain_boost and category in found.columns:
                found = relational.preferred_first(found, category, expected_categories, "rank").drop("rank").withColumnRenamed("boosted_rank", "rank")
            if explain and "combined_score" in found.columns:
                found = found.withColumn("explanation", explanation(F.col("combined_score"), F.col("vector_score"), F.col("text_score")))
            if highlight:
                found = found.withColumn("snippet", lexical.highlight(F.col("content"), positive_words(parse(text))))
            rows = found.orderBy("rank").collect()
            out |= {"results": [r.asDict() for r in rows], "total_count": len(rows), "has_more": len(rows) >= count}
            scores = [r[self._score(search_type)] for r in rows]
            out["score_stats"] = {"min": round(min(scores), 4), "max": round(max(scores), 4), "avg": round(sum(scores) / len(scores), 4)} if scores else {}
        except (EngineError, ValueError) as e:
            out["error"] = str(e)
        out["execution_time_ms"] = round(1000 * (time.monotonic() - began))
        if log:
            self._log(out)
        return out

    def quick_search(self, query: str, limit: int = 10) -> list[dict]:
        """section_id and rank_score of the best sections by text; nothing for a query that fails."""
        try:
            return [r.asDict() for r in lexical.quick(self._sections(), validate(query, *self.config.search.query_length), limit).collect()]
        except (EngineError, ValueError):
            return []

    def search_with_highlighting(self, query: str, **options) -> dict:
        return self.search(query, "fulltext", **{**options, "highlight": True})

    def advanced_search(self, query: str, filters: dict, **options) -> dict:
        return self.search(query, "fulltext", **{**options, "filters": filters})

    def similar_sections(self, section_id: int, limit: int = 5) -> list[dict]:
        """Sections like one: by its vector, itself among them, or by the beginning of its text where it has none."""
        sections = self._sections()
        found = vector.like_section(sections, self._vectors(sections), section_id, limit)
        return [r.asDict() for r in found.collect()]

    def _score(self, search_type: str) -> str:
        return {"hybrid": "rerank_score", "vector": "similarity", "fulltext": "rank_score"}[search_type]

    def _order(self, search_type: str) -> list[Column]:
        return [F.desc(self._score(search_type)), F.asc("section_id")]

    def _found(self, text: str, search_type: str, count: int, alpha: float, filters: dict | None, query_vector: list[float] | None, search_tags: list[int] | None, language: str) -> DataFrame:
        s = self.config.search
        bridge, names = self.store.read("section_tags"), self.store.read("tags")
        sections = filtered(self._sections(), filters, bridge, names)
        if search_type == "fulltext":
            return lexical.search(sections, text, count)
        wanted = query_vector or self._embedding(text)
        vectors = self._vectors(sections)
        if search_type == "vector":
            near = vector.cascade(vectors, wanted, count, s.threshold, s.fallback_threshold, id_col="section_id").select("section_id", "similarity")
            if search_tags:
                near = vector.boosted(near, bridge, search_tags, s.tag_boost, limit=count, id_col="section_id")
            return sections.join(F.broadcast(near), "section_id")
        lists = tags.tag_lists(bridge, names)
        run = lambda q, low: hybrid(sections, vectors, q, wanted, count, alpha, s.fusion, s.rerank_pool, s.threshold, low, lists, language=language)
        found = run(text, s.fallback_threshold)
        plain = relax(text)
        if found.isEmpty() and plain:
            found = run(plain, s.relaxed_threshold)
        return found

    def _embedding(self, text: str) -> list[float]:
        if not self.provider:
            raise InvalidQueryError("a vector search needs an embedding provider or a query vector")
        return list(answers.with_retry(lambda: self.provider([text]))[0])

    def _log(self, out: dict) -> None:
        row = entry(self.spark, uuid.uuid4().int >> 65, str(out["query"]), out["search_type"], self.clock(), out["execution_time_ms"], out["total_count"], error=out.get("error"))
        try:
            self.store.append("search_logs", row)
        except EngineError:  # a search doesn't fail for its log
            pass

    def parse(self, query: str) -> dict:
        tree = parse(query or "")
        return {**summary(query), "tree": tree, "words": positive_words(tree)}

    def suggestions(self, prefix: str, limit: int = 10) -> list[str]:
        return [r.word for r in lexical.suggest(self._sections(), prefix, limit).collect()]

    def ask(self, question: str, **options) -> dict:
        found = self.search(question, **options)
        if "error" in found or not found["results"]:
            return {**answers.answer(question, "", self.model or str), "sources": [], "search": found}
        rows = self.spark.createDataFrame([{k: r.get(k) for k in ("section_id", "document_id", "section_title", "content", "rank")} for r in found["results"]], "section_id long, document_id long, section_title string, content string, rank int")
        text = answers.context(rows).first()[0]
        cited = answers.sources(rows, self.store.read("source_documents")).collect()
        if not self.model:
            raise InvalidParameterError("an answer needs a model")
        return {**answers.answer(question, text, self.model, found["language"]), "sources": [r.asDict() for r in cited], "search": found}

    # Tags, topics and numbers

    def create_tags(self, names: list[str] | dict) -> None:
        self.store.write("tags", tags.with_hierarchy(self.store.read("tags"), names, self.clock()))

    def tag_sections(self, section_ids: list[int], tag_ids: list[int], replace: bool = False) -> None:
        ids = lambda xs: self.spark.createDataFrame([(x,) for x in xs], "id long")
        self.store.write("section_tags", tags.linked(self.store.read("section_tags"), ids(section_ids), ids(tag_ids), "section_id", "tag_id", self.clock(), replace))

    def generate_tags(self, text: str, languages: tuple[str, ...] = ("en",)) -> dict:
        if not (text or "").strip() or not self.model:
            raise InvalidParameterError("tags need a text and a model")
        return answers.parse_tags(str(answers.with_retry(lambda: self.model(answers.tag_prompt(text, languages)))))

    def list_tags(self, page: int = 1, per_page: int = 20, search: str | None = None) -> dict:
        rows = tags.popular(self.store.read("tags"), self.store.read("section_tags"), None)
        if search:
            rows = relational.containing(rows, search, "name", ignore_case=True)
        rows, pager = relational.page(rows, [F.asc("name"), F.asc("id")], page, per_page)
        return {"tags": [r.asDict() for r in rows.collect()], **pager}

    def create_topic(self, name: str, description: str | None = None, tag_ids: list[int] | None = None) -> int:
        key = self.store.next_id("research_topics")
        self.store.upsert("research_topics", self.spark.createDataFrame([(key, name, description, self.clock())], "id long, name string, description string, created_at timestamp"))
        if tag_ids:
            self.store.insert_missing("research_topic_tags", self.spark.createDataFrame([(key, t, self.clock()) for t in tag_ids], "research_topic_id long, tag_id long, created_at timestamp"))
        return key

    def get_topic(self, topic_id: int) -> dict | None:
        """A topic with its tags' ids and the number of its sections."""
        row = relational.matching(self.store.read("research_topics"), {"id": topic_id}).first()
        if not row:
            return None
        own = lambda name: relational.matching(self.store.read(name), {"research_topic_id": topic_id})
        return {**row.asDict(), "tag_ids": [r[0] for r in own("research_topic_tags").select("tag_id").orderBy("tag_id").collect()], "section_count": own("research_topic_sections").count()}

    def update_topic(self, topic_id: int, name: str | None = None, description: str | None = None, tag_ids: list[int] | None = None) -> dict | None:
        """Changes what is given; with ``tag_ids`` they replace the topic's tags."""
        old = relational.matching(self.store.read("research_topics"), {"id": topic_id}).first()
        if not old:
            return None
        kept = (topic_id, old.name if name is None else name, old.description if description is None else description, old.created_at)
        self.store.upsert("research_topics", self.spark.createDataFrame([kept], TABLES["research_topics"].schema))
        if tag_ids is not None:
            bridge = tags.unlinked(self.store.read("research_topic_tags"), "research_topic_id", topic_id)
            fresh = self.spark.createDataFrame([(topic_id, t, self.clock()) for t in dict.fromkeys(tag_ids)], TABLES["research_topic_tags"].schema)
            self.store.write("research_topic_tags", bridge.unionByName(fresh))
        return self.get_topic(topic_id)

    def delete_topic(self, topic_id: int) -> dict:
        return self.store.delete("research_topics", F.col("id") == topic_id)

    def remove_old_embeddings(self, days: int = 30) -> dict:
        return self.store.delete_older("embeddings", self.clock(), days)

    def remove_old_logs(self, days: int = 30) -> dict:
        return self.store.delete_older("search_logs", self.clock(), days)

    def list_topics(self, page: int = 1, per_page: int = 20, search: str | None = None) -> dict:
        rows = relational.counted(self.store.read("research_topics"), self.store.read("research_topic_sections"), "id", "research_topic_id")
        if search:
            rows = relational.containing(rows, search, "name", "description", ignore_case=True)
        rows, pager = relational.page(rows, [F.asc("id")], page, per_page)
        return {"topics": [r.asDict() for r in rows.collect()], **pager}

    def add_document_to_topic(self, topic_id: int, document_id: int) -> dict:
        """Links a document's sections; those that are linked already aren't counted."""
        own = self.store.read("source_sections").where(F.col("document_id") == document_id)
        pairs = own.select(F.lit(topic_id).cast("long").alias("research_topic_id"), F.col("id").alias("section_id"), F.lit(self.clock()).alias("created_at"))
        return {"added_sections": self.store.insert_missing("research_topic_sections", pairs)}

    def remove_document_from_topic(self, topic_id: int, document_id: int) -> dict:
        bridge = self.store.read("research_topic_sections")
        own = self.store.read("source_sections").where(F.col("document_id") == document_id).select(F.col("id").alias("section_id"), F.lit(topic_id).cast("long").alias("research_topic_id"))
        keep = bridge.join(own, ["research_topic_id", "section_id"], "left_anti")
        removed = bridge.count() - keep.count()
        self.store.write("research_topic_sections", keep.select(*bridge.columns))
        return {"removed_sections": removed}

    def topic_recommendations(self, document_id: int, limit: int = 10) -> list[dict]:
        rows = tags.recommended_topics(self.store.read("research_topic_tags"), self.store.read("section_tags"), self.store.read("source_sections"), document_id, limit)
        return [r.asDict() for r in rows.collect()]

    def search_logs(self, limit: int = 50, search_type: str | None = None) -> list[dict]:
        rows = self.store.read("search_logs")
        rows = rows.where(F.col("search_type") == search_type) if search_type else rows
        return [r.asDict() for r in rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit).collect()]

    def statistics(self) -> dict:
        names = {"document_count": "source_documents", "section_count": "source_sections", "embedding_count": "embeddings", "tag_count": "tags", "topic_count": "research_topics"}
        return {r.name: r["count"] for r in relational.table_counts({k: self.store.read(v) for k, v in names.items()}).collect()}

    def clean_tag(self, name: str) -> str | None:
        return self.spark.range(1).select(clean_tag_name(F.lit(name))).first()[0]
