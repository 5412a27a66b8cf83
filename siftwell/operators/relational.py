"""Filters, joins, aggregates, ranking and paging that the knowledge base's queries are made of."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matching(df: DataFrame, criteria: dict) -> DataFrame:
    """Rows that equal all given values; a list means one of them, null means null."""

    def one(name: str, value) -> Column:
        if isinstance(value, (list, tuple, set)):
            return F.col(name).isin(list(value))
        return F.col(name).isNull() if value is None else F.col(name) == value

    return df.where(reduce(lambda a, b: a & b, (one(k, v) for k, v in criteria.items()), F.lit(True)))


def containing(df: DataFrame, text: str, *columns: str, ignore_case: bool = False) -> DataFrame:
    """Rows of which one of the columns contains ``text`` literally."""
    has = [F.contains(F.lower(c), F.lit(text.lower())) if ignore_case else F.contains(F.col(c), F.lit(text)) for c in columns]
    return df.where(reduce(lambda a, b: a | b, has))


def recent(df: DataFrame, column: str, now: datetime | Column, days: int = 30) -> DataFrame:
    """Rows not older than ``days`` before ``now``, which is given, so that results don't change by themselves."""
    at = now if isinstance(now, Column) else F.lit(now)
    return df.where(F.col(column) >= at.cast("timestamp") - F.make_interval(days=F.lit(days)))


def fresh(df: DataFrame, column: str, now: datetime, age: timedelta = timedelta(hours=1)) -> DataFrame:
    """Rows not older than ``age`` before ``now``."""
    return df.where(F.col(column) >= F.lit(now - age).cast("timestamp"))


def exists(df: DataFrame, criteria: dict, name: str = "found") -> DataFrame:
    """One row that says whether any row equals the given values."""
    return matching(df, criteria).limit(1).agg((F.count("*") > 0).alias(name))


def older(df: DataFrame, column: str, now: datetime | Column, days: int) -> DataFrame:
    at = now if isinstance(now, Column) else F.lit(now)
    return df.where(F.col(column) < at.cast("timestamp") - F.make_interval(days=F.lit(days)))


def present(df: DataFrame, others: DataFrame, key: str, other_key: str | None = None) -> DataFrame:
    """Rows with a partner, each once however many it has."""
    return df.join(others.select(F.col(other_key or key).alias("__key")), F.col(key) == F.col("__key"), "left_semi")


def absent(df: DataFrame, others: DataFrame, key: str, other_key: str | None = None, null_too: bool = True) -> DataFrame:
    """Rows without a partner; those with a null key are among them unless told otherwise."""
    out = df.join(others.select(F.col(other_key or key).alias("__key")), F.col(key) == F.col("__key"), "left_anti")
    return out if null_too else out.where(F.col(key).isNotNull())


def stale(sections: DataFrame, index: DataFrame) -> DataFrame:
    """Sections that are not in the index or were changed after they were indexed."""
    done = index.select(F.col("section_id").alias("__id"), F.col("updated_at").alias("__indexed"))
    return sections.join(done, F.col("id") == F.col("__id"), "left").where(F.col("__id").isNull() | (F.col("updated_at") > F.col("__indexed"))).drop("__id", "__indexed")


def counted(parents: DataFrame, children: DataFrame, key: str, child_key: str, name: str = "section_count") -> DataFrame:
    """Parents with the number of their children, 0 where they have none. Children are counted before the join."""
    counts = children.groupBy(F.col(child_key).alias("__key")).agg(F.count("*").alias("__n"))
    return parents.join(counts, F.col(key) == F.col("__key"), "left").withColumn(name, F.coalesce("__n", F.lit(0))).drop("__key", "__n")


def top(df: DataFrame, limit: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(limit)


def counts_by(df: DataFrame, *columns: str) -> DataFrame:
    """The number of rows for each value."""
    return df.groupBy(*columns).agg(F.count("*").alias("count"))


def newest(df: DataFrame, limit: int, column: str = "created_at", id_col: str = "id") -> DataFrame:
    """The ``limit`` last rows by a time, those without one last."""
    return top(df, limit, F.desc_nulls_last(column), F.desc(id_col))


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Ranks from 1. The window has no partition, so it stands only after a limit."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> tuple[DataFrame, dict]:
    """A page of rows and what a pager shows; numbers below 1 mean the first page."""
    number, size = max(1, number), max(1, size)
    total = df.count()
    return df.orderBy(*order).offset((number - 1) * size).limit(size), {"total": total, "page": number, "per_page": size, "total_pages": -(-total // size)}


def latest(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in the given order. An aggregate, so each task keeps one row of a key before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    rank = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(rank)).where("__n = 1").drop("__n").select(*key, *rest)


def interleave(df: DataFrame, category: str, position: str, name: str = "diversified_rank") -> DataFrame:
    """Results dealt in turn from each category, categories by their first result: all firsts, then all seconds, and so on.

    For a result list that a limit has cut already; blank categories are ``uncategorized``.
    """
    own = F.when(F.trim(F.coalesce(F.col(category), F.lit(""))) == "", "uncategorized").otherwise(F.col(category))
    within = Window.partitionBy("__c").orderBy(position)
    out = df.withColumn("__c", own).withColumn("__n", F.row_number().over(within)).withColumn("__first", F.min(position).over(Window.partitionBy("__c")))
    return ranked(out, F.col("__n"), F.col("__first"), name=name).drop("__c", "__n", "__first")


def preferred_first(df: DataFrame, category: str, expected: list[str], position: str, name: str = "boosted_rank") -> DataFrame:
    """Results whose category contains an expected word come first, otherwise in their order."""
    words = [w for w in expected if w]
    hit = reduce(lambda a, b: a | b, (F.contains(F.col(category), F.lit(w)) for w in words), F.lit(False))
    return ranked(df, F.when(F.coalesce(hit, F.lit(False)), 0).otherwise(1), F.col(position), name=name)


def score_stats(df: DataFrame, column: str) -> DataFrame:
    """Smallest, largest and mean score to four places; no row for no scores."""
    out = df.agg(F.round(F.min(column), 4).alias("min"), F.round(F.max(column), 4).alias("max"), F.round(F.avg(column), 4).alias("avg"))
    return out.where("min is not null")


def min_max(df: DataFrame, column: str, name: str) -> DataFrame:
    """Scores scaled to 0..1 over all rows; where all are equal, 1 if positive, else 0. The two bounds are one broadcast row."""
    bounds = df.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    span = F.col("__hi") - F.col("__lo")
    scaled = F.when(F.abs(span) < 1e-9, F.when(F.col(column) > 0, 1.0).otherwise(0.0)).otherwise((F.col(column) - F.col("__lo")) / span)
    return df.crossJoin(F.broadcast(bounds)).withColumn(name, scaled).drop("__lo", "__hi")


def coverage(documents: DataFrame, sections: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Per document: sections, those with an embedding, and their share in percent to two places."""
    have = embeddings.groupBy(F.col("source_id").alias("__s")).agg(F.max("created_at").alias("__at"))
    joined = sections.join(have, F.col("id") == F.col("__s"), "left")
    per = joined.groupBy("document_id").agg(F.count("*").alias("total_sections"), F.count("__s").alias("embedded_sections"), F.max("__at").alias("latest_embedding"))
    out = documents.select(F.col("id").alias("document")).join(per, F.col("document") == F.col("document_id"), "left").drop("document_id")
    zero = ["total_sections", "embedded_sections"]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})
    return out.withColumn("coverage", F.coalesce(F.round(100.0 * F.col("embedded_sections") / F.nullif(F.col("total_sections"), F.lit(0)), 2), F.lit(0.0)))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name and count of each table, in one plan."""
    return reduce(DataFrame.unionAll, (df.agg(F.lit(name).alias("name"), F.count("*").alias("count")) for name, df in tables.items()))


def with_documents(sections: DataFrame, documents: DataFrame) -> DataFrame:
    """Sections with the language and title of their documents; null where the document's row is missing."""
    docs = documents.select(F.col("id").alias("__d"), "language", F.col("title").alias("document_title"))
    return sections.join(docs, F.col("document_id") == F.col("__d"), "left").drop("__d")


def spread(rows: DataFrame, least_bytes: int = 64 << 20) -> DataFrame:
    """``rows`` dealt out to all cores where their table is so small that it may be read by one task; larger tables are read by many and stay as they are."""
    spark = rows.sparkSession
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(spark.sparkContext.defaultParallelism) if size < least_bytes else rows
