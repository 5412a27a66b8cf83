"""Search logs: rows, analytics and export."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.operators.relational import recent
from siftwell.operators.vector import similar

SLOW_MS = 100
CSV_COLUMNS = ["id", "query", "search_type", "execution_time_ms", "results_count", "created_at"]


def entry(spark, row_id: int, query: str, search_type: str, now: datetime, execution_time_ms: int = 0, results_count: int = 0, result_ids: list[int] | None = None, filters: dict | None = None, error: str | None = None, schema=None) -> DataFrame:
    """One log row; an error is kept in the filters."""
    from siftwell.schemas import TABLES

    kept = {"error": error} if error else filters
    row = (row_id, query, search_type, execution_time_ms, results_count, None, result_ids, json.dumps(kept) if kept is not None else None, now)
    return spark.createDataFrame([row], schema or TABLES["search_logs"].schema)


def slow(logs: DataFrame, threshold_ms: float = SLOW_MS) -> DataFrame:
    return logs.where(F.col("execution_time_ms") > threshold_ms)


def without_results(logs: DataFrame) -> DataFrame:
    return logs.where((F.col("results_count") == 0) | F.col("results_count").isNull())


def with_many_results(logs: DataFrame, threshold: int = 100) -> DataFrame:
    return logs.where(F.col("results_count") > threshold)


def with_flags(logs: DataFrame) -> DataFrame:
    return logs.withColumns({"successful": F.coalesce(F.col("results_count") > 0, F.lit(False)), "slow": F.coalesce(F.col("execution_time_ms") > SLOW_MS, F.lit(False))})


def popular(logs: DataFrame, limit: int = 20, now: Column | datetime | None = None, days: int = 1) -> DataFrame:
    """Queries by how often they were asked, of the last days where ``now`` is given."""
    rows = recent(logs, "created_at", now, days) if now is not None else logs
    return rows.groupBy("query").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "query").limit(limit)


def time_by_type(logs: DataFrame) -> DataFrame:
    rows = logs.where(F.col("execution_time_ms").isNotNull())
    return rows.groupBy("search_type").agg(F.round(F.avg("execution_time_ms"), 4).alias("avg_time"), F.count("*").alias("count")).orderBy(F.desc("avg_time"))


def latency(logs: DataFrame, *shares: float) -> DataFrame:
    """Smallest, mean and largest time of each type and its percentiles, interpolated."""
    columns = [F.percentile("execution_time_ms", F.lit(p)).alias(f"p{round(100 * p)}") for p in shares or (0.5, 0.95, 0.99)]
    return logs.groupBy("search_type").agg(F.min("execution_time_ms").alias("min"), F.avg("execution_time_ms").alias("avg"), F.max("execution_time_ms").alias("max"), *columns)


def in_period(logs: DataFrame, start, end) -> DataFrame:
    return logs.where(F.col("created_at").between(start, end))


def period(logs: DataFrame, start, end) -> DataFrame:
    """Totals of a period: searches, mean time, with and without results."""
    found = F.coalesce(F.col("results_count"), F.lit(0)) > 0
    return in_period(logs, start, end).agg(F.count("*").alias("total"), F.round(F.avg("execution_time_ms"), 4).alias("avg_time"), F.count_if(found).alias("successful"), F.count_if(~found).alias("failed"))


def gaps(logs: DataFrame, least: int = 2) -> DataFrame:
    """Queries that were asked again and again without results."""
    return without_results(logs).groupBy("query").agg(F.count("*").alias("searches"), F.max("created_at").alias("last")).where(F.col("searches") >= least).orderBy(F.desc("searches"), "query")


def alike(logs: DataFrame, vector: list[float], limit: int = 10) -> DataFrame:
    """Earlier queries with results within a cosine distance of 0.3."""
    return similar(logs.where(F.col("results_count") > 0), vector, limit, 0.7, vector_col="query_vector")


def export(logs: DataFrame, path: str, start, end, fmt: str = "json") -> DataFrame:
    """Writes a period's rows, as JSON with all columns or as CSV with CSV_COLUMNS, and returns them."""
    rows = in_period(logs, start, end)
    if fmt == "json":
        rows.write.mode("overwrite").json(path)
    elif fmt == "csv":
        rows.select(CSV_COLUMNS).write.mode("overwrite").option("header", True).csv(path)
    elif fmt != "rows":
        raise ValueError(f"unknown format {fmt}")
    return rows
