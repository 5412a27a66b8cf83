"""Keeping the index up to date from streams, and popularity over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftwell.operators.lexical import postings
from siftwell.schemas import TABLES


def changed_sections(spark: SparkSession, path: str) -> DataFrame:
    """A stream of section rows from Parquet files as they appear in a folder."""
    return spark.readStream.schema(TABLES["source_sections"].schema).parquet(path)


def new_files(spark: SparkSession, path: str) -> DataFrame:
    """A stream of path and content of text files as they appear in a folder."""
    return spark.readStream.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def latest_rows(index: DataFrame) -> DataFrame:
    """The postings of each section's last batch; earlier ones are dropped."""
    last = index.groupBy(F.col("section_id").alias("__s")).agg(F.max("batch").alias("__b"))
    return index.join(last, (F.col("section_id") == F.col("__s")) & (F.col("batch") == F.col("__b"))).drop("__s", "__b")


def maintain(sections: DataFrame, index_path: str, checkpoint: str, language: str = "en", once: bool = True) -> StreamingQuery:
    """Writes the postings of each batch of changed sections under ``index_path``; read them with latest_rows.

    A batch's folder is replaced when the batch runs again after a failure, so each is there once.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumnRenamed("id", "section_id").withColumn("language", F.lit(language))
        newest = rows.groupBy("section_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "section_id"]), F.coalesce("updated_at", "created_at")).alias("r")).select("section_id", "r.*")
        postings(newest).write.mode("overwrite").parquet(f"{index_path}/batch={number}")

    writer = sections.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def popularity(logs: DataFrame, window: str = "24 hours", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Queries by window of time, of a table or a stream."""
    rows = logs.withWatermark("created_at", late) if logs.isStreaming else logs
    counts = rows.groupBy(F.window("created_at", window, slide).alias("w"), "query").agg(F.count("*").alias("count"))
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "query", "count")
