"""Documents from files, with their metadata, as a table.

Any path that Spark reads will do. Markdown is taken as it is, HTML in SQL;
other formats go through a converter that the caller gives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.errors import DocumentConversionError
from siftwell.functions.text import detect_language, first_line, html_body, html_keywords, html_meta, html_title

MARKDOWN, HTML = ("md", "markdown"), ("html", "htm")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """path and content of Markdown or plain text files, one row each."""
    files = spark.read.option("wholetext", True).text(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, extension, file_size, modified_at and raw content of files; contents are read only where used."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("extension"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified_at"), F.col("content").alias("raw"))


def html_metadata(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Adds title, author, description, keywords and body of HTML pages."""
    html = F.col(html_col)
    return pages.withColumns({"title": html_title(html), "author": html_meta(html, "author"), "description": html_meta(html, "description"), "keywords": html_keywords(html), "body": html_body(html)})


def convert(files: DataFrame, converters: dict[str, Callable[[bytes], str]], attempts: int = 3) -> DataFrame:
    """path, content and error: files converted by their extension, each tried a few times; a failure is kept as an error, not raised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for extension, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text, error = None, f"no converter for {extension}"
                for _ in range(attempts if extension in converters else 0):
                    try:
                        text, error = converters[extension](raw), None
                        break
                    except Exception as e:  # noqa: BLE001  whatever a converter raises is the row's error
                        error = f"{type(e).__name__}: {e}"
                texts.append(text)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "content", "error"])

    return files.select("path", "extension", "raw").mapInArrow(run, "path string, content string, error string")


def documents(spark: SparkSession, path: str, pattern: str = "*", converters: dict[str, Callable[[bytes], str]] | None = None, options: dict | None = None) -> DataFrame:
    """Rows for source_documents with their content: title, author, description, language, metadata and download_state.

    Metadata that a file holds gives way to ``options["title"]``, and both to ``options["metadata"]``.
    """
    options = options or {}
    files = read_files(spark, path, pattern)
    text = F.when(F.col("extension").isin(*MARKDOWN, "txt", *HTML), F.decode("raw", "UTF-8"))
    plain = files.where(F.col("extension").isin(*MARKDOWN, "txt", *HTML)).withColumns({"content": text, "error": F.lit(None).cast("string")})
    if converters:
        others = files.where(F.col("extension").isin(list(converters)))
        done = convert(others, converters).withColumnRenamed("path", "__path")
        plain = plain.unionByName(others.join(done, F.col("path") == F.col("__path")).drop("__path"))
    is_html = F.col("extension").isin(*HTML)
    found = html_metadata(plain, "content")
    shown = F.when(is_html, F.col("body")).otherwise(F.col("content"))
    heading = F.nullif(F.trim(F.regexp_replace(first_line(F.col("content")), r"^#+\s*", "")), F.lit(""))
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    given = {**({"title": options["title"]} if "title" in options else {}), **options.get("metadata", {})}
    pick = lambda key, own: F.lit(given[key]) if key in given else own
    metadata = F.to_json(F.struct("path", "file_size", "extension", F.date_format("modified_at", "yyyy-MM-dd'T'HH:mm:ss").alias("modified_at"), F.when(is_html, F.col("keywords")).alias("keywords")))
    return found.select(
        F.xxhash64("path").alias("id"),
        pick("title", F.coalesce(F.when(is_html, F.col("title")), F.when(~is_html, heading), name)).alias("title"),
        F.col("path").alias("url"),
        pick("author", F.when(is_html, F.col("author"))).cast("string").alias("author"),
        pick("description", F.when(is_html, F.col("description"))).cast("string").alias("description"),
        pick("language", detect_language(shown, "ratio")).alias("language"),
        F.when(F.col("error").isNull(), 1).otherwise(2).alias("download_state"),
        metadata.alias("metadata"),
        shown.alias("content"),
        "error",
    )


def manifest(spark: SparkSession, rows: list[dict], root: str) -> DataFrame:
    """A curated list (file, title, tags, category, language) joined to the files' contents; files that are missing have a null content."""
    schema = "file string, title string, tags array<string>, category string, language string"
    listed = spark.createDataFrame([(r["file"], r.get("title"), r.get("tags") or [], r.get("category"), r.get("language")) for r in rows], schema)
    files = read_markdown(spark, root).withColumn("__file", F.regexp_extract("path", r"([^/]+)$", 1))
    out = listed.join(files, F.regexp_extract("file", r"([^/]+)$", 1) == F.col("__file"), "left").drop("__file")
    return out.withColumn("language", F.coalesce("language", detect_language(F.col("content"), "first_korean")))


def import_json(spark: SparkSession, path: str, known: DataFrame, schema: str = "title string, content string, url string, author string, language string") -> DataFrame:
    """Rows of JSON lines whose title isn't known yet; of a repeated title the first by url stays."""
    rows = spark.read.schema(schema).json(path)
    first = rows.groupBy("title").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "title"]), F.coalesce("url", F.lit(""))).alias("r")).select("title", "r.*")
    return first.join(known.select(F.col("title").alias("__t")), F.col("title") == F.col("__t"), "left_anti")


def require(text: str | None) -> str:
    if not text:
        raise DocumentConversionError("nothing was converted")
    return text
