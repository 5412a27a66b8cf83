"""Tables of a knowledge base: schemas, keys, references, and the rules that their rows keep."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, FloatType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

_TYPES: dict[str, DataType] = {
    "BIGINT": LongType(),
    "INT": IntegerType(),
    "STRING": StringType(),
    "BOOLEAN": BooleanType(),
    "DATE": DateType(),
    "TIMESTAMP": TimestampType(),
    "ARRAY<FLOAT>": ArrayType(FloatType()),
    "ARRAY<INT>": ArrayType(IntegerType()),
    "ARRAY<STRING>": ArrayType(StringType()),
}


def _schema(columns: str) -> StructType:
    """A schema without a session, of comma-separated names and types."""
    return StructType([StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))])


@dataclass(frozen=True)
class Table:
    schema: StructType
    key: tuple[str, ...]
    #: Column to the table it points to; rows go with what they point to, but for SET_NULL.
    references: dict[str, str] = field(default_factory=dict)
    rules: tuple[tuple[str, str], ...] = ()


SET_NULL = {("tags", "parent_id")}

TABLES: dict[str, Table] = {
    "source_documents": Table(
        _schema("id BIGINT, title STRING, url STRING, author STRING, publication_date DATE, language STRING, description STRING, download_state INT, metadata STRING, created_at TIMESTAMP, updated_at TIMESTAMP"),
        ("id",),
        rules=(("title", "title IS NOT NULL AND trim(title) <> ''"), ("language", "language IS NULL OR language RLIKE '^[a-z]{2}(_[a-z]{2})?$'"), ("download_state", "download_state IN (0, 1, 2)")),
    ),
    "source_sections": Table(
        _schema("id BIGINT, document_id BIGINT, content STRING, section_title STRING, section_number INT, created_at TIMESTAMP, updated_at TIMESTAMP"),
        ("id",),
        {"document_id": "source_documents"},
        (("content", "content IS NOT NULL AND trim(content) <> ''"), ("document_id", "document_id IS NOT NULL"), ("section_title", "section_title IS NULL OR length(section_title) <= 500")),
    ),
    "tags": Table(_schema("id BIGINT, name STRING, parent_id BIGINT, created_at TIMESTAMP"), ("id",), {"parent_id": "tags"}, (("name", "name IS NOT NULL AND trim(name) <> '' AND length(name) <= 255"), ("parent_id", "parent_id IS NULL OR parent_id <> id"))),
    "research_topics": Table(_schema("id BIGINT, name STRING, description STRING, created_at TIMESTAMP"), ("id",), {}, (("name", "name IS NOT NULL AND trim(name) <> '' AND length(name) <= 255"),)),
    "section_tags": Table(_schema("section_id BIGINT, tag_id BIGINT, created_at TIMESTAMP"), ("section_id", "tag_id"), {"section_id": "source_sections", "tag_id": "tags"}),
    "research_topic_sections": Table(_schema("research_topic_id BIGINT, section_id BIGINT, created_at TIMESTAMP"), ("research_topic_id", "section_id"), {"research_topic_id": "research_topics", "section_id": "source_sections"}),
    "research_topic_tags": Table(_schema("research_topic_id BIGINT, tag_id BIGINT, created_at TIMESTAMP"), ("research_topic_id", "tag_id"), {"research_topic_id": "research_topics", "tag_id": "tags"}),
    "text_search_configs": Table(_schema("language_code STRING, config_name STRING, is_installed BOOLEAN"), ("language_code",), {}, (("language_code", "language_code RLIKE '^[a-z_]{2,10}$'"), ("config_name", "config_name IS NOT NULL"))),
    "section_fts": Table(_schema("section_id BIGINT, document_id BIGINT, language STRING, title_terms ARRAY<STRING>, content_terms ARRAY<STRING>, created_at TIMESTAMP, updated_at TIMESTAMP"), ("section_id",), {"section_id": "source_sections", "document_id": "source_documents"}),
    "embeddings": Table(_schema("id BIGINT, source_id BIGINT, vector ARRAY<FLOAT>, created_at TIMESTAMP"), ("id",), {"source_id": "source_sections"}, (("vector", "vector IS NOT NULL AND size(vector) > 0"), ("source_id", "source_id IS NOT NULL"))),
    "search_logs": Table(
        _schema("id BIGINT, query STRING, search_type STRING, execution_time_ms INT, results_count INT, query_vector ARRAY<FLOAT>, result_ids ARRAY<INT>, filters STRING, created_at TIMESTAMP"),
        ("id",),
        {},
        (("query", "query IS NOT NULL"), ("search_type", "search_type IN ('vector', 'fulltext', 'hybrid')"), ("execution_time_ms", "execution_time_ms IS NULL OR execution_time_ms >= 0"), ("results_count", "results_count IS NULL OR results_count >= 0")),
    ),
}

DOWNLOAD_STATES = {"pending": 0, "completed": 1, "failed": 2}

# Language code and name of its text search configuration.
LANGUAGE_CONFIGS = (
    ("en", "pg_catalog.english"),
    ("en_us", "pg_catalog.english"),
    ("en_gb", "pg_catalog.english"),
    ("zh", "jiebacfg"),
    ("zh_cn", "jiebacfg"),
    ("zh_tw", "jiebacfg"),
    ("ja", "pg_catalog.simple"),
    ("ja_jp", "pg_catalog.simple"),
    ("ko", "pg_catalog.simple"),
    ("ko_kr", "pg_catalog.simple"),
    ("es", "pg_catalog.spanish"),
    ("fr", "pg_catalog.french"),
    ("de", "pg_catalog.german"),
    ("it", "pg_catalog.italian"),
    ("ru", "pg_catalog.russian"),
    ("ar", "pg_catalog.simple"),
    ("default", "pg_catalog.simple"),
)
SIMPLE_CONFIG = "pg_catalog.simple"


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name].schema)


def language_configs(spark: SparkSession) -> DataFrame:
    """The seed of text_search_configs."""
    return spark.createDataFrame([(code, config, True) for code, config in LANGUAGE_CONFIGS], TABLES["text_search_configs"].schema)


def violations(df: DataFrame, name: str) -> DataFrame:
    """Rows of ``df`` that break a rule of the table, with the names of the rules' columns in ``broken``."""
    rules = TABLES[name].rules
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(column)) for column, rule in rules))) if rules else F.array().cast("array<string>")
    return df.withColumn("broken", broken).where(F.size("broken") > 0)


def repeated_keys(df: DataFrame, name: str) -> DataFrame:
    """Keys that several rows have, with their count."""
    return df.groupBy(*TABLES[name].key).count().where("count > 1")


def missing_references(df: DataFrame, name: str, others: dict[str, DataFrame]) -> DataFrame:
    """Rows that point to a row that another table lacks."""
    parts = []
    for column, other in TABLES[name].references.items():
        keys = others[other].select(F.col(TABLES[other].key[0]).alias("__key"))
        parts.append(df.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("__key"), "left_anti").withColumn("broken", F.lit(column)))
    return reduce(DataFrame.unionByName, parts) if parts else df.withColumn("broken", F.lit("")).limit(0)


def state_name(state: Column) -> Column:
    """The name of a download state."""
    out = F.lit(None).cast("string")
    for name, number in DOWNLOAD_STATES.items():
        out = F.when(state == number, F.lit(name)).otherwise(out)
    return out
