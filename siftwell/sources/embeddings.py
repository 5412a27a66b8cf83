"""Embedding sections by a provider that the caller gives, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.text import section_text
from siftwell.plans.answer import with_retry

Provider = Callable[[list[str]], list[list[float]]]


def embed(sections: DataFrame, provider: Provider, batch: int = 100, attempts: int = 3, id_col: str = "id") -> DataFrame:
    """source_id, vector and error of each section; a batch that fails is tried row by row, and a row that fails keeps its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(0, rows.num_rows, batch):
                part = rows.slice(i, batch)
                texts = part.column(1).to_pylist()
                try:
                    vectors, errors = list(with_retry(lambda texts=texts: provider(texts), attempts)), [None] * len(texts)
                except Exception:  # noqa: BLE001  then each row has its own chance
                    vectors, errors = [], []
                    for text in texts:
                        try:
                            vectors.append(provider([text])[0])
                            errors.append(None)
                        except Exception as e:  # noqa: BLE001  the row's error
                            vectors.append(None)
                            errors.append(f"{type(e).__name__}: {e}")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], names=["source_id", "vector", "error"])

    text = section_text(F.col("section_title"), F.col("section_number"), F.col("content"))
    return sections.select(F.col(id_col).cast("long").alias("source_id"), text.alias("text")).mapInArrow(run, "source_id long, vector array<float>, error string")


def missing(sections: DataFrame, embeddings: DataFrame, limit: int | None = None) -> DataFrame:
    """Sections without an embedding."""
    out = sections.join(embeddings.select(F.col("source_id").alias("__e")), F.col("id") == F.col("__e"), "left_anti")
    return out.orderBy("id").limit(limit) if limit is not None else out


def complete(sections: DataFrame, embeddings: DataFrame, provider: Provider, **options) -> DataFrame:
    """source_id and vector of all sections: those there are, and new ones for the rest."""
    fresh = embed(missing(sections, embeddings), provider, **options).where(F.col("error").isNull())
    return embeddings.select("source_id", "vector").unionByName(fresh.select("source_id", "vector"))


def tally(done: DataFrame) -> DataFrame:
    """How many rows succeeded and failed."""
    return done.agg(F.count_if(F.col("error").isNull()).alias("success"), F.count_if(F.col("error").isNotNull()).alias("failed"))
