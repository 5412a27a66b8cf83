"""Exact deduplication by content sort.

Normalised texts are range-partitioned by sampled splitters and sorted
externally, so that equal texts stand next to each other; each row is then
compared in full with its neighbour.  The splitters order by the first
characters of the normalised text, its digest and the identifier.  With the
identifier in the order, a text that fills a third of the table is split over
many partitions, and sampled keys stay short for the driver however long the
texts are.  A run of equal texts that touches a partition's border is joined
with its continuation by the full text; there are at most two such runs in a
partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import SPACE, cut, text_of

PREFIX = 12  # characters of the sort key that come before the digest
_ROWS = "doc_id long, digest string, keep long, keep_chars long, size long, part int, edge int, edge_text string"
_NAMES = ["doc_id", "digest", "keep", "keep_chars", "size", "part", "edge", "edge_text"]


def _emit(ids: pa.Array, digest: pa.Array, keep: pa.Array, chars: pa.Array, size: np.ndarray, part: int, edge: int = 0, text: str | None = None) -> pa.RecordBatch:
    n = len(ids)
    texts = pa.array([text] + [None] * (n - 1), pa.string()) if text is not None else pa.nulls(n, pa.string())
    return pa.RecordBatch.from_arrays([ids, digest, keep, chars, pa.array(size, pa.int64()), pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, edge, np.int32)), texts], names=_NAMES)


class _Run:
    """The run of equal texts at the end of what was read: its identifiers, its best row and its text."""

    def __init__(self, ids: pa.Array, digest: str, keep, chars: int, text: str, first: bool):
        self.ids, self.digest, self.keep, self.chars, self.text, self.first = [ids], digest, keep, chars, text, first

    def rows(self, part: int, edge: int) -> Iterator[pa.RecordBatch]:
        size, text = sum(map(len, self.ids)), self.text if edge else None
        for ids in self.ids:
            n = len(ids)
            yield _emit(ids, pa.array([self.digest] * n, pa.string()), pa.array([self.keep] * n, pa.int64()), pa.array([self.chars] * n, pa.int64()), np.full(n, size), part, edge, text)
            text = None


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal neighbours in a sorted partition (columns norm, digest, chars, doc_id; a run's best row comes first)."""
    part, last = TaskContext.get().partitionId(), None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        norm, digest, chars, ids = (batch.column(k) for k in range(4))
        starts = [0] if n == 1 else [0, *(np.flatnonzero(~pc.equal(norm.slice(1), norm.slice(0, n - 1)).to_numpy(zero_copy_only=False)) + 1)]
        if last and last.text == norm[0].as_py():
            end = int(starts[1]) if len(starts) > 1 else n
            last.ids.append(ids.slice(0, end))
            starts = starts[1:]
        if not len(starts):
            continue
        first = last is None
        if last:
            yield from last.rows(part, 1 if last.first else 0)
        begin = int(starts[0])
        if first and len(starts) > 1:  # the partition's first run may go on before it
            end = int(starts[1])
            yield from _Run(ids.slice(begin, end - begin), digest[begin].as_py(), ids[begin].as_py(), chars[begin].as_py(), norm[begin].as_py(), True).rows(part, 1)
            starts, first = starts[1:], False
        if len(starts) > 1:
            lo, hi = int(starts[0]), int(starts[-1])
            size = np.diff(np.array(starts))
            at = pa.array(np.repeat(np.array(starts[:-1]), size))
            yield _emit(ids.slice(lo, hi - lo), digest.slice(lo, hi - lo), ids.take(at), chars.take(at), np.repeat(size, size), part)
        at = int(starts[-1])
        last = _Run(ids.slice(at), digest[at].as_py(), ids[at].as_py(), chars[at].as_py(), norm[at].as_py(), first)
    if last:
        yield from last.rows(part, 1 if last.first else 2)


def normalised(text: str = "text"):
    return F.regexp_replace(text_of(text), SPACE + "+", "")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without white space.  Of equal
    texts the one with the most code points stays, then the smallest id.  A
    null text is empty; empty texts equal each other.  A null id sorts last and
    stays only where its whole group has none.  Rows that repeat an id and a
    text are counted each; each of them that has the id that stays is ``kept``.
    Other columns are not read.  An empty table gives an empty result.
    """
    keyed = docs.select(normalised(text_col).alias("norm"), F.char_length(text_of(text_col)).cast("long").alias("chars"), F.col(id_col).cast("long").alias("doc_id"))
    keyed = keyed.select("norm", F.sha2("norm", 256).alias("digest"), "chars", "doc_id")
    key = [F.substring("norm", 1, PREFIX), F.col("digest")]
    order = F.col("doc_id").asc_nulls_last()
    ranged = keyed.repartitionByRange(*key, order).sortWithinPartitions(*key, "norm", F.desc("chars"), order)
    rows = cut(ranged.mapInArrow(_runs, _ROWS))
    best = F.min(F.struct((-F.col("keep_chars")).alias("a"), F.col("keep").isNull().alias("b"), F.col("keep").alias("c")))
    edges = rows.where(F.col("edge_text").isNotNull())
    whole = edges.groupBy("edge_text").agg(best.alias("best"), F.sum("size").alias("total"), F.collect_list(F.struct("part", "edge")).alias("at"))
    whole = whole.select(F.explode("at").alias("at"), F.col("best.c").alias("whole_keep"), "total").select("at.part", "at.edge", "whole_keep", "total")
    # At most two rows for each partition, so the broadcast is bounded.
    out = rows.join(F.broadcast(whole), ["part", "edge"], "left")
    keep = F.when(F.col("total").isNull(), F.col("keep")).otherwise(F.col("whole_keep"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("total", "size").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat an id and a text one stays."""
    kept = cut(exact_duplicates(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__digest")))
    repeated = not kept.groupBy("__id", "__digest").count().where("count > 1").isEmpty()
    digest = F.sha2(normalised(text_col), 256)
    out = docs.withColumn("__digest_of", digest)
    out = out.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col("__digest_of") == F.col("__digest")), "left_semi")
    if repeated:
        out = out.dropDuplicates([id_col, "__digest_of"])
    return out.drop("__digest_of")
