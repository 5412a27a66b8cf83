"""Near-duplicates by min-max hashing, with links confirmed on full shingle sets.

Under each permutation both the smallest and the largest hash of a set are
retained; each of them agrees between two sets with their Jaccard similarity
as probability, so a signature costs half the hash evaluations of plain
MinHash.  Bands of five minima or five maxima deal documents into buckets: at
similarity 0.75 two documents share none of the 40 buckets with probability
2e-5.

A node is a set that a task met: equal sets of one task are one node from the
start, and only nodes go into buckets.  Links are confirmed in three rounds,
each followed by connected components:

1. A node is compared with one other, the smallest node with which it shares
   several buckets as their smallest node; most copies are linked here.
2. In buckets that still hold several components, nodes are compared with the
   root of the largest one, the bucket's pivot.
3. What is left is compared in pairs, but for those that can't be similar:
   shingles that no other open node has are counted, two nodes can't share more
   of the pivot's than either has, nor more than neither misses, where bits
   show which of those both may miss; and beyond that no more than
   either has of shingles that are neither the pivot's nor its own.

So a bucket of thousands of near copies costs a few comparisons for each, no
link between components is lost to the choice of representatives, and no
bucket is capped.  Only texts of nodes that share a bucket are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import cut, discard, tasks
from siftwell.llm.shingles import chunks, mix, shingle_sets, text_bytes

WORDS = 5
SIMILARITY = 75  # percent
PERMUTATIONS = 100
BAND_ROWS = 5
MASKS = 8  # words of 64 bits, a power of two
FIRST_BANDS = 5  # shared buckets that make a node a likely match

_RANDOM = np.random.default_rng(7)
_A = _RANDOM.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_M = _RANDOM.integers(1, 1 << 63, BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minmax_bands(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One row of band hashes for each set that isn't empty."""
    begins = (np.cumsum(sizes) - sizes)[sizes > 0]
    low, high = (np.empty((len(begins), PERMUTATIONS), np.uint64) for _ in range(2))
    for k in range(PERMUTATIONS if len(begins) else 0):
        x = sets * _A[k]
        x += _B[k]
        low[:, k] = np.minimum.reduceat(x, begins)
        high[:, k] = np.maximum.reduceat(x, begins)
    both = np.concatenate([low, high], axis=1).reshape(len(begins), 2 * PERMUTATIONS // BAND_ROWS, BAND_ROWS)
    bands = (both * _M).sum(axis=2, dtype=np.uint64) + np.arange(both.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(bands).view(np.int64)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles, digest_size=16).digest()


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node, digest and, for the first row of a node, the bands of each row; rows without an id or a shingle have none of them."""
    nodes: dict[bytes, int] = {}  # of this task
    first = TaskContext.get().partitionId() << 36
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        named = batch.column(0).is_valid().to_pylist()
        for i, j in chunks(offsets):
            sets, sizes = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], WORDS)
            ends = np.cumsum(sizes).tolist()
            digests = [_digest(sets[e - n : e]) if n and named[i + k] else None for k, (e, n) in enumerate(zip(ends, sizes.tolist(), strict=True))]
            new = np.array([d is not None and d not in nodes and nodes.setdefault(d, first + len(nodes)) >= 0 for d in digests], bool)
            kept = np.repeat(new, sizes)
            bands = minmax_bands(sets[kept], sizes[new])
            at = np.concatenate(([0], np.cumsum(np.where(new, 2 * PERMUTATIONS // BAND_ROWS, 0)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(bands.reshape(-1)), mask=pa.array(~new))
            columns = [batch.column(0).slice(i, j - i), pa.array(sizes.astype(np.int64)), pa.array([d and nodes[d] for d in digests], pa.int64()), pa.array(digests, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "node", "digest", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of each node, from rows (node, best, digest, text) of which those of another text are left out."""
    seen: set[int] = set()
    for batch in batches:
        data, offsets = text_bytes(batch.column(3))
        nodes, digests = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for i, j in chunks(offsets):
            sets, sizes = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], WORDS)
            ends = np.cumsum(sizes).tolist()
            keep = []
            for k in range(i, j):
                keep.append(nodes[k] not in seen and _digest(sets[ends[k - i] - int(sizes[k - i]) : ends[k - i]]) == digests[k])
                if keep[-1]:
                    seen.add(nodes[k])
            keep = np.array(keep, bool)
            at = np.concatenate(([0], np.cumsum(sizes[keep]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(sets[np.repeat(keep, sizes)].view(np.int64)))
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).filter(mask), batch.column(1).slice(i, j - i).filter(mask), lists], names=["node", "best", "shingles"])


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, size_a, common, enough and masks of ``pairs`` (a, b and maybe b's shingles): the size of a and of what both share, whether they are similar enough, and bits for the shingles of a that b misses."""
    if "shingles" not in pairs.columns:
        pairs = pairs.join(sets.select(F.col("node").alias("__b"), "shingles"), F.col("b") == F.col("__b"))
    both = pairs.join(sets.select(F.col("node").alias("__a"), F.col("shingles").alias("others")), F.col("a") == F.col("__a"))
    both = both.select("a", "b", F.size("others").alias("size_a"), F.size("shingles").alias("size_b"), F.array_except("others", "shingles").alias("missing"))
    masks = [_mask(k).alias(f"mask{k}") for k in range(MASKS)]
    both = both.select("a", "b", "size_a", "size_b", F.size("missing").alias("miss"), *masks)
    common = F.col("size_a") - F.col("miss")
    return both.select("a", "b", "size_a", common.alias("common"), (100 * common >= SIMILARITY * (F.col("size_b") + F.col("miss"))).alias("enough"), *(f"mask{k}" for k in range(MASKS)))


def _mask(word: int):
    """A word of the bits of the missing shingles."""
    here = F.filter("missing", lambda x: F.shiftright(x, 6).bitwiseAND(MASKS - 1) == word)
    return F.aggregate(here, F.lit(0).cast("long"), lambda bits, x: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int"))))


def _both_miss(one: str, two: str):
    """The most shingles that two nodes can both miss: those of bits that both have, and what shares a bit with another."""
    def single(x: str):
        return F.col("miss" + x) - sum(F.bit_count(f"mask{k}{x}") for k in range(MASKS))

    return sum(F.bit_count(F.col(f"mask{k}{one}").bitwiseAND(F.col(f"mask{k}{two}"))) for k in range(MASKS)) + F.least(single(one), single(two))


def own_shingles(sets: DataFrame) -> DataFrame:
    """node and own, the number of shingles that none of the other ``sets`` (node, shingles) has; nodes without such shingles are left out."""
    held = sets.select("node", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("last"))
    return held.where("node = last").groupBy("node").agg(F.count("*").alias("own"))


def moved(frame: DataFrame, labels: DataFrame, *columns: str) -> DataFrame:
    """``frame`` with the nodes in ``columns`` replaced by their roots in ``labels`` (node, root); nodes that aren't there are roots."""
    for c in columns:
        frame = frame.join(labels.select(F.col("node").alias("__n"), F.col("root").alias("__r")), F.col(c) == F.col("__n"), "left").withColumn(c, F.coalesce("__r", c)).drop("__n", "__r")
    return frame


def followed(labels: DataFrame, up: DataFrame) -> DataFrame:
    """``labels`` (node, root) after their roots got roots in ``up``, and the rows of ``up``."""
    return moved(labels, up, "root").unionByName(up)


def components(links: DataFrame) -> DataFrame:
    """node and root, the smallest node reachable, of the nodes of ``links`` (a, b) that aren't roots themselves.

    Each node hooks on its smallest neighbour if that is smaller, and pointers
    jump until all hooks end in roots; links between different roots are what is left for the
    next level.  Each level leaves half of a component's roots at most.
    """
    links = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    labels = links.sparkSession.createDataFrame([], "node long, root long")
    while count := links.count():
        few = tasks(count)  # small tables needn't be written in many pieces
        links = links.coalesce(few)
        hooks = cut(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")).coalesce(few))
        tree = hooks.count() == count  # each link is a hook
        while True:
            up = hooks.select(F.col("node").alias("up"), F.col("root").alias("up_root"))
            jumped = cut(hooks.join(up, F.col("root") == F.col("up"), "left").select("node", F.coalesce("up_root", "root").alias("root"), F.col("up").isNotNull().alias("jumped")).coalesce(few))
            if jumped.where("jumped").isEmpty():
                break
            hooks = jumped.select("node", "root")
        labels = cut(followed(labels, hooks).coalesce(few))
        if tree:
            break
        rest = moved(links, hooks, "a", "b").where("a <> b")
        links = cut(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().coalesce(few))
    return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents are linked when their sets of 5-word shingles have a Jaccard
    similarity of 0.75 or more; ``component_id`` is the smallest id reachable.
    A null or empty text has an empty set and links with nothing.  A row
    with a null id links with nothing and is kept, its component null.  Rows
    that repeat an id are one document, linked by every text they have.  Other
    columns are not read; an empty table gives an empty result.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = cut(own.mapInArrow(_signatures, "doc_id long, n_shingles long, node long, digest binary, bands array<long>"))
    used = []  # checkpoints that nothing needs after the last round

    def keep(frame: DataFrame) -> DataFrame:
        used.append(cut(frame))
        return used[-1]

    buckets = signed.where("bands is not null").select(F.explode("bands").alias("bucket"), "node", F.col("n_shingles").alias("n"))
    ends = buckets.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("head"), F.max("node").alias("last")).where("head.node <> last")
    # Only buckets of several nodes matter from here on.
    shared = buckets.join(ends, "bucket").select("bucket", "node", "n", F.col("head.node").alias("head"), F.col("head.n").alias("head_n"))
    fits = (F.col("node") != F.col("head")) & (F.least("n", "head_n") * 100 >= F.greatest("n", "head_n") * SIMILARITY)
    # A node has a row for each band at most.
    by_head = shared.repartition("node").groupBy("node", "head").agg(F.count(F.when(fits, 1)).alias("times"), F.first("n").alias("n"), F.collect_list("bucket").alias("in_buckets"))
    likely = F.struct(F.least("times", F.lit(FIRST_BANDS)), -F.col("head"))
    nodes = by_head.groupBy("node").agg(F.first("n").alias("n"), F.max_by(F.when(F.col("times") > 0, F.col("head")), F.when(F.col("times") > 0, likely)).alias("best"), F.flatten(F.collect_list("in_buckets")).alias("in_buckets"))
    nodes = keep(nodes)
    asked = signed.where("bands is not null").select("node", F.col("doc_id").alias("of"), "digest").join(nodes.select(F.col("node").alias("__n"), "best"), F.col("node") == F.col("__n"))
    sets = keep(asked.join(own, F.col("of") == F.col("doc_id")).select("node", "best", "digest", "text").mapInArrow(_sets, "node long, best long, shingles array<long>"))

    known = keep(compared(sets.where("best is not null").select(F.col("best").alias("a"), F.col("node").alias("b"), "shingles"), sets))
    links = known.where("enough").select("a", "b")
    # Rows that repeat an id join the nodes of all their texts.
    several = signed.where("node is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z")
    repeated = not several.isEmpty()
    if repeated:
        links = links.unionByName(signed.where("node is not null").join(several.select(F.col("doc_id").alias("again"), "a"), F.col("doc_id") == F.col("again")).select("a", F.col("node").alias("b")))
    labels = components(links)

    # Buckets that still hold several components, each with the root of its largest one.
    placed = moved(nodes.withColumn("root", F.col("node")), labels, "root").select(F.explode("in_buckets").alias("bucket"), "node", "n", "root")
    sizes = placed.groupBy("bucket", "root").agg(F.count("*").alias("size"))
    mixed = sizes.groupBy("bucket").agg(F.max_by("root", F.struct("size", "root")).alias("pivot"), F.count("*").alias("roots")).where("roots > 1").select("bucket", "pivot")
    open_ = keep(placed.join(mixed, "bucket"))
    pairs = open_.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct().join(known.select("a", "b"), ["a", "b"], "left_anti")
    with_pivot = keep(compared(keep(pairs), sets))
    known = known.unionByName(with_pivot)
    up = components(moved(with_pivot.where("enough").select("a", "b"), labels, "a", "b"))
    labels = followed(labels, up)

    open_ = moved(open_.withColumn("main", F.col("pivot")), up, "root", "main")
    still = open_.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    open_ = keep(open_.join(still, "bucket", "left_semi"))
    if not open_.isEmpty():
        left = open_.select(F.explode(F.array("node", "pivot")).alias("__n")).distinct()
        rare = own_shingles(sets.join(left, F.col("node") == F.col("__n"), "left_semi"))
        close = open_.join(rare.withColumnRenamed("node", "__r"), F.col("node") == F.col("__r"), "left").join(known.drop("enough"), (F.col("pivot") == F.col("a")) & (F.col("node") == F.col("b")), "left")
        close = close.select("bucket", "node", "n", "root", "main", F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("common", "n").alias("with_pivot"), "size_a", F.coalesce(F.col("size_a") - F.col("common"), F.lit(0)).alias("miss"), *(F.coalesce(f"mask{k}", F.lit(0)).alias(f"mask{k}") for k in range(MASKS)))
        # Nothing of its own can a node share; what is neither that nor the pivot's, it can share with such shingles of another.
        close = keep(close.withColumn("else", F.greatest(F.col("n") - F.col("with_pivot") - F.col("own"), F.lit(0))).where(100 * (F.col("n") - F.col("own")) >= SIMILARITY * F.col("n")))
        # A pair is taken in the smallest of its buckets only; a node has one bucket for each band at most.
        buckets_of = close.groupBy("node").agg(F.collect_list("bucket").alias("buckets")).withColumnRenamed("node", "of")
        close = keep(close.join(buckets_of, F.col("node") == F.col("of")).drop("of"))
        names = ("node", "n", "root", "own", "with_pivot", "size_a", "else", "buckets", "miss", *(f"mask{k}" for k in range(MASKS)))
        # What lies outside a bucket's largest component against all that is in another component.
        one = close.where("root <> main").select("bucket", *(F.col(c).alias(c + "1") for c in names))
        two = close.select("bucket", "main", *(F.col(c).alias(c + "2") for c in names))
        once = (F.col("root2") == F.col("main")) | (F.col("node1") < F.col("node2"))
        low = lambda c: F.least(F.col(c + "1"), F.col(c + "2"))
        # The pivot itself misses nothing, and its size is not needed then.
        inside = F.least(low("with_pivot"), F.coalesce("size_a1", "size_a2") - F.col("miss1") - F.col("miss2") + _both_miss("1", "2"))
        most = F.least(inside + low("else"), F.col("n1") - F.col("own1"), F.col("n2") - F.col("own2"))
        can = 100 * most >= SIMILARITY * (F.col("n1") + F.col("n2") - most)
        here = F.col("bucket") == F.array_min(F.array_intersect("buckets1", "buckets2"))
        rest = one.join(two, "bucket").where((F.col("root1") != F.col("root2")) & once & can & here)
        rest = rest.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()
        either = known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        last = keep(compared(keep(rest.join(either, ["a", "b"], "left_anti")), sets))
        labels = followed(labels, components(moved(last.where("enough").select("a", "b"), labels, "a", "b")))
    labels = cut(labels)
    discard(*used)

    rows = moved(signed.select("doc_id", "n_shingles", F.col("node").alias("root")), labels, "root")
    lowest = rows.where("root is not null").groupBy(F.col("root").alias("__root")).agg(F.min("doc_id").alias("lowest"))
    out = rows.join(lowest, F.col("root") == F.col("__root"), "left").select("doc_id", "n_shingles", F.coalesce("lowest", "doc_id").alias("component_id"))
    if repeated:  # also by their rows without a shingle
        whole = out.groupBy(F.col("doc_id").alias("__doc")).agg(F.min("component_id").alias("__low"))
        out = out.join(whole, F.col("doc_id") == F.col("__doc"), "left").select("doc_id", "n_shingles", F.col("__low").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the document with the smallest id."""
    dropped = near_duplicates(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias("__dropped")).distinct()
    return docs.join(dropped, F.col(id_col).cast("long") == F.col("__dropped"), "left_anti")
