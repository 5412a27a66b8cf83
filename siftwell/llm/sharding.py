"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of cells.  A text's hash picks its cell and its
place within the cell, so equal texts stand together; each shard owns the cells between its virtual nodes
and those before them.  A shard takes at most ``(1 + slack)`` of the mean load.
What a full shard can't take continues clockwise to the next virtual node of a
shard with room.

Copies of a text that weigh more than a mean cell are a group of its own, of
which there are no more than cells.  It goes as a whole to the first shard
clockwise that has room for all of it; only where none has is it cut.  Its rows
are dealt into units by the hash of their ids, so no task holds a whole group.
Only loads of cells and units, numbers that the parameters bound, come to the
driver; the rows themselves are placed by running sums within cells or units.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.llm.common import text_of

CELLS = 4096
VIRTUAL_NODES = 64
SLACK = 0.002


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES, cells: int = CELLS) -> list[int]:
    """The shard that owns each cell: that of the first virtual node at the cell or clockwise of it."""
    nodes = sorted((int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big") % cells, s) for s in range(shards) for v in range(virtual_nodes))
    places = [p for p, _ in nodes]
    return [nodes[bisect_left(places, c) % len(nodes)][1] for c in range(cells)]


def capacity(load: int, shards: int, slack: float) -> int:
    return int(-(-load * (1 + slack) // shards))


def whole_groups(groups: list[tuple[int, int]], owner: list[int], room: list[int]) -> list[int | None]:
    """The shard that takes each group (cell, load) as a whole, the first clockwise with room for it; None where there is none. Heavy groups choose first, and ``room`` is lessened."""
    out: list[int | None] = [None] * len(groups)
    for k in sorted(range(len(groups)), key=lambda k: (-groups[k][1], k)):
        cell, load = groups[k]
        seen = dict.fromkeys(owner[(cell + step) % len(owner)] for step in range(len(owner))) if room[owner[cell]] < load else (owner[cell],)
        out[k] = next((s for s in seen if room[s] >= load), None)
        if out[k] is not None:
            room[out[k]] -= load
    return out


def place(loads: list[int], owner: list[int], shards: int, slack: float, room: list[int] | None = None) -> list[tuple[int, int, int, int]]:
    """Pieces (cell, from, to, shard) that cover the loads of all cells.

    First each shard takes its own cells clockwise up to its capacity; then
    what is left over goes clockwise to the owners of the next cells that have
    room; ``room`` is the capacity of each shard unless given.
    """
    room, pieces, over = room or [capacity(sum(loads), shards, slack)] * shards, [], []
    for cell, load in enumerate(loads):
        if load:
            own = min(load, room[owner[cell]])
            room[owner[cell]] -= own
            if own:
                pieces.append((cell, 0, int(own), owner[cell]))
            if own < load:
                over.append((cell, int(own), load))
    for cell, at, load in over:
        step = cell
        while at < load:
            step += 1
            shard = owner[step % len(loads)]
            part = min(load - at, room[shard])
            if part > 0:
                room[shard] -= part
                pieces.append((cell, at, int(at + part), shard))
                at = int(at + part)
            elif step > cell + 2 * len(loads):  # rounding left no room: the fullest shard is over by less than one unit
                pieces.append((cell, at, load, shard))
                at = load
    return pieces


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", virtual_nodes: int = VIRTUAL_NODES, cells: int = CELLS, slack: float = SLACK) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, shard, slot.

    ``size`` is the text's UTF-8 bytes plus 1 (null text: 1).  Loads are bytes.
    Equal texts (null and empty are equal) lie in one shard, but for texts of
    which no shard has room for all copies; those are cut between rows.  A text
    or row belongs to the piece in which its first byte falls, so a shard can
    pass its bound by less than a mean cell or one row for each cut.  Slots number a shard's
    rows in ring order from 0.  A null id is hashed as such.  Rows that repeat
    an id have one place on the ring, and each row counts.  An empty table
    gives an empty result; other columns are not read.
    """
    if shards < 1 or virtual_nodes < 1 or cells < shards:
        raise ValueError("shards and virtual_nodes must be positive, and cells no fewer than shards")
    spark = docs.sparkSession
    text, key = F.col(text_col), F.col(id_col)
    rows = docs.select(
        key.cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(text_of(text_col).cast("binary")).alias("text_crc32"),
        F.xxhash64(text_of(text_col)).alias("place"),
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    mean = max(1, total // cells)
    heavy = rows.groupBy("place").agg(F.sum("size").alias("load")).where(F.col("load") > mean).orderBy("place").collect()  # cells at most
    owner = ring(shards, virtual_nodes, cells)
    # Units on the ring: each cell, and after it those of the heavy texts in it.
    order = sorted([(c, 0, None) for c in range(cells)] + [(h.place % cells, 1, k) for k, h in enumerate(heavy)], key=lambda u: u[:2])
    unit_of_cell, first_unit, cell_of, parts = [0] * cells, [0] * len(heavy), [], [-(-h.load // mean) for h in heavy]
    for cell, _, k in order:
        if k is None:
            unit_of_cell[cell] = len(cell_of)
        else:
            first_unit[k] = len(cell_of)
        cell_of += [cell] * (1 if k is None else parts[k])
    texts = _table(spark, [[h.place, f, n] for h, f, n in zip(heavy, first_unit, parts, strict=True)], "heavy_place", "first_unit", "units")
    rows = rows.join(F.broadcast(texts), F.col("place") == F.col("heavy_place"), "left")  # cells at most
    plain = _table(spark, [[c, u] for c, u in enumerate(unit_of_cell)], "plain_cell", "plain_unit")
    rows = rows.withColumn("cell", F.pmod("place", F.lit(cells))).join(F.broadcast(plain), F.col("cell") == F.col("plain_cell"))
    unit = F.coalesce(F.col("first_unit") + F.pmod(F.xxhash64("doc_id"), F.col("units")), F.col("plain_unit"))
    rows = rows.select("doc_id", "size", "text_crc32", "place", unit.alias("unit"), F.col("units").isNotNull().alias("heavy"))
    loads = [0] * len(cell_of)
    for u, load in rows.groupBy("unit").agg(F.sum("size")).collect():  # twice the cells at most
        loads[u] = load
    room = [capacity(total, shards, slack)] * shards
    whole = whole_groups([(h.place % cells, h.load) for h in heavy], owner, room)
    pieces = []
    for k, shard in enumerate(whole):
        if shard is not None:
            for u in range(first_unit[k], first_unit[k] + parts[k]):
                pieces.append((u, 0, loads[u], shard))
                loads[u] = 0
    pieces += place(loads, [owner[c] for c in cell_of], shards, slack, room)
    by_unit: dict[int, list[tuple[int, int]]] = {}
    for u, start, _, shard in pieces:
        by_unit.setdefault(u, []).append((start, shard))
    table = [[[start, shard] for start, shard in sorted(by_unit.get(u, [(0, 0)]))] for u in range(len(cell_of))]
    plan = spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(table)), "array<array<array<long>>>")).alias("plan_unit", "cuts"))
    order_by = ("place", "doc_id", "size", "text_crc32")
    running = Window.partitionBy("unit").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("start", F.sum("size").over(running) - F.col("size"))
    # A light text goes where its first copy does.
    placed = placed.withColumn("begin", F.when(F.col("heavy"), F.col("start")).otherwise(F.min("start").over(Window.partitionBy("unit", "place"))))
    placed = placed.join(F.broadcast(plan), F.col("unit") == F.col("plan_unit")).drop("plan_unit")  # one row per unit
    chosen: Column = F.element_at(F.filter("cuts", lambda c: c[0] <= F.col("begin")), -1)
    placed = placed.withColumn("shard", chosen[1].cast("int")).drop("cuts")
    # A shard may hold several pieces of a unit; numbering by (shard, unit) needs only their count.
    within = Window.partitionBy("unit", "shard").orderBy("start", *order_by)
    placed = placed.withColumn("rank", F.row_number().over(within).cast("long") - 1)
    counts = placed.groupBy("unit", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("unit").alias("base_unit"), F.col("shard").alias("base_shard"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # At most one row per unit and shard: bounded by the parameters.
    out = placed.join(F.broadcast(base), (F.col("unit") == F.col("base_unit")) & (F.col("shard") == F.col("base_shard")))
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank")).alias("slot"))


def _table(spark: SparkSession, rows: list[list[int]], *names: str) -> DataFrame:
    """Rows of whole numbers that the driver computed, as a table."""
    table = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), "array<array<long>>")).alias("r"))
    return table.select(*(F.col("r")[k].alias(n) for k, n in enumerate(names)))
