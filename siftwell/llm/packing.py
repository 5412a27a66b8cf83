"""Hierarchical multi-length packing of token ids.

A document's full windows of the longest context go out as they are.  What is
left of it is routed to the tier of the smallest context size that holds it.
Tiers are packed from the longest to the shortest: each window starts with one
remainder of its own tier, its gap is filled with the largest fitting
remainders of shorter tiers, and the last gap is closed by cutting a remainder.
So every window is full, but for one at the end of a partition.  Sequences
of a tier are dealt into step groups of an equal number of tokens.

Each task packs the documents of its own partition as they stream by, with the
remainders of one batch in memory; nothing is shuffled.
"""

from __future__ import annotations

import base64
import json
import os
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 64 * 2048
END_ID = 1
VOCABULARY = "byte_bpe_50k.tiktoken"
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


@lru_cache(2)
def encoder(vocabulary: str):
    """A function from a text to its ids; ``vocabulary`` is a path, or the name of a public tokenizer's file.

    A ``.json`` file is read by tokenizers and a ``.tiktoken`` file by tiktoken,
    which gives the same ids of the same vocabulary in a fraction of the time.
    Added tokens are in the ``.json`` file alone, so a ``.tiktoken`` file has
    them from the one of its name beside it, if any. Their strings in a text get
    their ids.
    """
    import public_tokenizers

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    added, beside = {}, path.removesuffix(".tiktoken") + ".json"
    if os.path.exists(beside):
        with open(beside, encoding="utf-8") as file:
            added = {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}
    encoding = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return lambda text: encoding.encode_to_numpy(text, allowed_special="all")


class Packer:
    """Packs documents that are added in turn; ``add`` and ``end`` return finished pieces."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, first: int = 0):
        self.tiers, self.step_tokens = sorted(tiers), step_tokens
        self.sequence, self.group, self.filled, self.groups = first, first, {}, {}
        #: By tier, remainders (length, number, document, start) sorted by length.
        self.waiting: dict[int, list[tuple[int, int, tuple, int]]] = {t: [] for t in self.tiers}
        self.number = 0
        self.out: list[tuple] = []

    def _route(self, doc: tuple, start: int, length: int) -> None:
        tier = self.tiers[bisect_left(self.tiers, length)]
        insort(self.waiting[tier], (length, self.number, doc, start))
        self.number += 1

    def _write(self, pieces: list[tuple[tuple, int, int]], tier: int) -> None:
        tokens = sum(length for _, _, length in pieces)
        if tier not in self.groups or self.filled[tier] + tokens > self.step_tokens:
            self.groups[tier], self.filled[tier], self.group = self.group, 0, self.group + 1
        self.filled[tier] += tokens
        offset = 0
        for (doc_id, ids), start, length in pieces:
            self.out.append((doc_id, start, length, ids[start : start + length].tobytes(), len(ids), self.sequence, offset, tier, self.groups[tier]))
            offset += length
        self.sequence += 1

    def _fitting(self, tier: int, gap: int) -> tuple | None:
        """The largest waiting remainder of a shorter tier that fits in ``gap``."""
        for t in reversed(self.tiers[: self.tiers.index(tier)]):
            at = bisect_right(self.waiting[t], gap, key=lambda x: x[0])
            if at:
                return self.waiting[t].pop(at - 1)
        return None

    def _to_cut(self, tier: int) -> tuple | None:
        """A remainder to cut: the longest of the nearest shorter tier, else the shortest of this one."""
        for t in reversed(self.tiers[: self.tiers.index(tier)]):
            if self.waiting[t]:
                return self.waiting[t].pop()
        return self.waiting[tier].pop(0) if self.waiting[tier] else None

    def _pack(self) -> None:
        for tier in reversed(self.tiers):
            queue = self.waiting[tier]
            while queue:
                length, _, doc, start = queue.pop()
                pieces, gap = [(doc, start, length)], tier - length
                while gap:
                    if found := self._fitting(tier, gap):
                        length, _, doc, start = found
                    elif found := self._to_cut(tier):
                        whole, _, doc, start = found
                        length = min(whole, gap)
                        if whole > length:
                            self._route(doc, start + length, whole - length)
                    else:  # nothing is left in this tier or below: these wait for the next batch
                        for doc, start, length in pieces:
                            self._route(doc, start, length)
                        return
                    pieces.append((doc, start, length))
                    gap -= length
                self._write(pieces, tier)

    def add(self, docs: list[tuple]) -> list[tuple]:
        """``docs``: (doc_id, ids)."""
        window = self.tiers[-1]
        for doc in docs:
            start, size = 0, len(doc[1])
            while size - start >= window:
                self._write([(doc, start, window)], window)
                start += window
            if size > start:
                self._route(doc, start, size - start)
        self._pack()
        out, self.out = self.out, []
        return out

    def end(self) -> list[tuple]:
        """What still waits fills windows of falling size; only the very last is short."""
        rest = [[doc, start, length] for tier in reversed(self.tiers) for length, _, doc, start in self.waiting[tier]]
        left = sum(length for _, _, length in rest)
        while left:
            tier = next((t for t in reversed(self.tiers) if t <= left), self.tiers[0])
            pieces, gap = [], tier
            while gap and rest:
                doc, start, length = rest[0]
                part = min(gap, length)
                pieces.append((doc, start, part))
                gap -= part
                if part == length:
                    rest.pop(0)
                else:
                    rest[0] = [doc, start + part, length - part]
            left -= tier - gap
            self._write(pieces, tier)
        out, self.out = self.out, []
        return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, step_tokens: int = STEP_TOKENS, buffer: int = 512) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids, doc_tokens, sequence_id, offset, tier, step_group.

    ``ids`` are little-endian unsigned 32-bit integers; each document ends with
    ``end_id``, so a null or empty text has one id.  Pieces of a sequence lie at
    gapless offsets; a sequence is as long as its tier, but for the last of a
    partition.  Sequence and group numbers are unique, with the partition in
    their upper bits.  A null id is carried as it is, and rows that repeat an
    id are documents of their own.  Other columns are not read; an empty table
    gives an empty result.
    """
    end = np.array([end_id], np.uint32)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(vocabulary), Packer(tiers, step_tokens, TaskContext.get().partitionId() << 32)
        for batch in batches:
            for i in range(0, batch.num_rows, buffer):
                part = batch.slice(i, buffer)
                rows = packer.add([(d, np.concatenate([encode(t), end]).astype("<u4", copy=False) if t else end) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)])
                if rows:
                    yield _batch(rows)
        if rows := packer.end():
            yield _batch(rows)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pack, SCHEMA)
