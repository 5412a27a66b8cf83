"""Cross-entropy difference between a target and a background language model.

Both models are word bigram models with Dirichlet smoothing over one
vocabulary, that of the whole corpus; the background counts every document,
the target those that labels name.  A document's own counts are taken out of
both before it is scored.

Documents are dealt into blocks.  A block sends the counts of its distinct
n-grams, split by hash, to merging tasks; each of these sums the blocks' counts
and answers every block with the corpus's counts of the n-grams that it asked
for.  Both exchanges hold a block's n-grams as arrays, sorted and packed by their
differences, so nothing is sent for each token, nothing but the corpus's size comes to the driver, and no table of
the corpus's n-grams is held in one place.  The numbers of blocks and of merging
tasks follow the bytes of the corpus, so a task holds as much at any size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.shingles import chunks, mix, text_bytes, word_hashes

PRIOR = 20.0  # words' worth of the unigram model in each context
UNSEEN = 0.5  # added to each word's count
LEAST_BLOCKS = 8  # so that small corpora are worked on by several tasks
BLOCK_BYTES = 8 << 20  # of text that a task counts and scores at once, but for longer documents
_SINGLE, _START, _PAIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0xA24BAED4963EE407)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word of the texts: its hash as a unigram, that of its context, that of both as a bigram; and words by text. A text starts with a word of its own kind."""
    words, per_text, _, _ = word_hashes(data, offsets)
    single = mix(words ^ _SINGLE)
    before = np.empty_like(single)
    before[1:] = single[:-1]
    first = (np.cumsum(per_text) - per_text)[per_text > 0]
    before[first] = _START
    return single, before, mix(before * _PAIR + single), per_text


def _texts(table: pa.Table) -> tuple[list, pa.Array, np.ndarray]:
    """Ids and texts of the documents of a block, and which of them are of the target."""
    is_doc = table["is_doc"].to_pylist()
    ids = table["doc_id"].to_pylist()
    named = {i for i, d in zip(ids, is_doc, strict=True) if not d}
    docs = table.filter(table["is_doc"])
    texts = docs["text"].combine_chunks()
    texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
    own = docs["doc_id"].to_pylist()
    return own, texts, np.array([i is not None and i in named for i in own], bool)


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts, which have two columns."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    both = np.concatenate(counts)
    return distinct, np.stack([np.bincount(at, both[:, k], len(distinct)) for k in (0, 1)], axis=1).astype(np.int64)


def _key(hashes: np.ndarray | np.uint64, word: bool) -> np.ndarray:
    """The hash with its last bit telling words from pairs."""
    return hashes & ~np.uint64(1) | np.uint64(word)


def _packed(keys: np.ndarray) -> bytes:
    """Sorted distinct keys as the first one and the steps between them, in 4, 6 or 8 bytes each."""
    if not len(keys):
        return b"\0"
    steps = np.diff(keys)
    most = int(steps.max(initial=0))
    if most < 1 << 48:
        high = b"" if most < 1 << 32 else (steps >> np.uint64(32)).astype(np.uint16).tobytes()
        return bytes([6 if high else 4]) + keys[:1].tobytes() + (steps & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + high
    return b"\x08" + keys[:1].tobytes() + steps.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    if not width:
        return np.zeros(0, np.uint64)
    n = (len(data) - 9) // width
    steps = np.frombuffer(data, np.uint64 if width == 8 else np.uint32, n, 9).astype(np.uint64)
    if width == 6:
        steps |= np.frombuffer(data, np.uint16, n, 9 + 4 * n).astype(np.uint64) << np.uint64(32)
    return np.cumsum(np.concatenate([np.frombuffer(data, np.uint64, 1, 1), steps]), dtype=np.uint64)


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in a byte each; those of 255 and more stand behind them in full."""
    return np.uint32(len(counts)).tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<u8").tobytes()


def _wide(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    out = np.frombuffer(data, np.uint8, n, 4).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u8", offset=4 + n).astype(np.int64)
    return out


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part's keys begin in sorted keys, and their end: parts are ranges of keys."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))


def _block_counts(texts: pa.Array, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(texts)
    keys, counts = [], []
    for i, j in chunks(offsets):
        single, before, pair, per_text = grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        mine = np.repeat(target[i:j], per_text)
        starts = before == _START
        hashes = np.concatenate([_key(single, True), _key(before[starts], True), _key(pair, False)])
        of_target = np.concatenate([mine, mine[starts], mine])
        k, at, n = np.unique(hashes, return_inverse=True, return_counts=True)
        keys.append(k)
        counts.append(np.stack([n, np.bincount(at, of_target, len(k)).astype(np.int64)], axis=1))
    return _added(keys, counts)


def _count(parts: int):
    def count(table: pa.Table) -> pa.Table:
        _, texts, target = _texts(table)
        keys, counts = _block_counts(texts, target)
        cuts = _cuts(keys, parts)
        slices = [slice(cuts[p], cuts[p + 1]) for p in range(parts)]
        return pa.table(
            {
                "part": pa.array(np.arange(parts, dtype=np.int32)),
                "block": pa.array(np.full(parts, table["block"][0].as_py(), np.int32)),
                "keys": pa.array([_packed(keys[s]) for s in slices], pa.binary()),
                "background": pa.array([_narrow(counts[s, 0]) for s in slices], pa.binary()),
                "target": pa.array([_narrow(counts[s, 1]) for s in slices], pa.binary()),
            }
        )

    return count


def _merge(table: pa.Table) -> pa.Table:
    """Sums of the counts of one part's n-grams, for each block those that it sent, in its order; and the part's words and tokens."""
    keys = [_unpacked(k) for k in table["keys"].to_pylist()]
    sent = [_wide(k) for name in ("background", "target") for k in table[name].to_pylist()]
    n = len(keys)
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = [np.bincount(at, np.concatenate(sent[k * n : (k + 1) * n]), len(distinct)).astype(np.int64) for k in (0, 1)]
    word = (distinct & np.uint64(1) == 1) & (distinct != _key(_START, True))
    ends = np.cumsum([len(k) for k in keys])
    answers = [[_narrow(t[at[e - len(k) : e]]) for k, e in zip(keys, ends.tolist(), strict=True)] for t in total]
    same = lambda x: pa.array(np.full(n, x, np.int64))
    return pa.table({"block": table["block"], "part": table["part"], "background": pa.array(answers[0], pa.binary()), "target": pa.array(answers[1], pa.binary()), "words": same(word.sum()), "background_tokens": same(total[0][word].sum()), "target_tokens": same(total[1][word].sum())})


def _loss(pair: np.ndarray, context: np.ndarray, word: np.ndarray, tokens: np.ndarray, words: int, prior: float) -> np.ndarray:
    unigram = (word + UNSEEN) / (tokens + UNSEEN * (words + 1))
    return -np.log((pair + prior * unigram) / (np.maximum(context, pair) + prior))


def _score(prior: float):
    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        ids, texts, target = _texts(docs)
        keys, _ = _block_counts(texts, target)
        rows = sorted(zip(*(answers[c].to_pylist() for c in ("part", "background", "target", "words", "background_tokens", "target_tokens")), strict=True), key=lambda r: r[0])
        total = np.stack([np.concatenate([_wide(r[1 + k]) for r in rows]) for k in (0, 1)], axis=1)
        words, all_tokens = sum(r[3] for r in rows), np.array([sum(r[4 + k] for r in rows) for k in (0, 1)])
        data, offsets = text_bytes(texts)
        n_tokens, losses = np.zeros(len(ids), np.int64), np.zeros((len(ids), 2))
        for i, j in chunks(offsets):
            single, before, pair, per_text = grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            doc = np.repeat(np.arange(j - i), per_text)
            at = [np.searchsorted(keys, x) for x in (_key(single, True), _key(before, True), _key(pair, False))]
            # How often the document itself has each of its n-grams.
            own = []
            for x in at:
                _, place, n = np.unique(doc * len(keys) + x, return_inverse=True, return_counts=True)
                own.append(n[place])
            n_tokens[i:j] = per_text
            for k in (0, 1):
                out = 1 if k == 0 else target[i:j][doc].astype(np.int64)
                word, pairs = total[at[0], k] - out * own[0], total[at[2], k] - out * own[2]
                context = total[at[1], k] - out * own[1]
                tokens = all_tokens[k] - out * per_text[doc]
                losses[i:j, k] = np.bincount(doc, _loss(pairs, context, word, tokens, words, prior), j - i)
        per = losses / np.maximum(n_tokens, 1)[:, None]
        empty = n_tokens == 0
        column = lambda x: pa.array(x, pa.float64(), mask=empty)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(n_tokens), "target_loss": column(per[:, 1]), "background_loss": column(per[:, 0]), "score": column(per[:, 1] - per[:, 0])})

    return score


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", prior: float = PRIOR, blocks: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, target_loss, background_loss, score.

    ``target_ids`` has the ids of the target's documents in the column
    ``id_col``; ids that aren't in ``docs``, nulls and repetitions do nothing.
    Losses are nats per token; a low score is like the target.  Words are split
    at white space, A-Z lower-cased.  A null or empty text has no tokens and
    null losses; a null id is in the background only.  Rows that repeat an id
    are documents of their own.  Other columns are not read; an empty table gives an empty result.
    ``blocks`` is one for each BLOCK_BYTES of text unless given; a block's
    documents and their distinct n-grams fit a task.
    """
    if blocks is None:
        size = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
        blocks = max(LEAST_BLOCKS, -(-size // BLOCK_BYTES))
    parts = -(-blocks // 2)
    key, text = F.col(id_col).cast("long"), F.col(text_col)
    own = docs.select(key.alias("doc_id"), text.alias("text"), F.lit(True).alias("is_doc"))
    named = target_ids.select(key.alias("doc_id")).where("doc_id is not null").distinct().select("doc_id", F.lit(None).cast("string").alias("text"), F.lit(False).alias("is_doc"))
    place = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text")))
    rows = own.unionByName(named).withColumn("block", F.pmod(place, F.lit(blocks)).cast("int")).repartitionById(blocks, "block")
    asked = rows.groupBy("block").applyInArrow(_count(parts), "part int, block int, keys binary, background binary, target binary")
    answers = asked.repartitionById(parts, "part").groupBy("part").applyInArrow(_merge, "block int, part int, background binary, target binary, words long, background_tokens long, target_tokens long").repartitionById(blocks, "block")
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(prior), "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
