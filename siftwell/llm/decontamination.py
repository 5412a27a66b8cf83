"""Benchmark decontamination by n-gram seeds and Smith-Waterman alignment.

All n-grams of the test items are seeds.  The threshold bounds how many edits a
copy can have, and so how many n-grams of which length every copy keeps; each
item takes the longest n-gram of which a copy keeps one at least.  One pass looks
the seeds up in every document, keeps the stretches that hold as many of an
item's seeds as a copy must, cuts a window about each, and aligns window and item
word by word.  Copies with words changed, left out or put in keep a high score.

Test items are a stated query set: they are worked on in blocks of a bounded
number of n-grams, and each block's seeds go to every task.  Documents are
never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import SPACE
from siftwell.llm.shingles import chunks, gram_hashes, text_bytes, word_hashes

GRAM = 4  # words of a seed at most
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.6  # share of the score that the whole item has
LEAST_WORDS = 5  # of an item that edited copies are found of; shorter items match exactly
BLOCK_GRAMS = 1 << 20


def _words(text: str) -> np.ndarray:
    data, offsets = text_bytes(pa.array([text]))
    return word_hashes(data, offsets)[0]


def least_score(length: int, threshold: float) -> int:
    """The score that a copy of an item of ``length`` words has at least."""
    least = max(1, int(MATCH * length * threshold) - 1)
    while least / (MATCH * length) < threshold:
        least += 1
    return least


def seed_size(length: int, threshold: float) -> tuple[int, int, int]:
    """Of an item of ``length`` words: words of a seed, seeds that every copy keeps, and edits that a copy has at most.

    An edit costs one, so a copy with M words matched has at most 2 M - s edits for the
    least score s, and its matches lie in one run more than that.  Each run of r words
    keeps r - n + 1 n-grams; for n > 1 the fewest are kept where all words match.
    """
    if length < LEAST_WORDS:
        return length, 1, 0
    least = least_score(length, threshold)
    edits = max(0, MATCH * length - least)
    for n in range(min(GRAM, length), 1, -1):
        if length - (n - 1) * (edits + 1) > 0:
            return n, length - (n - 1) * (edits + 1), edits
    return 1, -(-least // MATCH), edits


def choose_seeds(words: list[np.ndarray], sizes: dict[int, int]) -> dict[int, list[tuple[int, int]]]:
    """Seeds as n-gram hash to (item, place): all n-grams of an item, of the size for its length or else GRAM words."""
    seeds: dict[int, list[tuple[int, int]]] = {}
    for item, w in enumerate(words):
        for at, h in enumerate(gram_hashes(w, sizes.get(len(w), min(GRAM, len(w)))).tolist()):
            seeds.setdefault(h, []).append((item, at))
    return seeds


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """The best local alignment's score, and where in the window it begins and ends."""
    size = len(window)
    ramp = -GAP * np.arange(size + 1)
    score, begin = np.zeros(size + 1, np.int64), np.arange(size + 1)
    best = (0, 0, 0)
    for word in item:
        step = np.where(window == word, MATCH, MISMATCH)
        new, start = np.zeros(size + 1, np.int64), np.arange(size + 1)
        diagonal, above = score[:-1] + step, score[1:] + GAP
        new[1:] = np.maximum(np.maximum(diagonal, above), 0)
        start[1:] = np.where(new[1:] == 0, np.arange(1, size + 1), np.where(diagonal >= above, begin[:-1], begin[1:]))
        # Gaps along the row: the best earlier cell less one gap a step.
        lifted = new + ramp
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(size + 1), 0))
        new, start = top - ramp, start[source]
        score, begin = new, start
        at = int(score.argmax())
        if score[at] > best[0]:
            best = (int(score[at]), int(begin[at]), at)
    return best


def windows(places: list[tuple[int, int]], words: int, length: int, slack: int) -> list[tuple[int, int]]:
    """Ranges of a document's words that hold an item of ``length`` words with ``slack`` words put in, by its seeds (place in document, place in item)."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((max(0, d - i - slack), min(words, d - i + length + slack)) for d, i in places):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def dense(pair: np.ndarray, place: np.ndarray, reach: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Which seed hits lie in a stretch of ``reach`` words that has hits at ``need`` places or more of its document and item.

    Hits are sorted by pair of document and item, then place.
    """
    if not len(pair):
        return np.zeros(0, bool)
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (place[1:] != place[:-1])
    first = np.flatnonzero(new)  # one hit for each place
    group = np.cumsum(np.concatenate(([0], pair[first][1:] != pair[first][:-1])))
    key = group * (int(place.max()) + int(reach.max()) + 1) + place[first]
    end = np.searchsorted(key, key + reach[first])  # groups lie further apart than any reach
    full = np.flatnonzero(end - np.arange(len(first)) >= need[first])
    marks = np.zeros(len(first) + 1, np.int64)
    np.add.at(marks, full, 1)
    np.add.at(marks, end[full], -1)
    return (np.cumsum(marks[:-1]) > 0)[np.cumsum(new) - 1]


def _lookup(keys: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``hashes`` that are among ``keys``, and their places there. A small table of bits spares most of the searches."""
    bits = np.zeros(1 << 20, bool)
    bits[(keys >> np.uint64(44)).astype(np.int64)] = True
    maybe = np.flatnonzero(bits[(hashes >> np.uint64(44)).astype(np.int64)])
    at = np.minimum(np.searchsorted(keys, hashes[maybe]), len(keys) - 1)
    hit = keys[at] == hashes[maybe]
    return maybe[hit], at[hit]


def _grams_of(words: np.ndarray, per_text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-gram hashes that lie in one text, their text, and their place in it."""
    first = np.cumsum(per_text) - per_text
    grams = gram_hashes(words, n)
    text = np.repeat(np.arange(len(per_text)), per_text)[: len(grams)]
    place = np.arange(len(grams)) - first[text]
    inside = place <= per_text[text] - n
    return grams[inside], text[inside], place[inside]


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and test item of which it holds a copy: doc_id, item_id, score, word_start, word_end.

    ``score`` is the best local alignment's part of what the whole item scores
    against itself (match 2, mismatch and gap -1); copies have ``threshold`` or
    more.  Words are split at white space, A-Z lower-cased.  Items of fewer than LEAST_WORDS
    words must occur whole.  Items or texts that are null or have no words match
    nothing; items with a null id are left out, and rows that repeat an item's id
    are one item with several texts.  Null document ids are carried; repeated
    documents are searched each.  Other columns are not read.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    query = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("item_id is not null and text is not null").distinct()
    total = query.agg(F.sum(F.size(F.split("text", SPACE + "+")))).first()[0] or 0
    blocks = -(-total // BLOCK_GRAMS) or 1
    found = None
    for k in range(blocks):
        part = query.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else query
        rows = _search(own, sorted((r.item_id, r.text) for r in part.toLocalIterator()), threshold)
        found = rows if found is None else found.unionByName(rows)
    best = F.max_by(F.struct("word_start", "word_end"), F.struct("score", -F.col("word_start")))
    # Several texts of one item, or items of several blocks: a document's rows lie in one task already but for those.
    many = blocks > 1 or not query.groupBy("item_id").count().where("count > 1").isEmpty()
    return found.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), best.alias("b")).select("doc_id", "item_id", "score", "b.*") if many else found


def _search(docs: DataFrame, items: list[tuple[int, str]], threshold: float) -> DataFrame:
    split = [(item, w) for item, text in items if len(w := _words(text))]
    ids, words = [item for item, _ in split], [w for _, w in split]
    sized = [seed_size(len(w), threshold) for w in words]
    seeds = choose_seeds(words, {len(w): n for w, (n, _, _) in zip(words, sized, strict=True)})
    empty = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, word_start long, word_end long")
    if not seeds:
        return empty
    keys = np.sort(np.array(list(seeds), np.uint64))
    owners = [seeds[h] for h in keys.tolist()]
    sizes, first_owner = np.array([len(x) for x in owners]), np.cumsum([0, *(len(x) for x in owners)])
    owner_item, owner_place = np.array([x for own in owners for x in own], np.int64).T
    length, (gram, need, edits) = np.array([len(w) for w in words]), np.array(sized).T
    least = [least_score(n, threshold if n >= LEAST_WORDS else 1) for n in length.tolist()]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            data, offsets = text_bytes(batch.column(1))
            doc_ids = batch.column(0).to_pylist()
            for i, j in chunks(offsets):
                w, per_text, _, _ = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                first = np.cumsum(per_text) - per_text
                hits: dict[tuple[int, int], list[tuple[int, int]]] = {}
                for n in set(gram.tolist()):
                    hashes, text, place = _grams_of(w, per_text, n)
                    at, key = _lookup(keys, hashes)
                    # Each hit once for each place in an item that has the seed.
                    times = sizes[key]
                    own = np.repeat(first_owner[key] - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
                    t, p, item, q = np.repeat(text[at], times), np.repeat(place[at], times), owner_item[own], owner_place[own]
                    pair = t * len(words) + item
                    order = np.lexsort((p, pair))
                    order = order[gram[item[order]] == n]
                    t, p, item, q, pair = t[order], p[order], item[order], q[order], pair[order]
                    keep = dense(pair, p, length[item] + edits[item], need[item])
                    for a, b, c, d in zip(t[keep].tolist(), item[keep].tolist(), p[keep].tolist(), q[keep].tolist(), strict=True):
                        hits.setdefault((a, b), []).append((c, d))
                for (t, item), places in hits.items():
                    own, best = w[first[t] : first[t] + per_text[t]], (0, 0, 0)
                    for lo, hi in windows(places, len(own), len(words[item]), int(edits[item])):
                        if MATCH * np.isin(words[item], own[lo:hi]).sum() < least[item]:
                            continue  # too few of the item's words are there
                        score, a, b = align(words[item], own[lo:hi])
                        best = max(best, (score, lo + a, lo + b), key=lambda x: x[0])
                    if best[0] >= least[item]:
                        out.append((doc_ids[i + t], ids[item], best[0] / (MATCH * len(words[item])), best[1], best[2]))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "score", "word_start", "word_end"])

    return docs.mapInArrow(search, empty.schema)


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold a copy of no test item, with all their columns."""
    bad = contaminated(docs, items, id_col, text_col).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, F.col(id_col).cast("long").eqNullSafe(F.col("__bad")), "left_anti")
