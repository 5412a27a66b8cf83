"""Language identification with interpolated Kneser-Ney character models.

One model per language, of order 4, is fitted on a bounded sample of labelled
documents.  The n-grams of all languages stand in one sorted hash array per
order, with the log probability in every language beside each; an n-gram that
no language has seen falls back to the shorter one with its context's
interpolation weight.  A document gets the language of the lowest cross-entropy
per character over its whole text.  Held-back documents of the sample calibrate
how far above a language's usual cross-entropy a text may lie before it is
rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.shingles import mix

ORDER = 4
SAMPLE_DOCS = 600  # the bound of the training sample: documents of a language, each with its whole text
BITS = 16  # of a character in a packed n-gram: all of the basic plane
CHUNK, BATCH_CHARS = 1 << 18, 1 << 20
UNDETERMINED = "und"
LEAST_SPREAD = 0.15  # nats; a text that mixes languages lies within the limit, one of random letters beyond it


@lru_cache(1)
def _plain() -> np.ndarray:
    """By code point of the basic plane: the lower-case letter, or a blank for what is no letter."""
    out = np.full(0x10000, 32, np.uint16)
    for c in range(0x10000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 and ord(low) < 0x10000 else c
    return out


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case letters of all texts with single blanks between words; where each text's letters begin and end; whether it has any.

    ``ORDER - 1`` blanks stand before each text, so nothing of its neighbours is in any context.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    plain = _plain()[np.minimum(codes, 0xFFFF)]
    high = codes > 0xFFFF
    if high.any():  # letters beyond the basic plane count as unknown letters
        plain[high] = [0xFFFF if chr(c).isalpha() else 32 for c in codes[high].tolist()]
    letter = plain != 32
    after = np.cumsum(sizes + 1)  # the blank after each text
    before = np.concatenate(([0], after[:-1])) if len(after) else after
    # A blank stays before a letter only; then each text with letters begins with one blank.
    keep = letter.copy()
    keep[:-1] |= ~letter[:-1] & letter[1:]
    place = np.concatenate(([0], np.cumsum(keep)))
    begin, end = place[before], place[after]
    has = end > begin
    kept = np.insert(plain[keep], np.repeat(begin[has], ORDER - 2), 32) if has.any() else plain[keep]
    shift = np.cumsum(has) * (ORDER - 2)
    return kept, np.where(has, begin + shift + 1, begin + shift), end + shift, has


@dataclass
class Table:
    """A sorted array of hashed n-grams with an index of their upper bits, and a value for each language."""

    keys: np.ndarray
    values: np.ndarray

    def __post_init__(self) -> None:
        bits = max(4, int(len(self.keys) * 2).bit_length())
        self.shift = np.uint64(64 - bits)
        self.index = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.padded = np.concatenate([self.keys, np.zeros(1, np.uint64)])

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The places of ``hashes``, -1 where there is none."""
        bucket = (hashes >> self.shift).astype(np.int64)
        at, end = self.index[bucket], self.index[bucket + 1]
        hit = (self.padded[at] == hashes) & (at < end)
        out = np.where(hit, at, -1)
        left = np.flatnonzero(~hit & (at + 1 < end))
        at, end, wanted = at[left] + 1, end[left], hashes[left]
        while len(left):
            hit = self.padded[at] == wanted
            out[left[hit]] = at[hit]
            on = ~hit & (at + 1 < end)
            left, at, end, wanted = left[on], at[on] + 1, end[on], wanted[on]
        return out


def _packed(ids: np.ndarray, n: int) -> np.ndarray:
    """The n characters that end at each place as one number; before the start stand zeros."""
    out = ids.astype(np.uint64)
    for k in range(1, n):
        out[k:] |= ids[:-k].astype(np.uint64) << np.uint64(BITS * k)
    return out


@dataclass
class Model:
    languages: list[str]
    charset: np.ndarray  # by code point: number of the character, 0 unknown
    unigrams: np.ndarray  # character by language
    tables: list[Table]  # orders 2 to ORDER: log probabilities
    weights: list[Table]  # contexts of orders 2 to ORDER: log interpolation weights
    usual: np.ndarray  # by language: mean cross-entropy, its spread between documents and between characters
    limit: float  # standard deviations above the usual that are rejected

    def log_probabilities(self, ids: np.ndarray, at: np.ndarray | None = None, order: int = ORDER) -> np.ndarray:
        """Of the characters at the places ``at``, by language."""
        at = np.arange(len(ids)) if at is None else at
        if order == 1:
            return self.unigrams[ids[at]]
        packed = np.zeros(len(at), np.uint64)
        for k in range(order):
            before = at - k
            packed |= np.where(before >= 0, ids[np.maximum(before, 0)], 0).astype(np.uint64) << np.uint64(BITS * k)
        table, weight = self.tables[order - 2], self.weights[order - 2]
        place = table.find(mix(packed + np.uint64(1)))
        out = table.values[place]
        missed = np.flatnonzero(place < 0)
        if len(missed):
            lower = self.log_probabilities(ids, at[missed], order - 1)
            context = weight.find(mix((packed[missed] >> np.uint64(BITS)) + np.uint64(1)))
            out[missed] = lower + np.where((context >= 0)[:, None], weight.values[context], 0)
        return out

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nats per character by text and language; characters scored; whether a text has a letter."""
        codes, begin, end, has = letters(texts)
        ids, size = self.charset[codes], end - begin
        sums = np.zeros((len(texts), len(self.languages)))
        owner = np.repeat(np.arange(len(texts)), size)
        places = np.arange(len(owner)) + np.repeat(begin - (np.cumsum(size) - size), size)
        for i in range(0, len(owner), CHUNK):
            own, part = owner[i : i + CHUNK], self.log_probabilities(ids, places[i : i + CHUNK])
            for j in range(part.shape[1]):
                sums[own[0] : own[-1] + 1, j] += np.bincount(own - own[0], part[:, j])
        size = np.maximum(size, 1)
        return -sums / size[:, None], size, has

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is rejected, of each text."""
        entropy, size, has = self.cross_entropies(texts)
        best = entropy.argmin(axis=1)
        lowest = entropy[np.arange(len(texts)), best]
        odds = np.exp(-(entropy - lowest[:, None]) * np.minimum(size, 100)[:, None])
        score = np.where(has, 1 / odds.sum(axis=1), 0.0)
        mean, spread, noise = self.usual[best].T
        far = (lowest - mean) / np.sqrt(spread**2 + noise**2 / size) > self.limit
        names = [self.languages[b] if h else UNDETERMINED for b, h in zip(best.tolist(), has.tolist(), strict=True)]
        return names, score, ~has | far


def _kneser_ney(ids: np.ndarray, chars: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    """Unigram probabilities, and for orders 2 to ORDER: n-grams, discounted shares, contexts, interpolation weights."""
    grams = [np.unique(_packed(ids, n), return_counts=True) for n in range(1, ORDER + 1)]
    counts: list[np.ndarray] = []
    for n in range(ORDER):
        keys, raw = grams[n]
        if n == ORDER - 1:
            counts.append(raw)
        else:  # the number of different characters before it
            longer = grams[n + 1][0] & np.uint64((1 << (BITS * (n + 1))) - 1)
            seen, kinds = np.unique(longer, return_counts=True)
            at = np.minimum(np.searchsorted(seen, keys), len(seen) - 1)
            counts.append(np.where(seen[at] == keys, kinds[at], 1))
    base = np.full(chars, 0.5)
    base[grams[0][0].astype(np.int64)] += counts[0]
    orders = []
    for n in range(1, ORDER):
        keys, c = grams[n][0], counts[n].astype(np.float64)
        ones, twos = (c == 1).sum(), (c == 2).sum()
        discount = ones / (ones + 2 * twos) if ones else 0.5
        context, start = np.unique(keys >> np.uint64(BITS), return_inverse=True)
        total = np.bincount(start, c)
        weight = np.bincount(start, np.minimum(c, discount)) / total
        orders.append((keys, np.maximum(c - discount, 0) / total[start], context, weight))
    return base / base.sum(), orders


def fit(samples: dict[str, list[str]]) -> Model:
    """A model from texts by language; every fourth text is held back for calibration.

    Texts that are far from their language by a model of the other half of the
    sample are wrongly labelled or junk, and nothing is learned from them.
    """
    languages = sorted(samples)
    if not languages:
        return Model([], np.zeros(0x10000, np.uint16), np.zeros((1, 0), np.float32), [], [], np.zeros((0, 3)), np.inf)
    if min(map(len, samples.values())) >= 8:
        halves = [{k: v[i::2] for k, v in samples.items()} for i in (0, 1)]
        models = [_fitted(languages, half) for half in halves]
        near = [{k: _near(models[1 - i], j, half[k]) for j, k in enumerate(languages)} for i, half in enumerate(halves)]
        samples = {k: near[0][k] + near[1][k] or samples[k] for k in languages}
    fitted = {k: [t for i, t in enumerate(v) if i % 4 != 3 or len(v) < 8] for k, v in samples.items()}
    held = {k: [t for i, t in enumerate(v) if i % 4 == 3 or len(v) < 8] for k, v in samples.items()}
    model = _fitted(languages, fitted)
    far = [6.0]
    for j, k in enumerate(languages):
        own, size, _ = _own(model, j, held[k])
        if not len(own):
            own, size = np.array([np.log(model.unigrams.shape[0])]), np.array([1])
        mean, spread, near = _spread(own)
        model.usual[j] = mean, spread, 2.0
        far.append(1.25 * float(((own[near] - mean) / np.sqrt(spread**2 + 4.0 / size[near])).max()))
    model.limit = max(far)
    return model


def _own(model: Model, language: int, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cross-entropies of texts in their language, characters scored, and which texts they are: those with letters."""
    entropy, size, has = model.cross_entropies(texts)
    return entropy[has, language], size[has], np.flatnonzero(has)


def _spread(own: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Mean and spread of the values near the median, and which those are."""
    middle = np.median(own)
    near = np.abs(own - middle) <= 6 * max(np.median(np.abs(own - middle)) * 1.5, 0.02)
    return float(own[near].mean()), max(float(own[near].std()), LEAST_SPREAD), near


def _near(model: Model, language: int, texts: list[str]) -> list[str]:
    """The texts that are as a language's texts usually are."""
    own, size, at = _own(model, language, texts)
    if not len(own):
        return []
    mean, spread, _ = _spread(own)
    return [texts[i] for i in at[(own - mean) / np.sqrt(spread**2 + 4.0 / size) <= 6].tolist()]


def _fitted(languages: list[str], fitted: dict[str, list[str]]) -> Model:
    coded = {k: letters(fitted[k]) for k in languages}
    seen = np.bincount(np.concatenate([c for c, *_ in coded.values()]), minlength=0x10000)
    known = np.flatnonzero(seen)
    charset = np.zeros(0x10000, np.uint16)
    charset[known] = np.arange(1, len(known) + 1)
    chars = len(known) + 1
    parts = {k: _kneser_ney(charset[c], chars) for k, (c, *_) in coded.items()}
    unigrams = np.log(np.stack([parts[k][0] for k in languages], axis=1)).astype(np.float32)
    tables: list[Table] = []
    weights: list[Table] = []
    lower = np.exp(unigrams.astype(np.float64))
    lower_keys = np.arange(chars, dtype=np.uint64)
    for n in range(2, ORDER + 1):
        keys = np.unique(np.concatenate([parts[k][1][n - 2][0] for k in languages]))
        contexts = np.unique(np.concatenate([parts[k][1][n - 2][2] for k in languages]))
        mask = np.uint64((1 << (BITS * (n - 1))) - 1)
        shorter = lower[np.searchsorted(lower_keys, keys & mask)]
        share, lam = np.zeros((len(keys), len(languages))), np.ones((len(contexts), len(languages)))
        for j, k in enumerate(languages):
            own, p, ctx, w = parts[k][1][n - 2]
            share[np.searchsorted(keys, own), j] = p
            lam[np.searchsorted(contexts, ctx), j] = w
        values = share + lam[np.searchsorted(contexts, keys >> np.uint64(BITS))] * shorter
        lower, lower_keys = values, keys
        tables.append(_table(keys, np.log(values)))
        weights.append(_table(contexts, np.log(lam)))
    return Model(languages, charset, unigrams, tables, weights, np.zeros((len(languages), 3)), np.inf)


def _table(keys: np.ndarray, values: np.ndarray) -> Table:
    hashes = mix(keys + np.uint64(1))
    order = np.argsort(hashes)
    return Table(hashes[order], values[order].astype(np.float32))


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that nothing is learned from."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2


def fit_on(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from a sample of the labelled documents that aren't held out, chosen by a hash of their ids.

    Rows without an id, a text or a language are not learned from; of rows that
    repeat an id and a language one text is taken.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))
    # A share of each language by hash that holds the sample, so that no task ranks a whole language.
    own = own.withColumn("place", F.pmod(F.xxhash64("id"), F.lit(1 << 40)))
    counts = own.groupBy("lang").agg(F.count("*").alias("rows"))  # a row for each language of the model
    near = own.join(F.broadcast(counts), "lang").where(F.col("place") * F.col("rows") < F.lit(2.0 * sample_docs * (1 << 40)))
    near = near.groupBy("lang", "id", "place").agg(F.min("text").alias("text"))
    rank = Window.partitionBy("lang").orderBy("place", "id")
    rows = near.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= sample_docs).collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.rank)):
        samples.setdefault(r.lang, []).append(r.text)
    return fit(samples)


def _parts(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Begins and texts (null: empty) of parts of at most 256 texts and BATCH_CHARS characters, one text at least."""
    part, chars, first = [], 0, 0
    for k, t in enumerate(texts.to_pylist()):
        t = t or ""
        if part and (len(part) == 256 or chars + len(t) > BATCH_CHARS):
            yield first, part
            part, chars, first = [], 0, k
        part.append(t)
        chars += len(t)
    if part:
        yield first, part


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` row by row: doc_id, lang_pred, score, rejected.

    Whole texts are read; null texts and those without a letter are ``und``
    with score 0, and rejected.  The score is the share of the best language
    over at most 100 characters' evidence.  Null ids are carried and repeated
    rows are judged each; other columns are not read.  With no language learned
    every text is ``und``.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, texts in _parts(batch.column(1)):
                if model.languages:
                    names, score, rejected = model.predict(texts)
                else:
                    names, score, rejected = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(texts)), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(judge, "doc_id long, lang_pred string, score double, rejected boolean")


def languages_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fits on the labelled part of ``docs`` and identifies all of it: doc_id, held_out, lang_pred, score, rejected. A null id is not held out."""
    found = identify(docs, fit_on(docs, id_col, text_col, lang_col), id_col, text_col)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def drop_rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is recognised, with all their columns; rows are judged where they lie, without a join.

    Null texts and those without a letter go; a null id is judged by its text.
    Where no labelled row is there to learn from, nothing can be recognised, and all rows stay.
    """
    model = fit_on(docs, id_col, text_col, lang_col)
    place = docs.columns.index(text_col)
    if not model.languages:
        return docs

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, texts in _parts(batch.column(place)):
                yield batch.slice(i, len(texts)).filter(pa.array(~model.predict(texts)[2]))

    return docs.mapInArrow(judge, docs.schema)
