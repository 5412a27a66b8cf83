"""Sets of word shingles as sorted arrays of 64-bit hashes, computed for whole Arrow batches with numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20  # of text worked on at once; a longer text is a chunk of its own

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_RANDOM = np.random.default_rng(20240607)
_BYTES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_MULTIPLIERS = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size + 1, _BASE, np.uint64), np.full(size + 1, _BASE_INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (null: empty) and the n + 1 offsets of the texts in them."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return raw, at - at[0] if len(texts) else np.zeros(1, np.int64)


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together, one text at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, number of words of each text, byte starts and ends of the words. Words are runs without white space."""
    if lower:
        data = _LOWER[data]
    size = len(data)
    word = _WORD[data]
    before, after = np.zeros(size, bool), np.zeros(size, bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    inner = offsets[1:-1]
    before[inner[inner < size]] = False
    after[inner[inner > 0] - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    up, down = _powers(max(CHUNK_BYTES * 2, 1 << int(size).bit_length()))
    total = np.zeros(size + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[:size], out=total[1:], dtype=np.uint64)
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.diff(np.searchsorted(starts, offsets)), starts, ends


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each place on; the last n - 1 places have none."""
    size = max(len(words) - n + 1, 0)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out += words[k : k + size] * _MULTIPLIERS[k]
    return mix(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The sets of all texts one after the other, each sorted and distinct, and their sizes.

    A text of fewer than n words has its whole sequence as the one shingle; one
    without words has none.
    """
    words, per_text, _, _ = word_hashes(data, offsets)
    first = np.concatenate(([0], np.cumsum(per_text)))
    grams = gram_hashes(words, n)
    counts = np.where(per_text >= n, per_text - n + 1, np.minimum(per_text, 1))
    ends = np.cumsum(counts)
    begins = ends - counts
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    text_of = np.repeat(np.arange(len(per_text)), per_text)[: len(grams)]
    inside = np.arange(len(grams)) - first[text_of] <= per_text[text_of] - n
    whole = np.ones(len(out), bool)
    short = np.flatnonzero((per_text > 0) & (per_text < n))
    whole[begins[short]] = False
    out[whole] = grams[inside]
    for t in short:
        k = int(per_text[t])
        h = (words[first[t] : first[t] + k] * _MULTIPLIERS[8 : 8 + k]).sum(dtype=np.uint64) + np.uint64(k)
        out[begins[t]] = mix(np.array([h], np.uint64))[0]
    for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
        if e - b > 1:
            out[b:e].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[begins[counts > 0]] = True
    running = np.concatenate(([0], np.cumsum(keep)))
    return out[keep], running[ends] - running[begins]
