import itertools
import random
import re

import numpy as np
import pyarrow as pa

from siftwell.llm.near_dedup import drop_near_duplicates, minmax_bands, near_duplicates
from siftwell.llm.shingles import shingle_sets, text_bytes

SCHEMA = "doc_id long, text string, node string, bands int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = {}
    for d, t in rows:
        sets.setdefault(d, []).append(shingles(t))
    ids, root = sorted(sets), {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if find(a) != find(b) and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: find(d) for d in ids}


def edited(rng, w, share):
    return [rng.choice("abcdefghij") + str(rng.randrange(99)) if rng.random() < share else x for x in w]


def fixture():
    rng = random.Random(3)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "One two"), (4, "one TWO"), (5, "one two three"), (6, "É one two three four five"), (7, "é one two three four five")]
    for g in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([5, 8, 40, 200, 600]))]
        for _ in range(rng.choice([2, 10, 60])):
            rows.append((len(rows) + 10, " ".join(edited(rng, base, rng.choice([0, 0.01, 0.03, 0.06, 0.1])))))
    chain = [f"c{k}" for k in range(120)]
    rows += [(2000 - k, " ".join(chain[k * 10 : k * 10 + 104])) for k in range(2)]
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], SCHEMA)
    got = near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    sizes = {d: len(shingles(t)) for d, t in rows}
    assert all(r.n_shingles == sizes[r.doc_id] for r in got)
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(brute(rows).values())


def test_odd_rows(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (1, "x y"), (2, "x y"), (3, "a b c d e f"), (4, "q " * 30000)]
    df = spark.createDataFrame([(d, t, None, None) for d, t in rows], SCHEMA)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.kept, r.n_shingles) for r in near_duplicates(df).collect())
    assert got == [(False, 1, 1, True, 1), (False, 1, 1, True, 2), (False, 2, 1, False, 1), (False, 3, 1, False, 2), (False, 4, 4, True, 1), (True, 0, None, True, 2), (True, 0, None, True, 2)]
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_ids_link_by_every_text(spark):
    one, two = [f"p{k}" for k in range(100)], [f"q{k}" for k in range(100)]
    rows = [(5, one), (5, two), (7, [*one[:99], "x"]), (8, [*two[:99], "y"])]
    for order in list(itertools.permutations(rows))[::9]:
        df = spark.createDataFrame([(d, " ".join(w), None, None) for d, w in order], SCHEMA)
        assert {r.component_id for r in near_duplicates(df).collect()} == {5}


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == brute(rows)


def test_bands_estimate_similarity():
    rng = np.random.default_rng(1)
    base = [f"w{x}" for x in rng.integers(0, 9999, 400)]
    other = base[:330] + [f"v{x}" for x in rng.integers(0, 9999, 70)]
    data, offsets = text_bytes(pa.array([" ".join(base), " ".join(other), None, "a b"]))
    sets, sizes = shingle_sets(data, offsets)
    bands = minmax_bands(sets, sizes)
    assert sizes.tolist() == [len(shingles(" ".join(base))), len(shingles(" ".join(other))), 0, 1] and bands.shape == (3, 40)
