import random

import numpy as np

from siftwell.llm.decontamination import GAP, MATCH, MISMATCH, align, choose_seeds, contaminated, drop_contaminated

DOCS, ITEMS = "doc_id long, text string, item_id string, score int", "item_id long, text string, doc_id int"


def brute_align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (MATCH if x == y else MISMATCH), h[i - 1][j] + GAP, h[i][j - 1] + GAP)
            best = max(best, h[i][j])
    return best


def test_alignment_against_the_whole_table():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 25))] for _ in range(2))
        score, lo, hi = align(np.array(a, np.uint64), np.array(b, np.uint64))
        assert score == brute_align(a, b) == brute_align(a, b[lo:hi])


def test_every_stretch_has_a_seed_however_common():
    words = [np.arange(40, dtype=np.uint64)]
    places = sorted(at for owners in choose_seeds(words, {}).values() for _, at in owners)
    assert places[0] <= 2 and all(b - a <= 3 for a, b in zip(places, places[1:], strict=False))


def fixture():
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(3000)] + ["the", "of", "and"] * 400
    passage = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(passage(rng.choice([6, 15, 40, 60])))) for k in range(40)] + [(100, "two words"), (101, None), (102, ""), (None, "x y z a b c")]
    docs, want = [], set()
    for d in range(300):
        body = passage(rng.randrange(5, 300))
        if d % 3 == 0:
            item, text = items[rng.randrange(40)]
            w = text.split()
            for _ in range(len(w) // 10 if d % 2 else 0):  # edits: change, leave out, put in
                at = rng.randrange(len(w))
                w[at : at + rng.choice([1, 1, 0])] = rng.choice([["other"], [], ["in", "between"][:1]])
            at = rng.randrange(len(body))
            body[at:at] = w
            want.add((d, item))
        docs.append((d, " ".join(body).upper() if d % 7 == 0 else "\n".join(body)))
    docs += [(400, None), (401, ""), (None, items[3][1]), (402, "say two words here"), (403, "two other words"), (404, " ".join(passage(50000)) + " " + items[5][1])]
    return docs, items, want | {(None, 3), (402, 100), (404, 5)}


def test_against_planted_and_brute_force(spark):
    docs, items, want = fixture()
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in docs], DOCS).repartition(3)
    query = spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)
    got = contaminated(df, query).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    texts = {d: (t or "").lower().split() for d, t in docs}
    words = {i: (t or "").lower().split() for i, t in items}
    for r in got:
        if len(texts[r.doc_id]) < 500:
            assert abs(r.score - brute_align(words[r.item_id], texts[r.doc_id]) / (MATCH * len(words[r.item_id]))) < 1e-9
            assert brute_align(words[r.item_id], texts[r.doc_id][r.word_start : r.word_end]) == round(r.score * MATCH * len(words[r.item_id]))
    clean = drop_contaminated(df, query)
    bad = {d for d, _ in want}
    assert clean.columns == df.columns and sorted(r.doc_id for r in clean.collect()) == sorted(d for d, _ in docs if d not in bad)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "a b c d e f", 1)] * 2, ITEMS)
    assert contaminated(docs, some).count() == 0 and contaminated(spark.createDataFrame([(1, "a b c", "", 1)], DOCS), items).count() == 0
    assert contaminated(spark.createDataFrame([(1, "x a b c d e f y", "", 1)] * 2, DOCS), some).count() == 2


def test_copies_without_a_common_4_gram_are_found(spark):
    rng = random.Random(3)
    items, docs, want = [], [], set()
    for k, n in enumerate([5, 6, 20, 40, 60] * 3):
        w = [f"i{k}x{j}" for j in range(n)]
        items.append((k, " ".join(w), 0))
        edited = [[("new" if j % step == step - 1 else x) for j, x in enumerate(w)] for step in (4, 5, 6)]  # every 4th, 5th, 6th word changed
        edited += [[y for j, x in enumerate(w) for y in ([x, "put"] if j % 2 else [x])], [x for j, x in enumerate(w) if j % 4 != 3]]  # a word put in after every second; every 4th left out
        edited += [[y for x in w for y in ([x, "in"] if rng.random() < 0.5 else [x])], [x if rng.random() < 0.85 else "other" for x in w]]
        for e in edited:
            d = len(docs)
            docs.append((d, " ".join(["before"] * 30 + e + ["after"] * 30), "", 0))
            if brute_align(w, docs[-1][1].split()) >= 0.6 * MATCH * n - 1e-9:
                want.add((d, k))
    assert len(want) > 90
    got = contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)


def test_found_pairs_equal_all_alignments(spark):
    """Every pair of document and item, aligned in full, about the threshold from both sides."""
    rng = random.Random(21)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, [rng.choice(vocabulary) for _ in range(rng.choice([5, 8, 14, 25]))]) for k in range(12)]
    docs = []
    for d in range(120):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 30))]
        if d % 3:
            copy, edits = [], rng.random() * 0.45
            for w in rng.choice(items)[1]:
                r = rng.random() / (edits or 1)
                copy += [] if r < 1 / 3 else [rng.choice(vocabulary)] if r < 2 / 3 else [w, rng.choice(vocabulary)] if r < 1 else [w]
            at = rng.randrange(len(text) + 1)
            text[at:at] = copy
        docs.append((d, text))
    want = {(d, i): score for d, text in docs for i, item in items if (score := brute_align(item, text) / (MATCH * len(item))) >= 0.6}
    frame = lambda rows, names: spark.createDataFrame([(k, " ".join(words)) for k, words in rows], names)
    found = contaminated(frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string")).collect()
    assert len(want) > 40 and {(r.doc_id, r.item_id) for r in found} == set(want)
    assert all(abs(r.score - want[r.doc_id, r.item_id]) < 1e-6 for r in found)
