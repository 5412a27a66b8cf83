import math
import random
from collections import Counter

import pytest

from siftwell.llm.lm_scoring import PRIOR, UNSEEN, cross_entropy_difference

DOCS, IDS = "doc_id long, text string, score string, block int", "doc_id long, quality int"


def brute(rows, target):
    texts = [(d, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()) for d, t in rows]
    grams = [(Counter(w), Counter(zip(["<s>", *w], w, strict=False)), Counter(["<s>", *w])) for _, w in texts]
    total = [[Counter(), Counter(), Counter()] for _ in (0, 1)]
    for (d, _), own in zip(texts, grams, strict=True):
        for k in (0, 1):
            if k == 0 or d in target:
                for t, c in zip(total[k], own, strict=True):
                    t.update(c)
    vocabulary, out = len(total[0][0]), []
    # The context of a pair is counted as a word; the start once for each text with words.
    for k in (0, 1):
        total[k][2] = Counter(total[k][0]) + Counter({"<s>": sum(1 for (d, w) in texts if w and (k == 0 or d in target))})
    for (d, w), own in zip(texts, grams, strict=True):
        n, losses = len(w), [0.0, 0.0]
        for k in (0, 1):
            out_own = 1 if k == 0 or d in target else 0
            tokens = sum(total[k][0].values()) - out_own * n
            # Contexts: how often each word precedes another one in this text.
            contexts = Counter(["<s>", *w[:-1]]) if w else Counter()
            for u, x in zip(["<s>", *w], w, strict=False):
                uni = (total[k][0][x] - out_own * own[0][x] + UNSEEN) / (tokens + UNSEEN * (vocabulary + 1))
                pair = total[k][1][u, x] - out_own * own[1][u, x]
                context = total[k][2][u] - out_own * contexts[u]
                losses[k] -= math.log((pair + PRIOR * uni) / (max(context, pair) + PRIOR))
        out.append((d, n, losses[1] / n if n else None, losses[0] / n if n else None))
    return out


@pytest.mark.parametrize("blocks", [1, 5])
def test_against_brute_force(spark, blocks):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(["a", "B", "c", "dd", f"w{rng.randrange(30 + 5 * (k % 2))}"]) for _ in range(rng.randrange(60)))) for k in range(120)]
    rows += [(200, None), (201, " \n"), (None, "a b c"), (None, "a b c"), (5, "a a a")]
    target = {k for k in range(0, 120, 2)}
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], DOCS).repartition(3)
    ids = spark.createDataFrame([(k, 1) for k in target] + [(None, 1), (999, 1), (2, 1)], IDS)
    got = sorted(((str(r.doc_id), r.n_tokens, r.target_loss, r.background_loss, r.score) for r in cross_entropy_difference(docs, ids, blocks=blocks).collect()), key=lambda x: (x[0], x[1]))
    want = sorted(((str(d), n, t, b) for d, n, t, b in brute(rows, target)), key=lambda x: (x[0], x[1]))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:2] == w[:2] and (g[2] is None) == (g[4] is None) == (w[2] is None)
        assert g[4] is None or (*g[2:4], g[4]) == pytest.approx((*w[2:4], w[2] - w[3]), abs=1e-9)


def test_target_documents_score_lower(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice("pqrst" if k % 2 else "vwxyz") * 3 for _ in range(80)), None, None) for k in range(60)]
    ids = spark.createDataFrame([(k, 1) for k in range(1, 30, 2)], IDS)
    got = {r.doc_id: r.score for r in cross_entropy_difference(spark.createDataFrame(rows, DOCS), ids).collect()}
    assert max(got[k] for k in range(1, 60, 2)) < min(got[k] for k in range(0, 60, 2))


def test_empty(spark):
    assert cross_entropy_difference(spark.createDataFrame([], DOCS), spark.createDataFrame([], IDS)).count() == 0
