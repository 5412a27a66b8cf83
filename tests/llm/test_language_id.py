import math
import random
import zlib

import numpy as np

from siftwell.llm.language_id import ORDER, _kneser_ney, drop_rejected, fit, languages_of, letters

SCHEMA = "doc_id long, text string, lang string, lang_pred string, score int"
SYLLABLES = {"aa": "ka lo mi tu re".split(), "bb": "sch ung ein ver tz".split(), "cc": "ét eau oux en qu".split()}


def text(rng, lang, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(words))


def fixture():
    rng = random.Random(1)
    return [(k, text(rng, lang := rng.choice(list(SYLLABLES)), rng.randrange(3, 120)), lang) for k in range(400)]


def test_letters_of_a_text_ignore_its_neighbours():
    alone = letters(["Ab, c!"])
    codes, begin, end, has = letters(["zz", None or "", "Ab, c!", "12", "\U0001d51e"])
    assert has.tolist() == [True, False, True, False, True]
    assert codes[begin[2] - ORDER + 1 : end[2]].tolist() == alone[0][alone[1][0] - ORDER + 1 : alone[2][0]].tolist()
    assert "".join(map(chr, codes[begin[2] : end[2]])) == "ab c" and end[1] == begin[1]


def test_model_is_a_distribution_and_equals_direct_kneser_ney():
    samples = {k: [text(random.Random(s), k, 60) for s in range(12)] for k in SYLLABLES}
    model = fit(samples)
    codes, begin, end, _ = letters(["kalo mitu"])
    ids = model.charset[codes].astype(np.int64)
    every = np.arange(model.unigrams.shape[0])
    for at in range(begin[0], end[0]):  # over all characters that could stand here
        total = np.zeros(len(model.languages))
        for c in every:
            changed = ids.copy()
            changed[at] = c
            total += np.exp(model.log_probabilities(changed, np.array([at]))[0].astype(np.float64))
        assert np.allclose(total, 1, atol=2e-3)
    _, orders = _kneser_ney(model.charset[letters(samples["aa"])[0]], model.unigrams.shape[0])
    assert [len(o[0]) > 0 for o in orders] == [True] * (ORDER - 1)


def test_held_out_accuracy_rejection_and_odd_rows(spark):
    rows = fixture()
    rng = random.Random(8)
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 $$ --", "cc"), (1003, "".join(rng.choice("xjwqzykżł") for _ in range(400)), "aa"), (None, text(rng, "bb", 50), None), (1005, text(rng, "cc", 40), None), (1005, text(rng, "cc", 9000), None)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows + odd], SCHEMA).repartition(3)
    got = languages_of(df).collect()
    truth = {d: lang for d, _, lang in rows}
    assert len(got) == len(rows + odd) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and all(r.lang_pred == truth[r.doc_id] for r in held)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and by[1003].rejected and by[None].lang_pred == "bb" and by[1005].lang_pred == "cc"
    kept = drop_rejected(df)
    assert kept.columns == df.columns and kept.count() == len(rows + odd) - 4
    assert not any(r.rejected for r in got if r.doc_id in truth)


def test_nothing_learned(spark):
    df = spark.createDataFrame([(1, "abc", None, None, None)], SCHEMA)
    assert [r.lang_pred for r in languages_of(df).collect()] == ["und"]
    assert languages_of(df.limit(0)).count() == 0


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in languages_of(docs).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert math.isfinite(sum(r.score for r in held))
