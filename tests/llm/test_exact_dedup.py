import hashlib
import random
import re

import pytest

from siftwell.llm.exact_dedup import drop_exact_duplicates, exact_duplicates

SCHEMA = "doc_id long, text string, norm string, kept int"


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d is None, d or 0, d))
    out = []
    for norm, members in groups.items():
        keep = min(members)[3]
        out += [(d, keep, len(members), d == keep, hashlib.sha256(norm.encode()).hexdigest()) for *_, d in members]
    return sorted(out, key=repr)


@pytest.mark.parametrize("partitions", ["1", "3", "16"])
def test_against_brute_force(spark, partitions):
    rng = random.Random(int(partitions))
    texts = ["", None, " \t\n", "a b", "ab", "a\u00a0b", "é" * 3000, "é " * 3000, "x" * 40, "x" * 39 + "y"]
    rows = [(k, rng.choice(texts)) for k in range(300)] + [(1000 + k, "hot  text"[: 8 + k % 2]) for k in range(400)] + [(None, "alone"), (None, "ab"), (7, "ab"), (7, "ab")]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame([(d, t, "clash", 3) for d, t in rows], SCHEMA).repartition(5)
        assert sorted((tuple(r) for r in exact_duplicates(df).collect()), key=repr) == brute(rows)
        kept = drop_exact_duplicates(df)
        assert kept.columns == df.columns and kept.count() == len({re.sub(r"\s", "", t or "") if t != "a\u00a0b" else t for _, t in rows})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_empty(spark):
    assert exact_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert drop_exact_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
