import numpy as np

import corpus_pipeline as p
from siftwell.llm.packing import encoder


def test_stages_keep_columns_and_take_effect(spark, sf_dir):
    docs = start = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [docs.count()]
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == start.columns
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and kept[-1] < kept[0]
    texts = {r.doc_id: r.text for r in docs.collect()}
    encode, got = encoder("byte_bpe_50k.tiktoken"), {}
    for r in p.run(spark, sf_dir).collect():
        got.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4")))
    assert set(got) == set(texts)
    for d, parts in got.items():
        ids = np.concatenate([x for _, x in sorted(parts, key=lambda x: x[0])])
        assert ids.tolist() == [*encode(texts[d] or "").tolist(), 1]
    assert p.ORACLE_SQL is None and 4 <= len(p.STAGES) <= 5
