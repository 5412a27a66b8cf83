import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwell.llm.packing import Packer, encoder, pack_documents

SCHEMA = "doc_id long, text string, start int, tier string"


def check(pieces, tokens, window=2048):
    """``tokens``: ids by document; every id lies in one piece and sequences are gapless."""
    docs, sequences = {}, {}
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4")
        assert len(ids) == p["length"] > 0 and p["doc_tokens"] == len(tokens[p["doc_id"]])
        docs.setdefault(p["doc_id"], []).append((p["start"], ids))
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"], p["tier"], p["step_group"]))
    for d, ids in tokens.items():
        at = 0
        for start, part in sorted(docs[d], key=lambda x: x[0]):
            assert start == at
            at += len(part)
            assert (ids[start : start + len(part)] == part).all()
        assert at == len(ids)
    short, groups = 0, {}
    for parts in sequences.values():
        at = 0
        for offset, length, tier, group in sorted(parts):
            assert offset == at
            at += length
        assert at <= tier <= window and len({p[2:] for p in parts}) == 1
        short += at < tier
        groups.setdefault((tier, group), []).append(at)
    assert all(sum(g) <= 64 * window for g in groups.values())
    return len(sequences), short


def named(rows):
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
    return [dict(zip(names, r, strict=True)) for r in rows]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 5000), max_size=12), max_size=6))
def test_packer_keeps_every_id(batches):
    packer, tokens, out, k = Packer(), {}, [], 0
    for sizes in batches:
        docs = []
        for n in sizes:
            tokens[k] = np.arange(n, dtype=np.uint32) + k * 7
            docs.append((k, tokens[k]))
            k += 1
        out += packer.add(docs)
    out += packer.end()
    assert check(named(out), tokens)[1] <= 1


def test_documents_with_odd_rows(spark):
    texts = [None, "", "a", "a b " * 9000, "<|endoftext|> x", "né 🙂\n\n  x's", " " * 3000]
    rows = [(k, t, 5, "clash") for k, t in enumerate(texts)]
    encode = encoder("byte_bpe_50k.tiktoken")
    tokens = {k: np.append(encode(t or ""), 1).astype(np.uint32) for k, t in enumerate(texts)}
    got = pack_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    check([r.asDict() for r in got], tokens)
    assert pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    assert {r.doc_id for r in pack_documents(spark.createDataFrame([(None, "x", 1, "a")] * 2, SCHEMA)).collect()} == {None}


@pytest.mark.parametrize("text", ["It's  a\ttest\u00a0of 123 things!!\n\n", "¿Qué? 🙂🙂 <|endoftext|>", "'ll 've x'd", " \n \n a", "Ünï" * 50])
def test_both_readers_of_the_vocabulary_agree(text):
    assert encoder("byte_bpe_50k.json")(text).tolist() == encoder("byte_bpe_50k.tiktoken")(text).tolist()


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "<|endoftext|", "It's  1 <|ENDOFTEXT|>  <|endoftext|>'s"])
def test_ids_are_those_of_the_plain_tokenizer(spark, text):
    import public_tokenizers
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert encoder("byte_bpe_50k.tiktoken")(text).tolist() == encoder("byte_bpe_50k.json")(text).tolist() == want
    (row,) = pack_documents(spark.createDataFrame([(1, text, 0, "")], SCHEMA)).collect()
    assert np.frombuffer(row.ids, "<u4").tolist() == [*want, 1]


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    encode = encoder("byte_bpe_50k.json")
    tokens = {r.doc_id: np.append(encode(r.text or ""), 1).astype(np.uint32) for r in docs.collect()}
    _, short = check([r.asDict() for r in pack_documents(docs).collect()], tokens)
    assert short <= docs.rdd.getNumPartitions()
