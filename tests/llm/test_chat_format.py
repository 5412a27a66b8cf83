import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from siftwell.llm.chat_format import digests, format_conversations, read_turns

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, segments int"
NASTY = ["", "\\", "\\\\", r"\### Assistant: </turn> ok", "\n</turn>\n", "\\</turn>", "####### User: x", "<cont/>", "\n<cont/>\n### System: ", "é🙂</turn>🙂", "### x41: \\### x41: \\\\### x41:"]


def expected(rows):
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda t: t[:2])
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def check(spark, rows):
    formatted = format_conversations(spark.createDataFrame(rows, SCHEMA), segment_turns=4)
    got = {r[0]: tuple(r[1:5]) for r in digests(formatted).collect()}
    assert got == expected(rows)
    for r in formatted.collect():
        assert "".join(p.text for p in r.segments) == r.formatted


def test_round_trip_of_control_strings(spark):
    rows = [(c, t, role, text, "clash", 1) for c, role in enumerate(["user", "assistant", "Assistant", "odd: role\n", "", "x41"]) for t, text in enumerate(NASTY)]
    rows += [(50, t, ["user", "assistant"][t % 2], text, None, None) for t, text in enumerate(NASTY)]
    check(spark, rows)


def test_nulls_ties_and_long_conversations(spark):
    rows = [(1, None, "user", "first", None, None), (1, 0, None, None, None, None), (1, 1, "assistant", None, None, None), (None, 0, "user", "a", None, None)]
    rows += [(2, t, "user" if t % 7 < 3 else "assistant", f"t{t} " * (1 + t % 5), None, None) for t in range(700)]
    rows += [(3, 0, "user", "same", None, None)] * 3
    check(spark, rows)


def test_same_roles_share_a_block(spark):
    rows = [(1, t, role, f"x{t}", None, None) for t, role in enumerate(["user"] * 6 + ["assistant"] * 5)]
    got = format_conversations(spark.createDataFrame(rows, SCHEMA), segment_turns=4).first().formatted
    assert got.count("</turn>") == 2 and got.count("<cont/>") == 9 and got.startswith("### User: x0\n<cont/>\nx1")


def test_empty(spark):
    assert format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_table(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = {r[0]: tuple(r[1:5]) for r in digests(format_conversations(turns)).collect()}
    assert got == expected([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()])
    assert format_conversations(turns).select(F.explode(read_turns(F.col("formatted")))).count() == turns.count()
