r"""Chat formatting with Spark expressions only.

A conversation becomes blocks, one for each stretch of turns with one role::

    ### User: first text
    <cont/>
    second text of the same role
    </turn>
    ### Assistant: answer
    </turn>

Control strings are ``### Name:``, ``</turn>`` and ``<cont/>``.  Inside texts
each gets a backslash in front, whatever stands before it, and reading back
takes one backslash away; so every text comes back unchanged.  A real
``</turn>`` or ``<cont/>`` follows a line end directly, which an escaped one
never does.

Turns are escaped row by row, collected in segments of a bounded range of turn
numbers, sorted, and joined with array functions; a segment learns the roles
beside it from a window over segments.  So a very long conversation is worked
on by many tasks, and only its finished segments meet in its one output row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import text_of

CONTROL = r"(### [A-Za-z0-9]+:|</turn>|<cont/>)"
NAMES = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
END, JOIN = "\n</turn>\n", "\n<cont/>\n"
SEGMENT_TURNS = 128


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\" + CONTROL, "$1")


def role_label(role: Column) -> Column:
    """The name in a block's header: known roles capitalised, others as x and hex digits, null as n."""
    label = F.when(role.isNull(), F.lit("n"))
    for name, shown in NAMES.items():
        label = label.when(role == name, F.lit(shown))
    return label.otherwise(F.concat(F.lit("x"), F.hex(role.cast("binary"))))


def label_role(label: Column) -> Column:
    role = F.when(label == "n", F.lit(None).cast("string"))
    for name, shown in NAMES.items():
        role = role.when(label == shown, F.lit(name))
    return role.otherwise(F.unhex(F.substring(label, 2, 1 << 30)).cast("string"))


def format_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """One row per conversation: conv_id, formatted, segments.

    ``segments`` holds the formatted text in parts, array<struct<text, loss>>;
    ``loss`` marks the assistant texts, which alone are trained on.  Joined,
    the parts are ``formatted``.  Turns are ordered by number, null first, then
    role and text; rows that repeat a turn are turns of their own.  A null text
    is empty, a null role is a role of its own, a null id is a conversation of
    its own.  Other columns are not read; an empty table gives an empty result.
    """
    number = F.col(turn_col).cast("long")
    rows = turns.select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.floor(number / segment_turns).alias("segment"),
        F.struct(number.alias("turn"), role_label(F.col(role_col)).alias("label"), escape(text_of(text_col)).alias("body")).alias("t"),
    )
    parts = rows.groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    order = Window.partitionBy("conv_id").orderBy(F.col("segment").asc_nulls_first())
    parts = parts.withColumn("prior", F.lag(F.element_at("ts", -1)["label"]).over(order)).withColumn("next", F.lead(F.element_at("ts", 1)["label"]).over(order))
    ts = F.col("ts")

    def piece(t: Column, i: Column) -> Column:
        # A turn that differs from the one before opens a block, one that equals it goes on in that block.
        before = F.when(i == 0, F.col("prior")).otherwise(F.get(ts, i - 1)["label"])
        after = F.when(i == F.size(ts) - 1, F.col("next")).otherwise(F.get(ts, i + 1)["label"])
        lead = F.when(before.eqNullSafe(t["label"]), F.lit(JOIN)).otherwise(F.concat(F.lit("### "), t["label"], F.lit(": ")))
        close = F.when(after.eqNullSafe(t["label"]), F.lit("")).otherwise(F.lit(END))
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(part(lead, F.lit(False)), part(t["body"], t["label"] == NAMES["assistant"]), part(close, F.lit(False)))

    parts = parts.select("conv_id", "segment", F.filter(F.flatten(F.transform(ts, piece)), lambda p: p["loss"] | (p["text"] != "")).alias("pieces"))
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("segment", "pieces"))).alias("s"))
    whole = whole.select("conv_id", F.flatten(F.transform("s", lambda s: s["pieces"])).alias("segments"))
    return whole.select("conv_id", F.array_join(F.transform("segments", lambda p: p["text"]), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns in a formatted conversation."""
    header = r"^### ([A-Za-z0-9]+): "
    blocks = F.filter(F.split(formatted, r"\n</turn>\n"), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = label_role(F.regexp_extract(block, header, 1))
        texts = F.split(F.regexp_replace(block, header, ""), r"\n<cont/>\n")
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda p: p["loss"]), lambda p: unescape(p["text"])), "")


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the formatted text."""
    read = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
