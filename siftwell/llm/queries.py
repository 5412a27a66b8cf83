"""The queries over the training-data operators, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.chat_format import digests, format_conversations
from siftwell.llm.common import read_table
from siftwell.llm.decontamination import contaminated
from siftwell.llm.exact_dedup import exact_duplicates
from siftwell.llm.html_text import main_text
from siftwell.llm.language_id import languages_of
from siftwell.llm.lm_scoring import cross_entropy_difference
from siftwell.llm.near_dedup import near_duplicates
from siftwell.llm.packing import pack_documents
from siftwell.llm.pii import digests as span_digests
from siftwell.llm.pii import find_personal_data
from siftwell.llm.sharding import shard_documents


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit(r"\### Assistant: </turn> ok")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return digests(format_conversations(turns.unionByName(probe)))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(read_table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(read_table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = read_table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return cross_entropy_difference(read_table(spark, sf_dir, "documents"), good)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages_of(read_table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(find_personal_data(read_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_formatting,
        op2_packing,
        op3_exact_dedup,
        op4_html_extraction,
        op5_sharding,
        op6_decontamination,
        op7_lm_scoring,
        op8_minhash_near_dedup,
        op9_language_id,
        op10_pii,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_formatting": r"""
        with t as (select conv_id, turn, role, coalesce(text, '') as text from conversations
                   union all select -7, i, case when i = 0 then 'user' else 'assistant' end, '\### Assistant: </turn> ok' from range(2) r(i)),
             l as (select *, case when role is null then 'n' when role in ('system', 'user', 'assistant', 'tool') then upper(role[1]) || role[2:] else 'x' || hex(encode(role)) end as label from t),
             o as (select *, row_number() over (partition by conv_id order by turn nulls first, label, text) as k from l),
             b as (select *, lag(label) over w is not distinct from label as joins, lead(label) over w is not distinct from label as goes_on from o window w as (partition by conv_id order by k)),
             c as (select *, length(text) + len(regexp_extract_all(text, '### [A-Za-z0-9]+:|</turn>|<cont/>')) + case when joins then 9 else length(label) + 6 end + case when goes_on then 0 else 9 end as chars from b)
        select conv_id, count(*) as n_turns, sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
               coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_sha256, sum(chars)::bigint as formatted_chars
        from c group by conv_id
    """,
    "op3_exact_dedup": r"""
        with n as (select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents),
             r as (select *, first_value(doc_id) over (partition by norm order by length(t) desc, doc_id) as keep_id, count(*) over (partition by norm) as group_size from n)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from r
    """,
    "op8_minhash_near_dedup": r"""
        with recursive t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
             s as (select distinct doc_id, array_to_string(w[i : i + 4], ' ') as shingle from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from t where len(w) > 0)),
             n as (select doc_id, count(*) as n from s group by 1),
             p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by 1, 2),
             e as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 75 * (a.n + b.n - c)),
             r as (select doc_id as x, doc_id as y from documents union select r.x, e.y from r join e on r.y = e.x),
             m as (select x, min(y) as low from r group by 1)
        select documents.doc_id, coalesce(n, 0)::bigint as n_shingles, low as component_id, documents.doc_id = low as kept
        from documents left join n using (doc_id) join m on m.x = documents.doc_id
    """,
}
