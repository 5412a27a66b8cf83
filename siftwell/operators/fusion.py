"""Fusion of lexical and vector results, reranking and explanation.

Both sides are result lists that a limit has cut, so joins and windows here
are over a few hundred rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import tokenize
from siftwell.operators.relational import min_max

RRF_K = 60
EQUAL = 1e-9


def settled(rows: DataFrame) -> DataFrame:
    """A result list that a limit has cut, computed once: its few rows come to the driver and are a table of their own."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


def _side(df: DataFrame, score: str, name: str, id_col: str) -> DataFrame:
    """id, score and rank of one side; of repeated ids the best stays."""
    best = df.groupBy(F.col(id_col).alias("section_id")).agg(F.max(score).alias(name))
    return best.withColumn(f"{name}_rank", F.row_number().over(Window.orderBy(F.desc(name), "section_id")))


def reciprocal_rank(text: DataFrame, vector: DataFrame, alpha: float | None = None, k: int = RRF_K, id_col: str = "section_id", text_score: str = "rank_score", vector_score: str = "similarity") -> DataFrame:
    """section_id, text_score, vector_score and combined_score, best first.

    A list gives 1 / (k + rank), and nothing for what it lacks. With ``alpha`` the
    vector side counts alpha and the text side the rest; without, both count once.
    """
    t, v = _side(text, text_score, "text_score", id_col), _side(vector, vector_score, "vector_score", id_col)
    both = t.join(v, "section_id", "full_outer")
    part = lambda name: F.coalesce(1.0 / (k + F.col(f"{name}_rank")), F.lit(0.0))
    total = part("vector_score") + part("text_score") if alpha is None else alpha * part("vector_score") + (1 - alpha) * part("text_score")
    return _finished(both.withColumn("combined_score", total))


def weighted_sum(text: DataFrame, vector: DataFrame, alpha: float = 0.95, id_col: str = "section_id", text_score: str = "rank_score", vector_score: str = "similarity", text_boost: float = 1.0, vector_boost: float = 1.0) -> DataFrame:
    """As reciprocal_rank, but the scores of each list are scaled to 0..1 over that list and blended by ``alpha``."""
    t = min_max(_side(text, text_score, "text_score", id_col), "text_score", "text_scaled")
    v = min_max(_side(vector, vector_score, "vector_score", id_col), "vector_score", "vector_scaled")
    both = t.join(v, "section_id", "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return _finished(both.withColumn("combined_score", alpha * zero("vector_scaled") * vector_boost + (1 - alpha) * zero("text_scaled") * text_boost))


def _finished(both: DataFrame) -> DataFrame:
    zero = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("text_score", "vector_score")}
    return both.withColumns(zero).select("section_id", "text_score", "vector_score", "combined_score").orderBy(F.desc("combined_score"), "section_id")


def combine(method: str, text: DataFrame, vector: DataFrame, alpha: float, **options) -> DataFrame:
    if method == "rrf":
        return reciprocal_rank(text, vector, alpha, **options)
    if method == "weighted_sum":
        return weighted_sum(text, vector, alpha, **options)
    raise ValueError(f"unknown fusion {method}")


def clamp_limit(limit: int | None, default: int = 20, least: int = 1, most: int = 100) -> int:
    return min(max(int(limit if limit is not None else default), least), most)


def clamp_alpha(alpha: float) -> float:
    return min(max(float(alpha), 0.0), 1.0)


def alpha_for(alpha: float, query: str, language: str) -> float:
    """Short Chinese queries lean on the text side."""
    short = 0 < len((query or "").strip()) <= 4
    return min(alpha, 0.3) if short and (language == "zh" or language.startswith("zh_")) else alpha


def pool_size(rerank_limit: int, limit: int, unit: int = 64) -> int:
    """How many fused results are reranked: the larger of both limits, in whole units."""
    wanted = rerank_limit if rerank_limit > 0 else 2 * limit
    return -(-max(wanted, limit) // unit) * unit


def token_similarity(asked: list[str], content: Column, title: Column, tags: Column) -> Column:
    """Mean hits of the distinct query tokens: one in the content, two in the title, five for a tag; 0 for content without tokens."""
    own = list(dict.fromkeys(asked))
    terms = F.array(*(F.lit(t) for t in own)) if own else F.array().cast("array<string>")
    hits = lambda words: F.size(F.filter(words, lambda w: F.array_contains(terms, w)))
    lower = F.transform(F.coalesce(tags, F.array().cast("array<string>")), F.lower)
    total = hits(tokenize(content)) + 2 * hits(tokenize(title)) + 5 * hits(lower)
    return F.when(F.size(tokenize(content)) == 0, 0.0).otherwise(total / F.lit(float(max(len(own), 1))))


def tag_feature(asked: list[str], tags: Column) -> Column:
    """The share of query tokens that are tags, repeated tokens counted."""
    lower = F.transform(F.coalesce(tags, F.array().cast("array<string>")), F.lower)
    terms = F.array(*(F.lit(t) for t in asked)) if asked else F.array().cast("array<string>")
    return F.size(F.filter(terms, lambda t: F.array_contains(lower, t))) / F.lit(float(max(len(asked), 1)))


def rerank(fused: DataFrame, asked: list[str], weight: float, content: str = "content", title: str = "section_title", tags: str = "tags") -> DataFrame:
    """Adds token_score and rerank_score, best first; without query tokens the fused order stays.

    Six tokens and more shrink the vector's weight to 0.2; where none of three
    and more is found, the vector score counts three tenths.
    """
    if not asked:
        return fused.withColumns({"token_score": F.lit(0.0), "rerank_score": F.col("combined_score")}).orderBy(F.desc("combined_score"), "section_id")
    w = min(weight, 0.2) if len(asked) >= 6 else weight
    out = fused.withColumn("token_score", token_similarity(asked, F.col(content), F.col(title), F.col(tags)))
    missed = (F.col("token_score") <= 0) & F.lit(len(asked) >= 3)
    vector = F.col("vector_score") * F.when(missed, 0.3).otherwise(1.0)
    feature = F.when(F.col("token_score") > 0, tag_feature(asked, F.col(tags))).otherwise(0.0)
    out = out.withColumn("rerank_score", (1 - w) * F.col("token_score") + w * vector + feature)
    return out.orderBy(F.desc("rerank_score"), "section_id")
