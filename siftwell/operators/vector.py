"""Vector search by exact cosine similarity.

A search is one scan: similarity is an expression on the vector column, and
the top-k keeps k rows in each task.  An optional coarse quantiser partitions
vectors by their nearest centroid, so that a search reads a few partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.vectors import cosine, cosine_to, literal, mean, mean_column
from siftwell.operators.relational import containing, matching, present

ROUND = 1e-12


def scored(vectors: DataFrame, query: list[float], vector_col: str = "vector") -> DataFrame:
    return vectors.withColumn("similarity", cosine_to(F.col(vector_col), query))


def nearest(vectors: DataFrame, query: list[float], limit: int = 10, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """The ``limit`` nearest vectors with their similarity; ties go to the smaller id."""
    return scored(vectors, query, vector_col).orderBy(F.desc("similarity"), id_col).limit(limit)


def similar(vectors: DataFrame, query: list[float], limit: int = 10, threshold: float = 0.3, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """As nearest, of those above the threshold."""
    return scored(vectors, query, vector_col).where(F.col("similarity") > threshold).orderBy(F.desc("similarity"), id_col).limit(limit)


def cascade(vectors: DataFrame, query: list[float], limit: int = 10, threshold: float = 0.3, fallback: float | None = 0.1, any_nearest: bool = True, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """Vectors above the threshold; if there are none those above the fallback; if none either, the nearest.

    One scan takes the top-k; all tiers are decided on its rows, since the best row settles the tier.
    """
    found = nearest(vectors, query, limit, id_col, vector_col)
    best = F.max("similarity").over(Window.partitionBy())
    tier = F.when(best > threshold, threshold)
    if fallback is not None and fallback < threshold:
        tier = tier.when(best > fallback, fallback)
    tier = tier.otherwise(F.lit(-2.0 if any_nearest else 2.0))
    return found.withColumn("__tier", tier).where(F.col("similarity") > F.col("__tier")).drop("__tier")


def filtered_after(vectors: DataFrame, query: list[float], limit: int = 10, allowed: DataFrame | None = None, values: dict | None = None, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """Of the ``limit`` nearest vectors those whose id is in ``allowed`` (column id) and whose columns equal ``values``; so fewer than ``limit`` may stay.

    Filter the vectors before ``nearest`` to get ``limit`` rows.
    """
    found = matching(nearest(vectors, query, limit, id_col, vector_col), values or {})
    return found if allowed is None else present(found, allowed, id_col, "id")


def cross_modal(vectors: DataFrame, query: list[float], limit: int = 10, **options) -> DataFrame:
    """The nearest vectors to one of another kind of content; vectors of all kinds share one space."""
    return nearest(vectors, query, limit, **options)


def within(vectors: DataFrame, query: list[float], radius: float, limit: int = 100, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """Vectors at a cosine distance below the radius."""
    return similar(vectors, query, limit, 1 - radius, id_col, vector_col)


def many_vectors(vectors: DataFrame, queries: list[list[float]], limit: int = 10, method: str = "average", weights: list[float] | None = None, **options) -> DataFrame:
    """The nearest vectors to the average or weighted average of several."""
    if method not in ("average", "weighted"):
        raise ValueError(f"unknown method {method}")
    return nearest(vectors, mean(queries, weights or [] if method == "weighted" else None), limit, **options)


def for_each(queries: DataFrame, vectors: DataFrame, limit: int = 10, query_id: str = "query_id", query_vector: str = "query_vector", id_col: str = "id", vector_col: str = "vector", block: int = 256) -> DataFrame:
    """The nearest vectors to each of a stated set of queries: query_id, id, similarity, rank.

    Queries are taken in blocks of a fixed number as one array, so each block
    is one pass over the vectors; each row keeps, per query, only its similarity.
    """
    rows = queries.select(query_id, query_vector).orderBy(query_id).collect()
    out = None
    for i in range(0, len(rows), block):
        part = rows[i : i + block]
        asked = F.array(*(F.struct(F.lit(r[0]).alias(query_id), literal(list(r[1])).alias("q")) for r in part))
        pairs = vectors.select(F.col(id_col), F.explode(F.transform(asked, lambda q: F.struct(q[query_id].alias(query_id), cosine(F.col(vector_col), q["q"]).alias("similarity")))).alias("p")).select(f"p.{query_id}", id_col, "p.similarity")
        order = Window.partitionBy(query_id).orderBy(F.desc("similarity"), F.col(id_col))
        best = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
        out = best if out is None else out.unionByName(best)
    if out is None:
        return queries.select(query_id).crossJoin(vectors.select(id_col)).withColumns({"similarity": F.lit(0.0), "rank": F.lit(0)}).limit(0)
    return out


def boosted(found: DataFrame, tagged: DataFrame, tag_ids: list[int], weight: float = 1.1, threshold: float | None = None, limit: int | None = None, id_col: str = "id", section_col: str = "section_id") -> DataFrame:
    """Results with any of the tags count ``weight`` times: similarity, boosted_score and matching_tags.

    ``found`` is a result list; ``tagged`` has section_id and tag_id. Matched tags are grouped before the join, so no result repeats.
    """
    own = tagged.where(F.col("tag_id").isin(tag_ids)).join(F.broadcast(found.select(F.col(id_col).alias("__f"))), F.col(section_col) == F.col("__f"), "left_semi")
    tags = own.groupBy(F.col(section_col).alias("__s")).agg(F.sort_array(F.collect_set("tag_id")).alias("matching_tags"))
    out = found.join(tags, F.col(id_col) == F.col("__s"), "left").drop("__s")
    out = out.withColumn("boosted_score", F.col("similarity") * F.when(F.size("matching_tags") > 0, weight).otherwise(1.0))
    out = out.withColumn("matching_tags", F.coalesce("matching_tags", F.array().cast("array<bigint>")))
    out = out.where(F.col("boosted_score") >= threshold) if threshold is not None else out
    out = out.orderBy(F.desc("boosted_score"), id_col)
    return out.limit(limit) if limit is not None else out


def additive_boost(found: DataFrame, weight: float = 0.3) -> DataFrame:
    """The variant that adds a tenth of the weight for each matching tag."""
    return found.withColumn("boosted_score", F.col("similarity") + F.size("matching_tags") * weight * 0.1)


def average_by(vectors: DataFrame, key: str, dimensions: int, vector_col: str = "vector") -> DataFrame:
    """The element-wise average vector of each key."""
    return vectors.groupBy(key).agg(F.array(*mean_column(F.col(vector_col), dimensions)).alias("mean_vector"))


def like_row(vectors: DataFrame, row_id, limit: int = 5, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """The nearest vectors to that of a row, itself among them; no row for an unknown id."""
    row = vectors.where(F.col(id_col) == row_id).select(vector_col).first()
    return nearest(vectors, list(row[0]), limit, id_col, vector_col) if row else vectors.withColumn("similarity", F.lit(0.0)).limit(0)


def like_section(sections: DataFrame, vectors: DataFrame, section_id: int, limit: int = 5, shown: int = 101) -> DataFrame:
    """section_id and similarity of the sections nearest to one, itself among them.

    A section without a vector gives the other sections that contain the first ``shown`` characters
    of its text, in order of their ids and with a null similarity.
    """
    row = vectors.where(F.col("section_id") == section_id).select("vector").first()
    if row and row[0]:
        return nearest(vectors, list(row[0]), limit, "section_id").select("section_id", "similarity")
    text = sections.where(F.col("section_id") == section_id).select(F.substring(F.coalesce("content", F.lit("")), 1, shown)).first()
    others = containing(sections.where(F.col("section_id") != section_id), text[0], "content") if text else sections.limit(0)
    return others.select("section_id", F.lit(None).cast("double").alias("similarity")).orderBy("section_id").limit(limit)


def centroids(vectors: DataFrame, count: int = 100, dimensions: int | None = None, id_col: str = "id", vector_col: str = "vector", sample: int = 20000, rounds: int = 10) -> list[list[float]]:
    """Centroids of a bounded sample, by k-means on the driver; fitting needs no more rows at any size."""
    import numpy as np

    rows = vectors.select(id_col, vector_col).where(F.size(vector_col) > 0).orderBy(F.xxhash64(id_col), id_col).limit(sample).collect()
    points = np.array([r[1] for r in rows], float)
    if not len(points):
        return []
    points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), ROUND)
    centres = points[: min(count, len(points))].copy()
    for _ in range(rounds):
        owner = (points @ centres.T).argmax(axis=1)
        for k in range(len(centres)):
            if (owner == k).any():
                centres[k] = points[owner == k].mean(axis=0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), ROUND)
    return centres.tolist()


def with_list(vectors: DataFrame, centres: list[list[float]], vector_col: str = "vector", name: str = "list") -> DataFrame:
    """Each vector's nearest centroid; write the table partitioned by it."""
    scores = F.array(*(F.struct(cosine_to(F.col(vector_col), c).alias("s"), F.lit(-k).alias("k")) for k, c in enumerate(centres)))
    return vectors.withColumn(name, -F.array_max(scores)["k"])


def probe(vectors: DataFrame, centres: list[list[float]], query: list[float], limit: int = 10, probes: int = 10, name: str = "list", id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """Approximate nearest vectors: only the lists of the nearest centroids are read."""
    size = sum(x * x for x in query) ** 0.5 or 1.0
    order = sorted(range(len(centres)), key=lambda k: -sum(a * b for a, b in zip(centres[k], query, strict=True)) / size)
    return nearest(vectors.where(F.col(name).isin(order[:probes])), query, limit, id_col, vector_col)


def rank(found: DataFrame, score: str = "similarity", id_col: str = "id") -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), F.col(id_col))))
