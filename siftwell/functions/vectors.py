"""Vector functions over arrays of floats, computed in doubles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def parsed(text: Column) -> Column:
    """The vector that a text such as ``[0.1, 0.2]`` writes out; null where it isn't one."""
    return F.try_variant_get(F.try_parse_json(text), "$", "array<float>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is null, empty, of no length, or of another dimension."""
    lengths = norm(a) * norm(b)
    value = F.when((F.size(a) == F.size(b)) & (lengths > 0), dot(a, b) / lengths).otherwise(F.lit(0.0))
    return F.coalesce(value, F.lit(0.0))


def cosine_to(a: Column, query: list[float]) -> Column:
    """Cosine similarity to one query vector, whose norm is computed once."""
    size = sum(x * x for x in query) ** 0.5
    if not size:
        return F.lit(0.0)
    unit = literal([x / size for x in query])
    length = norm(a)
    return F.coalesce(F.when((F.size(a) == len(query)) & (length > 0), dot(a, unit) / length).otherwise(F.lit(0.0)), F.lit(0.0))


def mean(vectors: list[list[float]], weights: list[float] | None = None) -> list[float]:
    """The element-wise average of query vectors; weighted ones are divided by the sum of weights, a missing weight is 1."""
    if not vectors or len({len(v) for v in vectors}) > 1:
        raise ValueError("vectors of one dimension are needed")
    given = weights if weights is not None else [1.0] * len(vectors)
    own = [given[k] if k < len(given) else 1.0 for k in range(len(vectors))]
    total = sum(given)
    return [sum(w * v[k] for w, v in zip(own, vectors, strict=True)) / total for k in range(len(vectors[0]))]


def mean_column(vector: Column, size: int) -> list[Column]:
    """Aggregates for the element-wise average of a column of vectors of one size."""
    return [F.avg(F.get(vector, F.lit(k)).cast("double")) for k in range(size)]


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
