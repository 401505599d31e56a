"""Vector arithmetic on array columns, kept inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from benchweave.functions.names import to_col

EPSILON = 1e-12
# Names of the vector kinds and the columns that hold them.
FEATURE_COLUMNS = {"embedding": "embedding", "projected": "projected_feature", "pooled": "pooled_feature"}


def as_doubles(vector) -> Column:
    return to_col(vector).cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)


def norm(vector) -> Column:
    return F.sqrt(F.aggregate(as_doubles(vector), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(vector) -> Column:
    length = F.greatest(norm(vector), F.lit(EPSILON))
    return F.transform(as_doubles(vector), lambda x: x / length)


def cosine(left, right) -> Column:
    a, b = as_doubles(left), as_doubles(right)
    return dot(a, b) / (F.greatest(norm(a), F.lit(EPSILON)) * F.greatest(norm(b), F.lit(EPSILON)))


def cosine_distance(left, right) -> Column:
    return F.lit(1.0) - cosine(left, right)


def softmax_top(scores) -> tuple[Column, Column]:
    """Index of the first largest score and its softmax probability."""
    values = as_doubles(scores)
    top = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return (F.array_position(values, top) - 1).cast("bigint"), F.lit(1.0) / total


def feature_vector(kind: str) -> Column:
    """The chosen vector column; an unknown kind is an error, and so is a row without that vector."""
    if kind not in FEATURE_COLUMNS:
        raise ValueError(f"unknown feature source {kind!r}; expected one of {sorted(FEATURE_COLUMNS)}")
    name = FEATURE_COLUMNS[kind]
    return F.coalesce(F.col(name), F.raise_error(F.lit(f"a row has no {name}")))
