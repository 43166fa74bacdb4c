"""Native column expressions over ``array<float|double>`` vectors (computed in double).

Each helper is one ``aggregate(zip_with(...))`` over the pair of arrays; scalars such as norms
are computed by separate expressions, never inside another lambda.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def l2_squared(a, b) -> Column:
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def l2(a, b) -> Column:
    return F.sqrt(l2_squared(a, b))


def norm(a) -> Column:
    return F.sqrt(_sum(F.transform(_c(a), lambda x: x.cast("double") * x.cast("double"))))


def cosine(a, b) -> Column:
    den = norm(a) * norm(b)
    return F.when(den > 0, dot(a, b) / den).otherwise(F.lit(0.0))


def distance(a, b, metric: str = "l2") -> Column:
    if metric == "l2":
        return l2_squared(a, b)
    if metric == "l2_root":
        return l2(a, b)
    if metric == "ip":
        return -dot(a, b)
    if metric == "cosine":
        return F.lit(1.0) - cosine(a, b)
    raise ValueError(metric)


def mean_vectors(df: DataFrame, group_col: str, vec_col: str = "embedding", out: str = "mean") -> DataFrame:
    """Element-wise mean vector per group (double), with Spark ML's ``Summarizer`` (whole-vector
    partial aggregation per task, so a group's cost is one vector add per row)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    return df.groupBy(group_col).agg(
        Summarizer.mean(array_to_vector(F.col(vec_col))).alias("_m"),
        F.count("*").cast("bigint").alias("n_rows"),
    ).select(group_col, vector_to_array("_m").alias(out), "n_rows")
