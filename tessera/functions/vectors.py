"""Vector arithmetic as column functions, in double precision, and means of vectors by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-12


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products; null where either is null or lengths differ."""
    pairs = F.zip_with(doubles(a), doubles(b), lambda x, y: x * y)
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def is_valid(v: Column, dim: int | None = None) -> Column:
    """Whether a vector is not null, of ``dim`` finite numbers, and not zero."""
    finite = ~F.exists(doubles(v), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    right = F.size(v) == dim if dim else F.size(v) > 0
    return F.coalesce(v.isNotNull() & right & finite & (norm(v) > 0), F.lit(False))


def unit(v: Column) -> Column:
    """``v`` over its length; null for vectors that are not valid."""
    # The length is an element, since an expression within the lambda is computed for each component.
    over = F.transform(F.array(norm(v)), lambda length: F.transform(doubles(v), lambda x: x / (length + EPSILON)))
    return F.when(is_valid(v), over[0])


def clip(x: Column, low: float, high: float) -> Column:
    """``x`` within the bounds; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, cut to [-1, 1]; null if either is not valid."""
    return clip(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), -1.0, 1.0)


def topk_mean(values: Column, k: int) -> Column:
    """Mean of the ``k`` largest of an array; 0 for an empty or null one."""
    top = F.slice(F.reverse(F.array_sort(F.filter(values, lambda x: x.isNotNull()))), 1, k)
    return F.coalesce(F.aggregate(top, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(top), F.lit(0)), F.lit(0.0))


def share_mean(values: Column, share: float) -> Column:
    """Mean of the largest ``share`` of an array, one element at least; the count is rounded half to even."""
    n = F.greatest(F.lit(1), F.bround(F.size(values) * F.lit(share)).cast("int"))
    top = F.slice(F.reverse(F.array_sort(values)), F.lit(1), n)
    return F.when(F.size(values) > 0, F.aggregate(top, F.lit(0.0), lambda s, x: s + x) / F.size(top)).otherwise(0.0)


def mean_vectors(df: DataFrame, keys: list[str], vector: str, out: str = "vector", weight: Column | None = None, normalise: bool = True) -> DataFrame:
    """A row per group with the (weighted) mean of its vectors, of unit length if ``normalise``.

    The mean is taken element by element, with partial sums on the map side: no group's vectors are gathered.
    """
    w = weight if weight is not None else F.lit(1.0)
    cells = df.where(is_valid(F.col(vector))).select(*keys, w.cast("double").alias("_w"), F.posexplode(doubles(F.col(vector))).alias("_i", "_x"))
    sums = cells.groupBy(*keys, "_i").agg((F.sum(F.col("_w") * F.col("_x")) / F.nullif(F.sum("_w"), F.lit(0.0))).alias("_m"))
    rows = sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias(out))
    return rows.withColumn(out, unit(F.col(out))) if normalise else rows


def leave_one_out(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Adds ``rest``: the unit mean of the group's other vectors, from the group's sum less the own; null in a group of one."""
    units = df.withColumn("_u", unit(F.col(vector)))
    cells = units.where("_u IS NOT NULL").select(*keys, F.posexplode("_u").alias("_i", "_x"))
    sums = cells.groupBy(*keys, "_i").agg(F.sum("_x").alias("_s"), F.count("*").alias("_n"))
    sums = sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_s"))), lambda s: s["_s"]).alias("_sum"), F.max("_n").alias("_n"))
    joined = units.join(sums, keys, "left")
    rest = F.when(F.col("_n") > 1, unit(F.zip_with("_sum", "_u", lambda s, x: s - x)))
    return joined.withColumn("rest", rest).drop("_u", "_sum", "_n")
