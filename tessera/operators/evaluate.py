"""How good a mapping or a score is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def auc(df: DataFrame, score: str, label: str, keys: list[str] | None = None) -> DataFrame:
    """n_pos, n_neg and auc: the chance that a positive outranks a negative, ties half.

    Rows are counted by score first; ranks are summed over distinct scores.
    """
    keys = keys or []
    by = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*keys, score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = by.withColumn("_w", F.col("p") * (below + 0.5 * F.col("q")))
    out = wins.groupBy(*keys).agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), F.sum("_w").alias("_w"))
    return out.withColumn("auc", F.col("_w") / F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0))).drop("_w")


def summary(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """n, mean, std (of the population), min, max and the exact quantiles of QUANTILES, interpolated."""
    at = F.percentile(value, F.array(*[F.lit(q) for q in QUANTILES]))
    out = df.where(F.col(value).isNotNull()).groupBy(*(keys or [])).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), at.alias("_q"))
    return out.select(*(keys or []), "n", "mean", "std", "min", "max", *[F.col("_q")[i].alias(f"p{int(q * 100)}") for i, q in enumerate(QUANTILES)])


def summary_of_counts(counts: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """As ``summary``, from the number ``n`` of rows of each value."""
    by = counts.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum("n").alias("n"))
    at = F.percentile(value, F.array(*[F.lit(q) for q in QUANTILES]), F.col("n"))
    w = Window.partitionBy(*keys)
    mean = F.sum(F.col(value) * F.col("n")).over(w) / F.sum("n").over(w)
    out = by.withColumn("_mean", mean).groupBy(*keys).agg(F.sum("n").alias("n"), F.max("_mean").alias("mean"), F.sqrt(F.sum(F.col("n") * (F.col(value) - F.col("_mean")) * (F.col(value) - F.col("_mean"))) / F.sum("n")).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), at.alias("_q"))
    return out.select(*keys, "n", "mean", "std", "min", "max", *[F.col("_q")[i].alias(f"p{int(q * 100)}") for i, q in enumerate(QUANTILES)])


def separation(pairs: DataFrame, key_a: str, key_b: str, camera_a: str, camera_b: str, score: str) -> DataFrame:
    """Figures of scores within a key and of different keys across cameras."""
    kind = F.when(F.col(key_a) == F.col(key_b), "same").when(F.col(camera_a) != F.col(camera_b), "different")
    return summary(pairs.withColumn("kind", kind).where("kind IS NOT NULL"), score, ["kind"])


def label_join(labels: DataFrame, tracks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels (a, b, verdict) of which both tracks are known, and those that miss one."""
    good = labels.where(F.col("verdict").isin("same", "different"))
    known = tracks.select("key").distinct()
    both = good.join(known.select(F.col("key").alias("a")), "a", "left_semi").join(known.select(F.col("key").alias("b")), "b", "left_semi")
    return both, good.exceptAll(both.select(*good.columns))


def run_summary(df: DataFrame, camera: str, identity: str) -> DataFrame:
    """By camera, and for all (null): rows, identities, and identities that other cameras saw too."""
    cameras = df.groupBy(identity).agg((F.count_distinct(camera) > 1).alias("_multi"))
    joined = df.join(cameras, identity, "left")
    return joined.rollup(camera).agg(F.count("*").alias("n_rows"), F.count_distinct(identity).alias("n_identities"), F.count_distinct(F.when(F.col("_multi"), F.col(identity))).alias("n_multi"))
