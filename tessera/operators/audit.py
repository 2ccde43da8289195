"""Reports over a decision log: decisions (handle, phase, round, outcome) and candidates (handle, candidate, score, excluded_by, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def in_one_row(*frames: DataFrame) -> DataFrame:
    """The columns of frames of one row each, as one row."""
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def exclusions(candidates: DataFrame, known: list[str]) -> DataFrame:
    """reason and n, the reasons of ``known`` that never came up at 0."""
    rows = candidates.sparkSession.createDataFrame([(k,) for k in known], "reason string")
    counts = candidates.where("excluded_by IS NOT NULL").groupBy(F.col("excluded_by").alias("reason")).agg(F.count("*").alias("n"))
    return rows.join(counts, "reason", "full_outer").select("reason", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def shortlist(candidates: DataFrame, most: int) -> DataFrame:
    """Adds ``listed``: whether a candidate is among the ``most`` best of its decision."""
    rank = F.row_number().over(Window.partitionBy("handle").orderBy(F.desc("score"), "candidate"))
    return candidates.withColumn("listed", rank <= most)


def margin_disagreement(margins: DataFrame, band: float) -> DataFrame:
    """One row: how often the margin over the eligible and that over all differ, and by how much; how many are within ``band``."""
    gap = F.abs(F.col("margin_eligible") - F.col("margin_any"))
    return margins.where("margin_eligible IS NOT NULL AND margin_any IS NOT NULL").agg(
        F.count("*").alias("n"), F.count_if(gap > 1e-9).alias("n_differ"), F.count_if(F.col("margin_any") < band).alias("n_in_band"), F.round(F.avg(gap), 6).alias("mean_gap"),
    )


def margins_by_outcome(margins: DataFrame, accepted: str) -> DataFrame:
    """accepted, n and the quartiles of the margins, of either outcome."""
    return margins.groupBy(accepted).agg(F.count("*").alias("n"), F.percentile("margin_eligible", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("quartiles"))


def fragmentation(mapping: DataFrame) -> DataFrame:
    """One row: tracklets, identities, tracklets an identity, identities of several tracklets and cameras, suppressed share."""
    by = mapping.where("gid IS NOT NULL").groupBy("gid").agg(F.count("*").alias("n"), F.count_distinct("camera").alias("cameras"))
    whole = mapping.agg(F.count("*").alias("n_tracklets"), F.count_if(F.col("gid").isNull()).alias("n_suppressed"))
    sizes = by.agg(F.count("*").alias("n_identities"), F.round(F.avg("n"), 6).alias("mean_size"), F.max("n").alias("largest"), F.count_if(F.col("n") > 1).alias("n_fragmented"), F.count_if(F.col("cameras") > 1).alias("n_multi_camera"))
    return in_one_row(whole, sizes)


def camera_pairs(decisions: DataFrame) -> DataFrame:
    """By unordered camera pair: considered, merged and excluded, from (camera_a, camera_b, accepted, excluded_by)."""
    pair = [F.least("camera_a", "camera_b").alias("camera_x"), F.greatest("camera_a", "camera_b").alias("camera_y")]
    return decisions.where(F.col("camera_a") != F.col("camera_b")).groupBy(*pair).agg(F.count("*").alias("considered"), F.count_if("accepted").alias("merged"), F.count_if(F.col("excluded_by").isNotNull()).alias("excluded"))


def outcomes(updates: DataFrame) -> DataFrame:
    """The last outcome written for each handle."""
    rank = F.row_number().over(Window.partitionBy("handle").orderBy(F.desc("version")))
    return updates.withColumn("_n", rank).where("_n = 1").drop("_n")
