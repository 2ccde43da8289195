"""Isotonic regression over binned scores: sums by bin in Spark, pool-adjacent-violators over the bins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_isotonic(scored: DataFrame, low: float, high: float, bins: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Knots (x, y) of a non-decreasing map from ``raw`` to P(label = 1); ``scored`` has raw and label. ``bins`` rows at most reach the driver."""
    bin_of = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("raw") - low) / (high - low) * bins))).cast("int")
    rows = scored.where("raw IS NOT NULL AND label IS NOT NULL").groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.sum("label").alias("ones"), F.avg("raw").alias("x")).orderBy("bin").collect()
    if not rows:
        return np.array([low, high]), np.array([0.5, 0.5])
    blocks: list[list[float]] = []  # weight, mean, weighted x
    for r in rows:
        blocks.append([float(r["n"]), r["ones"] / r["n"], r["x"] * r["n"]])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            n, y, x = blocks.pop()
            m = blocks[-1]
            m[1] = (m[0] * m[1] + n * y) / (m[0] + n)
            m[0] += n
            m[2] += x
    return np.array([b[2] / b[0] for b in blocks]), np.array([b[1] for b in blocks])


def apply_isotonic(raw: np.ndarray, knots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return np.clip(np.interp(raw, *knots), 0.0, 1.0)
