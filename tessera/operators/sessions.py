"""Segments, spans and bounded banks along time."""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def gap_segments(df: DataFrame, keys: list[str], at: Column, gap: Any, tie: list[str], out: str = "segment") -> DataFrame:
    """Numbers the segments of each key from 1: a new one begins where more than ``gap`` passed since the row before."""
    order = Window.partitionBy(*keys).orderBy(at, *tie)
    new = (F.lag(at).over(order).isNull() | (at - F.lag(at).over(order) > gap)).cast("int")
    return df.withColumn("_new", new).withColumn(out, F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def frame_gap(seconds: float, fps: float) -> int:
    """Whole frames in a gap; a part of a frame is cut off."""
    return int(seconds * fps)


def keep_last(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The last ``n`` rows of each key; ``order`` sorts newest first and breaks ties."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def quota(df: DataFrame, keys: list[str], kind: str, order: list[Column], per_kind: int, total: int) -> DataFrame:
    """Up to ``total`` rows a key: first the best ``per_kind`` of each kind, then the best of the rest."""
    by_kind = F.row_number().over(Window.partitionBy(*keys, kind).orderBy(*order))
    ranked = df.withColumn("_extra", (by_kind > per_kind).cast("int"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_extra", *order))
    return ranked.withColumn("_rn", rank).where(F.col("_rn") <= total).drop("_rn", "_extra")


def islands(df: DataFrame, keys: list[str], start: str, end: str, slack: float) -> DataFrame:
    """Spans of each key put together where the gap is ``slack`` at most: keys, start, end and n_spans."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = (reach.isNull() | (F.col(start) - reach > slack)).cast("int")
    numbered = df.withColumn("_new", new).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_spans")).drop("_island")


def rate_limited(df: DataFrame, keys: list[str], at: str, interval: float) -> DataFrame:
    """Rows at least ``interval`` after the last one taken of their key: taking a row starts the wait anew.

    The fold runs over a key's times only (an array of numbers), and taken times are joined back.
    """
    def step(acc: Column, x: Column) -> Column:
        take = acc["last"].isNull() | (x - acc["last"] >= interval)
        return F.struct(F.when(take, x).otherwise(acc["last"]).alias("last"), F.when(take, F.concat(acc["taken"], F.array(x))).otherwise(acc["taken"]).alias("taken"))

    times = df.groupBy(*keys).agg(F.array_sort(F.collect_set(F.col(at).cast("double"))).alias("_t"))
    zero = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast("array<double>").alias("taken"))
    taken = times.select(*keys, F.explode(F.aggregate("_t", zero, step, lambda acc: acc["taken"])).alias("_taken"))
    return df.join(taken, [df[k].eqNullSafe(taken[k]) for k in keys] + [df[at].cast("double") == taken["_taken"]], "left_semi")


def novel(df: DataFrame, keys: list[str], kind: str, order: list[str], vector: str, quality: str, novelty: float, better: float = 0.02) -> DataFrame:
    """Rows that a growing bank accepts: a vector near one of its kind is refused unless its quality is better by ``better``.

    The bank decides row by row, so a key's rows are folded in order in one task; keys run in parallel.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        banks: dict[Any, tuple[list[np.ndarray], list[float]]] = {}
        keep = []
        for vec, k, q in zip(rows[vector], rows[kind], rows[quality], strict=True):
            v = np.asarray(vec, float)
            v = v / (np.linalg.norm(v) + 1e-12)
            bank, qualities = banks.setdefault(k, ([], []))
            near = np.array(bank) @ v if bank else np.zeros(0)
            best = int(near.argmax()) if len(near) else -1
            take = best < 0 or near[best] < novelty or q > qualities[best] + better
            if take:
                bank.append(v)
                qualities.append(q)
            keep.append(take)
        return rows[keep]

    return df.groupBy(*keys).applyInPandas(fold, df.schema)


def edges_of_state(df: DataFrame, keys: list[str], order: list[str], active: str) -> DataFrame:
    """Adds ``edge`` (enter, exit or null) and ``segment``, which grows at each exit of the state ``active``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.coalesce(F.lag(active).over(w), F.lit(False))
    edge = F.when(F.col(active) & ~before, "enter").when(~F.col(active) & before, "exit")
    out = df.withColumn("edge", edge)
    return out.withColumn("segment", (1 + F.sum(F.when(F.col("edge") == "exit", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).cast("long"))


def lanes(df: DataFrame, keys: list[str], start: str, end: str, tie: str) -> DataFrame:
    """Adds ``lane``: each span goes to the first lane that is free at its start. A key's spans are packed in order in one task."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([start, end, tie], kind="stable")
        free: list[float] = []
        lane = []
        for a, b in zip(rows[start], rows[end], strict=True):
            at = next((i for i, f in enumerate(free) if a >= f), len(free))
            free[at : at + 1] = [b]
            lane.append(at)
        return rows.assign(lane=np.array(lane, np.int64))

    return df.groupBy(*keys).applyInPandas(pack, T.StructType([*df.schema.fields, T.StructField("lane", T.LongType())]))


def sample_and_hold(df: DataFrame, keys: list[str], at: str, value: str, step: float, hold: float) -> DataFrame:
    """A row each ``step`` from a key's first to its last time, with the last value (of several at one time the largest); null once it is older than ``hold``."""
    ends = df.groupBy(*keys).agg(F.min(at).alias("_a"), F.max(at).alias("_b"))
    grid = ends.select(*keys, F.explode(F.sequence(F.lit(0), F.floor((F.col("_b") - F.col("_a")) / step).cast("int"))).alias("_i"), "_a").select(*keys, (F.col("_a") + F.col("_i") * step).alias(at), F.lit(None).cast(df.schema[value].dataType).alias(value), F.lit(True).alias("_grid"))
    both = df.select(*keys, F.col(at).cast("double").alias(at), value).withColumn("_grid", F.lit(False)).unionByName(grid)
    seen = Window.partitionBy(*keys).orderBy(at, "_grid", value).rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(~F.col("_grid"), F.struct(F.col(at).alias("t"), F.col(value).alias("v")))
    held = both.withColumn("_last", F.last(mark, ignorenulls=True).over(seen)).where("_grid")
    return held.select(*keys, at, F.when(F.col(at) - F.col("_last.t") <= hold, F.col("_last.v")).alias(value))


def moving_average(df: DataFrame, keys: list[str], order: list[str], vector: str, decay: float = 0.8) -> DataFrame:
    """A row per key with the exponential average of its vectors in order, of unit length after each step."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        now = None
        for vec in rows.sort_values(order, kind="stable")[vector]:
            v = np.asarray(vec, float)
            now = v if now is None else decay * now + (1 - decay) * v
            now = now / (np.linalg.norm(now) + 1e-12)
        return rows[keys].head(1).assign(average=[now])

    schema = T.StructType([*df.select(*keys).schema.fields, T.StructField("average", T.ArrayType(T.DoubleType()))])
    return df.groupBy(*keys).applyInPandas(fold, schema)

