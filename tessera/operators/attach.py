"""Attaching tracklets that stayed alone to groups, in passes: a group's gallery finds what no single tracklet of it did."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.vectors import unit
from tessera.operators.agglomerate import together
from tessera.operators.cluster import constrained_components, cut
from tessera.operators.edges import NAMES, met_in_cells
from tessera.operators.scoring import subsample

CELL = 256


@dataclass(frozen=True)
class Attach:
    """Bars of the passes; the weights are of the best cosine, the mean of the ``top`` best, and the cosine of the means."""

    threshold: float = 0.62
    strong: float = 0.80
    margin: float = 0.03
    passes: int = 3
    cap: int = 64
    top: int = 6
    weights: tuple[float, float, float] = (0.50, 0.32, 0.18)


def group_score(query: np.ndarray, bank: np.ndarray, rule: Attach) -> float:
    """How well a tracklet's unit vectors fit a group's (4 places)."""
    cos = (query @ bank.T).ravel()
    top = np.sort(cos)[-rule.top :].mean()
    a, b = query.mean(axis=0), bank.mean(axis=0)
    means = float(a @ b) / (float(np.linalg.norm(a) * np.linalg.norm(b)) + 1e-12)
    return round(float(rule.weights[0] * cos.max() + rule.weights[1] * top + rule.weights[2] * means), 4)


def _galleries(features: DataFrame, members: DataFrame, rule: Attach) -> DataFrame:
    """component, size, dim and vec: at most ``cap`` unit vectors of a group, one after another."""
    rows = features.join(members, "key").select("component", "key", "seq", unit(F.col("vec").cast("array<double>")).alias("row")).where("row IS NOT NULL")
    rows = subsample(rows, ["component"], ["key", "seq"], rule.cap)
    held = rows.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("key", "seq", "row"))).alias("_rows"))
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    return held.join(sizes, "component").select("component", "size", F.size(F.col("_rows")[0]["row"]).alias("dim"), F.flatten(F.transform("_rows", lambda r: r["row"])).alias("vec"))


def _fits(galleries: DataFrame, rule: Attach) -> DataFrame:
    """single, component, score: every group of one against every other group, in cells of bounded size."""
    dim = (galleries.select("dim").first() or [1])[0]
    dealt, _, base = met_in_cells(galleries.where("size = 1"), galleries, ["component", "vec"], CELL)
    kind = base.schema[NAMES[0]].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        read = lambda t: list(zip(t.column(NAMES[0]).to_pylist(), (np.asarray(v, float).reshape(-1, dim) for v in t.column(NAMES[1]).to_pylist()), strict=True))
        groups = read(right)
        out = [(i, j, group_score(q, bank, rule)) for i, q in read(left) for j, bank in groups if i != j]
        one = left.schema.field(NAMES[0]).type
        return pa.table([pa.array([r[c] for r in out], t) for c, t in enumerate((one, one, pa.float64()))], names=["single", "component", "score"])

    return dealt.applyInArrow(run, f"single {kind}, component {kind}, score double")


def attached(nodes: DataFrame, members: DataFrame, features: DataFrame, rule: Attach = Attach()) -> DataFrame:
    """``members`` (key, component) after up to ``passes`` passes; ``nodes`` has key, camera, start, end, ``features`` key, seq, vec.

    In a pass each tracklet that is alone is scored against all groups as they stand at its beginning, but for those with
    a member in its camera at its time. It joins the best if that reaches the threshold and is clear of the second, or is
    strong; joins are taken by falling score, and one that puts two of a camera at one time together is passed over. The
    next pass scores against the groups as they are then. Tracklets without vectors stay alone; empty tables give empty
    ones.
    """
    foes = cut(together(nodes, 60.0), "attach-foes")
    for _ in range(rule.passes):
        galleries = cut(_galleries(features, members, rule), "attach-galleries")
        side = lambda name, end: members.select(F.col("key").alias(name), F.col("component").alias(end))
        barred = foes.join(side("left", "a"), "left").join(side("right", "b"), "right").select("a", "b")
        barred = barred.unionByName(barred.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        fits = _fits(galleries, rule).join(barred, (F.col("single") == F.col("a")) & (F.col("component") == F.col("b")), "left_anti")
        order = Window.partitionBy("single").orderBy(F.desc("score"), "component")
        best = fits.withColumn("_n", F.row_number().over(order)).withColumn("_second", F.coalesce(F.lead("score").over(order), F.lit(0.0))).where("_n = 1")
        good = best.where((F.col("score") >= rule.threshold) & ((F.round(F.col("score") - F.col("_second"), 4) >= rule.margin) | (F.col("score") >= rule.strong)))
        joins = cut(good.select(F.col("single").alias("left"), F.col("component").alias("right"), "score"), "attach-joins")
        if not joins.head(1):
            break
        # Links inside a group come first (score 2), so the fold sees whole groups.
        inside = members.where("key <> component").select(F.col("component").alias("left"), F.col("key").alias("right"), F.lit(2.0).alias("score"))
        before = members.select("component").distinct().count()
        members = cut(constrained_components(inside.unionByName(joins), nodes.join(members.select("key"), "key", "left_semi")), "attach-members")
        if members.select("component").distinct().count() == before:
            break
    return members
