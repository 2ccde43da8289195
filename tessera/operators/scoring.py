"""Scores of pairs from many vectors: views, models, pooled sets, reciprocal neighbours."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.vectors import clip, cosine, mean_vectors, unit
from tessera.operators import blocks

#: Views that are compared with themselves, and view pairs that tell of a change of posture.
DIRECT_VIEWS = ["full", "upper", "torso", "lower"]
TRANSITION_VIEWS = [
    ("full", "upper"), ("upper", "full"), ("full", "torso"), ("torso", "full"), ("upper", "torso"), ("torso", "upper"),
    ("full", "lower"), ("lower", "full"), ("torso", "lower"), ("lower", "torso"),
]
#: The least score at which a model supports a pair, by model.
MODEL_BARS = {"resnet": 0.44, "swin": 0.44, "solider": 0.42}


def vector_pairs(left: DataFrame, right: DataFrame, pairs: DataFrame, on: list[str], vector: str) -> DataFrame:
    """left, right, the columns of ``on`` and cos for all vector pairs of the given pairs: long form, joined on keys."""
    a = left.select(F.col("key").alias("left"), *on, F.col(vector).alias("_a"))
    b = right.select(F.col("key").alias("right"), *[F.col(c).alias(f"_{c}") for c in on], F.col(vector).alias("_b"))
    joined = pairs.select("left", "right").join(a, "left").join(b.withColumnRenamed("right", "_right"), [F.col("right") == F.col("_right"), *[F.col(c) == F.col(f"_{c}") for c in on]])
    return joined.select("left", "right", *on, cosine(F.col("_a"), F.col("_b")).alias("cos"))


def topk_means(cosines: DataFrame, keys: list[str], k: int, out: str = "score") -> DataFrame:
    """Mean of each group's ``k`` largest cosines."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("cos")))
    return cosines.where("cos IS NOT NULL").withColumn("_n", rank).where(F.col("_n") <= k).groupBy(*keys).agg(F.avg("cos").alias(out))


def view_cosines(features: DataFrame, pairs: DataFrame, views: DataFrame, more: list[str]) -> DataFrame:
    """left, right, the columns of ``more``, view_l, view_r, those of ``views`` and cos of all vectors of the listed view pairs."""
    a = features.select(F.col("key").alias("left"), *more, F.col("view").alias("view_l"), F.col("vec").alias("_a"))
    b = features.select(F.col("key").alias("right"), *more, F.col("view").alias("view_r"), F.col("vec").alias("_b"))
    joined = pairs.select("left", "right").join(a, "left").join(F.broadcast(views), "view_l").join(b, ["right", "view_r", *more])
    return joined.select("left", "right", *views.columns, *more, cosine(F.col("_a"), F.col("_b")).alias("cos"))


def best_of(cosines: DataFrame, keys: list[str], k: int, bar: float) -> DataFrame:
    """keys, n, best, top (mean of the ``k`` best cosines) and support (how many reach ``bar``)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("cos")))
    top = F.avg(F.when(F.col("_n") <= k, F.col("cos")))
    return cosines.where("cos IS NOT NULL").withColumn("_n", rank).groupBy(*keys).agg(F.count("*").alias("n"), F.max("cos").alias("best"), top.alias("top"), F.count_if(F.col("cos") >= bar).alias("support"))


def _compared(features: DataFrame, pairs: DataFrame, views: DataFrame, more: list[str], k: int, bar: float) -> DataFrame:
    """``best_of`` the cosines of ``view_cosines``, added up where blocks of two banks meet: no table of cosines is made."""
    asked = pairs.select("left", "right").distinct()
    if more:  # banks by the columns that both sides share
        name = F.struct(F.col("key").alias("key"), *more)
        rows = features.where(F.concat(*more).isNotNull()).select(name.alias("key"), F.col("view").alias("class"), "vec")
        shared = features.select(F.col("key").alias("left"), *more).distinct().join(asked, "left").join(features.select(F.col("key").alias("right"), *more).distinct(), ["right", *more])
        asked = shared.select(*[F.struct(F.col(c).alias("key"), *more).alias(c) for c in ("left", "right")])
    else:
        rows = features.select("key", F.col("view").alias("class"), "vec")
    allowed = [(r.view_l, r.view_r) for r in views.select("view_l", "view_r").collect()]  # the fixed list of compared kinds
    by = blocks.best_of_pairs(rows, asked, [k], bar, allowed).withColumnsRenamed({"class_l": "view_l", "class_r": "view_r", f"top_{k}": "top"})
    if more:
        by = by.select(F.col("left.key").alias("left"), F.col("right.key").alias("right"), *[F.col(f"left.{c}").alias(c) for c in more], "view_l", "view_r", "n", "best", "top", "support")
    return by.join(F.broadcast(views), ["view_l", "view_r"])


def _views(features: DataFrame) -> DataFrame:
    rows = [(v, v, True) for v in DIRECT_VIEWS] + [(a, b, False) for a, b in TRANSITION_VIEWS]
    return features.sparkSession.createDataFrame(rows, "view_l string, view_r string, direct boolean")


def _by_view(features: DataFrame, pairs: DataFrame, k: int, bar: float) -> DataFrame:
    """Each compared view pair's top mean and support, and its place among those of its kind."""
    by_view = _compared(features, pairs, _views(features), ["model"], k, bar)
    place = F.row_number().over(Window.partitionBy("left", "right", "model", "direct").orderBy(F.desc("top"), "view_l", "view_r"))
    return by_view.withColumn("_n", place)


def view_scores(features: DataFrame, pairs: DataFrame, k: int = 5, bar: float = 0.50) -> DataFrame:
    """left, right, model, score, support and transition from features (key, model, view, vec).

    Each compared view pair scores the mean of its ``k`` best cosines. The base is the better of the best direct view
    and the mean of the two best; a posture transition counts .85 of itself and .15 of the base. Support is the number
    of vectors' pairs at ``bar`` or more, in direct views and transitions.
    """
    direct = F.col("direct")
    one = _by_view(features, pairs, k, bar).groupBy("left", "right", "model").agg(
        F.max(F.when(direct, F.col("top"))).alias("_best"), F.avg(F.when(direct & (F.col("_n") <= 2), F.col("top"))).alias("_two"), F.max(F.when(~direct, F.col("top"))).alias("_trans"), F.sum("support").alias("support"),
    )
    base = F.coalesce(F.greatest("_best", "_two"), F.lit(0.0))
    value = F.when(F.col("_trans").isNull(), base).otherwise(F.greatest(base, 0.85 * F.greatest("_trans", F.lit(-1.0)) + 0.15 * base))
    return one.select("left", "right", "model", value.alias("score"), "support", F.coalesce(F.col("_trans") >= base + 0.01, F.lit(False)).alias("transition"))


def capped_view_scores(features: DataFrame, pairs: DataFrame, k: int = 5, bar: float = 0.60) -> DataFrame:
    """As ``view_scores``, of the earlier model: the base is the mean of the two best direct views, a transition counts
    .72 of itself and .28 of the base, and a view pair lends support of 3 (direct) or 2 (transition) at most."""
    direct = F.col("direct")
    capped = F.least("support", F.when(direct, 3).otherwise(2))
    one = _by_view(features, pairs, k, bar).groupBy("left", "right", "model").agg(F.avg(F.when(direct & (F.col("_n") <= 2), F.col("top"))).alias("_two"), F.max(F.when(~direct, F.col("top"))).alias("_trans"), F.sum(capped).alias("support"))
    same, trans = F.coalesce("_two", F.lit(0.0)), F.col("_trans")
    value = F.when(trans.isNull(), same).when(F.col("_two").isNull(), trans).otherwise(F.greatest(same, 0.72 * trans + 0.28 * same))
    return one.select("left", "right", "model", value.alias("score"), "support", F.coalesce(trans >= same, F.lit(False)).alias("transition"))


def _kinds(features: DataFrame, pairs: DataFrame, allowed: list[tuple[str, str]], bar: float) -> DataFrame:
    """(left, right, view_l, view_r, score, support): .72 of the best cosine and .28 of the mean of the three best, by compatible kinds."""
    views = features.sparkSession.createDataFrame(allowed, "view_l string, view_r string")
    by = _compared(features, pairs, views, [], 3, bar)
    return by.withColumn("score", 0.72 * F.col("best") + 0.28 * F.col("top"))


def body_scores(features: DataFrame, pairs: DataFrame, bar: float = 0.60, parts_with_whole: bool = False) -> DataFrame:
    """left, right, score, support and partial from features (key, view, vec) of the kinds full, light, upper and lower.

    Kinds that are equal come first; full and light are alike, and parts are compared with them if asked. Where the left
    side shows parts only, the best of them counts .85 and the base .15. Support is the number of cosines at ``bar``.
    """
    whole, parts = ["full", "light"], ["upper", "lower"]
    allowed = [(a, b) for a in whole for b in whole] + [(p, p) for p in parts]
    allowed += [x for p in parts for w in whole for x in ((p, w), (w, p))] if parts_with_whole else []
    exact, part = F.col("view_l") == F.col("view_r"), F.col("view_l").isin(parts)
    one = _kinds(features, pairs, allowed, bar).groupBy("left", "right").agg(
        F.coalesce(F.max(F.when(exact, F.col("score"))), F.max("score")).alias("_base"), F.sum("support").alias("support"), F.max(F.when(part, F.col("score"))).alias("_part"), F.bool_and(part).alias("partial"),
    )
    return one.select("left", "right", F.when(F.col("partial"), 0.85 * F.col("_part") + 0.15 * F.col("_base")).otherwise(F.col("_base")).alias("score"), "support", "partial")


def part_scores(features: DataFrame, pairs: DataFrame, bar: float = 0.63) -> DataFrame:
    """left, right, score and support: .82 of full (light, if there is no full) and .18 of the better part; without them .85 and .15 of the two parts."""
    kinds = _kinds(features, pairs, [(k, k) for k in ("full", "light", "upper", "lower")], bar)
    of = lambda kind, c: F.max(F.when(F.col("view_l") == kind, F.col(c)))
    one = kinds.groupBy("left", "right").agg(*[of(kind, c).alias(f"{kind}_{c}") for kind in ("full", "light", "upper", "lower") for c in ("score", "support")])
    whole, n_whole = F.coalesce("full_score", "light_score"), F.coalesce("full_support", "light_support", F.lit(0))
    better, worse = F.greatest("upper_score", "lower_score"), F.least("upper_score", "lower_score")
    n_parts = F.coalesce("upper_support", F.lit(0)) + F.coalesce("lower_support", F.lit(0))
    score = F.when(whole.isNull(), 0.85 * better + 0.15 * worse).when(better.isNull(), whole).otherwise(0.82 * whole + 0.18 * better)
    return one.select("left", "right", score.alias("score"), (n_whole + n_parts).alias("support")).where("score IS NOT NULL")


def face_scores(cosines: DataFrame, keys: list[str], bar: float = 0.55) -> DataFrame:
    """keys, score (.72 of the best cosine, .28 of the mean of the three best) and support at ``bar``."""
    return best_of(cosines, keys, 3, bar).select(*keys, (0.72 * F.col("best") + 0.28 * F.col("top")).alias("score"), "support")


@dataclass(frozen=True)
class Blend:
    """Parts of a blended score: the best cosine, the mean of the ``k`` best, and the prototypes' cosine."""

    best: float
    top: float
    prototype: float
    k: int


#: Blends of two tracklets' banks, and of a tracklet and a group.
CORE_BLEND = Blend(0.0, 0.45, 0.55, 5)
TRACK_BLEND = Blend(0.50, 0.30, 0.20, 4)
GROUP_BLEND = Blend(0.50, 0.32, 0.18, 6)


def prototype_pairs(features: DataFrame, pairs: DataFrame) -> DataFrame:
    """left, right, prototype (the cosine of the banks' means) of pairs of banks (key, vec)."""
    means = mean_vectors(features.withColumn("vec", unit(F.col("vec"))), ["key"], "vec", "vec")
    return vector_pairs(means, means, pairs, [], "vec").withColumnRenamed("cos", "prototype")


def blended(features: DataFrame, pairs: DataFrame, blend: Blend) -> DataFrame:
    """left, right and score of pairs of banks (key, vec) by ``blend``."""
    return blends(features, pairs, {"score": blend})


def blends(features: DataFrame, pairs: DataFrame, named: dict[str, Blend]) -> DataFrame:
    """left, right and a score for each of ``named`` blends of pairs of banks (key, vec), whose vectors are compared once."""
    ks = sorted({b.k for b in named.values()})
    best = blocks.best_of_pairs(features.select("key", F.lit("").alias("class"), "vec"), pairs.select("left", "right").distinct(), ks, 2.0)
    both = best.join(prototype_pairs(features, pairs), ["left", "right"])
    score = lambda b: b.best * F.col("best") + b.top * F.col(f"top_{b.k}") + b.prototype * F.col("prototype")
    return both.select("left", "right", *[score(b).alias(name) for name, b in named.items()])


def bank_scores(features: DataFrame, pairs: DataFrame, share: float = 0.25) -> DataFrame:
    """left, right, prototype, max_exemplar (never below the prototypes), consensus (mean of the best ``share``) and n of pairs of banks (key, vec)."""
    both = blocks.pooled_pairs(features.select("key", "vec"), pairs.distinct(), share).join(prototype_pairs(features, pairs), ["left", "right"])
    return both.select("left", "right", "prototype", F.greatest("prototype", "max_exemplar").alias("max_exemplar"), "consensus", "n")


@dataclass(frozen=True)
class Weights:
    """Parts of a fused score."""

    top_two: float
    strongest: float
    colour: float
    temporal: float
    geometry: float
    continuity: float


#: Fixed values.
SAME_CAMERA = Weights(0.83, 0.0, 0.07, 0.0, 0.0, 0.10)
CROSS_CAMERA = Weights(0.75, 0.12, 0.05, 0.05, 0.03, 0.0)


def fused(models: dict[str, float], same: Column, colour: Column, temporal: Column, geometry: Column, continuity: Column, within: Weights = SAME_CAMERA, across: Weights = CROSS_CAMERA) -> dict[str, Column]:
    """fused, agreement and support from columns of model scores: the two best models, and the other evidence by weight.

    ``models`` gives the score at which each supports the pair.
    """
    scores = F.reverse(F.array_sort(F.array(*[F.coalesce(F.col(m), F.lit(0.0)) for m in models])))
    top_two = (scores[0] + scores[1]) / 2.0
    part = lambda w: w.top_two * top_two + w.strongest * scores[0] + w.colour * colour + w.temporal * temporal + w.geometry * geometry + w.continuity * continuity
    return {"fused": clip(F.when(same, part(within)).otherwise(part(across)), 0.0, 1.0), "agreement": top_two, "model_support": sum(F.when(F.coalesce(F.col(m), F.lit(0.0)) >= bar, 1).otherwise(0) for m, bar in models.items())}


def trajectory(prior: Column, following: Column, elapsed: Column, height: Column) -> Column:
    """How well the ``following`` points (x, y, ts structs) go on from the ``prior`` ones, of one camera.

    .70 of nearness to the place that the last two points lead to (for ``elapsed`` seconds, 1 at most), 0 at six heights
    away; .30 of the direction over six points on either side. Neutral with fewer than two points; ``height`` is that of
    the last point, 1 at least.
    """
    tail, head = F.when(F.size(prior) >= 6, F.slice(prior, -6, 6)).otherwise(prior), F.slice(following, 1, 6)
    first, last, before = tail[0], F.element_at(tail, -1), F.when(F.size(prior) >= 2, F.element_at(prior, -2))
    begin, end = head[0], F.element_at(head, -1)
    dt = F.greatest(last["ts"] - before["ts"], F.lit(1e-3))
    ahead = F.least(F.greatest(elapsed, F.lit(0.0)), F.lit(1.0)) / dt
    off = F.hypot(begin["x"] - last["x"] - (last["x"] - before["x"]) * ahead, begin["y"] - last["y"] - (last["y"] - before["y"]) * ahead)
    position = F.greatest(F.lit(0.0), 1.0 - off / F.greatest(F.coalesce(height, F.lit(1.0)), F.lit(1.0)) / 6.0)
    vx, vy, wx, wy = last["x"] - first["x"], last["y"] - first["y"], end["x"] - begin["x"], end["y"] - begin["y"]
    old, new = F.hypot(vx, vy), F.hypot(wx, wy)
    direction = F.when((old > 1e-3) & (new > 1e-3), 0.5 + 0.5 * clip((vx * wx + vy * wy) / F.nullif(old * new, F.lit(0.0)), -1.0, 1.0)).otherwise(0.5)
    enough = (F.size(prior) >= 2) & (F.size(following) >= 2)
    return F.coalesce(F.when(enough, 0.70 * position + 0.30 * direction), F.lit(0.5))


def pooled(cosines: DataFrame, keys: list[str], share: float = 0.3) -> DataFrame:
    """By pair: max_exemplar (the best cosine), consensus (mean of the best ``share``, half to even) and n."""
    w = Window.partitionBy(*keys)
    n = F.count("*").over(w)
    kept = F.greatest(F.lit(1), F.bround(n * F.lit(share)).cast("long"))
    some = cosines.where("cos IS NOT NULL").withColumn("_n", n).withColumn("_k", kept).withColumn("_r", F.row_number().over(w.orderBy(F.desc("cos"))))
    return some.groupBy(*keys).agg(F.max("cos").alias("max_exemplar"), F.avg(F.when(F.col("_r") <= F.col("_k"), F.col("cos"))).alias("consensus"), F.count("*").alias("n"))


def _best_counted(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cos, n (pairs of that cosine), _above (pairs of a better one) and _all, a row for each cosine."""
    by = counts.groupBy(*keys, "cos").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys)
    return by.withColumn("_above", F.sum("n").over(w.orderBy(F.desc("cos"))) - F.col("n")).withColumn("_all", F.sum("n").over(w))


def pooled_counts(counts: DataFrame, keys: list[str], share: float = 0.3) -> DataFrame:
    """As ``pooled``, from the number ``n`` of pairs of each cosine."""
    k = F.greatest(F.lit(1), F.bround(F.col("_all") * F.lit(share)).cast("long"))
    some = _best_counted(counts, keys).withColumn("_k", k).withColumn("_taken", F.greatest(F.lit(0), F.least("n", F.col("_k") - F.col("_above"))))
    return some.groupBy(*keys).agg(F.max("cos").alias("max_exemplar"), (F.sum(F.col("cos") * F.col("_taken")) / F.max("_k")).alias("consensus"), F.max("_all").alias("n"))


def topk_counts(counts: DataFrame, keys: list[str], k: int, out: str = "score") -> DataFrame:
    """As ``topk_means``, from the number ``n`` of pairs of each cosine."""
    some = _best_counted(counts, keys).withColumn("_taken", F.least("n", F.lit(k) - F.col("_above"))).where("_taken > 0")
    return some.groupBy(*keys).agg((F.sum(F.col("cos") * F.col("_taken")) / F.sum("_taken")).alias(out))


def subsample(df: DataFrame, keys: list[str], order: list[str], cap: int) -> DataFrame:
    """At most ``cap`` rows a key, evenly spread over its order (positions rounded half to even), first and last included."""
    w = Window.partitionBy(*keys)
    i, n = F.row_number().over(w.orderBy(*order)) - 1, F.count("*").over(w)
    picks = F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda j: F.bround(j * (F.col("_n") - 1) / F.lit(float(max(1, cap - 1)))).cast("long"))
    return df.withColumn("_i", i).withColumn("_n", n).where((F.col("_n") <= cap) | F.array_contains(picks, F.col("_i").cast("long"))).drop("_i", "_n")


def split_views(vectors: np.ndarray, groups: int) -> list[np.ndarray]:
    """Vectors in ``groups`` equal parts along their main direction, found in 8 power steps from the first centred row.

    Fewer than twice as many vectors as groups, or vectors without a direction, stay whole.
    """
    if groups < 2 or len(vectors) < 2 * groups:
        return [vectors]
    centred = vectors - vectors.mean(0)
    direction = centred[0]
    for step in range(9):
        if step:
            direction = centred.T @ (centred @ direction)
        size = np.linalg.norm(direction)
        if size == 0:
            return [vectors]
        direction = direction / size
    return [vectors[part] for part in np.array_split(np.argsort(centred @ direction, kind="stable"), groups)]


def view_medoids(features: DataFrame, vector: str = "vec", groups: int = 2) -> DataFrame:
    """key, part and vec: the unit mean of each part of a key's vectors. A key's (capped) bank is split in one task."""

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        v = np.stack([np.asarray(x, float) for x in rows.sort_values("seq", kind="stable")[vector]])
        v = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-12)
        means = [p.mean(0) for p in split_views(v, groups)]
        return pd.DataFrame({"key": [rows["key"].iloc[0]] * len(means), "part": range(len(means)), "vec": [m / (np.linalg.norm(m) + 1e-12) for m in means]})

    kind = features.schema["key"].dataType.simpleString()
    return features.select("key", "seq", vector).groupBy("key").applyInPandas(split, f"key {kind}, part int, vec array<double>")


def view_medoid_scores(features: DataFrame, pairs: DataFrame, groups: int = 2, cap: int = 64) -> DataFrame:
    """left, right and score: the best cosine between parts' means of two (capped) banks, never below the prototypes' of the whole banks."""
    parts = view_medoids(subsample(features, ["key"], ["seq"], cap), "vec", groups)
    best = vector_pairs(parts, parts, pairs, [], "vec").groupBy("left", "right").agg(F.max("cos").alias("_best"))
    return best.join(prototype_pairs(features, pairs), ["left", "right"]).select("left", "right", F.greatest("_best", "prototype").alias("score"))


def diverse(features: DataFrame, keys: list[str], vector: str, score: str, n: int, share: float = 0.65) -> DataFrame:
    """``n`` rows a key, picked one by one for ``share`` of their score and the rest of their distance to those picked."""

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([score], ascending=False, kind="stable")
        v = np.stack([np.asarray(x, float) for x in rows[vector]])
        v = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-12)
        s, taken = rows[score].to_numpy(float), [0]
        near = v @ v[0]
        while len(taken) < min(n, len(v)):
            gain = share * s + (1 - share) * (1 - near)
            gain[taken] = -np.inf
            taken.append(int(gain.argmax()))
            near = np.maximum(near, v @ v[taken[-1]])
        return rows.iloc[taken]

    return features.groupBy(*keys).applyInPandas(pick, features.schema)


def reciprocal_jaccard(neighbours: DataFrame, k: int, pairs: DataFrame | None = None) -> DataFrame:
    """query, hit and jaccard of the k-reciprocal neighbourhoods, from (query, hit, rank).

    x is in the neighbourhood of q if each is among the other's ``k`` nearest; q is in its own.
    """
    near = neighbours.where(F.col("rank") <= k).select("query", "hit")
    back = near.select(F.col("hit").alias("_q"), F.col("query").alias("_h"))
    mutual = near.join(back, (F.col("query") == F.col("_q")) & (F.col("hit") == F.col("_h")), "left_semi")
    sets = mutual.groupBy("query").agg(F.array_sort(F.collect_list("hit")).alias("s"))
    every = neighbours.select("query").distinct().join(sets, "query", "left")
    every = every.select("query", F.array_union(F.array("query"), F.coalesce("s", F.array().cast(sets.schema["s"].dataType))).alias("s"))
    asked = near if pairs is None else pairs
    a, b = every.withColumnRenamed("s", "_sa"), every.select(F.col("query").alias("hit"), F.col("s").alias("_sb"))
    both = asked.join(a, "query").join(b, "hit")
    return both.select("query", "hit", (F.size(F.array_intersect("_sa", "_sb")) / F.size(F.array_union("_sa", "_sb"))).alias("jaccard"))
