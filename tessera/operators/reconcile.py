"""Two-phase reconciliation of tracklets into identities: within cameras, then across, in rounds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.vectors import mean_vectors
from tessera.operators.cluster import constrained_components, cut
from tessera.operators.edges import hashed_search, mutual_best, over

ALL = (1 << 31) - 1


@dataclass(frozen=True)
class Settings:
    """Bars of a run; ``same_camera`` may be overridden by camera, and the strictest of a pair's cameras holds.

    ``hashed`` looks for neighbours by hashes (measured recall, not all): for more groups than all-pairs search can take.
    """

    least_observations: int = 3
    same_camera: float = 0.75
    cross_camera: float = 0.65
    waiver: float = 0.90
    hashed: bool = False
    per_camera: tuple[tuple[str, float], ...] = ()

    def __post_init__(self) -> None:
        scores = [self.same_camera, self.cross_camera, self.waiver, *(b for _, b in self.per_camera)]
        if not all(-1.0 <= x <= 1.0 for x in scores):
            raise ValueError("bars are cosines: -1 to 1")
        if self.waiver < max(self.same_camera, self.cross_camera):
            raise ValueError("the waiver must not be below the bars that it waives the choice for")
        if self.least_observations < 1:
            raise ValueError("a tracklet has one observation at least")
        if len({c for c, _ in self.per_camera}) < len(self.per_camera):
            raise ValueError("a camera has one bar")


def tracklets(observations: DataFrame, least: int) -> DataFrame:
    """key, camera, start, end, n and vec (unit mean) of tracklets with ``least`` observations; of others no row."""
    spans = observations.groupBy("key", "camera").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n")).where(F.col("n") >= least)
    return spans.join(mean_vectors(observations, ["key"], "vec", "vec"), "key")


def bars(nodes: DataFrame, settings: Settings) -> DataFrame:
    """camera and bar."""
    rows = nodes.sparkSession.createDataFrame(list(settings.per_camera) or [("", 0.0)], "camera string, bar double")
    return nodes.select("camera").distinct().join(F.broadcast(rows), "camera", "left").select("camera", F.coalesce("bar", F.lit(settings.same_camera)).alias("bar"))


def _round(nodes: DataFrame, members: DataFrame, same: bool, settings: Settings, had: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(left, right, score): edges between the groups of ``members`` (key, component) that pass veto, bar and choice, of all pairs; and the pairs.

    ``had`` is the pairs of the round before and the groups (component) that grew or went since: only those are compared anew.
    """
    groups = nodes.join(members, "key")
    means = mean_vectors(groups, ["component"], "vec", "vec", weight=F.col("n"))
    cameras = groups.groupBy("component").agg(F.min("camera").alias("camera"), F.count_distinct("camera").alias("n_cameras"))
    # Groups of one and the same camera have one side, and any other group a side of its own.
    side = F.when(F.col("n_cameras") == 1, F.concat(F.lit("1:"), "camera")).otherwise(F.concat(F.lit("2:"), F.col("component").cast("string")))
    table = cut(means.join(cameras, "component").select("component", "vec", side.alias("side")), "reconcile-groups")
    spans = cut(groups.join(F.broadcast(bars(nodes, settings)), "camera", "left").select("component", "camera", "start", "end", "bar"), "reconcile-spans")
    least = min([settings.same_camera, settings.cross_camera, *(b for _, b in settings.per_camera)])
    asked = table if had is None else table.join(had[1], "component", "left_semi")
    if settings.hashed:
        sides = lambda name: table.select(F.col("component").alias(name), F.col("side").alias(f"_{name}"))
        near = hashed_search(asked, table, "component", "vec", ALL).join(sides("query"), "query").join(sides("hit"), "hit")
        near = near.where((F.col("_query") == F.col("_hit")) == F.lit(same))
    else:
        near = over(asked, table, "component", "vec", least, "side", same)
    near = near.select(F.col("query").alias("left"), F.col("hit").alias("right"), "score").where(F.col("score") >= least)
    if had is not None:
        near = cut(near, "reconcile-near")
        without = lambda df, end: df.join(had[1].select(F.col("component").alias(end)), end, "left_anti").select("left", "right", "score")
        back = without(near, "right").select(F.col("right").alias("left"), F.col("left").alias("right"), "score")
        near = without(without(had[0], "left"), "right").unionByName(near).unionByName(back)
    pairs = every = cut(near, "reconcile-pairs")
    # What a pair has in common: the strictest bar of its cameras, and whether both were seen by one at one time.
    x = spans.select(F.col("component").alias("left"), "camera", F.col("start").alias("sa"), F.col("end").alias("ea"), "bar")
    y = spans.select(F.col("component").alias("right"), "camera", F.col("start").alias("sb"), F.col("end").alias("eb"))
    meets = (F.col("sa") <= F.col("eb")) & (F.col("sb") <= F.col("ea"))
    common = pairs.select("left", "right").join(x, "left").join(y, ["right", "camera"]).groupBy("left", "right").agg(F.max("bar").alias("bar"), F.max(meets).alias("meets"))
    pairs = pairs.join(common, ["left", "right"], "left").where(~F.coalesce("meets", F.lit(False)) & (F.col("score") >= F.coalesce("bar", F.lit(settings.cross_camera))))
    pairs = pairs.select("left", "right", "score")
    chosen = mutual_best(pairs).unionByName(pairs.where(F.col("score") >= settings.waiver))
    return chosen.select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"), "score").distinct(), every


def reconcile(observations: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """key, camera, component: the identity of every tracklet of ``observations`` (key, camera, ts, vec).

    Groups that look alike join if no two members would be in one camera at one time and, of all such pairs, each is the
    other's best (or the score is beyond doubt). Groups that share a camera need its bar. Within cameras first, then
    across, each until nothing grows. Edges between groups stand for their members; the veto is taken over all of them.
    All groups are compared once in either phase; a round after that compares those that grew.
    """
    nodes = cut(tracklets(observations, settings.least_observations), "reconcile-tracklets")
    members = nodes.select("key", F.col("key").alias("component"))
    for same in (True, False):
        had = None
        while True:
            edges, pairs = _round(nodes, members, same, settings, had)
            edges = cut(edges, "reconcile-edges")
            if not edges.head(1):
                break
            members, grown = _joined(nodes, members, edges, settings)
            if not grown.head(1):
                break
            had = pairs, grown
    return nodes.select("key", "camera").join(members, "key")


def _joined(nodes: DataFrame, members: DataFrame, edges: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Members after the edges are folded in; and the names (component) of groups that grew or are part of others now.

    Links inside a group come first (score 2), so the fold sees whole groups.
    """
    inside = members.where("key <> component").select(F.col("component").alias("left"), F.col("key").alias("right"), F.lit(2.0).alias("score"))
    new = constrained_components(inside.unionByName(edges.select("left", "right", F.col("score").cast("double"))), nodes.join(F.broadcast(bars(nodes, settings)), "camera", "left").select("key", "camera", "start", "end", "bar"))
    new = cut(new, "reconcile-members")
    moved = new.join(members.select("key", F.col("component").alias("_was")), "key").where("component <> _was")
    return new, cut(moved.select(F.explode(F.array("component", "_was")).alias("component")).distinct(), "reconcile-grown")



@dataclass(frozen=True)
class Choice:
    """Bars of a single pass over pairs: a pair joins if it is each side's best by ``margin``, or ``strong``."""

    threshold: float = 0.62
    strong: float = 0.80
    margin: float = 0.03


def chosen(pairs: DataFrame, choice: Choice = Choice()) -> DataFrame:
    """The pairs (left, right, score; each once) that may join, with both margins and whether each is the other's best.

    Ranks and margins are over all pairs of a key, on either side; the margin of one without a second is its score.
    """
    both = pairs.select(F.col("left").alias("a"), F.col("right").alias("b"), "score").unionByName(pairs.select(F.col("right").alias("a"), F.col("left").alias("b"), "score"))
    order = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    ranked = both.withColumn("_n", F.row_number().over(order)).withColumn("_next", F.coalesce(F.lead("score").over(order), F.lit(0.0)))
    best = ranked.where("_n = 1").select("a", "b", (F.col("score") - F.col("_next")).alias("margin"))
    side = lambda a, b, m: best.select(F.col("a").alias(a), F.col("b").alias(b), F.col("margin").alias(m))
    out = pairs.join(side("left", "right", "margin_left"), ["left", "right"], "left").join(side("right", "left", "margin_right"), ["left", "right"], "left")
    out = out.withColumn("reciprocal", F.col("margin_left").isNotNull() & F.col("margin_right").isNotNull())
    clear = F.col("reciprocal") & (F.least("margin_left", "margin_right") >= choice.margin)
    return out.na.fill(0.0, ["margin_left", "margin_right"]).where((F.col("score") >= choice.threshold) & (clear | (F.col("score") >= choice.strong)))


def one_pass(scored: DataFrame, nodes: DataFrame, choice: Choice = Choice()) -> DataFrame:
    """(key, component): chosen pairs joined by falling score, unless members of one camera would overlap in time."""
    picked = cut(chosen(cut(scored.select("left", "right", "score"), "one-pass-scored"), choice).select("left", "right", "score"), "one-pass-chosen")
    return constrained_components(picked, nodes, "overlap")
