"""The whole way from tracklets to identities: groups, evidence, stitching in a camera, matching across, ids."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scores
from tessera.functions.vectors import clip, cosine, mean_vectors, unit
from tessera.operators import edges as pairs_of
from tessera.operators import evidence, identity, intervals, scoring, sessions
from tessera.operators.cluster import constrained_components, cut, greedy_matching

MODELS = ("resnet", "swin", "solider")
#: Parts of the fused score within and across cameras.
SAME_CAMERA = scoring.Weights(0.78, 0.0, 0.12, 0.0, 0.0, 0.10)
CROSS_CAMERA = scoring.Weights(0.70, 0.12, 0.10, 0.05, 0.03, 0.0)
GROUP = ["key", "camera", "members", "start", "end", "n", "aspect", "state", "x_start", "y_start", "x_end", "y_end", "h_end"]


@dataclass(frozen=True)
class Settings:
    """Bars of a run. ``offsets`` brings cameras' clocks together, in seconds."""

    same_fused: float = 0.48
    cross_fused: float = 0.50
    partial_fused: float = 0.47
    same_agreement: float = 0.48
    same_continuity: float = 0.22
    same_strongest: float = 0.72
    same_colour: float = 0.72
    most_gap: float = 30.0
    strong: float = 0.80
    second: float = 0.46
    cross_colour: float = 0.65
    bank: int = 64
    models: dict[str, float] = field(default_factory=lambda: dict(scoring.MODEL_BARS))
    offsets: dict[str, float] = field(default_factory=dict)


def evidence_of(groups: DataFrame, features: DataFrame, colours: DataFrame, pairs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``pairs`` (left, right) with a column for each model, fused, agreement, model_support, mutual_models, view_support,
    transition, colour, geometry, temporal and continuity.

    ``groups`` has the columns of GROUP, ``features`` key, model, view and vec, ``colours`` key and vec. A model without
    vectors on either side scores 0; a missing colour or place is neutral. The left group of a camera's pair comes first.
    """
    by_model = cut(scoring.view_scores(features, pairs), "model-scores")
    wide = by_model.groupBy("left", "right").agg(
        *[F.max(F.when(F.col("model") == m, F.col("score"))).alias(m) for m in settings.models], F.max(F.when(F.col("model") == "swin", F.col("support"))).alias("view_support"), F.max(F.when(F.col("model") == "swin", F.col("transition"))).alias("_turned"),
    )
    mutual = evidence.mutual_models(by_model.where(_least(settings)).select("left", "right", "model", "score"))
    side = lambda s: groups.select(F.col("key").alias("left" if s == "a" else "right"), *[F.col(c).alias(f"{c}_{s}") for c in ("camera", "start", "end", "state", "x_start", "y_start", "x_end", "y_end", "h_end")])
    tint = lambda s: colours.select(F.col("key").alias("left" if s == "a" else "right"), F.col("vec").alias(f"tint_{s}"))
    out = pairs.select("left", "right").distinct().join(wide, ["left", "right"], "left").join(mutual.withColumnRenamed("n_models", "mutual_models"), ["left", "right"], "left")
    out = out.join(side("a"), "left").join(side("b"), "right").join(tint("a"), "left", "left").join(tint("b"), "right", "left")
    out = out.na.fill(0.0, list(settings.models)).na.fill(0, ["mutual_models", "view_support"])

    same = F.col("camera_a") == F.col("camera_b")
    at = lambda c: scores.shifted(F.col(c), F.col(f"camera_{c[-1]}"), settings.offsets)
    colour = scores.colour(cosine(F.col("tint_a"), F.col("tint_b")))
    near = scores.nearness(*[F.col(c) for c in ("x_end_a", "y_end_a", "x_start_b", "y_start_b")], F.greatest(F.col("h_end_a"), F.lit(1.0)))
    temporal = scores.temporal(at("start_a"), at("end_a"), at("start_b"), at("end_b"))
    gap = F.least(F.abs(F.col("start_b") - F.col("end_a")), F.abs(F.col("start_a") - F.col("end_b")))
    meets = scores.overlaps_closed(F.col("start_a"), F.col("end_a"), F.col("start_b"), F.col("end_b"))
    going_on = F.when(meets, 0.0).otherwise(0.65 * F.greatest(F.lit(0.0), 1.0 - gap / 30.0) + 0.35 * near)
    known = lambda c: ~F.col(c).isin("unknown", "mixed")
    turned = F.coalesce("_turned", F.lit(False)) | (known("state_a") & known("state_b") & (F.col("state_a") != F.col("state_b")))
    out = out.select(
        "left", "right", "camera_a", "camera_b", *settings.models, "mutual_models", "view_support", colour.alias("colour"), near.alias("geometry"), temporal.alias("temporal"), F.when(same, going_on).otherwise(0.5).alias("continuity"), turned.alias("transition"), same.alias("same"),
    )
    parts = scoring.fused(settings.models, F.col("same"), *[F.col(c) for c in ("colour", "temporal", "geometry", "continuity")], within=SAME_CAMERA, across=CROSS_CAMERA)
    return out.withColumns(parts)


def _least(settings: Settings) -> Column:
    """Scores that reach their model's bar."""
    bar = F.create_map(*[F.lit(x) for item in settings.models.items() for x in item])
    return F.col("score") >= bar[F.col("model")]


def _strongest(settings: Settings) -> Column:
    return F.reverse(F.array_sort(F.array(*settings.models)))


def same_accepted(settings: Settings) -> Column:
    """Whether a pair of one camera is one: enough of all, and two models that agree or one strong model and colour."""
    bar = F.when(F.col("transition"), settings.partial_fused).otherwise(settings.same_fused)
    agreed = (F.col("model_support") >= 2) & (F.col("agreement") >= settings.same_agreement)
    alone = (_strongest(settings)[0] >= settings.same_strongest) & (F.col("colour") >= settings.same_colour)
    return (F.col("fused") >= bar) & (F.col("continuity") >= settings.same_continuity) & (agreed | alone)


def cross_accepted(settings: Settings) -> Column:
    """Whether a pair across cameras may match: two models, or a strong one with some of a second and colour."""
    bar = F.when(F.col("transition"), settings.partial_fused).otherwise(settings.cross_fused)
    alone = (_strongest(settings)[0] >= settings.strong) & (_strongest(settings)[1] >= settings.second) & (F.col("colour") >= settings.cross_colour)
    return (F.col("fused") >= bar) & ((F.col("model_support") >= 2) | alone)


def stitched_groups(tracklets: DataFrame, features: DataFrame, colours: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(groups, their features, their colours, edges): tracklets of a camera of which one goes on from the other, put together.

    Each tracklet joins one other at most, the best pairs first. A group keeps its last ``bank`` vectors of a model and view.
    """
    following = intervals.successors(tracklets.select("key", "camera", "start", "end"), ["camera"], "start", "end", settings.most_gap)
    pairs = cut(following.select(F.col("key_a").alias("left"), F.col("key_b").alias("right")), "resolver-successors")
    edges = cut(evidence_of(tracklets, features, colours, pairs, settings).where(same_accepted(settings)), "resolver-same")
    taken = greedy_matching(edges.withColumn("_lane", F.col("camera_a")), ["_lane"], "fused", apart=False).drop("_lane")
    group = taken.select(F.col("right").alias("key"), F.col("left").alias("group"))
    of = cut(tracklets.select("key").join(group, "key", "left").select("key", F.coalesce("group", "key").alias("group")), "resolver-groups")
    whole = tracklets.join(of, "key")
    first = F.struct("start", "key")
    heights = whole.groupBy("group").agg(F.max_by("h_end", first).alias("h_end"))
    groups = evidence.groups_of(whole, ["group", "camera"]).join(heights, "group").withColumnRenamed("group", "key")
    order = features.join(of, "key").join(tracklets.select("key", "start"), "key")
    bank = sessions.keep_last(order, ["group", "model", "view"], [F.desc("start"), F.desc("key"), F.desc("seq")], settings.bank)
    tints = mean_vectors(colours.join(of, "key"), ["group"], "vec", "vec", normalise=True)
    return groups.select(*GROUP), bank.select(F.col("group").alias("key"), "model", "view", "seq", "vec"), tints.withColumnRenamed("group", "key"), taken


def candidates(groups: DataFrame, features: DataFrame, settings: Settings) -> DataFrame:
    """(left, right): groups of different cameras with vectors of one model that are as near as its bar asks, all of them.

    A model's score is a mean of cosines, so a pair that it supports has such vectors; a pair without any is never
    accepted, and none is made.
    """
    named = features.join(groups.select("key", "camera"), "key").withColumn("id", F.concat_ws("|", "key", "view", F.col("seq").cast("string")))
    named = cut(named, "resolver-vectors")
    found: DataFrame | None = None
    for model, bar in settings.models.items():
        own = named.where(F.col("model") == model)
        near = pairs_of.over(own, own, "id", "vec", bar, "camera")
        near = near.join(own.select(F.col("id").alias("query"), F.col("key").alias("left"), F.col("camera").alias("ca")), "query").join(own.select(F.col("id").alias("hit"), F.col("key").alias("right"), F.col("camera").alias("cb")), "hit")
        near = near.where("ca < cb").select("left", "right").distinct()
        found = near if found is None else found.unionByName(near)
    return cut(found.distinct(), "resolver-candidates")


def resolve(tracklets: DataFrame, features: DataFrame, colours: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(identities, edges within cameras, edges across): key, camera, group and gid of every tracklet.

    ``tracklets`` has the columns of GROUP but members, ``features`` key, model, view, seq and vec, ``colours`` key and vec.
    In a camera, tracklets that go on from one another are stitched. Across cameras each group takes one partner of
    another camera at most, the best pairs first, and an identity never holds two groups of a camera. Identities are
    numbered in the order of their first start.
    """
    groups, bank, tints, within = stitched_groups(tracklets, features, colours, settings)
    groups, bank, tints = cut(groups, "resolver-stitched"), cut(bank, "resolver-bank"), cut(tints, "resolver-colours")
    scored = evidence_of(groups, bank, tints, candidates(groups, bank, settings), settings)
    good = cut(scored.where(cross_accepted(settings)), "resolver-cross")
    across = cut(greedy_matching(good, ["camera_a", "camera_b"], "fused"), "resolver-across")
    parts = cut(constrained_components(across.select("left", "right", F.col("fused").alias("score")), groups.select("key", "camera", "start", "end"), "camera"), "resolver-components")
    named = parts.join(groups.select("key", "camera", "start", "members"), "key")
    first = named.groupBy("component").agg(F.min(F.struct("start", "key")).alias("at"))
    ids = identity.numbered(named, first)
    return ids.select(F.explode("members").alias("member"), "camera", F.col("key").alias("group"), "gid").withColumnRenamed("member", "key"), within, across
