"""What speaks for a pair or a track: supports, accepting rules, calibration, samples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.scores import first_reason
from tessera.functions.vectors import cosine, mean_vectors, topk_mean
from tessera.operators import blocks


@dataclass(frozen=True)
class Bars:
    """Bars of the accepting rules."""

    same_fused: float = 0.48
    same_agreement: float = 0.50
    same_continuity: float = 0.22
    cross_fused: float = 0.60
    cross_agreement: float = 0.48
    support: int = 2


def same_camera_reason(bars: Bars = Bars()) -> Column:
    """Why a pair of one camera is refused, or ``accepted``; from fused, agreement, continuity, model_support and gap."""
    return first_reason(
        ("overlap", F.col("gap") <= 0), ("support", F.col("model_support") < bars.support), ("agreement", F.col("agreement") < bars.same_agreement), ("continuity", F.col("continuity") < bars.same_continuity), ("fused", F.col("fused") < bars.same_fused), otherwise="accepted",
    )


def cross_camera_reason(bars: Bars = Bars()) -> Column:
    return first_reason(("support", F.col("model_support") < bars.support), ("agreement", F.col("agreement") < bars.cross_agreement), ("fused", F.col("fused") < bars.cross_fused), otherwise="accepted")


@dataclass(frozen=True)
class BodyBars:
    """Bars of the rules that accept an identity for a track by its body."""

    threshold: float = 0.60
    strong: float = 0.72
    margin: float = 0.035
    support: int = 2
    accumulated: float = 0.56
    accumulated_support: int = 3
    partial: float = 0.58
    partial_support: int = 2
    continuity: float = 0.35
    spatial: float = 0.35
    continuous_body: float = 0.48
    small_margin: float = 0.02
    face: float = 0.80
    face_strong: float = 0.90
    face_quality: float = 0.60
    face_body: float = 0.42


def accepted_by_body(bars: BodyBars = BodyBars(), faces: bool = False, guarded: bool = False) -> Column:
    """The first rule by which the best candidate is accepted, or ``pending``; from score, second, body, support, partial, temporal and spatial.

    Rules in order: a track lost a moment ago, a strong body, a body with support and margin, one accumulated over many
    looks, a partial one. ``faces`` adds a strong face first and a face with some body last (face, face_quality).
    ``guarded`` asks more of all but the second and third, and the full margin everywhere.
    """
    c, margin = F.col, F.col("score") - F.col("second")
    small = bars.margin if guarded else bars.small_margin
    recent = (c("temporal") >= bars.continuity) & (c("spatial") >= bars.spatial) & (c("body") >= (max(0.56, bars.accumulated) if guarded else bars.continuous_body))
    if guarded:
        recent = recent & (c("support") >= bars.support) & (margin >= bars.margin)
    rules = [
        ("recent_lost_track", recent),
        ("body_strong", (c("body") >= bars.strong) & ((margin >= bars.margin) | (c("support") >= bars.support))),
        ("body_gallery", (c("body") >= bars.threshold) & (c("support") >= bars.support) & (margin >= bars.margin)),
        ("body_accumulated", (c("body") >= bars.accumulated) & (c("support") >= bars.accumulated_support) & (margin >= small)),
        ("partial_body", c("partial") & (c("body") >= (max(0.60, bars.partial) if guarded else bars.partial)) & (c("support") >= bars.partial_support) & (margin >= small)),
    ]
    if faces:
        clear = c("face_quality") >= bars.face_quality
        rules = [("face_assisted", (c("face") >= bars.face_strong) & clear), *rules, ("face_body_assist", (c("face") >= bars.face) & clear & (c("body") >= bars.face_body) & (margin >= bars.small_margin))]
    return first_reason(*rules, otherwise="pending")


@dataclass(frozen=True)
class LiveBars:
    """Bars of the gates that a live match passes."""

    models: int = 2
    views: int = 2
    same_camera: float = 0.52
    across: float = 0.56
    strong: float = 0.76
    attributes: float = 0.46
    score: float = 0.62
    margin: float = 0.035
    clear: float = 0.74


def _seen_enough(bars: LiveBars) -> tuple[Column, Column]:
    """Whether views and attributes speak for a match, or deep evidence is so strong that they need not."""
    strong = F.col("deep") >= bars.strong
    return (F.col("view_support") >= bars.views) | strong, (F.col("attributes") >= bars.attributes) | strong


def live_reason(bars: LiveBars = LiveBars()) -> Column:
    """Why a live match is refused, or ``accepted``; from model_support, deep (mean of the two best models), view_support,
    attributes (their mean), score, second and same_camera."""
    views, attributes = _seen_enough(bars)
    least = F.when(F.col("same_camera"), bars.same_camera).otherwise(bars.across)
    return first_reason(
        ("models", F.col("model_support") < bars.models), ("deep", F.col("deep") < least), ("views", ~views), ("attributes", ~attributes), ("score", F.col("score") < bars.score),
        ("margin", (F.col("score") - F.col("second") < bars.margin) & (F.col("deep") < bars.clear)), otherwise="accepted",
    )


def still_own(bars: LiveBars = LiveBars()) -> Column:
    """Whether a track still looks like the identity it has: the gates but those of rank."""
    views, attributes = _seen_enough(bars)
    return (F.col("model_support") >= bars.models) & (F.col("deep") >= bars.same_camera) & views & attributes


def accepted_by_gallery(threshold: float, strong: float, support: int, margin: float) -> Column:
    """Whether the best identity is taken: enough score with support and margin, or a strong score alone."""
    c = F.col
    return (c("score") >= threshold) & (((c("support") >= support) & (c("score") - c("second") >= margin)) | (c("score") >= strong))


def complete_views(features: DataFrame, models: list[str], views: list[str]) -> DataFrame:
    """key and complete: whether a track has a vector of every model and view."""
    wanted = F.col("model").isin(models) & F.col("view").isin(views)
    kinds = F.count_distinct(F.when(wanted, F.struct("model", "view")))
    return features.groupBy("key").agg((kinds == len(models) * len(views)).alias("complete"))


def anchor_first(anchored: str, score: str, *keys: str) -> list[Column]:
    """An order: pairs with an anchor, then by score, then by keys, all falling."""
    return [F.desc(anchored), F.desc(score), *[F.desc(k) for k in keys]]


def measured_rate(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, n and fps: frames a second between a key's first and last time; null where these are one."""
    span = F.max(order) - F.min(order)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), ((F.count("*") - 1) / F.nullif(span, F.lit(0.0))).alias("fps"))


def merged_in_order(first: Column, second: Column) -> Column:
    """The elements of both arrays, each once, where it came first."""
    return F.array_distinct(F.concat(first, second))


def groups_of(tracklets: DataFrame, keys: list[str]) -> DataFrame:
    """keys, members, start, end, n, aspect (median) and state of groups of tracklets (key, start, end, n, aspect, state).

    A group of different states is ``mixed``; shapes that are not positive do not count. Places come from the tracklets
    that start first and last: x_start and y_start, x_end and y_end.
    """
    state = F.when(F.count_distinct("state") == 1, F.max("state")).otherwise("mixed")
    order = F.struct("start", "key")
    return tracklets.groupBy(*keys).agg(
        F.array_sort(F.collect_list("key")).alias("members"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"), F.median(F.when(F.col("aspect") > 0, F.col("aspect"))).alias("aspect"), state.alias("state"),
        F.min_by("x_start", order).alias("x_start"), F.min_by("y_start", order).alias("y_start"), F.max_by("x_end", order).alias("x_end"), F.max_by("y_end", order).alias("y_end"),
    )


def visible_share(confidences: Column, least: float) -> Column:
    """Share of keypoints seen with ``least`` confidence; null without keypoints."""
    return F.when(F.size(confidences) > 0, F.size(F.filter(confidences, lambda c: c >= least)) / F.size(confidences))


def mutual_models(scores: DataFrame) -> DataFrame:
    """left, right and n_models: by how many models (left, right, model, score) each is the other's best."""
    best = scores
    for side, tie in (("left", "right"), ("right", "left")):
        best = best.withColumn(f"_{side}", F.row_number().over(Window.partitionBy("model", side).orderBy(F.desc("score"), tie)))
    return best.groupBy("left", "right").agg(F.count_if((F.col("_left") == 1) & (F.col("_right") == 1)).alias("n_models"))


def bank_scores(queries: DataFrame, bank: DataFrame) -> DataFrame:
    """query, gid and score: the better of the bank's mean and its best exemplar. Both have vec; pairs share ``block``.

    ``block`` says which identities a query may be compared with; it keeps pairs to those.
    """
    means = mean_vectors(bank, ["block", "gid"], "vec", "mean")
    q = queries.select("query", "block", F.col("vec").alias("_q"))
    by_mean = q.join(means, "block").select("query", "gid", cosine(F.col("_q"), F.col("mean")).alias("s"))
    asks = queries.select(F.col("block").alias("key"), F.col("query").alias("row"), "vec")
    by_best = blocks.best_by_class(asks, bank.select(F.col("block").alias("key"), F.col("gid").alias("class"), "vec")).select(F.col("row").alias("query"), F.col("class").alias("gid"), F.col("cos").alias("s"))
    return by_mean.unionByName(by_best).groupBy("query", "gid").agg(F.max("s").alias("score"))


def observation_support(cosines: DataFrame, low: float, stable: float) -> DataFrame:
    """query, gid, n_low and n_stable: features (feature, cos) whose best cosine reaches either bar."""
    best = cosines.groupBy("query", "gid", "feature").agg(F.max("cos").alias("_c"))
    return best.groupBy("query", "gid").agg(F.count_if(F.col("_c") >= low).alias("n_low"), F.count_if(F.col("_c") >= stable).alias("n_stable"))


def support_by_kind(features: DataFrame, bank: DataFrame, low: float, stable: float) -> DataFrame:
    """query, gid, n_low and n_stable of ``features`` (query, gid, feature, kind, vec) against the ``bank`` (gid, kind, vec) of the identity asked for.

    A feature is held against the bank's vectors of its kind, or against all of them where the bank has none of that kind.
    """
    asks = features.select(F.col("gid").alias("key"), F.struct("query", "feature", "kind").alias("row"), "vec")
    best = blocks.best_by_class(asks, bank.select(F.col("gid").alias("key"), F.col("kind").alias("class"), "vec"))
    best = best.groupBy(F.col("row.query").alias("query"), F.col("key").alias("gid"), F.col("row.feature").alias("feature")).agg(F.max(F.when(F.col("row.kind") == F.col("class"), F.col("cos"))).alias("_own"), F.max("cos").alias("_any"))
    best = best.withColumn("_c", F.coalesce("_own", "_any"))
    counts = best.groupBy("query", "gid").agg(F.count_if(F.col("_c") >= low).alias("n_low"), F.count_if(F.col("_c") >= stable).alias("n_stable"))
    asked = features.join(bank.select("gid"), "gid", "left_semi").select("query", "gid").distinct()
    return asked.join(counts, ["query", "gid"], "left").na.fill(0, ["n_low", "n_stable"])


def histogram(df: DataFrame, keys: list[str], value: Column, bins: int, low: float, high: float, weight: Column | None = None) -> DataFrame:
    """keys, bin and weight: the sum of ``weight`` (1 each) of values by equal bins of [low, high]; the top end falls in the last bin, what is outside in none."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    place = F.least(F.floor((value - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    return df.where(value.between(low, high)).groupBy(*keys, place.alias("bin")).agg(F.sum(w).alias("weight"))


def attribute_blocks(vector: Column, sizes: dict[str, int]) -> dict[str, Column]:
    """Named slices of a packed vector, one after another."""
    out, at = {}, 1
    for name, size in sizes.items():
        out[name] = F.slice(vector, at, size)
        at += size
    return out


def block_similarity(left: Column, right: Column, k: int = 3) -> Column:
    """Mean of the ``k`` best cosines between two arrays of vectors; neutral if either is empty."""
    pairs = F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: cosine(a, b))))
    return F.when((F.size(left) > 0) & (F.size(right) > 0), topk_mean(pairs, k)).otherwise(0.5)


def track_ends(boxes: DataFrame, keys: list[str], at: str) -> DataFrame:
    """First and last centre and the last height of a track's boxes (x1, y1, x2, y2)."""
    x, y = (F.col("x1") + F.col("x2")) / 2.0, (F.col("y1") + F.col("y2")) / 2.0
    return boxes.groupBy(*keys).agg(F.min_by(x, at).alias("x_first"), F.min_by(y, at).alias("y_first"), F.max_by(x, at).alias("x_last"), F.max_by(y, at).alias("y_last"), F.max_by(F.col("y2") - F.col("y1"), at).alias("height_last"))


def calibrated(rows: DataFrame, camera: DataFrame, group: DataFrame, value: str) -> DataFrame:
    """Adds ``value`` of the row's camera, or else of its group, or else null; both tables have one row a key."""
    a = camera.select("camera", F.col(value).alias("_own"))
    b = group.select("floor_group", F.col(value).alias("_group"))
    return rows.join(a, "camera", "left").join(b, "floor_group", "left").withColumn(value, F.coalesce("_own", "_group")).drop("_own", "_group")


def split_merged(boxes: DataFrame, bodies: str) -> DataFrame:
    """A box that holds two or more bodies (an array of boxes) becomes one row for each, with track ids of their own."""
    many = F.size(bodies) >= 2
    parts = boxes.withColumn("_b", F.when(many, F.transform(bodies, lambda b, i: F.struct((i + 1).alias("i"), b.alias("box")))).otherwise(F.array(F.struct(F.lit(0).alias("i"), F.lit(None).cast(boxes.schema[bodies].dataType.elementType).alias("box")))))
    return parts.withColumn("_p", F.explode("_b")).withColumn("track_id", F.col("track_id") + 100000 * F.col("_p.i")).withColumn("body", F.col("_p.box")).drop("_b", "_p")


def capped_sample(df: DataFrame, key: str, order: list[str], per_key: int, keys: int) -> DataFrame:
    """Up to ``per_key`` rows of the first ``keys`` keys: a report's sample."""
    some = df.select(key).distinct().orderBy(key).limit(keys)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.join(some, key, "left_semi").withColumn("_n", rank).where(F.col("_n") <= per_key).drop("_n")


def every_nth(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Each key's first row and every ``n``-th after it."""
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("_i", i).where(F.col("_i") % n == 0).drop("_i")


def latest_state(points: DataFrame, gid: Column) -> DataFrame:
    """gid, run_id and frame last seen: of newer runs first, then of later frames."""
    return points.where(gid.isNotNull()).groupBy(gid.alias("gid")).agg(F.max(F.struct("run_id", "frame", "camera")).alias("_m")).select("gid", "_m.run_id", "_m.frame", "_m.camera")


def anchor_check(samples: DataFrame, keys: list[str], at: str, clean: str, vector: str, n: int = 4) -> DataFrame:
    """For rows after an overlap: their best cosine with the last ``n`` clean rows before it. ``clean`` marks rows outside overlaps."""
    w = Window.partitionBy(*keys).orderBy(at)
    marked = samples.withColumn("_was", F.lag(clean).over(w)).where(F.col(clean))
    marked = marked.withColumn("_bank", F.collect_list(vector).over(w.rowsBetween(-n, -1)))
    back = marked.where(~F.col("_was"))
    return back.withColumn("anchor", F.array_max(F.transform("_bank", lambda b: cosine(b, F.col(vector))))).drop("_bank", "_was")
