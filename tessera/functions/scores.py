"""Evidence between two tracklets or groups as column functions. Missing evidence is neutral: one half."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.vectors import clip

NEUTRAL = 0.5


def neutral(x: Column) -> Column:
    return F.coalesce(x, F.lit(NEUTRAL))


def overlap_seconds(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Seconds that two spans share; negative: the gap between them."""
    return F.least(a1, b1) - F.greatest(a0, b0)


def overlaps_closed(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Whether two closed spans meet; touching ends do."""
    return ~((a1 < b0) | (b1 < a0))


def overlaps_open(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (a0 < b1) & (b0 < a1)


def temporal(a0: Column, a1: Column, b0: Column, b1: Column, horizon: float = 30.0, at_overlap: float = NEUTRAL) -> Column:
    """1 for no gap down to 0 at ``horizon`` seconds; ``at_overlap`` where the spans overlap."""
    gap = -overlap_seconds(a0, a1, b0, b1)
    return F.when(overlaps_closed(a0, a1, b0, b1), F.lit(at_overlap)).otherwise(F.greatest(F.lit(0.0), 1.0 - gap / horizon))


def shifted(ts: Column, camera: Column, offsets: dict[str, float]) -> Column:
    """``ts`` on a common clock: with its camera's offset in seconds, 0 where none is known."""
    pairs = [F.lit(x) for item in offsets.items() for x in item]
    return ts + F.coalesce(F.create_map(*pairs)[camera], F.lit(0.0)) if pairs else ts


def nearness(x0: Column, y0: Column, x1: Column, y1: Column, height: Column, heights: float = 8.0) -> Column:
    """1 at the same place down to 0 at ``heights`` heights away; neutral without a place."""
    return neutral(clip(1.0 - F.hypot(x1 - x0, y1 - y0) / F.nullif(height, F.lit(0.0)) / heights, 0.0, 1.0))


def continuity(same_camera: Column, gap: Column, limit: float, near: Column) -> Column:
    """.55 of closeness in time and .45 of closeness in space; 0 across cameras, in overlap or past ``limit``."""
    good = same_camera & (gap >= 0) & (gap <= limit)
    return F.when(good, 0.55 * (1.0 - gap / limit) + 0.45 * near).otherwise(0.0)


def shape_similarity(a: Column, b: Column, scale: float = 0.45) -> Column:
    """exp(-|ln(a / b)| / scale); neutral where a shape is missing or not positive."""
    good = (a > 0) & (b > 0)
    return neutral(F.when(good, F.exp(-F.abs(F.ln(a / b)) / scale)))


def box_shape(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Height over width of a box, sides of 1 at least; ``F.median`` over boxes is a track's shape."""
    one = F.lit(1.0)
    return F.greatest(one, (y2 - y1).cast("double")) / F.greatest(one, (x2 - x1).cast("double"))


def box_geometry(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """Six figures of a box in a frame: centre, foot, width, height and area as shares, and the logarithm of its shape."""
    w, h = F.greatest(x2 - x1, F.lit(1.0)), F.greatest(y2 - y1, F.lit(1.0))
    fw, fh = F.greatest(width, F.lit(1.0)), F.greatest(height, F.lit(1.0))
    return F.array(0.5 * (x1 + x2) / fw, y2 / fh, w / fw, h / fh, w * h / (fw * fh), F.ln(h / w))


#: How far apart the six figures may be.
GEOMETRY_SCALE = (0.25, 0.30, 0.18, 0.30, 0.18, 1.0)


def geometry_score(a: Column, b: Column) -> Column:
    """1 for equal ``box_geometry`` down to 0 at a scaled distance of 3."""
    far = F.aggregate(F.zip_with(F.zip_with(a, b, lambda x, y: x - y), F.array(*[F.lit(x) for x in GEOMETRY_SCALE]), lambda d, s: (d / s) * (d / s)), F.lit(0.0), lambda t, x: t + x)
    return clip(1.0 - F.sqrt(far) / 3.0, 0.0, 1.0)


def sample_interval(interval: Column, part: Column, default: int = 5) -> tuple[Column, Column]:
    """Frames between samples and between samples of parts: 1 at least, and parts no more often than the whole."""
    every = F.greatest(F.lit(1), F.coalesce(interval, F.lit(default)).cast("int"))
    return every, F.greatest(every, F.coalesce(part.cast("int"), every))


def colour(similarity: Column) -> Column:
    return neutral(clip(similarity, 0.0, 1.0))


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def verifier(cos: Column, rerank: Column, n: Column, seconds: Column, quality: Column) -> Column:
    """Logistic probability that two views are of one entity. The weights."""
    return sigmoid(-13.5 + 11.0 * cos + 7.0 * rerank + 0.6 * F.log1p(n) - 0.01 * seconds + 1.0 * neutral(quality))


def box_quality(blur: Column, brightness: Column, rejected: Column) -> Column:
    """Sharpness times exposure, 0 to 1; 0 if rejected, neutral without measurements."""
    q = F.least(F.lit(1.0), blur / 60.0) * F.greatest(F.lit(0.0), 1.0 - F.abs(brightness - 127.5) / 127.5)
    return F.when(F.coalesce(rejected, F.lit(False)), F.lit(0.0)).otherwise(neutral(q))


def evidence(mean_quality: Column, n: Column, span: Column) -> Column:
    """How much a tracklet shows: its quality, its count up to 12 and its seconds up to 8."""
    return 0.75 * mean_quality + 0.15 * F.least(F.lit(1.0), n / 12.0) + 0.10 * F.least(F.lit(1.0), span / 8.0)


def posture(aspect: Column) -> Column:
    return F.when(aspect.isNull(), "unknown").when(aspect >= 1.35, "upright").otherwise("compact")


def score_bucket(score: Column, buckets: int = 6) -> Column:
    """0 to ``buckets`` - 1 over [0, 1], the ends included."""
    return clip(F.floor(score * buckets), 0, buckets - 1).cast("int")


def first_reason(*rules: tuple[str, Column], otherwise: str) -> Column:
    """The name of the first rule that holds: an ordered list of gates."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, holds in rules:
        out = out.when(F.coalesce(holds, F.lit(False)), F.lit(name))
    return out.otherwise(F.lit(otherwise))


@dataclass(frozen=True)
class CropGate:
    """What a crop must have; None in place of ``blur`` or the brightness bounds leaves these out."""

    width: float = 24
    height: float = 64
    area: float = 2500
    share_of_frame: float = 0.002
    aspect: tuple[float, float] = (0.20, 1.20)
    blur: float | None = 20.0
    brightness: tuple[float, float] | None = (20.0, 235.0)


def crop_reason(width: Column, height: Column, frame_area: Column, blur: Column, brightness: Column, gate: CropGate = CropGate()) -> Column:
    """``ok``, or the first of seven ordered reasons why a crop is refused; a measure that is missing refuses nothing."""
    area, aspect = width * height, width / F.nullif(height, F.lit(0))
    rules = [
        ("too_narrow", width < gate.width),
        ("too_short", height < gate.height),
        ("too_small", area < gate.area),
        ("too_tiny_in_frame", area / F.nullif(frame_area, F.lit(0)) < gate.share_of_frame),
        ("bad_aspect", ~aspect.between(*gate.aspect)),
    ]
    rules += [("blurry", blur < gate.blur)] if gate.blur is not None else []
    rules += [("bad_brightness", ~brightness.between(*gate.brightness))] if gate.brightness is not None else []
    return first_reason(*rules, otherwise="ok")


def gid(number: Column, prefix: str = "G", width: int = 6) -> Column:
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))


def tracklet_key(camera: Column, track: Column, segment: Column) -> Column:
    return F.concat_ws(":", camera.cast("string"), track.cast("string"), segment.cast("string"))


def parts_of_key(key: Column) -> tuple[Column, Column, Column]:
    """Camera, track and segment of a ``tracklet_key``; the camera may hold colons itself."""
    parts = F.split(key, ":")
    n = F.size(parts)
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 2, F.lit(0))), ":"), F.get(parts, n - 2).cast("long"), F.get(parts, n - 1).cast("int")


def bare_camera(camera: Column, prefix: str = "cam_") -> Column:
    return F.when(camera.startswith(prefix), F.substring(camera, len(prefix) + 1, 1 << 20)).otherwise(camera)


def path_stem(path: Column) -> Column:
    """The last part of a path without its last ending."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)/*$", 1), r"(?<=.)\.[^.]*$", "")


def run_id(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd_HHmmss")
