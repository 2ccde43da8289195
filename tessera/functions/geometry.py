"""Boxes, floor positions and speeds as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.greatest(x2 - x1, F.lit(0)) * F.greatest(y2 - y1, F.lit(0))


def intersection(a: list[Column], b: list[Column]) -> Column:
    return _area(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3]))


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of boxes (x1, y1, x2, y2); 0 for empty ones."""
    both = intersection(a, b)
    return F.coalesce(both / F.nullif(_area(*a) + _area(*b) - both, F.lit(0)), F.lit(0.0))


def containment(a: list[Column], b: list[Column]) -> Column:
    """Intersection over the smaller area; 0 for empty boxes."""
    return F.coalesce(intersection(a, b) / F.nullif(F.least(_area(*a), _area(*b)), F.lit(0)), F.lit(0.0))


def overlaps(a: list[Column], b: list[Column], least_iou: float, least_containment: float) -> Column:
    return (iou(a, b) >= least_iou) | (containment(a, b) >= least_containment)


def foot_point(box: list[Column]) -> tuple[Column, Column]:
    """The middle of the lower edge."""
    return (box[0] + box[2]) / 2.0, box[3].cast("double")


def is_clipped(box: list[Column], width: Column, height: Column, margin: int = 2) -> Column:
    """Whether a box touches the frame's border, within ``margin`` pixels."""
    return (box[0] <= margin) | (box[1] <= margin) | (box[2] >= width - margin) | (box[3] >= height - margin)


def rescaled(box: list[Column], from_size: tuple[Column, Column], to_size: tuple[Column, Column]) -> list[Column]:
    """A box in another frame size; null where the aspects differ by more than a hundredth."""
    (fw, fh), (tw, th) = from_size, to_size
    same = F.abs(fw / fh - tw / th) / (tw / th) <= 0.01
    return [F.when(same, x * s) for x, s in zip(box, (tw / fw, th / fh, tw / fw, th / fh), strict=True)]


def project(h: Column, u: Column, v: Column) -> Column:
    """Struct (x, y) of a point under the homography ``h`` (9 numbers by row); null where the denominator vanishes."""
    at = lambda i: F.element_at(h, i + 1)
    down = at(6) * u + at(7) * v + at(8)
    x, y = at(0) * u + at(1) * v + at(2), at(3) * u + at(4) * v + at(5)
    return F.when(F.abs(down) >= 1e-9, F.struct((x / down).alias("x"), (y / down).alias("y")))


def required_speed(distance: Column, errors: Column, elapsed: Column, clock: float = 0.0) -> Column:
    """The least speed that explains a distance, errors taken off; null if no time could have passed."""
    return F.greatest(distance - errors, F.lit(0.0)) / F.nullif(F.abs(elapsed) + clock, F.lit(0.0))


def verdict(required: Column, limit: Column, known: Column) -> Column:
    """``unavailable`` without what is needed, else ``impossible`` or ``plausible``; only the second rejects."""
    return F.when(~F.coalesce(known, F.lit(False)) | limit.isNull(), "unavailable").when(required.isNull(), "unavailable").when(required > limit, "impossible").otherwise("plausible")
