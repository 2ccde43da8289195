"""Which detections of a track are embedded: by ticks, the frames that were really processed."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.cluster import in_order


@dataclass(frozen=True)
class Sampling:
    """A new track's first ``warmup`` embeddings are ``spacing`` ticks apart, later ones ``interval``; a track unseen for
    more than ``ttl`` ticks is forgotten and starts anew; ``most`` (0: none) caps the embeddings of a track's life."""

    interval: int = 10
    warmup: int = 5
    spacing: int = 3
    ttl: int = 300
    most: int = 0


def ticks(frames: DataFrame, camera: str, frame: str) -> DataFrame:
    """camera, frame and tick of the distinct processed frames of each camera, counted from 1.

    Frames are numbered over all cameras in ranges, and a camera's first number is taken off, so that no task holds a camera.
    """
    some = frames.where(F.col(camera).isNotNull() & F.col(frame).isNotNull()).select(camera, frame).distinct()
    numbered = in_order(some, [F.col(camera), F.col(frame)], "_n")
    first = numbered.groupBy(camera).agg(F.min("_n").alias("_first"))
    return numbered.join(first, camera).select(camera, frame, (F.col("_n") - F.col("_first") + 1).alias("tick"))


class Sampler:
    """One track's state: when it was seen and embedded last (ticks), how many embeddings it had, and the frame of the held one."""

    def __init__(self, rule: Sampling) -> None:
        self.rule, self.count, self.seen, self.at, self.held = rule, 0, 0, 0, None

    def take(self, tick: int, frame: int, good: bool) -> tuple[bool, int | None]:
        """Whether this detection is embedded, and the frame whose vector it then carries."""
        rule = self.rule
        if self.count and tick - 1 - self.seen > rule.ttl:
            self.count, self.held = 0, None
        gap = tick - self.at
        warm = self.count < rule.warmup and gap >= rule.spacing
        due = self.count == 0 or not (rule.most and self.count >= rule.most) and (warm or gap >= rule.interval)
        self.seen = tick
        if due and good:
            self.count, self.at, self.held = self.count + 1, tick, frame
            return True, frame
        return False, self.held


def sampled(detections: DataFrame, keys: list[str], frame: str, good: str, tie: str, rule: Sampling = Sampling(), frames: DataFrame | None = None) -> DataFrame:
    """Adds ``tick``, ``embedded`` and ``held`` (the frame whose vector the detection carries, null if none) to detections.

    ``keys`` are a track's columns, the camera first; ``good`` says whether the crop may be embedded (null: no). A crop
    that is refused keeps the held vector and is asked again the next time. ``frames`` lists the processed frames with
    the same camera and frame columns; without it, those with a detection count. A row without camera, track or frame is
    never embedded. Several rows of a track in one frame go in the order of ``tie``.

    Tracks are streamed in order, each row once, with a few numbers of state: a track of any length fits a task.
    """
    clock = ticks(detections if frames is None else frames, keys[0], frame).select(F.col(keys[0]).alias("_k"), F.col(frame).alias("_f"), "tick")
    rows = detections.join(clock, (F.col(keys[0]) == F.col("_k")) & (F.col(frame) == F.col("_f")), "left").drop("_k", "_f")
    known = F.col("tick").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    schema = T.StructType([*rows.schema.fields, T.StructField("embedded", T.BooleanType()), T.StructField("held", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        track, sampler = None, Sampler(rule)
        for b in batches:
            picked = []
            names = [b.column(k).to_pylist() for k in keys]
            for *who, tick, at, ok in zip(*names, *(b.column(c).to_pylist() for c in ("tick", frame, good)), strict=True):
                if who != track:
                    track, sampler = who, Sampler(rule)
                picked.append(sampler.take(tick, at, bool(ok)))
            columns = [*b.columns, pa.array([p[0] for p in picked], pa.bool_()), pa.array([p[1] for p in picked], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, "embedded", "held"])

    out = rows.where(known).repartition(*keys).sortWithinPartitions(*keys, "tick", tie).mapInArrow(run, schema)
    rest = rows.where(~known | known.isNull()).withColumn("embedded", F.lit(False)).withColumn("held", F.lit(None).cast("long"))
    return out.unionByName(rest)


def embeddings_per_track(sampled_rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, detections, embeddings and the share of detections that carry a vector."""
    carried = F.avg(F.col("held").isNotNull().cast("double")).alias("carried")
    return sampled_rows.groupBy(*keys).agg(F.count("*").alias("detections"), F.count(F.when(F.col("embedded"), 1)).alias("embeddings"), carried)

