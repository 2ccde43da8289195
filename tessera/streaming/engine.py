"""Streams: newest rows, fair order, expiry, and identities assigned as observations arrive."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window


def newest(batch: DataFrame, keys: list[str], order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """The newest row of each key of a micro-batch, and how many rows of the key gave way to it."""
    ranked = batch.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    dropped = batch.groupBy(*keys).agg((F.count("*") - 1).alias("dropped"))
    return ranked.where("_n = 1").drop("_n"), dropped


def fair(batch: DataFrame, lane: str, order: list[Column], most: int) -> DataFrame:
    """Adds ``turn``: rows of the lanes by turns, up to ``most`` a lane, the newest of each."""
    ranked = batch.withColumn("_n", F.row_number().over(Window.partitionBy(lane).orderBy(*order))).where(F.col("_n") <= most)
    return ranked.withColumn("turn", F.col("_n")).drop("_n")


def fresh(batch: DataFrame, at: Column, now: Column, most: float) -> DataFrame:
    """Rows at most ``most`` seconds old."""
    return batch.where(now - at <= most)


def active(identities: DataFrame, now: Column, idle: float, most: int) -> DataFrame:
    """Identities seen within ``idle`` seconds, the ``most`` seen last at most (ties by gid)."""
    return identities.where(now - F.col("last_ts") <= idle).orderBy(F.desc("last_ts"), "gid").limit(most)


def sessions(stream: DataFrame, keys: list[str], at: str, gap: str, late: str) -> DataFrame:
    """Sessions of each key that end after ``gap`` without rows; rows later than ``late`` are dropped."""
    windowed = stream.withWatermark(at, late).groupBy(*keys, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return windowed.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


@dataclass(frozen=True)
class Online:
    """Bars of the online engine."""

    least_observations: int = 3
    bar: float = 0.70
    margin: float = 0.02
    together: float = 2.0
    idle: float = 300.0
    most_active: int = 200
    bank: int = 12
    least_weight: float = 0.05


class Gallery:
    """Identities and open tracks of a shard; plain values, so that it is a line of JSON in the state store."""

    def __init__(self, settings: Online, text: str | None = None):
        held = json.loads(text) if text else {"next": 1, "ids": {}, "tracks": {}}
        self.s, self.next, self.ids, self.tracks = settings, held["next"], held["ids"], held["tracks"]

    def text(self) -> str:
        return json.dumps({"next": self.next, "ids": self.ids, "tracks": self.tracks})

    def sweep(self, now: float) -> None:
        """Forgets what was idle too long, and beyond the cap what was seen first."""
        live = sorted(((g["last"], k) for k, g in self.ids.items() if now - g["last"] <= self.s.idle), key=lambda x: (-x[0], int(x[1])))
        self.ids = {k: self.ids[k] for _, k in live[: self.s.most_active]}
        self.tracks = {k: t for k, t in self.tracks.items() if now - t["last"] <= self.s.idle and (t["gid"] is None or str(t["gid"]) in self.ids)}

    def _best(self, v: np.ndarray, camera: str, now: float) -> int | None:
        found = []
        for k, g in self.ids.items():
            if now - g["last"] > self.s.idle or now - g["seen"].get(camera, -1e18) <= self.s.together:
                continue  # forgotten by now, or seen elsewhere by the camera at this time
            bank = np.array(g["bank"])
            mean = bank.mean(0)
            found.append((max(float(mean @ v / (np.linalg.norm(mean) + 1e-12)), float((bank @ v).max())), -int(k)))
        found.sort(reverse=True)
        if not found or found[0][0] < self.s.bar or len(found) > 1 and found[0][0] - found[1][0] < self.s.margin:
            return None
        return -found[0][1]

    def observe(self, camera: str, track: int, ts: float, vec: Any, quality: float) -> tuple[int, list[str]]:
        """(gid, earlier points to relabel): a negative gid is provisional."""
        v = np.asarray(vec, float)
        v = v / (np.linalg.norm(v) + 1e-12)
        t = self.tracks.setdefault(f"{camera}:{track}", {"gid": None, "n": 0, "sum": [0.0] * len(v), "points": [], "last": ts})
        t["last"], t["n"] = ts, t["n"] + 1
        t["sum"] = (np.array(t["sum"]) + max(quality, self.s.least_weight) * v).tolist()
        earlier: list[str] = []
        if t["gid"] is None and t["n"] >= self.s.least_observations:
            mean = np.array(t["sum"])
            mean = mean / (np.linalg.norm(mean) + 1e-12)
            gid = self._best(mean, camera, ts)
            if gid is None:
                gid, self.next = self.next, self.next + 1
                self.ids[str(gid)] = {"bank": [], "last": ts, "seen": {}}
            t["gid"], earlier, t["points"] = gid, t["points"], []
        if t["gid"] is None:
            return -(abs(hash_of(camera, track)) % (1 << 31)) - 1, earlier
        g = self.ids[str(t["gid"])]
        g["bank"] = [*g["bank"], v.tolist()][-self.s.bank :]
        g["last"] = g["seen"][camera] = ts
        return t["gid"], earlier


def hash_of(camera: str, track: int) -> int:
    """A number of a track that does not depend on the process."""
    out = 1469598103934665603
    for byte in f"{camera}:{track}".encode():
        out = (out ^ byte) * 1099511628211 % (1 << 64)
    return out


OUT = "point_id string, camera string, track_id bigint, ts double, gid bigint, version bigint"


def online_identities(stream: DataFrame, settings: Online = Online(), shard: str = "shard") -> DataFrame:
    """Identities of a stream (point_id, camera, track_id, ts, vec, quality and a shard column), as rows to append.

    The gallery of a shard is one state, so cameras that may see the same entity belong to one shard. A track is
    provisional (a negative gid) for its first observations; once it is known, its earlier points come again with their
    new gid and version 1, and the latest version counts (``operators.identity.corrected``).
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gallery = Gallery(settings, state.get[0] if state.exists else None)
        out = []
        rows = pd.concat(list(frames)).sort_values(["ts", "camera", "track_id", "point_id"], kind="stable")
        for r in rows.itertuples():
            gid, earlier = gallery.observe(r.camera, int(r.track_id), float(r.ts), r.vec, float(r.quality))
            track = gallery.tracks[f"{r.camera}:{int(r.track_id)}"]
            if track["gid"] is None:
                track["points"].append(r.point_id)
            out.append((r.point_id, r.camera, r.track_id, r.ts, gid, 0))
            out += [(p, r.camera, r.track_id, r.ts, gid, 1) for p in earlier]
        if len(rows):
            gallery.sweep(float(rows["ts"].max()))
        state.update((gallery.text(),))
        yield pd.DataFrame(out, columns=["point_id", "camera", "track_id", "ts", "gid", "version"])

    return stream.groupBy(shard).applyInPandasWithState(run, OUT, "gallery string", "append", GroupStateTimeout.NoTimeout)


def segments(stream: DataFrame) -> DataFrame:
    """camera, track_id, frame, segment and edge of a stream with ``overlapping``: the state machine of overlaps.

    Entering an overlap pauses a track, leaving it begins a new segment; the next ``recovery`` rows are samples to
    verify it by.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, segment, left = state.get if state.exists else (False, 1, 0)
        out = []
        for r in pd.concat(list(frames)).sort_values("frame", kind="stable").itertuples():
            edge = "enter" if r.overlapping and not before else "exit" if before and not r.overlapping else None
            if edge == "exit":
                segment, left = segment + 1, 4
            recovering = edge is None and not r.overlapping and left > 0
            left -= recovering
            before = bool(r.overlapping)
            out.append((key[0], key[1], r.frame, segment, edge, bool(recovering)))
        state.update((before, segment, left))
        yield pd.DataFrame(out, columns=["camera", "track_id", "frame", "segment", "edge", "recovering"])

    schema = "camera string, track_id bigint, frame bigint, segment bigint, edge string, recovering boolean"
    return stream.groupBy("camera", "track_id").applyInPandasWithState(run, schema, "before boolean, segment bigint, left_over bigint", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over all that is there, into Parquet at ``path``."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
