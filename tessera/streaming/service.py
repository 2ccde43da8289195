"""Online identities with late correction: a track waits for evidence, takes an identity by two lanes, and may be moved or split off again.

All rules are in ``Service``, over keyed state; ``served`` runs it in ``transformWithState``, a shard a key, where each
identity and each track is an entry of a map state of its own: a micro-batch writes those that it touched. Timers on event
time forget what was idle too long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.streaming.engine import hash_of
from tessera.streaming.held import InState, Plain, lists


@dataclass(frozen=True)
class Serving:
    """Bars and windows. Frames are the camera's own; seconds are event time.

    ``warm_up`` is how many observations an identity may have while its track can still move to a better one, ``late``
    how many frames after it was resolved a track can still be split off, by ``split`` below the bar that admitted it.
    """

    least_observations: int = 3
    same_camera: float = 0.80
    cross_camera: float = 0.70
    margin: float = 0.02
    better: float = 0.05
    warm_up: int = 5
    late: int = 30
    split: float = 0.05
    together: float = 2.0
    idle: float = 300.0
    bank: int = 12
    least_weight: float = 0.05


def unit(v: np.ndarray) -> np.ndarray:
    return v / (np.linalg.norm(v) + 1e-12)


IDENTITY = "bank array<array<double>>, n long, last double, cameras array<string>, seen array<double>"
TRACK = "camera string, gid long, n long, total array<double>, admitted double, resolved long, last double, version int, points array<string>, vecs array<array<double>>"
OUT = "point_id string, camera string, track_id long, ts double, gid long, version int, why string"


@dataclass
class Identity:
    bank: list
    n: int
    last: float
    cameras: list
    seen: list

    def at(self, camera: str) -> float:
        return self.seen[self.cameras.index(camera)] if camera in self.cameras else float("-inf")

    def look(self, camera: str, ts: float) -> None:
        if camera not in self.cameras:
            self.cameras, self.seen = [*self.cameras, camera], [*self.seen, ts]
        else:
            i = self.cameras.index(camera)
            self.seen = [*self.seen[:i], max(ts, self.seen[i]), *self.seen[i + 1 :]]
        self.last = max(self.last, ts)

    def score(self, v: np.ndarray) -> float:
        """The best of the bank's mean and of its nearest vector."""
        bank = np.array(self.bank)
        return max(float(unit(bank.mean(axis=0)) @ v), float((bank @ v).max()))

    def row(self) -> tuple:
        return (self.bank, self.n, self.last, self.cameras, self.seen)


@dataclass
class Track:
    camera: str
    gid: int | None
    n: int
    total: list
    admitted: float
    resolved: int
    last: float
    version: int
    points: list
    vecs: list

    def row(self) -> tuple:
        return (self.camera, self.gid, self.n, self.total, self.admitted, self.resolved, self.last, self.version, self.points, self.vecs)


class Service:
    """The rules of a shard over its identities, tracks and the next number (an entry ``next`` of identities' counter)."""

    def __init__(self, settings: Serving, ids: Plain, tracks: Plain, following: int):
        self.s, self.ids, self.tracks, self.following = settings, ids, tracks, following

    def identity(self, gid: int) -> Identity | None:
        found = self.ids.get(str(gid))
        return Identity(*found) if found else None

    def _known(self, now: float, camera: str, own: int | None = None) -> dict[int, Identity]:
        """Identities that are not forgotten by ``now``, and that another track of the camera is not showing just then."""
        out = {}
        for key in self.ids.keys():
            g = self.identity(int(key))
            if int(key) != own and g.bank and now - g.last <= self.s.idle and now - g.at(camera) > self.s.together:
                out[int(key)] = g
        return out

    def _mint(self) -> int:
        self.following += 1
        return self.following - 1

    def _two_lanes(self, camera: str, v: np.ndarray, now: float) -> tuple[int, float]:
        """An identity and the bar that admitted it: one that the camera has seen before, one of other cameras, or a new one."""
        known = self._known(now, camera)
        scores = {g: i.score(v) for g, i in known.items()}
        best = lambda some: max(some, key=lambda g: (scores[g], -g))
        if same := [g for g, i in known.items() if camera in i.cameras]:
            g = best(same)
            if scores[g] >= self.s.same_camera:
                return g, self.s.same_camera
        if across := [g for g, i in known.items() if set(i.cameras) - {camera}]:
            g = best(across)
            second = max((scores[o] for o in across if o != g), default=-1.0)
            if scores[g] >= self.s.cross_camera and scores[g] - second >= self.s.margin:
                mean = unit(np.array(known[g].bank).mean(axis=0))
                if scores[g] >= max((i.score(mean) for o, i in known.items() if o != g), default=-1.0):
                    return g, self.s.cross_camera
        return self._mint(), self.s.cross_camera

    def _give(self, gid: int, camera: str, ts: float, vecs: list) -> None:
        g = self.identity(gid) or Identity([], 0, ts, [], [])
        g.bank = [*g.bank, *lists(vecs)][-self.s.bank :]
        g.n += len(vecs)
        g.look(camera, ts)
        self.ids.put(str(gid), g.row())

    def _move(self, t: Track, gid: int, ts: float) -> None:
        """A track with all it gave goes to another identity; one that nothing else speaks for is no more."""
        old = self.identity(t.gid)
        if old and old.n <= t.n:
            self.ids.drop(str(t.gid))
        elif old:
            old.n -= t.n
            gone = {tuple(v) for v in t.vecs}
            old.bank = [v for v in old.bank if tuple(v) not in gone] or old.bank[:1]
            self.ids.put(str(t.gid), old.row())
        self._give(gid, t.camera, ts, t.vecs)
        missing = t.n - len(t.vecs)
        if missing:
            g = self.identity(gid)
            g.n += missing
            self.ids.put(str(gid), g.row())
        t.gid, t.version = gid, t.version + 1

    def observe(self, point: str, camera: str, track_id: int, frame: int, ts: float, vec: list, quality: float) -> list[tuple]:
        """Rows (point_id, camera, track_id, ts, gid, version, why): this point's, and those of earlier points that change.

        A negative gid is provisional; of a point's rows that of the highest version counts.
        """
        key = f"{camera}:{track_id}"
        v = unit(np.asarray(vec, float))
        held = self.tracks.get(key)
        t = Track(*held) if held and ts - held[6] <= self.s.idle else Track(camera, None, 0, [0.0] * len(v), 0.0, -1, ts, 0, [], [])
        t.last, t.n = ts, t.n + 1
        t.total = (np.asarray(t.total) + max(quality, self.s.least_weight) * v).tolist()
        t.points, t.vecs = [*t.points, point], [*lists(t.vecs), v.tolist()]
        again, why = False, "kept"
        if t.gid is None:
            why = "waiting"
            if t.n >= self.s.least_observations:
                t.gid, t.admitted = self._two_lanes(camera, unit(np.array(t.total)), ts)
                why = "resolved" if self.identity(t.gid) else "new"
                self._give(t.gid, camera, ts, t.vecs)
                t.resolved, t.version, again = frame, t.version + 1, True
        else:
            self._give(t.gid, camera, ts, [v.tolist()])
            if frame - t.resolved <= self.s.late:
                own = self.identity(t.gid)
                if own.n <= self.s.warm_up and (other := self._better(t, own, v, ts)) is not None:
                    self._move(t, other, ts)
                    again, why = True, "moved"
                elif self._rest(t, own) is not None and self._rest(t, own) < t.admitted - self.s.split:
                    self._move(t, self._mint(), ts)
                    again, why = True, "split"
        gid = t.gid if t.gid is not None else -(abs(hash_of(camera, track_id)) % (1 << 31)) - 1
        out = [(p, camera, track_id, ts, gid, t.version, why) for p in (t.points if again else t.points[-1:])]
        if t.gid is not None and frame - t.resolved > self.s.late:
            t.points, t.vecs = [], []  # nothing of this track is corrected any more
        self.tracks.put(key, t.row())
        return out

    def _better(self, t: Track, own: Identity, v: np.ndarray, now: float) -> int | None:
        scores = {g: i.score(v) for g, i in self._known(now, t.camera, t.gid).items()}
        best = max(scores, key=lambda g: (scores[g], -g), default=None)
        rest = self._rest_score(t, own, v)
        if best is None or scores[best] < self.s.cross_camera or scores[best] < rest + self.s.better:
            return None
        return best

    def _without(self, t: Track, own: Identity) -> list:
        gone = {tuple(x) for x in t.vecs}
        return [x for x in own.bank if tuple(x) not in gone]

    def _rest_score(self, t: Track, own: Identity, v: np.ndarray) -> float:
        """How well the identity fits a vector but for that vector itself."""
        bank = [x for x in own.bank if tuple(x) != tuple(v.tolist())]
        return Identity(bank, own.n, own.last, [], []).score(v) if bank else -1.0

    def _rest(self, t: Track, own: Identity) -> float | None:
        """How well what others gave to the identity fits the track as a whole; null if nobody else gave."""
        bank = self._without(t, own)
        return Identity(bank, own.n, own.last, [], []).score(unit(np.array(t.total))) if bank else None

    def sweep(self, now: float) -> None:
        for key in self.ids.keys():
            if now - self.ids.get(key)[2] > self.s.idle:
                self.ids.drop(key)
        for key in self.tracks.keys():
            if now - self.tracks.get(key)[6] > self.s.idle:
                self.tracks.drop(key)


def in_order(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["seconds", "camera", "track_id", "point_id"], kind="stable")


class Serves(StatefulProcessor):
    """``Service`` over map states of a shard; a timer at the end of the idle time sweeps them."""

    def __init__(self, settings: Serving):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ids, self.tracks = handle.getMapState("ids", "gid string", IDENTITY), handle.getMapState("tracks", "track string", TRACK)
        self.following = handle.getValueState("following", "n long")

    def _service(self) -> Service:
        n = self.following.get()[0] if self.following.exists() else 1
        return Service(self.settings, InState(self.ids), InState(self.tracks), n)

    def _write(self, service: Service) -> None:
        service.ids.write()
        service.tracks.write()
        self.following.update((service.following,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        service, out, last = self._service(), [], 0.0
        for r in in_order(pd.concat(list(rows))).itertuples():
            out += service.observe(r.point_id, r.camera, int(r.track_id), int(r.frame), float(r.seconds), r.vec, float(r.quality))
            last = max(last, float(r.seconds))
        self._write(service)
        self.handle.registerTimer(int((last + self.settings.idle) * 1000) + 1)
        yield pd.DataFrame(out, columns=["point_id", "camera", "track_id", "ts", "gid", "version", "why"])

    def handleExpiredTimer(self, key: tuple, timers: object, expired: object) -> Iterator[pd.DataFrame]:
        service = self._service()
        service.sweep(expired.getExpiryTimeInMs() / 1000)
        self._write(service)
        yield pd.DataFrame({c: [] for c in ("point_id", "camera", "track_id", "ts", "gid", "version", "why")}).astype({"track_id": "int64", "ts": "float64", "gid": "int64", "version": "int32"})

    def close(self) -> None:
        pass


def served(stream: DataFrame, settings: Serving = Serving(), shard: str = "shard", late: str = "10 seconds") -> DataFrame:
    """Identities of a stream (point_id, camera, track_id, frame, ts, vec, quality and a shard), as rows to append.

    Cameras that may see the same entity belong to one shard. Rows later than ``late`` behind the newest are dropped.
    The state store has to be one that keeps maps (RocksDB).
    """
    seconds = F.col("ts").cast("double").alias("seconds")
    rows = stream.withWatermark("ts", late).select(shard, "point_id", "camera", "track_id", "frame", "ts", seconds, "vec", F.coalesce("quality", F.lit(0.0)).alias("quality"))
    return rows.groupBy(shard).transformWithStateInPandas(Serves(settings), OUT, "append", "EventTime")


def replayed(rows: list[tuple], settings: Serving = Serving()) -> list[tuple]:
    """The rows of one shard, (point_id, camera, track_id, frame, seconds, vec, quality) in order, through a dict."""
    service = Service(settings, Plain(), Plain(), 1)
    return [out for r in rows for out in service.observe(*r)]
