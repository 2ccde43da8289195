"""The live engine of several models: it scores observations itself against banks that grow in state.

An observation brings vectors by model and view, and attributes. It is scored against the identities of its shard, and
the track holds on to one, is given another, or makes a new one as ``tracks.Track`` decides. What speaks for an identity
is added to its banks where it is new to them. After an overlap a track has to look like itself of before, strictly at
first and by lower bars once it failed often, before it shows its identity again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.streaming.held import InState, Plain
from tessera.streaming.tracks import Patience, Track

#: Views that may stand for one another.
TRANSITIONS = {("front", "side"), ("side", "front"), ("back", "side"), ("side", "back")}
NEW_ATTRIBUTES = 0.5


@dataclass(frozen=True)
class Live:
    """Bars of the engine; ``models`` gives each model's bar for support and for a new identity's second sample."""

    models: tuple[tuple[str, float, float], ...] = (("a", 0.50, 0.55), ("b", 0.50, 0.55), ("c", 0.50, 0.55))
    required: int = 2
    same_camera: float = 0.62
    cross_camera: float = 0.58
    strong: float = 0.74
    views: int = 2
    view_bar: float = 0.50
    attributes: float = 0.50
    least_score: float = 0.62
    margin: float = 0.02
    bank: int = 32
    novelty: float = 0.97
    same_gap: float = 60.0
    cross_gap: float = 120.0
    together: float = 2.0
    idle: float = 600.0
    recovery: float = 0.62
    recovery_relaxed: float = 0.52
    recovery_failures: int = 3
    references: int = 4
    patience: Patience = field(default_factory=Patience)


@dataclass
class Seen:
    """An observation: unit vectors by (model, view), and attributes by name."""

    track: str
    camera: str
    ts: float
    overlapping: bool
    vectors: dict[tuple[str, str], np.ndarray]
    attributes: dict[str, np.ndarray]


def seen(track: str, camera: str, ts: float, overlapping: bool, vectors: list, attributes: list) -> Seen:
    """From rows of (model, view, vec) and of (name, vec); vectors without a direction are left out."""
    unit = lambda v: np.asarray(v, float) / np.linalg.norm(np.asarray(v, float))
    some = lambda rows: [r for r in (tuple(r.values()) if isinstance(r, dict) else tuple(r) for r in (rows if rows is not None else ())) if np.linalg.norm(np.asarray(r[-1], float)) > 0]
    return Seen(track, camera, ts, overlapping, {(m, v): unit(x) for m, v, x in some(vectors)}, {n: unit(x) for n, x in some(attributes)})


PROFILE = "n long, last double, cameras array<string>, seen array<double>"
BANK = "vecs array<array<double>>"
TRACK = (
    "camera string, last double, gid string, failures int, other string, seen int, pending int, made int, overlapping boolean, recovering boolean, "
    "recovery_failures int, names array<string>, before array<array<double>>, models array<string>, references array<array<double>>"
)
OUT = "track string, camera string, ts double, gid string, status string, score double"


@dataclass(frozen=True)
class Match:
    gid: str
    score: float
    deep: float
    support: int
    views: int
    attributes: float
    same: bool


class Engine:
    """The rules of a shard over profiles (by gid), banks (by gid, model and view, or attribute) and tracks."""

    def __init__(self, settings: Live, profiles: Plain, banks: Plain, tracks: Plain):
        self.s, self.profiles, self.banks, self.tracks = settings, profiles, banks, tracks

    def _bank(self, gid: str, model: str, view: str) -> np.ndarray | None:
        found = self.banks.get(f"{gid}|{model}|{view}")
        return np.array(found[0]) if found and len(found[0]) else None

    def score(self, o: Seen, gid: str) -> Match:
        _, _, cameras, times = self.profiles.get(gid)
        same = o.camera in cameras
        by_model, views = {}, 0
        for model, _, _ in self.s.models:
            best = []
            for (m, view), v in o.vectors.items():
                if m != model:
                    continue
                near = [float((b[-32:] @ v).max()) for other in ("front", "side", "back", "full", view) if (other == view or (view, other) in TRANSITIONS) and (b := self._bank(gid, model, other)) is not None]
                if near:
                    best.append(max(near))
                    views += max(near) >= self.s.view_bar
            by_model[model] = float(np.mean(sorted(best, reverse=True)[:3])) if best else 0.0
        deep = float(np.mean(sorted(by_model.values(), reverse=True)[:2]))
        support = sum(by_model[m] >= bar for m, bar, _ in self.s.models)
        alike = [float((b[-24:] @ v).max()) if (b := self._bank(gid, "@", n)) is not None else 0.5 for n, v in o.attributes.items()]
        attributes = float(np.mean(alike)) if alike else 0.5
        last = times[cameras.index(o.camera)] if same else max(times, default=o.ts)
        temporal = min(1.0, max(0.0, 1.0 - abs(o.ts - last) / (self.s.same_gap if same else self.s.cross_gap)))
        # Shape and floor are not observed here: each counts as undecided.
        score = 0.76 * deep + 0.10 * attributes + 0.14 * 0.5 if same else 0.76 * deep + 0.14 * attributes + 0.05 * 0.5 + 0.05 * temporal
        return Match(gid, score, deep, support, views, attributes, same)

    def verified(self, m: Match) -> bool:
        strong = m.deep >= self.s.strong
        return m.support >= self.s.required and m.deep >= self.s.same_camera and (strong or m.views >= self.s.views and m.attributes >= self.s.attributes)

    def acceptable(self, m: Match, second: float) -> bool:
        strong = m.deep >= self.s.strong
        good = m.support >= self.s.required and m.deep >= (self.s.same_camera if m.same else self.s.cross_camera)
        clear = m.score - second >= self.s.margin or strong
        return good and (strong or m.views >= self.s.views and m.attributes >= self.s.attributes) and m.score >= self.s.least_score and clear

    def _shown(self, o: Seen) -> set[str]:
        """Identities that another track of the camera is showing just then."""
        rows = ((k, self.tracks.get(k)) for k in self.tracks.keys())
        return {t[2] for k, t in rows if k != o.track and t[0] == o.camera and t[2] and abs(o.ts - t[1]) <= self.s.together}

    def _add(self, gid: str, o: Seen) -> None:
        n, last, cameras, times = self.profiles.get(gid) or (0, o.ts, [], [])
        at = dict(zip(cameras, times, strict=True)) | {o.camera: o.ts}
        self.profiles.put(gid, (n + 1, max(last, o.ts), list(at), list(at.values())))
        for model, view, v, depth, most in [(m, w, v, 16, self.s.bank) for (m, w), v in o.vectors.items()] + [("@", n, v, 12, min(self.s.bank, 48)) for n, v in o.attributes.items()]:
            bank = self._bank(gid, model, view)
            if bank is None or float((bank[-depth:] @ v).max()) < self.s.novelty:
                kept = [*(bank.tolist() if bank is not None else []), v.tolist()][-most:]
                self.banks.put(f"{gid}|{model}|{view}", (kept,))

    def _consistent(self, o: Seen, before: dict[str, np.ndarray]) -> bool:
        """Whether the observation is of the entity of the one before: by every model, and by attributes on the whole."""
        for model, _, bar in self.s.models:
            near = [float(v @ w) for (m, view), v in o.vectors.items() if m == model for name, w in before.items() if name.split("|")[0] == model and (view == name.split("|")[1] or (view, name.split("|")[1]) in TRANSITIONS)]
            if not near or max(near) < bar:
                return False
        alike = [float(v @ before[f"@|{n}"]) for n, v in o.attributes.items() if f"@|{n}" in before]
        return not alike or float(np.mean(alike)) >= NEW_ATTRIBUTES

    def _recovered(self, o: Seen, models: list[str], references: list, relaxed: bool) -> bool:
        bar, scores = self.s.recovery_relaxed if relaxed else self.s.recovery, []
        for model, _, _ in self.s.models:
            mine = [v for (m, _), v in o.vectors.items() if m == model]
            cos = sorted((float(v @ np.asarray(r)) for v in mine for m, r in zip(models, references, strict=True) if m == model), reverse=True)
            scores.append(float(np.mean(cos[:3])) if cos else 0.0)
        return sum(x >= bar for x in scores) >= self.s.required and float(np.mean(sorted(scores, reverse=True)[:2])) >= bar

    def observe(self, o: Seen) -> tuple:
        """(track, camera, ts, gid, status, score): the identity that the observation speaks for, if any."""
        row = self.tracks.get(o.track)
        if row is None or o.ts - row[1] > self.s.idle:
            row = (o.camera, o.ts, None, 0, None, 0, 0, 0, False, False, 0, [], [], [], [])
        track = Track(*row[2:8])
        was, recovering, failed, names, before, models, references = row[8:]
        before_ = {n: np.asarray(v) for n, v in zip(names, before, strict=True)}
        score, status = 0.0, "overlapping"
        if not o.overlapping:
            if was and references:
                recovering, failed = True, 0
            if recovering:
                if self._recovered(o, models, references, failed >= self.s.recovery_failures):
                    recovering = False
                else:
                    failed, status = failed + 1, "unproven"
                    if failed >= 2 * self.s.recovery_failures:
                        track.gid, track.other, track.seen, recovering, status = None, None, 0, False, "given_up"
            if status == "overlapping":
                shown = self._shown(o)
                fresh = [g for g in self.profiles.keys() if o.ts - self.profiles.get(g)[1] <= self.s.idle]
                ranked = sorted((self.score(o, g) for g in fresh if g == track.gid or g not in shown), key=lambda m: (-m.score, m.gid))
                free = [m for m in ranked if m.gid not in shown]
                second = free[1].score if len(free) > 1 else 0.0
                told = [{"gid": m.gid, "score": m.score, "verified": self.verified(m), "accepted": m in free[:1] and self.acceptable(m, second)} for m in ranked]
                consistent = bool(before_) and self._consistent(o, before_)
                status = track.step(o.track, told, consistent, self.s.patience)
                score = next((m.score for m in ranked if m.gid == track.gid), 0.0)
                if status == "made":
                    self._add_before(track.gid, o, before_)
                if status in ("verified", "switched", "matched", "made"):
                    self._add(track.gid, o)
                    new = [(m, v.tolist()) for (m, _), v in o.vectors.items()]
                    both = [*zip(models, references, strict=True), *new]
                    held = [x for m, _, _ in self.s.models for x in [y for y in both if y[0] == m][-self.s.references :]]
                    models, references = [m for m, _ in held], [list(map(float, v)) for _, v in held]
                before_ = {f"{m}|{w}": v for (m, w), v in o.vectors.items()} | {f"@|{n}": v for n, v in o.attributes.items()} if status == "pending" else {}
        shows = track.gid if status in ("verified", "switched", "matched", "made") else None
        kept = (track.gid, track.failures, track.other, track.seen, track.pending, track.made)
        self.tracks.put(o.track, (o.camera, o.ts, *kept, o.overlapping, recovering, failed, list(before_), [v.tolist() for v in before_.values()], models, references))
        return (o.track, o.camera, o.ts, shows, status, score)

    def _add_before(self, gid: str, o: Seen, before: dict[str, np.ndarray]) -> None:
        """The first of the two samples that made an identity is its own as well."""
        vectors = {tuple(n.split("|")): v for n, v in before.items() if not n.startswith("@|")}
        self._add(gid, Seen(o.track, o.camera, o.ts, False, vectors, {n[2:]: v for n, v in before.items() if n.startswith("@|")}))

    def sweep(self, now: float) -> None:
        for g in self.profiles.keys():
            if now - self.profiles.get(g)[1] > self.s.idle:
                self.profiles.drop(g)
                for key in [k for k in self.banks.keys() if k.startswith(f"{g}|")]:
                    self.banks.drop(key)
        for k in self.tracks.keys():
            if now - self.tracks.get(k)[1] > self.s.idle:
                self.tracks.drop(k)


class Lives(StatefulProcessor):
    """``Engine`` over map states of a shard: a profile, a bank and a track are an entry each."""

    def __init__(self, settings: Live):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.profiles, self.banks = handle.getMapState("profiles", "gid string", PROFILE), handle.getMapState("banks", "bank string", BANK)
        self.tracks = handle.getMapState("tracks", "track string", TRACK)

    def _engine(self) -> Engine:
        return Engine(self.settings, InState(self.profiles), InState(self.banks), InState(self.tracks))

    def _write(self, engine: Engine) -> None:
        for held in (engine.profiles, engine.banks, engine.tracks):
            held.write()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        engine, out, last = self._engine(), [], 0.0
        for r in pd.concat(list(rows)).sort_values(["seconds", "track"], kind="stable").itertuples():
            out.append(engine.observe(seen(r.track, r.camera, float(r.seconds), bool(r.overlapping), r.vectors, r.attributes)))
            last = max(last, float(r.seconds))
        self._write(engine)
        self.handle.registerTimer(int((last + self.settings.idle) * 1000) + 1)
        yield pd.DataFrame(out, columns=["track", "camera", "ts", "gid", "status", "score"])

    def handleExpiredTimer(self, key: tuple, timers: object, expired: object) -> Iterator[pd.DataFrame]:
        engine = self._engine()
        engine.sweep(expired.getExpiryTimeInMs() / 1000)
        self._write(engine)
        yield pd.DataFrame({c: [] for c in ("track", "camera", "ts", "gid", "status", "score")}).astype({"ts": "float64", "score": "float64"})

    def close(self) -> None:
        pass


def engine_stream(stream: DataFrame, settings: Live = Live(), shard: str = "shard", late: str = "10 seconds") -> DataFrame:
    """OUT of a stream of observations: track, camera, ts, overlapping, vectors (array of model, view, vec), attributes (array of name, vec), and a shard."""
    rows = stream.withWatermark("ts", late).select(shard, "track", "camera", "ts", F.col("ts").cast("double").alias("seconds"), "overlapping", "vectors", "attributes")
    return rows.groupBy(shard).transformWithStateInPandas(Lives(settings), OUT, "append", "EventTime")


def replayed(rows: list[tuple], settings: Live = Live()) -> list[tuple]:
    """The rows of one shard, (track, camera, seconds, overlapping, vectors, attributes) in order, through dicts."""
    engine = Engine(settings, Plain(), Plain(), Plain())
    return [engine.observe(seen(*r)) for r in rows]
