"""What a live track holds on to: an identity is verified sample by sample, given up, switched, matched or newly made."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, fields

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass(frozen=True)
class Patience:
    """How often a track may fail to look like its identity, how often another must be seen before a
    switch and by how much it must be better, and how many samples in a row make a new identity."""

    failures: int = 3
    confirmations: int = 2
    switch_margin: float = 0.05
    samples: int = 2


@dataclass
class Track:
    """The state of a track: its identity, failures since it was verified, the identity it may switch to, and how many
    samples in a row are of one unknown entity. ``made`` counts the identities that the track gave rise to."""

    gid: str | None = None
    failures: int = 0
    other: str | None = None
    seen: int = 0
    pending: int = 0
    made: int = 0

    def step(self, name: str, scores: list[dict], consistent: bool, p: Patience) -> str:
        """Takes a sample: ``scores`` (gid, score, verified, accepted) of the identities that are free, and whether it is
        of the entity of the sample before. Gives what happened."""
        own = next((s for s in scores if s["gid"] == self.gid), None) if self.gid else None
        if own and own["verified"]:
            self.failures, self.other, self.seen = 0, None, 0
            return "verified"
        best = max(scores, key=lambda s: (s["score"], s["gid"]), default=None)
        candidate = best if best and best["accepted"] else None
        if self.gid:
            if candidate and candidate["gid"] != self.gid and candidate["score"] >= (own["score"] if own else 0.0) + p.switch_margin:
                self.seen = self.seen + 1 if self.other == candidate["gid"] else 1
                self.other = candidate["gid"]
                if self.seen >= p.confirmations:
                    self.gid, self.failures, self.other, self.seen = candidate["gid"], 0, None, 0
                    return "switched"
            self.failures += 1
            if self.failures >= p.failures:
                self.gid, self.other, self.seen = None, None, 0
                return "given_up"
            return "held_back"
        if candidate:
            self.gid, self.failures, self.pending = candidate["gid"], 0, 0
            return "matched"
        self.pending = self.pending + 1 if consistent and self.pending else 1
        if self.pending >= p.samples:
            self.made += 1
            self.gid, self.failures, self.pending = f"{name}#{self.made}", 0, 0
            return "made"
        return "pending"


STATE = "gid string, failures int, other string, seen int, pending int, made int"
OUT = "track string, ts double, gid string, status string"


def _steps(track: Track, name: str, rows: pd.DataFrame, patience: Patience) -> pd.DataFrame:
    """A row per sample in order of time; the identity shows only where the sample speaks for it."""
    out = []
    for r in rows.sort_values("ts", kind="stable").itertuples():
        scores = [s if isinstance(s, dict) else s.asDict() for s in (r.scores if r.scores is not None else ())]
        status = track.step(name, scores, bool(r.consistent), patience)
        out.append((name, float(r.ts), track.gid if status in ("verified", "switched", "matched", "made") else None, status))
    return pd.DataFrame(out, columns=["track", "ts", "gid", "status"])


def held(samples: DataFrame, patience: Patience = Patience()) -> DataFrame:
    """OUT of all samples (track, ts, scores array<struct<gid,score,verified,accepted>>, consistent): a track in a task at a time.

    A new identity is named after its track and a number (``operators.identity.allocated`` gives it a number of its own).
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return _steps(Track(), rows["track"].iloc[0], rows, patience)

    return samples.select("track", "ts", "scores", "consistent").groupBy("track").applyInPandas(run, OUT)


def held_stream(samples: DataFrame, patience: Patience = Patience(), idle_ms: int | None = 600_000) -> DataFrame:
    """As ``held``, over a stream, with six values of state a track; a track idle for ``idle_ms`` is forgotten.

    Without ``idle_ms`` nothing is forgotten: for replays, which would else wait for the clock.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        track = Track(*state.get) if state.exists else Track()
        yield _steps(track, key[0], pd.concat(list(frames)), patience)
        state.update(tuple(asdict(track)[f.name] for f in fields(Track)))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)

    rows = samples.select("track", "ts", "scores", "consistent").groupBy("track")
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.applyInPandasWithState(run, OUT, STATE, "append", timeout)
