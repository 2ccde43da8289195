"""Identities from galleries that grow: tracklets in order join the identity that fits them, found a new one, or wait."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby
from math import exp, log
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import unit
from tessera.operators import blocks
from tessera.operators.cluster import components, cut
from tessera.operators.identity import numbered

WHOLE, PARTS, FACE = ("full", "light"), ("upper", "lower"), "face"
SLAB = 4_000_000
CELL = 8_192
NAMES = ["key", "founder", "reason", "score", "margin", "body", "face", "support"]


@dataclass(frozen=True)
class Growing:
    """Bars of the solver. ``faces`` adds the rules of a second model (features of kind ``face``); a tracklet founds an
    identity from ``least`` features and an evidence of ``found`` on (otherwise it is refused one); features of less quality than ``promote`` enter no bank; with ``merge``,
    identities whose banks agree are put together at the end."""

    threshold: float = 0.61
    margin: float = 0.035
    strong: float = 0.74
    support: int = 2
    bank: int = 24
    promote: float = 0.70
    repeat: float = 0.985
    least: int = 3
    found: float = 0.0
    faces: bool = False
    face_threshold: float = 0.70
    face_strong: float = 0.80
    face_margin: float = 0.06
    face_quality: float = 0.48
    face_strong_quality: float = 0.64
    body_conflict: float = 0.52
    merge: bool = False
    merge_body: float = 0.74
    merge_support: int = 3
    merge_face: float = 0.90

    def floor(self) -> float:
        """The cosine below which no pair of features can matter to a decision.

        A fused score is .9 c + .1 at most, c the best cosine of both sides. An identity counts if it is taken or comes
        within a margin of one that is, so c must reach (the least score that is taken - the margin - .1) / .9.
        """
        taken, wide = self.threshold, self.margin
        if self.faces:
            wide = max(wide, self.face_margin)
            strong_face = min(0.68 * self.face_strong + 0.24 * self.body_conflict, 0.68 * self.body_conflict + 0.24 * self.face_strong, 0.9 * self.face_strong)
            taken = min(taken, 0.68 * self.strong, 0.9 * self.face_threshold, strong_face)
        bars = [(taken - wide - 0.1) / 0.9] + ([self.merge_body, self.merge_face] if self.merge else [])
        return min(bars)


@dataclass
class Tracklet:
    key: Any
    camera: str
    start: float
    end: float
    shape: float
    evidence: float
    features: dict[str, tuple[np.ndarray, np.ndarray]]  # kind: qualities and unit vectors

    def count(self) -> int:
        return sum(len(q) for kind, (q, _) in self.features.items() if kind != FACE)

    def face_quality(self) -> float:
        return max(self.features[FACE][0], default=0.0) if FACE in self.features else 0.0


Bank = dict[str, tuple[np.ndarray, np.ndarray]]


@dataclass
class Identity:
    founder: Any
    trusted: Bank = field(default_factory=dict)
    candidate: Bank = field(default_factory=dict)
    spans: dict[str, list[tuple[float, float]]] = field(default_factory=dict)
    shapes: list[float] = field(default_factory=list)

    def vectors(self, kind: str) -> np.ndarray | None:
        held = [b[kind][1] for b in (self.trusted, self.candidate) if kind in b]
        return np.concatenate(held) if held else None

    def meets(self, camera: str, start: float, end: float) -> bool:
        """Whether a member was in the camera at that time; members of one camera never overlap, so two neighbours tell."""
        spans = self.spans.get(camera, [])
        at = bisect_left(spans, (start, end))
        return any(not (e < start or end < s) for s, e in spans[max(0, at - 1) : at + 1])

    def size(self) -> int:
        return sum(len(q) for bank in (self.trusted, self.candidate) for kind, (q, _) in bank.items() if kind != FACE)


def trimmed(bank: Bank, most: int) -> Bank:
    """At most ``most`` features: first the best of each kind in equal shares, then the best of the rest (earlier ones where equal)."""
    kinds = sorted(bank)
    if sum(len(bank[k][0]) for k in kinds) <= most:
        return bank
    share = max(1, most // len(kinds))
    ranks = {k: np.argsort(-bank[k][0], kind="stable") for k in kinds}
    first = [(k, i) for k in kinds for i in ranks[k][:share]]
    rest = sorted(((k, i) for k in kinds for i in ranks[k][share:]), key=lambda x: -bank[x[0]][0][x[1]])
    kept: dict[str, list[int]] = {}
    for k, i in (first + rest)[:most]:
        kept.setdefault(k, []).append(i)
    return {k: (bank[k][0][sorted(at)], bank[k][1][sorted(at)]) for k, at in kept.items()}


def joined(one: Bank, other: Bank, most: int) -> Bank:
    """The bank of both."""
    both = {k: tuple(np.concatenate([b[k][c] for b in (one, other) if k in b]) for c in (0, 1)) for k in {**one, **other}}
    return trimmed(both, most)


def fresh(bank: Bank, features: Bank, least: float, repeat: float) -> Bank:
    """``bank`` and those of ``features`` of enough quality that repeat no vector of their kind."""
    out = dict(bank)
    for kind, (qualities, vecs) in features.items():
        for q, v in zip(qualities, vecs, strict=True):
            had = out.get(kind)
            if q < least or had is not None and float((had[1] @ v).max()) > repeat:
                continue
            out[kind] = (np.array([q]), v[None]) if had is None else (np.append(had[0], q), np.vstack([had[1], v]))
    return out


def part_of(bank: Bank, face: bool) -> Bank:
    return {k: x for k, x in bank.items() if (k == FACE) == face}


def compared(a: np.ndarray | None, b: np.ndarray | None, bar: float) -> tuple[float, int] | None:
    """.72 of the best cosine and .28 of the mean of the three best, and how many reach ``bar``."""
    if a is None or b is None or not len(a) or not len(b):
        return None
    cos = np.sort((a @ b.T).ravel())
    return 0.72 * float(cos[-1]) + 0.28 * float(cos[-3:].mean()), int((cos >= bar).sum())


def body_score(left: dict[str, np.ndarray], right: Identity) -> tuple[float, int]:
    """.82 of the whole and .18 of its better part; without a whole .85 of the better and .15 of the other part."""
    kinds = {k: compared(left.get(k), right.vectors(k), 0.63) for k in WHOLE + PARTS}
    whole = kinds["full"] or kinds["light"]
    parts = sorted((kinds[k] for k in PARTS if kinds[k]), reverse=True)
    support = sum(p[1] for p in parts) + (whole[1] if whole else 0)
    if whole:
        return (0.82 * whole[0] + 0.18 * parts[0][0] if parts else whole[0]), support
    return (0.85 * parts[0][0] + 0.15 * parts[-1][0] if parts else 0.0), support


class Index:
    """All vectors of a shard's banks with their identities, so that one product by kind finds who can matter."""

    def __init__(self) -> None:
        self.rows: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.used: dict[str, int] = {}
        self.places: dict[int, dict[str, list[int]]] = {}
        self.free: dict[str, list[int]] = {}

    def put(self, number: int, identity: Identity | None) -> None:
        """Puts the identity's vectors in place of those it had; None takes it away."""
        for kind, places in self.places.pop(number, {}).items():
            self.rows[kind][0][places] = -1
            self.free[kind] += places
        if identity is None:
            return
        for kind in {*identity.trusted, *identity.candidate}:
            vecs = identity.vectors(kind)
            places = [self._place(kind, vecs.shape[1]) for _ in vecs]
            owners, held = self.rows[kind]
            owners[places], held[places] = number, vecs
            self.places.setdefault(number, {})[kind] = places

    def _place(self, kind: str, dim: int) -> int:
        if self.free.setdefault(kind, []):
            return self.free[kind].pop()
        owners, held = self.rows.get(kind, (np.full(0, -1), np.zeros((0, dim))))
        at = self.used.get(kind, 0)
        if at == len(owners):
            more = max(64, at)
            self.rows[kind] = (np.append(owners, np.full(more, -1)), np.vstack([held, np.zeros((more, dim))]))
        self.used[kind] = at + 1
        return at

    def near(self, features: dict[str, np.ndarray], floor: float, made: int) -> tuple[np.ndarray, np.ndarray]:
        """Identities (of numbers to ``made``) with a vector whose cosine is ``floor`` or more, and their best cosine."""
        best = np.full(made + 1, -np.inf)
        for kind, vecs in features.items():
            if kind in self.rows and len(vecs):
                owners, held = self.rows[kind]
                n = self.used[kind]
                cos = (held[:n] @ vecs.T).max(axis=1)
                at = np.flatnonzero((cos >= floor) & (owners[:n] >= 0))
                np.maximum.at(best, owners[at], cos[at])
        found = np.flatnonzero(best >= floor)
        return found, best[found]

    def pairs(self, floor: float) -> dict[int, np.ndarray]:
        """Of each identity those with a vector whose cosine with one of its own is ``floor`` or more, by slabs of bounded size."""
        found: dict[int, list[np.ndarray]] = {}
        for kind, (owners, held) in self.rows.items():
            at = np.flatnonzero(owners[: self.used[kind]] >= 0)
            at = at[np.argsort(owners[at], kind="stable")]
            own, vecs = owners[at], held[at]
            step = max(1, SLAB // max(1, len(at)))
            for first in range(0, len(at), step):
                i, j = np.divmod(np.flatnonzero(vecs[first : first + step] @ vecs.T >= floor), len(at))
                some = np.unique(own[first + i] * (1 << 32) + own[j])
                ends, others = some >> 32, some & ((1 << 32) - 1)
                for a, of in zip(np.unique(ends), np.split(others, np.flatnonzero(np.diff(ends)) + 1), strict=False):
                    found.setdefault(int(a), []).append(of)
        return {a: np.unique(np.concatenate(of)) for a, of in found.items()}


class Shard:
    """The identities of tracklets that may concern each other, as they grow."""

    def __init__(self, rule: Growing) -> None:
        self.rule, self.floor = rule, rule.floor() - 1e-9
        self.identities: dict[int, Identity] = {}
        self.index = Index()
        self.made = 0
        self.settled: set[Any] = set()

    def ranked(self, t: Tracklet) -> list[dict[str, Any]]:
        """The two identities that fit best, or fewer: no score is above what the best cosine of any kind allows, so the others need none."""
        rule, vecs = self.rule, {k: v for k, (_, v) in t.features.items()}
        seen = rule.faces and t.face_quality() >= rule.face_quality
        order = lambda r: (-r["score"], -r["support"], r["number"])
        rows: list[dict[str, Any]] = []
        numbers, best = self.index.near(vecs, self.floor, self.made)
        most = 0.90 * np.maximum(best, 0.0) + (0.10 if t.shape > 0 else 0.05 + 1e-9) + 1e-6
        if rule.faces:
            most = np.maximum(most, 0.92 * np.maximum(best, 0.0) + 0.08 + 1e-6)
        for at in np.argsort(-most, kind="stable"):
            if len(rows) == 2 and most[at] < rows[1]["score"]:
                break
            number = int(numbers[at])
            identity = self.identities[number]
            if identity.meets(t.camera, t.start, t.end):
                continue
            body, support = body_score(vecs, identity)
            face, faces = (compared(vecs.get(FACE), identity.vectors(FACE), 0.55) or (0.0, 0)) if seen else (0.0, 0)
            shape = exp(-abs(log(t.shape / float(np.median(identity.shapes)))) / 0.45) if t.shape > 0 and identity.shapes else 0.5
            if face > 0 and body > 0:
                strong = face >= rule.face_strong and t.face_quality() >= rule.face_strong_quality
                score = (0.68 * face + 0.24 * body if strong else 0.68 * body + 0.24 * face) + 0.08 * shape
            else:
                score = 0.90 * (face if face > 0 else body) + 0.10 * shape
            rows.append({"number": number, "score": round(score, 6), "body": round(body, 6), "face": round(face, 6), "support": support, "faces": faces})
            rows = sorted(rows, key=order)[:2]
        return rows

    def accepted(self, t: Tracklet, best: dict[str, Any], margin: float) -> str | None:
        rule, body, face = self.rule, best["body"], best["face"]
        enough, clear = best["support"] >= rule.support, margin >= rule.margin
        if not rule.faces:
            return "matched" if best["score"] >= rule.threshold and (enough and clear or best["score"] >= rule.strong) else None
        seen = best["faces"] >= 1 and face >= rule.face_threshold and t.face_quality() >= rule.face_quality
        strong = best["faces"] >= 1 and face >= rule.face_strong and t.face_quality() >= rule.face_strong_quality
        fused = best["score"] >= rule.threshold and clear
        if strong and (body <= 0 or body >= rule.body_conflict):
            return "face_body_strong"
        if seen and body <= 0 and margin >= rule.face_margin:
            return "face_only"
        if seen and body >= rule.body_conflict and fused:
            return "face_body"
        if body >= rule.strong and enough and clear:
            return "body_strong"
        return "body_gallery" if body >= rule.threshold and enough and fused else None

    def put(self, number: int, t: Tracklet, trusted: bool, trusted_faces: bool) -> None:
        rule, identity = self.rule, self.identities[number]
        for face, kept in ((False, trusted), (True, trusted_faces)):
            name, most = ("trusted", rule.bank) if kept else ("candidate", max(8 if face else 6, rule.bank // 2))
            old = getattr(identity, name)
            grown = fresh(part_of(old, face), part_of(t.features, face), rule.face_quality if face else rule.promote, rule.repeat)
            setattr(identity, name, {**part_of(old, not face), **trimmed(grown, most)})
        insort(identity.spans.setdefault(t.camera, []), (t.start, t.end))
        if t.shape > 0:
            identity.shapes = (identity.shapes + [t.shape])[-rule.bank :]
        self.index.put(number, identity)

    def take(self, t: Tracklet, last: bool) -> tuple | None:
        """The tracklet's decision as a row of NAMES, None where it waits for the second pass."""
        if t.key in self.settled:
            return None
        rule, rows = self.rule, self.ranked(t)
        best = rows[0] if rows else None
        margin = round(best["score"] - (rows[1]["score"] if len(rows) > 1 else 0.0), 6) if best else 0.0
        reason = self.accepted(t, best, margin) if best else None
        figures = (best["score"], margin, best["body"], best["face"], best["support"]) if best else (0.0, 0.0, 0.0, 0.0, 0)
        if reason:
            strong_face = best["face"] >= rule.face_strong and t.face_quality() >= rule.face_strong_quality
            strong = (best["body"] if rule.faces else best["score"]) >= rule.strong and best["support"] >= rule.support
            trusted = strong or rule.faces and strong_face
            self.settled.add(t.key)
            self.put(best["number"], t, trusted, trusted)
            return (t.key, self.identities[best["number"]].founder, reason, *figures)
        enough = t.count() >= rule.least or rule.faces and t.face_quality() >= rule.face_strong_quality
        if enough and t.evidence >= rule.found:
            self.made += 1
            self.identities[self.made] = Identity(t.key)
            self.settled.add(t.key)
            self.put(self.made, t, True, t.face_quality() >= rule.face_strong_quality)
            return (t.key, t.key, "new", *figures)
        return (t.key, None, "refused" if enough else "pending", *figures) if last else None

    def merged(self) -> Iterator[tuple]:
        """Rows of NAMES for identities that others take in (key is their founder): the first pair in order of founding that agrees, until none does.

        A bank of two holds vectors of theirs alone, so who can agree with it is known from both. After a merge only pairs
        of the one that grew are asked again; all other pairs before the row in turn have been found not to agree.
        """
        partners = self.index.pairs(min(self.rule.merge_body, self.rule.merge_face) - 1e-9)
        root = np.arange(self.made + 1)
        none = np.zeros(0, root.dtype)

        def of(a: int) -> list[int]:
            return [int(b) for b in np.unique(root[partners.get(a, none)]) if b != a]

        for turn in sorted(self.identities):
            while turn in self.identities:
                pair = next(((turn, b) for b in of(turn) if b > turn and self._agree(turn, b)), None)
                if pair is None:
                    break
                while pair is not None:
                    a, b = pair
                    winner, loser = pair if self.identities[a].size() >= self.identities[b].size() else (b, a)
                    founder = self._merge(winner, loser)
                    yield (founder, self.identities[winner].founder, "identity_merge", 0.0, 0.0, 0.0, 0.0, 0)
                    root[root == loser] = winner
                    partners[winner] = np.union1d(partners.get(winner, none), partners.pop(loser, none))
                    before = sorted((min(u, winner), max(u, winner)) for u in of(winner) if min(u, winner) < turn)
                    pair = next((p for p in before if self._agree(*p)), None)

    def _merge(self, winner: int, loser: int) -> Any:
        """Puts an identity into another; gives the founder of the one that is gone."""
        into, gone = self.identities[winner], self.identities.pop(loser)
        for name, part in (("trusted", 1), ("candidate", 2)):
            old, new = getattr(into, name), getattr(gone, name)
            body = joined(part_of(old, False), part_of(new, False), max(6, self.rule.bank // 2) if part == 2 else self.rule.bank)
            faces = joined(part_of(old, True), part_of(new, True), max(8, self.rule.bank // 2) if part == 2 else self.rule.bank)
            setattr(into, name, {**body, **faces})
        for camera, spans in gone.spans.items():
            into.spans[camera] = sorted(into.spans.get(camera, []) + spans)
        into.shapes = (into.shapes + gone.shapes)[-self.rule.bank :]
        return gone.founder

    def _agree(self, a: int, b: int) -> bool:
        one, two, rule = self.identities[a], self.identities[b], self.rule
        few, many = sorted((one, two), key=lambda i: sum(map(len, i.spans.values())))
        if any(many.meets(c, s, e) for c, spans in few.spans.items() for s, e in spans):
            return False
        body, support = body_score({k: one.vectors(k) for k in {*one.trusted, *one.candidate}}, two)
        if body >= rule.merge_body and support >= rule.merge_support:
            return True
        face = compared(one.vectors(FACE), two.vectors(FACE), 0.55) if rule.faces else None
        return face is not None and face[0] >= rule.merge_face


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Features in order, a row each, without a batch's vectors as Python lists."""
    for b in batches:
        scalars = [b.column(c).to_pylist() for c in ("shard", "last", "key", "camera", "start", "end", "shape", "evidence", "kind", "quality")]
        vecs = b.column("row")
        values, ends = vecs.values.to_numpy(zero_copy_only=False), vecs.offsets.to_numpy()
        for i, row in enumerate(zip(*scalars, strict=True)):
            yield (*row, values[ends[i] : ends[i + 1]])


def _solve(batches: Iterator[pa.RecordBatch], rule: Growing, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    flush = lambda: pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], f.type) for c, f in enumerate(schema)], schema=schema)
    for _, of_shard in groupby(_read(batches), key=lambda r: r[0]):
        shard = Shard(rule)
        for (last, key), rows in groupby(of_shard, key=lambda r: (r[1], r[2])):
            rows = list(rows)
            by_kind: dict[str, list[tuple]] = {}
            for r in rows:
                if r[8] is not None:
                    by_kind.setdefault(r[8], []).append(r)
            features = {k: (np.array([r[9] for r in f]), np.stack([r[10] for r in f])) for k, f in by_kind.items()}
            decision = shard.take(Tracklet(key, *rows[0][3:8], features), bool(last))
            if decision:
                out.append(decision)
            if len(out) >= 10_000:
                yield flush()
                out.clear()
        if rule.merge:
            out.extend(shard.merged())
    yield flush()


def _joined_labels(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels (each that of its smallest member) after the links between x and y."""
    while True:
        x, y = label[x], label[y]
        apart = x != y
        if not apart.any():
            return label
        x, y = np.minimum(x[apart], y[apart]), np.maximum(x[apart], y[apart])
        np.minimum.at(label, y, x)
        while not np.array_equal(label, label[label]):
            label = label[label]


def linked(features: DataFrame, floor: float) -> DataFrame:
    """left and right: links by which tracklets hang together as by all features of one kind whose cosine (4 places) is ``floor`` or more.

    Two blocks that meet give a link for each tracklet of theirs at most, to the first one that it hangs together with.
    """
    rows = features.where("key IS NOT NULL").select(F.col("kind").alias("key"), F.col("key").alias("row"), "vec")
    packed, number = blocks.packed(rows, "vec", ["row"], "row", CELL), blocks.kind_of(rows, "vec")
    bar = (np.ceil(floor * 10_000 - 1e-6) - 0.5) / 10_000 - 1e-9
    schema = "left string, right string"
    arrow = blocks.arrow_schema(schema)

    def hang(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        (u, mine), (v, theirs) = blocks.opened(left, number, ["row"]), blocks.opened(right, number, ["row"])
        names = pa.concat_arrays([mine["row"], theirs["row"]]).dictionary_encode()
        codes = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        a, b = codes[: len(u)], codes[len(u) :]
        label = np.arange(len(names.dictionary))
        for at, cos in blocks.slabs(u, v):
            i, j = np.divmod(np.flatnonzero(cos >= bar), len(v))
            label = _joined_labels(label, a[at + i], b[j])
            if not label.any():  # all hang together
                break
        at = np.flatnonzero(label != np.arange(len(label)))
        return pa.Table.from_arrays([names.dictionary.take(pa.array(label[at])), names.dictionary.take(pa.array(at))], schema=arrow)

    kinds = packed.select(F.col("key").alias("left"), F.col("key").alias("right")).distinct()
    return blocks.met(packed, packed, kinds, once=True).applyInArrow(hang, schema).distinct()


def grown(tracklets: DataFrame, features: DataFrame, rule: Growing = Growing(), links: DataFrame | None = None) -> DataFrame:
    """Decisions: key, gid (null while pending), component, reason, score, margin, body, face and support, a row a tracklet.

    ``tracklets`` has key (a string, one row each), camera, start, end, shape (null: unknown) and evidence; ``features``
    has key, seq, kind (full, light, upper, lower or face), quality and vec, and a tracklet has a bounded number of them.

    In the order of falling evidence (then camera, start, key) a tracklet takes the identity that fits best, if the rules
    accept it, and its features enter that identity's bank; otherwise it founds an identity, or waits. Those that wait are
    asked once more at the end, and then are known, new, or none (pending; refused, where only evidence lacks). With ``merge``, identities that agree and never met are put together then.

    Only tracklets that some pair of features links (``Growing.floor``) can concern each other, so each component of the
    links is a shard that equals one fold over everything. A task streams a shard's features in order; it holds the banks
    of the shard's identities, the spans of their members and the keys that have been placed, never the shard's rows.
    ``links`` (left, right) replaces the exact search, as by a hashed one. Tracklets without features stay pending;
    features without kind or quality, or with a null or zero vector, are left out; empty tables give empty ones.
    """
    t = tracklets.where("key IS NOT NULL").select("key", "camera", F.col("start").cast("double"), F.col("end").cast("double"), F.coalesce(F.col("shape").cast("double"), F.lit(0.0)).alias("shape"), F.coalesce("evidence", F.lit(0.0)).cast("double").alias("evidence"))
    rows = features.select("key", "seq", "kind", F.col("quality").cast("double").alias("quality"), "vec", unit(F.col("vec").cast("array<double>")).alias("row"))
    rows = rows.where("row IS NOT NULL AND kind IS NOT NULL AND quality IS NOT NULL" + ("" if rule.faces else f" AND kind <> '{FACE}'"))
    rows = cut(rows, "growing-features")
    links = cut(linked(rows, rule.floor()) if links is None else links, "growing-links")
    t = t.join(components(links).select("key", F.col("component").alias("_c")), "key", "left").withColumn("shard", F.coalesce("_c", "key")).drop("_c")
    n = rows.groupBy("key").agg(F.count(F.when(F.col("kind") != FACE, 1)).alias("n"), F.count(F.when(F.col("kind") == FACE, 1)).alias("n_faces"))
    t = t.join(n, "key")
    ready = (F.col("n") >= rule.least) | (F.lit(rule.faces) & (F.col("n_faces") > 0))
    once = t.where(ready).withColumn("last", F.lit(0)).withColumn("_at", F.col("start"))
    again = t.where(~ready | (F.lit(rule.faces) & (F.col("n") < rule.least)) | (F.col("evidence") < rule.found)).withColumn("last", F.lit(1)).withColumn("_at", F.lit(0.0))
    stream = once.unionByName(again.where("n > 0")).join(rows.drop("vec"), "key").repartition("shard")
    stream = stream.sortWithinPartitions("shard", "last", F.desc("evidence"), "camera", "_at", "key", "seq", "kind")
    stream = stream.select("shard", "last", "key", "camera", "start", "end", "shape", "evidence", "kind", "quality", "row")
    types = [pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4, pa.int64()]
    schema = pa.schema(list(zip(NAMES, types, strict=True)))
    found = stream.mapInArrow(lambda b: _solve(b, rule, schema), "key string, founder string, reason string, score double, margin double, body double, face double, support long")
    found = cut(found, "growing")
    merges = found.where("reason = 'identity_merge'").select(F.col("founder").alias("left"), F.col("key").alias("right"))
    into = components(merges).select(F.col("key").alias("founder"), F.col("component").alias("_into"))
    found = found.where("reason <> 'identity_merge'").join(into, "founder", "left").withColumn("component", F.coalesce("_into", "founder")).drop("_into", "founder")
    all_keys = tracklets.where("key IS NOT NULL").select("key", "evidence", "camera", "start")
    found = all_keys.select("key").join(found, "key", "left").withColumn("reason", F.coalesce("reason", F.lit("pending")))
    place = F.struct((-F.coalesce("evidence", F.lit(0.0))).alias("a"), F.col("camera").alias("b"), F.col("start").alias("c"), F.col("key").alias("d"))
    first = found.where("reason = 'new'").join(all_keys, "key").groupBy("component").agg(F.min(place).alias("at"))
    ids = numbered(first.select("component"), first).select("component", "gid")
    return found.join(ids, "component", "left").select("key", "gid", "component", *NAMES[2:])
