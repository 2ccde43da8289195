"""Growing galleries: planted cases, shards against one fold over everything, merges, and what is empty or null."""

import numpy as np
import pytest

from tessera.operators.cluster import components
from tessera.operators.growing import FACE, Growing, Identity, Index, Shard, Tracklet, grown, joined, linked, trimmed

TRACKLETS = "key string, camera string, start double, end double, shape double, evidence double"
FEATURES = "key string, seq int, kind string, quality double, vec array<double>"


def axis(*values, dim=8):
    return list(values) + [0.0] * (dim - len(values))


def solved(spark, tracklets, features, rule, **more):
    out = grown(spark.createDataFrame(tracklets, TRACKLETS), spark.createDataFrame(features, FEATURES), rule, **more)
    return {r.key: r for r in out.collect()}


def plain(tracklets, features, rule):
    """One shard for everything, all identities asked (the floor is taken away)."""
    shard = Shard(rule)
    shard.floor = -2.0
    by_key = {}
    for k, seq, kind, q, v in sorted(features, key=lambda f: (f[0], f[1], f[2])):
        if rule.faces or kind != FACE:
            by_key.setdefault(k, {}).setdefault(kind, []).append((q, np.asarray(v) / np.linalg.norm(v)))
    ts = {}
    for k, camera, s, e, shape, evidence in tracklets:
        f = {kind: (np.array([q for q, _ in x]), np.stack([v for _, v in x])) for kind, x in by_key.get(k, {}).items()}
        ts[k] = (evidence, Tracklet(k, camera, s, e, shape or 0.0, evidence, f))
    rows = []
    ready = [k for k, (_, t) in ts.items() if t.count() >= rule.least or rule.faces and FACE in t.features]
    for k in sorted(ready, key=lambda k: (-ts[k][0], ts[k][1].camera, ts[k][1].start, k)):
        rows.append(shard.take(ts[k][1], False))
    for k in sorted((k for k in ts if k not in shard.settled and ts[k][1].count()), key=lambda k: (-ts[k][0], ts[k][1].camera, k)):
        rows.append(shard.take(ts[k][1], True))
    merges = {r[0]: r[1] for r in shard.merged()} if rule.merge else {}
    of = {}
    for r in filter(None, rows):
        founder = r[1]
        while founder in merges:
            founder = merges[founder]
        of[r[0]] = (founder, r[2])
    return of


def test_body_of_another_time_is_matched(spark):
    rule = Growing(margin=0.01, support=1, least=1)
    out = solved(
        spark,
        [("a", "c1", 0.0, 1.0, None, 0.9), ("b", "c1", 10.0, 11.0, None, 0.8), ("same_time", "c1", 0.5, 2.0, None, 0.7), ("other", "c2", 0.0, 1.0, None, 0.6)],
        [(k, s, "full", 0.9, axis(1.0)) for k in ("a", "b", "same_time") for s in range(2)] + [("other", 0, "full", 0.9, axis(0.0, 1.0))],
        rule,
    )
    assert out["a"].gid == out["b"].gid and out["b"].reason == "matched"
    assert out["same_time"].reason == "new" and out["same_time"].gid != out["a"].gid  # one camera at one time
    assert out["other"].gid not in (out["a"].gid, out["same_time"].gid)
    assert len({r.gid for r in out.values()}) == 3


def test_face_alone_finds_its_identity(spark):
    rule = Growing(threshold=0.99, strong=0.99, support=1, faces=True, face_threshold=0.65, face_strong=0.75, face_margin=0.01, face_quality=0.4, face_strong_quality=0.6)
    features = [("a", s, "full", 0.9, axis(1.0)) for s in range(3)] + [("a", 3, FACE, 0.95, axis(0.0, 1.0)), ("b", 0, FACE, 0.95, axis(0.0, 1.0))]
    tracklets = [("a", "c1", 0.0, 1.0, None, 0.9), ("b", "c2", 0.0, 1.0, None, 0.1)]
    out = solved(spark, tracklets, features, rule)
    assert out["b"].reason == "face_body_strong" and out["a"].gid == out["b"].gid
    blind = solved(spark, tracklets, features, Growing(threshold=0.99, strong=0.99, support=1))
    assert blind["b"].gid is None and blind["b"].reason == "pending"


def test_weak_evidence_waits_for_the_gallery(spark):
    # "few" comes first by evidence, but cannot found an identity; it is asked again when the others have.
    rule = Growing(support=1, least=3)
    features = [("few", 0, "full", 0.9, axis(1.0, 0.1))] + [("many", s, "full", 0.9, axis(1.0, 0.05 * s)) for s in range(3)] + [("lone", 0, "full", 0.9, axis(0.0, 0.0, 1.0))]
    out = solved(spark, [("few", "c1", 0.0, 1.0, 2.0, 0.99), ("many", "c2", 5.0, 6.0, 2.1, 0.5), ("lone", "c3", 0.0, 1.0, None, 0.4)], features, rule)
    assert out["few"].gid == out["many"].gid and out["few"].reason == "matched"
    assert out["lone"].gid is None and out["lone"].reason == "pending"


def crowd(seed, n, people, dim=16, noise=0.35, faces=False):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(people, dim))
    tracklets, features = [], []
    for i in range(n):
        who, start = int(rng.integers(people)), float(rng.integers(60))
        key = f"t{i:03d}"
        tracklets.append((key, f"c{rng.integers(3)}", start, start + float(rng.integers(1, 6)), float(2 + rng.random()), round(float(rng.random()), 1)))
        for s in range(int(rng.integers(1, 6))):
            kind = ("full", "upper", "light")[int(rng.integers(3))]
            features.append((key, s, kind, round(0.6 + 0.4 * float(rng.random()), 2), (centres[who] + noise * rng.normal(size=dim)).tolist()))
        if faces and rng.random() < 0.5:
            features.append((key, 9, FACE, round(0.4 + 0.6 * float(rng.random()), 2), (centres[who][::-1] + noise * rng.normal(size=dim)).tolist()))
    return tracklets, features


@pytest.mark.parametrize(
    ("rule", "faces"),
    [(Growing(), False), (Growing(faces=True), True), (Growing(found=0.5), False), (Growing(faces=True, found=0.7), True), (Growing(bank=4, margin=0.08, merge=True, merge_support=1), False), (Growing(faces=True, merge=True, merge_body=0.7, merge_support=1), True)],
)
def test_shards_equal_one_fold(spark, rule, faces):
    tracklets, features = crowd(3, 60, 9, faces=faces)
    want = plain(tracklets, features, rule)
    out = solved(spark, tracklets, features, rule)
    groups = lambda of: sorted(sorted(k for k in of if of[k] == g) for g in set(of.values()) if g is not None)
    assert {k: r.reason for k, r in out.items() if k in want} == {k: reason for k, (_, reason) in want.items()}
    assert groups({k: r.gid for k, r in out.items()}) == groups({k: founder for k, (founder, _) in want.items()})
    assert any(r.reason not in ("new", "pending") for r in out.values())
    span = {t[0]: t[1:4] for t in tracklets}
    for g in groups({k: r.gid for k, r in out.items()}):
        assert not any(a < b and span[a][0] == span[b][0] and span[a][1] <= span[b][2] and span[b][1] <= span[a][2] for a in g for b in g)


def test_identities_that_agree_are_merged(spark):
    # The left and right halves share no clear best at first: a bar of .99 keeps them apart until the end.
    rule = dict(threshold=0.995, strong=0.999, support=1, least=1)
    tracklets = [("a", "c1", 0.0, 1.0, None, 0.9), ("b", "c2", 5.0, 6.0, None, 0.8), ("c", "c1", 0.5, 0.6, None, 0.7)]
    features = [("a", 0, "full", 0.9, axis(1.0)), ("b", 0, "full", 0.9, axis(1.0, 0.2)), ("c", 0, "full", 0.9, axis(1.0, 0.1))]
    apart = solved(spark, tracklets, features, Growing(**rule))
    assert len({r.gid for r in apart.values()}) == 3
    out = solved(spark, tracklets, features, Growing(**rule, merge=True, merge_support=1))
    assert out["a"].gid == out["b"].gid != out["c"].gid  # a and c were in one camera at one time


def test_evidence_too_weak_to_found_is_refused(spark):
    features = [(k, s, "full", 0.9, axis(*v)) for k, v in (("weak", (1.0,)), ("strong", (1.0, 0.1)), ("lone", (0.0, 0.0, 1.0))) for s in range(3)]
    tracklets = [("weak", "c1", 0.0, 1.0, None, 0.5), ("strong", "c2", 5.0, 6.0, None, 0.8), ("lone", "c3", 0.0, 1.0, None, 0.5)]
    out = solved(spark, tracklets, features, Growing(found=0.68))
    assert out["weak"].gid == out["strong"].gid and out["strong"].reason == "new"
    assert (out["lone"].gid, out["lone"].reason) == (None, "refused")


def test_links_that_are_given_make_the_shards(spark):
    tracklets, features = crowd(5, 20, 3)
    every = spark.createDataFrame([(a[0], b[0]) for a in tracklets for b in tracklets if a[0] < b[0]], "left string, right string")
    none = spark.createDataFrame([], "left string, right string")
    as_rows = lambda out: {k: (r.gid, r.reason, r.score) for k, r in out.items()}
    searched, given = solved(spark, tracklets, features, Growing()), solved(spark, tracklets, features, Growing(), links=every)
    assert {k: r[:2] for k, r in as_rows(given).items()} == {k: r[:2] for k, r in as_rows(searched).items()}
    assert {r.reason for r in solved(spark, tracklets, features, Growing(), links=none).values()} <= {"new", "pending"}


def test_banks():
    bank = lambda kind, qs: {kind: (np.array(qs), np.eye(8)[: len(qs)])}
    both = {**bank("full", [0.9, 0.8, 0.7, 0.95]), **bank("upper", [0.5])}
    kept = trimmed(both, 4)
    assert sorted(kept["full"][0]) == [0.8, 0.9, 0.95] and list(kept["upper"][0]) == [0.5]
    one, two, three = (bank("full", q) for q in ([0.9, 0.2], [0.8, 0.3], [0.7, 0.4]))
    left, right = joined(joined(one, two, 3), three, 3), joined(one, joined(two, three, 3), 3)
    assert sorted(left["full"][0]) == sorted(right["full"][0]) == [0.7, 0.8, 0.9]


def test_members_of_one_camera():
    i = Identity("x", spans={"c": [(0.0, 1.0), (5.0, 6.0), (9.0, 12.0)]})
    assert [i.meets("c", *s) for s in ((1.0, 2.0), (2.0, 4.0), (4.0, 9.0), (7.0, 8.0), (11.0, 20.0), (13.0, 14.0), (-5.0, 50.0))] == [True, False, True, False, True, False, True]
    assert not i.meets("d", 0.0, 1.0)


def test_empty_and_null(spark):
    assert solved(spark, [], [], Growing(merge=True)) == {}
    tracklets = [("a", "c1", 0.0, 1.0, None, None), (None, "c1", 0.0, 1.0, None, 0.5), ("zero", None, 0.0, 1.0, None, 0.5)]
    features = [("a", 0, "full", 0.9, axis(1.0)), ("a", 1, None, 0.9, axis(1.0)), ("a", 2, "full", None, axis(1.0)), ("zero", 0, "full", 0.9, axis()), ("a", 3, "full", 0.9, None), (None, 0, "full", 0.9, axis(1.0))]
    out = solved(spark, tracklets, features, Growing(least=1))
    assert {k: (r.gid is not None, r.reason) for k, r in out.items()} == {"a": (True, "new"), "zero": (False, "pending")}


def test_links_hold_together_what_all_pairs_do_and_are_few(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8)) * 3
    rows = [(f"k{i}", s, ("full", "upper")[i % 2], 0.9, (centres[i % 6] + rng.normal(size=8)).tolist()) for i in range(120) for s in range(3)]
    unit = lambda v: np.asarray(v) / np.linalg.norm(v)
    part = {k: k for k, *_ in rows}
    for a, _, kind, _, v in rows:
        for b, _, other, _, w in rows:
            if a != b and kind == other and round(float(unit(v) @ unit(w)), 4) >= 0.8 and part[a] != part[b]:
                old, new = max(part[a], part[b]), min(part[a], part[b])
                part = {k: new if c == old else c for k, c in part.items()}
    links = linked(spark.createDataFrame(rows, FEATURES), 0.8)
    assert links.count() < 120  # one for each tracklet, and not one for each pair
    got = {r.key: r.component for r in components(links).collect()}
    assert {k: c for k, c in part.items() if list(part.values()).count(c) > 1} == got


def test_the_best_two_are_those_of_all_identities():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16))
    vector = lambda i: (lambda v: v / np.linalg.norm(v))(centres[i] + 0.4 * rng.normal(size=16))
    for faces in (False, True):
        shard = Shard(Growing(threshold=0.9, margin=0.01, support=1, least=1, found=0.0, faces=faces))
        shard.floor, asked = -2.0, []
        for i in range(160):
            kinds = {"full": 2, "upper": 1, **({FACE: 1} if i % 3 else {})}
            t = Tracklet(f"k{i}", f"c{i % 4}", 3.0 * i, 3.0 * i + 1, (0.0, 1.5, 2.0)[i % 3], 0.5, {k: (np.full(n, 0.9), np.stack([vector(i % 40) for _ in range(n)])) for k, n in kinds.items()})
            got, every = shard.ranked(t), []
            numbers = sorted(shard.identities)
            for n in numbers:  # each alone
                alone = Shard(shard.rule)
                alone.floor, alone.made, alone.identities = -2.0, 1, {1: shard.identities[n]}
                alone.index.put(1, shard.identities[n])
                every += [{**r, "number": n} for r in alone.ranked(t)]
            asked.append(got)
            assert got == sorted(every, key=lambda r: (-r["score"], -r["support"], r["number"]))[:2]
            shard.take(t, False)
        assert any(len(r) == 2 for r in asked)


def test_a_merge_asks_only_the_identity_that_grew(monkeypatch):
    rule = Growing(threshold=2.0, strong=2.0, least=1, merge=True, merge_body=0.9, merge_support=0)
    shard = Shard(rule)
    for i in range(60):  # thirty pairs that agree, one after another
        v = np.zeros((1, 32))
        v[0, i // 2] = 1.0
        shard.take(Tracklet(f"k{i:02}", f"c{i}", 0.0, 1.0, 0.0, 0.5, {"full": (np.array([0.9]), v)}), False)
    asked = []
    agree = Shard._agree
    monkeypatch.setattr(Shard, "_agree", lambda self, a, b, *more: asked.append((a, b)) or agree(self, a, b, *more))
    near = Index.near
    monkeypatch.setattr(Index, "near", lambda self, *a: asked.append("near") or near(self, *a))
    assert len(list(shard.merged())) == 30 and len(asked) <= 60
