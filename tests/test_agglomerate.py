"""Reconciliation under rules: each rule against its case, and runs against a plain fold over all pairs of groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import agglomerate, blocks
from tessera.operators.agglomerate import Rules, agglomerated
from tessera.operators.identity import gallery_of

SCHEMA = "key string, camera string, ts double, vec array<double>"


def at(*parts, dim=16):
    v = np.zeros(dim)
    for i, x in parts:
        v[i] = x
    return v / np.linalg.norm(v)


def track(key, start, vec, n=4, step=1.0):
    vecs = vec if isinstance(vec, list) else [vec] * n
    return [(key, key.split(":")[0], start + step * j, [float(x) for x in v]) for j, v in enumerate(vecs)]


def run(spark, obs, rules, forbidden=None):
    out = agglomerated(spark.createDataFrame(obs, SCHEMA), rules, forbidden)
    return out, {r.key: r.component for r in out.members.collect()}


def plain(obs, rules, forbidden=()):
    """The same rules by loops over all pairs of groups: key -> component."""
    by = {}
    for key, camera, ts, vec in obs:
        by.setdefault(key, (camera, [], []))
        by[key][1].append(ts)
        by[key][2].append(np.array(vec))
    by = {k: v for k, v in by.items() if len(v[1]) >= rules.least_observations}
    unit = lambda v: v / np.linalg.norm(v)
    proto = {k: unit(np.mean(v[2], axis=0)) for k, v in by.items()}
    cam = {k: v[0] for k, v in by.items()}
    foes = {frozenset(p) for p in forbidden} | {frozenset((a, b)) for a in by for b in by if a < b and cam[a] == cam[b] and not (max(by[a][1]) < min(by[b][1]) or max(by[b][1]) < min(by[a][1]))}
    groups = {k: {k} for k in by}
    bars = dict(rules.per_camera)

    def bar(a, b, same):
        shared = {cam[k] for k in a} & {cam[k] for k in b}
        if not shared:
            return rules.cross_camera
        top = max(bars.get(c, rules.same_camera) for c in shared)
        return top if same or rules.cluster_same_camera is None else min(top, rules.cluster_same_camera)

    def rows(g):
        every = [unit(v) for k in sorted(g) for v in by[k][2]]
        if len(every) > rules.cap:
            every = [every[int(i)] for i in np.linspace(0, len(every) - 1, rules.cap).round()]
        return np.stack(every)

    def score(a, b):
        mean = float(unit(np.mean([proto[k] for k in a], axis=0)) @ unit(np.mean([proto[k] for k in b], axis=0)))
        if rules.mode == "prototype":
            return round(mean, 4)
        cos = rows(a) @ rows(b).T
        if rules.mode == "max_exemplar":
            return round(max(mean, float(cos.max())), 4)
        flat = np.sort(cos.ravel())[::-1]
        return round(float(flat[: max(1, round(flat.size * rules.share))].mean()), 4)

    hostile = lambda a, b: any(frozenset((x, y)) in foes for x in a for y in b)
    first = {(a, b): score({a}, {b}) for a in by for b in by if a < b}
    for same in (True, False):
        while True:
            names, links = sorted(groups), {}
            for i, a in enumerate(names):
                for b in names[i + 1 :]:
                    x, y = groups[a], groups[b]
                    lone = len({cam[k] for k in x | y}) == 1
                    if lone != same or hostile(x, y) or (s := score(x, y)) < bar(x, y, same):
                        continue
                    clear = sum(first[min(p, q), max(p, q)] >= bar(x, y, same) for p in x for q in y)
                    if same and clear < (len(x) * len(y) if rules.quorum >= 1 else max(1, round(len(x) * len(y) * rules.quorum))):
                        continue
                    links[a, b] = s
            ranked = {g: sorted((-s, b if a == g else a) for (a, b), s in links.items() if g in (a, b)) for g in names}
            unsure = set()
            if rules.ambiguity > 0 and not same:
                unsure = {g for g, r in ranked.items() if len(r) > 1 and r[1][0] - r[0][0] < rules.ambiguity and hostile(groups[r[0][1]], groups[r[1][1]])}
            mutual = rules.mutual_same if same else rules.mutual_cross
            take = []
            for (a, b), s in links.items():
                beyond = not same and 0 < rules.waiver <= s
                if unsure & {a, b} or mutual and not beyond and not (ranked[a][0][1] == b and ranked[b][0][1] == a):
                    continue
                anchored = any(cam[k] in rules.anchors for k in groups[a] | groups[b])
                take.append((not anchored, -s, a, b))
            here, merged = {g: g for g in names}, False
            for _, s, a, b in sorted(take):
                p, q = sorted((here[a], here[b]))
                if p == q or hostile(groups[p], groups[q]) or -s < bar(groups[p], groups[q], same):
                    continue
                groups[p] |= groups.pop(q)
                here = {g: p if h == q else h for g, h in here.items()}
                merged = True
            if not merged or same and not rules.rounds_same:
                break
    return {k: g for g, ks in groups.items() for k in ks}


def random_tracks(seed, n=20):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 16))
    obs = []
    for i in range(n):
        c = centres[i % 4]
        obs += track(f"{'abc'[int(rng.integers(3))]}:{i:02}", float(rng.integers(0, 400)), [c + rng.normal(size=16) * 0.6 for _ in range(int(rng.integers(2, 7)))])
    return obs


VARIANTS = [
    Rules(same_camera=0.7, cross_camera=0.6, rounds_same=True, quorum=0.7, waiver=0.8, per_camera=(("b", 0.85),)),
    Rules(same_camera=0.75, cross_camera=0.6, mutual_cross=False, cluster_same_camera=0.65, anchors=("c",)),
    Rules(same_camera=0.8, cross_camera=0.7, ambiguity=0.1, mode="max_exemplar", mutual_same=True, rounds_same=True),
    Rules(same_camera=0.75, cross_camera=0.65, mode="consensus", cap=5, waiver=0.75),
]


@pytest.mark.parametrize("n", range(len(VARIANTS)))
def test_against_a_plain_fold(spark, n):
    obs = random_tracks(n)
    keys = sorted({o[0] for o in obs})
    more = [(keys[i], keys[(7 * i + 3) % len(keys)]) for i in range(0, len(keys), 5) if keys[i] != keys[(7 * i + 3) % len(keys)]]
    out, got = run(spark, obs, VARIANTS[n], spark.createDataFrame(more, "left string, right string"))
    want = plain(obs, VARIANTS[n], more)
    assert {k: c for k, c in got.items() if c} == want
    assert len(set(want.values())) < len(want)
    assert out.merges.count() == len(want) - len(set(want.values()))


def test_rounds_of_the_fold_take_what_the_fold_takes(spark):
    # Every link at once in tasks, and rounds only (no link is left for tasks).
    rules = Rules(same_camera=0.7, cross_camera=0.5, mutual_cross=False, anchors=("b",))
    rng = np.random.default_rng(4)
    cams = {f"g{i:02}": sorted(rng.choice(list("abc"), int(rng.integers(1, 3)), replace=False).tolist()) for i in range(12)}
    names = sorted(cams)
    links = [(a, b, round(float(rng.uniform(0.5, 1)), 2), 0.5, bool({"b"} & {*cams[a], *cams[b]}), cams[a], cams[b]) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < 0.4]
    foes = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < 0.1]
    chosen = spark.createDataFrame(links, "a string, b string, score double, bar double, first boolean, _ca array<string>, _cb array<string>")
    no = spark.createDataFrame(foes, "a string, b string")
    got = [sorted((r.a, r.b) for r in agglomerate.folded(chosen, no, rules, False, n).collect()) for n in (0, 10**6)]
    assert got[0] == got[1] and len(got[0]) > 3


def test_quorum_refuses_what_a_mean_admits(spark):
    # One fragment agrees with the newcomer, the other does not; their mean does.
    a, b = at((0, 1.0)), at((0, 0.95), (1, 0.31))
    s = at((0, 0.78), (1, 0.62))
    obs = track("x:1", 0, a) + track("x:2", 100, b) + track("x:3", 200, s)
    strict = Rules(same_camera=0.85, mutual_same=True, rounds_same=True)
    assert len(set(run(spark, obs, strict)[1].values())) == 2
    assert len(set(run(spark, obs, Rules(same_camera=0.85, mutual_same=True, rounds_same=True, quorum=0.5))[1].values())) == 1


def test_modes_see_views_that_means_hide(spark):
    front, back = at((0, 1.0)), at((1, 1.0))
    one, other = [front] * 4 + [back] * 4, [back] * 6 + [at((2, 1.0))] * 6
    obs = track("x:1", 0, one) + track("y:1", 100, other)
    joins = lambda mode, bar: len(set(run(spark, obs, Rules(cross_camera=bar, mode=mode))[1].values())) == 1
    assert not joins("prototype", 0.8) and joins("max_exemplar", 0.99) and joins("view_medoid", 0.99)
    assert joins("consensus", 0.95)


def test_vetoes(spark):
    v = at((0, 1.0))
    obs = track("a:1", 0, v) + track("a:2", 2, v) + track("b:1", 1, v) + track("c:1", 500, v)
    nodes = spark.createDataFrame([("a:1", "a", 0.0, 3.0), ("a:2", "a", 2.0, 5.0), ("b:1", "b", 1.0, 4.0), ("c:1", "c", 500.0, 503.0)], "key string, camera string, start double, end double")
    pair = lambda df: sorted((min(r.left, r.right), max(r.left, r.right)) for r in df.collect())
    assert pair(agglomerate.together(nodes, 60.0)) == [("a:1", "a:2")]
    listed = spark.createDataFrame([("b", "a", 1.5), ("a", "c", 0.0), ("b", "c", None)], "cam_a string, cam_b string, tolerance double")
    assert pair(agglomerate.apart(nodes, listed, 60.0)) == [("a:1", "b:1"), ("a:2", "b:1")]
    assert pair(agglomerate.apart(nodes, listed.withColumn("tolerance", F.lit(2.0)), 60.0)) == []
    blind = run(spark, obs, Rules())[1]
    assert blind["a:1"] != blind["a:2"] and blind["b:1"] in (blind["a:1"], blind["a:2"])
    seen = run(spark, obs, Rules(), agglomerate.apart(nodes, listed, 60.0))[1]
    assert seen["b:1"] not in (seen["a:1"], seen["a:2"])
    why = agglomerate.reasons(same_camera=agglomerate.together(nodes, 60.0), not_seen_together=agglomerate.apart(nodes, listed, 60.0)).collect()
    assert {(r.left, r.right): r.reason for r in why} == {("a:1", "a:2"): "same_camera", ("a:1", "b:1"): "not_seen_together", ("a:2", "b:1"): "not_seen_together"}


def test_floors_that_cannot_be_crossed(spark):
    walk = lambda key, grp, start, x: [(key, grp, start + 0.5 * i, x + 0.1 * i, 0.0, 0.1) for i in range(6)]
    rows = walk("a", 1, 0.0, 0.0) + walk("b", 1, 4.0, 60.0) + walk("c", 1, 4.0, 3.0) + walk("d", 2, 4.0, 60.0) + walk("e", 1, 90.0, 60.0)
    pos = spark.createDataFrame(rows, "key string, grp int, ts double, x double, y double, error double")
    limits = spark.createDataFrame([(1, 3.0)], "grp int, limit double")
    got = sorted((r.left, r.right) for r in agglomerate.unreachable(pos, limits, 30.0, 60.0).collect())
    assert got == [("a", "b"), ("b", "c")]


def test_ambiguity_waiver_and_order(spark):
    # Two of camera b at one time are about as like a's: taking either is a guess.
    obs = track("a:1", 0, at((0, 1.0))) + track("b:1", 50, at((0, 0.80), (1, 0.6))) + track("b:2", 51, at((0, 0.78), (2, 0.62)))
    sure = run(spark, obs, Rules(cross_camera=0.6))[1]
    assert sure["a:1"] == sure["b:1"] != sure["b:2"]
    assert len(set(run(spark, obs, Rules(cross_camera=0.6, ambiguity=0.05))[1].values())) == 3
    # b's best is c, c's best is d: only the waiver joins b.
    obs = track("b:1", 0, at((0, 1.0))) + track("c:1", 50, at((0, 0.9), (1, 0.43))) + track("d:1", 99, at((0, 0.75), (1, 0.66)))
    out = run(spark, obs, Rules(cross_camera=0.7, waiver=0.85))[0]
    assert out.merges.where("round = 1").count() == 2
    assert run(spark, obs, Rules(cross_camera=0.7))[0].merges.where("round = 1").count() == 1


def test_ids_anchors_and_links(spark):
    v, w = at((0, 1.0)), at((1, 1.0))
    obs = track("a:1", 0, v) + track("b:1", 50, v) + track("b:2", 90, w) + track("c:1", 10, v, n=2)
    rules = Rules(anchors=("a",), require_anchor=True)
    out, _ = run(spark, obs, rules)
    had = spark.createDataFrame([("b:1", 7), ("b:2", 3), ("c:1", 9)], "key string, gid int")
    got = {r.key: (r.gid, r.state) for r in agglomerate.identified(out, had, rules).collect()}
    assert got == {"a:1": (7, "resolved"), "b:1": (7, "resolved"), "b:2": (None, "unregistered"), "c:1": (None, "suppressed")}
    free = {r.key: r.gid for r in agglomerate.identified(out, had.where("gid <> 3"), Rules()).collect()}
    assert free == {"a:1": 7, "b:1": 7, "b:2": 10, "c:1": None}
    assert [tuple(r) for r in agglomerate.link_scores(out).orderBy("key").collect()] == [("a:1", 1.0, 0.65, "b:1"), ("b:1", 1.0, 0.65, "a:1")]


def test_nothing_to_join(spark):
    out, got = run(spark, track("a:1", 0, at((0, 1.0)), n=2), Rules())
    assert got == {"a:1": None} and out.merges.count() == 0 and agglomerate.link_scores(out).count() == 0
    empty = agglomerated(spark.createDataFrame([], SCHEMA))
    assert empty.members.count() == 0
    for bad in ({"mode": "median"}, {"quorum": 0.0}, {"least_observations": 0}, {"per_camera": (("a", 0.5), ("a", 0.6))}):
        with pytest.raises(ValueError):
            Rules(**bad)


def test_gallery_of_a_mapping(spark):
    rows = [(k, i, at((int(i) % 3, 1.0), (9, 0.01 * i)).tolist(), 1.0 - 0.1 * i) for k in ("a", "b") for i in range(8)]
    features = spark.createDataFrame(rows, "key string, seq int, vec array<double>, quality double")
    mapping = spark.createDataFrame([("a", "g"), ("b", "g")], "key string, gid string")
    got = gallery_of(features, mapping, 1).collect()
    assert sorted((r.gid, r.key, r.seq) for r in got) == [("g", "a", 0), ("g", "b", 0)]
    more = gallery_of(features, mapping, 4).collect()
    assert len(more) == 8 and {r.seq for r in more} == {0, 1, 2, 3}
    assert {r.seq % 3 for r in gallery_of(features.where("key = 'a'"), mapping, 6).collect()} == {0, 1, 2}


def test_rounds_of_the_second_phase_can_be_bounded(spark):
    import math

    at = [0, 1, 5, 6, 20, 21, 25, 26]
    rows = [(f"k{i}", f"c{i}", float(10 * i), [math.cos(math.radians(a)), math.sin(math.radians(a))]) for i, a in enumerate(at)]
    obs = spark.createDataFrame(rows, "key string, camera string, ts double, vec array<double>")
    for most, groups in ((1, 4),):
        out = agglomerated(obs, Rules(least_observations=1, same_camera=0.5, cross_camera=0.5, most_rounds=most))
        assert out.members.select("component").distinct().count() == groups


BY_BEST = [
    Rules(same_camera=0.7, cross_camera=0.6, mutual_same=True),
    Rules(same_camera=0.8, cross_camera=0.5, mutual_same=True, per_camera=(("b", 0.65), ("c", 0.9)), cluster_same_camera=0.7),
]


@pytest.mark.parametrize("n", range(len(BY_BEST)))
def test_best_partners_take_the_place_of_a_table_of_links(spark, monkeypatch, n):
    # Blocks of a few groups, slabs of a few rows; equal vectors tie.
    for module, name, value in ((agglomerate, "LEAST_BLOCK", 3), (agglomerate, "CELL", 3), (blocks, "SLAB", 7)):
        monkeypatch.setattr(module, name, value, raising=False)
    obs = random_tracks(n + 20, 32)
    obs += [(key[:1] + ":9" + key[2:], camera, ts + 1000, vec) for key, camera, ts, vec in obs[:24]]
    keys = sorted({o[0] for o in obs})
    more = [(keys[i], keys[(7 * i + 3) % len(keys)]) for i in range(0, len(keys), 5) if keys[i] != keys[(7 * i + 3) % len(keys)]]
    sizes, write = [], agglomerate.cut
    monkeypatch.setattr(agglomerate, "cut", lambda df, name: (lambda out: sizes.append(out.count()) or out)(write(df, name)))
    out, got = run(spark, obs, BY_BEST[n], spark.createDataFrame(more, "left string, right string"))
    want = plain(obs, BY_BEST[n], more)
    assert {k: c for k, c in got.items() if c} == want
    assert len(set(want.values())) < len(want) - 10
    assert out.merges.count() == len(want) - len(set(want.values())) and {r.bar for r in out.merges.collect()} <= {0.5, 0.6, 0.65, 0.7, 0.8, 0.9}
    # Before, all pairs of tracklets were written.
    assert max(sizes) < len(want) * (len(want) - 1) / 4
