import itertools
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry, scores, vectors
from tessera.operators import audit, cluster, edges, evaluate, identity, intervals, motion, reconcile, scoring, sessions


def one(i, n=8):
    v = [0.0] * n
    v[i] = 1.0
    return v


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0], [4.0, 3.0]), (2, [0.0, 0.0], [1.0, 0.0]), (3, None, [1.0, 0.0]), (4, [float("nan"), 1.0], [1.0, 0.0])], "k int, a array<float>, b array<float>")
    got = {r.k: (r.c, r.v) for r in df.select("k", vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.is_valid(F.col("a"), 2).alias("v")).collect()}
    assert got[1] == (pytest.approx(0.96), True) and got[2] == (None, False) and got[3] == (None, False) and got[4][1] is False
    top = spark.createDataFrame([([0.1, 0.9, 0.5, 0.7],), ([],)], "x array<double>").select(vectors.topk_mean(F.col("x"), 2).alias("t"), vectors.share_mean(F.col("x"), 0.5).alias("s")).collect()
    assert [(round(r.t, 6), round(r.s, 6)) for r in top] == [(0.8, 0.8), (0.0, 0.0)]


def test_neutral_evidence(spark):
    df = spark.createDataFrame([(0.0, 1.0, 2.0, 3.0), (0.0, 2.0, 2.0, 3.0)], "a0 double, a1 double, b0 double, b1 double")
    got = [r.t for r in df.select(scores.temporal(*[F.col(c) for c in ("a0", "a1", "b0", "b1")]).alias("t")).collect()]
    assert got == [pytest.approx(1 - 1 / 30), 0.5]  # touching ends overlap
    r = spark.range(1).select(scores.shape_similarity(F.lit(None).cast("double"), F.lit(1.0)).alias("s"), scores.colour(F.lit(None).cast("double")).alias("c"), scores.gid(F.lit(7)).alias("g")).first()
    assert (r.s, r.c, r.g) == (0.5, 0.5, "G000007")


def test_geometry(spark):
    a, b = [F.lit(x) for x in (0, 0, 10, 10)], [F.lit(x) for x in (5, 5, 15, 15)]
    r = spark.range(1).select(geometry.iou(a, b).alias("i"), geometry.containment(a, b).alias("c"), geometry.project(F.array(*[F.lit(float(x)) for x in (1, 0, 0, 0, 1, 0, 0, 0, 0)]), F.lit(1.0), F.lit(1.0)).alias("p")).first()
    assert (round(r.i, 6), r.c, r.p) == (round(25 / 175, 6), 0.25, None)
    v = spark.range(1).select(geometry.verdict(F.lit(3.0), F.lit(2.0), F.lit(True)).alias("a"), geometry.verdict(F.lit(1.0), F.lit(2.0), F.lit(True)).alias("b"), geometry.verdict(F.lit(9.0), F.lit(None).cast("double"), F.lit(True)).alias("c")).first()
    assert tuple(v) == ("impossible", "plausible", "unavailable")


def test_view_scores_know_a_change_of_posture(spark):
    features = spark.createDataFrame([("a", "m", "full", one(0)), ("b", "m", "full", one(1)), ("b", "m", "upper", one(0)), ("c", "m", "full", one(0))], "key string, model string, view string, vec array<double>")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "left string, right string")
    got = {r.right: r for r in scoring.view_scores(features, pairs).collect()}
    assert got["b"].score == pytest.approx(0.85) and got["b"].transition and got["b"].support == 1  # one pair of vectors at .50 or more, full against upper
    assert got["c"].score == pytest.approx(1.0) and not got["c"].transition and got["c"].support == 1


def plain_split(rows, k):
    if k < 2 or len(rows) < 2 * k:
        return [rows]
    c = rows - rows.mean(0)
    v = c[0] / np.linalg.norm(c[0])
    for _ in range(8):
        v = c.T @ (c @ v)
        v = v / np.linalg.norm(v)
    return [rows[i] for i in np.array_split(np.argsort(c @ v, kind="stable"), k)]


def test_view_medoid_scores_against_plain_python(spark):
    rng = np.random.default_rng(5)
    banks = {k: rng.normal(size=(n, 6)) for k, n in (("a", 9), ("b", 3), ("c", 12))}
    features = spark.createDataFrame([(k, i, v.tolist()) for k, m in banks.items() for i, v in enumerate(m)], "key string, seq int, vec array<double>")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c")], "left string, right string")
    mean = lambda m: (x := m.mean(0)) / np.linalg.norm(x)
    unit = {k: m / np.linalg.norm(m, axis=1, keepdims=True) for k, m in banks.items()}
    for r in scoring.view_medoid_scores(features, pairs).collect():
        a, b = unit[r.left], unit[r.right]
        assert r.score == pytest.approx(max([mean(a) @ mean(b)] + [mean(x) @ mean(y) for x in plain_split(a, 2) for y in plain_split(b, 2)]))


def test_camera_clocks_are_brought_together(spark):
    df = spark.createDataFrame([("a", 10.0), ("b", 10.0), ("c", 10.0)], "camera string, t double")
    assert [r.t for r in df.select(scores.shifted(F.col("t"), F.col("camera"), {"a": 2.5, "b": -4.0}).alias("t")).collect()] == [12.5, 6.0, 10.0]


def test_models_support_at_their_own_bars(spark):
    df = spark.createDataFrame([(0.45, 0.43, 0.43)], "resnet double, swin double, solider double")
    half, same = F.lit(0.5), F.lit(False)
    out = scoring.fused(scoring.MODEL_BARS, same, half, half, half, half)
    assert df.select(out["model_support"].alias("n")).first().n == 2


def test_trajectory(spark):
    pts = lambda xs, t0: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(0.0).alias("y"), F.lit(t0 + i * 0.5).alias("ts")) for i, x in enumerate(xs)])
    r = spark.range(1).select(scoring.trajectory(pts([0, 1, 2], 0.0), pts([4, 5], 2.0), F.lit(1.0), F.lit(2.0)).alias("on"), scoring.trajectory(pts([0, 1, 2], 0.0), pts([4, 3], 2.0), F.lit(1.0), F.lit(2.0)).alias("back"), scoring.trajectory(pts([0], 0.0), pts([4], 2.0), F.lit(1.0), F.lit(2.0)).alias("few")).first()
    assert r.on == pytest.approx(1.0) and r.back == pytest.approx(0.7) and r.few == 0.5


def test_medoids_and_diverse_picks(spark):
    rng = np.random.default_rng(1)
    bank = [("k", i, (np.array(one(i % 2)) + 0.01 * rng.normal(size=8)).tolist(), 0.9 - i / 100) for i in range(8)]
    df = spark.createDataFrame(bank, "key string, seq int, vec array<double>, score double")
    parts = scoring.view_medoids(df, groups=2).collect()
    assert len(parts) == 2 and abs(np.dot(parts[0].vec, parts[1].vec)) < 0.2
    picks = {r.seq % 2 for r in scoring.diverse(df, ["key"], "vec", "score", 2).collect()}
    assert picks == {0, 1}
    assert scoring.subsample(df, ["key"], ["seq"], 3).count() == 3


def test_folds_along_time(spark):
    df = spark.createDataFrame([("a", t) for t in (0.0, 1.0, 4.0, 5.0, 9.0)], "k string, t double")
    assert rows(sessions.rate_limited(df, ["k"], "t", 4.0), "t") == [(0.0,), (4.0,), (9.0,)]
    bank = spark.createDataFrame([("k", 1, "full", one(0), 0.5), ("k", 2, "full", one(0), 0.51), ("k", 3, "full", one(0), 0.6), ("k", 4, "full", one(1), 0.1)], "key string, seq int, kind string, vec array<double>, q double")
    assert rows(sessions.novel(bank, ["key"], "kind", ["seq"], "vec", "q", 0.9), "seq") == [(1,), (3,), (4,)]
    avg = sessions.moving_average(bank, ["key"], ["seq"], "vec").first().average
    assert avg[0] > 0.9 and avg[1] > 0.2


def test_reconciliation_keeps_what_overlaps_apart(spark):
    def track(key, camera, start, i):
        return [(key, camera, start + 0.5 * j, one(i)) for j in range(4)]

    obs = [*track("a:1", "a", 0.0, 0), *track("a:7", "a", 50.0, 0), *track("b:5", "b", 10.0, 0), *track("c:8", "c", 10.0, 3), *track("a:9", "a", 1.0, 0)]
    df = spark.createDataFrame(obs, "key string, camera string, ts double, vec array<double>")
    got = {r.key: r.component for r in reconcile.reconcile(df).collect()}
    assert got["c:8"] not in {got[k] for k in got if k != "c:8"}
    assert got["a:9"] != got["a:1"] and got["b:5"] in (got["a:1"], got["a:9"], got["a:7"])
    spans = df.groupBy("key", "camera").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1")).join(spark.createDataFrame(list(got.items()), "key string, gid string"), "key")
    assert intervals.violations(spans, "gid", "camera", "t0", "t1", "key", 10.0).count() == 0
    again = {r.key: r.component for r in reconcile.reconcile(df.orderBy(F.desc("ts"))).collect()}
    assert again == got


def brute_reconciled(tracks, same_camera=0.75, cross_camera=0.65, waiver=0.90):
    """All pairs of groups, conflicts out first, rounds to a fixpoint; ``tracks``: key -> (camera, start, end, unit vec), of equal n."""
    group = {k: k for k in tracks}

    def allowed(x, y, score):
        for p in (tracks[k] for k in tracks if group[k] == x):
            for q in (tracks[k] for k in tracks if group[k] == y):
                if p[0] == q[0] and (score < same_camera or not (p[2] < q[1] or q[2] < p[1])):
                    return False
        return True

    for same in (True, False):
        while True:
            roots = sorted(set(group.values()))
            vec = {r: sum(tracks[k][3] for k in tracks if group[k] == r) for r in roots}
            cams = {r: {tracks[k][0] for k in tracks if group[k] == r} for r in roots}
            pairs = {}
            for a in roots:
                for b in roots:
                    lone = len(cams[a] | cams[b]) == 1
                    if a == b or lone != same:
                        continue
                    s = round(float(vec[a] @ vec[b] / np.linalg.norm(vec[a]) / np.linalg.norm(vec[b])), 4)
                    if s >= (same_camera if cams[a] & cams[b] else cross_camera) and allowed(a, b, s):
                        pairs[a, b] = s
            best = {a: min((-s, y) for (x, y), s in pairs.items() if x == a)[1] for a in {x for x, _ in pairs}}
            take = sorted((-s, a, b) for (a, b), s in pairs.items() if a < b and (s >= waiver or (best[a] == b and best[b] == a)))
            if not take:
                break
            for s, a, b in take:
                x, y = sorted((group[a], group[b]))
                if x != y and allowed(x, y, -s):
                    group = {k: x if g == y else g for k, g in group.items()}
    return group


def reconciled(spark, tracks):
    obs = [(k, c, a + (b - a) * j / 3, v.tolist()) for k, (c, a, b, v) in tracks.items() for j in range(4)]
    return {r.key: r.component for r in reconcile.reconcile(spark.createDataFrame(obs, "key string, camera string, ts double, vec array<double>")).collect()}


def test_reconciliation_sees_past_ten_closer_fragments(spark):
    # Fourteen fragments of one camera at one time are closer to each other than each to its partner elsewhere.
    def at(i, tilt, far):
        v = np.zeros(32)
        v[0], v[1 + i], v[20] = 1.0, tilt, far
        return v / np.linalg.norm(v)

    tracks = {f"a:{i:02}": ("a", 0.0, 9.0, at(i, 0.4, 0.0)) for i in range(14)} | {f"b:{i:02}": ("b", 0.0, 9.0, at(i, 0.4, 0.9)) for i in range(14)}
    got = reconciled(spark, tracks)
    assert got == {f"{c}:{i:02}": f"a:{i:02}" for c in "ab" for i in range(14)}
    assert got == brute_reconciled(tracks)


@pytest.mark.parametrize("seed", [1, 2])
def test_reconciliation_against_all_pairs(spark, seed):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(2, 16))
    tracks = {}
    for i in range(36):
        v = centre[i % 2] + rng.normal(size=16) * 0.7
        start = float(rng.integers(0, 60))
        tracks[f"k{i:02}"] = ("abc"[int(rng.integers(0, 3))], start, start + 9.0, v / np.linalg.norm(v))
    assert reconciled(spark, tracks) == brute_reconciled(tracks)


def test_unit_takes_the_length_of_a_long_vector_once(spark):
    df = spark.range(300).select(F.expr("transform(sequence(1, 4000), i -> cast((id * i) % 97 as double))").alias("v")).cache()
    df.count()
    began = time.monotonic()
    got = df.select(vectors.unit(F.col("v")).alias("u")).agg(F.count("u").alias("n"), F.sum(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x)).alias("s")).first()
    assert got.n == 296 and got.s == pytest.approx(296.0)  # four are zero, which have none
    assert time.monotonic() - began < 30  # a length for each component takes minutes


def brute_constrained(links, spans):
    sets = {k: {k} for k in spans}
    for a, b, _ in sorted(links, key=lambda e: (-e[2], e[0], e[1])):
        x, y = sets[a], sets[b]
        if x is not y and not any(spans[p][0] == spans[q][0] and not (spans[p][2] < spans[q][1] or spans[q][2] < spans[p][1]) for p in x for q in y):
            x |= y
            for k in y:
                sets[k] = x
    return {k: min(s) for k, s in sets.items()}


def test_constrained_components_against_one_fold(spark):
    rng = np.random.default_rng(7)
    spans = {i: (str(rng.integers(0, 3)), float(s), float(s + rng.integers(1, 6))) for i, s in enumerate(rng.integers(0, 40, 40))}
    links = [(int(a), int(b), round(float(rng.random()), 4)) for a, b in itertools.combinations(range(40), 2) if rng.random() < 0.08]
    nodes = spark.createDataFrame([(k, *v) for k, v in spans.items()], "key int, camera string, start double, end double")
    got = {r.key: r.component for r in cluster.constrained_components(spark.createDataFrame(links, "left int, right int, score double"), nodes).collect()}
    assert got == brute_constrained(links, spans)


def test_constrained_components_by_rounds_and_by_folds(spark):
    rng = np.random.default_rng(8)
    spans = {i: (str(rng.integers(0, 6)), float(s), float(s + rng.integers(0, 5))) for i, s in enumerate(rng.integers(0, 200, 150))}
    links = [(int(a), int(b), round(float(rng.random()), 2)) for a, b in (rng.permutation(150)[:2] for _ in range(600))]
    links += [(i, i + 1, 0.001 * i) for i in range(40)]  # a path of falling scores from its end on
    df = spark.createDataFrame(links, "left int, right int, score double")
    nodes = spark.createDataFrame([(k, *v) for k, v in spans.items()], "key int, camera string, start double, end double")
    for at_once in (20, 10_000):
        got = {r.key: r.component for r in cluster.constrained_components(df, nodes, at_once=at_once).collect()}
        assert got == brute_constrained(links, spans)
    whole = {k: (c, 0.0, 0.0) for k, (c, _, _) in spans.items()}  # members of one camera always meet
    got = {r.key: r.component for r in cluster.constrained_components(df, nodes, "camera", at_once=20).collect()}
    assert got == brute_constrained(links, whole)


def test_greedy_matching_against_one_fold(spark):
    rng = np.random.default_rng(9)
    links = [(0, int(a), int(b), round(float(rng.random()), 2)) for a in range(12) for b in range(12) if rng.random() < 0.4]
    left, right, want = set(), set(), set()
    for _, a, b, _s in sorted(links, key=lambda e: (-e[3], e[1], e[2])):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            want.add((a, b))
    got = cluster.greedy_matching(spark.createDataFrame(links, "lane int, left int, right int, score double"), ["lane"])
    assert {(r.left, r.right) for r in got.collect()} == want


def test_hungarian_against_all_permutations():
    rng = np.random.default_rng(11)
    for n, m in ((3, 3), (3, 5), (5, 4), (1, 4)):
        gain = rng.random((n, m))
        flip = gain.T if n > m else gain
        best = max(sum(flip[i, p[i]] for i in range(flip.shape[0])) for p in itertools.permutations(range(flip.shape[1]), flip.shape[0]))
        assert math.isclose(sum(gain[a, b] for a, b in cluster.hungarian(gain)), best)


def test_chains_and_stitches(spark):
    links = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.8), ("a", "c", 0.85), ("d", "c", 0.3)], "left string, right string, score double")
    assert rows(cluster.chains(links), "left", "right") == [("a", "b"), ("b", "c")]
    nodes = spark.createDataFrame([("a", 0.0, 1.0), ("b", 2.0, 3.0), ("c", 2.5, 4.0), ("d", 9.0, 9.5)], "key string, start double, end double")
    got = dict(rows(cluster.stitched(links, nodes), "key", "component"))
    assert got == {"a": "a", "b": "a", "c": "c", "d": "d"}  # c overlaps b; it keeps an identity of its own
    split = cluster.split_conflicted(nodes.withColumn("g", F.when(F.col("key") == "d", 2).otherwise(1)), "g")
    assert dict(rows(split, "key", "part")) == {"a": 1, "b": 2, "c": 3, "d": 1}


def test_local_solver(spark):
    t = spark.createDataFrame([("t1", "a", 0.0, 1.0, 0.9, one(0)), ("t2", "a", 2.0, 3.0, 0.9, one(0)), ("t3", "a", 2.5, 4.0, 0.9, one(0)), ("t4", "a", 5.0, 6.0, 0.1, one(4)), ("t1", "b", 0.0, 1.0, 0.9, one(0))], "key string, camera string, start double, end double, evidence double, vec array<double>")
    got = {(r.camera, r.key): (r.gid, r.reason) for r in identity.solve_local(t).collect()}
    assert got["a", "t1"][0] == got["a", "t2"][0] != got["a", "t3"][0]
    assert got["a", "t4"][1] == "founded" and got["b", "t1"][0] == 1


def test_identities_persist(spark):
    m = spark.createDataFrame([("x", 3), ("x", 5), ("y", 3), ("z", None)], "component string, had bigint")
    assert dict(rows(identity.survivors(m, 100), "component", "gid")) == {"x": 3, "y": 100, "z": 101}
    old = spark.createDataFrame([(1, "m", 1, [1.0, 0.0], ["a"], 5.0, 4), (1, "m", 2, [0.0, 1.0], ["a"], 5.0, 4)], "gid bigint, model string, seq bigint, vec array<double>, cameras array<string>, last_ts double, observations bigint")
    new = spark.createDataFrame([(1, "m", 3, [0.0, 1.0], ["b"], 4.0, 6), (1, "m", 4, [0.6, 0.8], ["b"], 4.0, 6)], old.schema)
    ids, bank = identity.merged_gallery(old, new, 2)
    assert rows(ids, "gid", "cameras", "last_ts", "observations") == [(1, ["a", "b"], 5.0, 6)]
    assert rows(bank, "seq") == [(2,), (4,)]
    comp = spark.createDataFrame([("c", "m1", one(0)), ("c", "m2", one(1))], "component string, model string, vec array<double>")
    gal = spark.createDataFrame([(1, "m1", one(0)), (1, "m2", one(1)), (2, "m1", one(0))], "gid bigint, model string, vec array<double>")
    s = identity.gallery_scores(comp, gal, {"m1": 0.3, "m2": 0.37, "m3": 0.33})
    assert [(r.component, r.gid, round(r.score, 6)) for r in identity.matched_gallery(s).collect()] == [("c", 1, 1.0)]
    v = spark.createDataFrame([("p", 1, 0), ("p", 9, 1), ("q", 2, 0)], "point_id string, gid bigint, version bigint")
    assert rows(identity.corrected(v), "point_id", "gid") == [("p", 9), ("q", 2)]
    q = identity.quality_out(spark.createDataFrame([("a", 1, one(0)), ("b", 1, one(0)), ("c", 2, one(1))], "key string, gid int, vec array<double>"))
    got = {r.key: r for r in q.collect()}
    assert got["a"].fit == pytest.approx(1.0) and got["a"].margin == pytest.approx(1.0) and got["c"].fit is None


def test_reports(spark):
    auc = evaluate.auc(spark.createDataFrame([(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0)], "s double, y int"), "s", "y").first()
    assert (auc.n_pos, auc.n_neg, auc.auc) == (2, 2, 0.875)
    labels = spark.createDataFrame([("a", "b", "same"), ("a", "z", "different"), ("a", "b", "unsure")], "a string, b string, verdict string")
    both, missing = evaluate.label_join(labels, spark.createDataFrame([("a",), ("b",)], "key string"))
    assert both.count() == 1 and missing.count() == 1
    log = spark.createDataFrame([("h", 1, "no"), ("h", 2, "yes")], "handle string, version int, outcome string")
    assert rows(audit.outcomes(log), "outcome") == [("yes",)]
    ways = motion.shortest_ways(spark.createDataFrame([("a", "b", 2.0), ("b", "c", 3.0), ("a", "c", 9.0)], "a string, b string, seconds double"))
    assert dict(((r.a, r.b), r.seconds) for r in ways.collect())["c", "a"] == 5.0


def test_search_in_blocks_and_ties(spark):
    v = spark.createDataFrame([(i, one(i % 3)) for i in range(9)], "id bigint, vec array<double>")
    whole = rows(edges.search(v, v, "id", "vec", 2), "query", "hit", "rank")
    assert whole == rows(edges.search(v, v, "id", "vec", 2, size=2), "query", "hit", "rank")
    assert (0, 3, 1) in whole and (0, 6, 2) in whole
    assert edges.search(v.limit(0), v, "id", "vec", 2).count() == 0


def test_evidence(spark):
    from tessera.operators import evidence

    r = spark.range(1).select(evidence.visible_share(F.array(F.lit(0.9), F.lit(0.1)), 0.5).alias("v"), evidence.visible_share(F.lit(None).cast("array<double>"), 0.5).alias("n"), evidence.block_similarity(F.array(F.array(F.lit(1.0), F.lit(0.0))), F.array(F.array(F.lit(1.0), F.lit(0.0)))).alias("b"), evidence.block_similarity(F.array().cast("array<array<double>>"), F.array().cast("array<array<double>>")).alias("e")).first()
    assert (r.v, r.n, r.b, r.e) == (0.5, None, pytest.approx(1.0), 0.5)
    cut = evidence.attribute_blocks(F.col("x"), {"a": 2, "b": 1})
    assert tuple(spark.createDataFrame([([1, 2, 3],)], "x array<int>").select(cut["a"].alias("a"), cut["b"].alias("b")).first()) == ([1, 2], [3])
    merged = spark.createDataFrame([(1, [[0, 0, 1, 1], [2, 2, 3, 3]]), (2, [])], "track_id long, bodies array<array<int>>")
    assert rows(evidence.split_merged(merged, "bodies"), "track_id", "body") == [(100001, [0, 0, 1, 1]), (2, None), (200001, [2, 2, 3, 3])]
    seen = spark.createDataFrame([("k", 1, True, one(0)), ("k", 2, False, one(5)), ("k", 3, True, one(0)), ("k", 4, True, one(1))], "k string, t int, clean boolean, vec array<double>")
    assert [(r.t, round(r.anchor, 6)) for r in evidence.anchor_check(seen, ["k"], "t", "clean", "vec").collect()] == [(3, 1.0)]


def test_hashed_search_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(100, 32))
    df = spark.createDataFrame([(i, (centres[i % 100] + 0.4 * rng.normal(size=32)).tolist()) for i in range(300)], "vec_id long, vec array<double>")
    want = {(r.query, r.hit): r.score for r in edges.search(df, df, "vec_id", "vec", 1).collect()}
    got = {(r.query, r.hit): r.score for r in edges.hashed_search(df, df, "vec_id", "vec", 1).collect()}
    best = {q: s for (q, _), s in want.items()}
    found = {q: s for (q, _), s in got.items()}
    assert sum(found.get(q) == s for q, s in best.items()) >= 0.9 * len(best)


def test_no_points_are_neutral(spark):
    none = F.array().cast("array<struct<x:double,y:double,ts:double>>")
    assert spark.range(1).select(scoring.trajectory(none, none, F.lit(1.0), F.lit(2.0)).alias("t")).first().t == 0.5


def test_held_value_of_one_time_is_the_largest(spark):
    df = spark.createDataFrame([("a", 0.0, v) for v in (1.0, 9.0, 4.0)] + [("a", 10.0, 2.0), ("a", 10.0, 1.0)], "k string, t double, v double")
    for order in (F.asc("v"), F.desc("v")):
        got = sessions.sample_and_hold(df.orderBy(order), ["k"], "t", "v", 5.0, 6.0)
        assert sorted((r.t, r.v) for r in got.collect()) == [(0.0, 9.0), (5.0, 9.0), (10.0, 2.0)]


def test_greedy_matching_by_rounds_and_by_folds(spark):
    rng = np.random.default_rng(6)
    edges = [(int(k), int(a), int(b), float(s)) for k, a, b, s in zip(rng.integers(0, 3, 400), rng.integers(0, 25, 400), rng.integers(0, 25, 400), rng.integers(0, 60, 400) / 60, strict=True)]
    edges = list({(k, a, b): (k, a, b, s) for k, a, b, s in edges}.values())
    df = spark.createDataFrame(edges, "lane int, left int, right int, score double")
    used, want = set(), set()
    for k, a, b, _ in sorted(edges, key=lambda e: (-e[3], e[1], e[2])):
        if (k, "l", a) not in used and (k, "r", b) not in used:
            used |= {(k, "l", a), (k, "r", b)}
            want.add((k, a, b))
    for at_once in (0, 100, 10_000):
        assert {(r.lane, r.left, r.right) for r in cluster.greedy_matching(df, ["lane"], at_once=at_once).collect()} == want


def test_greedy_matching_where_a_key_is_used_once_on_either_side(spark):
    rng = np.random.default_rng(8)
    edges = list({(int(a), int(b)): (0, int(min(a, b)), int(max(a, b)) + 1, float(s)) for a, b, s in zip(rng.integers(0, 20, 150), rng.integers(0, 20, 150), rng.random(150), strict=True)}.values())
    edges = list({e[1:3]: e for e in edges}.values())
    used, want = set(), set()
    for _, a, b, _ in sorted(edges, key=lambda e: (-e[3], e[1], e[2])):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    df = spark.createDataFrame(edges, "lane int, left int, right int, score double")
    for at_once in (0, 10_000):
        assert {(r.left, r.right) for r in cluster.greedy_matching(df, ["lane"], at_once=at_once, apart=False).collect()} == want


def test_greedy_matching_of_a_long_path(spark):
    path = [(0, i // 2, (i + 1) // 2, 1.0 - i / 1000) for i in range(600)]
    got = cluster.greedy_matching(spark.createDataFrame(path, "lane int, left int, right int, score double"), ["lane"]).collect()
    assert sorted((r.left, r.right) for r in got) == [(i, i) for i in range(300)]


def test_places_in_the_order_of_all_rows(spark):
    rng = np.random.default_rng(2)
    rows_ = [(int(x), f"k{i}") for i, x in enumerate(rng.integers(0, 20, 200))]
    got = cluster.in_order(spark.createDataFrame(rows_, "at int, key string").repartition(5), [F.col("at"), F.col("key")], "place").collect()
    assert [(r["at"], r.key) for r in sorted(got, key=lambda r: r.place)] == sorted(rows_) and sorted(r.place for r in got) == list(range(1, 201))


def test_one_pass_takes_clear_and_strong_pairs(spark):
    pairs = [("a", "b", 0.70), ("a", "c", 0.69), ("d", "e", 0.70), ("d", "f", 0.60), ("g", "h", 0.90), ("g", "i", 0.89), ("h", "i", 0.85), ("j", "k", 0.50)]
    df = spark.createDataFrame(pairs, "left string, right string, score double")
    got = {(r.left, r.right): r for r in reconcile.chosen(df).collect()}
    assert set(got) == {("d", "e"), ("g", "h"), ("g", "i"), ("h", "i")}  # a has two of the same, j is too weak
    assert got["d", "e"].reciprocal and got["d", "e"].margin_left == pytest.approx(0.1) and got["d", "e"].margin_right == pytest.approx(0.7)
    assert not got["h", "i"].reciprocal
    nodes = spark.createDataFrame([(k, "c1" if k in "gi" else k, 0.0, 1.0) for k in "abcdefghijk"], "key string, camera string, start double, end double")
    part = {r.key: r.component for r in reconcile.one_pass(df, nodes).collect()}
    assert part["d"] == part["e"] and part["g"] == part["h"] and part["i"] == "i" and part["a"] != part["b"]


def test_settings_are_checked():
    for bad in ({"same_camera": 1.5}, {"waiver": 0.1}, {"least_observations": 0}, {"per_camera": (("a", 0.5), ("a", 0.6))}):
        with pytest.raises(ValueError):
            reconcile.Settings(**bad)


def test_successors_of_equal_times_come_out_in_runs(spark):
    # Six spans at each of 40 moments of two cameras; the gap of 20 is the widest taken, that of 0 is none.
    spans = [("xy"[i % 2], f"{i}:{c}", 5.0 * i, 5.0 * i + 10.0 + c % 2) for i in range(80) for c in range(6)]
    odd = [(None, "no camera", 5.0, 6.0), ("x", "no time", None, None), ("x", "no end", 31.0, None), ("x", "no start", None, 31.5), ("x", "early", -45.0, -35.25)]
    df = spark.createDataFrame(spans + odd + spans[:1], "camera string, key string, t0 double, t1 double")
    got = intervals.successors(df, ["camera"], "t0", "t1", 20.0).collect()
    assert list(got[0].asDict()) == ["camera_a", "key_a", "t0_a", "t1_a", "camera_b", "key_b", "t0_b", "t1_b", "gap"]
    whole = [x for x in spans + odd + spans[:1] if x[0] is not None]
    want = [(*a, *b, b[2] - a[3]) for a in whole for b in whole if a[0] == b[0] and a[3] is not None and b[2] is not None and 0 < b[2] - a[3] <= 20.0]
    assert {r.gap for r in got} >= {20.0} and sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert len(list(itertools.groupby(got, lambda r: (r.camera_a, r.t1_a, r.t0_b)))) == len({(r.camera_a, r.t1_a, r.t0_b) for r in got}) < len(got) / 8
    near = intervals.successors(df, ["camera"], "t0", "t1", 20.0, places=0).select("key_a", "key_b", "gap").collect()
    assert len(near) == len(want) and all(r.gap == round(r.gap) for r in near)
