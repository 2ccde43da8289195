"""The resolver on small made-up tracklets: each case has known identities."""

import pytest

from tessera.operators import resolver
from tessera.plans.pair_queries import resolver_fixture

VIEWS = ("full", "upper", "torso", "lower")


def one(i, n=8):
    return [1.0 if k == i else 0.0 for k in range(n)]


def tracklet(key, camera, start, end, person, colour=0, aspect=1.6, views=VIEWS, x=(100.0, 105.0), h=180.0, models=None):
    row = (key, camera, float(start), float(end), 5, aspect, "upright" if aspect >= 1.35 else "compact", x[0], 100.0, x[1], 100.0, h)
    vectors = [(key, m, v, 0, one((models or {}).get(m, person))) for m in resolver.MODELS for v in views]
    return row, vectors, (key, one(colour, 4))


def tables(spark, cases):
    rows, vectors, colours = zip(*cases, strict=True)
    schema = "key string, camera string, start double, end double, n long, aspect double, state string, x_start double, y_start double, x_end double, y_end double, h_end double"
    return spark.createDataFrame(list(rows), schema), spark.createDataFrame([v for vs in vectors for v in vs], "key string, model string, view string, seq int, vec array<double>"), spark.createDataFrame(list(colours), "key string, vec array<double>")


def pair(spark, *cases):
    t, f, c = tables(spark, cases)
    return resolver.evidence_of(t, f, c, spark.createDataFrame([(cases[0][0][0], cases[1][0][0])], "left string, right string")).first()


def test_evidence_of_pairs(spark):
    turned = pair(spark, tracklet("a", "c2", 10, 20, 0, aspect=1.8), tracklet("b", "c4", 10, 20, 0, aspect=0.9, views=("upper", "torso")))
    assert turned.transition and turned.model_support == 3 and turned.mutual_models == 3 and turned.fused >= 0.54
    other = pair(spark, tracklet("a", "c2", 0, 10, 0, aspect=0.9), tracklet("b", "c4", 0, 10, 1, colour=1, aspect=0.9))
    assert other.model_support == 0 and other.fused < 0.54 and other.temporal == 0.5
    alone = pair(spark, tracklet("a", "c2", 0, 10, 0), tracklet("b", "c4", 0, 10, 1, models={"swin": 0}))
    assert alone.model_support == 1 and alone.mutual_models <= 1
    same = pair(spark, tracklet("a", "c1", 0, 4, 0), tracklet("b", "c1", 5, 9, 0, x=(108.0, 112.0)))
    near = 1 - 3 / 180 / 8
    assert same.continuity == pytest.approx(0.65 * (1 - 1 / 30) + 0.35 * near) and same.fused == pytest.approx(0.78 + 0.12 + 0.10 * same.continuity)
    late = pair(spark, tracklet("a", "c1", 0, 5, 0), tracklet("b", "c4", 40, 45, 0))
    assert late.model_support == 3 and late.temporal == 0.0


def test_resolve(spark):
    cases = [
        tracklet("p1", "c1", 0, 5, 0), tracklet("p2", "c1", 6, 10, 0, x=(108.0, 110.0)), tracklet("p3", "c4", 12, 20, 0),  # one person, cut in c1
        tracklet("q1", "c1", 2, 8, 1, colour=1), tracklet("q2", "c4", 0, 9, 1, colour=1),  # another, in both cameras
        tracklet("r1", "c4", 30, 35, 2, colour=2), tracklet("r2", "c4", 33, 39, 2, colour=2),  # alike, but at one time
        tracklet("s1", "c1", 50, 55, 5, models={"swin": 4}), tracklet("s2", "c4", 50, 55, 6, models={"swin": 4}),  # one model only
    ]
    ids, within, across = resolver.resolve(*tables(spark, cases))
    gid = {r.key: r.gid for r in ids.collect()}
    assert set(gid) == {c[0][0] for c in cases}
    assert gid["p1"] == gid["p2"] == gid["p3"] == "G000001" and gid["q1"] == gid["q2"] == "G000002"
    assert len({gid[k] for k in ("p1", "q1", "r1", "r2", "s1", "s2")}) == 6
    assert [(r.left, r.right) for r in within.collect()] == [("p1", "p2")]
    assert sorted((r.left, r.right) for r in across.collect()) == [("p1", "p3"), ("q1", "q2")]


def test_resolve_of_nothing(spark):
    ids, *_ = resolver.resolve(*[t.limit(0) for t in tables(spark, [tracklet("a", "c1", 0, 1, 0)])])
    assert ids.count() == 0


def test_the_fixture_is_resolved(spark):
    ids, *_ = resolver.resolve(*resolver_fixture(spark))
    assert ids.select("gid").distinct().count() == 6
