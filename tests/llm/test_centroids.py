import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import centroids

ODD = "vec_id long, embedding array<double>, cluster string, distance string, sums int"


def brute(rows, k, rounds, dim):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) by Python's integers alone."""
    kept = [(i, x) for i, x in rows if x is not None and len(x) == dim and all(v is not None and math.isfinite(v) for v in x)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    whole = lambda x: [math.floor(Fraction(v) * 256) for v in x]
    c, v = [whole(x) for _, x in first], [whole(x) for _, x in kept]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        of = [near(x)[1] for x in v]
        c = [[sum(x[d] for x, o in zip(v, of, strict=True) if o == j) // of.count(j) for d in range(dim)] if j in of else c[j] for j in range(len(c))]
    best = [near(x) for x in v]
    by = [sum(d for d, o in best if o == j) for j in range(len(c))]
    long = lambda x: x if x < 1 << 63 else None
    return sorted(((i, j, long(d), long(by[j]), long(sum(by)), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, best, strict=True)), key=repr)


def found(df, **settings):
    return sorted((tuple(r) for r in centroids.clustered(df, **settings).collect()), key=repr)


@pytest.mark.parametrize("scale", [1.0, 3e4, 1e9, 1e30])
def test_against_integers(spark, scale):
    # Small components go through BLAS, those of some 3e4 through 64 bits, larger ones through Python's integers.
    rng = np.random.default_rng(int(math.log10(scale)) + 5)
    rows = [(i, [float(v) for v in rng.normal(size=8) * (scale if i % 3 else 1.0)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    settings = {"k": 9, "rounds": 3, "dim": 8}
    assert found(df, **settings) == brute(rows, **settings)


def test_bounds_of_the_tiers():
    at = [[1 << 20, 0], [0, 1 << 20]]
    for big, kind in ((1 << 24, np.int64), (1 << 26, np.int64), (1 << 40, object)):
        q = np.array([[big, big - 1], [big - 1, big], [5, 5]], np.float64)
        cluster, distance = centroids.nearest(q, np.array([True] * 3), at)
        assert cluster.tolist() == [0, 1, 0]
        assert [int(d) for d in distance] == [min((int(x) - a) ** 2 + (int(y) - b) ** 2 for a, b in at) for x, y in q]
        assert distance.dtype == kind or big == 1 << 26


def test_ties_empty_clusters_and_repeats(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(10)] + [(100, [50.0, 50.0])] * 3 + [(None, [0.0, 1.0]), (None, [0.5, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k in (1, 2, 5, 15, 40):
        settings = {"k": k, "rounds": 4, "dim": 2}
        assert found(df, **settings) == brute(rows, **settings)


def test_odd_rows(spark):
    good = [float(i) for i in range(64)]
    rows = [(1, good), (2, None), (3, []), (4, good[:63]), (5, [*good, 1.0]), (6, [*good[:63], None]), (7, [*good[:63], math.nan]), (8, [math.inf, *good[1:]]), (9, [-math.inf, *good[1:]]), (None, good)]
    df = spark.createDataFrame([(i, x, "c", "d", 1) for i, x in rows], ODD)
    out = centroids.clustered(df)
    assert sorted((r.vec_id for r in out.collect()), key=repr) == [1, None]
    assert {r.distance for r in out.collect()} == {0}
    empty = centroids.clustered(df.limit(0))
    assert empty.count() == 0 and empty.columns == out.columns
    assert centroids.clustered(df.where("vec_id = 2")).count() == 0


def test_float_vectors_are_read_as_doubles(spark):
    rows = [(i, [float(np.float32(0.1 * i)), float(np.float32(-1 / 3))]) for i in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert found(df, k=2, rounds=2, dim=2) == brute(rows, 2, 2, 2)
