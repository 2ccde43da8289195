"""Blocks of vectors met two by two, with blocks smaller than the banks, against all pairs at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import blocks, edges, evaluate, evidence, scoring


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(blocks.packed, "__defaults__", (None, 7))
    monkeypatch.setattr(blocks, "SLAB", 20)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    vec = rng.normal(size=(60, 6)).astype(np.float32)
    vec[20:45] = vec[20]  # copies fill more than a block
    return [(int(i), "ab"[i % 2], "xyz"[i % 3], v.tolist()) for i, v in enumerate(vec)] + [(60, "a", "x", None), (61, "a", "x", [0.0] * 6), (62, "b", "y", [1.0, 2.0])]


def unit(rows, good):
    m = np.array([r[3] for r in rows if good(r)], np.float32).astype(float)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def features(spark, rows):
    return spark.createDataFrame(rows, "row long, key string, class string, vec array<float>")


PAIR = [("a", "b")]


def test_best_of_pairs_of_banks(spark, rows):
    f = features(spark, rows)
    pairs = spark.createDataFrame(PAIR, "left string, right string")
    got = {(r.class_l, r.class_r): r for r in blocks.best_of_pairs(f, pairs, [2, 5], 0.3, [("x", "x"), ("x", "y")]).collect()}
    assert set(got) == {("x", "x"), ("x", "y")}
    for (cl, cr), r in got.items():
        cos = np.sort((unit(rows, lambda z: z[0] < 60 and z[1] == "a" and z[2] == cl) @ unit(rows, lambda z: z[0] < 60 and z[1] == "b" and z[2] == cr).T).ravel())[::-1]
        assert (r.n, r.support) == (len(cos), int((cos >= 0.3).sum()))
        assert [r.best, r.top_2, r.top_5] == pytest.approx([cos[0], cos[:2].mean(), cos[:5].mean()], abs=1e-9)


@pytest.mark.parametrize("share", [0.01, 0.25, 0.6, 1.0])
def test_pooled_pairs_take_the_exact_share(spark, rows, share):
    f = features(spark, rows).select("key", "vec")
    r = blocks.pooled_pairs(f, spark.createDataFrame(PAIR, "left string, right string"), share).collect()
    cos = np.sort((unit(rows, lambda z: z[0] < 60 and z[1] == "a") @ unit(rows, lambda z: z[0] < 60 and z[1] == "b").T).ravel())[::-1]
    k = max(1, round(len(cos) * share))
    assert [(x.n, x.max_exemplar, x.consensus) for x in r] == [(len(cos), pytest.approx(cos[0], abs=1e-9), pytest.approx(cos[:k].mean(), abs=1e-9))]


def test_counts_and_extremes_of_a_keys_pairs(spark, rows):
    f = features(spark, rows).where("row < 60").select("row", "key", F.col("class").alias("side"), "vec")
    found = blocks.counted_pairs(f).collect()
    want, low, late = {}, {}, {}
    for key in "ab":
        some = [r for r in rows if r[0] < 60 and r[1] == key]
        u = unit(some, lambda z: True)
        s = np.round(np.clip(u @ u.T, -1, 1), 4)
        for i, x in enumerate(some):
            low[x[0]] = min(s[i, j] for j in range(len(some)) if j != i)
            late[x[0]] = max((s[i, j] for j in range(i + 1, len(some))), default=None)
            for j in range(i + 1, len(some)):
                at = key, x[2], some[j][2], round(float(s[i, j]), 4) + 0.0
                want[at] = want.get(at, 0) + 1
    assert {(r.key, r.side_a, r.side_b, round(r.cos, 4) + 0.0): r.n for r in found} == want
    ends = {r.row: r for r in blocks.extremes(f.drop("side")).collect()}
    assert {k: r.lowest for k, r in ends.items()} == pytest.approx(low)
    assert {k: r.later for k, r in ends.items()} == pytest.approx(late)


def test_figures_from_counts_equal_those_from_pairs(spark):
    values = [0.1, 0.1, 0.1, 0.7, 0.4, 0.9, 0.9, -0.2, 0.3]
    pairs = spark.createDataFrame([("k", v) for v in values], "key string, cos double")
    counts = pairs.groupBy("key", "cos").agg(F.count("*").alias("n"))
    flat = lambda df: [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()]
    assert flat(scoring.pooled_counts(counts, ["key"])) == flat(scoring.pooled(pairs, ["key"]))
    assert flat(scoring.topk_counts(counts, ["key"], 4)) == flat(scoring.topk_means(pairs, ["key"], 4))
    assert flat(evaluate.summary_of_counts(counts, "cos", ["key"])) == flat(evaluate.summary(pairs, "cos", ["key"]))
    assert flat(edges.quorum_of_counts(counts, ["key"], "cos", 0.4, 0.5)) == flat(edges.quorum(pairs, ["key"], "cos", 0.4, 0.5))


def test_support_keeps_queries_without_a_valid_feature(spark):
    f = spark.createDataFrame([("q", 1, 1, "k", [0.0, 0.0]), ("p", 1, 2, "k", [1.0, 0.0]), ("r", 2, 3, "k", [1.0, 0.0])], "query string, gid int, feature int, kind string, vec array<float>")
    bank = spark.createDataFrame([(1, "k", [0.6, 0.8]), (1, "l", [1.0, 0.0])], "gid int, kind string, vec array<float>")
    assert sorted(map(tuple, evidence.support_by_kind(f, bank, 0.5, 0.9).collect())) == [("p", 1, 1, 0), ("q", 1, 0, 0)]


def test_no_pairs_of_banks_are_joined(spark, rows):
    # A join of all vectors of two banks would give a row a pair; blocks give a row a cell.
    f = features(spark, rows).where("row < 60")
    plan = blocks.best_of_pairs(f, spark.createDataFrame(PAIR, "left string, right string"), [3], 0.5)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan


def test_search_over_many_cells_and_slabs_keeps_ties_and_sides(spark, rows, monkeypatch):
    monkeypatch.setattr(edges, "STEP", 5)
    monkeypatch.setattr(edges, "STRIP", 4)
    f = features(spark, rows).where("row < 62")
    some = [r for r in rows if r[0] < 62 and r[3]]
    m = np.array([r[3] for r in some], np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True) + 1e-12
    s = np.round(np.clip(m @ m.T, -1, 1), 4)
    for k, side in ((1, None), (4, None), (3, "class")):
        got = {(r.query, r.rank): (r.hit, r.score) for r in edges.search(f, f, "row", "vec", k, side, size=20).collect()}
        want = {}
        for i, x in enumerate(some):
            order = sorted((-s[i, j], y[0]) for j, y in enumerate(some) if j != i and (side is None or x[2] != y[2]))
            want |= {(x[0], n + 1): (h, pytest.approx(-c)) for n, (c, h) in enumerate(order[:k])}
        assert got == want


def test_a_cell_of_search_holds_no_more_than_a_slab():
    import tracemalloc

    m = np.random.default_rng(0).normal(size=(8_192, 16))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    rank = np.arange(len(m))
    tracemalloc.start()
    edges._best_in_cell(m[:1_024], m, rank[:1_024], rank, None, None, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
