"""Every query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__
from tessera.operators.cluster import hungarian
from tessera.plans import registry

DIR = os.environ.get("TESSERA_TEST_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def rounded(x):
    return round(x, 6) if isinstance(x, float) else tuple(map(rounded, x)) if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_duckdb(spark, duck, name):
    found = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in found.description]
    want = sorted((tuple(map(rounded, r)) for r in found.fetchall()), key=repr)
    df = registry.QUERIES[name](spark, DIR)
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(map(rounded, r)) for r in df.select(*columns).collect()), key=repr) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_matchings_see_all_competitors(spark, tmp_path):
    # Sixteen a camera, all alike: more than the ten or five nearest compete for each.
    rng = np.random.default_rng(4)
    vec = np.abs(rng.normal(size=(64, 12))) + 1.0
    spark.createDataFrame([(i, i // 4, v.tolist()) for i, v in enumerate(vec)], "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    unit = np.float32(vec).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    best = {(r.ca, r.cb): (r.n_matched, r.total) for r in registry.QUERIES["assignment_totals"](spark, str(tmp_path)).collect()}
    greedy = {(r.ca, r.cb): r.n_matched for r in registry.QUERIES["greedy_matching_totals"](spark, str(tmp_path)).collect()}
    assert set(best) == set(greedy) == {(a, b) for a in range(4) for b in range(a + 1, 4)}
    for (a, b), (n, total) in best.items():
        gain = np.round(unit[a::4] @ unit[b::4].T, 4)
        assert n == greedy[a, b] == 16
        assert total == pytest.approx(sum(gain[i, j] for i, j in hungarian(gain)), abs=2e-3)
