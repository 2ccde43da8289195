"""Rounds of reconciliation compare what grew, and find what comparing everything finds."""

import numpy as np
import pytest

from tessera.operators import reconcile


@pytest.fixture(scope="module")
def seen(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(6, 8))
    rows = [(f"t{t:02d}", f"c{t % 3}", float(10 * t + i), (centre[t % 6] + 0.45 * rng.normal(size=8)).tolist()) for t in range(42) for i in range(3)]
    return spark.createDataFrame(rows, "key string, camera string, ts double, vec array<double>").cache()


def run(seen, monkeypatch, anew):
    asked, real, search = [], reconcile._round, reconcile.over
    monkeypatch.setattr(reconcile, "over", lambda q, *rest: asked.append(q.count()) or search(q, *rest))
    if anew:
        monkeypatch.setattr(reconcile, "_round", lambda nodes, members, same, settings, had: real(nodes, members, same, settings))
    out = sorted(map(tuple, reconcile.reconcile(seen, reconcile.Settings(same_camera=0.7, cross_camera=0.6)).collect()))
    monkeypatch.undo()
    return out, asked


def test_rounds_compare_grown_groups_alone(seen, monkeypatch):
    got, few = run(seen, monkeypatch, False)
    want, many = run(seen, monkeypatch, True)
    assert got == want and len({c for _, _, c in got}) < 42
    assert len(few) == len(many) > 4 and sum(few) < 0.8 * sum(many)
