"""The local solver against a plain one that asks every identity each time, and its time on many that are alike to none."""

import time

import numpy as np
import pytest

from tessera.operators import identity


def plain(rows, bar, margin, seed, merge_bar, bank=24):
    vecs = {k: np.asarray(v, float) / (np.linalg.norm(v) + 1e-12) for k, *_, v in rows}
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    span, proof = {r[0]: (r[1], r[2]) for r in rows}, {r[0]: r[3] for r in rows}
    groups, why = {}, {}
    meets = lambda i, g: any(not (span[i][1] < span[j][0] or span[j][1] < span[i][0]) for j in groups[g])
    score = lambda i, g: float(np.mean(sorted((float(vecs[j] @ vecs[i]) for j in groups[g][-bank:]), reverse=True)[:3]))

    def join(i):
        found = sorted(((score(i, g), -g) for g in groups if not meets(i, g)), reverse=True)
        if not found or round(found[0][0], 4) < bar or len(found) > 1 and found[0][0] - found[1][0] < margin:
            return False
        groups[-found[0][1]].append(i)
        why[i] = "matched"
        return True

    def new(i, reason):
        groups[max(groups, default=0) + 1] = [i]
        why[i] = reason

    waiting = []
    for i in span:
        if not join(i):
            if proof[i] >= seed and all(meets(i, g) or score(i, g) < bar for g in groups):
                new(i, "seeded")
            else:
                waiting.append(i)
    waiting.sort(key=lambda i: (-proof[i], span[i][0], i))
    while waiting:
        still = [i for i in waiting if not join(i)]
        if len(still) == len(waiting):
            new(still.pop(0), "founded")
        waiting = still
    changed = True
    while changed:
        changed = False
        for a in sorted(groups):
            for b in sorted(groups):
                if a < b and a in groups and b in groups and not any(meets(i, a) for i in groups[b]):
                    s = sorted((float(vecs[i] @ vecs[j]) for i in groups[a] for j in groups[b]), reverse=True)[:5]
                    if np.mean(s) >= merge_bar:
                        groups[a] += groups.pop(b)
                        changed = True
    return {k: (g, why[k]) for g, ks in groups.items() for k in ks}


SCHEMA = "key long, camera string, start double, end double, evidence double, vec array<double>"


@pytest.mark.parametrize("seed", range(6))
def test_equals_the_plain_solver(spark, seed, monkeypatch):
    monkeypatch.setattr(identity, "NEAR_SLAB", 500)
    rng = np.random.default_rng(seed)
    people = rng.normal(size=(9, 5))
    rows = [(i, float(t := rng.uniform(0, 60)), float(t + rng.uniform(0.1, 4)), float(rng.choice([0.5, 0.7])), (people[rng.integers(9)] + rng.normal(size=5) * 0.45).tolist()) for i in range(120)]
    bars = (0.85, 0.03, 0.68, 0.88)
    df = spark.createDataFrame([(k, "c", s, e, p, v) for k, s, e, p, v in rows], SCHEMA).repartition(1)
    got = {r.key: (r.gid, r.reason) for r in identity.solve_local(df, bars[0], bars[1], bars[2], bars[3]).collect()}
    want = plain(rows, *bars)
    assert got == want
    assert len({g for g, _ in want.values()}) > 9


def test_many_identities_take_seconds(spark):
    # Three thousand that are alike to none: asking every identity each time took minutes.
    vec = np.random.default_rng(1).normal(size=(3_000, 64))
    df = spark.createDataFrame([(i, "c", float(i), i + 0.5, 0.7, v.tolist()) for i, v in enumerate(vec)], SCHEMA)
    identity.solve_local(df.limit(1)).collect()
    at = time.time()
    assert identity.solve_local(df).select("gid").distinct().count() == 3_000
    assert time.time() - at < 30
