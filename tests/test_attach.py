"""Attach passes against a plain fold."""

import numpy as np

from tessera.operators.attach import Attach, attached, group_score


def plain(nodes, members, features, rule):
    span = {k: (c, s, e) for k, c, s, e in nodes}
    unit = lambda v: np.asarray(v) / np.linalg.norm(v)
    vecs = {k: np.stack([unit(v) for q, _, v in sorted(features, key=lambda f: (f[0], f[1])) if q == k]) for k in span}
    clash = lambda a, b: any(span[x][0] == span[y][0] and not (span[x][2] < span[y][1] or span[y][2] < span[x][1]) for x in a for y in b if x != y)
    of = dict(members)
    for _ in range(rule.passes):
        groups = {}
        for k, c in of.items():
            groups.setdefault(c, []).append(k)
        joins = []
        for c, ks in groups.items():
            if len(ks) > 1:
                continue
            fits = sorted((-group_score(vecs[ks[0]], np.concatenate([vecs[m] for m in sorted(g)]), rule), o) for o, g in groups.items() if o != c and not clash(ks, g))
            second = -fits[1][0] if len(fits) > 1 else 0.0
            if fits and -fits[0][0] >= rule.threshold and (round(-fits[0][0] - second, 4) >= rule.margin or -fits[0][0] >= rule.strong):
                joins.append((fits[0][0], c, fits[0][1]))
        merged = False
        for _, a, b in sorted(joins):
            x, y = sorted((of[a], of[b]))
            left, right = [k for k in of if of[k] == x], [k for k in of if of[k] == y]
            if x != y and not clash(left, right):
                of = {k: x if c == y else c for k, c in of.items()}
                merged = True
        if not merged:
            break
    return of


def test_passes_against_a_plain_fold(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 10))
    nodes, features, members = [], [], {}
    for i in range(24):
        key, start = f"{'abc'[i % 3]}:{i:02}", float(rng.integers(0, 300))
        nodes.append((key, key[0], start, start + 20.0))
        features += [(key, j, (centres[i % 4] + rng.normal(size=10) * 0.7).tolist()) for j in range(5)]
        members[key] = key
    span = {n[0]: n for n in nodes}
    groups = {}
    for key in sorted(members)[:12]:  # half of them are in groups already
        g = groups.setdefault(int(key[2:]) % 4, [])
        if all(span[key][1] != span[o][1] or span[key][3] < span[o][2] or span[o][3] < span[key][2] for o in g):
            g.append(key)
            members[key] = g[0]
    rule = Attach(threshold=0.6, margin=0.02)
    want = plain(nodes, members, features, rule)
    got = attached(spark.createDataFrame(nodes, "key string, camera string, start double, end double"), spark.createDataFrame(list(members.items()), "key string, component string"), spark.createDataFrame(features, "key string, seq int, vec array<double>"), rule)
    assert {r.key: r.component for r in got.collect()} == want
    assert len(set(want.values())) < len(set(members.values()))


def test_nothing_to_attach(spark):
    nodes = spark.createDataFrame([("a", "a", 0.0, 1.0), ("b", "a", 0.5, 2.0)], "key string, camera string, start double, end double")
    members = nodes.selectExpr("key", "key AS component")
    features = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("b", 0, [1.0, 0.0])], "key string, seq int, vec array<double>")
    assert {r.key: r.component for r in attached(nodes, members, features).collect()} == {"a": "a", "b": "b"}
    assert attached(nodes.limit(0), members.limit(0), features.limit(0)).count() == 0
