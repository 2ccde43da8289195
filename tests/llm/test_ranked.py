import itertools
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import ranked

ODD = "doc_id long, text string, rank string, score string, item_id int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top):
    said = [terms(t) for _, t in docs]
    n_docs, total = sum(map(bool, said)), sum(map(len, said))
    df = Counter(t for words in said for t in set(words))
    out = []
    for item, text in items:
        scored = []
        for (i, _), words in zip(docs, said, strict=True):
            tf, m = Counter(words), 100 - 25 + (25 * len(words) * n_docs) // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in terms(text) if tf[t])
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank, s[2], -s[0]) for rank, s in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, parts=3, **settings):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    return sorted((tuple(r) for r in ranked.search(d, spark.createDataFrame(items, "item_id long, text string"), **settings).collect()), key=repr)


def corpus(seed, n=300, vocabulary=60):
    rng = np.random.default_rng(seed)
    words = np.array([f"w{i}" for i in range(vocabulary)] + ["Straße", "naïve", "日本", "X9", "x9"])
    p = 1 / np.arange(1, len(words) + 1)
    seps = [" ", "  ", "\n", ", ", "-", "_"]
    text = lambda k: "".join(w + seps[rng.integers(len(seps))] for w in rng.choice(words, k, p=p / p.sum()))
    docs = [(int(i), text(rng.integers(0, 200))) for i in rng.permutation(n)]
    return docs + docs[:40], [(j, text(rng.integers(1, 40))) for j in range(25)]


def test_against_brute_force(spark, monkeypatch):
    docs, items = corpus(1)
    want = brute(docs, items, 20)
    assert found(spark, docs, items) == want
    monkeypatch.setattr(ranked, "SLICE", 4000)  # many shards a task
    assert found(spark, docs, items, parts=2) == want
    monkeypatch.setattr(ranked, "ITEM_TERMS", 60)  # many passes
    assert found(spark, docs, items[:9]) == brute(docs, items[:9], 20)


def test_terms_are_the_pattern(spark):
    texts = ["", None, "a", "A-b_c.9", "é😀x", "\x00\x7f", "İSTANBUL Kelvin K", "end", "x" * 70_000, "tail "]
    owner, got = ranked.terms(pa.array(texts, pa.string()))
    assert [(int(o), t.decode()) for o, t in zip(owner, got.to_pylist(), strict=True)] == [(i, t) for i, x in enumerate(texts) for t in terms(x)]
    part = pa.array(texts, pa.string()).slice(2, 4)
    assert [t.decode() for t in ranked.terms(part)[1].to_pylist()] == [t for x in texts[2:6] for t in terms(x)]


def test_boundaries_cost_least():
    rng = np.random.default_rng(2)
    for trial in range(30):
        lengths = rng.integers(0, 9, 4)
        starts = np.r_[0, np.cumsum(lengths)]
        scores = rng.integers(1, 50, starts[-1]).astype(float)
        texts = np.concatenate([np.sort(rng.choice(30, n, replace=False)) for n in lengths]).astype(np.int64)
        price = [0.1, 1.0, 8.0][trial % 3]
        ends = ranked.boundaries(scores, texts, starts, 4, price)
        for a, b in itertools.pairwise(starts):
            cost = lambda cuts, a=a, b=b: sum((texts[y - 1] + 1 - texts[x]) * scores[x:y].max() + price * scores[a:b].mean() for x, y in itertools.pairwise((a, *cuts, b)))
            if a < b:
                ways = [c for r in range(b - a) for c in itertools.combinations(range(a + 1, b), r) if all(y - x <= 4 for x, y in itertools.pairwise((a, *c, b)))]
                assert ends[b - 1]
                assert cost([i + 1 for i in range(a, b - 1) if ends[i]]) == pytest.approx(min(map(cost, ways)))


def test_bounds_hold_and_pass_over_documents():
    docs, items = corpus(3, 3000, 2000)
    column = pa.array([t for _, t in docs])
    group = ranked._indexed([(i, [t.encode() for t in terms(x)]) for i, x in items])
    n, term, _, _ = ranked._pairs(column, group.vocabulary)
    df = np.bincount(term, minlength=len(group.vocabulary))
    shard = ranked.Shard(column, group, np.array([ranked.weight(len(docs), int(x)) for x in df]), len(docs), int(n.sum()))
    for wanted in group.wanted:
        scores = shard.score(wanted, np.arange(shard.size))
        assert (shard.bounds(wanted) >= scores).all()
    shard.scored = 0
    for wanted in group.wanted:
        ranked.look(shard, wanted, ranked.Best(20), np.arange(shard.size), np.zeros(shard.size, bool))
    assert shard.scored < 0.3 * shard.size * len(items)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (None, "alpha beta"), (None, "alpha"), (3, "alpha beta"), (3, "alpha beta"), (4, "gamma " * 30_000), (5, "!!!"), (6, "ALPHA, alpha")]
    items = [(7, "alpha"), (7, "alpha"), (8, None), (9, "..."), (None, "gamma alpha"), (10, "nowhere")]
    assert found(spark, docs, items) == brute(docs, items, 20)
    rows = spark.createDataFrame([(i, t, "r", "s", 1) for i, t in docs], ODD)
    wide = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id long")
    assert sorted((tuple(r) for r in ranked.search(rows, wide).collect()), key=repr) == brute(docs, items, 20)
    assert ranked.search(rows.limit(0), wide).count() == 0
    out = ranked.search(rows, wide.limit(0))
    assert out.count() == 0 and out.columns == ["item_id", "rank", "doc_id", "score"]


def test_ties_go_to_smaller_ids(spark):
    docs = [(int(i), "same words here") for i in np.random.default_rng(5).permutation(200)]
    assert [r[2] for r in sorted(found(spark, docs, [(0, "words")], parts=8), key=lambda r: r[1])] == list(range(20))
