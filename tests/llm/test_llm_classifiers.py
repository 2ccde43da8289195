import os
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import calibration, decontamination, quality, rules, toxicity
from tessera.llm.common import labelled_sample, table

DIR = os.environ.get("TESSERA_TEST_DIR", "/root/testdata/sf0.001").replace("sf0.001", "sf0.01")


def held_out(scores, labels, column):
    marks = {r.doc_id: r[column] for r in labels.collect()}
    rows = [r for r in scores.collect() if r.held_out and r.doc_id in marks]
    return [(marks[r.doc_id], r.predicted, r.score) for r in rows]


def test_quality_on_held_out_rows(spark):
    docs, labels = table(spark, DIR, "documents"), table(spark, DIR, "labels")
    found = quality.scores(docs, labels)
    assert found.count() == docs.count()
    rows = held_out(found, labels, "quality")
    assert all(0 <= s <= 1 for *_, s in rows) and sum(y == p for y, p, _ in rows) >= 0.95 * len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found.collect())
    # labels of held-out rows are not read
    other = labels.withColumn("quality", F.when(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"), 0).otherwise(F.col("quality")))
    a = sorted((r.doc_id, round(r.score, 6)) for r in found.collect())
    assert a == sorted((r.doc_id, round(r.score, 6)) for r in quality.scores(docs, other).collect())


def test_toxicity_on_held_out_rows(spark):
    docs, labels = table(spark, DIR, "documents"), table(spark, DIR, "labels")
    found = toxicity.scores(docs, labels)
    assert found.count() == docs.count()
    rows = held_out(found, labels, "toxic")
    assert sum(y == p for y, p, _ in rows) >= 0.9 * len(rows)
    english = {r.doc_id for r in docs.where("lang = 'en'").collect()}
    marks = {r.doc_id: r.toxic for r in labels.collect()}
    caught = [r.predicted for r in found.collect() if r.held_out and r.doc_id in english and marks.get(r.doc_id) == 1]
    assert np.mean(caught) >= 0.9


def test_counts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_COUNTED", 1)
    docs = spark.createDataFrame([(1, "a b"), (2, "b b c"), (3, None)], "doc_id long, text string").repartition(2)
    marks = labelled_sample(spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"), 10)
    got = {r.token: (r.toxic, r.clean, r.every) for r in toxicity.counted(docs, marks).collect()}
    assert got == {"a": (1, 0, 1), "b": (1, 1, 2), "c": (0, 1, 1)}


def test_segments_against_all_subsegments():
    rng = np.random.default_rng(1)
    for _ in range(200):
        given = [0.6 if x < 0.3 else 0.0 for x in rng.random(int(rng.integers(0, 14)))]
        got = toxicity.segments(given, 0.25)
        scores = [x or -0.25 for x in given]
        best = max((sum(scores[i:j]) for i in range(len(given)) for j in range(i + 1, len(given) + 1)), default=0)
        assert not got if best <= 0 else max(s for *_, s in got) == pytest.approx(best)
        assert all(a < b for a, b, _ in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:], strict=False))
        assert all(sum(scores[a:b]) == pytest.approx(s) for a, b, s in got)


def by_recursion(scores, first=0):
    """Maximal segments as they are defined: the best contiguous one (the shortest of ties), then those left and right of it."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            x = sum(scores[i:j])
            if x > 0 and (best is None or x > best[0] + 1e-9 or (abs(x - best[0]) < 1e-9 and j - i < best[2] - best[1])):
                best = (x, i, j)
    if best is None:
        return []
    x, i, j = best
    return by_recursion(scores[:i], first) + [(first + i, first + j, x)] + by_recursion(scores[j:], first + j)


def test_segments_against_the_definition():
    rng = np.random.default_rng(8)
    for _ in range(300):
        given = [float(rng.choice([0.31, 0.77, 1.9])) * (1 + rng.random() / 50) if x < 0.4 else 0.0 for x in rng.random(int(rng.integers(0, 22)))]
        got = toxicity.segments(given, 0.25)
        want = by_recursion([x or -0.25 for x in given])
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])
        given = [x or -float(rng.choice([0.0, 0.0, 0.4, 1.1])) * (1 + rng.random() / 50) for x in given]
        got = toxicity.segments(given, 0.25)
        want = by_recursion([x or -0.25 for x in given])
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_a_million_hits_take_linear_time():
    began = time.time()
    scores = np.zeros(10_000_000)
    scores[::10] = 1.3
    assert len(toxicity.segments(scores.tolist())) == 1_000_000
    assert time.time() - began < 40


def test_lexicon_law_and_scores_against_plain_python(spark):
    """The whole of op3 on a small corpus: counts, prior, log-odds, beginnings, segments, law, evidence, calibration."""
    rng = np.random.default_rng(12)
    vile, plain = ["vile", "viles", "vileness", "rotten"], [f"word{i}" for i in range(40)]
    docs, labels = [], []
    for d in range(240):
        own = [plain[i] for i in rng.integers(0, 40, int(rng.integers(5, 40)))]
        if d % 3 == 0:
            own[2:2] = [vile[i] for i in rng.integers(0, 4, 5)]
        else:
            own[1:1] = ["kind", "gentle"][: int(rng.integers(1, 3))]  # words of clean texts alone
        docs.append((d, " ".join(own)))
        if d % 2 == 0:
            labels.append((d, int(d % 3 == 0)))
    got = {r.doc_id: r for r in toxicity.scores(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}

    folds = {d: zlib.crc32(str(d).encode()) % 4 for d, _ in docs}
    learn = {d: y for d, y in labels if folds[d] in (0, 1)}
    counts = {}
    for d, text in docs:
        for w in set(text.split()):
            c = counts.setdefault(w, [0, 0, 0])
            c[2] += 1
            if d in learn:
                c[0 if learn[d] else 1] += 1
    sums = [sum(c[i] for c in counts.values()) for i in range(3)]
    terms = {w: list(c) for w, c in counts.items()}
    for w, c in counts.items():
        if len(w) > 3 and c[0] + c[1] > 0:
            for k in range(3, min(8, len(w) - 1) + 1):
                own = terms.setdefault(w[:k] + "*", [0, 0, 0])
                for i in range(3):
                    own[i] += c[i]
    whole = toxicity.PRIOR + toxicity.FLAT_PRIOR * len(counts)
    lexicon = {}
    for w, (t, c, e) in terms.items():
        prior = e / sums[2] * toxicity.PRIOR + toxicity.FLAT_PRIOR
        a, b = t + prior, c + prior
        odds = np.log(a / (sums[0] + whole - a)) - np.log(b / (sums[1] + whole - b))
        error = 1.96 * np.sqrt(1 / a + 1 / b)
        if t > 1 and odds > error:
            lexicon[w] = odds - error
        elif c > 1 and odds < -error and not w.endswith("*"):
            lexicon[w] = odds + error - toxicity.DRIFT
    assert min(lexicon.values()) < -toxicity.DRIFT and max(lexicon.values()) > 0

    def score(w):
        best = max([lexicon.get(w, 0.0)] + [lexicon.get(w[:k] + "*", 0.0) for k in range(3, min(8, len(w) - 1) + 1)])
        return best if best > 0 else lexicon.get(w, 0.0)

    found = {d: by_recursion([score(w) or -toxicity.DRIFT for w in text.split()]) for d, text in docs}
    known = {d: y for d, y in labels if folds[d] == 3}
    hits = [score(w) for d, text in docs if known.get(d) == 0 for w in text.split() if score(w)]
    n_clean = sum(len(text.split()) for d, text in docs if known.get(d) == 0)
    lam, k = 1.0, 0.1
    if max(hits, default=0.0) > 0:
        steps = [-toxicity.DRIFT] * (n_clean - len(hits)) + [(min(255, np.floor(x * 16)) + 0.5) / 16 for x in hits]
        lam = next(x for x in np.arange(0.001, 64, 0.001) if np.mean(np.exp(x * np.array(steps))) >= 1)
        clean_scores = [x for d in found if known.get(d) == 0 for *_, x in found[d]]
        k = len(clean_scores) / n_clean * np.exp(lam * min(clean_scores))
    evidence = {}
    for d, text in docs:
        expected = {(a, b): k * len(text.split()) * np.exp(-lam * x) for a, b, x in found[d]}
        mine = {(x["first"], x["end"]): x["expected"] for x in got[d].passages}
        sure = {s: x for s, x in expected.items() if abs(x - toxicity.SIGNIFICANT) > 0.01 * toxicity.SIGNIFICANT}
        assert {s for s, x in sure.items() if x < toxicity.SIGNIFICANT} == {s for s in mine if s in sure}
        assert all(x == pytest.approx(expected[s], rel=0.03) for s, x in mine.items())
        evidence[d] = sum(-np.log10(x) for x in mine.values())
        assert got[d].held_out == (folds[d] == 2)
    # Scores rise with the evidence, and separate the two kinds.
    order = sorted(evidence, key=evidence.get)
    assert all(got[a].score <= got[b].score + 1e-9 for a, b in zip(order, order[1:], strict=False))
    assert any(evidence[d] > 0 for d in evidence if d % 3 == 0) and not any(evidence[d] > 0 for d in evidence if d % 3)


def test_ridge_against_one_machine(spark):
    rng = np.random.default_rng(6)
    stats = rng.normal(size=(300, quality.N_STATS)).astype(np.float32)
    label = (stats[:, 0] + stats[:, 3] > 0).astype(float)
    features = quality.Fourier(np.zeros(quality.N_STATS), np.ones(quality.N_STATS))
    train = spark.createDataFrame([(x.tolist(), float(y)) for x, y in zip(stats, label, strict=True)], "stats array<float>, label double").repartition(5)
    z = features(stats.astype(np.float64))
    want = np.linalg.solve(z.T @ z / 300 + quality.RIDGE * np.eye(z.shape[1]) / z.shape[1], z.T @ label / 300)
    got = quality.fit_ridge(train, features)
    assert np.allclose(z @ got, z @ want, atol=1e-6)


def test_fourier_features_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(40, quality.N_STATS))
    z = quality.Fourier(np.zeros(quality.N_STATS), np.ones(quality.N_STATS), size=20_000)(x)[:, :-1]
    far = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.allclose(z @ z.T, np.exp(-far / (2 * quality.N_STATS)), atol=0.05)


def test_isotonic_against_brute_force(spark):
    rows = [(0.1, 0.0), (0.2, 1.0), (0.3, 0.0), (0.4, 1.0), (0.6, 1.0)]
    x, y = calibration.fit_isotonic(spark.createDataFrame(rows, "raw double, label double"), 0.0, 1.0, 64)
    assert y.tolist() == pytest.approx([0.0, 0.5, 1.0]) or y.tolist() == pytest.approx([0.0, 0.5, 1.0, 1.0])
    assert calibration.apply_isotonic(np.array([-5.0, 9.0]), (x, y)).tolist() == [0.0, 1.0]
    none = calibration.fit_isotonic(spark.createDataFrame([], "raw double, label double"), 0.0, 1.0)
    assert calibration.apply_isotonic(np.array([0.3]), none).tolist() == [0.5]


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_base_counts_against_brute_force():
    rng = np.random.default_rng(2)
    texts = [None, "", " \n\t", "é|é# a\x1cb", "a\n\na\n a\nb\nb"]
    for _ in range(60):
        words = [["a", "b", "éü", "c|", "d#"][i] for i in rng.integers(0, 5, 3)] * int(rng.integers(0, 8)) + [f"w{x}" for x in rng.integers(0, 9, int(rng.integers(0, 30)))]
        texts.append("".join(w + [" ", "\n", "\t", "  "][int(rng.integers(0, 4))] for w in words))
    column = pa.array(texts, pa.string())
    got = rules.base_counts(column, rules.Words(column))
    for i, t in enumerate(texts):
        assert tuple(int(got[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_base(t)


def test_rules_keep_clean_documents(spark):
    docs, labels = table(spark, DIR, "documents"), table(spark, DIR, "labels")
    found = {r.doc_id: r for r in rules.judged(docs, labels).collect()}
    good = [found[r.doc_id] for r in labels.where("quality = 1").collect() if r.doc_id in found and not found[r.doc_id].base_failed]
    bad = [found[r.doc_id] for r in labels.where("quality = 0").collect() if r.doc_id in found]
    assert np.mean([r.kept for r in good]) >= 0.98 and np.mean([not r.kept for r in bad]) >= 0.9
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in found.values())


def test_ratios_against_brute_force(spark):
    texts = {1: "a b a", 2: "a c", 3: "b b"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(1, 1), (2, 0), (9, 1), (None, 1)], "doc_id long, quality int")
    got = rules.ratios(docs, labels)
    assert np.array_equal(got, rules.ratios(docs, labels, most_broadcast=0))
    raw, trusted = np.zeros(rules.BUCKETS), np.zeros(rules.BUCKETS)
    for d, t in texts.items():
        for b in rules.buckets(rules.Words(pa.array([t])))[0]:
            raw[b] += 1
            trusted[b] += d == 1
    p, q = ((x + rules.SMOOTHING) / (x.sum() + rules.SMOOTHING * rules.BUCKETS) for x in (trusted, raw))
    assert np.allclose(got, np.log(p / q), atol=1e-5)


def test_ids_beyond_doubles_beside_nulls(spark):
    big = 2**53 + 1
    texts = [(big, "good words here"), (big - 1, "other words there"), (None, "none at all")]
    labels = spark.createDataFrame([(big, 1)], "doc_id long, quality int")
    got = rules.ratios(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), labels)
    own = set(rules.buckets(rules.Words(pa.array(["good words here"])))[0].tolist())
    other = set(rules.buckets(rules.Words(pa.array(["other words there"])))[0].tolist())
    assert all(got[b] > 0 for b in own - other) and all(got[b] < 0 for b in other - own)


ODD = [(1, None, None, None), (2, "", "x", 1), (None, "some words here", "y", 2), (3, "word " * 30_000, None, 3), (3, "word " * 30_000, None, 3), (4, "\x00 ퟿ ok", "z", 4)]


def test_odd_tables(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, label string, stats int")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 1), (3, 0, 0), (None, 1, 1), (77, None, None)], "doc_id long, quality int, toxic int")
    for marks in (labels, labels.limit(0)):
        for run in (quality.scores, toxicity.scores, rules.judged):
            assert run(docs, marks).count() == len(ODD)
            assert run(docs.limit(0), marks).count() == 0
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= len(ODD)
    assert {r.score for r in quality.scores(docs, labels.limit(0)).collect()} == {0.5}
    assert decontamination.clean(docs, spark.createDataFrame([(1, "other words entirely")], "item_id long, text string")).count() == len(ODD)
