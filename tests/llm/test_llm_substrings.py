import hashlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import substrings as ss


def brute(docs):
    seen, out = {}, {}
    for d, text in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 99):
            w = raw[i : i + 100]
            if w in seen:
                gone[i : i + 100] = True
            else:
                seen[w] = d
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out[d] = len(raw), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()
    return out


def corpus(seed):
    rng = np.random.default_rng(seed)
    letters = np.array(list("abcdé \n"))
    word = lambda n, k=7: "".join(letters[rng.integers(0, k, n)])
    passage, docs = word(260), []
    for i in range(30):
        parts = [word(int(rng.integers(0, 300)))]
        if rng.random() < 0.5:
            a = int(rng.integers(0, 150))
            parts.append(passage[a : a + int(rng.integers(60, 200))])
        if rng.random() < 0.3:
            parts.append("ab" * int(rng.integers(0, 200)))
        if docs and rng.random() < 0.3:
            other = docs[int(rng.integers(0, len(docs)))][1]
            at = int(rng.integers(0, max(1, len(other))))
            parts = [other[:at] + "X" + other[at:]]
        docs.append((i * 3, "".join(parts)))
    return docs + [(1, ""), (2, None), (4, "x" * 99), (5, "x" * 100), (7, "x" * 350)]


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(ss, "SLICE", 900)
    monkeypatch.setattr(ss, "CHUNK", 2000)
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in ss.cleaned(df).collect()}
    assert got == brute(docs)


def test_small_batches(spark, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        docs = corpus(11)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in ss.cleaned(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
        assert got == brute(docs)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("most", [2, 5])
def test_large_buckets_are_refined_in_steps(spark, monkeypatch, most):
    monkeypatch.setattr(ss, "MOST_TOGETHER", most)
    docs = corpus(5 + most)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in ss.cleaned(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute(docs)


def test_narrowed_buckets_keep_every_string_and_part_unequal_ones(spark):
    rng = np.random.default_rng(1)
    rows, strings = [], []
    for d in range(12):
        ahead, low = int(rng.integers(40, 77)), int(rng.integers(0, 40))
        text = bytes(rng.integers(97, 99, ahead - low + 100).astype(np.uint8)) if d % 3 else b"a" * (ahead - low + 100)
        rows.append((7, d, 1000 << 30, ahead, text))
        strings += [(d, 1000 + i, text[i : i + 100]) for i in range(ahead - low + 1)]
    texts, large = spark.createDataFrame(rows, ss.CONTEXT), spark.createDataFrame([(7,)], "large long")
    for width in ss.WIDTHS:
        out = ss.narrowed(texts, large, width).collect()
        got = [(r.doc, (r.place >> 30) + i, bytes(r.text[i : i + 100]), r.bucket, r.ahead - i) for r in out for i in range(len(r.text) - 99)]
        assert sorted(x[:3] for x in got) == sorted(strings)
        buckets, of = {}, {}
        for *_, string, bucket, at in got:
            assert buckets.setdefault((string, at), bucket) == bucket  # equal strings at equal anchors stay together
            assert width > 1 or of.setdefault(bucket, (string, at)) == (string, at)


def test_refinement_numbers_equal_strings_alike():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    data[250:400] = data[20:170]
    at = np.arange(301)
    got = ss.refine(data, at)
    raw = data.tobytes()
    for i in range(301):
        for j in range(i):
            same = raw[i : i + 100] == raw[j : j + 100]
            assert (got[i] == got[j] and got[i] >= 0) == same


def test_odd_tables(spark):
    text = "".join(chr(x) for x in np.random.default_rng(0).integers(97, 123, 240))
    rows = [(None, text, 1, "p"), (3, text, 2, "q"), (3, text, 2, "q"), (8, "no" + text, 3, None), (9, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc int, place string")
    got = {str(r.doc_id): (r.n_removed, r.n_spans) for r in ss.cleaned(docs).collect()}
    assert got == {"None": (0, 0), "3": (240, 1), "8": (240, 1), "9": (0, 0)}
    assert ss.cleaned(docs).count() == 5 and ss.cleaned(docs.limit(0)).count() == 0
    two = spark.createDataFrame([(1, text), (1, "zz" + text), (2, text)], "doc_id long, text string")
    assert sorted(r.n_removed for r in ss.cleaned(two).collect()) == [0, 240, 240]


@pytest.mark.parametrize("n", [100, 255, 256, 278, 279, 280, 1000, 5000])
def test_anchors_of_texts_longer_than_the_position_bits(monkeypatch, n):
    monkeypatch.setattr(ss, "_LOW", np.uint64(255))
    text = "".join(np.random.default_rng(n).choice(list("abc"), n))
    r = ss.Runs(pa.array([text[:150], text]))
    gram = np.array([int(x) & ~255 for x in ss.mix(sum(ss.grams8(r.data)[8 * k : len(r.data) - ss.GRAM + 1 + 8 * k] * ss._C[k] for k in range(3)))], object)
    seen = 0
    for first, last, anchor, row in zip(r.first.tolist(), r.last.tolist(), r.anchor.tolist(), r.row.tolist(), strict=True):
        assert r.starts[row] <= first <= last <= r.starts[row + 1] - ss.LENGTH
        for i in range(first, last + 1):
            assert anchor == min(range(i, i + ss.SPAN), key=lambda p: (gram[p], p))
        seen += last - first + 1
    assert seen == max(0, min(n, 150) - 99) + n - 99


def test_repeats_past_8_mb_of_a_text(spark):
    rng = np.random.default_rng(3)
    word = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes().decode()
    passage, head, tail = word(300), word((1 << 23) + 5000), word(400)
    docs = [(1, word(50) + passage + word(70)), (2, head + passage + tail), (3, word(30) + tail)]
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in ss.cleaned(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == {1: (0, 0, sha(docs[0][1])), 2: (300, 1, sha(head + tail)), 3: (400, 1, sha(docs[2][1][:30]))}


def test_null_and_repeated_ids_in_number(spark):
    # Far more of each than the bits that once told them apart: documents of their own, in the order of their MD5.
    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    shared = [word(110) for _ in range(40)]
    text = lambda i: word(30) + (shared[i % 40] if i % 3 else word(110)) + word(20)
    docs = [(None, text(i)) for i in range(3000)] + [(7, text(i)) for i in range(3000)] + [(i, text(i)) for i in range(100, 300)]
    docs += docs[:50] + docs[3000:3050]
    order = sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0, hashlib.md5(d[1].encode()).digest()))
    want = brute([(n, t) for n, (_, t) in enumerate(order)])
    of = {d: want[n] for n, d in enumerate(order)}
    got = ss.cleaned(spark.createDataFrame(docs, "doc_id long, text string").repartition(6)).collect()
    rows = lambda x: sorted(x, key=repr)
    assert rows((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == rows((d[0], *of[d]) for d in docs)
