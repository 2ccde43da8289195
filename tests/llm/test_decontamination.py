import numpy as np
import pytest

from tessera.llm import decontamination as dc


def words(rng, n, vocabulary):
    return [f"w{int(x)}" for x in rng.integers(0, vocabulary, n)]


def edited(rng, item, k):
    out = list(item)
    for _ in range(k):
        i = int(rng.integers(0, len(out)))
        kind = rng.integers(0, 3)
        if kind == 0:
            out[i] = f"x{int(rng.integers(0, 1000))}"
        elif kind == 1:
            del out[i]
        else:
            out.insert(i, f"y{int(rng.integers(0, 1000))}")
    return out


def brute(item, doc, k):
    """Least word edits of item against any stretch of doc, by the plain table."""
    row = [0] * (len(doc) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(doc):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (a != b)))
        row = new
    return min(row) <= k


def test_recall_within_the_budget_and_precision():
    rng = np.random.default_rng(3)
    items = [(i, " ".join(words(rng, int(rng.integers(15, 50)), 400))) for i in range(60)]
    index = dc.Index(items)
    planted, texts = set(), []
    for d in range(400):
        body = words(rng, 200, 400)
        if d % 2 == 0:
            n = int(rng.integers(0, 60))
            item = items[n][1].split()
            body[100:100] = edited(rng, item, int(rng.integers(0, dc.budget(len(item)) + 1)))
            planted.add((d, n))
        texts.append(" ".join(body))
    ids, doc = dc.numbered(texts, index)
    got = {(d, n) for d, here in dc.leaks_of(ids, doc, index).items() for n in here}
    assert len(planted & got) >= 0.95 * len(planted)
    for d, n in got - planted:
        assert brute(items[n][1].split(), texts[d].split(), dc.budget(len(items[n][1].split())))


def test_edits_against_the_plain_table():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a, b = rng.integers(0, 5, 8), rng.integers(0, 5, int(rng.integers(0, 14)))
        for k in (0, 2, 8):
            assert (dc.edits(a, b, k) is not None) == brute(list(a), list(b), k)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "alpha beta gamma delta epsilon zeta eta", "c"), (3, "ALPHA, beta! gamma delta epsilon zeta eta", None), (3, "ALPHA, beta! gamma delta epsilon zeta eta", None)], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, "alpha beta gamma delta epsilon zeta eta"), (8, None), (9, "")], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.item_id, r.distance) for r in dc.found(docs, items).collect()) == [(0, 7, 0), (3, 7, 0), (3, 7, 0)]
    assert dc.clean(docs, items).count() == 2
    assert dc.clean(docs, items).columns == docs.columns
    assert dc.found(docs, items.limit(0)).count() == 0 and dc.found(docs.limit(0), items).count() == 0


def test_windows_cover_every_leak():
    """The pass over pieces is exact: a stretch within the budget has a window within it, whatever the edits."""
    rng = np.random.default_rng(9)
    items = [(i, " ".join(words(rng, int(rng.integers(1, 45)), 60))) for i in range(50)]
    index = dc.Index(items)
    for n, (_, text) in enumerate(items):
        item = text.split()
        k = dc.budget(len(item))
        for _ in range(6):
            before, own = words(rng, int(rng.integers(0, 30)), 300), edited(rng, item, k)
            ids, doc = dc.numbered([" ".join(before + own + words(rng, 10, 300))], index)
            start, size = index.windows(ids, np.zeros(len(ids), np.int64), np.full(len(ids), len(ids)))
            near = [int(s) for s, z in zip(start, size, strict=True) if z == len(item)]
            assert any(abs(s - len(before)) <= k for s in near) or not own


def test_items_in_blocks_are_found_alike(spark):
    rng = np.random.default_rng(10)
    items = spark.createDataFrame([(i, " ".join(words(rng, 20, 400))) for i in range(30)] + [(30, "single")], "item_id long, text string")
    texts = [r.text for r in items.collect()]
    docs = spark.createDataFrame([(d, " ".join(words(rng, 30, 400) + [texts[d % 31]] + words(rng, 9, 400))) for d in range(60)], "doc_id long, text string")
    rows = lambda most: sorted(map(tuple, dc.found(docs, items, most).collect()))
    whole = rows(dc.WORDS)
    assert {(d, i) for d, i, *_ in whole} >= {(d, d % 31) for d in range(60)} and whole == rows(25)
    assert dc.clean(docs, items, 25).count() == 0


def test_very_long_texts(spark):
    rng = np.random.default_rng(11)
    item = " ".join(words(rng, 30, 400))
    text = "filler " * 400_000 + item + " filler" * 400_000
    got = dc.found(spark.createDataFrame([(1, text), (2, "filler " * 500_000)], "doc_id long, text string"), spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.distance, r.first_word) for r in got] == [(1, 5, 0, 400_000)]


@pytest.mark.parametrize("size", [5, 20, 50, 100, 200, 400])
def test_recall_at_the_whole_budget_for_every_length(size):
    rng = np.random.default_rng(size)
    n = 60 if size <= 100 else 40
    index = dc.Index([(i, " ".join(words(rng, size, 4000))) for i in range(n)])
    texts = [" ".join(words(rng, 40, 4000) + edited(rng, _words_of(index, i), dc.budget(size)) + words(rng, 40, 4000)) for i in range(n)]
    ids, doc = dc.numbered(texts, index)
    got = {(d, i) for d, here in dc.leaks_of(ids, doc, index).items() for i in here}
    assert sum((i, i) in got for i in range(n)) >= 0.95 * n


def _words_of(index, i):
    back = {v: k.decode() if isinstance(k, bytes) else k for k, v in index.vocabulary.items()}
    return [back[int(w)] for w in index.items[i][1]]


def test_windows_of_long_items_are_walked_in_bounded_rows():
    assert all(2 * size * dc.TABLES * dc.rows_of(size) <= max(dc.STEPS, 2 * size * dc.TABLES) for size in (1, 10, 400, 4000, 10**6))
    rng = np.random.default_rng(1)
    item = " ".join(words(rng, 3000, 4000))
    index = dc.Index([(0, item), (1, "a few words only")])
    ids, doc = dc.numbered([item + " tail", "nothing here"], index)
    assert {d: set(here) for d, here in dc.leaks_of(ids, doc, index).items()} == {0: {0}}
