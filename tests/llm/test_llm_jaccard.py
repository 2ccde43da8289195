import numpy as np
import pytest

from tessera.llm import jaccard


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)} if len(words) >= 4 else {tuple(words)} if words else set()


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    rng = np.random.default_rng(seed)
    docs = []
    for base in range(6):
        words = [f"w{x}" for x in rng.integers(0, 300, int(rng.integers(4, 160)))]
        for _ in range(int(rng.integers(1, 14))):
            own = list(words)
            for _ in range(int(rng.integers(0, 4))):
                own[int(rng.integers(0, len(own)))] = f"x{rng.integers(0, 50)}"
            docs.append(" ".join(own).upper() if rng.random() < 0.2 else "\t".join(own))
    docs += ["", "a b", "A  b\n", "c", None, " \n"]
    return list(enumerate(docs))


@pytest.mark.parametrize("seed, block, long", [(1, 4, 20_000), (2, 3, 0), (3, 5, 1)])
def test_against_brute_force(spark, monkeypatch, seed, block, long):
    monkeypatch.setattr(jaccard, "BLOCK", block)  # pivots in blocks, several rounds and a rest
    monkeypatch.setattr(jaccard, "LONG_LIST", long)
    monkeypatch.setattr(jaccard, "SAMPLE", 1)
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.joined(df, 4, 85).collect()}
    assert got == brute(docs)


def test_search_and_bounds_against_brute_force():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(5):
        base = rng.choice(5000, int(rng.integers(3, 400)), replace=False).astype(np.uint64)
        for _ in range(8):
            keep = rng.random(len(base)) > rng.choice([0.02, 0.08, 0.2])
            sets.append(np.unique(np.concatenate([base[keep], rng.integers(6000, 9000, int(rng.integers(0, 4))).astype(np.uint64)])))
    sets = sorted((s for s in sets if len(s)), key=len)
    linked = {(j, i) for i in range(len(sets)) for j in range(i) if 100 * (x := len(np.intersect1d(sets[i], sets[j]))) >= 85 * (len(sets[i]) + len(sets[j]) - x)}
    found, labels = jaccard.t_occurrences(sets, 85)
    assert {(j, i) for i, j in found} <= linked

    def classes(pairs):
        parent = list(range(len(sets)))
        for a, b in pairs:
            x, y = parent[a], parent[b]
            parent = [min(x, y) if p in (x, y) else p for p in parent]
        return parent

    assert classes(found) == classes(linked) == labels.tolist()
    # What is known to be of one component gives no link, and the others' components stay the same.
    known = np.array(classes(linked))
    some = np.where(np.arange(len(sets)) % 3 == 0, known, np.arange(len(sets)))
    more, labels = jaccard.t_occurrences(sets, 85, some)
    assert {tuple(np.flatnonzero(labels == x)) for x in labels} == {tuple(np.flatnonzero(known == x)) for x in known} and len(more) <= len(found)
    hashed = [jaccard.mix(s) for s in sets]
    flags = jaccard.partnered(np.array(list(map(len, sets))), [jaccard.sketch_of(np.sort(h)) for h in hashed], 85)
    assert all(flags[i] and flags[j] for i, j in linked)
    big = [np.sort(jaccard.mix(np.arange(a, a + n).astype(np.uint64))) for a, n in ((0, 3000), (100, 3100), (9000, 3050))]
    assert jaccard.partnered(np.array([3000, 3100, 3050])[[0, 2, 1]], [jaccard.sketch_of(big[i]) for i in (0, 2, 1)], 85).tolist() == [True, False, True]


def test_one_group_of_near_copies_holds_most_rows(spark, monkeypatch):
    """Blocks, rounds and the rest on one large pivot: rows searched stay in proportion to the rows."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "LONG_LIST", 8)
    monkeypatch.setattr(jaccard, "SAMPLE", 1)
    rng = np.random.default_rng(7)
    base = [f"w{x}" for x in rng.integers(0, 500, 120)]
    docs = []
    for i in range(200):
        own = list(base)
        own[int(rng.integers(0, 120))] = f"x{i}"
        docs.append((i, " ".join(own)))
    docs += [(200 + i, " ".join(base[:40] + [f"y{rng.integers(0, 900)}" for _ in range(int(rng.integers(60, 100)))])) for i in range(40)]
    seen, searched = [], jaccard.searched

    def counting(units, *more):
        seen.append(units.count())
        return searched(units, *more)

    monkeypatch.setattr(jaccard, "searched", counting)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.joined(df, 4, 85).collect()}
    assert got == brute(docs)
    assert len(seen) >= 3


def test_odd_tables(spark):
    text = "one two three four five six seven eight"
    rows = [(5, text, "a", 1), (3, text.upper(), "b", 2), (3, text.upper(), "b", 2), (None, text, "c", 3), (9, None, None, None), (8, "", "d", 4), (7, text + " nine ten", "e", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rep string, other int")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.joined(docs, 4, 85).collect())
    assert got == sorted([("5", 5, "3"), ("3", 5, "3"), ("3", 5, "3"), ("None", 5, "None"), ("9", 0, "9"), ("8", 0, "8"), ("7", 7, "7")])
    one = jaccard.one_of_each(docs, 4, 85)
    assert one.columns == docs.columns
    assert sorted(str(r.doc_id) for r in one.collect()) == ["3", "7", "8", "9", "None"]
    assert jaccard.joined(docs.limit(0)).count() == 0 and jaccard.one_of_each(docs.limit(0)).count() == 0
