import os
import re

import corpus_pipeline
from tessera.llm import decontamination
from tessera.llm.common import components, table, written



def classes(docs):
    """The smallest doc_id of each group of texts whose sets of five-word shingles are alike at .8, by all pairs."""
    sets = {}
    for i, text in docs:
        words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
    ids = sorted(sets)
    parent = {i: i for i in ids}
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((parent[a], parent[b]))
                parent = {k: p if v == q else v for k, v in parent.items()}
    return set(parent.values())


DIR = os.environ.get("TESSERA_TEST_DIR", "/root/testdata/sf0.001")


def test_stages(spark):
    docs = table(spark, DIR, "documents")
    columns, seen = docs.columns, {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, DIR), f"test-{name}")
        seen[name] = docs
        if name != "shards":
            assert docs.columns == columns
    ids = {k: [r.doc_id for r in v.select("doc_id").collect()] for k, v in seen.items()}
    marks = {r.doc_id: r.quality for r in table(spark, DIR, "labels").collect()}
    gone = set(ids["documents"]) - set(ids["good"])
    assert sum(marks.get(i) == 1 for i in gone) <= 0.05 * len(marks)
    assert len(set(ids["distinct"])) == len(ids["distinct"]) and set(ids["distinct"]) <= set(ids["good"])
    assert classes([(r.doc_id, r.text) for r in seen["good"].collect()]) == set(ids["distinct"])
    leaks = {r.doc_id for r in decontamination.found(seen["distinct"], table(spark, DIR, "benchmark")).collect()}
    assert set(ids["clean"]) == set(ids["distinct"]) - leaks
    assert set(ids["mix"]) <= set(ids["clean"]) and max(map(ids["mix"].count, set(ids["mix"]))) <= 2
    assert sorted(ids["shards"]) == sorted(ids["mix"])


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (5, 5), (200, 100)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100, 200: 100}
