"""Live tracks: every transition by hand, and a replayed stream against the batch."""

from tessera.streaming import engine, tracks

SCHEMA = "track string, ts double, scores array<struct<gid:string,score:double,verified:boolean,accepted:boolean>>, consistent boolean"


def s(gid, score, verified=False, accepted=False):
    return (gid, float(score), verified, accepted)


CASES = {
    "match": [([s("A", 0.9, True, True)], False, "matched", "A"), ([s("A", 0.9, True)], False, "verified", "A")],
    "loses": [([s("A", 0.9, True, True)], False, "matched", "A")] + [([s("A", 0.3)], False, "held_back", None)] * 2 + [([s("A", 0.3)], False, "given_up", None), ([], False, "pending", None)],
    "recovers": [([s("A", 0.9, True, True)], False, "matched", "A"), ([s("A", 0.3)], False, "held_back", None), ([s("A", 0.8, True)], False, "verified", "A"), ([s("A", 0.3)], False, "held_back", None)],
    "switches": [([s("A", 0.9, True, True)], False, "matched", "A"), ([s("A", 0.4), s("B", 0.8, True, True)], False, "held_back", None), ([s("A", 0.4), s("B", 0.8, True, True)], False, "switched", "B")],
    "wavers": [([s("A", 0.9, True, True)], False, "matched", "A"), ([s("A", 0.4), s("B", 0.8, True, True)], False, "held_back", None), ([s("A", 0.4), s("C", 0.8, True, True)], False, "held_back", None), ([s("A", 0.4), s("B", 0.42, True, True)], False, "given_up", None)],
    "new": [([], False, "pending", None), ([s("A", 0.2)], True, "made", "new#1"), ([s("new#1", 0.9, True)], True, "verified", "new#1")],
    "unsure": [([], False, "pending", None), ([], False, "pending", None), ([], True, "made", "unsure#1")],
}


def rows():
    return [(k, float(i), scores, consistent) for k, steps in CASES.items() for i, (scores, consistent, _, _) in enumerate(steps)]


def want():
    return sorted((k, float(i), gid or "", status) for k, steps in CASES.items() for i, (_, _, status, gid) in enumerate(steps))


def test_every_transition(spark):
    got = tracks.held(spark.createDataFrame(rows(), SCHEMA).repartition(3)).collect()
    assert sorted((r.track, r.ts, r.gid or "", r.status) for r in got) == want()


def test_a_replayed_stream_gives_the_same(spark, tmp_path):
    for i in range(5):
        part = [r for r in rows() if int(r[1]) == i]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    engine.drain(tracks.held_stream(stream, idle_ms=None), str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.schema(tracks.OUT).parquet(str(tmp_path / "out")).collect()
    assert sorted((r.track, r.ts, r.gid or "", r.status) for r in got) == want()
