"""The online service and the live engine: their rules over plain state, and streams against replays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.identity import corrected
from tessera.streaming import live, service
from tessera.streaming.engine import drain

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def toward(i, tilt=0.0, j=7, dim=8):
    v = np.zeros(dim)
    v[i], v[j] = 1.0, tilt
    return (v / np.linalg.norm(v)).tolist()


def feed(track, camera, start, vecs, frame=0):
    return [(f"{camera}:{track}:{frame + i}", camera, track, frame + i, start + i, v, 1.0) for i, v in enumerate(vecs)]


def final(out):
    return {p: g for p, g, _ in sorted(((r[0], r[4], r[5]) for r in out), key=lambda x: x[2])}


def test_service_waits_then_names_all_points():
    out = service.replayed(feed(1, "a", 0, [toward(0)] * 4))
    assert [r[6] for r in out] == ["waiting", "waiting", "new", "new", "new", "kept"] and out[0][4] < 0
    assert set(final(out).values()) == {1}


def test_service_takes_two_lanes():
    again = feed(1, "a", 0, [toward(0)] * 4) + feed(2, "a", 20, [toward(0)] * 3, 20) + feed(3, "b", 40, [toward(0, 0.2)] * 3)
    assert set(final(service.replayed(again)).values()) == {1}
    # Two identities that are as like: across cameras there is no choice between them.
    two = feed(1, "a", 0, [toward(0, 0.4, 6)] * 7) + feed(2, "b", 20, [toward(0, 0.4, 5)] * 7) + feed(3, "c", 40, [toward(0)] * 3)
    got = final(service.replayed(two, service.Serving(cross_camera=0.9, margin=0.02)))
    assert len(set(got.values())) == 3
    # One that another track of the camera shows at that time is not taken.
    meet = sorted(feed(1, "a", 0, [toward(0)] * 9) + feed(2, "a", 3, [toward(0)] * 4, 3), key=lambda r: r[4])
    assert len(set(final(service.replayed(meet)).values())) == 2


def test_service_moves_in_warm_up():
    # The first crops are bad and make an identity of their own; then the track shows itself.
    known = feed(1, "a", 0, [toward(0)] * 8)
    late = feed(2, "b", 30, [toward(3)] * 3 + [toward(0)] * 4)
    out = service.replayed(known + late)
    assert "moved" in {r[6] for r in out}
    assert set(final(out).values()) == {1}


def test_service_splits_what_turns_out_wrong():
    s = service.Serving(warm_up=0, late=30)
    known = feed(1, "a", 0, [toward(0)] * 12)
    other = feed(2, "b", 30, [toward(0, 0.3)] * 3 + [toward(4)] * 12)
    out = service.replayed(known + other, s)
    got = final(out)
    assert "split" in {r[6] for r in out} and {got[p] for p in got if p.startswith("a")} == {1}
    assert len({got[p] for p in got if p.startswith("b")}) == 1 and 1 not in {got[p] for p in got if p.startswith("b")}
    assert "split" not in {r[6] for r in service.replayed(known + other, service.Serving(warm_up=0, late=3))}


def test_service_forgets():
    s = service.Serving(idle=50.0)
    out = service.replayed(feed(1, "a", 0, [toward(0)] * 4) + feed(2, "b", 100, [toward(0)] * 4), s)
    assert len(set(final(out).values())) == 2


def random_feed(seed, n=24):
    rng = np.random.default_rng(seed)
    people = rng.normal(size=(6, 8))
    rows = []
    for t in range(n):
        who, camera, start = people[t % 6], "abc"[int(rng.integers(3))], float(rng.integers(0, 120))
        rows += feed(t, camera, start, [(who + rng.normal(size=8) * 0.5).tolist() for _ in range(int(rng.integers(2, 12)))], int(start))
    return sorted(rows, key=lambda r: (r[4], r[1], r[2], r[0]))


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def streamed(spark, tmp_path, frames, schema, run):
    for i, df in enumerate(frames):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"part={i}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part=*"))
    drain(run(source), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    return spark.read.parquet(str(tmp_path / "out"))


def test_service_stream_equals_replay(rocks, tmp_path):
    rows = random_feed(1)
    schema = "shard string, point_id string, camera string, track_id long, frame long, ts timestamp, vec array<double>, quality double"
    cut = [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
    frames = [
        rocks.createDataFrame([(s, p, c, t, f, ts, v, q) for s in ("x", "y") for p, c, t, f, ts, v, q in part], schema.replace("ts timestamp", "ts double")).withColumn("ts", F.timestamp_seconds("ts")).select("shard", "point_id", "camera", "track_id", "frame", "ts", "vec", "quality")
        for part in cut
    ]
    got = streamed(rocks, tmp_path, frames, schema, lambda s: service.served(s, service.Serving(late=1000), late="1000 seconds"))
    want = service.replayed(rows, service.Serving(late=1000))
    assert len({r[6] for r in want}) >= 4
    assert sorted(tuple(r) for r in got.collect()) == sorted(want * 2)
    latest = {r.point_id: r.gid for r in corrected(got).collect()}
    assert latest == final(want)


MODELS = ("a", "b", "c")


def look(i, tilt=0.0, j=7, view="front"):
    return [(m, view, toward((i + k) % 6, tilt, j)) for k, m in enumerate(MODELS)]


def sample(track, camera, ts, vectors, overlapping=False, attributes=()):
    return (track, camera, float(ts), overlapping, vectors, list(attributes))


def statuses(rows, settings=live.Live()):
    return [(r[4], r[3]) for r in live.replayed(rows, settings)]


def test_engine_makes_verifies_and_matches():
    rows = [sample("a:1", "a", t, look(0, 0.1 * t)) for t in range(4)] + [sample("b:5", "b", 20 + t, look(0, 0.1)) for t in range(2)]
    got = statuses(rows)
    assert [s for s, _ in got] == ["pending", "made", "verified", "verified", "matched", "verified"]
    assert {g for _, g in got[1:]} == {"a:1#1"}
    # Another entity is not taken for it; samples of two entities in a row make none.
    other = statuses(rows[:4] + [sample("b:6", "b", 30, look(2)), sample("b:6", "b", 31, look(4)), sample("b:6", "b", 32, look(4))])
    assert [s for s, _ in other[4:]] == ["pending", "pending", "made"]


def test_engine_needs_support_of_models():
    half = [("a", "front", toward(0)), ("b", "front", toward(5)), ("c", "front", toward(4))]
    rows = [sample("a:1", "a", t, look(0)) for t in range(2)] + [sample("b:2", "b", 20, half)]
    assert statuses(rows)[2][0] == "pending"
    assert statuses(rows, live.Live(required=1, cross_camera=0.4, least_score=0.3, views=1, attributes=0.0))[2][0] == "matched"


def test_engine_does_not_show_one_identity_twice_in_a_camera():
    rows = [sample("a:1", "a", 0, look(0)), sample("a:1", "a", 1, look(0)), sample("a:2", "a", 2, look(0)), sample("a:2", "a", 9, look(0))]
    assert [s for s, _ in statuses(rows)] == ["pending", "made", "pending", "matched"]


def test_engine_gives_up_and_switches():
    rows = [sample("a:1", "a", t, look(0)) for t in range(2)] + [sample("b:1", "b", 10 + t, look(2)) for t in range(2)]
    gone = statuses(rows + [sample("a:1", "a", 20 + t, look(4)) for t in range(4)])
    assert [s for s, _ in gone[4:]] == ["held_back", "held_back", "given_up", "pending"]
    switched = statuses(rows + [sample("a:1", "a", 20 + t, look(2)) for t in range(2)])
    assert switched[4:] == [("held_back", None), ("switched", "b:1#1")]


def test_engine_recovers_after_overlaps():
    known = [sample("a:1", "a", t, look(0)) for t in range(3)]
    hidden = [sample("a:1", "a", 3, look(3), True)]
    fine = statuses(known + hidden + [sample("a:1", "a", 4, look(0, 0.2))])
    assert [s for s, _ in fine[3:]] == ["overlapping", "verified"]
    # Cosines of some .57: too little at first, enough once it failed three times.
    dim = statuses(known + hidden + [sample("a:1", "a", 4 + t, look(0, 1.45)) for t in range(4)])
    assert [s for s, _ in dim[4:7]] == ["unproven"] * 3 and dim[7][0] != "unproven"
    lost = statuses(known + hidden + [sample("a:1", "a", 4 + t, look(3)) for t in range(7)])
    assert [s for s, _ in lost[4:]] == ["unproven"] * 5 + ["given_up", "pending"]


def test_banks_grow_by_what_is_new_and_stay_bounded():
    held = live.Engine(live.Live(bank=5), *(live.Plain() for _ in range(3)))
    for t in range(40):
        held.observe(live.seen("a:1", "a", float(t), False, look(0, 0.02 * t), [("shirt", toward(1, 0.05 * t))]))
    sizes = {k: len(v[0]) for k, v in held.banks.entries.items()}
    assert set(sizes) == {"a:1#1|a|front", "a:1#1|b|front", "a:1#1|c|front", "a:1#1|@|shirt"} and max(sizes.values()) <= 5 and min(sizes.values()) > 1
    held.sweep(1e6)
    assert not held.banks.entries and not held.profiles.entries and not held.tracks.entries


def test_engine_stream_equals_replay(rocks, tmp_path):
    rng = np.random.default_rng(2)
    rows = []
    for t in range(10):
        who, camera, start = int(rng.integers(4)), "ab"[t % 2], float(rng.integers(100, 160))
        rows += [sample(f"{camera}:{t}", camera, start + i, look(who, float(rng.uniform(0, 0.8)), 6, ["front", "side", "back"][int(rng.integers(3))]), bool(rng.random() < 0.1), [("shirt", toward(who))]) for i in range(8)]
    rows.sort(key=lambda r: (r[2], r[0]))
    schema = "shard string, track string, camera string, ts timestamp, overlapping boolean, vectors array<struct<model:string,view:string,vec:array<double>>>, attributes array<struct<name:string,vec:array<double>>>"
    parts = [rows[:30], rows[30:]]
    frames = [rocks.createDataFrame([("x", *r) for r in part], schema.replace("ts timestamp", "ts double")).withColumn("ts", F.timestamp_seconds("ts")).select("shard", "track", "camera", "ts", "overlapping", "vectors", "attributes") for part in parts]
    got = streamed(rocks, tmp_path, frames, schema, lambda s: live.engine_stream(s, late="1000 seconds"))
    want = live.replayed(rows)
    assert len({r[4] for r in want}) >= 4
    key = lambda r: (r[0], r[2], r[4], r[3] or "", round(r[5], 9))
    assert sorted(map(key, map(tuple, got.collect()))) == sorted(map(key, want))
