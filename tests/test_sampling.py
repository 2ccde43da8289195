"""Sampling by ticks: cases worked out by hand, and a plain fold over random tracks."""

import random

from tessera.operators.sampling import Sampler, Sampling, embeddings_per_track, sampled, ticks

SCHEMA = "camera string, track long, frame long, good boolean, id long, tick_note string"


def run(spark, rows, rule, frames=None):
    df = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], SCHEMA)
    if frames is not None:
        frames = spark.createDataFrame(frames, "camera string, frame long")
    return sampled(df, ["camera", "track"], "frame", "good", "id", rule, frames)


def embedded(spark, rows, rule, frames=None):
    return sorted((r.camera, r.track, r.frame) for r in run(spark, rows, rule, frames).where("embedded").collect())


def test_warm_up_then_interval(spark):
    rows = [("c", 1, f, True) for f in range(1, 41)]
    assert [f for _, _, f in embedded(spark, rows, Sampling(interval=10, warmup=3, spacing=3))] == [1, 4, 7, 17, 27, 37]
    assert [f for _, _, f in embedded(spark, rows, Sampling(interval=10, warmup=3, spacing=0))] == [1, 2, 3, 13, 23, 33]
    assert [f for _, _, f in embedded(spark, rows, Sampling(interval=10, warmup=3, spacing=3, most=4))] == [1, 4, 7, 17]


def test_ticks_count_processed_frames_not_frame_numbers(spark):
    # Load shedding: only every 15th frame was processed; ten ticks are 150 frames.
    rows = [("c", 1, 15 * f, True) for f in range(1, 41)]
    assert [f // 15 for _, _, f in embedded(spark, rows, Sampling(interval=10, warmup=1))] == [1, 11, 21, 31]
    # Frames without a detection of the track count where they are given.
    frames = [("c", f) for f in range(1, 601)]
    assert [f for _, _, f in embedded(spark, rows, Sampling(interval=20, warmup=1), frames)] == [15 * f for f in range(1, 41, 2)]


def test_expiry_is_counted_in_ticks_since_last_seen(spark):
    frames = [("c", f) for f in range(1, 30)]
    rows = [("c", 1, f, True) for f in (1, 2, 13, 24, 26)]
    # Seen at 2 and at 13: ten ticks pass between them, so a ttl of 10 keeps the track and 9 forgets it.
    assert [f for _, _, f in embedded(spark, rows, Sampling(interval=100, warmup=1, ttl=10), frames)] == [1]
    assert [f for _, _, f in embedded(spark, rows, Sampling(interval=100, warmup=1, ttl=9), frames)] == [1, 13, 24]
    # A capped track that stays in view keeps its cap; one that left starts anew.
    assert [f for _, _, f in embedded(spark, rows, Sampling(interval=1, warmup=0, most=1, ttl=9), frames)] == [1, 13, 24]


def test_refused_crops_are_asked_again_and_keep_the_held_vector(spark):
    rows = [("c", 1, f, f in (3, 9)) for f in range(1, 11)]
    out = sorted((r.frame, r.embedded, r.held) for r in run(spark, rows, Sampling(interval=5, warmup=1)).collect())
    assert [h for _, _, h in out] == [None, None, 3, 3, 3, 3, 3, 3, 9, 9]
    assert [f for f, e, _ in out if e] == [3, 9]


def test_random_tracks_against_a_plain_fold(spark):
    rng = random.Random(4)
    rows = [(f"c{rng.randrange(3)}", rng.randrange(4), rng.randrange(120), rng.random() < 0.7) for _ in range(400)]
    rule = Sampling(interval=6, warmup=2, spacing=2, ttl=12, most=5)
    clock = {c: {f: i + 1 for i, f in enumerate(sorted({r[2] for r in rows if r[0] == c}))} for c in ("c0", "c1", "c2")}
    states, want = {}, []
    for i, (c, t, f, good) in sorted(enumerate(rows), key=lambda x: (clock[x[1][0]][x[1][2]], x[0])):
        want.append((i, clock[c][f], *states.setdefault((c, t), Sampler(rule)).take(clock[c][f], f, good)))
    out = run(spark, rows, rule)
    assert sorted((r.id, r.tick, r.embedded, r.held) for r in out.collect()) == sorted(want)
    totals = embeddings_per_track(out, ["camera", "track"]).collect()
    assert sum(r.detections for r in totals) == 400 and sum(r.embeddings for r in totals) == sum(w[2] for w in want)


def test_nulls_and_empty(spark):
    out = run(spark, [(None, 1, 1, True), ("c", None, 1, True), ("c", 1, None, True), ("c", 1, 1, None), ("c", 1, 2, True)], Sampling()).collect()
    assert {r.id: (r.embedded, r.held) for r in out} == {0: (False, None), 1: (False, None), 2: (False, None), 3: (False, None), 4: (True, 2)}
    assert run(spark, [], Sampling()).collect() == []
    assert ticks(spark.createDataFrame([], "camera string, frame long"), "camera", "frame").collect() == []
