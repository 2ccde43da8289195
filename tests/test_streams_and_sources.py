import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import identity
from tessera.sources import io, schemas
from tessera.streaming import engine


def one(i, n=8):
    v = [0.0] * n
    v[i] = 1.0
    return v


def observations(spark):
    rows = []
    for camera, track, start, i in (("a", 1, 0.0, 0), ("b", 5, 10.0, 0), ("a", 9, 1.0, 3), ("c", 2, 400.0, 0)):
        rows += [(f"{camera}{track}-{j}", camera, track, start + 0.5 * j, one(i), 0.9, 0) for j in range(5)]
    return spark.createDataFrame(rows, "point_id string, camera string, track_id bigint, ts double, vec array<double>, quality double, shard int")


def test_online_identities(spark, tmp_path):
    obs = observations(spark)
    for i, part in enumerate((obs.where("ts < 6"), obs.where("ts >= 6"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(obs.schema).parquet(str(tmp_path / "in"))
        engine.drain(engine.online_identities(stream), str(tmp_path / "out"), str(tmp_path / f"check"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.where("version = 0").count() == 20
    final = {r.point_id: r.gid for r in identity.corrected(out).collect()}
    assert final["a1-0"] == final["a1-4"] == final["b5-4"] > 0
    assert final["a9-0"] not in (final["a1-0"], final["b5-0"])
    assert final["c2-4"] not in (final["a1-0"], final["a9-0"])  # it was idle too long


def test_overlap_segments_match_the_batch_form(spark, tmp_path):
    rows = [("a", 1, f, f in (3, 4, 8)) for f in range(12)]
    df = spark.createDataFrame(rows, "camera string, track_id bigint, frame bigint, overlapping boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    engine.drain(engine.segments(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "check"))
    got = {r.frame: (r.segment, r.edge) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    from tessera.operators.sessions import edges_of_state

    want = {r.frame: (r.segment, r.edge) for r in edges_of_state(df, ["camera", "track_id"], ["frame"], "overlapping").collect()}
    assert got == want and got[9] == (3, "exit")


def test_stream_sessions(spark, tmp_path):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("a", 10), ("b", 3)], "k string, s int").select("k", F.timestamp_seconds("s").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = engine.sessions(stream, ["k"], "ts", "2 seconds", "0 seconds")
    engine.drain(out, str(tmp_path / "out"), str(tmp_path / "check"))
    assert sorted((r.k, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 2), ("b", 1)]


def test_json_lines(spark, tmp_path):
    lines = [{"_comment": "labels"}, {"run_id": "r", "a": "x:1", "b": "y:2", "verdict": "same"}, {"run_id": "r", "a": "x:1", "b": "y:3", "verdict": "unsure"}]
    (tmp_path / "labels.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n{broken\n")
    assert [(r.a, r.b) for r in io.labels(spark, str(tmp_path / "labels.jsonl")).collect()] == [("x:1", "y:2")]
    (tmp_path / "pairs.jsonl").write_text(json.dumps({"run_id": "r", "a": ["cam", 1], "b": ["cam", 2], "same": True}) + "\n")
    assert [(r.a, r.b, r.same) for r in io.tracklet_pairs(spark, str(tmp_path / "pairs.jsonl")).collect()] == [("cam:1", "cam:2", True)]
    records = [{"camera": "a", "frame": 1, "track_id": 3}, {"camera": "a", "frame": 2, "track_id": 3, "post_overlap_feature_check": True, "post_overlap_reid_fused": 0.5}]
    (tmp_path / "d.jsonl").write_text("\n".join(map(json.dumps, records)))
    seen, checks = io.detections(spark, str(tmp_path / "d.jsonl"))
    assert seen.count() == 1 and checks.first().post_overlap_reid_fused == 0.5


def test_points(spark, tmp_path):
    p = io.Points(spark, str(tmp_path / "points"))
    rows = spark.createDataFrame([("r1", "a", 1, f, f * 0.5, one(0), None, None) for f in range(3)] + [("r2", "a", 1, 0, 0.0, one(1), 4, 4)], "run_id string, camera string, track_id bigint, frame bigint, ts double, vec array<float>, global_id bigint, reid_id bigint")
    p.add(rows)
    p.add(rows)
    assert p.count() == 4 and p.read("r1").count() == 3
    ids = p.read("r1").select("point_id").limit(1).withColumn("gid", F.lit(7).cast("bigint"))
    assert sorted(str(r.global_id) for r in p.identified(ids).collect()) == ["4", "7", "None", "None"]
    assert p.cleared(p.read("r2").select("point_id")).where("global_id IS NOT NULL").count() == 0
    assert identity.next_id(p.read()).first().next_id == 5
    t = io.tracklet_table(p.read(), 2).collect()
    assert [(r.run_id, r.n, r.frames) for r in t] == [("r1", 3, [0, 1, 2])]
    p.reset()
    assert p.count() == 0


def test_checks(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (2, [1.0])], "id int, vec array<float>")
    good, bad = schemas.valid_vectors(df, "vec", 2)
    assert good.count() == 1 and bad.count() == 2
    assert [(r.id, r.n) for r in schemas.duplicate_keys(df, ["id"]).collect()] == [(2, 2)]


def test_gallery_forgets(spark):
    g = engine.Gallery(engine.Online(most_active=1))
    for t in range(3):
        g.observe("a", 1, float(t), one(0), 1.0)
        g.observe("a", 2, float(t) + 0.1, one(1), 1.0)
    g.sweep(3.0)
    assert list(g.ids) == ["2"]
    assert engine.Gallery(g.s, g.text()).ids == g.ids
    assert pytest.approx(1.0) == sum(x * x for x in g.ids["2"]["bank"][0])


def test_versions_of_points_and_writes_that_differ(spark, tmp_path):
    p = io.Points(spark, str(tmp_path / "points"))
    schema = "run_id string, camera string, track_id bigint, frame bigint, ts double, vec array<float>, global_id bigint, reid_id bigint"
    for g in (None, 3, 2):
        p.add(spark.createDataFrame([("r", "a", 1, 0, 0.0, one(0), g, g)], schema))
    assert [r.global_id for r in p.read().collect()] == [3]
    new = p.replace(p.identified(p.read().select("point_id").withColumn("gid", F.lit(9).cast("bigint"))))
    assert [r.global_id for r in new.read().collect()] == [9] and [r.global_id for r in p.read().collect()] == [3]
    again = new.replace(new.cleared(new.read().select("point_id")))
    assert [r.global_id for r in again.read().collect()] == [None] and again.path.endswith("@2")


def test_saved_tracklets_and_galleries(spark, tmp_path):
    t = spark.createDataFrame([("a:1:1", "a"), ("a:2:1", "a")], "key string, camera string")
    v = spark.createDataFrame([("a:1:1", 2, 0.5, one(1)), ("a:1:1", 1, 0.9, one(0))], "key string, seq int, quality double, vec array<float>")
    io.save_tracklets(t, v, str(tmp_path / "cache"))
    got = io.load_tracklets(spark, str(tmp_path / "cache")).collect()
    assert [(r.key, [b.seq for b in r.bank]) for r in got] == [("a:1:1", [1, 2])]
    io.write_mapping(spark.createDataFrame([("a:1:1", "G2"), ("a:1:1", "G1")], "key string, gid string"), str(tmp_path / "map"))
    assert [(r.key, r.gid) for r in io.load_mapping(spark, str(tmp_path / "map")).collect()] == [("a:1:1", "G1")]
    bank = spark.createDataFrame([(1, "swin", 2, one(1)), (1, "swin", 1, one(0)), (7, "swin", 1, one(0))], "gid long, model string, seq int, vec array<float>")
    io.write_gallery(bank, str(tmp_path / "bank"))
    rows = io.load_gallery(spark, spark.createDataFrame([(1,)], "gid long"), str(tmp_path / "bank")).collect()
    assert [(r.gid, r.model, r.vectors) for r in rows] == [(1, "swin", [one(0), one(1)])]


def test_logs(spark, tmp_path):
    io.write_probabilities(spark.createDataFrame([(1.0, 0.5, 0.25, 0.9)], "ts double, cos double, rerank double, prob double"), str(tmp_path / "p"))
    r = spark.read.json(str(tmp_path / "p")).first()
    assert r.features.cos == 0.5 and r.prob == 0.9
    schema = "run_id string, camera string, track_id long, frame long, ts double, bbox array<double>, foot_x double, foot_y double, source string, clipped boolean, x double, y double, error double, group string"
    pos = spark.createDataFrame([("r", "a", 1, 2, 0.1, [0.0, 1.0, 2.0, 3.456], 1.0, 3.456, "box", False, 4.00004, 5.0, 0.5, "g"), ("r", "a", 1, 3, 0.2, None, None, None, None, None, None, None, None, None)], schema)
    assert tuple(io.floor_counts(pos).first()) == ("a", 1, 1)
    io.write_floor_log(pos, str(tmp_path / "floor"), "v1", "m")
    got = spark.read.json(str(tmp_path / "floor")).collect()
    assert [(g.floor, g.foot_img, g.calib_version, g.bbox[3]) for g in got] == [[[4.0, 5.0], [1.0, 3.46], "v1", 3.46]] or got[0].floor == [4.0, 5.0]
    io.write_annotations(spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, "z")], "camera string, frame long, label string"), str(tmp_path / "notes"))
    assert sorted((r.camera, r.frame) for r in spark.read.json(str(tmp_path / "notes")).collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_calibrations(spark, tmp_path):
    good = spark.createDataFrame([("a", "hall", [1.0] * 9, 640, 480, 0.5), ("b", "hall", [2.0] * 9, 640, 480, 0.7)], schemas.CALIBRATION)
    got = io.write_calibration(good, str(tmp_path), "v1")
    assert {(r.camera, r.calib_version, len(r.homography)) for r in got.collect()} == {("a", "v1", 9), ("b", "v1", 9)}
    assert tuple(io.calibration_summary(got).first()) == ("hall", ["a", "b"], 0.7)
    for bad in (good.unionByName(good), good.withColumn("homography", F.slice("homography", 1, 8))):
        with pytest.raises(ValueError):
            io.write_calibration(bad, str(tmp_path), "v2")


def test_ids_are_never_given_twice(spark):
    parts, long = spark.createDataFrame([("x",), ("y",), ("x",)], "component string"), "gid long"
    ids, new = identity.allocated(parts, spark.createDataFrame([(4,)], long), spark.createDataFrame([(9,)], long))
    assert sorted(map(tuple, ids.collect())) == [("x", 10), ("y", 11)] and sorted(r.gid for r in new.collect()) == [10, 11]
