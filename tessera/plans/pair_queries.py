"""Pair evidence over ``embeddings`` (a bank for each camera and label) and rules over made-up evidence from ``events``.

Banks: key is camera:label, view and model follow from vec_id. Pairs: banks of different cameras, of one label or of
neighbouring labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import scores
from tessera.functions.vectors import mean_vectors, unit
from tessera.operators import evidence, identity, reconcile, resolver, scoring
from tessera.plans.base import add
from tessera.plans.event_queries import EV, boxes, events

VIEWS = ("full", "upper", "torso", "lower")
KINDS = ("full", "light", "upper", "lower")
MODELS = ("resnet", "swin", "solider")

RAW = "list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))"
BANKS = f"""
WITH f AS (
  SELECT vec_id, vec_id % 4 AS cam, label, (vec_id % 4) || ':' || label AS key, CAST(embedding AS DOUBLE[]) AS e,
         {list(VIEWS)}[(vec_id // 4) % 4 + 1] AS view, {list(KINDS)}[(vec_id // 4) % 4 + 1] AS kind, {list(MODELS)}[(vec_id // 16) % 3 + 1] AS model
  FROM embeddings),
x AS (
  SELECT a.key AS l, b.key AS r, a.model AS ma, b.model AS mb, a.view AS va, b.view AS vb, a.kind AS ka, b.kind AS kb,
         greatest(-1, least(1, {RAW})) AS cos
  FROM f a JOIN f b ON a.cam < b.cam AND (b.label = a.label OR b.label = (a.label + 1) % 10))"""
PROTOTYPES = f"""
u AS (SELECT key, cam, label, list_transform(e, lambda z: z / (sqrt(list_dot_product(e, e)) + 1e-12)) AS e FROM f),
c AS (SELECT key, cam, label, unnest(range(1, len(e) + 1)) AS i, unnest(e) AS z FROM u),
m AS (SELECT key, cam, label, list(z ORDER BY i) AS e FROM (SELECT key, cam, label, i, avg(z) AS z FROM c GROUP BY ALL) GROUP BY ALL),
proto AS (
  SELECT a.key AS l, b.key AS r, {RAW} AS prototype
  FROM m a JOIN m b ON a.cam < b.cam AND (b.label = a.label OR b.label = (a.label + 1) % 10))"""


def banks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id")
    pick = lambda names, at: F.array(*[F.lit(n) for n in names])[at.cast("int")]
    cam = i % 4
    view = F.floor(i / 4) % 4
    return e.select(
        F.col("vec_id").alias("seq"), cam.alias("cam"), "label", F.concat_ws(":", cam.cast("string"), F.col("label").cast("string")).alias("key"), F.col("embedding").alias("vec"),
        pick(VIEWS, view).alias("view"), pick(KINDS, view).alias("kind"), pick(MODELS, F.floor(i / 16) % 3).alias("model"),
    )


def bank_pairs(rows: DataFrame) -> DataFrame:
    keys = rows.select("key", "cam", "label").distinct()
    near = F.explode(F.array(F.col("label"), (F.col("label") + 1) % 10)).alias("other")
    left = keys.select(F.col("key").alias("left"), F.col("cam").alias("ca"), near)
    right = keys.select(F.col("key").alias("right"), F.col("cam").alias("cb"), F.col("label").alias("other"))
    return left.join(right, "other").where("ca < cb").select("left", "right")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in names else c for c in df.columns])


TRANSITIONS = ", ".join(f"('{a}', '{b}')" for a, b in scoring.TRANSITION_VIEWS)


def _views_sql(bar: float) -> str:
    return f"""{BANKS},
v AS (
  SELECT l, r, ma AS model, va, vb, va = vb AS direct, avg(cos) FILTER (n <= 5) AS top, count(*) FILTER (cos >= {bar}) AS s
  FROM (SELECT *, row_number() OVER (PARTITION BY l, r, ma, va, vb ORDER BY cos DESC) AS n FROM x
        WHERE ma = mb AND (va = vb OR (va, vb) IN ({TRANSITIONS}))) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY l, r, model, direct ORDER BY top DESC) AS n FROM v),
g AS (
  SELECT l, r, model, max(top) FILTER (direct) AS best, avg(top) FILTER (direct AND n <= 2) AS two, max(top) FILTER (NOT direct) AS trans,
         CAST(sum(s) AS BIGINT) AS support, CAST(sum(least(s, CASE WHEN direct THEN 3 ELSE 2 END)) AS BIGINT) AS capped FROM o GROUP BY ALL)"""


@add("view_evidence", f"""{_views_sql(0.50)},
b AS (SELECT *, coalesce(greatest(best, two), 0) AS base FROM g)
SELECT l AS "left", r AS "right", model, round(CASE WHEN trans IS NULL THEN base ELSE greatest(base, 0.85 * trans + 0.15 * base) END, 6) AS score,
       support, coalesce(trans >= base + 0.01, false) AS transition FROM b""")
def view_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = banks(spark, sf_dir)
    return _rounded(scoring.view_scores(rows.select("key", "model", "view", "vec"), bank_pairs(rows)), "score")


@add("capped_view_evidence", f"""{_views_sql(0.60)}
SELECT l AS "left", r AS "right", model,
       round(CASE WHEN trans IS NULL THEN coalesce(two, 0) WHEN two IS NULL THEN trans ELSE greatest(two, 0.72 * trans + 0.28 * two) END, 6) AS score,
       capped AS support, coalesce(trans >= coalesce(two, 0), false) AS transition FROM g""")
def capped_view_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = banks(spark, sf_dir)
    return _rounded(scoring.capped_view_scores(rows.select("key", "model", "view", "vec"), bank_pairs(rows)), "score")


def _kinds_sql(bar: float, allowed: str) -> str:
    return f"""{BANKS},
k AS (
  SELECT l, r, ka, kb, 0.72 * max(cos) + 0.28 * avg(cos) FILTER (n <= 3) AS s, count(*) FILTER (cos >= {bar}) AS c
  FROM (SELECT *, row_number() OVER (PARTITION BY l, r, ka, kb ORDER BY cos DESC) AS n FROM x WHERE {allowed}) GROUP BY ALL)"""


@add("body_evidence", f"""{_kinds_sql(0.60, "ka = kb OR (ka IN ('full', 'light') AND kb IN ('full', 'light'))")},
g AS (
  SELECT l, r, coalesce(max(s) FILTER (ka = kb), max(s)) AS base, max(s) FILTER (ka IN ('upper', 'lower')) AS part, bool_and(ka IN ('upper', 'lower')) AS partial,
         CAST(sum(c) AS BIGINT) AS support FROM k GROUP BY ALL)
SELECT l AS "left", r AS "right", round(CASE WHEN partial THEN 0.85 * part + 0.15 * base ELSE base END, 6) AS score, support, partial FROM g""")
def body_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = banks(spark, sf_dir)
    return _rounded(scoring.body_scores(rows.select("key", F.col("kind").alias("view"), "vec"), bank_pairs(rows)), "score")


@add("part_evidence", f"""{_kinds_sql(0.63, "ka = kb")},
g AS (
  SELECT l, r, coalesce(max(s) FILTER (ka = 'full'), max(s) FILTER (ka = 'light')) AS whole, max(s) FILTER (ka IN ('upper', 'lower')) AS better, min(s) FILTER (ka IN ('upper', 'lower')) AS worse,
         coalesce(max(c) FILTER (ka = 'full'), max(c) FILTER (ka = 'light'), 0) + coalesce(sum(c) FILTER (ka IN ('upper', 'lower')), 0) AS support FROM k GROUP BY ALL)
SELECT l AS "left", r AS "right", CAST(support AS BIGINT) AS support,
       round(CASE WHEN whole IS NULL THEN 0.85 * better + 0.15 * worse WHEN better IS NULL THEN whole ELSE 0.82 * whole + 0.18 * better END, 6) AS score FROM g""")
def part_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = banks(spark, sf_dir)
    return _rounded(scoring.part_scores(rows.select("key", F.col("kind").alias("view"), "vec"), bank_pairs(rows)), "score")


@add("bank_evidence", f"""{BANKS}, {PROTOTYPES},
t AS (SELECT l, r, max(cos) AS best, avg(cos) FILTER (n <= greatest(1, round_even(size * 0.25, 0))) AS consensus, any_value(size) AS n
      FROM (SELECT *, count(*) OVER (PARTITION BY l, r) AS size, row_number() OVER (PARTITION BY l, r ORDER BY cos DESC) AS n FROM x) GROUP BY ALL)
SELECT l AS "left", r AS "right", round(prototype, 6) AS prototype, round(greatest(prototype, best), 6) AS max_exemplar, round(consensus, 6) AS consensus, n
FROM t JOIN proto USING (l, r)""")
def bank_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = banks(spark, sf_dir)
    return _rounded(scoring.bank_scores(rows.select("key", "vec"), bank_pairs(rows)), "prototype", "max_exemplar", "consensus")


@add("blended_evidence", f"""{BANKS}, {PROTOTYPES},
t AS (SELECT l, r, max(cos) AS best, avg(cos) FILTER (n <= 5) AS five, avg(cos) FILTER (n <= 4) AS four
      FROM (SELECT *, row_number() OVER (PARTITION BY l, r ORDER BY cos DESC) AS n FROM x) GROUP BY ALL)
SELECT l AS "left", r AS "right", round(0.55 * prototype + 0.45 * five, 6) AS core, round(0.5 * best + 0.3 * four + 0.2 * prototype, 6) AS track
FROM t JOIN proto USING (l, r)""")
def blended_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = banks(spark, sf_dir)
    pairs, bank = bank_pairs(rows), rows.select("key", "vec")
    return _rounded(scoring.blends(bank, pairs, {"core": scoring.CORE_BLEND, "track": scoring.TRACK_BLEND}), "core", "track")


PATHS = f"""{EV}, p AS (
  SELECT track, event_id, t, ((event_id * 7) % 40)::DOUBLE AS x, ((event_id * 13) % 40)::DOUBLE AS y,
         row_number() OVER w AS i, count(*) OVER (PARTITION BY track) AS n FROM e WINDOW w AS (PARTITION BY track ORDER BY t, event_id)),
h AS (
  SELECT track, list({{'x': x, 'y': y, 't': t}} ORDER BY i) FILTER (i <= n // 2 AND i > n // 2 - 6) AS a, list({{'x': x, 'y': y, 't': t}} ORDER BY i) FILTER (i > n // 2 AND i <= n // 2 + 6) AS b
  FROM p GROUP BY track),
d AS (
  SELECT track, a, b, a[-1] AS z, a[-2] AS y, b[1] AS s, least(greatest(b[1].t - a[-1].t, 0), 1) / greatest(a[-1].t - a[-2].t, 1e-3) AS k,
         a[-1].x - a[1].x AS vx, a[-1].y - a[1].y AS vy, b[-1].x - b[1].x AS wx, b[-1].y - b[1].y AS wy FROM h),
q AS (
  SELECT *, greatest(0, 1 - sqrt(power(s.x - z.x - (z.x - y.x) * k, 2) + power(s.y - z.y - (z.y - y.y) * k, 2)) / 20.0 / 6) AS position,
         sqrt(vx * vx + vy * vy) AS old, sqrt(wx * wx + wy * wy) AS new FROM d)
SELECT track, round(CASE WHEN len(a) >= 2 AND len(b) >= 2 THEN 0.7 * position + 0.3 *
       CASE WHEN old > 1e-3 AND new > 1e-3 THEN 0.5 + 0.5 * greatest(-1, least(1, (vx * wx + vy * wy) / (old * new))) ELSE 0.5 END ELSE 0.5 END, 6) AS score FROM q"""


@add("trajectory_evidence", PATHS)
def trajectory_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each track's second half as a continuation of its first."""
    i, w = F.col("event_id"), Window.partitionBy("track")
    p = events(spark, sf_dir).select("track", "event_id", F.col("t").alias("ts"), ((i * 7) % 40).cast("double").alias("x"), ((i * 13) % 40).cast("double").alias("y"))
    p = p.withColumn("i", F.row_number().over(w.orderBy("ts", "event_id"))).withColumn("half", F.floor(F.count("*").over(w) / 2))
    side = lambda holds: F.transform(F.array_sort(F.collect_list(F.when(holds, F.struct("i", "x", "y", "ts")))), lambda r: F.struct(r["x"].alias("x"), r["y"].alias("y"), r["ts"].alias("ts")))
    near = (F.col("i") > F.col("half") - 6) & (F.col("i") <= F.col("half") + 6)
    halves = p.where(near).groupBy("track").agg(side(F.col("i") <= F.col("half")).alias("a"), side(F.col("i") > F.col("half")).alias("b"))
    gap = F.get("b", F.lit(0))["ts"] - F.get("a", F.size("a") - 1)["ts"]
    return halves.select("track", F.round(scoring.trajectory(F.col("a"), F.col("b"), gap, F.lit(20.0)), 6).alias("score"))


def _share(column: str, modulus: int) -> Column:
    return (F.col(column) % modulus) / float(modulus)


MADE = """WITH x AS (
  SELECT event_id, (event_id % 101) / 101.0::DOUBLE AS score, (event_id % 37) / 37.0::DOUBLE * 0.9 AS second, (user_id % 97) / 97.0::DOUBLE AS body, event_id % 6 AS support, event_id % 5 = 0 AS partial,
         (event_id % 11) / 11.0::DOUBLE AS temporal, (event_id % 13) / 13.0::DOUBLE AS spatial, (event_id % 17) / 17.0::DOUBLE AS face, (event_id % 19) / 19.0::DOUBLE AS face_quality FROM events),
y AS (SELECT *, score - second AS margin FROM x)"""
STRONG = "WHEN body >= 0.72 AND (margin >= 0.035 OR support >= 2) THEN 'body_strong' WHEN body >= 0.6 AND support >= 2 AND margin >= 0.035 THEN 'body_gallery'"
LOOSE = f"WHEN temporal >= 0.35 AND spatial >= 0.35 AND body >= 0.48 THEN 'recent_lost_track' {STRONG} WHEN body >= 0.56 AND support >= 3 AND margin >= 0.02 THEN 'body_accumulated' WHEN partial AND body >= 0.58 AND support >= 2 AND margin >= 0.02 THEN 'partial_body'"


@add("accepting_rules", f"""{MADE}
SELECT event_id, CASE {LOOSE} ELSE 'pending' END AS body_reason,
       CASE WHEN face >= 0.9 AND face_quality >= 0.6 THEN 'face_assisted' {LOOSE}
            WHEN face >= 0.8 AND face_quality >= 0.6 AND body >= 0.42 AND margin >= 0.02 THEN 'face_body_assist' ELSE 'pending' END AS face_reason,
       CASE WHEN temporal >= 0.35 AND spatial >= 0.35 AND body >= 0.56 AND support >= 2 AND margin >= 0.035 THEN 'recent_lost_track' {STRONG}
            WHEN body >= 0.56 AND support >= 3 AND margin >= 0.035 THEN 'body_accumulated' WHEN partial AND body >= 0.6 AND support >= 2 AND margin >= 0.035 THEN 'partial_body'
            ELSE 'pending' END AS guarded_reason,
       score >= 0.5 AND ((support >= 2 AND margin >= 0.04) OR score >= 0.8) AS by_gallery FROM y""")
def accepting_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    x = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", _share("event_id", 101).alias("score"), (_share("event_id", 37) * 0.9).alias("second"), _share("user_id", 97).alias("body"), (i % 6).alias("support"), (i % 5 == 0).alias("partial"),
        _share("event_id", 11).alias("temporal"), _share("event_id", 13).alias("spatial"), _share("event_id", 17).alias("face"), _share("event_id", 19).alias("face_quality"),
    )
    rule = evidence.accepted_by_body
    return x.select("event_id", rule().alias("body_reason"), rule(faces=True).alias("face_reason"), rule(guarded=True).alias("guarded_reason"), evidence.accepted_by_gallery(0.5, 0.8, 2, 0.04).alias("by_gallery"))


BOXES = "WITH x AS (SELECT event_id, event_id // 8 AS frame, (event_id * 7) % 40 AS x1, (event_id * 13) % 40 AS y1, (event_id * 7) % 40 + 12 + event_id % 9 AS x2, (event_id * 13) % 40 + 20 AS y2 FROM events)"
FIGURES = "[(x1 + x2) / 2.0::DOUBLE / 64, y2 / 64.0::DOUBLE, (x2 - x1) / 64.0::DOUBLE, (y2 - y1) / 64.0::DOUBLE, (x2 - x1) * (y2 - y1) / 4096.0::DOUBLE, ln((y2 - y1) / (x2 - x1)::DOUBLE)]"


@add("box_geometries", f"""{BOXES}, g AS (SELECT frame, event_id, {FIGURES} AS g FROM x),
p AS (SELECT a.frame, a.event_id AS a, b.event_id AS b, list_transform(list_zip(a.g, b.g, [0.25, 0.3, 0.18, 0.3, 0.18, 1.0]::DOUBLE[]), lambda z: power((z[1] - z[2]) / z[3], 2)) AS d FROM g a JOIN g b ON a.frame = b.frame AND a.event_id < b.event_id)
SELECT frame, a, b, round(greatest(0, least(1, 1 - sqrt(list_sum(d)) / 3)), 6) AS score FROM p""")
def box_geometries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike boxes of one frame (eight at most) are in place and shape."""
    side = F.lit(64.0)
    g = boxes(spark, sf_dir).select("frame", "event_id", scores.box_geometry(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], side, side).alias("g"))
    a, b = g.select("frame", F.col("event_id").alias("a"), F.col("g").alias("ga")), g.select("frame", F.col("event_id").alias("b"), F.col("g").alias("gb"))
    return a.join(b, "frame").where("a < b").select("frame", "a", "b", F.round(scores.geometry_score(F.col("ga"), F.col("gb")), 6).alias("score"))


@add("track_shapes", f"{BOXES} SELECT user_id AS track, round(median(greatest(1, y2 - y1) / greatest(1, x2 - x1)::DOUBLE), 6) AS shape FROM x JOIN events USING (event_id) GROUP BY user_id")
def track_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = events(spark, sf_dir).select("event_id", "track")
    shape = scores.box_shape(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    return boxes(spark, sf_dir).join(tracks, "event_id").groupBy("track").agg(F.round(F.median(shape), 6).alias("shape"))


@add("measured_rates", f"{EV} SELECT camera, count(*) AS n, round((count(*) - 1) / nullif(max(t) - min(t), 0), 9) AS fps FROM e GROUP BY camera")
def measured_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.measured_rate(events(spark, sf_dir), ["camera"], "t").select("camera", "n", F.round("fps", 9).alias("fps"))


@add("sampling_intervals", "SELECT event_id, CAST(greatest(1, event_id % 4) AS INTEGER) AS every, CAST(greatest(greatest(1, event_id % 4), event_id % 7) AS INTEGER) AS every_part FROM events")
def sampling_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    every, part = scores.sample_interval(F.col("event_id") % 4, F.col("event_id") % 7)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", every.alias("every"), part.alias("every_part"))


@add("complete_tracks", f"""{BANKS} SELECT key, count(DISTINCT (model, view)) FILTER (view <> 'lower') = 9 AS complete FROM f GROUP BY key""")
def complete_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.complete_views(banks(spark, sf_dir), list(MODELS), ["full", "upper", "torso"])


@add("pair_order", f"""{EV} SELECT track, event_id, CAST(row_number() OVER (PARTITION BY track ORDER BY event_id % 3 = 0 DESC, round(value, 1) DESC, event_id DESC) AS INTEGER) AS place FROM e""")
def pair_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("anchored", F.col("event_id") % 3 == 0).withColumn("score", F.round("value", 1))
    return e.select("track", "event_id", F.row_number().over(Window.partitionBy("track").orderBy(*evidence.anchor_first("anchored", "score", "event_id"))).alias("place"))


@add("key_parts", """WITH d AS (SELECT DISTINCT source, lang FROM documents), k AS (SELECT source, lang, 'cam_' || source || ':' || lang || ':7:2' AS key FROM d)
SELECT key, 'cam_' || source || ':' || lang AS camera, 7::BIGINT AS track, 2 AS segment, source || ':' || lang AS bare, '20240102_030405' AS run, source || '.' || lang AS stem FROM k""")
def key_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "lang").distinct()
    k = d.withColumn("key", F.concat(F.lit("cam_"), F.concat_ws(":", "source", "lang", F.lit("7"), F.lit("2"))))
    camera, track, segment = scores.parts_of_key(F.col("key"))
    path = F.concat(F.lit("/video/a.b/"), F.concat_ws(".", "source", "lang", F.lit("mp4")))
    at = F.to_timestamp(F.lit("2024-01-02 03:04:05"))
    return k.select("key", camera.alias("camera"), track.alias("track"), segment.alias("segment"), scores.bare_camera(camera).alias("bare"), scores.run_id(at).alias("run"), scores.path_stem(path).alias("stem"))


GROUPS = f"""{BOXES}, t AS (
  SELECT user_id % 20 AS g, event_id AS key, event_id::DOUBLE AS s, event_id + 0.5::DOUBLE AS e, (y2 - y1) / (x2 - x1)::DOUBLE AS a, (x1 + x2) / 2.0::DOUBLE AS x, y2::DOUBLE AS y
  FROM x JOIN events USING (event_id)), u AS (SELECT *, CASE WHEN a >= 1.35 THEN 'upright' ELSE 'compact' END AS state FROM t)
SELECT g, count(*) AS n, min(s) AS start, max(e) AS "end", round(median(a), 6) AS aspect, CASE WHEN count(DISTINCT state) = 1 THEN any_value(state) ELSE 'mixed' END AS state,
       arg_min(x, (s, key)) AS x_start, arg_min(y, (s, key)) AS y_start, arg_max(x, (s, key)) AS x_end, arg_max(y, (s, key)) AS y_end FROM u GROUP BY g"""


@add("tracklet_groups", GROUPS)
def tracklet_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = scores.box_shape(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    x, y = (F.col("x1") + F.col("x2")) / 2.0, F.col("y2").cast("double")
    rows = boxes(spark, sf_dir).join(events(spark, sf_dir).select("event_id", "track"), "event_id").select(
        (F.col("track") % 20).alias("g"), F.col("event_id").alias("key"), F.col("event_id").cast("double").alias("start"), (F.col("event_id") + 0.5).alias("end"), F.lit(1).cast("long").alias("n"),
        shape.alias("aspect"), scores.posture(shape).alias("state"), x.alias("x_start"), y.alias("y_start"), x.alias("x_end"), y.alias("y_end"),
    )
    return evidence.groups_of(rows, ["g"]).drop("members").withColumn("aspect", F.round("aspect", 6))


def resolver_fixture(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tracklets, features and colours of six people: one cut in two in a camera, one sitting in the other, two alike at one time, one of a single model."""
    people = [  # key, camera, start, end, shape, x at both ends, person, colour
        ("a1", "c1", 0, 4, 1.8, 100, 105, 0, 0), ("a2", "c1", 5, 9, 1.8, 108, 112, 0, 0), ("a3", "c2", 11, 20, 0.9, 40, 44, 0, 0), ("b1", "c1", 2, 8, 1.7, 300, 320, 1, 1), ("b2", "c2", 1, 9, 1.7, 10, 12, 1, 1),
        ("c1", "c2", 30, 36, 1.6, 70, 75, 2, 2), ("d1", "c2", 33, 39, 1.6, 72, 78, 2, 2), ("e1", "c1", 50, 55, 1.6, 90, 95, 3, 3), ("f1", "c2", 50, 55, 1.6, 90, 95, 4, 3),
    ]
    unit = lambda i, n: [1.0 if k == i else 0.0 for k in range(n)]
    rows = [(k, c, float(s), float(e), 5, a, "upright" if a >= 1.35 else "compact", float(x0), 100.0, float(x1), 100.0, 180.0) for k, c, s, e, a, x0, x1, _, _ in people]
    schema = "key string, camera string, start double, end double, n long, aspect double, state string, x_start double, y_start double, x_end double, y_end double, h_end double"
    shared = {"e1": {"swin": 5}, "f1": {"swin": 5}}
    vectors = [(k, m, v, 0, unit(shared.get(k, {}).get(m, p), 8)) for k, _, _, _, a, _, _, p, _ in people for m in MODELS for v in (VIEWS if a >= 1.35 else VIEWS[1:3])]
    features = spark.createDataFrame(vectors, "key string, model string, view string, seq int, vec array<double>")
    return spark.createDataFrame(rows, schema), features, spark.createDataFrame([(p[0], unit(p[8], 4)) for p in people], "key string, vec array<double>")


@add("resolved_identities", """SELECT * FROM (VALUES ('a1', 'c1', 'G000001'), ('a2', 'c1', 'G000001'), ('a3', 'c2', 'G000001'), ('b1', 'c1', 'G000002'), ('b2', 'c2', 'G000002'),
('c1', 'c2', 'G000003'), ('d1', 'c2', 'G000004'), ('e1', 'c1', 'G000005'), ('f1', 'c2', 'G000006')) AS t(key, camera, gid)""")
def resolved_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resolver on a fixed set of tracklets whose identities are known."""
    return resolver.resolve(*resolver_fixture(spark))[0].select("key", "camera", "gid")


ONE_PASS = f"""{BANKS.replace("WITH f", "WITH RECURSIVE f")}, {PROTOTYPES},
t AS (SELECT l, r, avg(cos) FILTER (n <= 5) AS five FROM (SELECT *, row_number() OVER (PARTITION BY l, r ORDER BY cos DESC) AS n FROM x) GROUP BY ALL),
p AS (SELECT l, r, round(0.55 * prototype + 0.45 * five, 6) AS score FROM t JOIN proto USING (l, r)),
b AS (SELECT l AS a, r AS b, score FROM p UNION ALL SELECT r, l, score FROM p),
k AS (SELECT *, row_number() OVER v AS n, coalesce(lead(score) OVER v, 0) AS next FROM b WINDOW v AS (PARTITION BY a ORDER BY score DESC, b)),
w AS (
  SELECT p.l, p.r, p.score FROM p LEFT JOIN k x ON x.a = p.l AND x.b = p.r AND x.n = 1 LEFT JOIN k y ON y.a = p.r AND y.b = p.l AND y.n = 1
  WHERE p.score >= 0.05 AND (p.score >= 0.3 OR least(p.score - x.next, p.score - y.next) >= 0.005 AND x.n = 1 AND y.n = 1)),
o AS (SELECT l, r, row_number() OVER (ORDER BY score DESC, l, r) AS i FROM w),
d AS (SELECT key, min(cam) AS cam, min(label) AS label FROM f GROUP BY key),
z AS (
  SELECT CAST(0 AS BIGINT) AS i, (SELECT list({{'k': key, 'c': cam, 's': label, 'g': key}} ORDER BY key) FROM d) AS m
  UNION ALL
  SELECT i + 1, CASE WHEN ga = gb OR len(list_filter(list_filter(m, lambda q: q.g = ga), lambda q: len(list_filter(list_filter(m, lambda u: u.g = gb), lambda u: u.c = q.c AND NOT (u.s + 1.5 < q.s OR q.s + 1.5 < u.s))) > 0)) > 0
         THEN m ELSE list_transform(m, lambda q: {{'k': q.k, 'c': q.c, 's': q.s, 'g': CASE WHEN q.g = greatest(ga, gb) THEN least(ga, gb) ELSE q.g END}}) END
  FROM (SELECT z.i, z.m, list_filter(z.m, lambda q: q.k = o.l)[1].g AS ga, list_filter(z.m, lambda q: q.k = o.r)[1].g AS gb FROM z JOIN o ON o.i = z.i + 1))
SELECT q.k AS key, q.g AS component FROM (SELECT unnest(arg_max(m, i)) AS q FROM z)"""


@add("one_pass_identities", ONE_PASS)
def one_pass_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Banks joined by clear or strong scores in one pass; a bank lasts 1.5 units from its label on."""
    rows = banks(spark, sf_dir)
    scored = scoring.blended(rows.select("key", "vec"), bank_pairs(rows), scoring.CORE_BLEND).withColumn("score", F.round("score", 6))
    nodes = rows.groupBy("key").agg(F.min("cam").cast("string").alias("camera"), F.min("label").cast("double").alias("start")).withColumn("end", F.col("start") + 1.5)
    return reconcile.one_pass(scored, nodes, reconcile.Choice(0.05, 0.3, 0.005))


@add("live_gates", """WITH x AS (
  SELECT event_id, event_id % 4 AS m, (user_id % 97) / 97.0::DOUBLE AS d, event_id % 3 AS v, (event_id % 19) / 19.0::DOUBLE AS a, (event_id % 101) / 101.0::DOUBLE AS s, (event_id % 37) / 37.0::DOUBLE AS z, event_id % 2 = 0 AS same FROM events)
SELECT event_id, CASE WHEN m < 2 THEN 'models' WHEN d < CASE WHEN same THEN 0.52 ELSE 0.56 END THEN 'deep' WHEN v < 2 AND d < 0.76 THEN 'views' WHEN a < 0.46 AND d < 0.76 THEN 'attributes'
       WHEN s < 0.62 THEN 'score' WHEN s - z < 0.035 AND d < 0.74 THEN 'margin' ELSE 'accepted' END AS reason,
       m >= 2 AND d >= 0.52 AND (v >= 2 OR d >= 0.76) AND (a >= 0.46 OR d >= 0.76) AS own FROM x""")
def live_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    x = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", (i % 4).alias("model_support"), _share("user_id", 97).alias("deep"), (i % 3).alias("view_support"), _share("event_id", 19).alias("attributes"),
        _share("event_id", 101).alias("score"), _share("event_id", 37).alias("second"), (i % 2 == 0).alias("same_camera"),
    )
    return x.select("event_id", evidence.live_reason().alias("reason"), evidence.still_own().alias("own"))


@add("reciprocal_guard", f"""{BANKS}, u AS (SELECT label, list_transform(e, lambda z: z / (sqrt(list_dot_product(e, e)) + 1e-12)) AS e FROM f),
c AS (SELECT label, unnest(range(1, len(e) + 1)) AS i, unnest(e) AS z FROM u),
m AS (SELECT label, list(z ORDER BY i) AS e FROM (SELECT label, i, avg(z) AS z FROM c GROUP BY ALL) GROUP BY ALL),
q AS (SELECT label, e FROM f UNION ALL SELECT label, e FROM m)
SELECT a.label AS gid, max(round({RAW}, 4)) AS best_other FROM q a JOIN m b ON a.label <> b.label GROUP BY a.label""")
def reciprocal_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each label's bank, the best fit of any other label's prototype."""
    bank = banks(spark, sf_dir).select(F.col("label").alias("gid"), "seq", unit(F.col("vec")).alias("vec"))
    return identity.best_others(bank, mean_vectors(bank, ["gid"], "vec", "vec"))
