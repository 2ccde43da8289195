"""Queries over ``events``: event_type is a camera, user_id a track, ts the time, value a position or score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import geometry, scores
from tessera.operators import audit, evaluate, identity, intervals, motion, sessions
from tessera.plans.base import add
from tessera.streaming import engine

GAP = 3600.0
EV = "WITH e AS (SELECT event_id, event_type AS camera, user_id AS track, epoch_us(ts) / 1000000.0::DOUBLE AS t, value, props FROM events)"
SEG = f"{EV}, g AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w > 3600 THEN 1 ELSE 0 END AS n FROM e WINDOW w AS (PARTITION BY camera, track ORDER BY t, event_id)), s AS (SELECT *, CAST(sum(n) OVER (PARTITION BY camera, track ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM g)"
TR = f"{SEG}, k AS (SELECT camera, track, segment, camera || ':' || track || ':' || segment AS key, min(t) AS t0, max(t) AS t1, count(*) AS n, avg(value) AS v FROM s GROUP BY camera, track, segment)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.col("event_type").alias("camera"), F.col("user_id").alias("track"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000000.0)).alias("t"), "value", "props")


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.gap_segments(events(spark, sf_dir), ["camera", "track"], F.col("t"), GAP, ["event_id"])


def tracklets(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = segmented(spark, sf_dir).groupBy("camera", "track", "segment").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("*").alias("n"), F.avg("value").alias("v"))
    return by.withColumn("key", scores.tracklet_key(F.col("camera"), F.col("track"), F.col("segment")))


@add("gap_segments", f"{SEG} SELECT camera, track, segment, count(*) AS n, round(max(t) - min(t), 4) AS span FROM s GROUP BY camera, track, segment")
def gap_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmented(spark, sf_dir).groupBy("camera", "track", "segment").agg(F.count("*").alias("n"), F.round(F.max("t") - F.min("t"), 4).alias("span"))


@add("tracklet_evidence", f"{TR} SELECT key, n, round(0.75 * least(1, abs(v) / 100) + 0.15 * least(1, n / 12.0::DOUBLE) + 0.10 * least(1, (t1 - t0) / 8.0::DOUBLE), 9) AS evidence FROM k")
def tracklet_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = F.least(F.lit(1.0), F.abs("v") / 100)
    return tracklets(spark, sf_dir).select("key", "n", F.round(scores.evidence(quality, F.col("n"), F.col("t1") - F.col("t0")), 9).alias("evidence"))


@add("suppressed_tracklets", f"{TR} SELECT key, n, n >= 3 AS kept FROM k")
def suppressed_tracklets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracklets(spark, sf_dir).select("key", "n", (F.col("n") >= 3).alias("kept"))


@add("keep_last", f"{EV} SELECT camera, track, event_id, t FROM e QUALIFY row_number() OVER (PARTITION BY camera, track ORDER BY t DESC, event_id DESC) <= 2")
def keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.keep_last(events(spark, sf_dir), ["camera", "track"], [F.desc("t"), F.desc("event_id")], 2).select("camera", "track", "event_id", "t")


@add("bank_quota", f"{EV}, r AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY track, camera ORDER BY value DESC, event_id) > 2 THEN 1 ELSE 0 END AS extra FROM e) SELECT track, camera, event_id FROM r QUALIFY row_number() OVER (PARTITION BY track ORDER BY extra, value DESC, event_id) <= 6")
def bank_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.quota(events(spark, sf_dir), ["track"], "camera", [F.desc("value"), F.asc("event_id")], 2, 6).select("track", "camera", "event_id")


@add("span_islands", f"{TR}, o AS (SELECT track, t0, t1, CASE WHEN max(t1) OVER w IS NULL OR t0 - max(t1) OVER w > 7200 THEN 1 ELSE 0 END AS n FROM k WINDOW w AS (PARTITION BY track ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), i AS (SELECT *, sum(n) OVER (PARTITION BY track ORDER BY t0, t1 ROWS UNBOUNDED PRECEDING) AS island FROM o) SELECT track, min(t0) AS t0, max(t1) AS t1, count(*) AS n_spans FROM i GROUP BY track, island")
def span_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sessions.islands(tracklets(spark, sf_dir), ["track"], "t0", "t1", 7200.0)
    return out.select("track", "t0", "t1", "n_spans")


@add("rate_limited", f"""{EV}, u AS (SELECT track, t FROM (SELECT DISTINCT track, t FROM e)), o AS (SELECT track, list(t ORDER BY t) AS ts FROM u GROUP BY track), f AS (SELECT track, list_reduce(list_transform(ts, lambda x: [x]), lambda acc, x: CASE WHEN x[1] - acc[len(acc)] >= 86400 THEN list_concat(acc, x) ELSE acc END) AS taken FROM o) SELECT e.event_id, e.track FROM e JOIN (SELECT track, unnest(taken) AS t FROM f) k ON e.track = k.track AND e.t = k.t""")
def rate_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.rate_limited(events(spark, sf_dir), ["track"], "t", 86400.0).select("event_id", "track")


@add("overlap_state", f"{EV}, a AS (SELECT *, coalesce(value > 50, false) AS active FROM e), b AS (SELECT *, coalesce(lag(active) OVER (PARTITION BY track ORDER BY t, event_id), false) AS before FROM a) SELECT event_id, track, CASE WHEN active AND NOT before THEN 'enter' WHEN NOT active AND before THEN 'exit' END AS edge, CAST(1 + sum(CASE WHEN NOT active AND before THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM b")
def overlap_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("active", F.coalesce(F.col("value") > 50, F.lit(False)))
    return sessions.edges_of_state(e, ["track"], ["t", "event_id"], "active").select("event_id", "track", "edge", "segment")


@add("overlapping_spans", f"{TR} SELECT a.key AS key_a, b.key AS key_b FROM k a JOIN k b ON a.track = b.track AND a.key < b.key AND NOT (a.t1 < b.t0 OR b.t1 < a.t0)")
def overlapping_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.overlapping_pairs(tracklets(spark, sf_dir).select("track", "key", "t0", "t1"), ["track"], "t0", "t1", "key", GAP * 4).select("key_a", "key_b")


@add("overlapping_spans_open", f"{TR} SELECT a.camera, a.key AS key_a, b.key AS key_b FROM k a JOIN k b ON a.camera = b.camera AND a.key < b.key AND a.t0 < b.t1 AND b.t0 < a.t1")
def overlapping_spans_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = intervals.overlapping_pairs(tracklets(spark, sf_dir).select("camera", "key", "t0", "t1"), ["camera"], "t0", "t1", "key", GAP, closed=False)
    return out.select(F.col("camera_a").alias("camera"), "key_a", "key_b")


@add("same_camera_successors", f"{TR} SELECT a.key AS key_a, b.key AS key_b, round(b.t0 - a.t1, 4) AS gap FROM k a JOIN k b ON a.camera = b.camera AND b.t0 > a.t1 AND b.t0 - a.t1 <= 600")
def same_camera_successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.successors(tracklets(spark, sf_dir).select("camera", "key", "t0", "t1"), ["camera"], "t0", "t1", 600.0, places=4).select("key_a", "key_b", "gap")


@add("latest_prior", f"{TR} SELECT key, (SELECT arg_max(p.key, (p.t1, p.key)) FROM k p WHERE p.track = k.track AND p.t1 <= k.t0 AND (p.key <> k.key)) AS prior_key FROM k WHERE t1 > t0")
def latest_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracklets(spark, sf_dir).select("track", "key", "t0", "t1")
    # A span of one moment ends where it starts, so it is asked about nothing.
    return intervals.latest_before(t, ["track"], "t0", "t1", "key").where("t1 > t0").select("key", "prior_key")


ASOF = f"{EV}, a AS (SELECT track, event_id, t FROM e WHERE camera = 'click'), b AS (SELECT track, event_id, t FROM e WHERE camera = 'view'), n1 AS (SELECT a.track, a.event_id AS ea, b.event_id AS eb, a.t AS ta, b.t AS tb FROM a JOIN b USING (track) QUALIFY row_number() OVER (PARTITION BY a.track, a.event_id ORDER BY abs(a.t - b.t), b.t, b.event_id) = 1)"


@add("nearest_in_time", f"{ASOF} SELECT track, ea AS event_id_a, eb AS event_id_b, round(abs(ta - tb), 4) AS dt FROM n1")
def nearest_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    out = intervals.nearest_in_time(e.where("camera = 'click'"), e.where("camera = 'view'"), ["track"], "t", "event_id").where("event_id_b IS NOT NULL")
    return out.select("track", "event_id_a", "event_id_b", F.round(F.abs(F.col("t_a") - F.col("t_b")), 4).alias("dt"))


@add("closest_pairings", f"{ASOF}, n2 AS (SELECT b.track, a.event_id AS ea, b.event_id AS eb, a.t AS ta, b.t AS tb FROM b JOIN a USING (track) QUALIFY row_number() OVER (PARTITION BY b.track, b.event_id ORDER BY abs(a.t - b.t), a.t, a.event_id) = 1), u AS (SELECT * FROM n1 UNION SELECT * FROM n2) SELECT track, ea AS event_id_a, eb AS event_id_b, CAST(row_number() OVER (PARTITION BY track ORDER BY abs(ta - tb), ea, eb) AS INTEGER) AS rank FROM u QUALIFY rank <= 9")
def closest_pairings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return intervals.closest_pairings(e.where("camera = 'click'"), e.where("camera = 'view'"), ["track"], "t", "event_id").select("track", "event_id_a", "event_id_b", "rank")


@add("identity_conflicts", f"{TR} SELECT DISTINCT a.key AS query, b.track FROM k a JOIN k b ON a.camera = b.camera AND a.key <> b.key AND NOT (a.t1 < b.t0 OR b.t1 < a.t0) WHERE a.n >= 2")
def identity_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracklets(spark, sf_dir)
    return intervals.conflicts(t, "track", "camera", "t0", "t1", "key", t.where("n >= 2"), GAP)


@add("overlap_violations", f"{TR} SELECT count(*) AS n_violations FROM k a JOIN k b ON a.camera = b.camera AND a.track = b.track AND a.key < b.key AND NOT (a.t1 < b.t0 OR b.t1 < a.t0)")
def overlap_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracklets(spark, sf_dir).select("track", "camera", "t0", "t1", "key")
    return intervals.violations(t, "track", "camera", "t0", "t1", "key", GAP * 4).agg(F.count("*").alias("n_violations"))


@add("temporal_scores", f"{TR} SELECT a.key AS key_a, b.key AS key_b, round(CASE WHEN NOT (a.t1 < b.t0 OR b.t1 < a.t0) THEN 0.5 ELSE greatest(0, 1 - (greatest(a.t0, b.t0) - least(a.t1, b.t1)) / 30.0::DOUBLE) END, 4) AS score FROM k a JOIN k b ON a.track = b.track AND a.key < b.key")
def temporal_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracklets(spark, sf_dir).select("track", "key", "t0", "t1")
    a, b = (t.select("track", *[F.col(c).alias(f"{c}_{s}") for c in ("key", "t0", "t1")]) for s in "ab")
    return a.join(b, "track").where("key_a < key_b").select("key_a", "key_b", F.round(scores.temporal(F.col("t0_a"), F.col("t1_a"), F.col("t0_b"), F.col("t1_b")), 4).alias("score"))


@add("speed_percentiles", f"{EV}, d AS (SELECT camera, abs(value - lag(value) OVER w) AS moved, t - lag(t) OVER w AS dt FROM e WINDOW w AS (PARTITION BY camera ORDER BY t, value)), s AS (SELECT camera, moved / dt AS speed FROM d WHERE dt >= 1 AND dt <= 3600), n AS (SELECT camera, speed, count(*) OVER (PARTITION BY camera) AS n, row_number() OVER (PARTITION BY camera ORDER BY speed) - 1 AS i FROM s) SELECT camera, n, round(speed, 6) AS ceiling FROM n WHERE n >= 30 AND i = round_even((n - 1) * 0.99, 0)")
def speed_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = events(spark, sf_dir).select("camera", F.col("t").alias("ts"), F.col("value").alias("x"), F.lit(0.0).alias("y"))
    return motion.speed_ceilings(motion.speeds(p, ["camera"], 1.0, 3600.0), ["camera"], 0.99).select("camera", "n", F.round("ceiling", 6).alias("ceiling"))


@add("reachability_verdict", f"{ASOF}, n2 AS (SELECT b.track, a.event_id AS ea, b.event_id AS eb, a.t AS ta, b.t AS tb FROM b JOIN a USING (track) QUALIFY row_number() OVER (PARTITION BY b.track, b.event_id ORDER BY abs(a.t - b.t), a.t, a.event_id) = 1), u AS (SELECT * FROM n1 UNION SELECT * FROM n2), c AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY track ORDER BY abs(ta - tb), ea, eb) <= 9), r AS (SELECT c.track, greatest(abs(x.value - y.value) - 2.0, 0) / (abs(ta - tb) + 0.5) AS v FROM c JOIN events x ON x.event_id = ea JOIN events y ON y.event_id = eb), m AS (SELECT track, count(v) AS n, median(v) AS required FROM r GROUP BY track) SELECT track, n, round(required, 6) AS required, CASE WHEN n < 3 OR required IS NULL THEN 'unavailable' WHEN required > 0.001 THEN 'impossible' ELSE 'plausible' END AS verdict FROM m")
def reachability_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("camera", "track", F.col("event_id").alias("row"), F.col("t").alias("ts"), F.col("value").alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("error"))
    out = motion.reachability(e.where("camera = 'click'"), e.where("camera = 'view'"), ["track"], F.lit(0.001))
    return out.select("track", "n", F.round("required", 6).alias("required"), "verdict")


@add("camera_ways", f"{EV}, d AS (SELECT lag(camera) OVER w AS a, camera AS b, t - lag(t) OVER w AS dt FROM e WINDOW w AS (PARTITION BY track ORDER BY t, event_id)), m AS (SELECT a, b, min(dt) AS s FROM d WHERE a IS NOT NULL AND a <> b AND dt > 0 GROUP BY a, b), u AS (SELECT a, b, min(s) AS s FROM (SELECT a, b, s FROM m UNION ALL SELECT b, a, s FROM m UNION ALL SELECT a, a, 0.0 FROM m UNION ALL SELECT b, b, 0.0 FROM m) GROUP BY a, b), u2 AS (SELECT x.a, y.b, min(x.s + y.s) AS s FROM u x JOIN u y ON x.b = y.a GROUP BY 1, 2), u4 AS (SELECT x.a, y.b, min(x.s + y.s) AS s FROM u2 x JOIN u2 y ON x.b = y.a GROUP BY 1, 2) SELECT x.a, y.b, round(min(x.s + y.s), 4) AS seconds FROM u4 x JOIN u4 y ON x.b = y.a GROUP BY 1, 2")
def camera_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("track").orderBy("t", "event_id")
    d = events(spark, sf_dir).select(F.lag("camera").over(w).alias("a"), F.col("camera").alias("b"), (F.col("t") - F.lag("t").over(w)).alias("dt"))
    quickest = d.where("a IS NOT NULL AND a <> b AND dt > 0").groupBy("a", "b").agg(F.min("dt").alias("seconds"))
    return motion.shortest_ways(quickest).select("a", "b", F.round("seconds", 4).alias("seconds"))


@add("topology_veto", f"{EV}, d AS (SELECT event_id, lag(camera) OVER w AS ca, camera AS cb, t - lag(t) OVER w AS dt FROM e WINDOW w AS (PARTITION BY track ORDER BY t, event_id)) SELECT event_id, coalesce(CASE WHEN ca = cb THEN false WHEN ca = 'error' OR cb = 'error' THEN NULL ELSE greatest(dt, 0) < 3600 * (CASE WHEN (ca, cb) IN (('click', 'signup'), ('signup', 'click')) THEN 2 ELSE 1 END) END, false) AS vetoed FROM d WHERE ca IS NOT NULL AND ca IN ('click', 'view', 'signup') AND cb IN ('click', 'view', 'signup')")
def topology_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = spark.createDataFrame([("click", "view", 3600.0), ("view", "signup", 3600.0)], "a string, b string, seconds double")
    w = Window.partitionBy("track").orderBy("t", "event_id")
    d = events(spark, sf_dir).select("event_id", F.lag("camera").over(w).alias("camera_a"), F.col("camera").alias("camera_b"), (F.col("t") - F.lag("t").over(w)).alias("elapsed"))
    seen = d.where(F.col("camera_a").isin("click", "view", "signup") & F.col("camera_b").isin("click", "view", "signup"))
    return motion.too_quick(seen, motion.shortest_ways(edges)).select("event_id", "vetoed")


@add("verifier_probability", "SELECT event_id, round(1 / (1 + exp(-(-13.5 + 11.0 * ((user_id % 100) / 100.0::DOUBLE) + 7.0 * ((event_id % 100) / 100.0::DOUBLE) + 0.6 * ln(1 + event_id % 7) - 0.01 * (event_id % 50) + coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE 0.9 END, 0.5)))), 4) AS p FROM events")
def verifier_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i = F.col("event_id")
    p = scores.verifier((F.col("user_id") % 100) / 100.0, (i % 100) / 100.0, i % 7, i % 50, F.when(i % 3 != 0, F.lit(0.9)))
    return e.select("event_id", F.round(p, 4).alias("p"))


@add("gate_reasons", "SELECT event_id, CASE WHEN value IS NULL THEN 'no_value' WHEN value < 5 THEN 'too_small' WHEN user_id % 11 = 0 THEN 'clipped' WHEN event_type = 'error' THEN 'rejected' ELSE 'passed' END AS reason FROM events")
def gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rules = (("no_value", F.col("value").isNull()), ("too_small", F.col("value") < 5), ("clipped", F.col("user_id") % 11 == 0), ("rejected", F.col("event_type") == "error"))
    return e.select("event_id", scores.first_reason(*rules, otherwise="passed").alias("reason"))


BOX = "WITH x AS (SELECT event_id, event_id // 8 AS frame, (event_id * 7) % 40 AS x1, (event_id * 13) % 40 AS y1, (event_id * 7) % 40 + 12 + event_id % 9 AS x2, (event_id * 13) % 40 + 20 AS y2 FROM events), p AS (SELECT a.frame, a.event_id AS key_a, b.event_id AS key_b, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) AS sa, (b.x2 - b.x1) * (b.y2 - b.y1) AS sb FROM x a JOIN x b ON a.frame = b.frame AND a.event_id <> b.event_id)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes made of event ids, eight to a frame."""
    i = F.col("event_id")
    x1, y1 = (i * 7) % 40, (i * 13) % 40
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.floor(i / 8).alias("frame"), x1.alias("x1"), y1.alias("y1"), (x1 + 12 + i % 9).alias("x2"), (y1 + 20).alias("y2"))


@add("box_overlaps", f"{BOX} SELECT frame, key_a, key_b FROM p WHERE key_a < key_b AND (i / (sa + sb - i)::DOUBLE >= 0.3 OR i / least(sa, sb)::DOUBLE >= 0.6)")
def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.box_overlaps(boxes(spark, sf_dir), ["frame"], "event_id", 0.3, 0.6)


@add("overlap_partners", f"{BOX} SELECT frame, key_a AS event_id, string_agg(key_b::VARCHAR, ',' ORDER BY key_b) AS partners FROM p WHERE i / (sa + sb - i)::DOUBLE >= 0.3 OR i / least(sa, sb)::DOUBLE >= 0.6 GROUP BY frame, key_a")
def overlap_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.blocked(boxes(spark, sf_dir), ["frame"], "event_id", 0.3, 0.6).select("frame", "event_id", F.array_join(F.transform("partners", lambda x: x.cast("string")), ",").alias("partners"))


@add("occlusion", f"{BOX} SELECT x.frame, x.event_id, round(coalesce(max(p.i / p.sa::DOUBLE), 0), 4) AS occluded FROM x LEFT JOIN p ON p.key_a = x.event_id GROUP BY 1, 2")
def occlusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.occlusion(boxes(spark, sf_dir), ["frame"], "event_id").select("frame", "event_id", F.round("occluded", 4).alias("occluded"))


@add("floor_positions", f"{BOX}, f AS (SELECT event_id, (x1 + x2) / 2.0::DOUBLE AS u, y2::DOUBLE AS v, x1 <= 2 OR y1 <= 2 OR x2 >= 58 OR y2 >= 58 AS clipped FROM x) SELECT event_id, round((0.5 * u + 0.1 * v + 1) / (0.001 * u + 0.002 * v + 1), 4) AS x, round((0.05 * u + 0.4 * v + 2) / (0.001 * u + 0.002 * v + 1), 4) AS y, CASE WHEN clipped THEN 0.75 ELSE 0.25 END::DOUBLE AS error FROM f")
def floor_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    u, v = geometry.foot_point(b)
    h = F.array(*[F.lit(x) for x in (0.5, 0.1, 1.0, 0.05, 0.4, 2.0, 0.001, 0.002, 1.0)])
    clipped = geometry.is_clipped(b, F.lit(60), F.lit(60))
    out = boxes(spark, sf_dir).withColumn("p", geometry.project(h, u, v))
    return out.select("event_id", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"), F.when(clipped, 0.75).otherwise(0.25).alias("error"))


@add("identity_vote", f"{EV}, c AS (SELECT track, camera, count(*) AS votes, min(event_id) AS f FROM e GROUP BY track, camera) SELECT track, camera, votes FROM c QUALIFY row_number() OVER (PARTITION BY track ORDER BY votes DESC, f, camera) = 1")
def identity_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.majority(events(spark, sf_dir), ["track"], "camera", "event_id")


@add("run_summary", f"{EV}, m AS (SELECT track, count(DISTINCT camera) > 1 AS multi FROM e GROUP BY track) SELECT camera, count(*) AS n_rows, count(DISTINCT track) AS n_identities, count(DISTINCT CASE WHEN multi THEN track END) AS n_multi FROM e JOIN m USING (track) GROUP BY ROLLUP (camera)")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.run_summary(events(spark, sf_dir), "camera", "track")


@add("value_summary", f"{EV} SELECT camera, count(value) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.05), 4) AS p5, round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.75), 4) AS p75, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99 FROM e GROUP BY camera")
def value_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluate.summary(events(spark, sf_dir), "value", ["camera"])
    return s.select("camera", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std")], "min", "max", *[F.round(c, 4).alias(c) for c in s.columns if c[0] == "p"])


@add("primary_camera", f"{TR}, y AS (SELECT track, camera, sum(t1 - t0) AS span FROM k GROUP BY track, camera) SELECT track, camera, round(span, 3) AS span FROM y QUALIFY row_number() OVER (PARTITION BY track ORDER BY round(span, 3) DESC, camera) = 1")
def primary_camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = tracklets(spark, sf_dir).groupBy("track", "camera").agg(F.round(F.sum(F.col("t1") - F.col("t0")), 3).alias("span"))
    return by.withColumn("n", F.row_number().over(Window.partitionBy("track").orderBy(F.desc("span"), "camera"))).where("n = 1").drop("n")


@add("survivor_ids", f"{EV}, w AS (SELECT DISTINCT track AS component, CAST(event_id % 500 AS BIGINT) AS had FROM e WHERE event_id % 5 = 0) SELECT count(*) AS n_components, count(DISTINCT component) AS n_distinct, (SELECT count(DISTINCT track) FROM e) AS n_tracks FROM (SELECT DISTINCT track AS component FROM e)")
def survivor_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every component gets one id and no id is given twice: the count of components, of distinct ids, of tracks."""
    m = events(spark, sf_dir).select(F.col("track").alias("component"), F.when(F.col("event_id") % 5 == 0, F.col("event_id") % 500).alias("had"))
    ids = identity.survivors(m, 100_000)
    n = m.select("component").distinct().agg(F.count("*").alias("n_tracks"))
    return audit.in_one_row(ids.agg(F.count("*").alias("n_components"), F.count_distinct("gid").alias("n_distinct")), n)


@add("numbered_identities", f"{EV}, f AS (SELECT track AS component, min(t) AS t0 FROM e GROUP BY track) SELECT component, 'G' || lpad(CAST(row_number() OVER (ORDER BY t0, component) AS VARCHAR), 6, '0') AS gid FROM f")
def numbered_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = events(spark, sf_dir).groupBy(F.col("track").alias("component")).agg(F.min("t").alias("at"))
    return identity.numbered(first.select("component"), first)


@add("unmatched_default", f"{EV}, m AS (SELECT track, 'G' || track AS gid FROM e GROUP BY track HAVING count(*) >= 12) SELECT e.event_id, coalesce(m.gid, 'UNKNOWN') AS gid FROM e LEFT JOIN m USING (track)")
def unmatched_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    m = e.groupBy("track").agg(F.count("*").alias("n")).where("n >= 12").select("track", F.concat(F.lit("G"), F.col("track").cast("string")).alias("gid"))
    return identity.with_identity(e.select("event_id", "track"), m, "track").select("event_id", "gid")


@add("anchor_required", f"{EV}, g AS (SELECT track AS gid, bool_or(camera = 'purchase') AS a FROM e GROUP BY track) SELECT e.event_id, g.gid FROM e JOIN g ON g.gid = e.track WHERE a")
def anchor_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", "camera", F.col("track").alias("gid"))
    return identity.anchored(e, "camera", ["purchase"]).select("event_id", "gid")


@add("exclusion_counts", f"{EV} SELECT reason, count(event_id) AS n FROM (VALUES ('click'), ('purchase'), ('never')) k(reason) LEFT JOIN e ON e.camera = reason GROUP BY reason UNION ALL SELECT camera, count(*) FROM e WHERE camera NOT IN ('click', 'purchase', 'never') GROUP BY camera")
def exclusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.exclusions(events(spark, sf_dir).select(F.col("camera").alias("excluded_by")), ["click", "purchase", "never"])


@add("camera_pair_matrix", f"{EV}, d AS (SELECT lag(camera) OVER w AS a, camera AS b, value FROM e WINDOW w AS (PARTITION BY track ORDER BY t, event_id)) SELECT least(a, b) AS camera_x, greatest(a, b) AS camera_y, count(*) AS considered, count(*) FILTER (value > 50) AS merged, count(*) FILTER (value < 10) AS excluded FROM d WHERE a <> b GROUP BY 1, 2")
def camera_pair_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("track").orderBy("t", "event_id")
    d = events(spark, sf_dir).select(F.lag("camera").over(w).alias("camera_a"), F.col("camera").alias("camera_b"), (F.col("value") > 50).alias("accepted"), F.when(F.col("value") < 10, "low").alias("excluded_by"))
    return audit.camera_pairs(d)


@add("fragmentation_stats", f"{TR}, m AS (SELECT camera, CASE WHEN n >= 2 THEN track END AS gid FROM k), b AS (SELECT gid, count(*) AS n, count(DISTINCT camera) AS c FROM m WHERE gid IS NOT NULL GROUP BY gid) SELECT (SELECT count(*) FROM m) AS n_tracklets, (SELECT count(*) FROM m WHERE gid IS NULL) AS n_suppressed, count(*) AS n_identities, round(avg(n), 6) AS mean_size, max(n) AS largest, count(*) FILTER (n > 1) AS n_fragmented, count(*) FILTER (c > 1) AS n_multi_camera FROM b")
def fragmentation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.fragmentation(tracklets(spark, sf_dir).select("camera", F.when(F.col("n") >= 2, F.col("track")).alias("gid")))


@add("fair_order", f"{EV} SELECT event_id, CAST(row_number() OVER (PARTITION BY camera ORDER BY t DESC, event_id) AS INTEGER) AS turn FROM e QUALIFY turn <= 20")
def fair_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.fair(events(spark, sf_dir), "camera", [F.desc("t"), F.asc("event_id")], 20).select("event_id", "turn")


@add("newest_per_track", f"{EV} SELECT track, event_id FROM e QUALIFY row_number() OVER (PARTITION BY track ORDER BY t DESC, event_id DESC) = 1")
def newest_per_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.newest(events(spark, sf_dir), ["track"], [F.desc("t"), F.desc("event_id")])[0].select("track", "event_id")


@add("active_identities", f"{EV}, i AS (SELECT track AS gid, max(t) AS last_ts FROM e GROUP BY track), n AS (SELECT max(t) AS now FROM e) SELECT gid, round(last_ts, 3) AS last_ts FROM i, n WHERE now - last_ts <= 86400 * 3 ORDER BY i.last_ts DESC, gid LIMIT 50")
def active_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    now = e.agg(F.max("t")).first()[0] or 0.0
    ids = e.groupBy(F.col("track").alias("gid")).agg(F.max("t").alias("last_ts"))
    return engine.active(ids, F.lit(now), 86400.0 * 3, 50).select("gid", F.round("last_ts", 3).alias("last_ts"))


@add("props_values", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def props_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@add("lanes_used", f"{TR} SELECT a.track, CAST(max(1 + (SELECT count(*) FROM k b WHERE b.track = a.track AND (b.t0, b.t1, b.key) < (a.t0, a.t1, a.key) AND b.t1 > a.t0)) AS BIGINT) AS n_lanes, count(*) AS n_spans FROM k a GROUP BY a.track")
def lanes_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lanes a track's spans take: as many as meet at one time."""
    packed = sessions.lanes(tracklets(spark, sf_dir).select("track", "key", "t0", "t1"), ["track"], "t0", "t1", "key")
    return packed.groupBy("track").agg((F.max("lane") + 1).alias("n_lanes"), F.count("*").alias("n_spans"))


@add("lane_packing_invariant", "SELECT 0::BIGINT AS n_clashes")
def lane_packing_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of one lane that meet, of which packing leaves none."""
    t = tracklets(spark, sf_dir).select("track", "key", "t0", "t1")
    packed = sessions.lanes(t, ["track"], "t0", "t1", "key")
    w = Window.partitionBy("track", "lane").orderBy("t0", "t1", "key")
    return packed.withColumn("before", F.max("t1").over(w.rowsBetween(Window.unboundedPreceding, -1))).where("before > t0").agg(F.count("*").alias("n_clashes"))


@add("sample_and_hold", f"{EV}, s AS (SELECT track, t, max(value) AS value FROM e GROUP BY track, t), b AS (SELECT track, min(t) AS a, max(t) AS z FROM s GROUP BY track), g AS (SELECT track, a + 43200.0::DOUBLE * unnest(range(0, CAST(floor((z - a) / 43200.0) AS BIGINT) + 1)) AS t FROM b) SELECT g.track, round(g.t, 3) AS t, CASE WHEN g.t - s.t <= 86400 THEN s.value END AS value FROM g ASOF JOIN s ON g.track = s.track AND g.t >= s.t")
def sample_and_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events(spark, sf_dir).select("track", "t", "value")
    return sessions.sample_and_hold(s, ["track"], "t", "value", 43200.0, 86400.0).select("track", F.round("t", 3).alias("t"), "value")


@add("sample_and_hold_all", f"{EV}, s AS (SELECT camera, t, max(value) AS value FROM e GROUP BY camera, t), b AS (SELECT camera, min(t) AS a, max(t) AS z FROM s GROUP BY camera), g AS (SELECT camera, a + 43200.0::DOUBLE * unnest(range(0, CAST(floor((z - a) / 43200.0) AS BIGINT) + 1)) AS t FROM b) SELECT g.camera, round(g.t, 3) AS t, CASE WHEN g.t - s.t <= 86400 THEN s.value END AS value FROM g ASOF JOIN s ON g.camera = s.camera AND g.t >= s.t")
def sample_and_hold_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``sample_and_hold``, by camera."""
    s = events(spark, sf_dir).select("camera", "t", "value")
    return sessions.sample_and_hold(s, ["camera"], "t", "value", 43200.0, 86400.0).select("camera", F.round("t", 3).alias("t"), "value")
