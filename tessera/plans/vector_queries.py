"""Queries over ``embeddings``: vec_id is an observation, label its entity, camera vec_id % 4, time vec_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.scores import score_bucket
from tessera.functions.vectors import cosine, leave_one_out, mean_vectors, norm
from tessera.operators import audit, blocks, edges, evaluate, identity, intervals, lanes, reconcile, scoring
from tessera.operators.cluster import assignment, components, constrained_components, cut
from tessera.plans.base import add

ALL = "WITH v AS (SELECT vec_id, label, vec_id % 4 AS cam, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
COS = "round(greatest(-1, least(1, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))))), 4)"
PAIRS = f"{ALL}, p AS (SELECT a.vec_id AS q, b.vec_id AS h, a.cam AS ca, b.cam AS cb, a.label AS la, b.label AS lb, {COS} AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", (F.col("vec_id") % 4).cast("int").alias("cam"), F.col("embedding").alias("vec"))


def near(spark: SparkSession, sf_dir: str, k: int, apart: str | None = None) -> DataFrame:
    """The k nearest of every vector. The queries are all vectors, in blocks against all."""
    v = vectors(spark, sf_dir)
    return edges.search(v, v, "vec_id", "vec", k, apart)


@add("nearest_neighbours", f"{PAIRS} SELECT q AS query, h AS hit, score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, h) AS INTEGER) AS rank FROM p QUALIFY rank <= 10")
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(spark, sf_dir, 10)


@add("nearest_other_camera", f"{PAIRS} SELECT q AS query, h AS hit, score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, h) AS INTEGER) AS rank FROM p WHERE ca <> cb QUALIFY rank <= 5")
def nearest_other_camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(spark, sf_dir, 5, "cam")


@add("mutual_best_pairs", f"{PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, h) AS rl FROM p WHERE ca <> cb) SELECT x.q AS a, x.h AS b, x.score FROM r x JOIN r y ON x.q = y.h AND x.h = y.q WHERE x.rl = 1 AND y.rl = 1 AND x.q < x.h")
def mutual_best_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = cut(near(spark, sf_dir, 1, "cam"), "best")
    back = best.select(F.col("query").alias("h2"), F.col("hit").alias("q2"))
    return best.join(back, (F.col("hit") == F.col("h2")) & (F.col("query") == F.col("q2"))).where("query < hit").select(F.col("query").alias("a"), F.col("hit").alias("b"), "score")


@add("nearest_entity", f"{PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, h) AS n FROM p), t AS (SELECT q, lb, max(score) AS score FROM r WHERE n <= 20 GROUP BY q, lb) SELECT q AS query, lb AS entity, score FROM t QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, lb) = 1")
def nearest_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = vectors(spark, sf_dir).select(F.col("vec_id").alias("hit"), F.col("label").alias("entity"))
    by = near(spark, sf_dir, 20).join(labels, "hit").groupBy("query", "entity").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "entity"))
    return by.withColumn("n", rank).where("n = 1").drop("n")


@add("entity_prototypes", f"{ALL}, u AS (SELECT label, list_transform(e, lambda x: x / (sqrt(list_dot_product(e, e)) + 1e-12)) AS e FROM v), c AS (SELECT label, unnest(range(1, len(e) + 1)) AS i, unnest(e) AS x FROM u), m AS (SELECT label, i, avg(x) AS x FROM c GROUP BY label, i), n AS (SELECT label, sqrt(sum(x * x)) AS size FROM m GROUP BY label) SELECT m.label, CAST(i - 1 AS INTEGER) AS i, round(x / (size + 1e-12), 4) AS x FROM m JOIN n USING (label)")
def entity_prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    unit = v.withColumn("vec", F.transform(F.col("vec").cast("array<double>"), lambda x: x / (norm(F.col("vec")) + 1e-12)))
    return mean_vectors(unit, ["label"], "vec").select("label", F.posexplode("vector").alias("i", "x")).select("label", "i", F.round("x", 4).alias("x"))


@add("weighted_prototypes", f"{ALL}, c AS (SELECT label, greatest(0.1::DOUBLE, (vec_id % 10) / 10.0::DOUBLE) AS w, unnest(range(1, len(e) + 1)) AS i, unnest(e) AS x FROM v), m AS (SELECT label, i, sum(w * x) / sum(w) AS x FROM c GROUP BY label, i) SELECT label, round(sqrt(sum(x * x)), 4) AS size, round(max(x), 4) AS largest FROM m GROUP BY label")
def weighted_prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.greatest(F.lit(0.1), (F.col("vec_id") % 10) / 10.0)
    m = mean_vectors(vectors(spark, sf_dir), ["label"], "vec", "vector", w, normalise=False)
    return m.select("label", F.round(norm(F.col("vector")), 4).alias("size"), F.round(F.array_max("vector"), 4).alias("largest"))


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, ca, cb, cos, n: how many pairs of vectors of one label and two cameras (that of the smaller id first) have a cosine."""
    rows = vectors(spark, sf_dir).select(F.col("label").alias("key"), F.col("vec_id").alias("row"), F.col("cam").alias("side"), "vec")
    return blocks.counted_pairs(rows).withColumnsRenamed({"key": "label", "side_a": "ca", "side_b": "cb"})


def label_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, vec_id, lowest, later: the lowest cosine of each vector with another of its label, and the best with one of a larger id."""
    rows = vectors(spark, sf_dir).select(F.col("label").alias("key"), F.col("vec_id").alias("row"), "vec")
    return blocks.extremes(rows).withColumnsRenamed({"key": "label", "row": "vec_id"})


@add("entity_scores", f"{PAIRS}, r AS (SELECT la AS label, score, count(*) OVER (PARTITION BY la) AS n, row_number() OVER (PARTITION BY la ORDER BY score DESC) AS i FROM p WHERE la = lb AND q < h) SELECT label, max(score) AS max_exemplar, round(avg(score) FILTER (i <= greatest(1, round_even(n * 0.3, 0))), 4) AS consensus, count(*) AS n FROM r GROUP BY label")
def entity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.pooled_counts(label_counts(spark, sf_dir), ["label"]).select("label", "max_exemplar", F.round("consensus", 4).alias("consensus"), "n")


@add("topk_mean_by_entity", f"{PAIRS}, r AS (SELECT la AS label, score, row_number() OVER (PARTITION BY la ORDER BY score DESC) AS i FROM p WHERE la = lb AND q < h) SELECT label, round(avg(score), 4) AS score FROM r WHERE i <= 5 GROUP BY label")
def topk_mean_by_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.topk_counts(label_counts(spark, sf_dir), ["label"], 5).select("label", F.round("score", 4).alias("score"))


@add("leave_one_out_fit", f"{ALL}, u AS (SELECT vec_id, label, list_transform(e, lambda x: x / (sqrt(list_dot_product(e, e)) + 1e-12)) AS e FROM v), c AS (SELECT label, unnest(range(1, len(e) + 1)) AS i, unnest(e) AS x FROM u), s AS (SELECT label, i, sum(x) AS x FROM c GROUP BY label, i), t AS (SELECT label, list(x ORDER BY i) AS s FROM s GROUP BY label), k AS (SELECT label, count(*) AS n FROM u GROUP BY label), r AS (SELECT vec_id, label, e, n, list_transform(list_zip(s, e), lambda z: z[1] - z[2]) AS rest FROM u JOIN t USING (label) JOIN k USING (label)) SELECT vec_id, label, CASE WHEN n > 1 THEN round(list_dot_product(e, rest) / sqrt(list_dot_product(rest, rest)) / sqrt(list_dot_product(e, e)), 4) END AS fit FROM r")
def leave_one_out_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leave_one_out(vectors(spark, sf_dir), ["label"], "vec").select("vec_id", "label", F.round(cosine(F.col("vec"), F.col("rest")), 4).alias("fit"))


@add("score_margins", f"{PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, h) AS n FROM p WHERE ca <> cb QUALIFY n <= 3) SELECT q AS query, max(score) FILTER (n = 1) AS best, round(max(score) FILTER (n = 1) - max(score) FILTER (n = 2), 4) AS margin, round(max(score) FILTER (n = 1) - max(score) FILTER (n = 3), 4) AS margin_third FROM r GROUP BY q")
def score_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    three = near(spark, sf_dir, 3, "cam")
    at = lambda i: F.max(F.when(F.col("rank") == i, F.col("score")))
    return three.groupBy("query").agg(at(1).alias("best"), F.round(at(1) - at(2), 4).alias("margin"), F.round(at(1) - at(3), 4).alias("margin_third"))


def camera_lanes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vectors as rows of lanes of two cameras, and the lanes."""
    return lanes.sides(vectors(spark, sf_dir).withColumnRenamed("vec_id", "row"), "cam")


MARGINS = "SELECT *, max(score) OVER (PARTITION BY q, cb) AS mq, max(score) OVER (PARTITION BY h, ca) AS mh, row_number() OVER (PARTITION BY q, cb ORDER BY score DESC, h) AS i, row_number() OVER (PARTITION BY h, ca ORDER BY score DESC, q) AS j, nth_value(score, 2) OVER (PARTITION BY q, cb ORDER BY score DESC, h ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS sq, nth_value(score, 2) OVER (PARTITION BY h, ca ORDER BY score DESC, q ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS sh FROM r"


@add("row_and_column_margins", f"{PAIRS}, r AS (SELECT ca, cb, q, h, score FROM p WHERE ca < cb AND score >= 0.0001), w AS ({MARGINS}) SELECT q AS \"left\", h AS \"right\", score, round(score - CASE WHEN i = 1 THEN coalesce(sq, 0) ELSE mq END, 4) AS margin_left, round(score - CASE WHEN j = 1 THEN coalesce(sh, 0) ELSE mh END, 4) AS margin_right FROM w")
def row_and_column_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both margins of every pair of positive score, in every lane of two cameras."""
    return lanes.margins(*camera_lanes(spark, sf_dir), bar=1)


ROW_COLUMN_ALL = f"{PAIRS}, r AS (SELECT ca, cb, q, h, score FROM p WHERE ca < cb), w AS (SELECT *, max(score) OVER (PARTITION BY q, cb) AS mq, max(score) OVER (PARTITION BY h, ca) AS mh, row_number() OVER (PARTITION BY q, cb ORDER BY score DESC, h) AS i, row_number() OVER (PARTITION BY h, ca ORDER BY score DESC, q) AS j, nth_value(score, 2) OVER (PARTITION BY q, cb ORDER BY score DESC, h ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS sq, nth_value(score, 2) OVER (PARTITION BY h, ca ORDER BY score DESC, q ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS sh FROM r) SELECT q AS \"left\", h AS \"right\", score, round(score - CASE WHEN i = 1 THEN coalesce(sq, 0) ELSE mq END, 4) AS margin_left, round(score - CASE WHEN j = 1 THEN coalesce(sh, 0) ELSE mh END, 4) AS margin_right FROM w WHERE i = 1 OR j = 1"


@add("row_and_column_margins_all", ROW_COLUMN_ALL)
def row_and_column_margins_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best pair of each row and of each column of every lane, with margins over the whole row and column, from the
    two nearest of each."""
    v = vectors(spark, sf_dir)
    sides = [edges.search(v, v.where(F.col("cam") == c), "vec_id", "vec", 2, "cam").withColumn("to", F.lit(c)) for c in sorted(r.cam for r in v.select("cam").distinct().collect())]
    two = sides[0]
    for s in sides[1:]:
        two = two.unionByName(s)
    two = cut(two.groupBy("query", "to").agg(F.max(F.when(F.col("rank") == 1, F.col("hit"))).alias("best"), F.max("score").alias("first"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second")), "two-nearest")
    cam = v.select("vec_id", "cam")
    found = two.join(cam.select(F.col("vec_id").alias("query"), F.col("cam").alias("of")), "query")
    is_left = F.col("of") < F.col("to")
    pairs = found.select(F.when(is_left, F.col("query")).otherwise(F.col("best")).alias("left"), F.when(is_left, F.col("best")).otherwise(F.col("query")).alias("right"), F.least("of", "to").alias("ca"), F.greatest("of", "to").alias("cb"), F.col("first").alias("score")).distinct()
    side = lambda name, to, x: two.select(F.col("query").alias(name), F.col("to").alias(to), F.col("best").alias(f"b{x}"), F.col("first").alias(f"f{x}"), F.col("second").alias(f"s{x}"))
    both = pairs.join(side("left", "cb", "l"), ["left", "cb"]).join(side("right", "ca", "r"), ["right", "ca"])
    margin = lambda x, other: F.round(F.col("score") - F.when(F.col(f"b{x}") == F.col(other), F.coalesce(f"s{x}", F.lit(0.0))).otherwise(F.col(f"f{x}")), 4)
    return both.select("left", "right", "score", margin("l", "right").alias("margin_left"), margin("r", "left").alias("margin_right"))


@add("reciprocal_jaccard", f"{PAIRS}, r AS (SELECT q, h, row_number() OVER (PARTITION BY q ORDER BY score DESC, h) AS n FROM p QUALIFY n <= 8), m AS (SELECT x.q, x.h FROM r x JOIN r y ON x.q = y.h AND x.h = y.q UNION SELECT DISTINCT q, q FROM r), s AS (SELECT q, list(h) AS s FROM m GROUP BY q) SELECT r.q AS query, r.h AS hit, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 4) AS jaccard FROM r JOIN s a ON a.q = r.q JOIN s b ON b.q = r.h")
def reciprocal_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(near(spark, sf_dir, 8), "near")
    return scoring.reciprocal_jaccard(found, 8).select("query", "hit", F.round("jaccard", 4).alias("jaccard"))


@add("pair_auc", f"{PAIRS}, r AS (SELECT q, h, score, CASE WHEN la = lb THEN 1 ELSE 0 END AS y FROM p QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, h) <= 20) SELECT (SELECT count(*) FROM r WHERE y = 1) AS n_pos, (SELECT count(*) FROM r WHERE y = 0) AS n_neg, round(sum(CASE WHEN x.score > z.score THEN 1.0 WHEN x.score = z.score THEN 0.5 ELSE 0.0 END) / count(*), 4)::DOUBLE AS auc FROM r x JOIN r z ON x.y = 1 AND z.y = 0")
def pair_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = vectors(spark, sf_dir).select("vec_id", "label")
    pairs = near(spark, sf_dir, 20).join(lab.select(F.col("vec_id").alias("query"), F.col("label").alias("la")), "query").join(lab.select(F.col("vec_id").alias("hit"), F.col("label").alias("lb")), "hit")
    out = evaluate.auc(pairs.withColumn("y", (F.col("la") == F.col("lb")).cast("int")), "score", "y")
    return out.select("n_pos", "n_neg", F.round("auc", 4).alias("auc"))


@add("separation_stats", f"{PAIRS} SELECT CASE WHEN ca <> cb THEN 'across' ELSE 'within' END AS kind, count(*) AS n, round(avg(score), 4) AS mean, round(stddev_pop(score), 4) AS std, min(score) AS min, max(score) AS max, round(quantile_cont(score, 0.5), 4) AS p50, round(quantile_cont(score, 0.95), 4) AS p95 FROM p WHERE la = lb AND q < h GROUP BY 1")
def separation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = label_counts(spark, sf_dir).withColumn("kind", F.when(F.col("ca") != F.col("cb"), "across").otherwise("within"))
    return evaluate.summary_of_counts(counts, "cos", ["kind"]).select("kind", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min", "max", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"))


@add("camera_similarity", f"{PAIRS} SELECT la AS label, least(ca, cb)::INTEGER AS camera_x, greatest(ca, cb)::INTEGER AS camera_y, count(*) AS n, round(avg(score), 4) AS mean FROM p WHERE la = lb AND q < h GROUP BY 1, 2, 3")
def camera_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = label_counts(spark, sf_dir).groupBy("label", F.least("ca", "cb").alias("camera_x"), F.greatest("ca", "cb").alias("camera_y"))
    return counts.agg(F.sum("n").alias("n"), F.round(F.sum(F.col("cos") * F.col("n")) / F.sum("n"), 4).alias("mean"))


@add("score_histogram", f"{PAIRS} SELECT CAST(greatest(0, least(5, floor(score * 6))) AS INTEGER) AS bucket, count(*) AS n FROM p WHERE la = lb AND q < h GROUP BY 1")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_counts(spark, sf_dir).groupBy(score_bucket(F.col("cos")).alias("bucket")).agg(F.sum("n").alias("n"))


@add("quorum_by_entity", f"{PAIRS} SELECT la AS label, ca::INTEGER AS ca, count(*) AS n_pairs, count(*) FILTER (score >= 0.5) AS n_above, count(*) FILTER (score >= 0.5) >= greatest(1, round_even(count(*) * 0.6, 0)) AS agreed FROM p WHERE la = lb AND q < h GROUP BY 1, 2")
def quorum_by_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.quorum_of_counts(label_counts(spark, sf_dir), ["label", "ca"], "cos", 0.5, 0.6)


def lane_pairs(rows: DataFrame, key: str) -> DataFrame:
    """(ca, cb, left, right, score): all pairs of positive score, a lane for each two cameras."""
    cam = cut(rows.select(key, "cam", "vec"), "lane-rows")
    found = edges.over(cam, cam, key, "vec", 0.0001, "cam").select(F.col("query").alias("left"), F.col("hit").alias("right"), "score")
    found = found.join(cam.select(F.col(key).alias("left"), F.col("cam").alias("ca")), "left").join(cam.select(F.col(key).alias("right"), F.col("cam").alias("cb")), "right")
    return found.where("ca < cb").select("ca", "cb", "left", "right", "score")


def prototype_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lanes of the cameras' prototypes of labels. A label's prototypes in two cameras are two keys."""
    protos = mean_vectors(vectors(spark, sf_dir), ["label", "cam"], "vec", "vec")
    return lane_pairs(protos.withColumn("key", F.concat_ws(":", "cam", "label")), "key")


def totals(taken: DataFrame) -> DataFrame:
    return taken.groupBy("ca", "cb").agg(F.count("*").alias("n_matched"), F.round(F.sum("score"), 4).alias("total"))


def matched_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ca, cb, left, right, score): the greedy matching of the vectors of each two cameras."""
    rows, pairs = camera_lanes(spark, sf_dir)
    of = pairs.select(F.col("left").alias("lane"), F.col("a").alias("ca"), F.col("b").alias("cb"))
    return lanes.greedy(rows, pairs, bar=1).join(F.broadcast(of), "lane").select("ca", "cb", "left", "right", "score")


#: One edge after another in each lane: the best one whose ends are both free.
GREEDY = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, vec_id % 4 AS cam, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
e AS (SELECT a.cam AS ca, b.cam AS cb, a.vec_id AS l, b.vec_id AS r, {COS} AS score FROM v a JOIN v b ON a.cam < b.cam WHERE {COS} >= 0.0001),
t AS (
  SELECT DISTINCT ca, cb, CAST([] AS BIGINT[]) AS ul, CAST([] AS BIGINT[]) AS ur, 0.0::DOUBLE AS total FROM e
  UNION ALL
  SELECT ca, cb, list_append(ul, b.l), list_append(ur, b.r), total + b.score
  FROM (SELECT t.ca, t.cb, t.ul, t.ur, t.total, arg_min({{'l': l, 'r': r, 'score': score}}, (-score, l, r)) AS b
        FROM t JOIN e ON t.ca = e.ca AND t.cb = e.cb
        WHERE NOT list_contains(t.ul, e.l) AND NOT list_contains(t.ur, e.r) GROUP BY t.ca, t.cb, t.ul, t.ur, t.total))
SELECT CAST(ca AS INTEGER) AS ca, CAST(cb AS INTEGER) AS cb, max(len(ul)) AS n_matched, round(max(total), 4) AS total FROM t GROUP BY ca, cb"""


@add("greedy_matching_totals", GREEDY)
def greedy_matching_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals(matched_cameras(spark, sf_dir))


@add("assignment_totals", None)
def assignment_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals(assignment(prototype_pairs(spark, sf_dir), ["ca", "cb"]))


@add("greedy_matching_invariant", "SELECT 0::BIGINT AS n_twice_left, 0::BIGINT AS n_twice_right")
def greedy_matching_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a key is used twice in a lane by the greedy matching across cameras."""
    taken = cut(matched_cameras(spark, sf_dir), "matched")
    twice = lambda side: taken.groupBy("ca", "cb", side).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n")).select(F.col("n").alias(f"n_twice_{side}"))
    return audit.in_one_row(twice("left"), twice("right"))


#: A fold over the links by falling score: two sets join unless they hold members of one camera.
FOLDED = f"""
WITH RECURSIVE v AS (SELECT vec_id, vec_id % 4 AS cam, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT a.vec_id AS q, b.vec_id AS h, {COS} AS score FROM v a JOIN v b ON a.cam <> b.cam),
r AS (SELECT q, h, score FROM p QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, h) <= 3),
l AS (SELECT DISTINCT least(q, h) AS a, greatest(q, h) AS b, score FROM r WHERE score >= 0.5),
n AS (SELECT a, b, row_number() OVER (ORDER BY score DESC, a, b) AS i FROM l),
f AS (
  SELECT CAST(0 AS BIGINT) AS i, (SELECT list({{'k': vec_id, 'c': cam, 's': vec_id}} ORDER BY vec_id) FROM v) AS m
  UNION ALL
  SELECT i + 1, CASE WHEN sa = sb OR list_has_any(list_transform(list_filter(m, lambda x: x.s = sa), lambda x: x.c), list_transform(list_filter(m, lambda x: x.s = sb), lambda x: x.c)) THEN m
         ELSE list_transform(m, lambda x: {{'k': x.k, 'c': x.c, 's': CASE WHEN x.s = greatest(sa, sb) THEN least(sa, sb) ELSE x.s END}}) END
  FROM (SELECT f.i, f.m, list_filter(f.m, lambda x: x.k = n.a)[1].s AS sa, list_filter(f.m, lambda x: x.k = n.b)[1].s AS sb FROM f JOIN n ON n.i = f.i + 1))
SELECT x.k AS key, x.s AS component FROM (SELECT unnest(arg_max(m, i)) AS x FROM f)"""


@add("constrained_identities", FOLDED)
def constrained_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near vectors of different cameras, with one member of a camera at most."""
    v = vectors(spark, sf_dir)
    links = near(spark, sf_dir, 3, "cam").where("score >= 0.5").select(F.least("query", "hit").alias("left"), F.greatest("query", "hit").alias("right"), "score").distinct()
    nodes = v.select(F.col("vec_id").alias("key"), F.col("cam").cast("string").alias("camera"), F.col("vec_id").cast("double").alias("start"), F.col("vec_id").cast("double").alias("end"))
    return constrained_components(links, nodes, "camera")


@add("constrained_identities_invariant", "SELECT 0::BIGINT AS n_violations")
def constrained_identities_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of one camera in one component, of which the rule ``camera`` leaves none."""
    v = vectors(spark, sf_dir)
    links = near(spark, sf_dir, 3, "cam").where("score >= 0.5").select(F.least("query", "hit").alias("left"), F.greatest("query", "hit").alias("right"), "score").distinct()
    nodes = v.select(F.col("vec_id").alias("key"), F.col("cam").cast("string").alias("camera"), F.col("vec_id").cast("double").alias("start"), F.col("vec_id").cast("double").alias("end"))
    found = constrained_components(links, nodes, "camera").join(nodes.select("key", "camera"), "key")
    return found.groupBy("component", "camera").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n_violations"))


@add("link_components", f"{PAIRS}, r AS (SELECT q, h, score FROM p QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, h) <= 3), e AS (SELECT q AS a, h AS b FROM r WHERE score >= 0.4 UNION SELECT h, q FROM r WHERE score >= 0.4) SELECT a AS key, least(a, min(b)) AS component FROM (WITH RECURSIVE t AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) SELECT * FROM t) GROUP BY a")
def link_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = near(spark, sf_dir, 3).where("score >= 0.4").select(F.col("query").alias("left"), F.col("hit").alias("right"))
    return components(links)


@add("assignment_invariant", "SELECT 0::BIGINT AS n_twice")
def assignment_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that the best assignments between cameras' prototypes use twice."""
    taken = assignment(prototype_pairs(spark, sf_dir), ["ca", "cb"])
    return taken.groupBy("ca", "cb", "right").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n_twice"))


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of tracklets cut from the vectors: four rows of one label and camera are one."""
    number = F.row_number().over(Window.partitionBy("label", "cam").orderBy("vec_id")) - 1
    v = vectors(spark, sf_dir).withColumn("piece", F.floor(number / 4))
    return v.select(F.concat_ws(":", "cam", "label", "piece").alias("key"), F.col("cam").cast("string").alias("camera"), F.col("vec_id").cast("double").alias("ts"), "vec")


@add("reconciled_identities_invariant", f"{ALL}, k AS (SELECT cam, label, (row_number() OVER (PARTITION BY label, cam ORDER BY vec_id) - 1) // 4 AS piece FROM v), t AS (SELECT 1 FROM k GROUP BY cam, label, piece HAVING count(*) >= 3) SELECT count(*) AS n_tracklets, 0::BIGINT AS n_violations FROM t")
def reconciled_identities_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracklets with an identity, and pairs of one identity that one camera saw at one time, of which there are none."""
    obs = pieces(spark, sf_dir)
    found = cut(reconcile.reconcile(obs), "reconciled")
    spans = obs.groupBy("key").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1")).join(found, "key")
    bad = intervals.violations(spans, "component", "camera", "t0", "t1", "key", 64.0).agg(F.count("*").alias("n_violations"))
    return audit.in_one_row(found.agg(F.count("*").alias("n_tracklets")), bad)


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a tracklet of half a unit of time."""
    v = vectors(spark, sf_dir)
    return v.select(F.col("vec_id").alias("key"), F.col("cam").cast("string").alias("camera"), F.col("vec_id").cast("double").alias("start"), (F.col("vec_id") + 0.5).alias("end"), F.lit(0.7).alias("evidence"), "vec")


@add("local_identities", None)
def local_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.solve_local(moments(spark, sf_dir))


@add("local_identities_invariant", "SELECT count(*) AS n_tracklets, 0::BIGINT AS n_gaps FROM embeddings")
def local_identities_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tracklets get an identity of their camera, and cameras' first identities are numbered from 1."""
    got = cut(identity.solve_local(moments(spark, sf_dir)), "solved")
    first = got.groupBy("camera").agg(F.min("gid").alias("low")).where("low <> 1").agg(F.count("*").alias("n_gaps"))
    return audit.in_one_row(got.where("gid IS NOT NULL").agg(F.count("*").alias("n_tracklets")), first)
