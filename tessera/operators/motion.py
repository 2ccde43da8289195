"""Speeds, reachability and shortest ways between cameras."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.geometry import intersection, overlaps, required_speed, verdict
from tessera.operators.cluster import cut
from tessera.operators.intervals import closest_pairings

LEAST_STEPS = 30


def speeds(positions: DataFrame, keys: list[str], least: float = 0.10, most: float = 2.0) -> DataFrame:
    """Speeds between neighbouring positions (ts, x, y) of a key, of steps from ``least`` to ``most`` seconds."""
    w = Window.partitionBy(*keys).orderBy("ts", "x", "y")
    dt = F.col("ts") - F.lag("ts").over(w)
    moved = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    return positions.withColumn("_dt", dt).withColumn("speed", moved / F.nullif(dt, F.lit(0.0))).where((F.col("_dt") >= least) & (F.col("_dt") <= most)).drop("_dt")


def speed_ceilings(steps: DataFrame, keys: list[str], share: float = 0.999, least: int = LEAST_STEPS) -> DataFrame:
    """n and ceiling of each key with ``least`` speeds: the nearest-rank percentile (rank rounded half to even)."""
    w = Window.partitionBy(*keys)
    n = F.count("*").over(w)
    numbered = steps.withColumn("_i", F.row_number().over(w.orderBy("speed")) - 1).withColumn("n", n)
    return numbered.where((F.col("n") >= least) & (F.col("_i") == F.bround((F.col("n") - 1) * F.lit(share)).cast("int"))).select(*keys, "n", F.col("speed").alias("ceiling"))


def reachability(a: DataFrame, b: DataFrame, keys: list[str], limit: Column, clock: float = 0.5, least: int = 3) -> DataFrame:
    """keys, n, required (median speed over the closest pairings) and verdict; both sides have keys, row, ts, x, y, error."""
    pairs = closest_pairings(a, b, keys, "ts", "row")
    side = lambda df, s: df.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("row").alias(f"_row_{s}"), F.col("x").alias(f"x_{s}"), F.col("y").alias(f"y_{s}"), F.col("error").alias(f"e_{s}"))
    for df, s in ((a, "a"), (b, "b")):
        other = side(df, s)
        pairs = pairs.join(other, [pairs[k] == other[f"_{k}"] for k in keys] + [pairs[f"row_{s}"] == other[f"_row_{s}"]]).drop(f"_row_{s}", *[f"_{k}" for k in keys])
    need = required_speed(F.hypot(F.col("x_a") - F.col("x_b"), F.col("y_a") - F.col("y_b")), F.col("e_a") + F.col("e_b"), F.col("ts_a") - F.col("ts_b"), clock)
    out = pairs.withColumn("_v", need).groupBy(*keys).agg(F.count("_v").alias("n"), F.median("_v").alias("required"))
    return out.withColumn("verdict", verdict(F.col("required"), limit, F.col("n") >= least))


def shortest_ways(edges: DataFrame, directed: bool = False) -> DataFrame:
    """a, b and seconds of the quickest way between all cameras, from (a, b, seconds); 0 to itself.

    The graph of cameras is small by nature. Paths double in length each round, so the rounds grow with the logarithm
    of the longest way.
    """
    every = edges if directed else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "seconds"))
    nodes = every.select("a").union(every.select("b")).distinct()
    ways = every.unionByName(nodes.select(F.col("a"), F.col("a").alias("b"), F.lit(0.0).alias("seconds"))).groupBy("a", "b").agg(F.min("seconds").alias("seconds"))
    ways = cut(ways, "ways")
    before = None
    while True:
        on = ways.select(F.col("a").alias("b"), F.col("b").alias("_c"), F.col("seconds").alias("_s"))
        ways = cut(ways.join(on, "b").groupBy("a", F.col("_c").alias("b")).agg(F.min(F.col("seconds") + F.col("_s")).alias("seconds")), "ways")
        now = tuple(ways.agg(F.count("*"), F.sum("seconds")).first())
        if now == before:
            return ways
        before = now


def too_quick(passages: DataFrame, ways: DataFrame) -> DataFrame:
    """Adds ``vetoed``: less time passed between two cameras than the quickest way takes. Unknown cameras never veto; time before 0 counts as 0."""
    w = ways.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "seconds")
    dt = F.greatest(F.col("elapsed"), F.lit(0.0))
    return passages.join(w, (F.col("camera_a") == F.col("_a")) & (F.col("camera_b") == F.col("_b")), "left").withColumn("vetoed", F.coalesce(dt < F.col("seconds"), F.lit(False))).drop("_a", "_b", "seconds")


def box_overlaps(boxes: DataFrame, frame: list[str], key: str, least_iou: float, least_containment: float) -> DataFrame:
    """Pairs of boxes (x1, y1, x2, y2) of one frame that overlap: frame columns, key_a, key_b."""
    a, b = (boxes.select(*frame, F.col(key).alias(f"key_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("x1", "y1", "x2", "y2")]) for s in "ab")
    box = lambda s: [F.col(f"{c}_{s}") for c in ("x1", "y1", "x2", "y2")]
    return a.join(b, frame).where((F.col("key_a") < F.col("key_b")) & overlaps(box("a"), box("b"), least_iou, least_containment)).select(*frame, "key_a", "key_b")


def blocked(boxes: DataFrame, frame: list[str], key: str, least_iou: float, least_containment: float) -> DataFrame:
    """frame columns, key and partners (sorted) of every box that overlaps another."""
    pairs = box_overlaps(boxes, frame, key, least_iou, least_containment)
    both = pairs.select(*frame, F.col("key_a").alias(key), F.col("key_b").alias("_p")).unionByName(pairs.select(*frame, F.col("key_b").alias(key), F.col("key_a").alias("_p")))
    return both.groupBy(*frame, key).agg(F.array_sort(F.collect_set("_p")).alias("partners"))


def occlusion(boxes: DataFrame, frame: list[str], key: str) -> DataFrame:
    """frame columns, key and occluded: the largest share of a box's own area that another covers, 0 for a lone one."""
    a, b = (boxes.select(*frame, F.col(key).alias(f"key_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("x1", "y1", "x2", "y2")]) for s in "ab")
    box = lambda s: [F.col(f"{c}_{s}") for c in ("x1", "y1", "x2", "y2")]
    own = F.nullif((F.col("x2_a") - F.col("x1_a")) * (F.col("y2_a") - F.col("y1_a")), F.lit(0))
    joined = a.join(b, [*frame], "left")
    share = F.when(F.col("key_a") != F.col("key_b"), intersection(box("a"), box("b")) / own)
    return joined.groupBy(*frame, F.col("key_a").alias(key)).agg(F.coalesce(F.max(share), F.lit(0.0)).alias("occluded"))
