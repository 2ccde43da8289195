"""Components, and matchings that fold edges in the order of their score.

An edge that comes first at both its ends is touched by no earlier one, so rounds that settle all such edges take the
same ones as a fold over all edges, without all edges meeting anywhere; a bounded rest is folded in a task.
"""

from __future__ import annotations

import tempfile
import uuid
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANGES = 32
AT_ONCE = 200_000
SHRINKS = 0.95


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: the lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, a: str = "left", b: str = "right", most_rounds: int = 60) -> DataFrame:
    """(key, component): the smallest key reachable, for every key of an edge.

    Each round a key takes the smallest label among its neighbours' and then its label's label, so that the number of
    rounds grows with the logarithm of a component's length.
    """
    both = cut(edges.select(F.col(a).alias("key"), F.col(b).alias("other")).unionByName(edges.select(F.col(b).alias("key"), F.col(a).alias("other"))).distinct(), "edges")
    labels = cut(both.groupBy("key").agg(F.least(F.min("other"), F.col("key")).alias("component")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("key").alias("other"), F.col("component").alias("_c")), "other").groupBy("key").agg(F.min("_c").alias("_m"))
        new = labels.join(near, "key").select("key", "component", F.least("component", "_m").alias("_l"))
        jump = labels.select(F.col("key").alias("_l"), F.col("component").alias("_j"))
        new = cut(new.join(jump, "_l", "left").select("key", F.col("component").alias("_old"), F.least("_l", F.coalesce("_j", "_l")).alias("component")), "labels")
        changed = new.where("_old <> component").head(1)
        labels = new.select("key", "component")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


class Union:
    """Sets of keys with a veto on joining two."""

    def __init__(self) -> None:
        self.parent: dict[Any, Any] = {}
        self.members: dict[Any, list[Any]] = {}

    def find(self, key: Any) -> Any:
        self.parent.setdefault(key, key)
        self.members.setdefault(key, [key])
        root = key
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[key] != root:
            self.parent[key], key = root, self.parent[key]
        return root

    def join(self, a: Any, b: Any) -> None:
        a, b = sorted((self.find(a), self.find(b)))
        if a != b:
            self.parent[b] = a
            self.members[a] += self.members.pop(b)


def _overlap(x: tuple[str, float, float, float], y: tuple[str, float, float, float]) -> bool:
    return x[0] == y[0] and not (x[2] < y[1] or y[2] < x[1])


def _first_at_both_ends(edges: DataFrame) -> DataFrame:
    """Of edges (left, right, score; x and y: the groups they join) those that come first at x and at y, which no earlier edge can touch."""
    order = [F.desc("score"), F.asc("left"), F.asc("right")]
    ends = edges.withColumn("_end", F.explode(F.array("x", "y")))
    first = ends.withColumn("_n", F.row_number().over(Window.partitionBy("_end").orderBy(*order))).where("_n = 1")
    return first.groupBy(*edges.columns).agg(F.count("*").alias("_n")).where("_n = 2").drop("_n")


def _refused(edges: DataFrame, spans: DataFrame, rule: str) -> DataFrame:
    """x and y of the edges that the rule forbids; ``spans`` has group, camera, start, end and bar of all members."""
    side = lambda end: spans.select(F.col("group").alias(end), *[F.col(c).alias(f"_{c}_{end}") for c in ("camera", "start", "end", "bar")])
    met = edges.join(side("x"), "x").join(side("y").withColumnRenamed("y", "_y"), (F.col("y") == F.col("_y")) & F.col("_camera_x").eqNullSafe(F.col("_camera_y")))
    if rule != "camera":
        before = lambda a, b: F.coalesce(F.col(f"_end_{a}") < F.col(f"_start_{b}"), F.lit(False))
        met = met.where(F.coalesce(F.col("score") < F.greatest("_bar_x", "_bar_y"), F.lit(False)) | ~(before("x", "y") | before("y", "x")))
    return met.select("x", "y").distinct()


def _settled(edges: DataFrame, members: DataFrame, spans: DataFrame, rule: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges, members (key, group) and spans after a round: edges that come first at both ends merge their groups or fall, with all edges between the two."""
    top = cut(_first_at_both_ends(edges), "constrained-top")
    merged = cut(top.join(_refused(top, spans, rule), ["x", "y"], "left_anti").select(F.col("x").alias("_into"), F.col("y").alias("_gone")), "constrained-merged")
    into = lambda df, c: df.join(merged.withColumnRenamed("_gone", c), c, "left").withColumn(c, F.coalesce("_into", c)).drop("_into")
    left = into(into(edges.join(top.select("x", "y"), ["x", "y"], "left_anti"), "x"), "y").where("x <> y")
    left = left.withColumns({"x": F.least("x", "y"), "y": F.greatest("x", "y")}).select(*edges.columns)
    # Groups that are forbidden stay so as they grow, and the bar only rises above later scores: of edges between two groups the first tells.
    order = Window.partitionBy("x", "y").orderBy(F.desc("score"), "left", "right")
    left = left.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    spans = into(spans, "group").select(*spans.columns)
    return cut(left, "constrained-edges"), cut(into(members, "group"), "constrained-members"), cut(spans.distinct() if rule == "camera" else spans, "constrained-spans")


def constrained_components(edges: DataFrame, nodes: DataFrame, rule: str = "overlap", at_once: int = AT_ONCE) -> DataFrame:
    """(key, component) of every node; edges (left, right, score) join in order of score unless the rule forbids it.

    ``overlap``: no two members of one camera at one time. ``camera``: no two members of one camera. ``nodes`` has key,
    camera, start and end, and may have bar: members of one camera then join by edges of that score only. Ties go by left
    and right. Components are named by their smallest key.

    While there are more than ``at_once`` edges, rounds settle those that come first at both their ends, which takes the
    same edges as one after another. What is left is folded in one task; only where rounds stop helping (a long path of
    falling scores) it is more than ``at_once``, and folded in a task for each loose component.
    """
    kind = nodes.schema["key"].dataType.simpleString()
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c)
    bar = F.coalesce(F.col("bar").cast("double"), F.lit(float("-inf"))) if "bar" in nodes.columns else F.lit(float("-inf"))
    known = edges.where("left IS NOT NULL AND right IS NOT NULL AND left <> right")
    ends = [F.col(c).cast(kind) for c in ("left", "right")]
    edges = cut(known.select("left", "right", number("score"), F.least(*ends).alias("x"), F.greatest(*ends).alias("y")), "constrained-edges")
    spans = nodes.select(F.col("key").alias("group"), F.col("camera").cast("string").alias("camera"), *([number("start"), number("end")] if rule != "camera" else [F.lit(0.0).alias(c) for c in ("start", "end")]), bar.alias("bar"))
    members: DataFrame | None = None
    n = edges.count()
    while n > at_once:
        if members is None:
            spans = cut(spans, "constrained-spans")
            members = edges.select(F.explode(F.array("x", "y")).alias("key")).distinct().select("key", F.col("key").alias("group"))
        edges, members, spans = _settled(edges, members, spans, rule)
        had, n = n, edges.count()
        if n > SHRINKS * had:
            break
    folded = _folded(edges, spans, rule, kind, n <= at_once)
    if members is None:
        return nodes.select("key").join(folded.withColumnRenamed("group", "key"), "key", "left").select("key", F.coalesce("component", "key").alias("component"))
    named = members.join(folded, "group", "left").select("key", F.coalesce("component", "group").alias("component"))
    return nodes.select("key").join(named, "key", "left").select("key", F.coalesce("component", "key").alias("component"))


def _folded(edges: DataFrame, spans: DataFrame, rule: str, kind: str, together: bool) -> DataFrame:
    """(group, component) of the groups that edges (left, right, score, x, y) have as ends: the fold itself, in one task or in one for each loose component."""
    if together:
        lanes, tagged = edges.select(F.explode(F.array("x", "y")).alias("group")).distinct().withColumn("lane", F.lit(0)), edges.withColumn("lane", F.lit(0))
    else:
        lanes = components(edges, "x", "y").select(F.col("key").alias("group"), F.col("component").alias("lane"))
        tagged = edges.join(lanes.withColumnRenamed("group", "x"), "x")
    blank = lambda *names: [F.lit(None).cast("double").alias(c) for c in names]
    links = tagged.select("lane", F.lit(0).alias("kind"), "x", "y", "left", "right", "score", F.lit(None).cast("string").alias("camera"), *blank("start", "end", "bar"))
    # No null stands for a key, which would turn a column of whole numbers into doubles.
    one = F.col("group")
    held = lanes.join(spans, "group").select("lane", F.lit(1).alias("kind"), one.alias("x"), one.alias("y"), one.cast(edges.schema["left"].dataType).alias("left"), one.cast(edges.schema["right"].dataType).alias("right"), *blank("score"), "camera", "start", "end", "bar")

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        seen: dict[Any, dict[Any, list[tuple]]] = {}  # of each set: spans by camera
        own = rows[rows["kind"] == 1]
        for x, camera, *span in zip(own["x"], own["camera"], own["start"], own["end"], own["bar"], strict=True):
            seen.setdefault(x, {}).setdefault(camera, []).append(tuple(span))
        sets = Union()
        edges = rows[rows["kind"] == 0].sort_values(["score", "left", "right"], ascending=[False, True, True], kind="stable")
        for a, b, score in zip(edges["x"], edges["y"], edges["score"], strict=True):
            x, y = sets.find(a), sets.find(b)
            if x == y:
                continue
            few, many = sorted((seen.get(x, {}), seen.get(y, {})), key=len)
            pairs = ((p, q) for camera in few if camera in many for p in few[camera] for q in many[camera])
            if any(rule == "camera" or score < max(p[2], q[2]) or not (p[1] < q[0] or q[1] < p[0]) for p, q in pairs):
                continue
            sets.join(x, y)
            few, into = seen.pop(max(x, y), {}), seen.setdefault(min(x, y), {})
            for camera, more in few.items():
                into.setdefault(camera, []).extend(more)
        keys = sorted({*edges["x"], *edges["y"]})
        return pd.DataFrame({"group": keys, "component": [sets.find(k) for k in keys]})

    return links.unionByName(held).groupBy("lane").applyInPandas(fold, f"group {kind}, component {kind}")


def in_order(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Adds ``out``: the place of each row, from 1, in the order of all rows.

    Rows are sorted in ranges and a range starts after all rows of those before it, so that no task holds all.
    """
    ranged = cut(df.repartitionByRange(RANGES, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per range
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_before")
    return ranged.join(F.broadcast(counts), "_part").withColumn(out, place).drop("_part", "_before")


def _greedy(rows: pd.DataFrame, lane: list[str], apart: bool) -> pd.DataFrame:
    """The fold itself: edges by falling score, ties by left and right."""
    rows = rows.sort_values([*lane, "_s", "left", "right"], ascending=[True] * len(lane) + [False, True, True], kind="stable")
    keys = list(zip(*(rows[c] for c in lane), strict=True))
    lefts, keep = set(), []
    rights = set() if apart else lefts
    for k, a, b in zip(keys, rows["left"], rows["right"], strict=True):
        good = (k, a) not in lefts and (k, b) not in rights
        keep.append(good)
        if good:
            lefts.add((k, a))
            rights.add((k, b))
    return rows[keep]


def greedy_matching(edges: DataFrame, lane: list[str], score: str = "score", at_once: int = AT_ONCE, apart: bool = True) -> DataFrame:
    """One-to-one edges within each lane, taken by score (ties by left and right).

    While there are more than ``at_once`` edges, rounds take all mutual best choices and drop their ends, which gives the
    same set as one edge after another; each round is two windows and two anti-joins. What is left then is folded by
    tasks, a lane each, so a long path of falling scores needs no round for each of its edges. Keys of left and right are
    ``apart`` (a left key may equal a right one), or else a key is used once on either side.
    """
    left = cut(edges.withColumn("_s", F.col(score)), "greedy")
    taken: DataFrame | None = None
    while left.count() > at_once:
        order = [F.desc("_s"), F.asc("left"), F.asc("right")]
        sides = F.array(*[F.struct(F.lit(i if apart else 0).alias("side"), F.col(c).alias("end")) for i, c in enumerate(("left", "right"))])
        ends = left.withColumn("_end", F.explode(sides))
        best = ends.withColumn("_n", F.row_number().over(Window.partitionBy(*lane, "_end").orderBy(*order))).where("_n = 1").drop("_n", "_end")
        now = cut(best.groupBy(*left.columns).agg(F.count("*").alias("_n")).where("_n = 2").drop("_n"), "greedy-taken")
        taken = now if taken is None else taken.unionByName(now)
        gone = now.select(*lane, F.explode(sides).alias("_end")).distinct()
        for i, c in enumerate(("left", "right")):
            left = left.join(gone.where(F.col("_end.side") == (i if apart else 0)).select(*lane, F.col("_end.end").alias(c)), [*lane, c], "left_anti")
        left = cut(left.select(*now.columns), "greedy")
    rest = left.groupBy(*lane).applyInPandas(lambda rows: _greedy(rows, lane, apart), left.schema)
    return (rest if taken is None else taken.unionByName(rest)).drop("_s")


def chains(edges: DataFrame, score: str = "score") -> DataFrame:
    """Edges by which each key has one successor and one predecessor at most: a greedy matching of ends with starts."""
    return greedy_matching(edges.withColumn("_lane", F.lit(1)), ["_lane"], score).drop("_lane")


def hungarian(gain: np.ndarray) -> list[tuple[int, int]]:
    """Rows and columns of the assignment of the largest sum: shortest augmenting paths with potentials."""
    flip = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if flip else gain)
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, back = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while True:
            used[j0] = True
            free = ~used[1:]
            now = cost[match[j0] - 1] - u[match[j0]] - v[1:]
            better = free & (now < least[1:])
            least[1:][better], back[1:][better] = now[better], j0
            j1 = int(np.argmin(np.where(free, least[1:], np.inf))) + 1
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[1:][free] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[back[j0]], back[j0]
    pairs = [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


def assignment(edges: DataFrame, lane: list[str], score: str = "score") -> DataFrame:
    """Edges of the one-to-one assignment with the largest sum in each lane; a missing edge has score 0 and is not given.

    A lane (a pair of cameras) is one matrix in one task: its size is that of the lane's groups, not of the corpus.
    """

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        ls, rs = sorted(rows["left"].unique()), sorted(rows["right"].unique())
        gain = np.zeros((len(ls), len(rs)))
        at = {(r.left, r.right): (ls.index(r.left), rs.index(r.right)) for r in rows.itertuples()}
        for (a, b), s in zip(at.values(), rows[score], strict=True):
            gain[a, b] = s
        chosen = set(hungarian(gain))
        return rows[[at[l, r] in chosen for l, r in zip(rows["left"], rows["right"], strict=True)]]

    return edges.groupBy(*lane).applyInPandas(solve, edges.schema)


def stitched(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, component): chains put together unless members overlap in time; every node has a component."""
    return constrained_components(chains(edges), nodes.withColumn("camera", F.lit("any")), "overlap")


def split_conflicted(nodes: DataFrame, group: str, key: str = "key") -> DataFrame:
    """Adds ``part``: 1 for all members of a group without overlapping members, else a number of its own for each."""
    a = nodes.select(F.col(group).alias("_g"), F.col(key).alias("_ka"), F.col("start").alias("_sa"), F.col("end").alias("_ea"))
    # Overlap exists if a span starts before the latest end of those that started before it.
    order = Window.partitionBy("_g").orderBy("_sa", "_ea", "_ka").rowsBetween(Window.unboundedPreceding, -1)
    bad = a.withColumn("_reach", F.max("_ea").over(order)).where(F.col("_sa") <= F.col("_reach")).select("_g").distinct().withColumn("_bad", F.lit(True))
    marked = nodes.join(bad, F.col(group) == F.col("_g"), "left").drop("_g")
    number = F.row_number().over(Window.partitionBy(group).orderBy("start", key))
    return marked.withColumn("part", F.when(F.col("_bad"), number).otherwise(1).cast("int")).drop("_bad")

