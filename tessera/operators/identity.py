"""Identities: votes, ids that never change hands, the table of known identities."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.scores import gid
from tessera.functions.vectors import cosine, leave_one_out, mean_vectors
from tessera.operators.cluster import cut, in_order
from tessera.operators.edges import search
from tessera.operators.scoring import diverse

NEAR_SLAB = 4_000_000


def majority(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most frequent ``value`` of each key; of several the one seen first by ``order``."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("votes"), F.min(order).alias("_first"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("votes"), "_first", value))
    return counts.withColumn("_n", rank).where("_n = 1").drop("_n", "_first")


def numbered(components: DataFrame, first: DataFrame, start: int = 1) -> DataFrame:
    """Adds ``gid``: components numbered from ``start`` in the order of ``first`` (component, at), ties by name."""
    ids = in_order(first, [F.col("at"), F.col("component")], "_place")
    ids = ids.select("component", gid(F.lit(start - 1) + F.col("_place")).alias("gid"))
    return components.join(ids, "component", "left")


def survivors(members: DataFrame, next_id: int) -> DataFrame:
    """component and gid: the lowest id that a component's members had and no earlier component took, else a new one.

    ``members`` has component and had (an id or null). Components are served in the order of their lowest id, so each
    gets its lowest unless an earlier one shares it; the conflict is settled in rounds of the components left.
    """
    wish = members.where("had IS NOT NULL").select("component", "had").distinct()
    every = members.select("component").distinct()
    taken = None
    left = wish
    while True:
        best = left.groupBy("component").agg(F.min("had").alias("had"))
        rank = F.row_number().over(Window.partitionBy("had").orderBy("component"))
        now = best.withColumn("_n", rank).where("_n = 1").drop("_n")
        # One round serves all components whose lowest id nobody before them wants.
        now = cut(now, "survivors")
        if not now.head(1):
            break
        taken = now if taken is None else taken.unionByName(now)
        left = cut(left.join(now.select("component"), "component", "left_anti").join(now.select("had"), "had", "left_anti").select("component", "had"), "survivors-left")
    done = (taken if taken is not None else wish.limit(0)).withColumnRenamed("had", "gid")
    new = every.join(done.select("component"), "component", "left_anti")
    new = in_order(new, [F.col("component")], "_place").select("component", (F.lit(next_id - 1) + F.col("_place")).cast(done.schema["gid"].dataType).alias("gid"))
    return done.unionByName(new)


def best_others(bank: DataFrame, prototypes: DataFrame) -> DataFrame:
    """gid and best_other: how well any other identity's prototype fits the bank (gid, seq, vec) of each.

    A prototype fits by the bank's mean or its nearest exemplar. A match with gid whose own score, taken against the same
    bank, is less than this is no reciprocal one.
    """
    means = mean_vectors(bank, ["gid"], "vec", "vec").withColumn("seq", F.lit(-1).cast("long"))
    asks = bank.select("gid", F.col("seq").cast("long").alias("seq"), "vec").unionByName(means.select("gid", "seq", F.col("vec").cast(bank.schema["vec"].dataType).alias("vec")))
    key = F.concat_ws(":", F.col("gid").cast("string"), F.col("seq").cast("string")).alias("id")
    asks = asks.select(key, "gid", "vec")
    base = prototypes.select(F.concat(F.lit("p:"), F.col("gid").cast("string")).alias("id"), "gid", F.col("vec").cast(bank.schema["vec"].dataType).alias("vec"))
    best = search(asks, base, "id", "vec", 1, "gid")
    return best.join(asks.select(F.col("id").alias("query"), "gid"), "query").groupBy("gid").agg(F.max("score").alias("best_other"))


def allocated(components: DataFrame, in_use: DataFrame, given: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(component and gid, given and new): a new id for each component, none of which was ever given out.

    ``given`` (gid) is the log of all ids that were allocated, also of those deleted since; append the second result to
    it before the ids are used, from one writer, and none comes twice.
    """
    high = in_use.select("gid").unionByName(given.select("gid")).agg(F.coalesce(F.max("gid"), F.lit(0)).alias("_high"))
    numbered_ = in_order(components.select("component").distinct(), [F.col("component")], "_place")
    ids = numbered_.join(F.broadcast(high)).select("component", (F.col("_high") + F.col("_place")).cast("long").alias("gid"))  # one row
    return ids, ids.select("gid")


def next_id(df: DataFrame) -> DataFrame:
    """One row: next_id, one more than the largest id in use (reid_id before global_id)."""
    return df.agg((F.coalesce(F.max(F.coalesce("reid_id", "global_id")), F.lit(0)) + 1).alias("next_id"))


def with_identity(detections: DataFrame, mapping: DataFrame, key: str = "tracklet_key", default: str = "UNKNOWN") -> DataFrame:
    """Detections with the gid of their tracklet, ``default`` where it has none."""
    return detections.join(mapping.select(key, "gid"), key, "left").withColumn("gid", F.coalesce("gid", F.lit(default)))


def relabelled(points: DataFrame, mapping: DataFrame, key: str = "point_id") -> DataFrame:
    """Points with new ids where ``mapping`` (key, gid) has one: both id columns change together."""
    m = mapping.select(F.col(key).alias("_k"), F.col("gid").alias("_new"))
    joined = points.join(m, F.col(key) == F.col("_k"), "left")
    return joined.withColumn("global_id", F.coalesce("_new", "global_id")).withColumn("reid_id", F.coalesce("_new", "reid_id")).drop("_k", "_new")


def corrected(versions: DataFrame, key: str = "point_id") -> DataFrame:
    """The latest version of each point's id: how late corrections take effect."""
    return versions.groupBy(key).agg(F.max_by("gid", "version").alias("gid"), F.max("version").alias("version"))


def merged_gallery(old: DataFrame, new: DataFrame, bank_size: int) -> tuple[DataFrame, DataFrame]:
    """Identities (gid, cameras, last_ts, observations) and embeddings (gid, model, seq, vec) after an upsert.

    Observations and times keep the larger value, cameras are joined; a bank drops vectors that it has byte for byte
    and keeps the last ``bank_size`` of each model.
    """
    both = old.select("gid", "model", "seq", "vec", "cameras", "last_ts", "observations").unionByName(new.select("gid", "model", "seq", "vec", "cameras", "last_ts", "observations"))
    identities = both.groupBy("gid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("cameras")))).alias("cameras"), F.max("last_ts").alias("last_ts"), F.max("observations").alias("observations"))
    once = both.groupBy("gid", "model", "vec").agg(F.min("seq").alias("seq"))
    rank = F.row_number().over(Window.partitionBy("gid", "model").orderBy(F.desc("seq"), F.xxhash64("vec")))
    bank = once.withColumn("_n", rank).where(F.col("_n") <= bank_size).select("gid", "model", "seq", "vec")
    return identities, bank


def gallery_scores(components: DataFrame, gallery: DataFrame, weights: dict[str, float], least_models: int = 2) -> DataFrame:
    """component, gid and score: cosines of the mean vectors by model, weighed anew over the models both have."""
    spark = components.sparkSession
    w = spark.createDataFrame(list(weights.items()), "model string, w double")
    a = mean_vectors(components, ["component", "model"], "vec", "_a")
    b = mean_vectors(gallery, ["gid", "model"], "vec", "_b")
    both = a.join(b, "model").join(F.broadcast(w), "model").withColumn("cos", cosine(F.col("_a"), F.col("_b")))
    out = both.groupBy("component", "gid").agg((F.sum(F.col("w") * F.col("cos")) / F.sum("w")).alias("score"), F.count("*").alias("models"))
    return out.where(F.col("models") >= least_models)


def gallery_of(features: DataFrame, mapping: DataFrame, size: int) -> DataFrame:
    """gid, key, seq, vec, quality: an identity's representative gallery, from ``features`` (key, seq, vec, quality) and ``mapping`` (key, gid).

    Each member gives its ``size`` best by quality; of these up to three times ``size`` are picked for being unlike one
    another. A member's bank and an identity's gallery are bounded; one identity's candidates meet in a task.
    """
    best = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("quality"), "seq"))
    some = features.select("key", "seq", "vec", "quality").withColumn("_n", best).where(F.col("_n") <= size).drop("_n")
    some = some.join(mapping.select("key", "gid"), "key").withColumn("_one", F.lit(1.0) - F.col("quality") * 0.0)
    return diverse(some, ["gid"], "vec", "_one", 3 * size).select("gid", "key", "seq", "vec", "quality")


def matched_gallery(scores: DataFrame, least: float = 0.62, margin: float = 0.02) -> DataFrame:
    """component and gid: a component takes its best identity if it is good enough, clear of its second, and free.

    Identities are given in order of score; ties go by component and gid.
    """
    order = Window.partitionBy("component").orderBy(F.desc("score"), "gid")
    top = scores.withColumn("_n", F.row_number().over(order)).withColumn("_second", F.lead("score").over(order)).where("_n = 1")
    good = top.where((F.col("score") >= least) & (F.col("score") - F.coalesce("_second", F.lit(-1.0)) >= margin))
    return good.withColumn("_g", F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("score"), "component"))).where("_g = 1").select("component", "gid", "score")


def anchored(mapping: DataFrame, camera: str, anchors: list[str]) -> DataFrame:
    """Rows of identities that an anchor camera has seen."""
    seen = mapping.groupBy("gid").agg(F.bool_or(F.col(camera).isin(anchors)).alias("_a")).where("_a").select("gid")
    return mapping.join(seen, "gid", "left_semi")


def quality_out(members: DataFrame) -> DataFrame:
    """key, gid, fit (cosine to the mean of its identity's other members) and margin (fit less the best other identity's).

    ``members`` has key, gid and vec.
    """
    rest = leave_one_out(members, ["gid"], "vec").select("key", "gid", "vec", "rest")
    fit = rest.withColumn("fit", cosine(F.col("vec"), F.col("rest")))
    own = F.col("gid").cast("string").alias("gid")
    asks = members.select(F.concat(F.lit("k:"), F.col("key").cast("string")).alias("id"), "vec", own)
    means = mean_vectors(members, ["gid"], "vec", "vec").select(F.concat(F.lit("g:"), F.col("gid").cast("string")).alias("id"), "vec", own)
    best = search(asks, means, "id", "vec", 1, "gid").select(F.col("query").alias("_id"), F.col("score").alias("_best"))
    joined = fit.join(best, F.concat(F.lit("k:"), F.col("key").cast("string")) == F.col("_id"), "left")
    return joined.select("key", "gid", "fit", (F.col("fit") - F.col("_best")).alias("margin"))


def weakest_links(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """key, link (the weakest score to its own identity) and partner; edges are (left, right, score)."""
    both = edges.select(F.col("left").alias("key"), F.col("right").alias("partner"), "score").unionByName(edges.select(F.col("right").alias("key"), F.col("left").alias("partner"), "score"))
    m = mapping.select("key", "gid")
    own = both.join(m, "key").join(m.select(F.col("key").alias("partner"), F.col("gid").alias("_g")), "partner").where("gid = _g")
    return own.groupBy("key").agg(F.min(F.struct("score", "partner")).alias("_m")).select("key", F.col("_m.score").alias("link"), F.col("_m.partner").alias("partner"))


def solve_local(tracklets: DataFrame, bar: float = 0.62, margin: float = 0.04, seed_evidence: float = 0.68, merge_bar: float = 0.80, bank: int = 24) -> DataFrame:
    """key, camera, gid (from 1 within the camera) and reason, for tracklets (key, camera, start, end, evidence, vec).

    A sequence by nature: in the order of start each tracklet joins the identity most like it (mean of its three best
    cosines with the bank) if that is clear and was not seen at the same time, else waits; waiting ones are tried until
    nothing changes; then those of most evidence found identities; last, identities that are alike and never met are
    put together. Cameras are solved in parallel; a camera's tracklets (not its detections) are in one task.
    """

    floor = min(bar - max(margin, 0.0) - 1e-3, bar)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["start", "key"], kind="stable").reset_index(drop=True)
        vecs = np.array([np.asarray(v, float) / (np.linalg.norm(v) + 1e-12) for v in rows["vec"]])
        starts, ends, evidence, keys = rows["start"].tolist(), rows["end"].tolist(), rows["evidence"].tolist(), rows["key"].tolist()
        n = len(rows)
        members: dict[int, list[int]] = {}
        spans: dict[int, list[tuple[float, float]]] = {}
        reason: dict[int, str] = {}
        of = np.zeros(n, np.int64)

        def meets(i: int, g: int) -> bool:
            """Members of one identity never overlap, so the two neighbours in time tell."""
            at = bisect_left(spans[g], (starts[i], ends[i]))
            return any(not (ends[i] < s or e < starts[i]) for s, e in spans[g][max(0, at - 1) : at + 1])

        def score(i: int, g: int) -> float:
            near = np.sort(vecs[members[g][-bank:]] @ vecs[i])[::-1][:3]
            return float(near.mean())

        def near_to(some: list[int], least: float) -> Iterator[tuple[int, np.ndarray]]:
            """Each of ``some`` with the tracklets of that cosine, from products of bounded size."""
            step = max(1, NEAR_SLAB // max(1, n))
            for at in range(0, len(some), step):
                cos = vecs[some[at : at + step]] @ vecs.T
                yield from ((i, np.flatnonzero(c >= least)) for i, c in zip(some[at : at + step], cos, strict=True))

        def candidates(near: np.ndarray) -> list[int]:
            """Identities that can be taken or come within the margin of one that is: no other reaches ``floor`` with any member."""
            groups = np.unique(of[near])
            return groups[groups > 0].tolist()

        def join(i: int, groups: list[int]) -> bool:
            found = sorted(((score(i, g), -g) for g in groups if not meets(i, g)), reverse=True)
            if not found or round(found[0][0], 4) < bar or len(found) > 1 and found[0][0] - found[1][0] < margin:
                return False
            put(i, -found[0][1], "matched")
            return True

        def put(i: int, g: int, why: str) -> None:
            members.setdefault(g, []).append(i)
            insort(spans.setdefault(g, []), (starts[i], ends[i]))
            of[i], reason[i] = g, why

        waiting, near_of = [], {}
        for i, near in near_to(list(range(n)), floor):
            groups = candidates(near)
            if not join(i, groups):
                if evidence[i] >= seed_evidence and all(meets(i, g) or score(i, g) < bar for g in groups):
                    put(i, len(members) + 1, "seeded")
                else:
                    waiting.append(i)
                    near_of[i] = near
        waiting.sort(key=lambda i: (-evidence[i], starts[i], keys[i]))
        asked: dict[int, list[tuple[int, int]]] = {}

        def again(i: int) -> bool:
            """``join``, unless the identities that concern it are as they were when it was refused."""
            groups = candidates(near_of[i])
            state = [(g, len(members[g])) for g in groups]
            if asked.get(i) == state:
                return False
            asked[i] = state
            return join(i, groups)

        while waiting:
            still = [i for i in waiting if not again(i)]
            if len(still) == len(waiting):
                put(still[0], len(members) + 1, "founded")
                still = still[1:]
            waiting = still
        alike: dict[int, set[int]] = {g: set() for g in members}
        for i, near in near_to(list(range(n)), merge_bar - 1e-6):
            alike[int(of[i])].update(np.unique(of[near]).tolist())
        now = {g: g for g in members}

        def last(g: int) -> int:
            while now[g] != g:
                g = now[g]
            return g

        changed = True
        while changed:
            changed = False
            for a in sorted(members):
                if a not in members:
                    continue
                heap = sorted({last(g) for g in alike[a]})
                done = a
                while heap:
                    b = heappop(heap)
                    if b <= done or b not in members:
                        continue
                    done = b
                    if not any(meets(i, a) for i in members[b]):
                        s = vecs[members[a]] @ vecs[members[b]].T
                        if np.sort(s.ravel())[::-1][:5].mean() >= merge_bar:
                            of[members[b]] = a
                            members[a] += members.pop(b)
                            spans[a] = sorted(spans[a] + spans.pop(b))
                            more = alike.pop(b)
                            now[b] = a
                            for g in {last(g) for g in more} - alike[a]:
                                heappush(heap, g)
                            alike[a] |= more
                            changed = True
        return pd.DataFrame({"key": rows["key"], "camera": rows["camera"], "gid": of, "reason": [reason[i] for i in range(n)]})

    kind = tracklets.schema
    return tracklets.groupBy("camera").applyInPandas(run, f"key {kind['key'].dataType.simpleString()}, camera {kind['camera'].dataType.simpleString()}, gid long, reason string")
