"""Camera-aware reranking: neighbourhoods of two sizes, compared by Jaccard and blended with cosine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.cluster import cut
from tessera.operators.edges import search


def reranked(queries: DataFrame, gallery: DataFrame, candidates: int = 10, k: int = 8, boost: int = 4, share: float = 0.7) -> DataFrame:
    """query, hit, cosine, jaccard, score: the ``candidates`` nearest of each query with ``share`` cosine and the rest Jaccard.

    Both tables have id, camera and vec. A row's neighbourhood for a camera is its ``k`` nearest in the gallery, ``boost``
    more if its own camera is another one. Two rows are neighbours if each is in the other's neighbourhood for its camera;
    a query's set is its neighbours and theirs, a candidate's its neighbours and itself. A gallery of ``k`` rows or fewer
    says nothing of neighbourhoods: cosine alone counts, and Jaccard is null.
    """
    window = k + boost
    wide = lambda own, other: F.when(own == other, F.lit(k)).otherwise(F.lit(window))
    cameras = gallery.select(F.col("id").alias("_g"), F.col("camera").alias("_gc"))
    size = gallery.where(F.col("vec").isNotNull()).count()
    found = cut(search(queries.select("id", "vec"), gallery.select("id", "vec"), "id", "vec", max(window, candidates)), "rerank-found")
    if size <= k:
        out = found.where(F.col("rank") <= candidates)
        return out.select("query", "hit", F.col("score").alias("cosine"), F.lit(None).cast("double").alias("jaccard"), "score")
    near = search(gallery.select("id", "vec"), gallery.select("id", "vec"), "id", "vec", window)
    near = near.join(cameras.select(F.col("_g").alias("query"), F.col("_gc").alias("camera")), "query").join(cameras.select(F.col("_g").alias("hit"), F.col("_gc").alias("hit_camera")), "hit")
    near = cut(near.select("query", "hit", "score", "rank", "camera", "hit_camera"), "rerank-near")
    # b is a's neighbour: among a's nearest, and a among b's for a's camera.
    back = near.where(F.col("rank") <= wide(F.col("camera"), F.col("hit_camera"))).select(F.col("query").alias("hit"), F.col("hit").alias("query"))
    mutual = near.select("query", "hit").join(back, ["query", "hit"], "left_semi")
    if size <= window:  # lists that are shorter than the wide neighbourhood leave nobody out
        open_ = near.where(F.lit(size - 1) < wide(F.col("hit_camera"), F.col("camera"))).select("query", "hit")
        mutual = mutual.unionByName(open_).distinct()
    own = mutual.groupBy("query").agg(F.collect_set("hit").alias("_set"))
    sets = gallery.select(F.col("id").alias("hit")).join(own.withColumnRenamed("query", "hit"), "hit", "left")
    sets = cut(sets.select("hit", F.coalesce("_set", F.array().cast(own.schema["_set"].dataType)).alias("_set")), "rerank-sets")
    # What a query has to score to be in a row's neighbourhood, for either size.
    at = lambda n: F.max(F.when(F.col("rank") == n, F.col("score")))
    bars = near.groupBy(F.col("query").alias("hit")).agg(at(k).alias("_narrow"), at(window).alias("_wide"))
    asked = queries.select(F.col("id").alias("query"), F.col("camera").alias("_qc"))
    top = found.join(asked, "query").join(cameras.withColumnRenamed("_g", "hit"), "hit").join(bars, "hit", "left")
    bar: Column = F.when(F.col("_qc") == F.col("_gc"), F.col("_narrow")).otherwise(F.col("_wide"))
    mine = top.where((F.col("rank") <= wide(F.col("_gc"), F.col("_qc"))) & (bar.isNull() | (F.col("score") >= bar)))
    mine = mine.join(sets, "hit").groupBy("query").agg(F.array_union(F.collect_set("hit"), F.array_distinct(F.flatten(F.collect_set("_set")))).alias("_mine"))
    out = found.where(F.col("rank") <= candidates).join(sets, "hit").join(mine, "query", "left")
    theirs, own_ = F.array_union(F.array("hit"), "_set"), F.coalesce("_mine", F.array().cast(own.schema["_set"].dataType))
    jaccard = F.size(F.array_intersect(own_, theirs)) / F.size(F.array_union(own_, theirs))
    return out.select("query", "hit", F.col("score").alias("cosine"), jaccard.alias("jaccard"), (share * F.col("score") + (1 - share) * jaccard).alias("score"))
