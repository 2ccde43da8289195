"""Centroid clustering of vectors in exact integers.

Distances come from the expansion |x|^2 - 2 x.c + |c|^2: one float64 matrix product a block of rows. Float64 holds every
integer below 2^53, so the product is exact, in whatever order BLAS sums, as long as no partial sum can pass that bound;
a block's rows are held against it by their largest component. Rows beyond it are measured in 64-bit integers, and rows
beyond those in Python's integers, which have no bound. Each partition hands out one row, its sums by cluster, and a
treeAggregate over these rows adds them up, so that neither a task nor the driver gets more than a few hundred of them.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import schema_of

DIM = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256
SALT = "2:"
BLOCK = 4096
SLAB = 128
EXACT_FLOAT = 1 << 53
EXACT_LONG = 1 << 62
LONG = (1 << 63) - 1
DEPTH = 2

Sums = tuple[list[int], list[list[int]], list[int]]  # of each cluster: rows, components, distances


@dataclass(frozen=True)
class Model:
    """Centroids as integers, and the sums of squared distances of the vectors that are nearest to each."""

    centroids: list[list[int]]
    inertias: list[int]

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids]


def _whole(x: float) -> int:
    """floor(SCALE * x) of any finite double."""
    return math.floor(x * SCALE) if abs(x) < 1e300 else int(x) * SCALE


def quantised(column: pa.Array, dim: int = DIM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows kept, their components as float64, whether these are the exact integers) of an array column.

    Kept are rows of exactly ``dim`` components, all of them numbers and finite. Components beyond 2^53 are flagged by row.
    """
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    rows = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    flat = column.filter(fits).flatten().cast(pa.float64())
    x = flat.to_numpy(zero_copy_only=False).reshape(len(rows), dim)  # a null component is NaN
    finite = np.isfinite(x).all(axis=1)
    rows, x = rows[finite], x[finite]
    with np.errstate(over="ignore"):
        q = np.floor(x * SCALE)
    exact = np.abs(q).max(axis=1, initial=0) < EXACT_FLOAT
    if not exact.all():
        q[~exact] = x[~exact]
    return rows, q, exact


def nearest(q: np.ndarray, exact: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, list[int] | np.ndarray]:
    """(cluster, squared distance) of each row of ``q``; of centroids at equal distance the smaller number is taken."""
    largest = max((abs(v) for c in centroids for v in c), default=0)
    dim = q.shape[1]
    reach = np.where(exact, np.abs(q).max(axis=1, initial=0), np.inf) + float(largest)
    # dim * (|x| + |c|)^2 bounds each of the three terms, all their partial sums and the distance.
    fast = dim * reach * reach < EXACT_FLOAT * (1 - 1e-9)
    cluster, distance = np.zeros(len(q), np.int32), np.zeros(len(q), object if not fast.all() else np.int64)
    if fast.any():
        c = np.array(centroids, np.float64)
        x = q if fast.all() else q[fast]
        d = x @ c.T
        d *= -2.0
        d += (x * x).sum(axis=1)[:, None]
        d += (c * c).sum(axis=1)[None, :]
        best = d.argmin(axis=1)
        cluster[fast], distance[fast] = best, d[np.arange(len(x)), best].astype(np.int64)
    # Integers instead: 64 bits where they do, Python's own beyond.
    long = ~fast & (dim * reach * reach < EXACT_LONG * (1 - 1e-9))
    for some, kind in ((np.flatnonzero(long), np.int64), (np.flatnonzero(~fast & ~long), object)):
        for at in range(0, len(some), SLAB):
            rows = some[at : at + SLAB]
            x = np.array([[int(v) if exact[i] else _whole(v) for v in q[i]] for i in rows], kind)
            away = ((x[:, None, :] - np.array(centroids, kind)[None]) ** 2).sum(axis=2)
            cluster[rows] = away.argmin(axis=1)
            distance[rows] = away[np.arange(len(rows)), cluster[rows]]
    return cluster, distance


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            rows, q, exact = quantised(part.column("embedding"), dim)
            if len(rows):
                yield part, rows, q, exact


def _sums(centroids: list[list[int]], dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A partition's sums by cluster, pickled: one row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        count, total, inertia = np.zeros(k, object), np.zeros((k, dim), object), np.zeros(k, object)
        for _, _, q, exact in _blocks(batches, dim):
            cluster, distance = nearest(q, exact, centroids)
            small = exact & (np.abs(q).max(axis=1, initial=0) < EXACT_FLOAT // BLOCK)  # a block of these adds up below 2^53
            order = np.argsort(cluster, kind="stable")
            for j, rows in zip(*_runs(cluster[order], order), strict=True):
                here = rows[small[rows]]
                count[j] += len(rows)
                inertia[j] += sum(map(int, distance[rows]))
                total[j] += np.array([int(v) for v in q[here].sum(axis=0)], object)
                for i in rows[~small[rows]]:
                    total[j] += np.array([int(v) if exact[i] else _whole(v) for v in q[i]], object)
        yield pa.RecordBatch.from_pydict({"sums": pa.array([pickle.dumps((count.tolist(), total.tolist(), inertia.tolist()))], pa.binary())})

    return task


def _runs(values: np.ndarray, rows: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    cuts = np.flatnonzero(np.diff(values)) + 1
    return [int(v) for v in values[np.r_[0, cuts]]], np.split(rows, cuts)


def _plus(a: Sums | None, b: Sums | None) -> Sums | None:
    if a is None or b is None:
        return a or b
    count, total, inertia = (np.array(x, object) + np.array(y, object) for x, y in zip(a, b, strict=True))
    return count.tolist(), total.tolist(), inertia.tolist()


def _totals(vectors: DataFrame, centroids: list[list[int]], dim: int) -> Sums:
    parts = vectors.select("embedding").mapInArrow(_sums(centroids, dim), "sums binary").rdd
    k = len(centroids)
    return parts.treeAggregate(None, lambda acc, row: _plus(acc, pickle.loads(bytes(row["sums"]))), _plus, DEPTH) or ([0] * k, [[0] * dim for _ in range(k)], [0] * k)


def _first(vectors: DataFrame, k: int, dim: int, salt: str) -> list[list[int]]:
    """The kept vectors of the ``k`` smallest hashes of their ids; ids that are null stand last, equal ids in the order of their components."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    kept = vectors.where((F.size("embedding") == dim) & F.forall("embedding", number))
    by = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).alias("by")
    x = F.transform("embedding", lambda v: v.cast("double")).alias("x")
    return [[_whole(v) for v in r["x"]] for r in kept.select(by, x).orderBy(F.asc_nulls_last("by"), "x").limit(k).collect()]


def fit(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, salt: str = SALT) -> Model:
    """Centroids after ``rounds`` rounds over all kept vectors of ``vectors`` (vec_id, embedding); see ``assigned`` for odd rows."""
    centroids = _first(vectors, k, dim, salt)
    for _ in range(rounds if centroids else 0):
        count, total, _ = _totals(vectors, centroids, dim)
        centroids = [[v // n for v in t] if n else c for n, t, c in zip(count, total, centroids, strict=True)]
    return Model(centroids, _totals(vectors, centroids, dim)[2] if centroids else [])


def assigned(vectors: DataFrame, model: Model, dim: int = DIM) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector.

    Kept are vectors of ``dim`` components of which none is null, NaN or infinite; a null vector, an empty or a longer one
    has no row. Null and repeated ids, and equal vectors, are rows of their own. With fewer vectors than clusters there
    are as many centroids as vectors; an empty table gives an empty one. Distances and inertias that 64 bits do not hold
    are null (their order is exact all the same). Other columns are not read.
    """
    digests, inertias = model.digests(), [v if v <= LONG else None for v in model.inertias]
    overall = sum(model.inertias) if sum(model.inertias) <= LONG else None
    centroids = model.centroids
    numbers = [("cluster", T.IntegerType()), ("distance", T.LongType()), ("cluster_inertia", T.LongType()), ("inertia", T.LongType()), ("centroid_sha256", T.StringType())]
    out = schema_of(("vec_id", vectors.schema["vec_id"].dataType), *numbers)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows, q, exact in _blocks(batches, dim) if centroids else ():
            cluster, distance = nearest(q, exact, centroids)
            of = cluster.tolist()
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": part.column("vec_id").take(pa.array(rows)),
                    "cluster": pa.array(cluster, pa.int32()),
                    "distance": pa.array([int(v) if v <= LONG else None for v in distance], pa.int64()),
                    "cluster_inertia": pa.array([inertias[j] for j in of], pa.int64()),
                    "inertia": pa.array([overall] * len(of), pa.int64()),
                    "centroid_sha256": pa.array([digests[j] for j in of], pa.string()),
                }
            )

    return vectors.select("vec_id", "embedding").mapInArrow(task, out)


def clustered(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, salt: str = SALT) -> DataFrame:
    """``vectors`` fitted and assigned; see ``assigned``."""
    return assigned(vectors, fit(vectors, k, rounds, dim, salt), dim)


def _sql() -> str:
    steps = [
        f"""
kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v, embedding
  FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h NULLS LAST, embedding) - 1 AS c, v AS m
  FROM (SELECT sha256('{SALT}' || CAST(vec_id AS VARCHAR)) AS h, embedding, v FROM kept) ORDER BY h NULLS LAST, embedding LIMIT {CLUSTERS})"""
    ]
    far = "list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    for n in range(ROUNDS + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, min(struct_pack(d := {far}, c := c)) AS best FROM kept CROSS JOIN c{n} GROUP BY r)")
        if n < ROUNDS:
            steps.append(
                f"""
s{n} AS (SELECT best.c AS c, i, CAST(floor_div AS BIGINT) AS x FROM (
  SELECT best, i, CASE WHEN sum(v[i]) % count(*) < 0 THEN sum(v[i]) // count(*) - 1 ELSE sum(v[i]) // count(*) END AS floor_div
  FROM (SELECT struct_pack(c := best.c) AS best, v, unnest(range(1, {DIM + 1})) AS i FROM a{n} JOIN kept USING (r)) GROUP BY best, i)),
c{n + 1} AS MATERIALIZED (SELECT o.c, coalesce(l.m, o.m) AS m FROM c{n} o LEFT JOIN (SELECT c, list(x ORDER BY i) AS m FROM s{n} GROUP BY c) l USING (c))"""
            )
    last = f"a{ROUNDS}"
    return f"""
WITH {",".join(steps)},
named AS (SELECT c, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM c{ROUNDS})
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(best.d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM {last} JOIN kept USING (r) JOIN named ON named.c = best.c
"""


ORACLE = _sql()
