"""Candidate pairs: similarity search, ranks, margins and mutual choice."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.group_ops import PandasCogroupedOps
from pyspark.sql.window import Window

from tessera.functions.vectors import cosine
from tessera.operators import blocks

CELL = 16_384
CELL_OF_PAIRS = 2_048
SLAB = 512
STRIP, STEP = 1_024, 4_096
UNLIKE = -90_000
NAMES = "_row", "_vector", "_group"


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(values), -1) if len(values) else np.zeros((0, 0))
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-12)


def _numbers(left: pa.ChunkedArray, right: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of two columns as integers that are equal for equal values and keep their order."""
    both = pa.chunked_array([*left.chunks, *right.chunks])
    order = pc.rank(both, tiebreaker="dense", null_placement="at_start").to_numpy().astype(np.int64)
    return order[: len(left)], order[len(left) :]


def met_in_cells(queries: DataFrame, base: DataFrame, columns: list[str], size: int) -> tuple[PandasCogroupedOps, DataFrame, DataFrame]:
    """Rows of both sides dealt by a hash into strips and lanes of about ``size``, met in one group for each two of them.

    A group holds one strip and one lane, so what a task holds is bounded, whatever the number of rows; each row is
    shuffled once for each strip or lane of the other side.
    """
    vector = columns[1]
    # The two sides may be one table: columns under names of their own keep them apart.
    ready = lambda df: df.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(*[F.col(c).alias(n) for c, n in zip(columns, NAMES, strict=False)])
    queries, base = ready(queries), ready(base)
    strips, lanes = (max(1, -(-df.count() // size)) for df in (queries, base))
    dealt = lambda n, name: F.pmod(F.xxhash64(NAMES[0]), F.lit(n)).cast("int").alias(name)
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    a = queries.select("*", dealt(strips, "_strip")).select("*", every(lanes, "_lane"))
    b = base.select("*", dealt(lanes, "_lane")).select("*", every(strips, "_strip"))
    return a.groupBy("_strip", "_lane").cogroup(b.groupBy("_strip", "_lane")), queries, base


def _pair_schema(queries: DataFrame, base: DataFrame) -> str:
    return f"query {queries.schema[NAMES[0]].dataType.simpleString()}, hit {base.schema[NAMES[0]].dataType.simpleString()}, score double"


def _compared(left: pa.Table, right: pa.Table, side: bool, alike: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(first query, scores) of slabs of SLAB queries: cosines in 1e-4, UNLIKE where a pair is not to be compared."""
    row, vector, group = NAMES
    a, b = _matrix(left.column(vector)), _matrix(right.column(vector))
    name_a, name_b = _numbers(left.column(row), right.column(row))
    side_a, side_b = _numbers(left.column(group), right.column(group)) if side else (None, None)
    for at in range(0, len(a), SLAB):
        s = np.round(np.clip(a[at : at + SLAB] @ b.T, -1, 1) * 10_000).astype(np.int64)
        s[name_a[at : at + SLAB, None] == name_b[None, :]] = UNLIKE
        if side_a is not None:
            s[(side_a[at : at + SLAB, None] == side_b[None, :]) != alike] = UNLIKE
        yield at, s


def _best_in_cell(a: np.ndarray, b: np.ndarray, row_a: np.ndarray, row_b: np.ndarray, side_a: np.ndarray | None, side_b: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, hit, score in 1e-4) of each query's ``k`` best of ``b``, whose rows are in order: of equal scores the first counts.

    Columns come in slabs, and after the first only those count whose cosine beats the query's k-th so far.
    """
    wide = -(1 << 62)
    out = []
    for at in range(0, len(a), STRIP):
        u, mine, side = a[at : at + STRIP], row_a[at : at + STRIP], None if side_a is None else side_a[at : at + STRIP]
        held = np.full((len(u), k), wide)  # score * 2^32 - place, falling
        for to in range(0, len(b), STEP):
            cos = u @ b[to : to + STEP].T
            if to == 0:
                first = np.full(cos.shape, wide)
                known = ~np.isnan(cos)
                first[known] = np.rint(np.clip(cos[known], -1, 1) * 10_000).astype(np.int64) * (1 << 32)
                first -= np.where(known, np.arange(cos.shape[1])[None, :], 0)
                first[mine[:, None] == row_b[None, :STEP]] = wide
                if side is not None:
                    first[side[:, None] == side_b[None, :STEP]] = wide
                some = min(k, first.shape[1])
                held[:, :some] = -np.sort(-np.partition(first, first.shape[1] - some, axis=1)[:, first.shape[1] - some :], axis=1) if some else held[:, :0]
                continue
            bar = np.where(held[:, -1] == wide, -np.inf, (-(-held[:, -1] >> 32) + 0.5) / 10_000 - 1e-9)
            i, j = np.divmod(np.flatnonzero(cos >= bar[:, None]), cos.shape[1])
            good = mine[i] != row_b[to + j]
            if side is not None:
                good &= side[i] != side_b[to + j]
            i, j = i[good], j[good]
            value = np.rint(np.clip(cos[i, j], -1, 1) * 10_000)
            known = ~np.isnan(value)
            i, key = i[known], value[known].astype(np.int64) * (1 << 32) - (to + j[known])
            if not len(i):
                continue
            touched = np.unique(i)
            rows = np.concatenate([np.repeat(touched, k), i])
            keys = np.concatenate([held[touched].ravel(), key])
            order = np.lexsort((~keys, rows))
            rows, keys = rows[order], keys[order]
            first = np.searchsorted(rows, touched)
            held[touched] = keys[first[:, None] + np.arange(k)]
        i, j = np.nonzero(held != wide)
        key = held[i, j]
        score = -(-key >> 32)
        out.append((i + at, score * (1 << 32) - key, score))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def search(queries: DataFrame, base: DataFrame, row: str, vector: str, k: int, apart: str | None = None, least: float = -1.0, size: int = CELL) -> DataFrame:
    """The ``k`` rows of ``base`` most alike each query (cosine rounded to 4 places): query, hit, score, rank.

    Both sides are packed into blocks of about ``size`` rows, which meet two by two; each gives its best ``k`` a query and
    only those are shuffled. A task holds two blocks and one slab of scores (32 MB). A row is not its own hit, nor one
    with the same ``apart`` value.
    """
    names = ["row"] + (["side"] if apart else [])
    ready = lambda df: df.select(F.lit(0).alias("key"), F.col(vector).alias("vec"), F.col(row).alias("row"), *([F.col(apart).alias("side")] if apart else []))
    one, two = ready(queries), ready(base)
    x = blocks.packed(one, "vec", names, "row", size)
    y = x if queries is base else blocks.packed(two, "vec", names, "row", size)
    number, other, bar = blocks.kind_of(one, "vec"), blocks.kind_of(two, "vec"), round(least * 10_000)
    schema = f"query {one.schema['row'].dataType.simpleString()}, hit {two.schema['row'].dataType.simpleString()}, score double"
    arrow = blocks.arrow_schema(schema)

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        (u, mine), (v, theirs) = blocks.opened(left, number, names), blocks.opened(right, other, names)
        rows, sides = blocks.ranks(mine["row"], theirs["row"]), blocks.ranks(mine["side"], theirs["side"]) if apart else None
        order = np.argsort(rows[1], kind="stable")  # scores tie after rounding: the smaller id is first
        q, h, scores = _best_in_cell(u, v[order], rows[0], rows[1][order], sides and sides[0], sides and sides[1][order], k)
        good = scores >= bar
        return pa.Table.from_arrays([mine["row"].take(pa.array(q[good])), theirs["row"].take(pa.array(order[h[good]])), pa.array(scores[good] / 10_000)], schema=arrow)

    pairs = x.select(F.col("key").alias("left"), F.col("key").alias("right")).distinct()
    found = blocks.met(x, y, pairs).applyInArrow(best, schema)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "hit"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def over(queries: DataFrame, base: DataFrame, row: str, vector: str, least: float, side: str | None = None, alike: bool = False, size: int = CELL_OF_PAIRS) -> DataFrame:
    """Every pair of a query and another row of ``base`` whose cosine (4 places) is ``least`` or more: query, hit, score.

    With ``side``, only pairs whose values of it differ (``alike``: are equal), which tasks see to before they give pairs.
    A cell gives ``size`` squared pairs at most.
    """
    cells, queries, base = met_in_cells(queries, base, [row, vector] + ([side] if side else []), size)
    bar = max(UNLIKE + 1, int(np.ceil(least * 10_000 - 1e-6)))

    def found(left: pa.Table, right: pa.Table) -> pa.Table:
        q, h, scores = [], [], []
        if left.num_rows and right.num_rows:
            for at, s in _compared(left, right, bool(side), alike):
                i, j = np.nonzero(s >= bar)
                q.append(i + at)
                h.append(j)
                scores.append(s[i, j] / 10_000)
        q, h, scores = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (q, h, scores))
        return pa.table({"query": left.column(NAMES[0]).take(pa.array(q)), "hit": right.column(NAMES[0]).take(pa.array(h)), "score": pa.array(scores, pa.float64())})

    return cells.applyInArrow(found, _pair_schema(queries, base))


def ranked(pairs: DataFrame, side: str, score: str, tie: str, out: str) -> DataFrame:
    return pairs.withColumn(out, F.row_number().over(Window.partitionBy(side).orderBy(F.desc(score), tie)))


def mutual_best(pairs: DataFrame, left: str = "left", right: str = "right", score: str = "score") -> DataFrame:
    """Pairs of which each side is the other's best; ties go to the smaller key."""
    both = ranked(ranked(pairs, left, score, right, "_l"), right, score, left, "_r")
    return both.where("_l = 1 AND _r = 1").drop("_l", "_r")


def margins(pairs: DataFrame, left: str = "left", right: str = "right", score: str = "score", missing: float = 0.0) -> DataFrame:
    """Adds margin_left and margin_right: a pair's score less the best other of that side, which is ``missing`` if there is none."""
    out = pairs
    for side, tie, name in ((left, right, "margin_left"), (right, left, "margin_right")):
        w = Window.partitionBy(side)
        order = w.orderBy(F.desc(score), tie)
        first, second = F.max(score).over(w), F.nth_value(score, 2).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        out = out.withColumn("_first", F.row_number().over(order) == 1).withColumn(name, F.col(score) - F.when(F.col("_first"), F.coalesce(second, F.lit(missing))).otherwise(first)).drop("_first")
    return out


def top_two(candidates: DataFrame, query: str, candidate: str, score: str, excluded: str) -> DataFrame:
    """By query: the best eligible candidate, the runner-up among the eligible and among all, and both margins (6 places)."""
    scored = candidates.withColumn("_s", F.round(score, 6))
    order = Window.partitionBy(query).orderBy(F.desc("_s"), candidate)
    eligible = scored.where(F.col(excluded).isNull()).withColumn("_n", F.row_number().over(order)).where("_n <= 2")
    two = eligible.groupBy(query).agg(F.max(F.when(F.col("_n") == 1, F.col(candidate))).alias("best"), F.max("_s").alias("best_score"), F.min(F.when(F.col("_n") == 2, F.col("_s"))).alias("second_eligible"))
    others = scored.join(two.select(F.col(query).alias("_q"), F.col("best").alias("_b")), F.col(query) == F.col("_q")).where(F.col(candidate) != F.col("_b"))
    out = two.join(others.groupBy(query).agg(F.max("_s").alias("second_any")), query, "left")
    return out.withColumn("margin_eligible", F.round(F.col("best_score") - F.col("second_eligible"), 6)).withColumn("margin_any", F.round(F.col("best_score") - F.col("second_any"), 6))


def ambiguous(pairs: DataFrame, conflicts: DataFrame, margin: float, left: str = "left", right: str = "right", score: str = "score") -> DataFrame:
    """Left keys whose two best candidates are within ``margin`` and, by ``conflicts`` (a, b), cannot be the same."""
    top = ranked(pairs, left, score, right, "_n").where("_n <= 2")
    two = top.groupBy(left).agg(F.max(F.when(F.col("_n") == 1, F.col(right))).alias("_1"), F.max(F.when(F.col("_n") == 2, F.col(right))).alias("_2"), (F.max(score) - F.min(score)).alias("_d"), F.count("*").alias("_c"))
    close = two.where((F.col("_c") == 2) & (F.col("_d") < margin))
    keyed = conflicts.withColumn("_x", F.least("a", "b")).withColumn("_y", F.greatest("a", "b"))
    close = close.withColumn("_lx", F.least("_1", "_2")).withColumn("_ly", F.greatest("_1", "_2"))
    return close.join(keyed, (F.col("_lx") == F.col("_x")) & (F.col("_ly") == F.col("_y")), "left_semi").select(left)


def quorum(pairs: DataFrame, keys: list[str], score: str, bar: float, share: float) -> DataFrame:
    """By group of member pairs: how many reach ``bar``, and whether that is ``share`` of them (half to even, one at least)."""
    counts = pairs.groupBy(*keys).agg(F.count("*").alias("n_pairs"), F.count_if(F.col(score) >= bar).alias("n_above"))
    return counts.withColumn("agreed", F.col("n_above") >= F.greatest(F.lit(1), F.bround(F.col("n_pairs") * F.lit(share)).cast("long")))


def quorum_of_counts(counts: DataFrame, keys: list[str], score: str, bar: float, share: float) -> DataFrame:
    """As ``quorum``, from the number ``n`` of pairs of each score."""
    by = counts.groupBy(*keys).agg(F.sum("n").alias("n_pairs"), F.coalesce(F.sum(F.when(F.col(score) >= bar, F.col("n"))), F.lit(0)).alias("n_above"))
    return by.withColumn("agreed", F.col("n_above") >= F.greatest(F.lit(1), F.bround(F.col("n_pairs") * F.lit(share)).cast("long")))


def covisible(pairs: DataFrame, listed: DataFrame, camera_a: str, camera_b: str, overlap: Column) -> DataFrame:
    """Adds ``vetoed``: the pair overlaps by more than the tolerance listed for its cameras.

    ``listed`` has cam_a, cam_b (either order) and tolerance, null for cameras that see the same place: those never
    veto, nor do cameras that are not listed.
    """
    known = listed.select(F.least("cam_a", "cam_b").alias("_x"), F.greatest("cam_a", "cam_b").alias("_y"), F.col("tolerance").alias("_t"))
    on = (F.least(camera_a, camera_b) == F.col("_x")) & (F.greatest(camera_a, camera_b) == F.col("_y"))
    return pairs.join(known, on, "left").withColumn("vetoed", F.coalesce(overlap > F.col("_t"), F.lit(False))).drop("_x", "_y", "_t")


def hashed_search(queries: DataFrame, base: DataFrame, row: str, vector: str, k: int, apart: str | None = None, tables: int = 24, bits: int = 8, seed: int = 7) -> DataFrame:
    """As ``search``, but only rows that share one of ``tables`` hashes with the query are compared: for large query sets.

    A hash is the signs of ``bits`` random projections; more tables find more, more bits compare fewer. Scores are exact.
    """
    planes: dict[int, np.ndarray] = {}

    def keys(dim: int) -> np.ndarray:
        if dim not in planes:
            planes[dim] = np.random.default_rng([seed, dim]).normal(size=(dim, tables * bits))
        return planes[dim]

    def hashed(df: DataFrame) -> DataFrame:
        columns = [row, vector] + ([apart] if apart else [])
        some = df.select(*columns).where(F.col(vector).isNotNull() & (F.size(vector) > 0))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            powers = 1 << np.arange(bits, dtype=np.int64)
            for b in batches:
                m = _matrix(b.column(vector))
                if not len(m):
                    continue
                codes = ((m @ keys(m.shape[1])).reshape(len(m), tables, bits) > 0) @ powers + np.arange(tables, dtype=np.int64) * (1 << bits)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * tables, pa.array(codes.ravel()))], names=[*b.schema.names, "_codes"])

        return some.mapInArrow(run, T.StructType([*some.schema.fields, T.StructField("_codes", T.ArrayType(T.LongType()))]))

    group = [F.col(apart).alias("_ga")] if apart else []
    q = hashed(queries)
    asks = q.select(F.col(row).alias("query"), *group, F.explode("_codes").alias("_code"))
    hits = hashed(base).select(F.col(row).alias("hit"), *([F.col(apart).alias("_gb")] if apart else []), F.explode("_codes").alias("_code"))
    pairs = asks.join(hits, "_code").where("query <> hit")
    pairs = pairs.where("NOT (_ga <=> _gb)") if apart else pairs
    pairs = pairs.select("query", "hit").distinct()
    a, b = queries.select(F.col(row).alias("query"), F.col(vector).alias("_a")), base.select(F.col(row).alias("hit"), F.col(vector).alias("_b"))
    scored = pairs.join(a, "query").join(b, "hit").select("query", "hit", F.round(cosine(F.col("_a"), F.col("_b")), 4).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "hit"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)
