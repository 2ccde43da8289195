"""Tracklets into identities under rules: scoring modes, quorum, vetoes, ambiguity, anchors, and two bars by phase.

What two tracklets forbid each other (one camera at one time, cameras that cannot see one place, a floor that cannot be
crossed so fast) is found once, by joins along time. It stands with the score in one table of links: the score of two
groups, whether any of their members forbid each other, and how many of their members' pairs reach the bar. A round takes
the links that pass and joins groups; links of groups that grew are added up and scored anew from both banks, all others
stay as they were. Each round is written to the shared folder.

Where both phases take mutual choices of means alone (``_by_best``), a group's best partner is all that a round asks for:
it is found where blocks of groups meet, and there is no table of links.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.scores import first_reason
from tessera.functions.vectors import cosine, unit
from tessera.operators import blocks
from tessera.operators.cluster import Union, cut
from tessera.operators.edges import CELL, NAMES, ambiguous, met_in_cells, over
from tessera.operators.identity import survivors
from tessera.operators.intervals import overlapping_pairs
from tessera.operators.motion import reachability
from tessera.operators.reconcile import tracklets
from tessera.operators.scoring import split_views, subsample

MODES = "prototype", "max_exemplar", "consensus", "view_medoid"
AT_ONCE = 20_000
CELL_OF_BANKS = 256
LEAST_BLOCK = 1_024


@dataclass(frozen=True)
class Rules:
    """A run's rules; what is not set is off, or as strict as it can be.

    ``cluster_same_camera`` is the second phase's bar for groups that share a camera, never above the first phase's.
    ``quorum`` of the pairs of two groups' members must reach the bar within a camera. ``waiver`` is the score from which
    groups of several cameras need not be each other's best. A group whose two best partners are within ``ambiguity`` and
    forbid each other joins neither. Groups that no anchor has seen get no id if ``require_anchor``. Links below
    ``least_alike`` are not kept; -1 keeps all.
    """

    least_observations: int = 3
    same_camera: float = 0.90
    cross_camera: float = 0.65
    per_camera: tuple[tuple[str, float], ...] = ()
    cluster_same_camera: float | None = None
    mode: str = "prototype"
    share: float = 0.25
    views: int = 2
    cap: int = 64
    mutual_same: bool = False
    rounds_same: bool = False
    quorum: float = 1.0
    mutual_cross: bool = True
    waiver: float = 0.0
    ambiguity: float = 0.0
    anchors: tuple[str, ...] = ()
    require_anchor: bool = False
    least_alike: float = -1.0
    most_rounds: int | None = None

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode is one of {MODES}")
        if not (0.0 < self.quorum <= 1.0 and 0.0 < self.share <= 1.0):
            raise ValueError("quorum and share are shares: above 0, 1 at most")
        if self.least_observations < 1 or self.cap < 1 or self.views < 1:
            raise ValueError("counts are 1 at least")
        if len({c for c, _ in self.per_camera}) < len(self.per_camera):
            raise ValueError("a camera has one bar")

    def bar(self, cameras_a: Column, cameras_b: Column, same: bool) -> Column:
        """The bar of two groups: the strictest of the cameras they share, or that across cameras where they share none."""

        def own(camera: Column) -> Column:
            return F.coalesce(*[F.when(camera == c, float(b)) for c, b in self.per_camera], F.lit(float(self.same_camera)))

        strictest = F.array_max(F.transform(F.array_intersect(cameras_a, cameras_b), own))
        if not same and self.cluster_same_camera is not None:
            strictest = F.when(strictest.isNotNull(), F.least(strictest, F.lit(float(self.cluster_same_camera))))
        return F.coalesce(strictest, F.lit(float(self.cross_camera)))


@dataclass(frozen=True)
class Outcome:
    """What came of a run.

    members: key, camera, component (null if suppressed or without a direction). merges: phase, round, left, right (the
    groups' smallest keys of that time), score, bar. links: key, partner (the other group), score, bar of every merge
    that a key's group took part in.
    """

    members: DataFrame
    merges: DataFrame
    links: DataFrame


# ---------------------------------------------------------------- what tracklets forbid each other


def together(nodes: DataFrame, width: float) -> DataFrame:
    """left, right: tracklets (key, camera, start, end) of one camera at one time, ends included."""
    found = overlapping_pairs(nodes.select("key", "camera", "start", "end"), ["camera"], "start", "end", "key", width)
    return found.select(F.col("key_a").alias("left"), F.col("key_b").alias("right"))


def apart(nodes: DataFrame, listed: DataFrame, width: float) -> DataFrame:
    """left, right: tracklets of two listed cameras (cam_a, cam_b, tolerance) that overlap by more than the tolerance.

    A null tolerance stands for cameras that see one place: those, and cameras that are not listed, forbid nothing. Both
    sides meet by listed pair and time, so that cameras that are not listed are never paired.
    """
    strict = listed.where("tolerance IS NOT NULL AND cam_a <> cam_b").select(F.least("cam_a", "cam_b").alias("_x"), F.greatest("cam_a", "cam_b").alias("_y"), F.col("tolerance").cast("double").alias("tolerance"))
    strict = strict.groupBy("_x", "_y").agg(F.max("tolerance").alias("tolerance"))
    sides = strict.select("*", F.explode(F.array("_x", "_y")).alias("camera"))
    spans = nodes.select("key", "camera", "start", "end").join(sides, "camera")
    met = overlapping_pairs(spans, ["_x", "_y"], "start", "end", "key", width)
    shared = F.least("end_a", "end_b") - F.greatest("start_a", "start_b")
    return met.where((F.col("camera_a") != F.col("camera_b")) & (shared > F.col("tolerance_a"))).select(F.col("key_a").alias("left"), F.col("key_b").alias("right"))


def unreachable(positions: DataFrame, limits: DataFrame, reach: float, width: float, clock: float = 0.5, least: int = 3) -> DataFrame:
    """left, right: tracklets whose closest positions in time ask for more speed than their floor's limit, by the median.

    ``positions`` has key, grp (a floor), ts, x, y, error, and ``limits`` grp and limit. Tracklets of several floors, or
    of one without a limit, forbid nothing. ``reach`` bounds the gap, in seconds, over which a floor could be too wide to
    cross: only tracklets that near in time are compared.
    """
    spans = positions.groupBy("key").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.min("grp").alias("grp"), F.count_distinct("grp").alias("_n"))
    spans = spans.where("_n = 1").join(limits, "grp").select("key", "grp", "limit", F.col("start").alias("start"), (F.col("end") + reach).alias("end"))
    near = overlapping_pairs(spans, ["grp"], "start", "end", "key", width).select(F.col("key_a").alias("left"), F.col("key_b").alias("right"), F.col("limit_a").alias("limit"))
    near = cut(near, "agglomerate-near")
    order = F.row_number().over(Window.partitionBy("key").orderBy("ts", "x", "y"))
    rows = positions.withColumn("row", order).select("key", "row", F.col("ts").cast("double").alias("ts"), "x", "y", "error")
    side = lambda name: near.select("left", "right").join(rows.withColumnRenamed("key", name), name)
    limit = near.select(F.col("left").alias("_l"), F.col("right").alias("_r"), "limit")
    found = reachability(side("left"), side("right"), ["left", "right"], F.lit(0.0), clock, least)
    found = found.join(limit, (F.col("left") == F.col("_l")) & (F.col("right") == F.col("_r")))
    return found.where((F.col("n") >= least) & (F.col("required") > F.col("limit"))).select("left", "right")


def reasons(**pairs: DataFrame) -> DataFrame:
    """left, right and reason of pairs by rule; of several rules the first as given names the reason."""
    every = [df.select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"), F.lit(name).alias("_rule")) for name, df in pairs.items()]
    by = reduce(DataFrame.unionByName, every).groupBy("left", "right").agg(F.collect_set("_rule").alias("_rules"))
    return by.select("left", "right", first_reason(*[(name, F.array_contains("_rules", name)) for name in pairs], otherwise="").alias("reason"))


# ---------------------------------------------------------------- scores of groups


def _rows(observations: DataFrame, members: DataFrame, rules: Rules) -> DataFrame:
    """component and rows: at most ``cap`` unit vectors of a group, evenly spread over its tracklets in their order."""
    rows = observations.join(members, "key").select("component", "key", "ts", unit(F.col("vec").cast("array<double>")).alias("row")).where("row IS NOT NULL")
    rows = subsample(rows, ["component"], ["key", "ts"], rules.cap)
    return rows.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("key", "ts", "row"))), lambda s: s["row"]).alias("rows"))


def _first_banks(nodes: DataFrame, observations: DataFrame, rules: Rules) -> DataFrame:
    """component, cameras, size, total (the sum of its tracklets' unit means) and rows (where the mode reads them), a tracklet each."""
    banks = nodes.select(F.col("key").alias("component"), F.array("camera").alias("cameras"), F.lit(1).cast("long").alias("size"), F.col("vec").alias("total"))
    if rules.mode == "prototype":
        return banks
    return banks.join(_rows(observations, nodes.select("key", F.col("key").alias("component")), rules), "component")


def _added(vectors: Column) -> Column:
    return F.aggregate(F.slice(vectors, F.lit(2), F.greatest(F.size(vectors) - 1, F.lit(0))), F.element_at(vectors, 1), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))


def _next_banks(banks: DataFrame, grown: DataFrame, observations: DataFrame, members: DataFrame, rules: Rules) -> DataFrame:
    """Banks after a round: those of groups that grew are added up, the others stay."""
    parts = banks.join(grown, "component").groupBy(F.col("to").alias("component"))
    new = parts.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("cameras")))).alias("cameras"), F.sum("size").alias("size"), _added(F.collect_list("total")).alias("total"))
    if rules.mode != "prototype":
        some = members.join(grown.select(F.col("to").alias("component")).distinct(), "component", "left_semi")
        new = new.join(_rows(observations, some, rules), "component")
    return banks.join(grown, "component", "left_anti").unionByName(new.select(*banks.columns))


def _views(rows: np.ndarray, rules: Rules) -> np.ndarray:
    if rules.mode != "view_medoid":
        return rows
    means = np.stack([p.mean(axis=0) for p in split_views(rows, rules.views)])
    return means / (np.linalg.norm(means, axis=1, keepdims=True) + 1e-12)


def _score_of(cos: np.ndarray, mean: float, rules: Rules) -> float:
    if rules.mode != "consensus":
        return max(mean, float(cos.max()))
    flat = cos.ravel()
    k = max(1, round(flat.size * rules.share))
    return float(np.partition(flat, flat.size - k)[flat.size - k :].mean())


def _first_links(banks: DataFrame, rules: Rules) -> DataFrame:
    """a, b, score (4 places), a < b: all pairs of tracklets in cells of bounded size."""
    if rules.mode == "prototype":
        found = over(banks, banks, "component", "total", rules.least_alike)
    else:
        flat = banks.select("component", F.concat("total", F.flatten("rows")).alias("vec"), F.size("total").alias("dim"))
        dim = (flat.select("dim").first() or [1])[0]
        dealt, _, base = met_in_cells(flat, flat, ["component", "vec"], CELL_OF_BANKS)
        kind = base.schema[NAMES[0]].dataType.simpleString()

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            read = lambda column: [np.asarray(v, float).reshape(-1, dim) for v in column.to_pylist()]
            one, other = read(left.column(NAMES[1])), read(right.column(NAMES[1]))
            ids, hits = left.column(NAMES[0]).to_pylist(), right.column(NAMES[0]).to_pylist()
            views, out = [_views(v[1:], rules) for v in other], []
            for i, bank in zip(ids, one, strict=True):
                mine = _views(bank[1:], rules)
                for h, theirs, view in zip(hits, other, views, strict=True):
                    if i < h and (score := round(_score_of(mine @ view.T, float(bank[0] @ theirs[0]), rules), 4)) >= rules.least_alike:
                        out.append((i, h, score))
            return pa.table([pa.array([r[c] for r in out], t) for c, t in enumerate((left.schema.field(NAMES[0]).type, left.schema.field(NAMES[0]).type, pa.float64()))], names=["query", "hit", "score"])

        found = dealt.applyInArrow(run, f"query {kind}, hit {kind}, score double")
    return found.where("query < hit").select(F.col("query").alias("a"), F.col("hit").alias("b"), "score")


def _scored(pairs: DataFrame, banks: DataFrame, rules: Rules) -> DataFrame:
    """``pairs`` with their groups' score, both banks at its side."""
    bank = F.struct("total") if rules.mode == "prototype" else F.struct("total", "rows")
    side = lambda end: banks.select(F.col("component").alias(end), bank.alias(f"_{end}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    if rules.mode == "prototype":
        return both.select(*pairs.columns, F.round(cosine(F.col("_a.total"), F.col("_b.total")), 4).alias("score"))

    def score(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        matrix = lambda v: np.array([np.asarray(x, float) for x in v])
        out = []
        for p, q, x, y in zip(a, b, c, d, strict=True):
            p, q = np.asarray(p, float), np.asarray(q, float)
            mean = float(p @ q) / (float(np.linalg.norm(p) * np.linalg.norm(q)) + 1e-12)
            out.append(round(_score_of(_views(matrix(x), rules) @ _views(matrix(y), rules).T, mean, rules), 4))
        return pd.Series(out, dtype=float)

    run = F.pandas_udf(score, "double")
    return both.select(*pairs.columns, run(F.col("_a.total"), F.col("_b.total"), F.col("_a.rows"), F.col("_b.rows")).alias("score"))


def _next_links(links: DataFrame, grown: DataFrame, banks: DataFrame, rules: Rules) -> DataFrame:
    """Links after a round: those of groups that grew are joined and scored anew, the others stay as they are."""
    to = lambda end: grown.select(F.col("component").alias(end), F.col("to").alias(f"_{end}"))
    named = links.join(to("a"), "a", "left").join(to("b"), "b", "left")
    moved = F.col("_a").isNotNull() | F.col("_b").isNotNull()
    x, y = F.coalesce("_a", "a"), F.coalesce("_b", "b")
    changed = named.where(moved & (x != y)).groupBy(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).agg(F.bool_or("forbidden").alias("forbidden"), F.sum("clear").alias("clear"))
    barred = changed.where("forbidden").withColumn("score", F.lit(None).cast("double"))
    return named.where(~moved).select(*links.columns).unionByName(_scored(changed.where("NOT forbidden"), banks, rules).select(*links.columns)).unionByName(barred.select(*links.columns))


# ---------------------------------------------------------------- best partners, without a table of links


def _by_best(rules: Rules) -> bool:
    """Whether a round asks for each group's best partner alone: mutual choice in both phases, by means, of all pairs, and no rule that reads other links."""
    return rules.mode == "prototype" and all(_matched(rules, same) for same in (True, False)) and not rules.rounds_same and rules.ambiguity <= 0 and rules.least_alike <= -1.0


def _camera_bars(rules: Rules, cameras: list[str], same: bool) -> np.ndarray:
    own = [dict(rules.per_camera).get(c, rules.same_camera) for c in cameras]
    return np.array(own if same or rules.cluster_same_camera is None else [min(b, rules.cluster_same_camera) for b in own], float)


def _met_bests(banks: DataFrame, foes: DataFrame, rules: Rules, same: bool, asked: DataFrame | None = None) -> DataFrame:
    """component, partner, score (4 places): of groups that meet, those of ``asked`` (component) with all, either one's best partner that no rule forbids.

    ``foes`` (a, b) are groups that forbid each other. Of equal scores the smaller name counts. A task holds two blocks of
    groups and a slab of their cosines.
    """
    lists = foes.unionByName(foes.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("component")).agg(F.collect_list("b").alias("foes"))
    none = F.array().cast(lists.schema["foes"].dataType)
    rows = banks if asked is None else banks.join(asked.withColumn("_asks", F.lit(1)), "component", "left")
    key = F.lit(1) if asked is None else F.coalesce("_asks", F.lit(0))
    rows = rows.join(lists, "component", "left").select(key.alias("key"), F.col("component").alias("row"), "cameras", F.coalesce("foes", none).alias("foes"), F.col("total").alias("vec"))
    # Enough cells for all cores, of bounded blocks.
    across = max(1, round((8 * banks.sparkSession.sparkContext.defaultParallelism) ** 0.5))
    names = ["row", "cameras", "foes"]
    packed = blocks.packed(blocks.valid(rows, "vec"), "vec", names, "row", min(CELL, max(LEAST_BLOCK, -(-banks.count() // across))))
    kind = banks.schema["component"].dataType.simpleString()
    schema = f"component {kind}, partner {kind}, score double"
    arrow, wide = blocks.arrow_schema(schema), -(1 << 62)

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        (u, mine), (v, theirs) = blocks.opened(left, "f8", names), blocks.opened(right, "f8", names)
        # Either side in the order of its names, so that of equal scores the first place counts.
        p, q = (np.argsort(r, kind="stable") for r in blocks.ranks(mine["row"], theirs["row"]))
        u, mine = u[p], {n: c.take(pa.array(p)) for n, c in mine.items()}
        v, theirs = v[q], {n: c.take(pa.array(q)) for n, c in theirs.items()}
        no = _places([pa.array(np.arange(len(u))), _rows_of(mine["foes"])], [mine["row"], mine["foes"].flatten()], theirs["row"])
        cameras = pa.concat_arrays([mine["cameras"].flatten(), theirs["cameras"].flatten()]).unique()
        seen, other = _held(mine["cameras"], cameras), _held(theirs["cameras"], cameras)
        lone, lone_other = seen.sum(axis=1) == 1, other.sum(axis=1) == 1
        bars = _camera_bars(rules, cameras.to_pylist(), same)
        least = bars.min() if same else min(rules.cross_camera, *bars)
        rowwise, columnwise = np.full(len(u), wide), np.full(len(v), wide)
        for at, cos in blocks.slabs(u, v):
            end = at + len(cos)
            score = np.rint(np.multiply(cos, blocks.SCALE, out=cos), out=cos)
            some = slice(*np.searchsorted(no[0], [at, end]))
            score[no[0][some] - at, no[1][some]] = -np.inf
            # A pair may rest on any shared camera: the strictest bar of those, for each bar that cameras have.
            i, j = np.divmod(np.flatnonzero(score >= np.floor(least * blocks.SCALE)), len(v))
            bar, shares = np.full(len(i), float(rules.cross_camera)), np.zeros(len(i), bool)
            for value in np.unique(bars):
                with_it = (seen[at:end, bars == value] @ other[:, bars == value].T)[i, j] > 0
                bar[with_it], shares = value, shares | with_it
            alone = lone[at + i] & lone_other[j] & shares
            good = (alone if same else ~alone) & (score[i, j] / blocks.SCALE >= bar)
            i, j = i[good], j[good]
            if len(i):
                key = score[i, j].astype(np.int64) * (1 << 32)
                first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
                rowwise[at + i[first]] = np.maximum.reduceat(key - j, first)
                np.maximum.at(columnwise, j, key - (at + i))
        out = []
        for names_of, partners, key in ((mine["row"], theirs["row"], rowwise), (theirs["row"], mine["row"], columnwise)):
            found = np.flatnonzero(key != wide)
            score = -(-key[found] >> 32)
            out.append(pa.Table.from_arrays([names_of.take(pa.array(found)), partners.take(pa.array(score * (1 << 32) - key[found])), pa.array(score / blocks.SCALE)], schema=arrow))
        return pa.concat_tables(out)

    pairs = banks.sparkSession.createDataFrame([(1, 1)] if asked is None else [(1, 0), (1, 1)], "left int, right int")
    return blocks.met(packed, packed, pairs, once=asked is None).applyInArrow(best, schema)


def _rows_of(lists: pa.ListArray) -> pa.Array:
    """The row of each element of the lists."""
    return pa.array(np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False)))


def _places(rows: list[pa.Array], names: list[pa.Array], among: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of names that are ``among`` these, in the order of the rows."""
    row = np.concatenate([r.to_numpy(zero_copy_only=False) for r in rows]).astype(np.int64)
    place = np.concatenate([pc.fill_null(pc.index_in(n, value_set=among), -1).to_numpy(zero_copy_only=False) for n in names])
    order = np.argsort(row, kind="stable")
    order = order[place[order] >= 0]
    return row[order], place[order]


def _held(lists: pa.ListArray, values: pa.Array) -> np.ndarray:
    """A row for each list and a column for each of ``values``: 1 where the list holds it."""
    held = np.zeros((len(lists), len(values)), np.float32)
    held[_rows_of(lists).to_numpy(zero_copy_only=False), pc.index_in(lists.flatten(), value_set=values).to_numpy(zero_copy_only=False)] = 1
    return held


def _bests(banks: DataFrame, foes: DataFrame, rules: Rules, same: bool, had: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """component, partner, score: each group's best partner that no rule forbids.

    ``had`` is the best partners before a round and the groups (component, to) that grew in it. Only groups that grew, and
    those whose best partner did, are asked anew; for any other it is its best so far, or a group that grew.
    """
    if had is None:
        found = _met_bests(banks, foes, rules, same)
    else:
        best, grown = had
        gone = grown.select(F.col("component").alias("partner"))
        stays = best.join(grown, "component", "left_anti")
        asked = grown.select(F.col("to").alias("component")).unionByName(stays.join(gone, "partner", "left_semi").select("component")).distinct()
        found = stays.join(gone, "partner", "left_anti").select("component", "partner", "score").unionByName(_met_bests(banks, foes, rules, same, asked))
    best = found.groupBy("component").agg(F.min(F.struct((-F.col("score")).alias("s"), "partner")).alias("_b"))
    return cut(best.select("component", "_b.partner", (-F.col("_b.s")).alias("score")), "agglomerate-best")


def _mutual(best: DataFrame, banks: DataFrame, rules: Rules, same: bool) -> DataFrame:
    """a, b, score, bar: groups that are each other's best partner."""
    back = best.select(F.col("component").alias("b"), F.col("partner").alias("a"))
    both = best.select(F.col("component").alias("a"), F.col("partner").alias("b"), "score").where("a < b").join(back, ["a", "b"], "left_semi")
    cameras = lambda end: banks.select(F.col("component").alias(end), F.col("cameras").alias(f"_c{end}"))
    return both.join(cameras("a"), "a").join(cameras("b"), "b").select("a", "b", "score", rules.bar(F.col("_ca"), F.col("_cb"), same).alias("bar"))


def _renamed(foes: DataFrame, grown: DataFrame) -> DataFrame:
    """Groups that forbid each other, by their names after a round."""
    to = lambda end: grown.select(F.col("component").alias(end), F.col("to").alias(f"_{end}"))
    x, y = F.coalesce("_a", "a"), F.coalesce("_b", "b")
    return foes.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


# ---------------------------------------------------------------- choice and merging


def _eligible(links: DataFrame, banks: DataFrame, rules: Rules, same: bool) -> DataFrame:
    """a, b, score, bar, first: links that no rule forbids and that reach their bar."""
    side = lambda end: banks.select(F.col("component").alias(end), F.col("cameras").alias(f"_c{end}"), F.col("size").alias(f"_n{end}"))
    out = links.where("NOT forbidden AND score IS NOT NULL").join(side("a"), "a").join(side("b"), "b")
    lone = F.size(F.array_union("_ca", "_cb")) == 1
    out = out.where(lone if same else ~lone).withColumn("bar", rules.bar(F.col("_ca"), F.col("_cb"), same)).where("score >= bar")
    if same:
        pairs = F.col("_na") * F.col("_nb")
        enough = pairs if rules.quorum >= 1.0 else F.greatest(F.lit(1), F.bround(pairs * F.lit(rules.quorum)).cast("long"))
        out = out.where(F.col("clear") >= enough)
    seen = F.arrays_overlap(F.array_union("_ca", "_cb"), F.array(*map(F.lit, rules.anchors))) if rules.anchors else F.lit(False)
    return out.select("a", "b", "score", "bar", seen.alias("first"), "_ca", "_cb")


def _chosen(eligible: DataFrame, forbidden: DataFrame, rules: Rules, same: bool) -> DataFrame:
    """Of eligible links those of mutual best choice, or beyond doubt, without the ones of ambiguous groups."""
    both = eligible.select(F.col("a").alias("left"), F.col("b").alias("right"), "score").unionByName(eligible.select(F.col("b").alias("left"), F.col("a").alias("right"), "score"))
    out = eligible
    if rules.mutual_same if same else rules.mutual_cross:
        order = Window.partitionBy("left").orderBy(F.desc("score"), "right")
        best = both.withColumn("_n", F.row_number().over(order)).where("_n = 1")
        ends = best.groupBy(F.least("left", "right").alias("a"), F.greatest("left", "right").alias("b")).agg(F.count("*").alias("_ends"))
        out = out.join(ends, ["a", "b"], "left")
        beyond = (F.col("score") >= rules.waiver) if rules.waiver > 0 and not same else F.lit(False)
        out = out.where((F.coalesce("_ends", F.lit(0)) == 2) | beyond).drop("_ends")
    if rules.ambiguity > 0 and not same:
        unsure = ambiguous(both, forbidden, rules.ambiguity).select(F.col("left").alias("_g"))
        for end in "ab":
            out = out.join(unsure, F.col(end) == F.col("_g"), "left_anti")
    return out


def _matched(rules: Rules, same: bool) -> bool:
    """Whether the chosen links are a matching: each group's only link, which nothing of the same round can touch."""
    return rules.mutual_same if same else rules.mutual_cross and rules.waiver <= 0


def _order(end: str = "") -> list[Column]:
    return [F.desc("first"), F.desc("score"), F.asc("a"), F.asc("b")]


def folded(chosen: DataFrame, forbidden: DataFrame, rules: Rules, same: bool, at_once: int = AT_ONCE) -> DataFrame:
    """The links (a, b, score, bar, first, _ca, _cb) that merge, taken one after another: anchors' first, then by falling score.

    A link is passed over if groups that merged before it forbid each other by now, or share a camera by now whose bar it
    does not reach. While more than ``at_once`` links are left, rounds settle those that come first at both their ends,
    which no earlier link can touch: they merge or fall, their groups become one, and so on. This takes the same links as
    the fold. The rest, in number at most ``at_once``, is folded in tasks: a camera's within cameras, else in one.
    """
    left = cut(chosen.select("*", F.col("a").alias("x"), F.col("b").alias("y")), "fold")
    barred = forbidden.select(F.col("a").alias("x"), F.col("b").alias("y"))
    taken: DataFrame | None = None
    while left.count() > at_once:
        ends = left.withColumn("_end", F.explode(F.array("x", "y")))
        top = ends.withColumn("_n", F.row_number().over(Window.partitionBy("_end").orderBy(*_order()))).where("_n = 1")
        top = top.groupBy(*[c for c in left.columns if c not in ("_ca", "_cb")]).agg(F.count("*").alias("_n"), F.first("_ca").alias("_ca"), F.first("_cb").alias("_cb")).where("_n = 2").drop("_n")
        top = cut(top.join(barred.withColumn("_no", F.lit(True)), ["x", "y"], "left"), "fold-top")
        good = cut(top.where(F.col("_no").isNull() & (F.col("score") >= rules.bar(F.col("_ca"), F.col("_cb"), same))).drop("_no"), "fold-good")
        taken = good.select(*chosen.columns) if taken is None else taken.unionByName(good.select(*chosen.columns))
        new = good.select(F.greatest("x", "y").alias("_old"), F.least("x", "y").alias("_new"), F.array_union("_ca", "_cb").alias("_cams"))
        kept = left.join(top.select("a", "b"), ["a", "b"], "left_anti")
        for end, cams in (("x", "_ca"), ("y", "_cb")):
            grown = new.select(F.explode(F.array("_old", "_new")).alias(end), "_new", "_cams")
            kept = kept.join(grown, end, "left").withColumn(end, F.coalesce("_new", end)).withColumn(cams, F.coalesce("_cams", cams)).drop("_new", "_cams")
        swapped = [F.when(F.col("x") <= F.col("y"), F.col(p)).otherwise(F.col(q)).alias(p) for p, q in (("x", "y"), ("y", "x"), ("_ca", "_cb"), ("_cb", "_ca"))]
        left = cut(kept.where("x <> y").select("a", "b", "score", "bar", "first", *swapped), "fold")
        for end in "xy":
            barred = barred.join(new.select(F.col("_old").alias(end), "_new"), end, "left").withColumn(end, F.coalesce("_new", end)).drop("_new")
        barred = cut(barred.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "fold-barred")
    rest = _folded_in_tasks(left, barred, rules, same, chosen)
    return rest if taken is None else taken.unionByName(rest)


def _folded_in_tasks(left: DataFrame, barred: DataFrame, rules: Rules, same: bool, chosen: DataFrame) -> DataFrame:
    lane = F.element_at("_ca", 1) if same else F.lit("")
    ends = left.select(F.explode(F.array("x", "y")).alias("_e"), lane.alias("lane")).distinct()
    no = barred.join(ends.withColumnRenamed("_e", "x"), "x").join(ends.select(F.col("_e").alias("y"), F.col("lane").alias("_l")), "y").where("lane = _l")
    blank = lambda c: F.lit(None).cast(left.schema[c].dataType).alias(c)
    rows = left.withColumn("lane", lane).unionByName(no.select("x", "y", "lane", *[blank(c) for c in left.columns if c not in ("x", "y")]))
    bars, most, kept = dict(rules.per_camera), rules.cluster_same_camera, chosen.columns

    def needed(cameras: set[str]) -> float:
        if not cameras:
            return rules.cross_camera
        bar = max(bars.get(c, rules.same_camera) for c in cameras)
        return bar if same or most is None else min(bar, most)

    def fold(df: pd.DataFrame) -> pd.DataFrame:
        links = df[df["a"].notna()].sort_values(["first", "score", "a", "b"], ascending=[False, False, True, True], kind="stable")
        foes: dict = {}
        for x, y in df.loc[df["a"].isna(), ["x", "y"]].itertuples(index=False):
            foes.setdefault(x, set()).add(y)
            foes.setdefault(y, set()).add(x)
        cams: dict = {}
        for r in links.itertuples():
            cams.setdefault(r.x, set(r[links.columns.get_loc("_ca") + 1]))
            cams.setdefault(r.y, set(r[links.columns.get_loc("_cb") + 1]))
        sets, good = Union(), []
        for x, y, score in links[["x", "y", "score"]].itertuples(index=False):
            p, q = sorted((sets.find(x), sets.find(y)))
            fine = p != q and score >= needed(cams[p] & cams[q]) and not any(m in foes.get(n, ()) for n in sets.members[p] for m in sets.members[q])
            good.append(fine)
            if fine:
                sets.join(p, q)
                cams[p] |= cams.pop(q)
        return links[good][kept]

    return rows.groupBy("lane").applyInPandas(fold, chosen.schema)


def _grown(merged: DataFrame, matched: bool) -> DataFrame:
    """component and to: of every group that grows, the smallest name it now has."""
    if matched:
        return merged.select(F.explode(F.array("a", "b")).alias("component"), F.least("a", "b").alias("to"))
    labels = merged.select(F.explode(F.array("a", "b")).alias("component")).distinct().withColumn("to", F.col("component"))
    both = merged.select(F.col("a").alias("p"), F.col("b").alias("q")).unionByName(merged.select(F.col("b").alias("p"), F.col("a").alias("q")))
    while True:
        near = both.join(labels.select(F.col("component").alias("q"), F.col("to").alias("_t")), "q").groupBy(F.col("p").alias("component")).agg(F.min("_t").alias("_m"))
        new = labels.join(near, "component").select("component", F.col("to").alias("_was"), F.least("to", "_m").alias("to"))
        jump = new.select(F.col("component").alias("to"), F.col("to").alias("_j"))
        new = cut(new.join(jump, "to").select("component", "_was", F.least("to", "_j").alias("to")), "agglomerate-labels")
        labels = new.select("component", "to")
        if not new.where("_was <> to").head(1):
            return labels


def agglomerated(observations: DataFrame, rules: Rules = Rules(), forbidden: DataFrame | None = None, width: float = 60.0) -> Outcome:
    """The identities of the tracklets of ``observations`` (key, camera, ts, vec), within cameras first, then across.

    ``forbidden`` (left, right) are pairs of keys that more rules keep apart, as ``apart`` and ``unreachable`` find them;
    tracklets of one camera at one time always are, and no score overrides a pair. ``width`` is the width of the bins in
    which spans meet. Keys with too few observations, or none of a direction, have a null component.
    """
    every = observations.groupBy("key").agg(F.min("camera").alias("camera"))
    nodes = cut(tracklets(observations, rules.least_observations).where("vec IS NOT NULL"), "agglomerate-nodes")
    pairs = together(nodes, width)
    pairs = pairs if forbidden is None else pairs.unionByName(forbidden.select("left", "right"))
    pairs = pairs.select(F.least("left", "right").alias("a"), F.greatest("left", "right").alias("b"), F.lit(True).alias("forbidden")).distinct()
    banks = cut(_first_banks(nodes, observations, rules), "agglomerate-banks")
    by_best = _by_best(rules)
    if by_best:
        foes = cut(pairs.select("a", "b"), "agglomerate-foes")
    else:
        camera = lambda end: nodes.select(F.col("key").alias(end), F.col("camera").alias(f"_{end}"))
        links = _first_links(banks, rules).join(pairs, ["a", "b"], "full").join(camera("a"), "a").join(camera("b"), "b")
        one = F.array("_a")
        clear = ((F.col("_a") == F.col("_b")) & (F.col("score") >= rules.bar(one, one, True))).cast("long")
        links = cut(links.select("a", "b", "score", F.coalesce("forbidden", F.lit(False)).alias("forbidden"), F.coalesce(clear, F.lit(0).cast("long")).alias("clear")), "agglomerate-links")
    members = nodes.select("key", F.col("key").alias("component"))
    merges: list[DataFrame] = []
    links_of: list[DataFrame] = []
    for same in (True, False):
        matched, n, had = _matched(rules, same), 0, None
        while same or rules.most_rounds is None or n < rules.most_rounds:
            if by_best:
                best = _bests(banks, foes, rules, same, had)
                merged = cut(_mutual(best, banks, rules, same), "agglomerate-merged")
            else:
                barred = links.where("forbidden").select("a", "b")
                chosen = _chosen(_eligible(links, banks, rules, same), barred, rules, same)
                merged = cut(chosen if matched else folded(chosen, barred, rules, same), "agglomerate-merged")
            if not merged.head(1):
                break
            n += 1
            merges.append(merged.select(F.lit("same_camera" if same else "cross_camera").alias("phase"), F.lit(n).alias("round"), F.col("a").alias("left"), F.col("b").alias("right"), "score", "bar"))
            sides = [merged.select(F.col(x).alias("component"), F.col(y).alias("partner"), "score", "bar") for x, y in (("a", "b"), ("b", "a"))]
            links_of.append(members.join(sides[0].unionByName(sides[1]), "component").select("key", "partner", "score", "bar"))
            grown = _grown(merged, matched)
            members = members.join(grown, "component", "left").select("key", F.coalesce("to", "component").alias("component"))
            if rules.mode != "prototype" or len(merges) % 4 == 0:
                members = cut(members, "agglomerate-members")
            if not same and n == rules.most_rounds:
                break
            banks = cut(_next_banks(banks, grown, observations, members, rules), "agglomerate-banks")
            if by_best:
                foes, had = cut(_renamed(foes, grown), "agglomerate-foes"), (best, grown)
            else:
                links = cut(_next_links(links, grown, banks, rules), "agglomerate-links")
            if same and not rules.rounds_same:
                break
    merged_by = _all(merges, observations, "phase string, round int, left string, right string, score double, bar double")
    linked_by = _all(links_of, observations, "key string, partner string, score double, bar double")
    return Outcome(every.join(members, "key", "left").select("key", "camera", "component"), merged_by, linked_by)


def _all(parts: list[DataFrame], like: DataFrame, schema: str) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else like.sparkSession.createDataFrame([], schema)


# ---------------------------------------------------------------- what comes out


def identified(outcome: Outcome, had: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """key, camera, component, gid, state: the lowest free id that a group's members had (``had``: key, gid), else a new one.

    ``state`` is resolved, suppressed (no component), or unregistered: a group that no anchor camera has seen takes no
    number where an anchor is required.
    """
    seen = F.bool_or(F.col("camera").isin(list(rules.anchors))) if rules.require_anchor and rules.anchors else F.bool_or(F.lit(True))
    groups = outcome.members.where("component IS NOT NULL").groupBy("component").agg(seen.alias("_seen"))
    ids = had.select(F.col("key"), F.col("gid").cast("long").alias("had"))
    owned = outcome.members.join(groups.where("_seen"), "component").join(ids, "key", "left").select("component", "had")
    top = (ids.agg(F.max("had")).first()[0] or 0) + 1
    given = survivors(cut(owned, "agglomerate-owned"), top).select("component", F.col("gid").cast("long").alias("gid"))
    state = F.when(F.col("component").isNull(), "suppressed").when(F.col("gid").isNull(), "unregistered").otherwise("resolved")
    return outcome.members.join(given, "component", "left").select("key", "camera", "component", "gid", state.alias("state"))


def link_scores(outcome: Outcome) -> DataFrame:
    """key, score, bar, partner: the weakest merge that each key's identity rests on, from its side."""
    return outcome.links.groupBy("key").agg(F.min(F.struct("score", "bar", "partner")).alias("_m")).select("key", "_m.score", "_m.bar", "_m.partner")
