"""Mixing sources to target weights by entropy balancing. DataFrame functions only.

A document of x = size / (its source's mean size by words) takes the rate w = min(MOST_COPIES, exp(lam x)): of all rates
that give a source its words, these are nearest to one copy of each document by relative entropy. ``lam``, the dual of a
source's token constraint, is found by Newton steps; each sums gradient and Hessian over all documents (those of a source
and size at once). Rates are then rounded into copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import WORD, exact_rank, unit_hash, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
NEWTON_STEPS = 200
EXACT = 1e-11
RANGES = 32
BINS = 1 << 16
WHOLE = 1e-9


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place_hash() -> Column:
    """A double in [0, 1) that a document's id and text decide."""
    return unit_hash(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce(F.col("text"), F.lit("")))))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, mean, target), a row per source; ``sized`` has source and size.

    Sources in code-point order, null last, take ``weights`` in turn and share ``share`` of all words; no target exceeds
    ``most`` times its source, and the excess goes to the others by weight until none is above. Sources are numbered in
    ranges, so that no task holds them all; the level of the shares needs sums only.
    """
    size = F.col("size").cast("double")
    by = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.coalesce(F.sum(size * size) / F.nullif(F.sum(size), F.lit(0.0)), F.lit(1.0)).alias("mean"))
    by = written(by.repartitionByRange(RANGES, F.col("source").isNull(), "source").withColumn("_part", F.spark_partition_id()), "mix-sources")
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per range
    parts = by.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", before.alias("_before"))
    n = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())) + F.col("_before") - 1
    by = by.join(parts, "_part").withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (n % len(weights) + 1).cast("int")))
    by = written(by.drop("_part", "_before").withColumn("ceiling", F.col("source_size") * F.lit(float(most))), "mix-weights")

    total = by.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    budget, level, n_capped = share * (total["words"] or 0), 0.0, -1
    spent, free = 0.0, total["weight"] or 0
    while free:
        level = (budget - spent) / free
        capped = F.col("ceiling") <= F.col("weight") * F.lit(level)
        now = by.agg(F.count_if(capped).alias("n"), F.sum(F.when(capped, F.col("ceiling")).otherwise(0.0)).alias("spent"), F.sum(F.when(capped, 0).otherwise(F.col("weight"))).alias("free")).first()
        if now["n"] == n_capped:
            break
        n_capped, spent, free = now["n"], now["spent"], now["free"]
    target = F.least("ceiling", F.col("weight") * F.lit(level)) if free else F.col("ceiling")
    return by.select("source", "source_size", "mean", target.alias("target"))


def _tilted(lam: Column, size: Column, mean: Column) -> Column:
    return F.exp(F.least(lam * size / mean, F.lit(50.0)))


def duals(by: DataFrame, sizes: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """``by`` with lam, such that rates of min(``most``, exp(lam size / mean)) give each source its target; null where all rates are ``most`` or 0.

    ``sizes`` has source, size and n (documents of that size). A step is Newton's on the logarithm of the words taken,
    with halving where it leaves the known bounds; sources are solved side by side until each is met to EXACT.
    """
    open_ = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * F.lit(most * (1 - 1e-12)))
    columns = ["source", "target", "mean", "lam", "low", "high"]
    state = by.where(open_).select("source", "target", "mean", F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    sizes = sizes.where("size > 0").withColumnRenamed("source", "s")
    for _ in range(NEWTON_STEPS):
        joined = sizes.join(state, F.col("source").eqNullSafe(F.col("s")))
        x, e = F.col("size") / F.col("mean"), _tilted(F.col("lam"), F.col("size"), F.col("mean"))
        words = F.col("n") * F.col("size")
        sums = joined.groupBy(*columns).agg(F.sum(words * F.least(F.lit(float(most)), e)).alias("taken"), F.sum(F.when(e < most, words * x * e).otherwise(0.0)).alias("slope"))
        below, met = F.col("taken") < F.col("target"), F.abs(F.col("taken") - F.col("target")) <= F.col("target") * F.lit(EXACT)
        sums = sums.withColumn("low", F.when(below, F.col("lam")).otherwise(F.col("low"))).withColumn("high", F.when(below, F.col("high")).otherwise(F.col("lam")))
        step = F.col("lam") - (F.log("taken") - F.log("target")) * F.col("taken") / F.nullif(F.col("slope"), F.lit(0.0))
        wide = F.when(below, F.greatest(2 * F.col("lam"), F.lit(0.0)) + 1).otherwise(F.least(2 * F.col("lam"), F.lit(0.0)) - 1)
        inside = step.isNotNull() & ~F.isnan(step) & (F.col("low").isNull() | (step > F.col("low"))) & (F.col("high").isNull() | (step < F.col("high")))
        new = F.when(met, F.col("lam")).when(inside, step).otherwise(F.coalesce((F.col("low") + F.col("high")) / 2, wide))
        seen = Observation()
        # The sums at the new value are taken in the next step: a source is done when its value has met its target.
        out = sums.select("source", "target", "mean", new.alias("lam"), "low", "high", met.alias("met")).observe(seen, F.count_if(~F.col("met")).alias("open"))
        state = written(out, "mix-duals").select(*columns)
        if not seen.get["open"]:
            break
    else:
        raise RuntimeError(f"the duals of some sources did not settle in {NEWTON_STEPS} steps")
    return by.join(state.select(F.col("source").alias("s"), "lam"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def rate(most: int = MOST_COPIES) -> Column:
    """A row's rate, from size and its source's mean, lam and target."""
    full = F.when(F.col("target") > 0, F.lit(float(most))).otherwise(0.0)
    return F.when(F.col("lam").isNull(), full).otherwise(F.least(F.lit(float(most)), _tilted(F.col("lam"), F.col("size"), F.col("mean"))))


def _parted(rows: DataFrame, by: DataFrame) -> DataFrame:
    """``rows`` (source, size, u, ...) with its source's figures, base (whole copies), rest (of the rate) and o (the order in which one more is taken)."""
    out = rows.join(by.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    out = out.withColumn("_rate", rate()).withColumn("base", F.floor(F.col("_rate") + F.lit(WHOLE)).cast("int"))
    out = out.withColumn("rest", F.when((F.col("_rate") - F.col("base") > WHOLE) & (F.col("size") > 0), F.col("_rate") - F.col("base")))
    # u over rest, by its logarithm from 2^-24 to 2^24 as a share: near 1 / rest draws the rest as a chance.
    o = F.least(F.greatest((F.log2(F.greatest(F.col("u"), F.lit(1e-18)) / F.col("rest")) + 24) / 48, F.lit(0.0)), F.lit(1.0))
    return out.withColumn("o", o).drop("_rate")


def plan(sized: DataFrame) -> DataFrame:
    """(source, source_size, mean, target, lam, cut, tied, tied_taken), a row per source; ``sized`` has source, size and u.

    Rates are rounded down; documents then stand in the order of u over the rest of their rate, and one more copy of each
    is taken as long as more than half of it fits into the words that are left. ``cut`` is the last place (o, u) taken;
    ``tied`` rows stand there (more than one only if equal rows repeat), and ``tied_taken`` of them are taken.
    """
    sizes = written(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-counts")
    by = written(duals(targets(sized), sizes), "mix-targets")
    whole = _parted(sizes.withColumn("u", F.lit(0.5)), by).groupBy("source", "target").agg(F.sum(F.col("n") * F.col("size") * F.col("base")).alias("held"))
    needs = written(whole.select(F.col("source").alias("s"), (F.col("target") - F.col("held")).alias("need")), "mix-needs")
    parted = _parted(sized, by).where("rest IS NOT NULL").select("source", "size", "o", "u").withColumn("_tie", F.col("u"))
    ranked = exact_rank(parted, ["source"], F.col("o"), BINS, "before", "size").join(needs, F.col("source").eqNullSafe(F.col("s")))
    ranked = written(ranked.select("s", F.struct("o", "u").alias("at"), (F.col("before") + F.col("size") / 2.0 <= F.col("need") + 1e-6).alias("fits")), "mix-ranked")
    cuts = ranked.where("fits").groupBy("s").agg(F.max("at").alias("cut"))
    tied = ranked.join(cuts.withColumnRenamed("s", "c"), F.col("s").eqNullSafe(F.col("c")) & (F.col("at") == F.col("cut"))).groupBy("c", "cut").agg(F.count("*").alias("tied"), F.count_if("fits").alias("tied_taken"))
    return written(by.join(tied, F.col("source").eqNullSafe(F.col("c")), "left").drop("c"), "mix-plan")


def with_copies(rows: DataFrame, by: DataFrame) -> DataFrame:
    """``rows`` (source, size, u, ...) with source_size, target and copies (0 to 2); ``by`` is their plan."""
    here = F.struct("o", "u")
    parted = _parted(rows, by)
    given = F.coalesce(F.col("rest").isNotNull() & (here <= F.col("cut")), F.lit(False))
    part = F.coalesce(F.col("rest").isNotNull() & (here == F.col("cut")) & (F.col("tied_taken") < F.col("tied")), F.lit(False))
    columns = [*rows.columns, "source_size", "target"]
    out = parted.where(~part).select(*columns, (F.col("base") + given.cast("int")).alias("copies"))
    if not by.where("tied_taken < tied").head(1):
        return out
    # Equal rows at the cut, of which some are taken: which ones makes no difference, their number does.
    equal = written(parted.where(part).withColumn("_tie", F.monotonically_increasing_id()), "mix-tied")
    equal = exact_rank(equal, ["source"], unit_hash(F.col("_tie")), BINS, "_place")
    return out.unionByName(equal.select(*columns, (F.col("base") + (F.col("_place") < F.col("tied_taken")).cast("int")).alias("copies")))


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(*more, "doc_id", "source", n_words(F.col("text")).alias("size"), place_hash().alias("u"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it has copies, with the columns of ``docs``.

    A null text has no words; a null source is a source of its own; every row counts on its own, whether or not its
    doc_id is null or repeated. Documents without words have a rate of 1 (0 where their whole source has no words). An
    empty table gives an empty one. Other columns, whatever their names, are carried in a struct.
    """
    by = plan(written(_sized(docs), "mix-sizes"))
    out = with_copies(_sized(docs, F.struct("*").alias("row")), by).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every document; see ``mixed`` for odd rows."""
    sized = written(_sized(docs), "mix-sizes")
    out = with_copies(sized, plan(sized))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


#: Targets by a rising level, duals by bisection, copies by one ranking of a source's documents.
ORACLE = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))), 1, 13)) AS BIGINT) / power(16, 13) AS u
  FROM documents),
totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         coalesce(sum(size::DOUBLE * size) / nullif(sum(size), 0), 1) AS mean FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight,
         source_size * 2.0::DOUBLE AS ceiling, (sum(source_size) OVER ()) * 1.5::DOUBLE AS budget FROM totals),
risen AS (
  SELECT *, ceiling / weight <= (budget - coalesce(sum(ceiling) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS capped
  FROM weighed WINDOW before AS (ORDER BY ceiling / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aimed AS (
  SELECT source, source_size, mean, CASE WHEN capped THEN ceiling ELSE weight * ((budget - sum(CASE WHEN capped THEN ceiling ELSE 0 END) OVER ())
         / nullif(sum(CASE WHEN capped THEN 0 ELSE weight END) OVER (), 0)) END AS target FROM risen),
hist AS (SELECT source, size, count(*) AS n FROM sized WHERE size > 0 GROUP BY source, size),
halved AS (
  SELECT source, target, mean, 0 AS step, -1e6::DOUBLE AS low, 1e6::DOUBLE AS high FROM aimed WHERE target > 0 AND target < source_size * 2 * (1 - 1e-12)
  UNION ALL
  SELECT source, target, mean, step + 1, CASE WHEN taken < target THEN (low + high) / 2 ELSE low END, CASE WHEN taken < target THEN high ELSE (low + high) / 2 END
  FROM (SELECT b.source, b.target, b.mean, b.step, b.low, b.high,
               sum(n * size * least(2.0::DOUBLE, exp(least((low + high) / 2 * size / mean, 50.0::DOUBLE)))) AS taken
        FROM halved b JOIN hist h ON h.source IS NOT DISTINCT FROM b.source WHERE b.step < 110
        GROUP BY b.source, b.target, b.mean, b.step, b.low, b.high)),
solved AS (SELECT source, (low + high) / 2 AS lam FROM halved WHERE step = 110),
rated AS (
  SELECT d.*, a.source_size, a.target,
         CASE WHEN l.lam IS NULL THEN CASE WHEN a.target > 0 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END
              ELSE least(2.0::DOUBLE, exp(least(l.lam * size / a.mean, 50.0::DOUBLE))) END AS rate
  FROM sized d JOIN aimed a ON d.source IS NOT DISTINCT FROM a.source LEFT JOIN solved l ON d.source IS NOT DISTINCT FROM l.source),
parted AS (SELECT *, CAST(floor(rate + 1e-9) AS INTEGER) AS base FROM rated),
rested AS (SELECT *, CASE WHEN rate - base > 1e-9 AND size > 0 THEN rate - base END AS rest, target - sum(base * size) OVER (PARTITION BY source) AS need FROM parted),
ranked AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source, rest IS NULL ORDER BY greatest(u, 1e-18) / rest, u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM rested),
counted AS (SELECT *, base + CASE WHEN rest IS NOT NULL AND before + size / 2.0::DOUBLE <= need + 1e-6 THEN 1 ELSE 0 END AS copies FROM ranked)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, copies FROM counted
"""
