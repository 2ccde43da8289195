"""What the operators share: tables in the shared folder, exact ranks, components, text buffers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.operators.cluster import shared_dir

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it cuts the lineage, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exact_rank(df: DataFrame, group: list[str], order: Column, n_bins: int, rank: str, weight: str | None = None) -> DataFrame:
    """Adds ``rank``: rows before each row of its group (with ``weight``: the sum of theirs), in the order of ``order``.

    ``order`` is a double in [0, 1), evenly spread. Rows are ranked within ``n_bins`` bins of it and the bins' totals are
    summed up to each bin, so that no task holds a group: only the totals meet, ``n_bins`` rows a group. Rows that tie on
    ``order`` are ranked by what remains of the row (see callers, which order by a key of their own).
    """
    bins = df.withColumn("_bin", F.least(F.floor(order * n_bins), F.lit(n_bins - 1)).cast("int")).withColumn("_by", order)
    amount = F.col(weight) if weight else F.lit(1).cast("long")
    totals = bins.groupBy(*group, "_bin").agg(F.sum(amount).alias("_total"))
    before = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_bin").alias("_gbin"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    on = F.col("_bin") == F.col("_gbin")
    for i, c in enumerate(group):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    within = Window.partitionBy(*group, "_bin").orderBy("_by", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    ranked = bins.withColumn("_within", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    out = ranked.join(totals, on, "left").withColumn(rank, (F.col("_before") + F.col("_within")).cast("long"))
    return out.drop("_bin", "_by", "_gbin", "_before", "_within", *[f"_g{i}" for i in range(len(group))])


def unit_hash(column: Column) -> Column:
    """A double in [0, 1) from the first 13 hexadecimal digits of the MD5 of a string; DuckDB gives the same."""
    return F.conv(F.substring(F.md5(F.coalesce(column.cast("string"), F.lit("null"))), 1, 13), 16, 10).cast("double") / float(16**13)


def components(edges: DataFrame, name: str, most_rounds: int = 40) -> DataFrame:
    """(id, component): the smallest id reachable, for every id of ``edges`` (a, b: long).

    Alternating large-star and small-star steps: each is one grouping and one self-join, so that a node with many
    links never sits whole in a task, and the number of steps grows with the logarithm of a component's size.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-edges")
    last = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = small.select("e.u", "e.v").where("u <> v").distinct()
        now = written(small, f"{name}-step")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == last:
            break
        last = tuple(state)
    else:
        raise RuntimeError(f"components of {name} did not settle in {most_rounds} rounds")
    leaf = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    root = now.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return leaf.unionByName(root).groupBy("id").agg(F.min("component").alias("component"))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array, nulls being empty; no copy is made."""
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    starts = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return starts - starts[0], data[starts[0] : starts[-1]]


def slices(batches: Iterator[pa.RecordBatch], most: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of about ``most`` bytes of text, a row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        starts, _ = text_buffer(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(starts, starts[at] + most, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def schema_of(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


def labelled_sample(labels: DataFrame, most: int) -> pd.DataFrame:
    """``most`` labelled rows at most, a row per doc_id, the first by a hash of doc_id: a bounded training sample on the driver."""
    one = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.max(c).alias(c) for c in labels.columns if c != "doc_id"])
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).toPandas()
