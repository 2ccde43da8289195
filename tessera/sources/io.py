"""Sources and sinks: JSON lines, the table of points by run, galleries, decision logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import schemas


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; lines that are empty, comments or broken are left out."""
    named = spark.read.schema(f"{schema}, _comment string, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    keep = F.col("_comment").isNull() & F.col("_corrupt").isNull()
    some = F.coalesce(*[F.col(f.name).cast("string") if f.dataType.typeName() not in ("map", "array", "struct") else F.to_json(f.name) for f in named.schema.fields if f.name not in ("_comment", "_corrupt")]).isNotNull()
    # Without a cache Spark refuses queries on the corrupt column alone; here it is read along with the others.
    return named.where(keep & some).drop("_comment", "_corrupt")


def detections(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Detections and post-overlap checks, the two kinds of record of one file."""
    rows = json_lines(spark, path, schemas.DETECTIONS)
    check = F.coalesce("post_overlap_feature_check", F.lit(False))
    return rows.where(~check), rows.where(check)


def labels(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, schemas.LABELS).where(F.col("verdict").isin("same", "different"))


def tracklet_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Labelled pairs, their [camera, track] put together as keys."""
    rows = json_lines(spark, path, schemas.TRACKLET_PAIRS)
    return rows.withColumn("a", F.array_join("a", ":")).withColumn("b", F.array_join("b", ":"))


def point_id(*parts: Column) -> Column:
    """An id that the same observation always gets."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def event_time(source_ts: Column, read_ts: Column) -> Column:
    """The time of the source, or else the time of reading."""
    return F.coalesce(source_ts, read_ts)


def media_time(offset: Column, index: Column, fps: Column) -> Column:
    return offset + index / fps


class Points:
    """The table of observed vectors at ``path``, a folder for each run_id."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, rows: DataFrame) -> None:
        """Appends rows; an id follows from what was observed, so that a second write of the same rows can be told."""
        ids = rows.withColumn("point_id", point_id(F.col("run_id"), F.col("camera"), F.col("track_id"), F.col("frame")))
        ids.write.mode("append").partitionBy("run_id").parquet(self.path)

    def read(self, run_id: str | None = None) -> DataFrame:
        """The points, each once; of one run only its folder is read."""
        rows = self.spark.read.schema(schemas.POINTS).parquet(self.path)
        rows = rows.where(F.col("run_id") == run_id) if run_id is not None else rows
        # Two writes of one point with different values: the largest row counts, on every run.
        others = [c for c in rows.columns if c != "point_id"]
        return rows.groupBy("point_id").agg(F.max(F.struct(*others)).alias("_row")).select("point_id", "_row.*").select(*rows.columns)

    def identified(self, mapping: DataFrame) -> DataFrame:
        """Points with the ids of ``mapping`` (point_id, gid); write it to a new path and swap, as files cannot be changed."""
        new = mapping.select(F.col("point_id").alias("_p"), F.col("gid").alias("_g"))
        rows = self.read()
        joined = rows.join(new, rows["point_id"] == new["_p"], "left")
        return joined.withColumn("global_id", F.coalesce("_g", "global_id")).withColumn("reid_id", F.coalesce("_g", "reid_id")).drop("_p", "_g")

    def cleared(self, ids: DataFrame) -> DataFrame:
        """Points of which those in ``ids`` (point_id) have no identity any more."""
        marks = ids.select(F.col("point_id").alias("_p"), F.lit(True).alias("_c")).distinct()
        rows = self.read()
        joined = rows.join(marks, rows["point_id"] == marks["_p"], "left")
        none = F.lit(None).cast("bigint")
        return joined.withColumn("global_id", F.when(F.col("_c"), none).otherwise(F.col("global_id"))).withColumn("reid_id", F.when(F.col("_c"), none).otherwise(F.col("reid_id"))).drop("_p", "_c")

    def replace(self, rows: DataFrame) -> "Points":
        """Writes ``rows`` as the next version of the table and gives it; readers of this one are not disturbed."""
        base, _, version = self.path.partition("@")
        new = Points(self.spark, f"{base}@{int(version or 0) + 1}")
        rows.select(*self.read().columns).write.mode("overwrite").partitionBy("run_id").parquet(new.path)
        return new

    def count(self) -> int:
        return self.read().count()

    def reset(self) -> None:
        self.spark.createDataFrame([], schemas.POINTS).write.mode("overwrite").partitionBy("run_id").parquet(self.path)


def tracklet_table(points: DataFrame, least: int = 1) -> DataFrame:
    """A row per (camera, track_id) with its frames, times, ids and vectors in order of frame."""
    row = F.struct("frame", "ts", "vec", "global_id", "point_id")
    rows = points.groupBy("run_id", "camera", "track_id").agg(F.array_sort(F.collect_list(row), lambda a, b: F.when(a["frame"] < b["frame"], -1).when(a["frame"] > b["frame"], 1).when(a["point_id"] < b["point_id"], -1).otherwise(1)).alias("rows"))
    return rows.where(F.size("rows") >= least).select("run_id", "camera", "track_id", F.size("rows").alias("n"), *[F.col(f"rows.{c}").alias(f"{c}s") for c in ("frame", "ts", "vec", "global_id")])


def write_decisions(log: DataFrame, path: str) -> None:
    """The log as JSON lines, a folder for each type of record."""
    log.write.mode("append").partitionBy("type").json(path)


def write_mapping(mapping: DataFrame, path: str) -> None:
    mapping.write.mode("overwrite").json(path)


def write_gallery(bank: DataFrame, path: str) -> None:
    bank.write.mode("overwrite").partitionBy("model").parquet(path)


def save_tracklets(tracklets: DataFrame, features: DataFrame, path: str) -> None:
    """Tracklets (key, ...) and their vectors (key, seq, quality, vec) as two tables under ``path``."""
    tracklets.write.mode("overwrite").parquet(f"{path}/tracklets")
    features.write.mode("overwrite").parquet(f"{path}/vectors")


def load_tracklets(spark: SparkSession, path: str) -> DataFrame:
    """The saved tracklets that have vectors, with ``bank``: (seq, quality, vec) in order."""
    vectors = spark.read.parquet(f"{path}/vectors")
    bank = vectors.groupBy(F.col("key").alias("_key")).agg(F.array_sort(F.collect_list(F.struct("seq", "quality", "vec"))).alias("bank"))
    tracklets = spark.read.parquet(f"{path}/tracklets")
    return tracklets.join(bank, tracklets["key"] == bank["_key"]).drop("_key")


def load_mapping(spark: SparkSession, path: str) -> DataFrame:
    """key and gid of a written mapping; of a key that stands twice the smaller gid."""
    return spark.read.schema("key string, gid string").json(path).groupBy("key").agg(F.min("gid").alias("gid"))


def load_gallery(spark: SparkSession, identities: DataFrame, path: str) -> DataFrame:
    """gid, model and vectors in order of seq, of the identities that are known; a model without vectors has no row."""
    bank = spark.read.parquet(path).join(identities.select("gid"), "gid", "left_semi")
    return bank.groupBy("gid", "model").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "vec"))), lambda x: x["vec"]).alias("vectors"))


def write_probabilities(scored: DataFrame, path: str) -> None:
    """One JSON line for each scored pair: when, the features and the probability."""
    features = F.struct(*[c for c in scored.columns if c not in ("ts", "prob")])
    scored.select("ts", features.alias("features"), "prob").write.mode("append").json(path)


def floor_records(positions: DataFrame, version: str, units: str) -> DataFrame:
    """The records of a geometry log from positions (run_id, camera, track_id, frame, ts, bbox, foot_x, foot_y, source,
    clipped, x, y, error, group): rows without a position have none. The image's foot point is kept, so that a better
    calibration can be applied later."""
    known = positions.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    return known.select(
        "run_id", "camera", "track_id", "frame", "ts", F.transform("bbox", lambda v: F.round(v, 2)).alias("bbox"), F.array(F.round("foot_x", 2), F.round("foot_y", 2)).alias("foot_img"), F.col("source").alias("foot_source"),
        "clipped", F.array(F.round("x", 4), F.round("y", 4)).alias("floor"), F.round("error", 4).alias("floor_error"), "group", F.lit(version).alias("calib_version"), F.lit(units).alias("units"),
    )


def floor_counts(positions: DataFrame) -> DataFrame:
    """camera, recorded and unavailable: how many observations have a position."""
    return positions.groupBy("camera").agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("recorded"), F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("unavailable"))


def write_floor_log(positions: DataFrame, path: str, version: str, units: str) -> None:
    floor_records(positions, version, units).write.mode("append").json(path)


def write_annotations(rows: DataFrame, path: str) -> None:
    """Boxes and labels (camera, frame, ...) as JSON lines, a folder for each camera, in order of frame within a file."""
    rows.repartition("camera", F.floor(F.col("frame") / 10_000)).sortWithinPartitions("camera", "frame").write.mode("overwrite").partitionBy("camera").json(path)


def write_calibration(record: DataFrame, path: str, version: str, units: str = "m") -> DataFrame:
    """Writes a calibration (camera, floor_group, homography, width, height, position_error) under its version, and gives it as read back.

    Records that no later run could use are refused: a camera twice, or a homography that has not nine numbers.
    """
    bad = record.where((F.size("homography") != 9) | F.exists("homography", lambda x: x.isNull() | F.isnan(x)) | F.col("camera").isNull())
    if bad.head(1) or schemas.duplicate_keys(record, ["camera"]).head(1):
        raise ValueError("a calibration needs one homography of nine numbers for each camera")
    stamped = record.withColumn("calib_version", F.lit(version)).withColumn("units", F.lit(units))
    stamped.write.mode("overwrite").json(f"{path}/{version}")
    return record.sparkSession.read.schema(stamped.schema).json(f"{path}/{version}")


def calibration_summary(record: DataFrame) -> DataFrame:
    """floor_group, cameras in order and the largest position error."""
    return record.groupBy("floor_group").agg(F.array_sort(F.collect_set("camera")).alias("cameras"), F.max("position_error").alias("position_error"))
