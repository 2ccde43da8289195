"""Quality classifier: ridge regression on random Fourier features of document statistics, then isotonic calibration."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.calibration import apply_isotonic, fit_isotonic
from tessera.llm.common import slices, text_buffer, written

THRESHOLD = 0.3
FOURIER = 256
RIDGE = 1e-3
SEED = 20240501
SLICE = 8 << 20

#: Classes of bytes whose shares are statistics.
CLASSES = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\r\x0b\x0c", "line": b"\n", "stop": b".,;:'\"()-", "shout": b"!?", "bar": b"|", "symbol": b"#*$%&<>@^~=+_/\\{}[]`"}
KINDS = len(CLASSES) + 2
_KIND = np.full(256, len(CLASSES) + 1, np.uint8)
_KIND[:128] = len(CLASSES)
for _i, _members in enumerate(CLASSES.values()):
    _KIND[np.frombuffer(_members, np.uint8)] = _i
N_STATS = KINDS + 7


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of N_STATS figures for each text: shares of byte classes, and how much words and lines repeat. Nulls are empty texts."""
    starts, data = text_buffer(texts)
    n, sizes = len(texts), np.diff(starts)
    kind = _KIND[data].astype(np.int64)
    kind += np.repeat(np.arange(n, dtype=np.int64) * KINDS, sizes)
    shares = np.bincount(kind, minlength=n * KINDS).reshape(n, KINDS) / np.maximum(sizes, 1)[:, None]
    own = np.zeros((n, 7))
    for i in range(n):
        raw = data[starts[i] : starts[i + 1]].tobytes()
        words = raw.split()
        if not words:
            continue
        lines, distinct = raw.split(b"\n"), len(set(words))
        own[i] = (
            np.log1p(len(words)), sum(map(len, words)) / len(words), distinct / len(words), np.log(distinct) / np.log(len(words) + 1), len(set(lines)) / len(lines), len(zlib.compress(raw, 1)) / len(raw), np.log1p(len(lines)),
        )
    return np.hstack([shares, own])


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and stats (array of N_STATS doubles) of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE):
            stats = statistics(b.column("text"))
            values = pa.array(stats.ravel().astype(np.float32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(np.arange(len(stats) + 1, dtype=np.int32) * N_STATS, values)], names=["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, stats array<float>")


def fold(doc_id: Column, parts: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)), F.lit(0)).cast("int")


class Fourier:
    """Standardised statistics to cosines whose products approximate a Gaussian kernel of width sqrt(N_STATS)."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, size: int = FOURIER, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(size=(len(mean), size)) / np.sqrt(len(mean))
        self.b = rng.uniform(0, 2 * np.pi, size)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.b)) * np.cos(x @ self.w + self.b), np.ones((len(x), 1))])


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def fit_ridge(train: DataFrame, features: Fourier, ridge: float = RIDGE) -> np.ndarray:
    """Weights that solve the ridge problem; ``train`` has stats and label.

    Each partition sums its part of the normal equations; a row of the matrix is then summed over the partitions, and
    FOURIER + 1 rows reach the driver, whatever the input.
    """
    size = FOURIER + 1

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size + 1))
        for f in frames:
            if len(f):
                z = features(_stack(f["stats"]))
                total += z.T @ np.hstack([z, f["label"].to_numpy(float)[:, None]])
        yield pd.DataFrame({"i": np.arange(size), "sums": list(total)})

    def add(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": f["i"].iloc[:1], "sums": [np.sum(np.stack(f["sums"].to_numpy()), axis=0)]})

    schema = "i int, sums array<double>"
    rows = train.mapInPandas(part, schema).groupBy("i").applyInPandas(add, schema).collect()
    a = np.zeros((size, size + 1))
    for r in rows:
        a[r["i"]] = r["sums"]
    n = max(a[-1, -2], 1.0)
    return np.linalg.solve(a[:, :-1] / n + ridge * np.eye(size) / size, a[:, -1] / n)


class Model:
    """What ``fit`` learns: the features' scaling, the ridge weights and the calibration's knots; a few kB."""

    def __init__(self, features: Fourier, weights: np.ndarray, knots: tuple[np.ndarray, np.ndarray] | None = None):
        self.features, self.weights, self.knots = features, weights, knots

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return apply_isotonic(self.raw(stats), self.knots)


def fit(stats: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0, label: str = "quality") -> Model:
    """``stats`` has doc_id, stats and fold. Rows of the fold ``held`` lend no label; of the others the last fold calibrates."""
    marks = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_d")).agg(F.max(label).cast("double").alias("label"))
    known = written(stats.where(F.col("fold") != held).join(marks, F.col("doc_id") == F.col("_d")).select("stats", "label", "fold"), "quality-known")
    calibrates = F.col("fold") == (parts - 1 if held != parts - 1 else parts - 2)
    moments = stats.agg(*[f(F.col("stats")[i].cast("double")).alias(f"{k}{i}") for i in range(N_STATS) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([moments[f"m{i}"] or 0.0 for i in range(N_STATS)])
    scale = np.array([max(moments[f"s{i}"] or 0.0, 1e-6) for i in range(N_STATS)])
    features = Fourier(mean, scale)
    model = Model(features, fit_ridge(known.where(~calibrates), features))

    def raw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield pd.DataFrame({"raw": model.raw(_stack(f["stats"])), "label": f["label"]})

    knots = fit_isotonic(known.where(calibrates).select("stats", "label").mapInPandas(raw, "raw double, label double"), -0.5, 1.5)
    return Model(features, model.weights, knots)


def _folded(docs: DataFrame, parts: int) -> DataFrame:
    return written(with_statistics(docs).withColumn("fold", fold(F.col("doc_id"), parts)), "quality-stats")


def scores(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text), learnt from ``labels`` (doc_id, quality).

    Every text, empty and null ones too, gets a score; repeated rows are scored alike; labels that are null or have no
    document are not used, and a doc_id labelled twice counts once, by its larger label. Without labels every score is
    0.5. An empty table gives an empty one.
    """
    stats = _folded(docs, parts)
    model = fit(stats, labels, parts, held)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                score = model.score(_stack(f["stats"]))
                yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"), "held_out": f["fold"] == held, "score": score, "predicted": (score >= THRESHOLD).astype("int32")})

    return stats.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns; no text is shuffled."""
    model = fit(_folded(docs, parts), labels, parts, held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE):
            yield b.filter(pa.array(model.score(statistics(b.column("text")).astype(np.float32)) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
