"""Quality rules: counts of a document, and a hashed n-gram likelihood ratio between trusted and raw text."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import mix, slices

BUCKETS = 1 << 16
SMOOTHING = 0.5
MOST_BROADCAST = 4_000_000
THRESHOLD = -0.12
LEAST_WORDS = 20
MOST_REPEATED = 30
RUN = 8
SLICE = 8 << 20
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True


class Words:
    """The words of a slice of texts: ``ids`` numbers them, ``doc`` has the row of each, ``names`` the distinct ones."""

    def __init__(self, texts: pa.Array):
        values = texts.fill_null("").to_pylist()
        seen: dict[bytes, int] = {}
        number, ids, counts, self.lines = seen.setdefault, [], [], []
        for text in values:
            # bytes.split() parts at exactly the bytes 09-0D and 20
            words = text.encode("utf-8", "surrogatepass").split()
            ids += [number(w, len(seen)) for w in words]
            counts.append(len(words))
        self.texts, self.names = values, list(seen)
        self.ids, self.counts = np.array(ids, np.int64), np.array(counts, np.int64)
        self.doc = np.repeat(np.arange(len(values)), self.counts)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, weights=flags, minlength=len(self.counts)).astype(np.int64)


def repeated_words(ids: np.ndarray, doc: np.ndarray, run: int = RUN) -> np.ndarray:
    """Flags the words inside a window of ``run`` (a power of two) words that its document has twice or more.

    Windows get numbers that are equal for equal words only: those of two halves are numbered as a pair, doubling.
    """
    n = len(ids)
    flags = np.zeros(n, bool)
    if n < run:
        return flags
    key, width = pd.factorize(doc * (int(ids.max()) + 1) + ids)[0].astype(np.int64), 1
    while width < run:
        top = int(key.max()) + 1
        key = pd.factorize(key[: len(key) - width] * top + key[width:])[0].astype(np.int64)
        width *= 2
    inside = doc[: len(key)] == doc[run - 1 :]
    again = np.bincount(key[inside], minlength=int(key.max()) + 1)[key] > 1
    again &= inside
    edge = np.zeros(n + 1, np.int64)
    edge[: len(again)] += again
    edge[run : run + len(again)] -= again
    return np.cumsum(edge)[:n] > 0


def base_counts(texts: pa.Array, words: Words) -> dict[str, np.ndarray]:
    lengths = np.array([len(w.decode("utf-8", "surrogatepass")) for w in words.names], np.int64)
    symbols, dup = np.zeros(len(words.texts), np.int64), np.zeros(len(words.texts), np.int64)
    for i, text in enumerate(words.texts):
        symbols[i] = _SYMBOLS[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)].sum()
        lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        dup[i] = len(lines) - len(set(lines))
    repeats = words.per_doc(repeated_words(words.ids, words.doc))
    return {"n_words": words.counts, "word_chars": words.per_doc(lengths[words.ids]) if len(words.ids) else np.zeros(len(words.texts), np.int64), "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeats}


def buckets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every word and every pair of neighbouring words of a document."""
    if not len(words.ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = np.array([zlib.crc32(w) for w in words.names], np.uint64)[words.ids]
    pair = mix(own[:-1] * np.uint64(0x9E3779B97F4A7C15) + own[1:])
    same = words.doc[:-1] == words.doc[1:]
    found = np.concatenate([mix(own), pair[same]]) % np.uint64(BUCKETS)
    return found.astype(np.int64), np.concatenate([words.doc, words.doc[:-1][same]])


def bucket_counts(docs: DataFrame, good: np.ndarray | None = None) -> DataFrame:
    """(bucket, raw, trusted): how often n-grams of each hash bucket stand in ``docs`` and in those of the ``good`` ids (None: all).

    A task gives BUCKETS rows at most.
    """
    shared = docs.sparkSession.sparkContext.broadcast(good)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, raw, trusted = shared.value, np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in slices(batches, SLICE):
            found, rows = buckets(Words(b.column("text")))
            raw += np.bincount(found, minlength=BUCKETS)
            if good is not None and len(good):
                ids = b.column("doc_id")
                known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
                own = known & (good[np.minimum(np.searchsorted(good, ids), len(good) - 1)] == ids)
                trusted += np.bincount(found[own[rows]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_pydict({"bucket": some.astype(np.int32), "raw": raw[some], "trusted": (raw if good is None else trusted)[some]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "bucket int, raw long, trusted long")


def ratios(docs: DataFrame, labels: DataFrame, most_broadcast: int = MOST_BROADCAST) -> np.ndarray:
    """log p(bucket | trusted) - log p(bucket | raw) of the hash buckets, both sides counted over every document of theirs.

    Trusted are all documents labelled of good quality. Up to ``most_broadcast`` of their ids (8 bytes each) go to the
    tasks, so that texts are read once and not shuffled; more are found by a semi-join, with the same result. BUCKETS
    rows reach the driver, whatever the input.
    """
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("good")).distinct()
    ids = good.limit(most_broadcast + 1).toPandas()["good"].to_numpy(np.int64)
    if len(ids) <= most_broadcast:
        counts = bucket_counts(docs, np.sort(ids))
    else:
        trusted = bucket_counts(docs.select("doc_id", "text").join(good, F.col("doc_id") == F.col("good"), "left_semi"))
        counts = bucket_counts(docs, np.zeros(0, np.int64)).unionByName(trusted.withColumn("raw", F.lit(0).cast("long")))
    found = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).toPandas()
    raw, trusted = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[found["bucket"]], trusted[found["bucket"]] = found["raw"], found["trusted"]
    if not trusted.sum():
        return np.zeros(BUCKETS, np.float32)
    p, q = ((x + SMOOTHING) / (x.sum() + SMOOTHING * BUCKETS) for x in (trusted, raw))
    return (np.log(p) - np.log(q)).astype(np.float32)


OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double"


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Counts, verdicts and ``llr`` (mean log ratio over a document's n-grams) of every row of ``docs`` (doc_id, text).

    A document is kept if it passes the base rules (LEAST_WORDS words; MOST_REPEATED % of words in repeated windows at
    most) and its llr reaches ``threshold``. Null and empty texts have no words and fail. Without trusted documents
    llr is 0. Repeated rows are judged alike. An empty table gives an empty one.
    """
    table = ratios(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE):
            words = Words(b.column("text"))
            out = base_counts(b.column("text"), words)
            found, rows = buckets(words)
            n = len(words.counts)
            llr = np.bincount(rows, weights=table[found], minlength=n) / np.maximum(np.bincount(rows, minlength=n), 1)
            failed = (out["n_words"] < LEAST_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEATED * out["n_words"])
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), **out, "base_failed": failed, "kept": ~failed & (llr >= threshold), "llr": llr})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, OUT)
