"""Toxicity: maximum-scoring segments of token log-odds, calibrated by their extreme-value law."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.calibration import apply_isotonic, fit_isotonic
from tessera.llm.common import labelled_sample, slices, written
from tessera.llm.quality import fold

THRESHOLD = 0.3
MOST_LABELLED = 400_000
PREFIXES = 3, 8
PRIOR = 500.0
FLAT_PRIOR = 0.5
DRIFT = 0.25
SIGNIFICANT = 0.05
SLICE = 8 << 20
MOST_COUNTED = 400_000

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Lower-case runs of letters and digits; every character beyond ASCII is a letter here."""
    if not text:
        return []
    return (text if text.isascii() else text.lower()).encode("utf-8", "surrogatepass").translate(_FOLD).split()


def counted(docs: DataFrame, labels: pd.DataFrame) -> DataFrame:
    """(token, toxic, clean, every): in how many documents a token stands, of either label and of the whole corpus."""
    ids, marks = labels["doc_id"].to_numpy(), labels["toxic"].to_numpy()
    order = np.argsort(ids)
    ids, marks = ids[order], marks[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, toxic, clean = Counter(), Counter(), Counter()

        def out() -> pa.RecordBatch:
            names = list(every)
            b = pa.RecordBatch.from_pydict({"token": pa.array([x.decode("utf-8", "replace") for x in names], pa.string()), "toxic": pa.array([toxic[x] for x in names], pa.int64()), "clean": pa.array([clean[x] for x in names], pa.int64()), "every": pa.array([every[x] for x in names], pa.int64())})
            for c in (every, toxic, clean):
                c.clear()
            return b

        for b in slices(batches, SLICE):
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                own = set(tokens(text))
                every.update(own)
                if doc is not None and (at := np.searchsorted(ids, doc)) < len(ids) and ids[at] == doc:
                    (toxic if marks[at] else clean).update(own)
            if len(every) > MOST_COUNTED:
                yield out()
        yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "token string, toxic long, clean long, every long").groupBy("token").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "every")])


class Terms:
    """Scores of terms, by the 64-bit hashes of these: 12 bytes a term and a sieve of 32 to 64, so that all terms go to the tasks."""

    def __init__(self, names: list[str], scores: np.ndarray):
        keys = np.fromiter((xxhash.xxh3_64_intdigest(x.encode()) for x in names), np.uint64, len(names))
        order = np.argsort(keys)
        self.keys, self.scores = keys[order], np.asarray(scores, np.float32)[order]
        # Which low bits of hashes occur: most tokens are no term, and are told so by one byte.
        self.mask = (1 << max(10, (32 * len(names)).bit_length())) - 1
        sieve = np.zeros(self.mask + 1, np.uint8)
        sieve[(self.keys & np.uint64(self.mask)).astype(np.int64)] = 1
        self.sieve = sieve.tobytes()

    def __len__(self) -> int:
        return len(self.keys)

    def get(self, term: bytes) -> float:
        low = xxhash.xxh3_64_intdigest(term)
        if not self.sieve[low & self.mask]:
            return 0.0
        key = np.uint64(low)
        at = int(np.searchsorted(self.keys, key))
        return float(self.scores[at]) if at < len(self.keys) and self.keys[at] == key else 0.0


def lexicon(counts: DataFrame) -> Terms:
    """All terms whose log-odds of toxic against clean text differ from 0: the end of their 95 % interval that is nearer 0.

    A token of negative log-odds counts so much below -DRIFT, which is what every token counts whose log-odds are not known
    to differ from 0 (it keeps the expected score of a text negative). Terms are tokens, and beginnings of labelled tokens (PREFIXES characters, written with a star), which tell of forms
    that no labelled text has (only where they are toxic). The Dirichlet prior is PRIOR times the term's share of the corpus plus FLAT_PRIOR, with
    every token of every document in the totals; rare terms need evidence to leave 0. A term stands in two toxic (or, for
    negative ones, clean) texts of the labelled sample at least: the sample's size bounds the lexicon.
    """
    counts = written(counts, "toxic-counts")
    n = counts.agg(*[F.sum(c).cast("double").alias(c) for c in ("toxic", "clean", "every")], F.count("*").alias("kinds")).first()
    if not n["toxic"] or not n["clean"]:
        return Terms([], np.zeros(0))
    low, high = PREFIXES
    starts = F.transform(F.sequence(F.lit(low), F.least(F.lit(high), F.length("token") - 1)), lambda k: F.concat(F.substring("token", 1, k), F.lit("*")))
    begun = counts.where((F.length("token") > low) & (F.col("toxic") + F.col("clean") > 0)).select(F.explode(starts).alias("token"), "toxic", "clean", "every")
    begun = begun.groupBy("token").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "every")])
    prior = F.col("every") / n["every"] * PRIOR + FLAT_PRIOR
    whole = PRIOR + FLAT_PRIOR * n["kinds"]
    a, b = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.log(a / (n["toxic"] + whole - a)) - F.log(b / (n["clean"] + whole - b))
    error = 1.96 * F.sqrt(1 / a + 1 / b)
    score = F.when((F.col("toxic") > 1) & (odds > error), odds - error).when(F.col("whole") & (F.col("clean") > 1) & (odds < -error), odds + error - DRIFT)
    terms = counts.withColumn("whole", F.lit(True)).unionByName(begun.withColumn("whole", F.lit(False)))
    best = terms.where("toxic > 1 OR clean > 1").select("token", score.alias("score")).where("score IS NOT NULL").toPandas()
    return Terms(best["token"].tolist(), best["score"].to_numpy())


class Scores(dict):
    """Scores of tokens as they come up: the token's or its best known beginning's if toxic, else its negative one, 0 for none."""

    def __init__(self, terms: Terms):
        super().__init__()
        self.terms = terms

    def __missing__(self, token: bytes) -> float:
        if len(self) > 1_000_000:
            self.clear()
        word = token.decode("utf-8", "replace")
        low, high = PREFIXES
        begun = (self.terms.get((word[:k] + "*").encode()) for k in range(low, min(high, len(word) - 1) + 1))
        own, best = self.terms.get(token), max(begun, default=0.0)
        out = self[token] = max(own, best) if max(own, best) > 0 else own
        return out


def segments(scores: list[float], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """(first, end, score) of all maximal scoring segments, disjoint, in order; a token of score 0 counts -drift.

    Ruzzo and Tompa's scan: a new segment is joined to the nearest earlier one that began lower, if that ended no higher.
    ``lower`` holds the segments that such a search can still reach, each beginning higher than the one before; what a
    search passes over begins no lower than the new segment and is closed to later ones, so every segment enters and
    leaves once: linear in the number of tokens. Runs without terms only lower the total and are passed over in a step, as
    are terms of negative scores.
    """
    found: list[list[float]] = []  # first, end, total before, total after
    lower: list[int] = []
    total, at = 0.0, 0
    for i in [i for i, x in enumerate(scores) if x]:
        total -= drift * (i - at)
        left, total, at = total, total + scores[i], i + 1
        if scores[i] < 0:
            continue
        new = [i, i + 1, left, total]
        while True:
            while lower and found[lower[-1]][2] >= new[2]:
                lower.pop()
            if not lower or found[lower[-1]][3] >= new[3]:
                lower.append(len(found))
                found.append(new)
                break
            j = lower.pop()
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(int(f), int(e), r - b) for f, e, b, r in found]


class Law:
    """Chance of a segment in clean text: expected number K n exp(-lam S) of segments of score S in n tokens."""

    def __init__(self, lam: float, k: float):
        self.lam, self.k = lam, k

    def expected(self, n: float, score: float) -> float:
        return self.k * max(n, 1) * float(np.exp(-self.lam * score))


def fit_law(clean: DataFrame, drift: float) -> Law:
    """``clean`` has n (tokens), hits (array of term scores) and scores (array of segment scores) of clean documents."""
    bins = 256
    tokens_n = clean.agg(F.sum("n")).first()[0] or 0
    hist = clean.select(F.explode("hits").alias("s")).groupBy(F.least(F.lit(bins - 1), F.floor(F.col("s") * 16)).alias("b")).agg(F.count("*").alias("n")).collect()
    score = np.array([-drift] + [(r["b"] + 0.5) / 16 for r in hist])
    count = np.array([0.0] + [float(r["n"]) for r in hist])
    count[0] = max(tokens_n - count.sum(), 1.0)
    share = count / count.sum()
    if score.max() <= 0 or share @ score >= 0:
        return Law(1.0, 0.1)
    low, high = 0.0, 1.0
    while share @ np.exp(high * score) < 1 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if share @ np.exp(mid * score) < 1 else (low, mid)
    seen = clean.agg(F.sum(F.size("scores"))).first()[0] or 0
    decay = clean.select(F.explode("scores").alias("s")).agg(F.min("s")).first()[0] or 0.0
    return Law(low, max(1e-9, seen / max(tokens_n, 1) * float(np.exp(low * decay))))


def passages(docs: DataFrame, terms: Terms, counts: Column, drift: float = DRIFT) -> DataFrame:
    """doc_id, n, hits, firsts, ends and scores: the maximal segments of every document, and the term scores where ``counts`` is true."""
    schema = "doc_id long, n long, hits array<double>, firsts array<int>, ends array<int>, scores array<double>"
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Scores(shared.value)
        for b in slices(batches, SLICE):
            out: dict[str, list] = {k: [] for k in ("n", "hits", "firsts", "ends", "scores")}
            for text, count in zip(b.column("text").to_pylist(), b.column("counts").to_pylist(), strict=True):
                scores = [known[w] for w in tokens(text)]
                found = segments(scores, drift)
                out["n"].append(len(scores))
                out["hits"].append([x for x in scores if x] if count else [])
                for k, i in (("firsts", 0), ("ends", 1), ("scores", 2)):
                    out[k].append([x[i] for x in found])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out["n"], pa.int64()), pa.array(out["hits"], pa.list_(pa.float64())), pa.array(out["firsts"], pa.list_(pa.int32())), pa.array(out["ends"], pa.list_(pa.int32())), pa.array(out["scores"], pa.list_(pa.float64()))], names=["doc_id", "n", "hits", "firsts", "ends", "scores"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", counts.alias("counts")).mapInArrow(run, schema)


def scores(docs: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages and passages (first word, end, score, expected) of every row.

    Labels are learnt from rows outside the fold ``held``: all but the last fold for the lexicon, the last for the
    calibration; MOST_LABELLED of them at most, the first by a hash. The counts behind the prior cover every document.
    Empty and null texts have no passage and the lowest score; repeated rows are scored alike; without labels nothing is
    toxic. A doc_id labelled twice counts once, by its larger label. An empty table gives an empty one.
    """
    at = fold(F.col("doc_id"), parts)
    last = parts - 1 if held != parts - 1 else parts - 2
    marks = labels.select("doc_id", "toxic").where(F.col("toxic").isNotNull() & (at != held))
    terms = lexicon(counted(docs, labelled_sample(marks.where(at != last), MOST_LABELLED)))
    found = written(passages(docs, terms, at == last).withColumn("fold", at), "toxic-passages")
    marks = marks.where(at == last).groupBy(F.col("doc_id").alias("_d")).agg(F.max("toxic").cast("double").alias("label"))
    known = written(found.where(F.col("fold") == last).join(marks, F.col("doc_id") == F.col("_d")), "toxic-known")
    law = fit_law(known.where("label = 0"), DRIFT)
    # Evidence: -log10 of the expected numbers, summed over the significant passages.
    expected = lambda s: F.greatest(F.lit(1e-30), F.lit(law.k) * F.greatest(F.col("n"), F.lit(1)) * F.exp(-law.lam * s))
    evidence = F.aggregate("scores", F.lit(0.0), lambda acc, s: acc + F.when(expected(s) < SIGNIFICANT, -F.log10(expected(s))).otherwise(0.0))
    raw = F.log1p(evidence)
    knots = fit_isotonic(known.select(raw.alias("raw"), "label"), 0.0, 8.0)

    @F.pandas_udf("double")
    def calibrated(x: pd.Series) -> pd.Series:
        return pd.Series(apply_isotonic(x.to_numpy(), knots))

    score = calibrated(raw) if len(terms) else F.lit(0.0)
    spans = F.filter(F.transform(F.arrays_zip("firsts", "ends", "scores"), lambda x: F.struct(x["firsts"].alias("first"), x["ends"].alias("end"), x["scores"].alias("score"), expected(x["scores"]).alias("expected"))), lambda x: x["expected"] < SIGNIFICANT)
    out = found.select("doc_id", (F.col("fold") == held).alias("held_out"), score.alias("score"), spans.alias("passages"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"), "passages")
