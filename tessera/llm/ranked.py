"""Ranked lexical search by variable-block-max WAND, exactly.

The corpus is read twice and never shuffled. The first scan counts: documents, terms, and in how many documents each of
the items' terms stands. The second takes pieces of some SLICE bytes of text, each a shard: it puts like documents side by side, lists the shard's
postings of the items' terms with their exact scores and cuts each list into blocks of varying length. Dynamic
programming puts the boundaries where the bounds err least: where the sum of (block's maximum - score) over all documents
between a block's ends is least, those without the term scoring 0, and a block itself costs PRICE mean scores. WAND's
pivot test, that the maxima of the blocks which could hold a document reach the twentieth best score so far, then passes
over whole runs of documents (all of a shard in one sweep over block ends); what is left is scored, from the highest
bound down, until no bound reaches. A task carries its best documents of each item from shard to shard, so only these
leave it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import slices, text_buffer

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 20
SLICE = 8 << 20
#: Terms of the items that one pass over the corpus looks for; further items take further passes.
ITEM_TERMS = 1 << 20
LONGEST = 64
PRICE = 8.0
LISTS = 2048
FIRST_LOOK = 64
SALTS = 64

#: What a byte becomes: letters in lower case, digits, parts of other code points; 0 where no term goes on.
_FOLD = np.zeros(256, np.uint8)
_FOLD[128:] = np.arange(128, 256)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _FOLD[_c] = _c
    _FOLD[ord(chr(_c).upper())] = _c


def terms(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(text of each term, terms in order) of an array of texts; a null has none."""
    bounds, data = text_buffer(column)
    folded = _FOLD[data]
    inside = folded != 0
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[bounds[:-1][bounds[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    kept = folded[inside]
    at = np.concatenate([(np.cumsum(inside, dtype=np.int64)[starts] - 1).astype(np.int32), np.array([len(kept)], np.int32)])
    owner = np.searchsorted(bounds, starts, "right") - 1
    return owner, pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(kept)])


@dataclass(frozen=True)
class Items:
    """A pass's items: their distinct terms, and of each item the numbers of its terms and how often it has them."""

    ids: list[int | None]
    vocabulary: pa.Array
    wanted: list[tuple[np.ndarray, np.ndarray]]


def _indexed(rows: list[tuple[int | None, list[bytes]]]) -> Items:
    number: dict[bytes, int] = {}
    wanted = []
    for _, words in rows:
        counts = Counter(words)
        for w in counts:
            number.setdefault(w, len(number))
        wanted.append((np.array([number[w] for w in counts], np.int64), np.array(list(counts.values()), np.int64)))
    return Items([i for i, _ in rows], pa.array(list(number), pa.binary()), wanted)


def passes(items: DataFrame, most: int = ITEM_TERMS) -> Iterator[Items]:
    """The items in groups of at most ``most`` terms (one item at least); those without a term find nothing and are left out."""
    rows: list[tuple[int | None, list[bytes]]] = []
    held = 0
    for r in items.select("item_id", "text").toLocalIterator():
        words = terms(pa.array([r["text"]], pa.string()))[1].to_pylist()
        if rows and held + len(words) > most:
            yield _indexed(rows)
            rows, held = [], 0
        if words:
            rows.append((r["item_id"], words))
            held += len(words)
    if rows:
        yield _indexed(rows)


def _pairs(column: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms of each text, then of each pair of a known term and a text, by term and text: term, text, how often)."""
    owner, found = terms(column)
    n = np.bincount(owner, minlength=len(column)).astype(np.int64)
    ids = pc.fill_null(pc.index_in(found, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
    known = ids >= 0
    key, tf = np.unique(ids[known].astype(np.int64) * len(column) + owner[known], return_counts=True)
    return n, key // max(1, len(column)), key % max(1, len(column)), tf.astype(np.int64)


def _counts(vocabulary: pa.Array) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(term, n) of a partition: the documents that hold each known term; under -1 those with a term, under -2 all terms."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, documents, total = np.zeros(len(vocabulary), np.int64), 0, 0
        for part in slices(batches, SLICE):
            n, term, _, _ = _pairs(part.column("text"), vocabulary)
            df += np.bincount(term, minlength=len(df))
            documents += int(np.count_nonzero(n))
            total += int(n.sum())
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array(np.r_[held, -1, -2], pa.int64()), "n": pa.array(np.r_[df[held], documents, total], pa.int64())})

    return task


def boundaries(scores: np.ndarray, texts: np.ndarray, starts: np.ndarray, longest: int = LONGEST, price: float = PRICE) -> np.ndarray:
    """Whether each posting ends a block; list l is ``scores[starts[l]:starts[l + 1]]``, of ascending ``texts``.

    Of all ways to cut a list into blocks of at most ``longest`` postings, one of least cost: the sum over blocks of
    their maximum times the texts from their first to their last, and ``price`` mean scores a block. All lists take a step together, as far as they go, LISTS
    at a time: a step looks back over the ``longest`` lengths that its last block can have.
    """
    ends = np.zeros(len(scores), bool)
    lengths = np.diff(starts)
    means = np.bincount(np.repeat(np.arange(len(lengths)), lengths), scores, len(lengths)) / np.maximum(lengths, 1)
    for at in range(0, len(lengths), LISTS):
        some = np.arange(at, min(at + LISTS, len(lengths)))
        some = some[np.argsort(-lengths[some], kind="stable")]
        some = some[lengths[some] > 0]
        if not len(some):
            continue
        first, size = starts[some], lengths[some]
        most = int(size[0])
        toll = price * means[some]
        peak = np.zeros((len(some), longest))
        cost = np.full((len(some), longest), np.inf)
        cost[:, 0] = 0.0
        choice = np.zeros(int(size.sum()), np.uint8 if longest <= 255 else np.int32)
        place = np.cumsum(size) - size
        begin = np.zeros((len(some), longest), np.int64)
        active = np.searchsorted(-size, -np.arange(1, most + 1), "right")
        for i in range(most):
            a = int(active[i])
            p, c, b = peak[:a], cost[:a], begin[:a]
            p[:, 1:] = p[:, :-1].copy()
            np.maximum(p, scores[first[:a] + i][:, None], out=p)
            b[:, 1:] = b[:, :-1].copy()
            b[:, 0] = texts[first[:a] + i]
            p[:, 0] = scores[first[:a] + i]
            whole = c + p * (b[:, :1] + 1 - b)
            best = whole.argmin(axis=1)
            choice[place[:a] + i] = best
            c[:, 1:] = c[:, :-1].copy()
            c[:, 0] = whole[np.arange(a), best] + toll[:a]
        left = size.copy()
        while (open_ := np.flatnonzero(left > 0)).size:
            last = left[open_] - 1
            ends[first[open_] + last] = True
            left[open_] = last - choice[place[open_] + last]
    return ends


class Shard:
    """The postings of a piece of the corpus: by term, texts in order, each with the exact score of one occurrence in an item.

    Texts are put in the order of their commonest known term, then of their length: neighbours hold the same terms and
    score alike, so few blocks bound them well. ``order`` has the text at each place.
    """

    def __init__(self, column: pa.Array, items: Items, weights: np.ndarray, documents: int, total: int):
        n, term, text, tf = _pairs(column, items.vocabulary)
        self.size = len(column)
        by_count = np.lexsort((tf, text))
        last = by_count[np.flatnonzero(np.diff(text[by_count], append=-1))]
        commonest = np.full(self.size, -1)
        commonest[text[last]] = term[last]
        self.order = np.lexsort((n, commonest))
        place = np.empty(self.size, np.int64)
        place[self.order] = np.arange(self.size)
        if len(n) and 25 * int(n.max()) * documents > (1 << 63) - 1:
            m = np.array([75 + 25 * int(x) * documents // total for x in n], np.int64)
        else:
            m = 75 + (25 * n * documents) // max(1, total)
        scores = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[text]))
        by_place = np.lexsort((place[text], term))
        self.texts, self.scores = place[text][by_place], scores[by_place]
        self.starts = np.searchsorted(term, np.arange(len(items.vocabulary) + 1))
        last = np.flatnonzero(boundaries(self.scores.astype(np.float64), self.texts, self.starts))
        first = np.r_[0, last[:-1] + 1] if len(last) else last
        self.low, self.high = self.texts[first], self.texts[last] + 1
        self.peak = np.maximum.reduceat(self.scores, first) if len(last) else self.scores
        self.blocks = np.searchsorted(last, self.starts - 1, "right")
        self.scored = 0

    def bounds(self, wanted: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Of each text, the sum of the maxima of the blocks that it could stand in."""
        change = np.zeros(self.size + 1, np.int64)
        for t, times in zip(*wanted, strict=True):
            b = slice(self.blocks[t], self.blocks[t + 1])
            change[self.low[b]] += times * self.peak[b]
            change[self.high[b]] -= times * self.peak[b]
        return np.cumsum(change[:-1])

    def score(self, wanted: tuple[np.ndarray, np.ndarray], texts: np.ndarray) -> np.ndarray:
        self.scored += len(texts)
        out = np.zeros(len(texts), np.int64)
        for t, times in zip(*wanted, strict=True):
            here = slice(self.starts[t], self.starts[t + 1])
            listed = self.texts[here]
            if len(listed):
                at = np.minimum(np.searchsorted(listed, texts), len(listed) - 1)
                out += np.where(listed[at] == texts, times * self.scores[here][at], 0)
        return out


class Best:
    """An item's best documents so far: scores and ids, highest first, then by ascending id, null last."""

    def __init__(self, top: int):
        self.top, self.scores, self.ids, self.null = top, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self) -> int:
        """What a document must score to be looked at: it may tie with the last, and win by its id."""
        return max(1, int(self.scores[-1])) if len(self.scores) == self.top else 1

    def put(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        s, i, n = np.r_[self.scores, scores], np.r_[self.ids, ids], np.r_[self.null, null]
        order = np.lexsort((i, n, -s))[: self.top]
        self.scores, self.ids, self.null = s[order], i[order], n[order]


def look(shard: Shard, wanted: tuple[np.ndarray, np.ndarray], best: Best, ids: np.ndarray, null: np.ndarray) -> None:
    """Brings ``best`` up to date with a shard: texts in the order of their bounds, until these fall below what counts."""
    bound = shard.bounds(wanted)
    left = np.flatnonzero(bound >= best.least())
    many = FIRST_LOOK
    while len(left):
        if len(left) > many:
            cut = np.argpartition(-bound[left], many)
            now, left = left[cut[:many]], left[cut[many:]]
        else:
            now, left = left, left[:0]
        now = np.sort(now)
        scores = shard.score(wanted, now)
        good = scores >= best.least()
        texts = shard.order[now[good]]
        best.put(scores[good], ids[texts], null[texts])
        left = left[bound[left] >= best.least()]
        many *= 4


def _search(items: Items, weights: np.ndarray, documents: int, total: int, top: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in items.ids]
        for part in slices(batches, SLICE):
            key = part.column("doc_id")
            null = key.is_null().to_numpy(zero_copy_only=False)
            ids = pc.fill_null(key, 0).to_numpy(zero_copy_only=False).astype(np.int64)
            shard = Shard(part.column("text"), items, weights, documents, total)
            for wanted, found in zip(items.wanted, best, strict=True):
                look(shard, wanted, found, ids, null)
        for q, found in enumerate(best):
            if len(found.scores):
                yield pa.RecordBatch.from_pydict({"q": pa.array([q] * len(found.scores), pa.int32()), "doc_id": pa.array(found.ids, pa.int64(), mask=found.null), "score": pa.array(found.scores)})

    return task


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _one_pass(docs: DataFrame, items: Items, top: int) -> DataFrame:
    spark = docs.sparkSession
    counted = docs.select("text").mapInArrow(_counts(items.vocabulary), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    n = {r["term"]: r["n"] for r in counted.collect()}  # as many rows as the items have terms, and two
    documents, total = n.get(-1, 0), n.get(-2, 0)
    weights = np.array([weight(documents, n.get(t, 0)) for t in range(len(items.vocabulary))], np.int64)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_search(items, weights, documents, total, top), "q int, doc_id long, score long")
    # A task gives `top` rows an item, so there may be many of an item: first the best of each salt, then of these.
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy("q", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= top)
    names = spark.createDataFrame(list(enumerate(items.ids)), "q int, item_id long")
    return ranked.join(names, "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of ``docs`` for each row of ``items`` (item_id, text), or all that score above 0.

    Null and empty texts have no terms: such documents count nowhere, such items find nothing. Each row counts for itself:
    repeated ids, equal rows and rows of null id take ranks of their own; among equal scores ids ascend, nulls last.
    Either table may be empty; the result then is. Texts of any length are read whole; other columns are not read.
    """
    found = [_one_pass(docs, group, top) for group in passes(items)]
    empty = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found) if found else empty


def _sql() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    cut = f"unnest(regexp_extract_all(translate(\"text\", '{upper}', '{upper.lower()}'), '{TERM}'))"
    return f"""
WITH said AS (SELECT r, doc_id, {cut} AS t FROM (SELECT row_number() OVER () AS r, doc_id, "text" FROM documents)),
lengths AS (SELECT r, count(*) AS n FROM said GROUP BY r),
sums AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
tfs AS (SELECT r, doc_id, t, count(*) AS tf FROM said GROUP BY r, doc_id, t),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tfs CROSS JOIN sums GROUP BY t, docs),
asked AS (SELECT q, item_id, t, count(*) AS times FROM (SELECT q, item_id, {cut} AS t FROM (SELECT row_number() OVER () AS q, item_id, "text" FROM benchmark)) GROUP BY q, item_id, t),
lifts AS (SELECT r, 75 + (25 * n * docs) // terms AS m FROM lengths CROSS JOIN sums),
scored AS (
  SELECT q, item_id, tfs.r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN tfs USING (t) JOIN weights USING (t) JOIN lifts ON lifts.r = tfs.r GROUP BY q, item_id, tfs.r, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""


ORACLE = _sql()
