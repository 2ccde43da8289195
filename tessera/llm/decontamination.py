"""Benchmark decontamination: CGK embeddings of item-sized windows, bit-sampling LSH, exact edit verification.

All items are one index, whatever their number (blocks of WORDS words, for one scan of the corpus each), which is built
on the driver and broadcast. Windows are embedded only where an item can begin: an item of n words with at most k edits,
cut into k + 1 pieces, keeps a piece as it is, so windows around places where no piece of an item of their length stands
hold no leak. This bound is exact. How many coordinates a hash takes follows from an item's length: edits put the walks
out of step more often in long items, so it is measured on made-up items with as many edits as they may have.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import mix, slices
from tessera.llm.toxicity import tokens

EDITS = 0.2
TABLES = 24
BITS = 4
RECALL = 0.97
TRIALS = 64
STEPS = 16 << 20
SEED = 7919
WORDS = 16 << 20
SLICE = 8 << 20
SIEVE = 1 << 22


class Index:
    """The items of a block: words as numbers from 1, the walks' coins, the pieces' hashes, and the LSH tables by length and repetition."""

    def __init__(self, items: list[tuple[int, str | None]]):
        split = [(i, w) for i, text in items if (w := tokens(text))]
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        self.items = [(i, np.array([number(w, len(self.vocabulary) + 1) for w in words], np.int32)) for i, words in split]
        self.by_size: dict[int, list[int]] = {}
        for n, (_, words) in enumerate(self.items):
            self.by_size.setdefault(len(words), []).append(n)
        longest = max(self.by_size, default=0)
        rng = np.random.default_rng(SEED)
        #: A walk's coin for (step, table, word) is the top bit of the word's hash times an odd number of (step, table).
        self.hashes = mix(np.arange(len(self.vocabulary) + 1, dtype=np.uint64) + np.uint64(SEED))
        self.odd = rng.integers(0, 1 << 63, (2 * longest, TABLES), np.uint64) * np.uint64(2) + np.uint64(1)
        #: picks[table]: which share of a walk's steps are sampled.
        self.picks = np.sort(rng.random((TABLES, BITS)), axis=1)
        self.pieces = self._pieces()
        self.bits = np.zeros(longest + 1, np.int64)
        for top in sorted({rung(size) for size in self.by_size}):
            some = [size for size in self.by_size if rung(size) == top]
            self.bits[some] = self._bits(min(top, longest))
        hashed = np.zeros((len(self.items), TABLES), np.uint64)
        for size, members in self.by_size.items():
            for at in range(0, len(members), rows_of(size)):
                some = members[at : at + rows_of(size)]
                hashed[some] = self.sampled(np.stack([self.items[n][1] for n in some]), np.full(len(some), size))
        order = np.argsort(hashed, axis=0, kind="stable")
        self.tables = [(hashed[order[:, t], t], order[:, t].astype(np.int32)) for t in range(TABLES)]

    def _pieces(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Words of a piece to (its hash, sorted, the item's length, the piece's place in the item), each triple once, and a sieve of the hashes."""
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for size, members in self.by_size.items():
            k = budget(size)
            width = size // (k + 1)
            words = np.stack([self.items[n][1] for n in members])
            for place in range(0, width * (k + 1), width):
                keys = np.unique(run_hashes(self.hashes[words[:, place : place + width]], width)[:, 0])
                found.setdefault(width, []).append((keys, np.full(len(keys), size, np.int32), np.full(len(keys), place, np.int32)))
        out = {}
        for width, parts in found.items():
            keys, sizes, places = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(keys, kind="stable")
            sieve = np.zeros(SIEVE, bool)
            sieve[(keys % np.uint64(SIEVE)).astype(np.int64)] = True
            out[width] = keys[order], sizes[order], places[order], sieve
        return out

    def _bits(self, size: int) -> int:
        """The most coordinates a hash may have so that items of ``size`` words with all the edits they may have are found.

        It is measured: of made-up items and their edited forms, RECALL must share a hash. No coordinate at all (0) means
        that every window around a piece is verified by its edits, which is exact.
        """
        rng = np.random.default_rng([SEED, size])
        n, k = max(16, min(TRIALS, STEPS // (4 * size * TABLES))), budget(size)
        hashes = mix(np.arange(2 * size + 2, dtype=np.uint64) + np.uint64(SEED ^ size))
        items, forms, lengths = rng.integers(1, 2 * size + 2, (n, size)), np.zeros((n, 2 * size), np.int64), np.zeros(n, np.int64)
        for i, item in enumerate(items):
            form = item.tolist()
            for _ in range(k):
                at, kind = int(rng.integers(0, len(form))), int(rng.integers(0, 3))
                form[at : at + (kind != 1)] = [] if kind == 0 and len(form) > 1 else [int(rng.integers(1, 2 * size + 2))]
            form += rng.integers(1, 2 * size + 2, max(0, size - len(form))).tolist()  # a window goes on past a shorter form
            forms[i, : len(form)], lengths[i] = form, size
        both = np.full(n, size)
        for bits in range(BITS, 0, -1):
            match = self.sampled(items, both, np.full(size + 1, bits), hashes) == self.sampled(forms[:, :size], lengths, np.full(size + 1, bits), hashes)
            if match.any(axis=1).mean() >= RECALL:
                return bits
        return 0

    def sampled(self, rows: np.ndarray, sizes: np.ndarray, bits: np.ndarray | None = None, hashes: np.ndarray | None = None) -> np.ndarray:
        """For each row of words (``sizes`` of which count) and each table, a hash of its size's coordinates of its CGK embedding.

        The walk reads a word at each of 2 * size steps, and moves on if the coin of (step, word) says so; two rows that
        share a subsequence fall in step again soon after an edit. Past its end a row reads 0.
        """
        n, width = rows.shape
        padded = np.where(np.arange(width + 1)[None, :] < sizes[:, None], np.hstack([rows, np.zeros((n, 1), rows.dtype)]), 0).astype(np.int32)
        steps = 2 * int(sizes.max())
        base, flat = (np.arange(n, dtype=np.int32) * (width + 1))[:, None], padded.ravel()
        at, last = np.zeros((n, TABLES), np.int32), sizes[:, None].astype(np.int32)
        read = np.empty((steps, n, TABLES), np.int32)
        flips = (self.hashes if hashes is None else hashes)[flat]
        for step in range(steps):
            here = base + at
            read[step] = flat[here]
            coin = flips[here]
            coin *= self.odd[step]
            coin >>= np.uint64(63)
            at += coin.astype(np.int32)
            np.minimum(at, last, out=at)
        out = np.repeat(mix(sizes.astype(np.uint64))[:, None], TABLES, axis=1)
        rows_, tables = np.arange(n)[:, None], np.arange(TABLES)[None, :]
        used = (self.bits if bits is None else bits)[sizes]
        for pick in range(int(used.max(initial=0))):
            step = (self.picks[:, pick][None, :] * 2 * sizes[:, None]).astype(np.int64)
            more = mix(out ^ (read[step, rows_, tables].astype(np.uint64) + np.uint64(pick << 40)))
            out = np.where((used > pick)[:, None], more, out)
        return out

    def windows(self, ids: np.ndarray, firsts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, length) of the windows that can hold an item: those around a piece, as far as the budget can move it."""
        places, sizes = [], []
        for width, (keys, lengths, offsets, sieve) in self.pieces.items():
            if len(ids) < width:
                continue
            run = run_hashes(self.hashes[ids][None, :], width)[0]
            might = np.flatnonzero(sieve[(run % np.uint64(SIEVE)).astype(np.int64)])
            might = might[might + width <= ends[might]]
            low, high = np.searchsorted(keys, run[might], "left"), np.searchsorted(keys, run[might], "right")
            n = high - low
            which = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            begin, size = np.repeat(might, n) - offsets[which], lengths[which]
            owner = np.repeat(might, n)
            places.append(begin)
            sizes.append(np.stack([size, owner], 1) if len(size) else np.zeros((0, 2), np.int64))
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        begin, both = np.concatenate(places), np.concatenate(sizes)
        size, owner = both[:, 0].astype(np.int64), both[:, 1].astype(np.int64)
        if not len(begin):
            return begin.astype(np.int64), size
        # Beginnings near one another, for items of one length and in one document, share their windows.
        top = int(size.max()) + 1
        key = np.unique((np.maximum(begin, firsts[owner])) * top + size)
        begin, size = key // top, key % top
        k = (EDITS * size).astype(np.int64)
        number = np.repeat(begin - k, 2 * k + 1) + np.arange((2 * k + 1).sum()) - np.repeat(np.cumsum(2 * k + 1) - (2 * k + 1), 2 * k + 1)
        size, low, high = np.repeat(size, 2 * k + 1), np.repeat(firsts[begin], 2 * k + 1), np.repeat(ends[begin], 2 * k + 1)
        inside = (number >= low) & (number < high)
        key = np.unique(number[inside] * top + size[inside])
        return key // top, key % top


def run_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the ``width`` words from each place of each row of word hashes."""
    out = words[:, : words.shape[1] - width + 1].copy()
    for i in range(1, width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[:, i : words.shape[1] - width + 1 + i])
    return out


def rung(size: int) -> int:
    """Lengths that share their number of coordinates: up to the next of a row of lengths, each a quarter longer than the last."""
    top = 8
    while top < size:
        top += max(1, top // 4)
    return top


def rows_of(size: int) -> int:
    """Rows of ``size`` words that are walked at once: their steps and tables are bounded."""
    return max(1, STEPS // (2 * size * TABLES))


def budget(size: int) -> int:
    """Edits that an item of ``size`` words may have."""
    return int(EDITS * size)


def edits(item: np.ndarray, window: np.ndarray, most: int) -> tuple[int, int] | None:
    """(distance, end) of the stretch of ``window`` nearest to ``item`` by word edits, if within ``most``."""
    if not len(window):
        return (len(item), 0) if len(item) <= most else None
    row, steps = np.zeros(len(window) + 1, np.int64), np.arange(len(window) + 1)
    for i, word in enumerate(item):
        new = np.empty_like(row)
        new[0] = i + 1
        np.minimum(row[1:] + 1, row[:-1] + (window != word), out=new[1:])
        row = np.minimum.accumulate(new - steps) + steps
        if row.min() > most:
            return None
    end = int(row.argmin())
    return (int(row[end]), end) if row[end] <= most else None


def leaks_of(ids: np.ndarray, doc: np.ndarray, index: Index) -> dict[int, dict[int, tuple[tuple[int, int], int]]]:
    """Row to (item to (distance, first word in ``ids``), places) for the documents that ``doc`` numbers.

    Windows away from any piece of an item of their length hold no leak and are passed over; all others are embedded.
    """
    found: dict[int, dict[int, tuple[tuple[int, int], int]]] = {}
    if not len(ids) or not index.items:
        return found
    counts = np.bincount(doc)
    ends, firsts = np.repeat(np.cumsum(counts), counts), np.repeat(np.cumsum(counts) - counts, counts)
    place, size = index.windows(ids, firsts, ends)
    seen: set[tuple[int, int]] = set()
    order = np.lexsort((place, size))
    place, size = place[order], size[order]
    i = 0
    while i < len(place):
        n = rows_of(int(size[i]))
        n = rows_of(int(size[min(i + n, len(size)) - 1]))  # sizes ascend: no row of these is longer
        at, width = place[i : i + n], size[i : i + n]
        i += n
        wide = at[:, None] + np.arange(int(width.max()))[None, :]
        rows = np.where(wide < ends[at][:, None], ids[np.minimum(wide, len(ids) - 1)], 0)
        hashes = index.sampled(rows, width)
        pairs: set[tuple[int, int]] = set()
        for r, (keys, order) in enumerate(index.tables):
            low, high = np.searchsorted(keys, hashes[:, r], "left"), np.searchsorted(keys, hashes[:, r], "right")
            for j in np.flatnonzero(high > low):
                pairs.update((int(at[j]), n) for n in order[low[j] : high[j]].tolist())
        for start, n in sorted(pairs):
            item = index.items[n][1]
            length, k = len(item), budget(len(item))
            low, high = int(firsts[start]), int(ends[start])
            if (start, n) in seen or edits(item, ids[max(start - k, low) : min(start + length + k, high)], k) is None:
                continue
            # The nearest stretch around; a window that begins before it found it with more edits.
            low = max(start - length, low)
            distance, end = edits(item, ids[low : min(start + 2 * length, high)], k)
            seen.update((s, n) for s in range(start, low + end))  # the same place
            here = found.setdefault(int(doc[start]), {})
            new = (distance, max(low, low + end - length))
            best, places = here.get(n, (new, 0))
            here[n] = min(best, new), places + 1
    return found


def numbered(texts: list[str | None], index: Index) -> tuple[np.ndarray, np.ndarray]:
    """The texts' words as numbers (0: in no item), and the row of each."""
    get, ids, counts = index.vocabulary.get, [], []
    for text in texts:
        words = tokens(text)
        ids += [get(w, 0) for w in words]
        counts.append(len(words))
    return np.array(ids, np.int32), np.repeat(np.arange(len(texts)), counts)


def indexes(benchmark: DataFrame, most: int = WORDS) -> Iterator[Index]:
    """Indexes of the items, each of ``most`` words (some 100,000 items) or one item at least: a bounded part passes through the driver."""
    block: list[tuple[int, str | None]] = []
    held = 0
    for r in benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        block.append((r["item_id"], r["text"]))
        held += r["text"].count(" ") + 1
        if held >= most:
            yield Index(block)
            block, held = [], 0
    if block:
        yield Index(block)


OUT = "doc_id long, item_id long, distance int, first_word int, places int"
Scan = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def found(docs: DataFrame, benchmark: DataFrame, most: int = WORDS) -> DataFrame:
    """doc_id, item_id, distance (word edits), first_word and places for each item that a row of ``docs`` contains.

    A document contains an item if a stretch of it is within budget(item's words) word edits, case and punctuation
    aside. Items without words match nothing, as do null and empty texts; repeated rows are each reported; items with
    the same id are matched apart. No items, or no documents, give no rows. ``docs`` is read once for each ``most``
    words of items.
    """
    context = docs.sparkSession.sparkContext

    def scanner(index: Index) -> Scan:
        shared = context.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in slices(batches, SLICE):
                ids, doc = numbered(b.column("text").to_pylist(), index)
                first = np.searchsorted(doc, np.arange(b.num_rows))
                rows = [(d, index.items[n][0], near[0], near[1] - int(first[d]), places) for d, here in leaks_of(ids, doc, index).items() for n, (near, places) in here.items()]
                if rows:
                    d, item, distance, word, places = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc_id").take(pa.array(d)), pa.array(item, pa.int64()), pa.array(distance, pa.int32()), pa.array(word, pa.int32()), pa.array(places, pa.int32())],
                        names=["doc_id", "item_id", "distance", "first_word", "places"],
                    )

        return run

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = docs.sparkSession.createDataFrame([], OUT)
    for i, index in enumerate(indexes(benchmark, most)):
        part = slim.mapInArrow(scanner(index), OUT)
        out = part if i == 0 else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, most: int = WORDS) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns; no text is shuffled, and ``docs`` is read once."""
    context = docs.sparkSession.sparkContext

    def scanner(index: Index) -> Scan:
        shared = context.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in slices(batches, SLICE):
                hit = np.zeros(b.num_rows, bool)
                hit[list(leaks_of(*numbered(b.column("text").to_pylist(), index), index))] = True
                yield b.filter(pa.array(~hit))

        return run

    for index in indexes(benchmark, most):
        docs = docs.mapInArrow(scanner(index), docs.schema)
    return docs
