"""Exact substring dedup by bucket-pointer refinement over sampled suffixes.

Every string of LENGTH bytes contains the position whose GRAM-byte string has the least hash of all in it (the leftmost
of several), so equal strings have equal anchors at equal offsets. Consecutive strings share an anchor: a run of them is
one row, about one for 39 bytes.

1. Initial buckets: runs are bucketed by their anchor's gram, and in a bucket by the whole run. Of equal runs all but
   the earliest are repeats; each task settles its own before anything is shuffled.
2. Buckets that hold different runs are refined: their texts, split by what lies left or right of the anchor, meet in
   one task, which numbers all strings of 8 bytes and then, doubling, sorts unsettled strings by the bucket numbers at
   their start and at a later offset, until strings of LENGTH bytes are told apart. Numbers of shorter strings are reused
   at each step, and a string alone in its bucket is settled.
   Buckets of more than MOST_TOGETHER runs are first refined into narrower ones, of strings whose anchor stands in half
   as many places and which so share a longer stretch, again and again; in the last, all strings are equal.
3. The starts found are put together by document, and the bytes they cover are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import mix, slices, text_buffer, written
from tessera.operators.cluster import in_order

LENGTH = 100
GRAM = 24
SPAN = LENGTH - GRAM + 1  # anchors a string can have
HALF = SPAN // 2
SLICE = 1 << 17
CHUNK_BITS = 1 << 16
CHUNK = 2 << 20
MOST_TOGETHER = 50_000
WIDTHS = 16, 8, 4, 2, 1
NO_DOC = -(1 << 63)

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_POWER = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_LOW = np.uint64((1 << 23) - 1)


def grams8(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as a number; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint64)
    padded[: len(data)] = data
    two = padded[:-1] | (padded[1:] << np.uint64(8))
    four = two[:-2] | (two[2:] << np.uint64(16))
    return (four[:-4] | (four[4:] << np.uint64(32)))[: len(data)]


def least_positions(gram: np.ndarray) -> np.ndarray:
    """The position of the least hash (leftmost of equal ones) in each window of SPAN.

    Hash and position share a number, the position in its low bits: they are taken from pieces that these bits can
    count, overlapping by a window less one, so that a text may be of any length.
    """
    most = int(_LOW) + 1
    out = np.zeros(len(gram) - SPAN + 1, np.uint64)
    for at in range(0, len(out), most - SPAN + 1):
        low = gram[at : at + most] & ~_LOW
        low |= np.arange(len(low), dtype=np.uint64)
        n, width = len(low) - SPAN + 1, 1
        while 2 * width <= SPAN:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[:n], low[SPAN - width : SPAN - width + n])
        out[at : at + n] = (low & _LOW) + np.uint64(at)
    return out


class _Powers:
    """Powers of the stretch hash's base and of its inverse, kept for the longest slice so far."""

    up = down = np.zeros(0, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = (np.cumprod(np.full(n, x, np.uint64)) for x in (_POWER, _INVERSE))
        return cls.up, cls.down


class Runs:
    """The runs of a slice: ``anchor``, ``first`` and ``last`` (starts of strings, in the slice), ``row``, ``gram`` and ``whole`` (hashes)."""

    def __init__(self, texts: pa.Array):
        self.starts, self.data = text_buffer(texts)
        n = len(self.data)
        self.anchor = self.first = self.last = self.row = np.zeros(0, np.int64)
        self.gram = self.whole = np.zeros(0, np.uint64)
        if n < LENGTH:
            return
        eight = grams8(self.data)
        gram = eight[: n - GRAM + 1] * _C[0]
        gram += eight[8 : n - GRAM + 9] * _C[1]
        gram += eight[16 : n - GRAM + 17] * _C[2]
        gram = mix(gram)
        low = least_positions(gram)
        # Strings that cross into the next text are none: runs are cut where a text starts and after its last string.
        step = np.ones(len(low), bool)
        np.not_equal(low[1:], low[:-1], out=step[1:])
        edges = np.concatenate([self.starts, self.starts[1:] - LENGTH + 1])
        step[edges[(edges >= 0) & (edges < len(step))]] = True
        first = np.flatnonzero(step)
        last = np.append(first[1:], len(low)) - 1
        row = np.searchsorted(self.starts, first, "right") - 1
        keep = first + LENGTH <= self.starts[row + 1]
        self.first, self.last, self.row = first[keep], last[keep], row[keep]
        self.anchor = low[self.first].astype(np.int64)
        self.gram = gram[self.anchor]
        # Sums of mixed 8-byte strings times powers: the hash of any stretch is a difference.
        up, self._down = _Powers.of(n)
        eight *= _C[2]
        eight ^= eight >> np.uint64(32)
        eight *= _C[0]
        eight *= up[:n]
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(eight, out=self._sums[1:])
        self.whole = self.stretch(self.first, self.last + LENGTH)

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from ``start`` to ``end``, 8 at least."""
        return mix((self._sums[end - 7] - self._sums[start]) * self._down[start] + (end - start).astype(np.uint64) * _C[0])


def _tags(batch: pa.RecordBatch, starts: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, 16 bits of its text's hash) of each row: rows of one doc_id with different texts stay apart."""
    docs = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
    checks = np.array([int.from_bytes(hashlib.blake2b(data[a:b], digest_size=2).digest(), "little") for a, b in zip(starts[:-1], starts[1:], strict=True)], np.int64)
    return docs, checks


def _packed(start: np.ndarray, check: np.ndarray, more: np.ndarray | int = 0, less: np.ndarray | int = 0) -> np.ndarray:
    """Position, 16 bits of the text's hash, and two offsets of 7 bits, in one number that sorts by position."""
    return (start << 30) | (check << 14) | (np.asarray(more, np.int64) << 7) | less


ROW = "kind int, gram long, whole long, doc long, place long, size long"


def _rows(kind: int, gram: np.ndarray, whole: np.ndarray, doc: np.ndarray, place: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), kind, np.int32)), pa.array(gram.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(doc), pa.array(place), pa.array(size)], names=["kind", "gram", "whole", "doc", "place", "size"])


def _merged(doc: np.ndarray, check: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, packed first, number) of the stretches of starts, neighbours put together."""
    order = np.lexsort((first, check, doc))
    doc, check, first, last = doc[order], check[order], first[order], last[order]
    if not len(doc):
        return doc, first, first
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (check[1:] != check[:-1]) | (first[1:] > last[:-1] + 1)  # a document's stretches are disjoint or equal
    heads = np.flatnonzero(new)
    ends = np.maximum.reduceat(last, heads)
    return doc[heads], _packed(first[heads], check[heads]), ends - first[heads] + 1


def runs_of(docs: DataFrame) -> DataFrame:
    """Kind 0: the earliest of equal runs of a task. Kind 1: stretches of starts that are repeats within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        held = 0

        def settle() -> Iterator[pa.RecordBatch]:
            gram, whole, doc, place, check, first, last = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            key = mix(gram + whole * _C[0])
            order = np.argsort(key)
            edge = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
            size = np.diff(np.append(edge, len(order)))
            several = order[np.repeat(size > 1, size)]
            several = several[np.lexsort((place[several], doc[several], whole[several], gram[several]))]
            g, w, d, p = gram[several], whole[several], doc[several], place[several]
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (w[1:] != w[:-1])
            head = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
            i = several[(d != d[head]) | (p != p[head])] if len(g) else several
            k = np.concatenate([order[edge[size == 1]], several[new[: len(g)]]])
            yield _rows(0, gram[k], whole[k], doc[k], place[k], np.zeros(len(k), np.int64))
            doc, place, size = _merged(doc[i], check[i], first[i], last[i])
            spread = mix(doc.view(np.uint64) ^ (place.view(np.uint64) * _C[0]))
            yield _rows(1, spread, spread, doc, place, size)

        for b in slices(batches, SLICE):
            found = Runs(b.column("text"))
            if not len(found.first):
                continue
            docs_, checks = _tags(b, found.starts, found.data)
            base, check = found.starts[found.row], checks[found.row]
            place = _packed(found.anchor - base, check, found.anchor - found.first, found.anchor - found.last)
            parts.append((found.gram, found.whole, docs_[found.row], place, check, found.first - base, found.last - base))
            held += len(place)
            if held > 400_000:
                yield from settle()
                held = 0
        if parts:
            yield from settle()

    return docs.mapInArrow(run, ROW)


def bucketed(rows: DataFrame) -> DataFrame:
    """Kind 1: stretches of starts that are repeats. Kind 2: the earliest of equal runs, in buckets of different ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come by gram, whole run, document and place; a row is known a repeat by the first of its run, and a
        # bucket by the next run in it, so that two rows are all that is remembered.
        head: tuple[int, int, int, int] | None = None
        told = True  # whether the remembered head has been given out
        for b in batches:
            if not b.num_rows:
                continue
            kind, g, w, d, p, size = (b.column(c).to_numpy() for c in ("kind", "gram", "whole", "doc", "place", "size"))
            direct = kind == 1
            if direct.any():
                yield b.filter(pa.array(direct))
                g, w, d, p = g[~direct], w[~direct], d[~direct], p[~direct]
                if not len(g):
                    continue
            if head is not None:
                g, w, d, p = (np.concatenate([[x], y]) for x, y in zip(head, (g, w, d, p), strict=True))
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (w[1:] != w[:-1])
            heads = np.flatnonzero(new)
            mine = heads[np.cumsum(new) - 1]
            later = np.flatnonzero((d != d[mine]) | (p != p[mine]))
            anchor, check, more, less = p[later] >> 30, (p[later] >> 14) & 0xFFFF, (p[later] >> 7) & 127, p[later] & 127
            doc, place, sizes = _merged(d[later], check, anchor - more, anchor - less)
            if len(doc):
                yield _rows(1, np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64), doc, place, sizes)
            same = g[heads][1:] == g[heads][:-1]
            shared = np.zeros(len(heads), bool)
            shared[1:] |= same
            shared[:-1] |= same
            if head is not None and told:
                shared_now = shared.copy()
                shared_now[0] = False
            else:
                shared_now = shared
            give = heads[shared_now]
            if len(give):
                yield _rows(2, g[give], w[give], d[give], p[give], np.zeros(len(give), np.int64))
            was = head is not None and len(heads) == 1 and told
            head = tuple(int(x[heads[-1]]) for x in (g, w, d, p))
            told = bool(shared[-1]) or was
    order = ("gram", "whole", "doc", "place")
    return rows.repartition("gram").sortWithinPartitions(*order).mapInArrow(run, ROW)


def _mark(n_marks: int, gram: np.ndarray, whole: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mix(gram.view(np.uint64) + mix(whole.view(np.uint64) + mix(doc.view(np.uint64) + place.view(np.uint64)))) & np.uint64(n_marks - 1)


CONTEXT = "bucket long, doc long, place long, ahead int, text binary"


def contexts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The texts of the chosen runs (CONTEXT: place of the first byte, and how far ahead the anchor is): strings left and right of the middle apart."""

    n_marks = 1 << min(29, max(20, int(32 * max(1, chosen.count())).bit_length()))
    words = CHUNK_BITS // 64

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(_mark(n_marks, *(b.column(c).to_numpy() for c in ("gram", "whole", "doc", "place")))).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"chunk": (at // CHUNK_BITS).astype(np.int32), "bit": (at % CHUNK_BITS).astype(np.int32)})

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, np.ndarray] = {}
        for b in batches:
            chunk, bit = b.column("chunk").to_numpy(), b.column("bit").to_numpy()
            for c in np.unique(chunk).tolist():
                own = bit[chunk == c].astype(np.uint64)
                np.bitwise_or.at(chunks.setdefault(c, np.zeros(words, np.uint64)), (own >> np.uint64(6)).astype(np.int64), np.uint64(1) << (own & np.uint64(63)))
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(chunks), pa.int32()), "words": pa.array([x.tobytes() for x in chunks.values()], pa.binary())})

    # A bitmap of bounded size tells which runs' texts are wanted; a run that it lets through by chance does no harm.
    bitmap = np.zeros(n_marks // 64, np.uint64)
    for r in chosen.mapInArrow(bits, "chunk int, bit int").repartition("chunk").mapInArrow(gather, "chunk int, words binary").toLocalIterator():
        bitmap[r["chunk"] * words : (r["chunk"] + 1) * words] = np.frombuffer(r["words"], np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = shared.value
        for b in slices(batches, SLICE):
            r = Runs(b.column("text"))
            if not len(r.first):
                continue
            docs_, checks = _tags(b, r.starts, r.data)
            base, check = r.starts[r.row], checks[r.row]
            mark = _mark(n_marks, r.gram, r.whole, docs_[r.row], _packed(r.anchor - base, check, r.anchor - r.first, r.anchor - r.last))
            wanted = (marked[(mark >> np.uint64(6)).astype(np.int64)] >> (mark & np.uint64(63))) & np.uint64(1) == 1
            for left in (True, False):
                low = np.where(left, np.maximum(r.anchor - r.last, HALF), r.anchor - r.last)
                high = np.where(left, r.anchor - r.first, np.minimum(r.anchor - r.first, HALF - 1))
                i = np.flatnonzero(wanted & (low <= high))
                if not len(i):
                    continue
                a = r.anchor[i]
                shared_text = r.stretch(a - HALF, a + GRAM) if left else r.stretch(a, a - HALF + 1 + LENGTH)
                first, end = a - high[i], a - low[i] + LENGTH
                texts = [r.data[x:y].tobytes() for x, y in zip(first.tolist(), end.tolist(), strict=True)]
                bucket = mix(shared_text ^ _C[int(left)]).view(np.int64)
                columns = [pa.array(bucket), pa.array(docs_[r.row[i]]), pa.array(_packed(first - base[i], check[i])), pa.array(high[i].astype(np.int32)), pa.array(texts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "doc", "place", "ahead", "text"])

    return docs.mapInArrow(run, CONTEXT)


def refine(data: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Numbers for the strings of LENGTH bytes at ``wanted``: equal for equal strings, -1 for a string that is alone."""
    pointer = pd.factorize(grams8(data))[0].astype(np.int64)
    depth, alive = 8, wanted
    while depth < LENGTH and len(alive):
        step = min(depth, LENGTH - depth)
        if step == depth:  # all positions get the longer strings' numbers: later steps point to them
            key = pointer[:-step] * (int(pointer.max()) + 1) + pointer[step:]
            longer = np.full(len(pointer), -1, np.int64)
            longer[: len(key)] = pd.factorize(key)[0]
            longer[len(key) :] = int(longer.max(initial=0)) + 1 + np.arange(len(pointer) - len(key))
            pointer = longer
            own = pointer[alive]
        else:
            own = pd.factorize(pointer[alive] * (int(pointer.max()) + 1) + pointer[alive + step])[0]
        alive = alive[np.bincount(own)[own] > 1] if step == depth else alive
        depth += step
    out = np.full(len(data), -1, np.int64)
    if len(alive):
        out[alive] = own
    return out[wanted]


def refined(texts: DataFrame) -> DataFrame:
    """doc, place and size of the stretches of starts that are repeats in their bucket."""

    def settle(doc: np.ndarray, place: np.ndarray, parts: list[bytes]) -> pa.RecordBatch:
        sizes = np.array(list(map(len, parts)), np.int64)
        ends = np.cumsum(sizes)
        counts = sizes - LENGTH + 1
        owner = np.repeat(np.arange(len(parts)), counts)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        number = refine(np.frombuffer(b"".join(parts), np.uint8), (ends - sizes)[owner] + offset)
        keep = number >= 0
        number, owner, offset = number[keep], owner[keep], offset[keep]
        first, check = (place[owner] >> 30) + offset, (place[owner] >> 14) & 0xFFFF
        d = doc[owner]
        order = np.lexsort((check, first, d, number))
        number, first, check, d = number[order], first[order], check[order], d[order]
        head = np.maximum.accumulate(np.where(np.append(True, number[1:] != number[:-1])[: len(number)], np.arange(len(number)), 0))
        later = (d != d[head]) | (first != first[head]) | (check != check[head])
        doc, place, size = _merged(d[later], check[later], first[later], first[later])
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(place), pa.array(size)], names=["doc", "place", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets: list[np.ndarray] = []
        docs: list[np.ndarray] = []
        places: list[np.ndarray] = []
        parts: list[bytes] = []
        held = 0
        for b in batches:
            bucket, texts_ = b.column("bucket").to_numpy(), b.column("text").to_pylist()
            buckets.append(bucket)
            docs.append(b.column("doc").to_numpy())
            places.append(b.column("place").to_numpy())
            parts += texts_
            held += sum(map(len, texts_))
            if held > CHUNK:
                key = np.concatenate(buckets)
                cut = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
                if cut:
                    d, p = np.concatenate(docs), np.concatenate(places)
                    yield settle(d[:cut], p[:cut], parts[:cut])
                    buckets, docs, places, parts = [key[cut:]], [d[cut:]], [p[cut:]], parts[cut:]
                    held = sum(map(len, parts))
        if parts:
            yield settle(np.concatenate(docs), np.concatenate(places), parts)

    return texts.select("bucket", "doc", "place", "text").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "doc long, place long, size long")


def narrowed(texts: DataFrame, large: DataFrame, width: int) -> DataFrame:
    """The texts of the ``large`` buckets in buckets of strings whose anchor stands in ``width`` places.

    Strings of a bucket are refined by the hash of what all strings share whose anchors stand in these places: it is
    longer than before, and whole strings at a width of 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("bucket", "doc", "place", "ahead", "text")}
            for bucket, doc, place, ahead, text in zip(*(b.column(c).to_pylist() for c in ("bucket", "doc", "place", "ahead", "text")), strict=True):
                low = ahead - (len(text) - LENGTH)  # the anchor stands low to ahead bytes into the strings
                for k in range(low // width * width, ahead + 1, width):
                    first, last = min(ahead, k + width - 1), max(low, k)
                    # All strings of these places have the bytes from k before the anchor to what the one that begins first has.
                    shared = text[ahead - k : ahead - (k + width - 1) + LENGTH]
                    key = hashlib.blake2b(shared, digest_size=8, key=b"%d %d %d" % (bucket, k, width)).digest()
                    out["bucket"].append(int.from_bytes(key, "little", signed=True))
                    out["doc"].append(doc)
                    out["place"].append(place + ((ahead - first) << 30))
                    out["ahead"].append(first)
                    out["text"].append(text[ahead - first : ahead - last + LENGTH])
            yield pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int64()), pa.array(out["doc"], pa.int64()), pa.array(out["place"], pa.int64()), pa.array(out["ahead"], pa.int32()), pa.array(out["text"], pa.binary())], names=list(out))

    return texts.join(large, F.col("bucket") == F.col("large"), "left_semi").mapInArrow(run, CONTEXT)


def alike(strings: DataFrame) -> DataFrame:
    """doc, place and size of all but the earliest of equal strings; the earliest are found before anything is shuffled."""
    first = strings.groupBy("text").agg(F.min(F.struct("doc", "place")).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("text").alias("t"), "first")
    both = strings.join(first, F.col("text") == F.col("t")).where((F.col("doc") != F.col("first.doc")) | (F.col("place") != F.col("first.place")))
    return both.select("doc", "place", F.lit(1).cast("long").alias("size"))


def _large(rows: DataFrame, key: str) -> DataFrame:
    return written(rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > MOST_TOGETHER).select(F.col(key).alias("large")), "substring-large")


def repeats(docs: DataFrame) -> DataFrame:
    """doc, place and size: the stretches of starts of strings of LENGTH bytes that also start earlier. ``docs`` has doc_id and text, no null."""
    first = written(bucketed(runs_of(docs)), "substring-buckets")
    chosen = first.where("kind = 2")
    found = first.where("kind = 1").select("doc", "place", "size")
    large, on = _large(chosen, "gram"), F.col("gram") == F.col("large")
    if not large.head(1):
        return found.unionByName(refined(contexts(docs, chosen)))
    found = found.unionByName(refined(contexts(docs, chosen.join(large, on, "left_anti"))))
    texts = contexts(docs, chosen.join(large, on, "left_semi"))
    for width in WIDTHS:
        texts = written(texts, "substring-contexts")
        large = _large(texts, "bucket")
        found = found.unionByName(refined(texts.join(large, F.col("bucket") == F.col("large"), "left_anti")))
        if not large.head(1):
            return found
        texts = narrowed(texts, large, width)
    return found.unionByName(alike(texts))


def _keyed(slim: DataFrame) -> DataFrame:
    """``slim`` (doc_id, text) with ``key``: a number of its own for each text of a doc_id, in the order of doc_id, then of the texts' MD5.

    Where every row has a doc_id of its own, as a count of ids tells, that is the key. Else all pairs of doc_id and MD5
    are numbered in ranges; only these pass through the shuffle.
    """
    if not slim.groupBy("doc_id").count().where("count > 1").head(1):
        return slim.withColumn("key", F.col("doc_id"))
    digest = F.unhex(F.md5("text"))
    pairs = slim.select("doc_id", digest.alias("digest")).distinct()
    keys = in_order(pairs, [F.col("doc_id"), F.col("digest")], "key").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.col("key").cast("long").alias("key"))
    return slim.join(keys, (F.col("doc_id") == F.col("_id")) & (digest == F.col("_digest"))).select("doc_id", "text", "key")


def cleaned(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every row of ``docs`` (doc_id, text).

    A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a smaller doc_id, or earlier in the
    document. Null texts are empty, and a null doc_id comes before all others. A repeated row is the same document, and
    both get the same result; rows of one doc_id, or of none, with different texts are documents of their own, one after
    another in the order of their texts' MD5. An empty table gives an empty one.
    """
    slim = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    slim = _keyed(slim)
    found = repeats(slim.select(F.col("key").alias("doc_id"), "text")).groupBy("doc").agg(F.collect_list(F.struct("place", "size")).alias("stretches"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE):
            starts, data = text_buffer(b.column("text"))
            _, checks = _tags(b, starts, data)
            out: dict[str, list] = {k: [] for k in ("n_removed", "n_spans", "kept_sha256", "kept")}
            for i, stretches in enumerate(b.column("stretches").to_pylist()):
                raw = data[starts[i] : starts[i + 1]]
                edge = np.zeros(len(raw) + 1, np.int32)
                for s in stretches or ():
                    if (s["place"] >> 14) & 0xFFFF == checks[i]:
                        first = s["place"] >> 30
                        edge[first] += 1
                        edge[first + s["size"] - 1 + LENGTH] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                kept = raw[~gone].tobytes() if stretches else raw.tobytes()
                out["n_removed"].append(len(raw) - len(kept))
                out["n_spans"].append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept)
            ids = b.column("doc_id").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([None if x == NO_DOC else x for x in ids], pa.int64()), pa.array(np.diff(starts)), pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64()), pa.array(out["kept_sha256"], pa.string()), pa.array(out["kept"], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    both = slim.join(found, F.col("key") == F.col("doc"), "left").select("doc_id", "text", "stretches")
    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
