"""N-gram Jaccard join: prefix-filtered candidates, T-occurrence search with DivideSkip, components of the links.

How it goes, with sets of 64-bit hashes of word shingles:

1. Equal sets meet in one class; only its smallest doc_id (the representative) is searched for.
2. A shared order of shingles puts frequent ones last. Two sets that link share a shingle among the first
   n - ceil(similar n) + 1 of each, so these are indexed, and a class's candidates stand in the lists of its own.
3. A list is cut where sizes are too far apart to link; what is left of it belongs to its smallest representative, the
   pivot, and all lists of one are searched together. So near copies, which share most lists, meet once or a few times
   and not once for each list. Lists of very many documents (found in a sample; either way gives the same links) are
   not sorted: they get their pivot by a broadcast and a grouping.
4. A pivot of up to BLOCK documents is one unit of search. In a unit, documents whose hashes' histograms leave no partner
   possible are dropped (an exact bound); the T-occurrence search then links the others. What a unit has put into one
   component needs no further link, so a unit gives fewer links than it has documents and no pairs are ever made.
5. A larger pivot is dealt into blocks by a hash; one document of each component found goes into the next, smaller
   round of blocks, until one block is left. Then the documents outside the pivot's largest component, the rest, meet
   all its documents, block by block, and only those of other components can link. For a group of near copies the rest
   is empty or small, so the work grows with the group's size; it is quadratic in blocks only for a rest that stays large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import components, mix, slices, text_buffer, written

WORDS = 5
SIMILAR = 80  # hundredths
SLICE = 6 << 20
SKETCH = 128
SAMPLE = 16
HOT_LEAST = 3
HOT_MOST = 500_000
DIVIDE = 0.01
BLOCK = 1024
MOST_MARKS = 1 << 27
LONG_LIST = 20_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def shingle_sets(texts: pa.Array, width: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of ``width`` words; a shorter text is one shingle, an empty one none."""
    starts, data = text_buffer(texts)
    raw = data.tobytes().translate(_LOWER)
    seen: dict[bytes, int] = {}
    number, ids, ends = seen.setdefault, [], [0]
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        ids += [number(w, len(seen)) for w in raw[a:b].split()]
        ends.append(len(ids))
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, seen), np.uint64, len(seen))[np.array(ids, np.int64)] if ids else np.zeros(0, np.uint64)
    whole = own[: max(0, len(own) - width + 1)].copy()
    for k in range(1, width):
        whole = mix(whole * _C[k % 4] + own[k : len(own) - width + 1 + k])
    out = []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(whole[a : b - width + 1]))
        elif b > a:
            h = np.array([b - a], np.uint64)
            for x in own[a:b]:
                h = mix(h * _C[0] + x)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def least_overlap(n: int, similar: int = SIMILAR) -> int:
    """The least overlap of a set of ``n`` with any set that links to it."""
    return -(-similar * n // 100)


def _ids(batch: pa.RecordBatch) -> pa.Array:
    return batch.column("doc_id")


def hot_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles and their counts, from one document in SAMPLE by a hash; HOT_MOST at most.

    They only set the shared order, which any choice leaves exact: they keep lists short.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE):
            values, counts = np.unique(np.concatenate(shingle_sets(b.column("text"), width)), return_counts=True)
            yield pa.RecordBatch.from_pydict({"shingle": values.view(np.int64), "n": counts})

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text")
    hot = some.mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_LEAST).orderBy(F.desc("n"), "shingle").limit(HOT_MOST).toPandas()
    values = hot["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], hot["n"].to_numpy(np.int64)[order]


def profiles(docs: DataFrame, width: int, similar: int) -> DataFrame:
    """doc_id, n, k1 and k2 (a 128-bit key of the set), prefix (its first shingles in the shared order) and sketch."""
    hot, heat = hot_shingles(docs, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE):
            n, k1, k2, prefixes, sketches = [], [], [], [], []
            for s in shingle_sets(b.column("text"), width):
                n.append(len(s))
                k1.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)))
                k2.append(int(np.bitwise_xor.reduce(mix(s ^ _C[1])).view(np.int64)) if len(s) else 0)
                most = len(s) - least_overlap(len(s), similar) + 1 if len(s) else 0
                if len(hot) and len(s):
                    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                    rank = np.where(hot[at] == s, heat[at], 0)
                    # few are hot: the first of the others come in hash order already
                    cold = s[rank == 0]
                    if len(cold) < most:
                        warm = np.flatnonzero(rank)
                        cold = np.concatenate([cold, s[warm[np.lexsort((s[warm], rank[warm]))]]])
                    s_first = cold[:most]
                else:
                    s_first = s[:most]
                prefixes.append(s_first.view(np.int64))
                sketches.append(sketch_of(s).tobytes())
            yield pa.RecordBatch.from_arrays([_ids(b), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["doc_id", "n", "k1", "k2", "prefix", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n long, k1 long, k2 long, prefix array<long>, sketch binary")


def _grouped(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[int, list[list]]]:
    """Rows sorted by unit, a unit at a time: (unit, the columns' values)."""
    unit, held = None, [[] for _ in columns]
    for b in batches:
        keys = b.column("unit").to_numpy()
        values = [b.column(c) for c in columns]
        cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])).tolist() if len(keys) else []
        for x, y in zip(cuts, [*cuts[1:], len(keys)], strict=True):
            if unit is not None and keys[x] != unit:
                yield unit, held
                held = [[] for _ in columns]
            unit = int(keys[x])
            for h, v in zip(held, values, strict=True):
                h += v.slice(x, y - x).to_pylist()
    if unit is not None:
        yield unit, held


def cells_of(n: int) -> int:
    """Cells of a set's histogram: SKETCH, or a doubling of it that leaves 8 elements a cell at most."""
    return SKETCH << max(0, (max(n, 1) - 1) // (8 * SKETCH)).bit_length()


def sketch_of(hashes: np.ndarray) -> np.ndarray:
    """How many hashes fall into each cell of equal width, 255 at most."""
    cells = cells_of(len(hashes))
    return np.minimum(np.bincount((hashes >> np.uint64(65 - cells.bit_length())).astype(np.int64), minlength=cells), 255).astype(np.uint8)


def partnered(sizes: np.ndarray, sketches: list[np.ndarray], similar: int = SIMILAR, groups: np.ndarray | None = None) -> np.ndarray:
    """Flags the documents (in the order of size) whose histograms leave a link with another (of another group, if given) possible.

    Of two histograms the finer is summed to the coarser's cells; what is beyond 255 in a cell adds to the bound.
    """
    kinds = np.array([len(x) for x in sketches])
    extra = sizes - np.array([x.sum(dtype=np.int64) for x in sketches])
    tables = {int(c): (np.flatnonzero(kinds == c), np.stack([sketches[i] for i in np.flatnonzero(kinds == c)]).astype(np.uint16)) for c in np.unique(kinds)}
    out = np.zeros(len(sizes), bool)
    for i in range(1, len(sizes)):
        low = int(np.searchsorted(sizes[:i], least_overlap(int(sizes[i]), similar)))
        if low == i:
            continue
        for c, (rows, table) in tables.items():
            x, y = np.searchsorted(rows, (low, i))
            if x == y or c > kinds[i]:
                continue
            mine = sketches[i].reshape(c, -1).sum(1, dtype=np.uint16)
            others = rows[x:y]
            bound = np.minimum(table[x:y], mine).sum(1, dtype=np.int64) + np.minimum(extra[others], extra[i])
            good = (100 + similar) * bound >= similar * (sizes[others] + sizes[i])
            if groups is not None:
                good &= groups[others] != groups[i]
            if good.any():
                out[i] = True
                out[others[good]] = True
    return out


def t_occurrences(sets: list[np.ndarray], similar: int = SIMILAR, groups: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(links, labels): links (i, j) that make the components of ``sets`` (sorted hashes, in the order of size, none empty), and those.

    Sets of one of ``groups``, if given, are of one component already. A set's query takes the inverted lists of its
    shingles, by DivideSkip: the longest are put aside; the others are merged (concatenated and counted, the array form
    of a heap's merge), and for sets with enough occurrences there to reach their threshold with the help of all long
    lists these are probed by binary search, the likeliest first. Sets that stand in the query's component by then are
    passed over.
    """
    sizes, n_sets = np.array([len(s) for s in sets], np.int64), len(sets)
    tokens = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int64)
    own = np.split(tokens, np.cumsum(sizes)[:-1])
    # All lists in one array, each in the order of its sets.
    entries = np.sort(tokens * n_sets + np.repeat(np.arange(n_sets), sizes))
    lists = (entries % n_sets).astype(np.int32)
    lengths = np.bincount(tokens)
    ends = np.cumsum(lengths)
    if groups is None:
        parent = np.arange(n_sets)
    else:
        _, head, inverse = np.unique(groups, return_index=True, return_inverse=True)
        parent = head[inverse]
    out: list[tuple[int, int]] = []
    for i in range(1, n_sets):
        low = int(np.searchsorted(sizes[:i], least_overlap(int(sizes[i]), similar)))
        if low == i or (parent[low:i] == parent[i]).all():
            continue
        need = -(-similar * (sizes[low:i] + sizes[i]) // (100 + similar))
        mine = own[i][np.argsort(lengths[own[i]], kind="stable")]
        t = int(need[0])
        n_long = min(t - 1, int(t / (DIVIDE * np.log2(max(2, int(lengths[mine[-1]]))) + 1)))
        short, long = mine[: len(mine) - n_long], np.sort(mine[len(mine) - n_long :])
        merged = np.concatenate([lists[ends[x] - lengths[x] : ends[x]] for x in short.tolist()])
        count = np.bincount(merged, minlength=i)[low:i]
        alive = np.flatnonzero((count >= need - n_long) & (parent[low:i] != parent[i]))
        for j in (alive[np.argsort(-count[alive], kind="stable")] + low).tolist():
            if parent[j] == parent[i]:
                continue
            probes = long * n_sets + j
            hits = entries[np.minimum(np.searchsorted(entries, probes), len(entries) - 1)] == probes
            if count[j - low] + int(hits.sum()) >= need[j - low]:
                out.append((i, j))
                a, b = sorted((parent[i], parent[j]))
                parent[parent == b] = a
    return out, parent


UNIT = "unit long, rep long, n long, pivot long, known long"


def searched(units: DataFrame, sketches: DataFrame, docs: DataFrame, width: int, similar: int) -> DataFrame:
    """(a, b, pivot, n): links within the units that make the components; only sets of possible partners are made anew.

    ``units`` has UNIT: documents of one ``known`` component need no link. Where a unit is a part of a large pivot, a row
    with a = b (and its size n) stands for each component found.
    """
    spark = docs.sparkSession
    names = ["unit", "rep", "n", "pivot", "known"]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for unit, (reps, sizes, cells, pivots, known) in _grouped(batches, ("rep", "n", "sketch", "pivot", "known")):
            good = partnered(np.array(sizes, np.int64), [np.frombuffer(x, np.uint8) for x in cells], similar, np.array(known, np.int64))
            out += [(unit, reps[i], sizes[i], pivots[i], known[i]) for i in np.flatnonzero(good)]
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=names)

    rows = units.join(sketches, "rep").repartition("unit").sortWithinPartitions("unit", "n", "rep").select(*names, "sketch")
    members = written(rows.mapInArrow(keep, UNIT), "jaccard-members")
    ids = written(members.select(F.col("rep").alias("id")).distinct(), "jaccard-ids")
    # A bitmap of the ids keeps other texts from being shuffled; those it lets through by chance do no harm.
    n_marks = min(MOST_MARKS, 1 << max(16, (16 * ids.count()).bit_length()))
    mark = lambda c: F.pmod(F.xxhash64(c), F.lit(n_marks))
    bits = ids.select(mark("id").alias("bit")).groupBy(F.floor(F.col("bit") / 32).cast("int").alias("w"))
    marks = bits.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 32).cast("int"))).alias("m")).toPandas()
    bitmap = np.zeros(n_marks // 32, np.uint32)
    bitmap[marks["w"].to_numpy(np.int64)] = marks["m"].to_numpy(np.int64).astype(np.uint32)
    shared = spark.sparkContext.broadcast(bitmap)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE):
            place = b.column("place").to_numpy()
            b = b.filter(pa.array((shared.value[place >> 5] >> (place & 31).astype(np.uint32)) & 1 == 1))
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([_ids(b), pa.array([s.tobytes() for s in shingle_sets(b.column("text"), width)], pa.binary())], names=["rep", "hashes"])

    sets = docs.withColumn("place", mark("doc_id")).mapInArrow(make, "rep long, hashes binary")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, (reps, sizes, hashes, pivots, known) in _grouped(batches, ("rep", "n", "hashes", "pivot", "known")):
            sets_ = [np.frombuffer(x, np.uint64) for x in hashes]
            # A row that repeats an id with another text has a set of another size; its class is another.
            good = [i for i, (s, n) in enumerate(zip(sets_, sizes, strict=True)) if len(s) == n]
            if len(good) > 1:
                found, labels = t_occurrences([sets_[i] for i in good], similar, np.array([known[i] for i in good], np.int64))
                out += [(reps[good[i]], reps[good[j]], None, None) for i, j in found]
                if pivots[0] is not None:
                    heads, counts = np.unique(labels, return_counts=True)
                    out += [(reps[good[i]], reps[good[i]], pivots[0], sizes[good[i]]) for i in heads[counts > 1].tolist()]
        columns = zip(*out, strict=True) if out else ((),) * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["a", "b", "pivot", "n"])

    rows = members.join(sets, "rep").repartition("unit").sortWithinPartitions("unit", "n", "rep").select(*names, "hashes")
    return written(rows.mapInArrow(search, "a long, b long, pivot long, n long"), "jaccard-links")


def pivots_of(classes: DataFrame, similar: int) -> DataFrame:
    """(pivot, rep, n): the representatives that share a list, or a part of one, under its smallest."""
    lists = classes.select("rep", "n", F.explode("prefix").alias("shingle"))
    some = classes.where(F.pmod(F.xxhash64("rep"), F.lit(SAMPLE)) == 0).select(F.explode("prefix").alias("long"))
    long = written(some.groupBy("long").agg(F.count("*").alias("_n")).where(F.col("_n") * SAMPLE > LONG_LIST).select("long"), "jaccard-long")
    on = F.col("shingle") == F.col("long")
    by_size = Window.partitionBy("shingle").orderBy("n", "rep")
    far = F.coalesce(100 * F.lag("n").over(by_size) < similar * F.col("n"), F.lit(True)).cast("int")
    cut = lists.join(long, on, "left_anti").withColumn("far", far).withColumn("run", F.sum("far").over(by_size.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("shingle", "run")
    members = cut.withColumn("pivot", F.min("rep").over(run)).withColumn("together", F.count("*").over(run)).where("together > 1").select("pivot", "rep", "n")
    if long.head(1):
        in_long = lists.join(long, on).select("shingle", "rep", "n")
        least = written(in_long.groupBy("shingle").agg(F.min("rep").alias("pivot")).withColumnRenamed("shingle", "s"), "jaccard-long-pivots")
        members = members.unionByName(in_long.join(least, F.col("shingle") == F.col("s")).select("pivot", "rep", "n"))
    return members.distinct()


def _blocks(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members with their unit: UNIT, the large pivots and their numbers of blocks: p, k)."""
    large = members.groupBy("pivot").agg(F.count("*").alias("_n")).where(F.col("_n") > BLOCK).select(F.col("pivot").alias("p"), F.ceil(F.col("_n") / BLOCK).alias("k"))
    large = written(large, "jaccard-large")
    dealt = members.join(large, F.col("pivot") == F.col("p"), "left").withColumn("block", F.pmod(F.xxhash64("rep"), F.coalesce("k", F.lit(1))))
    return dealt.select(F.xxhash64("pivot", "block").alias("unit"), "rep", "n", F.col("p").alias("pivot"), F.col("rep").alias("known")), large


def rest_units(members: DataFrame, large: DataFrame, labels: DataFrame) -> DataFrame:
    """UNIT rows in which the documents of large pivots that stand outside its largest component meet all of its documents."""
    of = members.join(large, F.col("pivot") == F.col("p")).select("pivot", "rep", "n", "k")
    of = written(of.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("known", F.coalesce("component", "rep")).drop("component"), "jaccard-known")
    main = of.groupBy("pivot", "known").agg(F.count("*").alias("_n")).groupBy("pivot").agg(F.max(F.struct("_n", "known")).alias("_m"), F.sum("_n").alias("_all"))
    main = written(main.select(F.col("pivot").alias("p"), F.col("_m.known").alias("main"), F.ceil((F.col("_all") - F.col("_m._n")) / BLOCK).alias("parts")).where("parts > 0"), "jaccard-main")
    of = of.join(main, F.col("pivot") == F.col("p")).drop("p")
    mine = F.pmod(F.xxhash64("rep"), F.col("k"))
    both = of.select("pivot", "rep", "n", "known", mine.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    rest = of.where("known <> main").withColumn("part", F.pmod(F.xxhash64("rep", F.lit("rest")), F.col("parts")))
    rest = rest.select("pivot", "rep", "n", "known", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("block"), "part")
    rows = both.unionByName(rest).select(F.xxhash64("pivot", "block", "part", F.lit("rest")).alias("unit"), "rep", "n", F.lit(None).cast("long").alias("pivot"), "known")
    return rows.distinct()


def linked(classes: DataFrame, docs: DataFrame, width: int, similar: int) -> DataFrame:
    """Links (a, b) of representatives that make the components of all links."""
    sketches = classes.select("rep", "sketch")
    members = written(pivots_of(classes, similar), "jaccard-pivots")
    units, large = _blocks(members)
    all_large, found = large, searched(written(units, "jaccard-units"), sketches, docs, width, similar)
    links = found.select("a", "b")
    if not all_large.head(1):
        return links
    while large.head(1):
        heads = written(found.where("a = b").select("pivot", F.col("a").alias("rep"), "n"), "jaccard-heads")
        units, large = _blocks(heads)
        found = searched(written(units, "jaccard-units"), sketches, docs, width, similar)
        links = links.unionByName(found.select("a", "b"))
    labels = written(components(links, "jaccard-blocks"), "jaccard-labels")
    units = written(rest_units(members, all_large, labels), "jaccard-units")
    return links.unionByName(searched(units, sketches, docs, width, similar).select("a", "b"))


def joined(docs: DataFrame, width: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row of ``docs`` (doc_id, text).

    Two documents link when 100 * intersection >= ``similar`` * union of their sets. Null and empty texts have no
    shingles and link with nothing, nor does a row without doc_id (its component is null). Repeated rows are returned
    each; rows of one doc_id with different texts are linked by their id. An empty table gives an empty one.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = written(profiles(docs, width, similar), "jaccard-profiles")
    sets = known.where("n > 0 AND doc_id IS NOT NULL")
    classes = written(sets.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch")), "jaccard-classes")

    found = linked(classes, docs, width, similar)

    own = sets.select("doc_id", "n", "k1", "k2")
    same_id = own.distinct().groupBy("doc_id").agg(F.count("*").alias("texts")).where("texts > 1").select("doc_id")
    member = own.join(classes.select("n", "k1", "k2", "rep"), ["n", "k1", "k2"])
    tied = member.join(same_id, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    comp = written(components(found.unionByName(tied), "jaccard"), "jaccard-components")

    whole = classes.select("n", "k1", "k2", "rep").join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("n", "k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    out = known.select("doc_id", "n", "k1", "k2").join(whole, ["n", "k1", "k2"], "left")
    lone = F.when(F.col("doc_id").isNull() | (F.col("n") == 0), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), lone.alias("component_id"))


def one_of_each(docs: DataFrame, width: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """``docs`` with one row of each component, the one whose doc_id names it; rows without words or doc_id all stay."""
    others = joined(docs, width, similar).where("component_id <> doc_id").select(F.col("doc_id").alias("other")).distinct()
    has = F.coalesce(F.regexp_like(F.col("text"), F.lit(r"[^\x20\x09-\x0D]")), F.lit(False)) & F.col("doc_id").isNotNull()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), has.alias("has"))
    first = rows.where("has").join(others, F.col("doc_id") == F.col("other"), "left_anti").dropDuplicates(["doc_id"])
    return first.unionByName(rows.where("NOT has")).select("row.*")


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [list_aggregate(w, 'string_agg', ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM words),
sized AS (SELECT doc_id, len(s) AS n, s FROM shingled),
one AS (SELECT doc_id, n, unnest(s) AS g FROM sized),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS x FROM one a JOIN one b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2, 3, 4),
linked AS (SELECT a, b FROM pairs WHERE 100 * x >= 85 * (na + nb - x)),
edges AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT a AS id, b AS other FROM edges UNION SELECT r.id, e.b FROM reach r JOIN edges e ON r.other = e.a)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(r.low, s.doc_id)) AS component_id
FROM sized s LEFT JOIN (SELECT id, min(other) AS low FROM reach GROUP BY id) r ON r.id = s.doc_id
"""
