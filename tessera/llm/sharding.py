"""Sharding by balanced label propagation: equal texts move together under quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import exact_rank, written

SHARDS = 24
BINS = 4096
IDLE = 3
FEW = 8


def _unit(column: Column) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(1 << 30)) / float(1 << 30)


def quotas(n_rows: int, shards: int) -> list[int]:
    return [n_rows // shards + (t < n_rows % shards) for t in range(shards)]


def bins(n_rows: int) -> int:
    """Bins to rank ``n_rows`` rows in: some 4,096 rows each, whatever their number."""
    return min(1 << 20, max(BINS, n_rows >> 12))


def _cycle(flow: dict[int, dict[int, int]], start: int) -> list[int] | None:
    """The shortest way from ``start`` back to it along wishes that are left."""
    before, queue = {}, [start]
    for node in queue:
        for t, left in flow.get(node, {}).items():
            if left > 0 and t == start:
                way = [node]
                while way[-1] != start:
                    way.append(before[way[-1]])
                return way[::-1]
            if left > 0 and t not in before and t != start:
                before[t] = node
                queue.append(t)
    return None


def exchanges(wishes: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many rows may move from shard to shard, of those that wish to, so that each shard gets no more than it gives and has room for.

    First along cycles, of two shards that exchange and longer ones, then into room, which moves leave where they come from.
    """
    flow: dict[int, dict[int, int]] = {}
    for (s, t), n in sorted(wishes.items()):
        flow.setdefault(s, {})[t] = n
    granted: dict[tuple[int, int], int] = {}

    def grant(s: int, t: int, n: int) -> None:
        flow[s][t] -= n
        granted[s, t] = granted.get((s, t), 0) + n

    for start in sorted(flow):
        while way := _cycle(flow, start):
            steps = list(zip(way, [*way[1:], way[0]], strict=True))
            n = min(flow[s][t] for s, t in steps)
            for s, t in steps:
                grant(s, t, n)
    room, moved = list(room), True
    while moved:
        moved = False
        for s in sorted(flow):
            for t in sorted(flow[s]):
                n = min(flow[s][t], room[t])
                if n > 0:
                    grant(s, t, n)
                    room[t], room[s], moved = room[t] - n, room[s] + n, True  # what leaves makes room
    return granted


def _propagate(pieces: DataFrame, n_rows: int, held: list[int], shards: int) -> tuple[DataFrame, list[int]]:
    """Moves documents of a group towards the shards that hold more of it, until no move is left; ``pieces`` is (g, shard, n).

    In each round every smaller piece of a group wishes to join a larger one, in an order that changes by round. A move
    between two pieces takes rows from the smaller to the larger, so linked pairs that share a shard grow with each, and
    rounds end when few wishes can be granted. Wishes are summed by shards, that is shards squared numbers, and granted along cycles, so that full shards
    exchange rows. Gives the pieces and the rows of each shard.
    """
    quota, idle, turn = quotas(n_rows, shards), 0, 0
    while idle < IDLE:
        mixed = F.pmod(F.xxhash64("g", "shard", F.lit(turn)), F.lit(1 << 30)).alias("turn")
        room = [q - h for q, h in zip(quota, held, strict=True)]
        free = F.element_at(F.array(*[F.lit(max(0, x)).cast("long") for x in room]), F.col("shard") + 1).alias("free")  # of two pieces of one size the one with more room around it is the larger
        row = pieces.groupBy("g").agg(F.reverse(F.array_sort(F.collect_list(F.struct("n", free, mixed, "shard")))).alias("xs")).where(F.size("xs") > 1)  # one for each shard at most
        row = row.select("g", "xs", F.ceil(F.size("xs") / 2).cast("int").alias("k"), F.posexplode("xs").alias("i", "x"))
        to = F.pmod(F.size("xs") - 1 - F.col("i") + F.lit(turn // 2), F.col("k")) if turn % 2 else F.size("xs") - 1 - F.col("i")
        wish = row.withColumn("y", F.get("xs", to.cast("int"))).where(F.col("i") >= F.col("k"))
        wish = written(wish.select("g", F.col("x.shard").alias("shard"), F.col("x.n").alias("n"), F.col("y.shard").alias("t")).withColumn("_tie", F.col("g")), "shard-wishes")
        sums = {(r["shard"], r["t"]): r["n"] for r in wish.groupBy("shard", "t").agg(F.sum("n").alias("n")).collect()}
        if not sums:
            break
        turn += 1
        granted = exchanges(sums, room)
        # A round that can grant but few of its wishes counts as idle: what is left is better laid anew.
        idle = idle + 1 if FEW * sum(granted.values()) < sum(sums.values()) else 0
        if not granted:
            continue
        most = F.create_map(*[F.lit(x) for (s, t), n in sorted(granted.items()) for x in (s * shards + t, n)])
        lane = F.col("shard") * shards + F.col("t")
        ranked = exact_rank(wish.where(most[lane].isNotNull()), ["shard", "t"], _unit(F.concat(F.hex("g"), F.lit(turn))), 64, "before", "n")
        moves = ranked.withColumn("m", F.least("n", most[lane] - F.col("before"))).where("m > 0")
        both = F.explode(F.array(F.struct("shard", (-F.col("m")).alias("n")), F.struct(F.col("t").alias("shard"), F.col("m").alias("n"))))
        moved = pieces.select("g", "shard", "n").unionByName(moves.select("g", both.alias("x")).select("g", "x.shard", "x.n"))
        pieces = written(moved.groupBy("g", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "shard-pieces")
        for (s, t), n in granted.items():
            held[s] -= n
            held[t] += n
    return pieces, held


def _squares(pieces: DataFrame) -> int:
    return int(pieces.agg(F.coalesce(F.sum((F.col("n") * F.col("n")).cast("decimal(38,0)")), F.lit(0))).first()[0])


def _relaid(pieces: DataFrame, n_rows: int, shards: int) -> DataFrame:
    """``pieces`` with all groups that are apart laid anew, one after another, into the room that they leave together.

    Large groups come first and take the shards of the most room; a group is parted only where a shard's room ends.
    """
    sizes = pieces.groupBy("g").agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    apart = written(sizes.where("k > 1").select("g", F.col("total").alias("n")).withColumn("_tie", F.col("g")), "shard-apart")
    stay = pieces.join(apart.select("g"), "g", "left_anti").select("g", "shard", "n")
    held = {r["shard"]: r["n"] for r in stay.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    room = sorted(((q - held.get(t, 0), t) for t, q in enumerate(quotas(n_rows, shards))), key=lambda x: (-x[0], x[1]))
    low, ends = 0, []
    for n, t in room:
        ends.append(F.struct(F.lit(t).alias("shard"), F.lit(low).cast("long").alias("low"), F.lit(low + n).cast("long").alias("high")))
        low += n
    order = (252 - F.floor(4 * F.log2("n")) + _unit(F.col("g"))) / 256  # four steps to a doubling
    placed = exact_rank(apart, [], order, bins(apart.count()), "before", "n")
    inside = lambda e: F.least(F.col("before") + F.col("n"), e["high"]) - F.greatest(F.col("before"), e["low"])
    parts = F.filter(F.transform(F.array(*ends), lambda e: F.struct(e["shard"].alias("shard"), inside(e).alias("n"))), lambda x: x["n"] > 0)
    return written(stay.unionByName(placed.select("g", F.explode(parts).alias("x")).select("g", "x.shard", "x.n")), "shard-pieces")


def _settled(pieces: DataFrame, n_rows: int, held: list[int], shards: int) -> tuple[DataFrame, list[int]]:
    """Rounds of moves; when none is left, what is still apart is laid anew and moved on, as long as that keeps more pairs."""
    pieces, held = _propagate(pieces, n_rows, held, shards)
    best = _squares(pieces)
    while True:
        laid = _relaid(pieces, n_rows, shards)
        if _squares(laid) <= best:
            return pieces, held
        sums = {r["shard"]: r["n"] for r in laid.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        pieces, held = _propagate(laid, n_rows, [sums.get(t, 0) for t in range(shards)], shards)
        best = _squares(pieces)


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of ``docs`` (doc_id, text).

    The law is ``rows``: shards' counts are at most one apart. Documents of equal text are linked. They start spread
    evenly over the shards in the order of a hash; in each round documents ask for shards that hold more of their group,
    and shards that are full exchange them. Groups still apart then are laid whole into the room they leave. Unlinked documents fill what is left. The documents of a group are
    interchangeable: rounds move counts of (group, shard), and only the end gives each document its place.
    Places follow from doc_id and text, however rows are dealt. A null text has size 8, no links and a null CRC. Repeated
    rows each get a slot. An empty table gives an empty one.
    """
    text = F.col("text")
    slim = docs.select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("g"),
    )
    slim = written(slim.withColumn("row", F.xxhash64("doc_id", "g")), "shard-rows")
    counts = slim.where("g IS NOT NULL").groupBy("g").agg(F.count("*").alias("n_group")).where("n_group > 1")
    counts = written(counts.select(F.col("g").alias("lg"), "n_group"), "shard-groups")
    tagged = slim.join(counts, F.col("g") == F.col("lg"), "left")
    linked = tagged.where("lg IS NOT NULL").drop("lg")
    single = tagged.where("lg IS NULL").drop("lg", "n_group")
    n_rows, n_linked = slim.count(), counts.agg(F.coalesce(F.sum("n_group"), F.lit(0))).first()[0]

    held = quotas(n_linked, shards)
    spread = exact_rank(linked.select("g", "row", "doc_id").withColumn("_tie", F.struct("row", "doc_id")), [], _unit(F.col("row")), bins(n_linked), "r")
    ends = [sum(held[: t + 1]) for t in range(shards)]
    first = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("r")))
    pieces = spread.withColumn("shard", first.cast("int")).groupBy("g", "shard").agg(F.count("*").alias("n"))
    pieces = written(pieces, "shard-pieces")
    pieces, held = _settled(pieces, n_rows, held, shards)
    quota = quotas(n_rows, shards)
    fill, rest = [], n_rows - n_linked
    for t in range(shards):
        fill.append(min(rest, max(0, quota[t] - held[t])))
        rest -= fill[-1]
    fill[-1] += rest
    start = [sum(held[j] + fill[j] for j in range(t)) for t in range(shards + 1)]
    filled = [sum(fill[:t]) for t in range(shards + 1)]
    bound = [sum(quota[:t]) for t in range(shards + 1)]
    at = lambda values, i: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), i + 1)
    last_not_above = lambda values, x: F.size(F.filter(F.array(*[F.lit(v).cast("long") for v in values[:-1]]), lambda v: v <= x)) - 1

    # A linked document: its rank in the group finds its piece, the piece's rank in the shard its place.
    placed = exact_rank(pieces.withColumn("_tie", F.col("g")), ["shard"], _unit(F.col("g")), bins(n_linked), "before", "n").withColumn("place", at(start, F.col("shard")) + F.col("before"))
    runs = placed.withColumn("first", F.sum("n").over(Window.partitionBy("g").orderBy("shard")) - F.col("n"))
    runs = runs.groupBy("g").agg(F.collect_list(F.struct("first", "n", "place")).alias("runs")).select(F.col("g").alias("rg"), "runs")  # one for each shard at most
    inner = exact_rank(linked.withColumn("_tie", F.struct("row", "doc_id")), ["g"], _unit(F.col("row")), BINS, "r")
    inner = inner.join(runs, F.col("g") == F.col("rg"))
    mine = F.filter("runs", lambda x: (x["first"] <= F.col("r")) & (F.col("r") < x["first"] + x["n"]))[0]
    inner = inner.select("doc_id", "size", "text_crc32", (mine["place"] + F.col("r") - mine["first"]).alias("place"))

    outer = exact_rank(single.withColumn("_tie", F.struct("row", "doc_id", "g")), [], _unit(F.col("row")), bins(n_rows), "r")
    label = last_not_above(filled, F.col("r"))
    last_of = F.array_max(F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda t: (at(filled, t) <= F.col("r")) & (F.col("r") < at(filled, t + 1))))
    outer = outer.withColumn("label", last_of) if n_rows else outer.withColumn("label", label)
    outer = outer.select("doc_id", "size", "text_crc32", (at(start, F.col("label")) + at([held[t] for t in range(shards)], F.col("label")) + F.col("r") - at(filled, F.col("label"))).alias("place"))

    shard_of = F.array_max(F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda t: (at(bound, t) <= F.col("place")) & (F.col("place") < at(bound, t + 1))))
    out = inner.unionByName(outer).withColumn("shard", shard_of.cast("int"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("place") - at(bound, F.col("shard"))).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def cut(placed: DataFrame) -> DataFrame:
    """(links, cut), one row: pairs of rows of equal text, and those whose rows stand in different shards; ``placed`` is ``shard``'s result."""
    pairs = lambda n: n * (n - 1) / 2
    inside = placed.where("text_crc32 IS NOT NULL").groupBy("size", "text_crc32", "shard").agg(F.count("*").alias("n"))
    groups = inside.groupBy("size", "text_crc32").agg(F.sum("n").alias("n"), F.sum(pairs(F.col("n"))).alias("kept"))
    return groups.agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0)).cast("long").alias("links"), F.coalesce(F.sum(pairs(F.col("n")) - F.col("kept")), F.lit(0)).cast("long").alias("cut"))
