"""Secret scans: patterns, and sliding-window Shannon entropy per character class. DataFrame functions only.

Patterns find what looks like a secret by its form. Whatever else could be one is a candidate: a long run of characters
that keys are written in, unless the allow-list knows it. Over each candidate and each character class slides a window,
whose symbol counts are kept up to date: a step takes the symbol that leaves out of its count and puts the one that
enters into its own, and the sum of c log2 c changes by these two terms alone. Windows whose entropy reaches the class's
bits, and which hold digits and letters, are joined into spans.

Everything is per row: no shuffle, no Python. Positions are code points, ends are exclusive. The cost of a row is linear
in its text, whatever the number of matches: they are placed in chunks of CHUNK.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import floor, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 512
UNIT = 1_000_000  # entropies are compared as whole millionths, so that every engine agrees
FIRST, LAST = ord("+"), ord("z")  # the symbols that are counted


@dataclass(frozen=True)
class Pattern:
    """A form of secret: ``group`` of a match of ``regex`` has ``least`` characters or the match fails."""

    kind: str
    regex: str
    least: int = 0
    group: int = 0


@dataclass(frozen=True)
class Alphabet:
    """A character class, its window and the entropy, in bits a symbol, from which a window counts."""

    kind: str
    symbols: str
    window: int
    bits: float

    def most(self) -> int:
        """The largest sum of c log2 c, in millionths, that a window of ``bits`` can have."""
        return floor(UNIT * self.window * (log2(self.window) - self.bits))


def either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


ASSIGNED = "(" + either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of 16 hex digits or 14 capitals that begins at the first place it can is the whole run: short runs need not be matched to fail.
PATTERNS = (Pattern("assign", ASSIGNED, 12, 2), Pattern("access", "AKIA[A-Z0-9]{14,}"), Pattern("hex", "[0-9a-f]{16,}"))
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = (
    Alphabet("entropy_hex", DIGITS + "ABCDEFabcdef", 20, 3.0),
    Alphabet("entropy_alnum", DIGITS + UPPER + LOWER, 20, 3.7),
    Alphabet("entropy_base64", DIGITS + UPPER + LOWER + "+/_=-", 24, 3.95),
)
CANDIDATE = "[0-9A-Za-z+/_=-]{20,}"
#: Digits and letters that a window must hold.
LEAST_OF_EACH = 2
#: A candidate that one of these matches is no secret: identifiers that are meant to be seen, digests of public files, paths, and what people write in place of a key.
ALLOWED = (
    "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    "^(md5|sha1|sha256|sha384|sha512)[-=_]",
    "^/?[a-z0-9_-]{1,16}(/[a-z0-9_-]{1,16}){2,}/?$",
    "[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr]|[Cc][Hh][Aa][Nn][Gg][Ee]_?[Mm][Ee]|[Dd][Uu][Mm][Mm][Yy]",
    "0123456789|abcdefghij|ABCDEFGHIJ|qwertyuiop",
)

HIT = "struct<start:bigint,end:bigint,value:string>"
SPAN = "struct<start:bigint,place:int,end:bigint,kind:string,value:string>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def matches(text: Column, regex: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """array<start, end, value> of the leftmost non-overlapping matches of ``regex`` that ``keep`` holds for.

    The text around the matches, which ``split`` gives, and the matches themselves take turns, so their lengths say
    where each stands.
    """

    def placed(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        kept = x["hit"].isNotNull() if keep is None else keep(x["hit"])
        here = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), x["hit"].alias("value")))
        return F.struct(end.cast("long").alias("at"), F.when(kept, F.concat(acc["found"], here)).otherwise(acc["found"]).alias("found"))

    def chunk(acc: Column, first: Column, both: Column) -> Column:
        init = F.struct(acc["at"].alias("at"), _empty(HIT).alias("found"))
        done = F.aggregate(F.slice(both, first, F.lit(CHUNK)), init, placed)
        return _let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(acc["parts"], F.array(d["found"])).alias("parts")))

    def all_of(hits: Column) -> Column:
        both = F.zip_with(F.slice(F.split(text, regex, -1), F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
        start = F.struct(F.lit(0).cast("long").alias("at"), _empty(f"array<{HIT}>").alias("parts"))
        chunks = F.sequence(F.lit(1), F.size(hits), F.lit(CHUNK))
        return F.when(F.size(hits) == 0, _empty(HIT)).otherwise(_let(both, lambda b: F.flatten(F.aggregate(chunks, start, lambda acc, first: chunk(acc, first, b))["parts"])))

    return _let(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), all_of)


def _added(counts: Column, at: Column, by: int) -> Column:
    return F.concat(F.slice(counts, F.lit(1), at), F.array(F.get(counts, at) + F.lit(by)), F.slice(counts, at + 2, F.lit(LAST - FIRST + 1)))


def windows(codes: Column, alphabet: Alphabet) -> Column:
    """array<start, end> of the joined windows of ``codes`` (symbols of a candidate, from 0 on) that reach the alphabet's bits."""
    w = alphabet.window
    n_log = F.array(*[F.lit(round(UNIT * c * log2(c)) if c else 0).cast("long") for c in range(w + 2)])
    known = F.array(*[F.lit(chr(c) in alphabet.symbols) for c in range(FIRST, LAST + 1)])
    digit = lambda x: x.between(ord("0") - FIRST, ord("9") - FIRST).cast("int")
    zeros = F.array_repeat(F.lit(0), LAST - FIRST + 1)

    def start() -> list[Column]:
        return [zeros.alias("counts"), F.lit(0).cast("long").alias("total"), F.lit(0).alias("digits"), F.lit(0).alias("run")]

    def step(acc: Column, x: Column) -> Column:
        enters, leaves, full = x["enters"], x["leaves"], acc["run"] >= w
        same = full & (enters == leaves)
        counts = F.when(same, acc["counts"]).when(full, _let(_added(acc["counts"], leaves, -1), lambda c: _added(c, enters, 1))).otherwise(_added(acc["counts"], enters, 1))
        gone, come = F.get(acc["counts"], leaves), F.get(acc["counts"], enters)
        total = acc["total"] + F.when(same, F.lit(0).cast("long")).otherwise(
            F.get(n_log, come + 1) - F.get(n_log, come) - F.when(full, F.get(n_log, gone) - F.get(n_log, gone - 1)).otherwise(F.lit(0).cast("long"))
        )
        digits = acc["digits"] + digit(enters) - F.when(full, digit(leaves)).otherwise(F.lit(0))
        inside = F.struct(counts.alias("counts"), total.alias("total"), digits.alias("digits"), (acc["run"] + 1).alias("run"))
        return _let(F.when(F.get(known, enters), inside).otherwise(F.struct(*start())), lambda s: joined(acc, s))

    def joined(acc: Column, now: Column) -> Column:
        at = acc["at"] + 1
        begin = (at - w).cast("long")
        rich = (now["run"] >= w) & (now["total"] <= alphabet.most()) & now["digits"].between(LEAST_OF_EACH, w - LEAST_OF_EACH)
        apart = rich & (begin > acc["end"])
        held = F.array(F.struct(acc["begin"].alias("start"), acc["end"].alias("end")))
        found = F.when(apart & (acc["end"] >= 0), F.concat(acc["found"], held)).otherwise(acc["found"])
        return F.struct(
            *[now[c].alias(c) for c in ("counts", "total", "digits", "run")], at.alias("at"), F.when(apart, begin).otherwise(acc["begin"]).alias("begin"),
            F.when(rich, at.cast("long")).otherwise(acc["end"]).alias("end"), found.alias("found"),
        )

    def last(acc: Column) -> Column:
        return F.when(acc["end"] >= 0, F.concat(acc["found"], F.array(F.struct(acc["begin"].alias("start"), acc["end"].alias("end"))))).otherwise(acc["found"])

    before = F.concat(F.array_repeat(F.lit(-1), w), F.slice(codes, F.lit(1), F.size(codes)))
    pairs = F.zip_with(codes, F.slice(before, F.lit(1), F.size(codes)), lambda a, b: F.struct(a.alias("enters"), b.alias("leaves")))
    nowhere = [F.lit(0).alias("at"), F.lit(-1).cast("long").alias("begin"), F.lit(-1).cast("long").alias("end"), _empty("struct<start:bigint,end:bigint>").alias("found")]
    return F.aggregate(pairs, F.struct(*start(), *nowhere), step, last)


def _spans(hits: Column, place: int, kind: str) -> Column:
    return F.transform(hits, lambda h: F.struct(h["start"].alias("start"), F.lit(place).alias("place"), h["end"].alias("end"), F.lit(kind).alias("kind"), h["value"].alias("value")))


def _entropic(candidate: Column, place: int, alphabets: tuple[Alphabet, ...]) -> Column:
    codes = F.transform(F.split(candidate["value"], ""), lambda c: F.ascii(c) - FIRST)

    def of(alphabet: Alphabet) -> Callable[[Column], Column]:
        return lambda codes: windows(codes, alphabet)

    each = []
    for n, alphabet in enumerate(alphabets):
        hits = F.transform(
            _let(codes, of(alphabet)),
            lambda s: F.struct(
                (candidate["start"] + s["start"]).alias("start"), (candidate["start"] + s["end"]).alias("end"),
                F.substring(candidate["value"], (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")).alias("value"),
            ),
        )
        each.append(_spans(hits, place + n, alphabet.kind))
    return F.concat(*each)


def found(docs: DataFrame, patterns: tuple[Pattern, ...] = PATTERNS, alphabets: tuple[Alphabet, ...] = ALPHABETS, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """doc_id, base and added (arrays of start, place, end, kind, value, in the order of start, then of kinds as listed) of every row of ``docs``.

    ``base`` holds the patterns' matches, ``added`` the joined windows of high entropy of candidates that the allow-list
    does not know; one kind's spans never overlap, those of two kinds may. A null text is empty and has no spans; null
    and repeated ids, and equal rows, are rows of their own; an empty table gives an empty one; other columns are not
    read. Texts and candidates of any length are scanned whole.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = []
    for n, p in enumerate(patterns):
        base.append(_spans(matches(text, p.regex, _long_enough(p) if p.least else None), n, p.kind))
    unknown = matches(text, CANDIDATE, lambda hit: ~F.greatest(*[F.coalesce(hit.rlike(a), F.lit(False)) for a in allowed], F.lit(False), F.lit(False)))
    added = F.flatten(F.transform(unknown, lambda c: _entropic(c, len(patterns), alphabets)))
    return docs.select("doc_id", F.array_sort(F.concat(*base)).alias("base"), F.array_sort(added).alias("added"))


def _long_enough(p: Pattern) -> Callable[[Column], Column]:
    return lambda hit: F.length(F.regexp_extract(hit, p.regex, p.group)) >= p.least


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256 and spans of every row; see ``found`` for odd rows."""
    counted = [F.size(F.filter("base", _of_kind(p.kind))).cast("long").alias(f"n_{p.kind}") for p in PATTERNS]
    spans = _listed(F.array_sort(F.concat("base", "added"))).alias("spans")
    return found(docs).select("doc_id", *counted, F.size("added").cast("long").alias("n_entropy"), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), spans)


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    class_of = lambda symbols: "[" + "".join(f"\\{c}" if c in "-+/=_" else c for c in symbols) + "]+"
    hits = " UNION ALL ".join(
        f"SELECT r, {n} AS place, '{p.kind}' AS kind, string_split_regex(t, {quoted(p.regex)}) AS gaps, regexp_extract_all(t, {quoted(p.regex)}) AS found FROM docs"
        for n, p in enumerate((*PATTERNS, Pattern("candidate", CANDIDATE)))
    )
    known = " OR ".join(f"regexp_matches(hit, {quoted(a)})" for a in ALLOWED)
    kinds = ", ".join(f"({n + len(PATTERNS)}, '{a.kind}', {quoted(class_of(a.symbols))}, {a.window}, {a.most()})" for n, a in enumerate(ALPHABETS))
    least = f"(place <> 0 OR length(regexp_extract(hit, {quoted(ASSIGNED)}, 2)) >= {PATTERNS[0].least})"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
hits AS ({hits}),
numbered AS (SELECT r, place, kind, gaps, found, unnest(range(1, len(found) + 1)) AS i FROM hits),
placed AS (SELECT r, place, kind, found[i] AS hit, CAST(sum(length(gaps[i]) + length(found[i])) OVER (PARTITION BY r, place ORDER BY i) AS BIGINT) AS e FROM numbered),
base AS (SELECT r, place, kind, e - length(hit) AS s, e FROM placed WHERE place < {len(PATTERNS)} AND {least}),
candidates AS (SELECT r, hit, e - length(hit) AS s FROM placed WHERE place = {len(PATTERNS)} AND NOT ({known})),
alphabets(place, kind, symbols, w, most) AS (VALUES {kinds}),
slid AS (SELECT c.r, c.s, c.hit, a.*, unnest(range(0, greatest(length(c.hit) - a.w + 1, 0))) AS pos FROM candidates c CROSS JOIN alphabets a),
seen AS (SELECT r, s, place, kind, w, most, pos, substr(hit, CAST(pos + 1 AS BIGINT), w) AS win, symbols FROM slid),
symbols AS (SELECT r, s, place, pos, unnest(string_split(win, '')) AS c FROM seen WHERE regexp_full_match(win, symbols)),
counted AS (SELECT r, s, place, pos, c, count(*) AS n FROM symbols GROUP BY ALL),
rich AS (
  SELECT r, s, place, pos FROM counted GROUP BY r, s, place, pos
  HAVING sum(CAST(round({UNIT} * n * log2(n)) AS BIGINT)) <= (SELECT most FROM alphabets a WHERE a.place = counted.place)
     AND coalesce(sum(n) FILTER (c BETWEEN '0' AND '9'), 0) BETWEEN {LEAST_OF_EACH} AND (SELECT w FROM alphabets a WHERE a.place = counted.place) - {LEAST_OF_EACH}),
steps AS (SELECT r, s, place, kind, w, pos, CASE WHEN pos > lag(pos) OVER (PARTITION BY r, s, place ORDER BY pos) + w THEN 1 ELSE 0 END AS fresh FROM rich JOIN alphabets USING (place)),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY r, s, place ORDER BY pos) AS island FROM steps),
added AS (SELECT r, place, kind, islands.s + min(pos) AS s, islands.s + max(pos) + max(w) AS e FROM islands GROUP BY r, islands.s, place, kind, island),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM added),
listed AS (
  SELECT r, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex,
         count(*) FILTER (place > 2) AS n_entropy, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) FILTER (place < 3) AS b,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) AS spans FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       coalesce(n_entropy, 0) AS n_entropy, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN listed USING (r)
"""


ORACLE = _sql()
