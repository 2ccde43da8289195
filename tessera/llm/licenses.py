"""Licence scans: matching statistics against a generalised suffix automaton of licence words, chained into spans."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices

#: The phrases that give the base labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Template wordings, by label; several wordings may share one.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("public-domain", "This is free and unencumbered software released into the public domain"),
]
LEAST_MATCH = 3
MOST_GAP = 6
LEAST_COVER = 0.75
SLICE = 8 << 20

#: A-Z to a-z; what is neither a digit, a letter nor beyond ASCII parts words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Automaton:
    """A suffix automaton of several word sequences; each state knows where its strings end, as (template, end)."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        self.sequences = sequences
        self._endings: dict[int, list[tuple[int, int, int]]] = {}
        for t, words in enumerate(sequences):
            last = 0
            for end, w in enumerate(words):
                last = self._extend(last, w)
                self.ends[last].add((t, end))
        for s in sorted(range(1, len(self.size)), key=lambda s: -self.size[s]):
            self.ends[self.link[s]] |= self.ends[s]

    def _state(self, size: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(dict(moves))
        self.size.append(size)
        self.link.append(link)
        self.ends.append(set())
        return len(self.size) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        copy = self._state(self.size[p] + 1, self.link[q], self.next[q])
        self.link[q] = copy
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:  # an earlier sequence has this string already
            q = self.next[last][w]
            return q if self.size[q] == self.size[last] + 1 else self._split(last, q, w)
        new, p = self._state(self.size[last] + 1, 0, {}), last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][w]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, q, w)
        return new

    def endings(self, state: int, least: int) -> list[tuple[int, int, int]]:
        """(template, end, most words) of the strings of ``least`` words or more that end where those of ``state`` do.

        A template that shares only a shorter end of what was read is found along the suffix links.
        """
        if state not in self._endings:
            out: dict[tuple[int, int], int] = {}
            at = state
            while at > 0 and self.size[at] >= least:
                for place in self.ends[at]:
                    out.setdefault(place, self.size[at])
                at = self.link[at]
            self._endings[state] = [(*place, most) for place, most in sorted(out.items())]
        return self._endings[state]

    def matches(self, words: list[int], least: int) -> Iterator[tuple[int, int, int, int]]:
        """(end in the text, template, end in it, length) of all matches of ``least`` words or more that neither side lengthens.

        The automaton gives the matching statistics of the stream; a match ends where the template goes on with another
        word than the text. They come in the order of their end.
        """
        state = length = 0
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if w in self.next[state]:
                state, length = self.next[state][w], length + 1
            if length >= least:
                after = words[i + 1] if i + 1 < len(words) else None
                for t, end, most in self.endings(state, least):
                    sequence = self.sequences[t]
                    if end + 1 == len(sequence) or sequence[end + 1] != after:
                        yield i, t, end, min(most, length)


class Scanner:
    """The automaton and phrases, built once in each task."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        self.labels = [label for label, _ in templates]
        texts = [words_of(text) for _, text in templates]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
        self.sizes = [len(t) for t in texts]
        self.automaton = Automaton([[self.vocabulary[w] for w in t] for t in texts])
        self.phrases = [(b" " + b" ".join(words_of(p)) + b" ", label) for p, label in phrases.items()]

    def base(self, words: list[bytes]) -> tuple[list[int], set[str]]:
        """First words of the places where a phrase stands, and the labels of those phrases."""
        line, places, labels = b" " + b" ".join(words) + b" ", [], set()
        for phrase, label in self.phrases:
            at, seen, n = line.find(phrase), 0, 0
            while at >= 0:
                n += line.count(b" ", seen, at)  # counted on from the last place
                seen = at
                places.append(n)
                labels.add(label)
                at = line.find(phrase, at + 1)
        return places, labels

    def spans(self, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """(label, first word, end, covered share of the template) of the chains that cover LEAST_COVER of one."""
        ids = np.fromiter(map(self.vocabulary.get, words, [-1] * len(words)), np.int64, len(words))
        known = np.flatnonzero(ids >= 0)
        chains: dict[int, Chains] = {}
        for run in np.split(known, np.flatnonzero(np.diff(known) > 1) + 1):
            if len(run) < LEAST_MATCH:  # no match can be long enough
                continue
            for end, t, t_end, length in self.automaton.matches(ids[run].tolist(), LEAST_MATCH):
                stop = int(run[0]) + end + 1
                if t not in chains:
                    chains[t] = Chains()
                chains[t].add(stop - length, stop, t_end + 1 - length, t_end + 1)
        found = [(self.labels[t], first, end, cover / self.sizes[t]) for t, c in chains.items() for first, end, cover in c.apart(LEAST_COVER * self.sizes[t])]
        return sorted(found, key=lambda x: (x[1], -x[2], x[0]))


class Chains:
    """Best chains of matches with one template: words in order on both sides, MOST_GAP words of the text apart at most.

    ``add`` takes matches in the order of their end and finds the best chain that ends with each: only those that ended
    MOST_GAP words before it or later can be lengthened, and these are the last ones.
    """

    def __init__(self) -> None:
        self.nodes: list[tuple[int, int, int, int]] = []  # first word of the chain, end, template end, words covered

    def add(self, first: int, stop: int, t_first: int, t_stop: int) -> None:
        best = (stop - first, -first)
        for begin, end, t_end, cover in reversed(self.nodes):
            if end < first - MOST_GAP:
                break
            gain = stop - first - max(0, end - first, t_end - t_first)
            if gain > 0:
                best = max(best, (cover + gain, -begin))
        self.nodes.append((-best[1], stop, t_stop, best[0]))

    def apart(self, least: float) -> list[tuple[int, int, int]]:
        """(first word, end, words covered) of the chains that cover ``least``, the best first, none across another."""
        firsts: list[int] = []
        ends: list[int] = []
        out: list[tuple[int, int, int]] = []
        for first, end, _, cover in sorted((n for n in self.nodes if n[3] >= least), key=lambda n: (-n[3], n[1], -n[0])):
            i = bisect.bisect_right(firsts, first)
            if (i and ends[i - 1] > first) or (i < len(firsts) and firsts[i] < end):
                continue
            firsts.insert(i, first)
            ends.insert(i, end)
            out.append((first, end, cover))
        return out


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,end:long,cover:double>>"


def scan(docs: DataFrame) -> DataFrame:
    """Base places, labels and template spans of every row of ``docs`` (doc_id, text).

    ``score`` is the best covered share of a template, 1 where a base phrase stands, 0 without either. Null and empty
    texts have no words and no labels (an empty string); repeated rows are scanned alike. An empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, kind = Scanner(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())]))
        for b in slices(batches, SLICE):
            out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
            for text in b.column("text").to_pylist():
                words = words_of(text)
                places, base = scanner.base(words)
                spans = scanner.spans(words)
                row = len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | {s[0] for s in spans})), 1.0 if base else max((min(1.0, s[3]) for s in spans), default=0.0), [dict(zip(("label", "first", "end", "cover"), s, strict=True)) for s in spans]
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
            kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": kind}
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), **{k: pa.array(v, kinds[k]) for k, v in out.items()}})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
