"""License scan by template markup: optional and replaceable regions become token automata.

A template is text with ``[[ ... ]]`` around an optional region and ``{name:min-max}`` for a
region that any ``min`` to ``max`` words replace. Its other words are mandatory: a text is
accepted only where they stand in order, with nothing else between them. Texts and templates
are compared as lower-case words (A-Z lowered; every other ASCII character that is no digit or
letter separates words).

A null or empty text has no words and no labels. Repeated rows are scanned one by one; other
columns of the input do not reach the result.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speakerprint.llm.common import as_bytes, map_batches

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Fixed phrases of the base scan and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Fixed wording of public licenses and of their usual notices, with markup.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "licensed under the [[terms of the]] apache license [[,]] version 2.0",
        "licensed under the apache license [[,]] version 2.0 [[ (the license) ]] you may not use this file except in compliance"
        " with the license you may obtain a copy of the license at [[ http://www.apache.org/licenses/LICENSE-2.0 ]]",
    ),
    "mit": (
        "{verb:1-1} under the [[terms of the]] mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this {work:1-3} and associated documentation"
        " files (the {name:1-3}) to deal in the {name:1-3} without restriction including without limitation the rights to use copy"
        " modify merge publish distribute sublicense and/or sell copies of the {name:1-3} and to permit persons to whom the"
        " {name:1-3} is furnished to do so subject to the following conditions the above copyright notice and this permission notice"
        " [[ (including the next paragraph) ]] shall be included in all copies or substantial portions of the {name:1-3}",
    ),
    "isc": (
        "{verb:1-1} under the [[terms of the]] isc license",
        "permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted"
        " provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "bsd": (
        "{verb:1-1} under the [[terms of the]] {clauses:0-2} bsd license",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following"
        " conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions"
        " and the following disclaimer",
    ),
    "gpl": (
        "licensed under the [[terms of the]] gnu [[lesser]] general public license [[ [[,]] version {number:1-2} ]]",
        "you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free"
        " software foundation [[either]] version {number:1-1} of the license [[or (at your option) any later version]]",
    ),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v. 2.0",),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
    "cc-by": ("licensed under [[a]] [[the]] cc by 4.0", "licensed under [[a]] creative commons attribution {version:0-2} international license"),
    "cc-by-nc": ("licensed under [[a]] [[the]] cc by nc [[4.0]]", "licensed under [[a]] creative commons attribution noncommercial {version:0-2} international license"),
    "cc-by-sa": ("licensed under [[a]] [[the]] cc by sa [[4.0]]", "licensed under [[a]] creative commons attribution sharealike {version:0-2} international license"),
    "cc0": ("licensed under [[the]] cc0 [[1.0]]", "dedicated to the public domain under cc0 [[1.0]]"),
    "reserved": ("copyright {owner:1-8} all rights reserved",),
}


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


class Automaton:
    """Token automaton of one template: states with word edges, one free edge, and jumps."""

    def __init__(self, template: str):
        self.words: list[dict[bytes, int]] = [{}]
        self.free: list[int | None] = [None]
        self.jumps: list[set[int]] = [set()]
        self.memo: dict[tuple[frozenset[int], bytes], frozenset[int]] = {}
        at, opened, mandatory = 0, [], set()
        for part in re.findall(r"\[\[|\]\]|\{\w+:\d+-\d+\}|[^\[\]{}]+", template):
            if part == "[[":
                opened.append(at)
            elif part == "]]":
                self.jumps[opened.pop()].add(at)
            elif part[0] == "{":
                low, high = map(int, part[1:-1].split(":")[1].split("-"))
                skip = []
                for k in range(high):
                    if k >= low:
                        skip.append(at)
                    new = self._state()
                    self.free[at] = new
                    at = new
                for s in skip:
                    self.jumps[s].add(at)
            else:
                for w in words_of(part.encode()):
                    new = self._state()
                    self.words[at][w] = new
                    at = new
                    if not opened:
                        mandatory.add(w)
        self.end, self.mandatory = at, mandatory
        self.start = self._closure({0})
        self.first = {w for s in self.start for w in self.words[s]}
        self.open_start = any(self.free[s] is not None for s in self.start)

    def _state(self) -> int:
        self.words.append({})
        self.free.append(None)
        self.jumps.append(set())
        return len(self.words) - 1

    def _closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.jumps[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def step(self, states: frozenset[int], word: bytes) -> frozenset[int]:
        """States after a word; kept for words of the template, which alone are few."""
        known = word in self.mandatory
        if known and (states, word) in self.memo:
            return self.memo[states, word]
        to = {self.words[s][word] for s in states if word in self.words[s]} | {self.free[s] for s in states if self.free[s] is not None}
        out = self._closure(to) if to else frozenset()
        if known:
            self.memo[states, word] = out
        return out

    def longest(self, words: list[bytes], start: int) -> int:
        """End of the longest accepted run of words from ``start``, or -1."""
        states, best = self.start, -1
        for i in range(start, len(words)):
            states = self.step(states, words[i])
            if not states:
                break
            if self.end in states:
                best = i + 1
        return best

    def matches(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Accepted runs from left to right, each as long as can be, without overlaps."""
        out, i = [], 0
        while i < len(words):
            end = self.longest(words, i) if self.open_start or words[i] in self.first else -1
            if end > i:
                out.append((i, end))
                i = end
            else:
                i += 1
        return out


@lru_cache(maxsize=1)
def automata() -> list[tuple[str, Automaton]]:
    return [(label, Automaton(t)) for label, texts in TEMPLATES.items() for t in texts]


def base_places(words: list[bytes], present: set[bytes]) -> list[tuple[int, int, str]]:
    """(start, end, label) of every place of a base phrase."""
    out = []
    for phrase, label in PHRASES.items():
        p = phrase.encode().split()
        if present.issuperset(p):
            out += [(i, i + len(p), label) for i in range(len(words) - len(p) + 1) if words[i] == p[0] and words[i : i + len(p)] == p]
    return sorted(out)


def scan_words(words: list[bytes]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base places and accepted template runs of a text."""
    present = set(words)
    runs = []
    for label, a in automata():
        if a.mandatory <= present:
            runs += [(s, e, label) for s, e in a.matches(words)]
    return base_places(words, present), sorted(runs)


SCHEMA = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string,"
    " score double, base array<struct<start:bigint,stop:bigint,label:string>>, runs array<struct<start:bigint,stop:bigint,label:string>>"
)
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("label", pa.string())]))
_ARROW = pa.schema(
    [("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")],
     ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("base", _SPAN), ("runs", _SPAN)]
)


def _scan(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for text in batch.column("text").to_pylist():
        words = words_of(text)
        base, runs = scan_words(words)
        covered, upto = 0, 0
        for s, e, _ in sorted(base + runs):
            covered += max(0, e - max(s, upto))
            upto = max(upto, e)
        own = {x[2] for x in base}
        rows.append(
            (len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(own)),
             ",".join(sorted(own | {x[2] for x in runs})), covered / len(words) if words else 0.0,
             [dict(start=s, stop=e, label=x) for s, e, x in base], [dict(start=s, stop=e, label=x) for s, e, x in runs])
        )
    columns = list(zip(*rows)) if rows else [[]] * (len(_ARROW) - 1)
    arrays = [pa.array(c, f.type) for c, f in zip(columns, list(_ARROW)[1:])]
    return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *arrays], schema=_ARROW)


def scan_licenses(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Labels and places per document: base phrases, accepted template runs, and their share of the words.

    ``score`` is the share of words inside a base phrase or an accepted run, 0 for no words.
    """
    return map_batches(docs.select(F.col(id).cast("bigint").alias("doc_id"), as_bytes(F.col(text)).alias("text")), _scan, SCHEMA)
