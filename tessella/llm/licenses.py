"""License scans with a generalised suffix automaton of licence tokens.

One automaton holds the words of all templates and base phrases. Streaming a
document's words through it gives, at each word, the length of the longest
suffix that occurs in some template (matching statistics). The suffix links of
that state give, for each place in each template, how long the match ending
there is. Matches that can't be extended and are long enough are chained per
template: the best chain ending with a match is found from those before it
(dynamic programming over places in both texts), in order in both and with small
gaps in the document. A template covered well enough gives a span with its label.
"""

from bisect import bisect
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import bytes_udf, struct_array, words_of

# The base phrases with their labels.
BASE_PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Short texts of public licences, with the method's own labels.
TEMPLATES = (
    ("agpl-text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("all-rights-reserved", "All rights reserved."),
    ("apache-notice", "Licensed under the Apache License, Version 2.0"),
    ("apache-text", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc-notice", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-text", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-text", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0-text", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("epl-text", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("gpl-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl-text", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit-notice", "Released under the MIT License."),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-text", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense-text", "This is free and unencumbered software released into the public domain."),
    ("zlib-text", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
)

MIN_MATCH = 3
MAX_GAP = 4
MIN_COVER = 0.8
RESULT = (
    "struct<n_words:bigint,base:array<struct<first:int,label:string>>,"
    "spans:array<struct<first:int,last:int,label:string,cover:double>>,cover:double>"
)


@dataclass
class _State:
    length: int
    link: int
    to: dict[int, int] = field(default_factory=dict)
    ends: set[tuple[int, int]] = field(default_factory=set)  # (template, where it ends there)
    suffixes: list[tuple[tuple[int, int], int]] = field(default_factory=list)  # further ends, of its suffixes, with their lengths
    phrases: list[tuple[int, int]] = field(default_factory=list)  # (words, phrase) that end here


class SuffixAutomaton:
    """Generalised suffix automaton over the word ids of several templates.

    Suffixes below ``least`` words are not listed as ends.
    """

    def __init__(self, templates: list[list[bytes]], phrases: list[list[bytes]], least: int = 1):
        self.ids: dict[bytes, int] = {}
        self.states = [_State(0, -1)]
        self.sizes = [len(t) for t in templates]
        for number, words in enumerate([*templates, *phrases]):
            at = 0
            for end, word in enumerate(words):
                at = self._extend(at, self.ids.setdefault(word, len(self.ids)))
                if number < len(templates):
                    self.states[at].ends.add((number, end))
        longest_first = sorted(range(1, len(self.states)), key=lambda s: -self.states[s].length)
        for s in longest_first:
            self.states[self.states[s].link].ends |= self.states[s].ends
        for number, words in enumerate(phrases):
            at = 0
            for word in words:
                at = self.states[at].to[self.ids[word]]
            self.states[at].phrases.append((len(words), number))
        for s in reversed(longest_first):
            state, link = self.states[s], self.states[self.states[s].link]
            state.phrases = state.phrases + link.phrases
            if link.length >= least:
                state.suffixes = [(e, link.length) for e in sorted(link.ends - state.ends)] + link.suffixes

    def _clone(self, parent: int, old: int, symbol: int) -> int:
        states = self.states
        copy = len(states)
        states.append(_State(states[parent].length + 1, states[old].link, dict(states[old].to)))
        states[old].link = copy
        while parent >= 0 and states[parent].to.get(symbol) == old:
            states[parent].to[symbol] = copy
            parent = states[parent].link
        return copy

    def _extend(self, last: int, symbol: int) -> int:
        """State of the text read so far plus ``symbol``."""
        states = self.states
        known = states[last].to.get(symbol)
        if known is not None:
            return known if states[known].length == states[last].length + 1 else self._clone(last, known, symbol)
        new = len(states)
        states.append(_State(states[last].length + 1, 0))
        p = last
        while p >= 0 and symbol not in states[p].to:
            states[p].to[symbol] = new
            p = states[p].link
        if p >= 0:
            q = states[p].to[symbol]
            states[new].link = q if states[q].length == states[p].length + 1 else self._clone(p, q, symbol)
        return new

    def statistics(self, words: list[bytes]):
        """Yield (position, state, matched length) wherever the match is not empty."""
        states, at, length = self.states, 0, 0
        for where, symbol in enumerate(map(self.ids.get, words)):
            if symbol is None:
                at = length = 0
                continue
            while at and symbol not in states[at].to:
                at = states[at].link
                length = states[at].length
            if symbol in states[at].to:
                at, length = states[at].to[symbol], length + 1
                yield where, at, length
            else:
                at = length = 0


class Match(NamedTuple):
    """``length`` words of a template, ending at ``end`` there and at ``last`` in the document."""

    last: int
    end: int
    length: int


class LicenseScanner:
    def __init__(self, templates=TEMPLATES, phrases=BASE_PHRASES, min_match=MIN_MATCH, max_gap=MAX_GAP, min_cover=MIN_COVER):
        self.labels = [label for label, _ in templates]
        self.base_labels = [label for _, label in phrases]
        self.min_match, self.max_gap, self.min_cover = min_match, max_gap, min_cover
        self.automaton = SuffixAutomaton(
            [words_of(t.encode()) for _, t in templates], [words_of(p.encode()) for p, _ in phrases], min_match
        )

    def scan(self, text: bytes):
        """Number of words, base places (first word, label), covered spans, best cover of any template."""
        words = words_of(text)
        base, matches = self.find(words)
        spans, best = [], 0.0
        for template, found in matches.items():
            size, ending = self.automaton.sizes[template], self.chains(found)
            best = max(best, max(covered for covered, *_ in ending) / size)
            ending = [c for c in ending if c[0] / size >= self.min_cover]
            spans += [(first, last + 1, self.labels[template], covered / size) for covered, first, last in disjoint(ending)]
        return len(words), base, sorted(spans), best

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, str]], dict[int, list[Match]]]:
        """Base places, and for each template its matches that can't be extended, by their last word."""
        states, least = self.automaton.states, self.min_match
        base: list[tuple[int, str]] = []
        matches: dict[int, list[Match]] = {}
        going: dict[tuple[int, int], int] = {}  # (template, end) of the matches at the word before

        def close(where: int, now: dict) -> None:
            for (template, end), length in going.items():
                if (template, end + 1) not in now:
                    matches.setdefault(template, []).append(Match(where, end, length))

        before = -2
        for where, state, length in self.automaton.statistics(words):
            at = states[state]
            for size, phrase in at.phrases:
                if size <= length:
                    base.append((where - size + 1, self.base_labels[phrase]))
            if length < least:
                continue
            if going and before != where - 1:
                close(before, {})
                going = {}
            now = dict.fromkeys(at.ends, length)
            now.update(at.suffixes)
            close(before, now)
            going, before = now, where
        close(before, {})
        return base, matches

    def chains(self, matches: list[Match]) -> list[tuple[int, int, int]]:
        """(words covered, first word, last word) of the best chain that ends with each match.

        A chain takes matches in order in both texts; of a match that overlaps
        the one before only the words after it count. At most ``max_gap`` words
        of the document lie between two.
        """
        gap = self.max_gap
        reach = gap + max(length for _, _, length in matches)
        best: list[tuple[int, int, int]] = []
        oldest = 0
        for i, (last, end, length) in enumerate(matches):
            while last - matches[oldest].last > reach:
                oldest += 1
            covered, first = length, last - length + 1
            for j in range(oldest, i):
                before_last, before_end, _ = matches[j]
                fresh = min(length, last - before_last, end - before_end)
                if fresh > 0 and last - fresh - before_last <= gap and (best[j][0] + fresh, best[j][1]) > (covered, first):
                    covered, first = best[j][0] + fresh, best[j][1]
            best.append((covered, first, last))
        return best


def disjoint(chains: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those that overlap none picked before, picked by falling cover; of equals the shorter, then the earlier."""
    taken: list[tuple[int, int, int]] = []  # (first, last, covered), in order
    for covered, first, last in sorted(chains, key=lambda c: (-c[0], c[2] - c[1], c[1])):
        at = bisect(taken, (first, last, covered))
        if (at == 0 or taken[at - 1][1] < first) and (at == len(taken) or taken[at][0] > last):
            taken.insert(at, (first, last, covered))
    return [(covered, first, last) for first, last, covered in taken]


_SCANNERS: dict[tuple, LicenseScanner] = {}


def scan_licenses(
    docs: DataFrame,
    templates=TEMPLATES,
    phrases=BASE_PHRASES,
    text_col: str = "text",
    out_col: str = "licenses",
    min_match: int = MIN_MATCH,
    max_gap: int = MAX_GAP,
    min_cover: float = MIN_COVER,
) -> DataFrame:
    """``docs`` with a struct: n_words, base phrase places, covered template spans, cover.

    ``cover`` is the largest share of any template that one chain covers, also
    below ``min_cover``. Null and empty texts have no words, places or spans and
    cover 0. Overlapping places all count. Licences that share most words, as
    those of one family do, may both give a span at the same place. Templates are a parameter of fixed size, not data, so the automaton
    is built in each Python worker; there is no shuffle.
    """
    key = (tuple(templates), tuple(phrases), min_match, max_gap, min_cover)
    place = pa.list_(pa.struct([("first", pa.int32()), ("label", pa.string())]))
    span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("label", pa.string()), ("cover", pa.float64())]))

    def batch(texts: list[bytes]) -> pa.Array:
        if key not in _SCANNERS:
            _SCANNERS[key] = LicenseScanner(*key)
        found = [_SCANNERS[key].scan(t) for t in texts]
        return struct_array(
            [
                ("n_words", pa.int64(), [n for n, *_ in found]),
                ("base", place, [[{"first": a, "label": b} for a, b in sorted(x)] for _, x, *_ in found]),
                ("spans", span, [[dict(zip(("first", "last", "label", "cover"), s)) for s in x] for _, _, x, _ in found]),
                ("cover", pa.float64(), [c for *_, c in found]),
            ]
        )

    return docs.withColumn(out_col, bytes_udf(batch, RESULT)(F.col(text_col)))
