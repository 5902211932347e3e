"""Licence notices in texts: matching statistics against a generalised suffix automaton of notice templates, chained into spans.

The automaton holds every run of words of every template. Reading a text, its state is the longest run that ends at the present word,
so one pass gives each template's matches that cannot be made longer. Matches of a template that follow one another closely in text and
template are chained, and a chain that covers enough of the template is a span of the text.
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect_left, bisect_right
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .store import map_texts

#: Phrases that name a licence, and their labels
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Public licence notices, by label
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": (
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software.",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 "
        "of the License, or (at your option) any later version.",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version.",
    ),
    "lgpl-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either "
        "version 2.1 of the License, or (at your option) any later version.",
    ),
    "agpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version.",
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain "
        "the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain "
        "the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be "
        "used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies.",
    ),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",),
    "cc-by-4.0": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc-by-sa-4.0": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",),
}

#: Words of the shortest match that is looked at, of the widest gap within a span, and the share of a template that a span must cover
LEAST, GAP, SHARE = 4, 12, 0.75
#: Score of a text that names a licence without the words of a notice
NAMED = 0.5
#: Bytes of a text that are cut into words at a time
PIECE = 1 << 20

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Match(NamedTuple):
    """A run of ``length`` words that ends before word ``end`` of the text and before word ``at`` of a template."""

    end: int
    at: int
    length: int


class Span(NamedTuple):
    label: str
    first: int
    last: int
    covered: int
    share: float


class Automaton:
    """Suffix automaton of several sequences of numbers. State 0 is the empty run; ``link`` leads to the longest run that ends in more
    places, and ``places[s]`` has, for each sequence, where the state's longest run ends."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends = []
        for number, sequence in enumerate(sequences):
            last = 0
            for i, x in enumerate(sequence):
                last = self._extend(last, x)
                ends.append((last, number, i + 1))
        self.places: list[dict[int, list[int]]] = [{} for _ in self.next]
        for state, number, end in ends:
            while state > 0 and self.length[state] >= LEAST:
                self.places[state].setdefault(number, []).append(end)
                state = self.link[state]
        # per state: each sequence that ends here, by its longest run: (sequence, that run's most words, its state)
        self.seen: list[dict[int, tuple[int, int]]] = []
        for state in range(len(self.next)):
            found, at = {}, state
            while at > 0 and self.length[at] >= LEAST:
                for number in self.places[at]:
                    found.setdefault(number, (self.length[at], at))
                at = self.link[at]
            self.seen.append(found)

    def _add(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, before: int, x: int) -> int:
        """The state of ``before``'s longest run followed by ``x``, made if the edge leads to longer runs as well."""
        to = self.next[before][x]
        if self.length[to] == self.length[before] + 1:
            return to
        new = self._add(self.length[before] + 1, dict(self.next[to]), self.link[to])
        self.link[to] = new
        while before >= 0 and self.next[before].get(x) == to:
            self.next[before][x] = new
            before = self.link[before]
        return new

    def _extend(self, last: int, x: int) -> int:
        if x in self.next[last]:
            return self._split(last, x)
        new = self._add(self.length[last] + 1, {}, 0)
        while last >= 0 and x not in self.next[last]:
            self.next[last][x] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, x)
        return new

    def step(self, state: int, length: int, x: int) -> tuple[int, int]:
        """The longest run that ends with the next word: its state and length."""
        while state > 0 and x not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        if x not in self.next[state]:
            return 0, 0
        return self.next[state][x], length + 1

    def statistics(self, words: list[int]):
        """(state, length) after each word."""
        state = length = 0
        for x in words:
            state, length = self.step(state, length, x)
            yield state, length

    def matches(self, words: list[int], start: int, found: dict[int, list[Match]]) -> None:
        """Add each sequence's matches of LEAST words or more that cannot be made longer, in order of their ends. ``start`` is the
        number of the first of ``words`` in the text."""
        before: dict[int, tuple[int, int]] = {}
        for i, (state, length) in enumerate(itertools.chain(self.statistics(words), [(0, 0)])):
            now = {n: (min(length, most), at) for n, (most, at) in self.seen[state].items() if min(length, most) >= LEAST} if length >= LEAST else {}
            for n, (size, at) in before.items():
                # each place of the run in the sequence is a match, unless the word after it is the text's next one, too
                if now.get(n, (0, 0))[0] == size + 1:
                    longer = {e - 1 for e in self.places[now[n][1]][n]}
                    found.setdefault(n, []).extend(Match(start + i, e, size) for e in self.places[at][n] if e not in longer)
                else:
                    found.setdefault(n, []).extend(Match(start + i, e, size) for e in self.places[at][n])
            before = now


def chains(matches: list[Match], gap: int = GAP) -> list[tuple[int, int, int]]:
    """(first word, last word, words covered) of the best chain that ends with each match. A match follows another that ends before it
    in text and template, with no more than ``gap`` words between in either; words that both cover count once."""
    best: list[tuple[int, int]] = []
    ends = [m.end for m in matches]
    for j, m in enumerate(matches):
        covered, first = m.length, m.end - m.length
        for i in range(bisect_left(ends, first - gap), j):
            p = matches[i]
            if p.end < m.end and p.at < m.at and m.at - m.length - p.at <= gap:
                gain = best[i][0] + min(m.length, m.end - p.end, m.at - p.at)
                if gain > covered:
                    covered, first = gain, best[i][1]
        best.append((covered, first))
    return [(first, m.end - 1, covered) for m, (covered, first) in zip(matches, best, strict=True)]


class Scanner:
    """Finds phrases and template spans in texts."""

    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        pairs = [(label, text) for label, texts in templates.items() for text in texts]
        cut = [_WORD.findall(text.encode().lower()) for _, text in pairs]
        named = {tuple(_WORD.findall(p.encode().lower())): label for p, label in phrases.items()}
        self.numbers = {w: i + 1 for i, w in enumerate(dict.fromkeys(itertools.chain(*cut, *named)))}
        self.labels = [label for label, _ in pairs]
        sequences = [[self.numbers[w] for w in words] for words in cut]
        self.sizes = [len(s) for s in sequences]
        self.automaton = Automaton(sequences)
        self.phrases = {tuple(self.numbers[w] for w in words): label for words, label in named.items()}
        self.pairs = np.zeros((len(self.numbers) + 1,) * 2, bool)
        for s in sequences:
            self.pairs[s[:-1], s[1:]] = True

    def words(self, text: str) -> np.ndarray:
        """The number of each word, 0 for those of no template or phrase. The text is cut piece by piece, so its words are never held
        all at once."""
        data, parts, at = text.encode("utf-8", "surrogatepass").lower(), [], 0
        while at < len(data):
            end = at + PIECE
            if end < len(data):  # end a piece where a word ends
                word = _WORD.match(data, end)
                end = word.end() if word else end
            found = _WORD.findall(data, at, end)
            parts.append(np.fromiter(map(self.numbers.get, found, itertools.repeat(0)), np.int32, len(found)))
            at = end
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def named(self, words: np.ndarray) -> list[tuple[int, str]]:
        """(start, label) of each place of a phrase."""
        found = []
        for phrase, label in self.phrases.items():
            held = np.ones(max(0, len(words) - len(phrase) + 1), bool)
            for i, x in enumerate(phrase):
                held &= words[i : i + len(held)] == x
            found += [(int(i), label) for i in np.flatnonzero(held)]
        return sorted(found)

    def spans(self, words: np.ndarray) -> list[Span]:
        """Spans that cover enough of a template. Of spans that share words the one that covers most words stays, then most of its template;
        others stay beside it only if they are as good on the same words."""
        found: dict[int, list[Match]] = {}
        # a match lies within a stretch whose neighbouring words are neighbours in some template
        known = np.concatenate([[False], self.pairs[words[:-1], words[1:]], [False]]).astype(np.int8)
        edges = np.diff(known)
        for lo, hi in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
            if hi - lo + 1 >= LEAST:
                self.automaton.matches(words[lo : hi + 1].tolist(), lo, found)
        enough = []
        for n, matches in found.items():
            for first, last, covered in chains(sorted(matches)):
                if covered >= SHARE * self.sizes[n]:
                    enough.append(Span(self.labels[n], first, last, covered, covered / self.sizes[n]))
        kept: list[Span] = []
        taken: list[tuple[int, int, int, float]] = []  # disjoint, in order
        for span in sorted(enough, key=lambda s: (-s.covered, -s.share, s.first, s.last, s.label)):
            i = bisect_left(taken, (span.first,))
            i -= i > 0 and taken[i - 1][1] >= span.first
            j = bisect_right(taken, (span.last, 1 << 60))
            if i == j:
                taken.insert(i, span[1:])
            elif taken[i:j] != [span[1:]]:
                continue
            kept.append(span)
        return sorted(set(kept), key=lambda s: (s.first, s.last, s.label))


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long,covered:long,share:double>>"


def scan(docs: DataFrame, id_: str = "doc_id", text: str = "text", templates: dict[str, tuple[str, ...]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """The id with n_words, n_base, first_word, last_word, base_labels, labels, score and spans of every row.

    Phrases of ``phrases`` count wherever their words follow one another; ``labels`` adds those of the spans. The score is the largest
    share of a template that a span covers, NAMED at least where a phrase stands, else 0. A null or empty text has no words, no labels
    ('') and null first and last words. Rows are taken one by one: repeated rows give repeated rows, any id may be null, other columns
    take no part, and an empty table gives an empty result. Memory is four bytes a word of the longest text, besides the text itself.
    """
    def run(batches):
        scanner = Scanner(templates, phrases)
        for pdf in batches:
            rows = []
            for t in pdf[text]:
                words = scanner.words(t if isinstance(t, str) else "")
                named, spans = scanner.named(words), scanner.spans(words)
                base = {label for _, label in named}
                score = max([NAMED if named else 0.0, *(s.share for s in spans)])
                rows.append((
                    len(words), len(named), named[0][0] if named else None, named[-1][0] if named else None,
                    ",".join(sorted(base)), ",".join(sorted(base | {s.label for s in spans})), score, [s._asdict() for s in spans],
                ))
            out = pd.DataFrame(rows, columns="n_words n_base first_word last_word base_labels labels score spans".split())
            yield out.astype({"first_word": "Int64", "last_word": "Int64"}).assign(**{id_: pdf[id_].array})

    return map_texts(docs, run, SCHEMA, id_, text)
