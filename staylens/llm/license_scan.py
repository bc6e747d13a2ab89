"""Licence scan: a generalised suffix automaton of licence texts, streamed over the words of documents.

The automaton recognises every run of words that occurs in some template.  A document's words
go through it one by one, which gives matching statistics: at each word the longest run ending
there that some template holds.  Runs of at least ``MIN_MATCH`` words that cannot be extended
are anchors at all their places in the templates; anchors that follow each other both in a
template and, within ``MAX_GAP`` words, in the document are chained, and a chain covers a span
of the document and a share of the template's words.  A template whose share reaches
``MIN_SHARE`` gives its label.  The base, places where the words of a phrase stand one after
another, is found besides, and its labels are kept.

The automaton is built from the small template table and travels with the tasks; documents
are not shuffled.  Only stretches of words that templates know are streamed.

Edge cases.  Null texts are empty: no words, no places, empty labels, score 0.  A word is never
cut; documents of any length are read in pieces and chained as a whole.  Rows are independent,
so repeated rows, null or equal ids give a row each, and further columns are not read.  Of
chains with equal cover the one that ends first is taken; an empty template table leaves the base.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.terms import ALNUM, as_binary, parts, runs, word_pieces

MIN_MATCH = 4
MAX_GAP = 12
MIN_SHARE = 0.6

# fixed values: the phrases of the base and their labels
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# fixed values: wording of public licences, (label, text)
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction, including without limitation the rights to "
            "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
            "persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
               "http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
            "option) any later version."),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc", "Licensed under CC BY 4.0."), ("cc", "Licensed under CC BY-SA 4.0."), ("cc", "Licensed under CC BY-NC 4.0."),
    ("cc", "Licensed under CC BY-ND 4.0."), ("cc", "Licensed under CC BY-NC-SA 4.0."),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)


def words_of(text: str) -> list[bytes]:
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    values, offsets, _, _, _ = runs(raw, np.array([0, len(raw)]), ALNUM)
    return as_binary(values, offsets).to_pylist()


# --- the automaton ---------------------------------------------------------------------

@dataclass
class Automaton:
    """Generalised suffix automaton over word numbers; state 0 is the empty run."""

    length: list[int] = field(default_factory=lambda: [0])
    link: list[int] = field(default_factory=lambda: [-1])
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    ends: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])     # (template, words before its end)
    children: list[list[int]] = field(default_factory=list)
    found: dict[int, list[tuple[int, int]]] = field(default_factory=dict)

    def _state(self, length: int, link: int, step: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.step.append(step)
        self.ends.append([])
        return len(self.length) - 1

    def _split(self, p: int, word: int) -> int:
        """The state that ``p`` reaches by ``word`` with exactly one word more than ``p``, made if need be."""
        q = self.step[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._state(self.length[p] + 1, self.link[q], dict(self.step[q]))
        self.link[q] = twin
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = twin
            p = self.link[p]
        return twin

    def add(self, template: int, words: list[int]) -> None:
        last = 0
        for at, word in enumerate(words):
            if word in self.step[last]:                  # known from a template before
                last = self._split(last, word)
            else:
                new, p = self._state(self.length[last] + 1, 0, {}), last
                while p >= 0 and word not in self.step[p]:
                    self.step[p][word] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, word)
                last = new
            self.ends[last].append((template, at + 1))

    def close(self) -> Automaton:
        self.children = [[] for _ in self.length]
        for state, link in enumerate(self.link):
            if link >= 0:
                self.children[link].append(state)
        return self

    def places(self, state: int) -> list[tuple[int, int]]:
        """All (template, end) at which the runs of a state stand."""
        if state not in self.found:
            out, stack = [], [state]
            while stack:
                s = stack.pop()
                out += self.ends[s]
                stack += self.children[s]
            self.found[state] = sorted(out)
        return self.found[state]

    def statistics(self, words: list[int]):
        """(longest run of the templates that ends at each word, its state)."""
        state = size = 0
        for w in words:
            while state and w not in self.step[state]:
                state = self.link[state]
                size = self.length[state]
            if w in self.step[state]:
                state = self.step[state][w]
                size += 1
            yield size, state

    def anchors(self, words: list[int], least: int, start: int = 0):
        """(template, start in the document, start in the template, words) of runs that cannot be extended."""
        held = None
        for at, (size, state) in enumerate(self.statistics(words)):
            if held and size <= held[0]:
                yield from self._placed(*held, start + at)
            held = (size, state) if size >= least else None
        if held:
            yield from self._placed(*held, start + len(words))

    def _placed(self, size, state, end):
        for template, stop in self.places(state):
            yield template, end - size, stop - size, size


def chains(anchors: list[tuple[int, int, int]], max_gap: int) -> list[tuple[int, int, int]]:
    """(first word, end word, template words covered) of the best chains of one template's anchors, which are
    (start in the document, start in the template, words) in document order; chains share no anchor."""
    score, before = [], []
    near: deque[int] = deque()
    for k, (d, t, n) in enumerate(anchors):
        while near and anchors[near[0]][0] + anchors[near[0]][2] + max_gap < d:
            near.popleft()
        best, via = n, -1
        for j in near:
            d0, t0, n0 = anchors[j]
            if d0 < d <= d0 + n0 + max_gap and t0 < t and d0 + n0 < d + n and t0 + n0 < t + n:
                gain = score[j] + n - max(0, d0 + n0 - d, t0 + n0 - t)
                if gain > best or (gain == best and via >= 0):       # of equals the nearest
                    best, via = gain, j
        score.append(best)
        before.append(via)
        near.append(k)
    out, used = [], set()
    for k in sorted(range(len(anchors)), key=lambda k: (-score[k], k)):
        path, at = [], k
        while at >= 0 and at not in used:
            path.append(at)
            at = before[at]
        if path:
            used.update(path)
            rest = score[at] if at >= 0 else 0           # what a better chain has taken
            out.append((anchors[path[-1]][0], max(anchors[x][0] + anchors[x][2] for x in path), score[k] - rest))
    return out


class Scanner:
    def __init__(self, templates, phrases, min_match: int, max_gap: int, min_share: float):
        self.templates = [(label, words_of(text)) for label, text in templates]
        self.phrases = [(label, words_of(text)) for text, label in phrases]
        known = sorted({w for _, ws in self.templates + self.phrases for w in ws})
        self.known, number = known, {w: i for i, w in enumerate(known)}
        self.phrase_ids = [(label, [number[w] for w in ws]) for label, ws in self.phrases]
        self.automaton = Automaton()
        for k, (_, ws) in enumerate(self.templates):
            self.automaton.add(k, [number[w] for w in ws])
        self.automaton.close()
        self.min_match, self.max_gap, self.min_share = min_match, max_gap, min_share

    def numbers(self, data, off):
        """(word numbers, -1 for unknown words; text of each word)."""
        import pyarrow as pa
        import pyarrow.compute as pc

        ids, ofs = [], []
        known = pa.array(self.known, pa.binary())
        for o in word_pieces(data, off, ALNUM):
            values, offsets, of, _, _ = runs(data, o, ALNUM)
            found = pc.fill_null(pc.index_in(as_binary(values, offsets), value_set=known), -1)
            ids.append(np.asarray(found).astype(np.int32))
            ofs.append(of)
        return (ids[0], ofs[0]) if len(ids) == 1 else (np.concatenate(ids), np.zeros(sum(map(len, ofs)), np.int64))

    def base(self, ids, of):
        """(text, first word in the buffer, label number) of the places of the phrases."""
        out = []
        for k, (_, phrase) in enumerate(self.phrase_ids):
            n = len(ids) - len(phrase) + 1
            if n > 0:
                ok = of[:n] == of[len(phrase) - 1:]
                for i, w in enumerate(phrase):
                    ok &= ids[i:i + n] == w
                at = np.flatnonzero(ok)
                out.append((of[at], at, np.full(len(at), k)))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3

    def spans(self, ids, of, first):
        """(text, template, first word, end word, share of the template) of the chains, words counted per text."""
        known = ids >= 0
        edge = np.diff(np.concatenate([[False], known, [False]]).astype(np.int8))
        border = np.zeros(len(ids) + 1, bool)
        border[first[(first > 0) & (first < len(ids))]] = True
        joint = border[:-1] & known & np.concatenate([[False], known[:-1]])       # a text ends within a stretch
        begin = np.union1d(np.flatnonzero(edge == 1), np.flatnonzero(joint))
        end = np.union1d(np.flatnonzero(edge == -1), np.flatnonzero(joint))
        long = end - begin >= self.min_match
        held: dict[tuple[int, int], list] = {}
        for a, b in zip(begin[long].tolist(), end[long].tolist()):
            text = int(of[a])
            for template, d, t, n in self.automaton.anchors(ids[a:b].tolist(), self.min_match, a - int(first[text])):
                held.setdefault((text, template), []).append((d, t, n))
        out = []
        for (text, template), found in sorted(held.items()):
            size = len(self.templates[template][1])
            out += [(text, template, a, b, n / size) for a, b, n in chains(sorted(found), self.max_gap)
                    if n / size >= self.min_share]
        return out

    def run(self, batches):
        import pyarrow as pa

        for batch in batches:
            for part, data, off in parts(batch):
                ids, of = self.numbers(data, off)
                first = np.searchsorted(of, np.arange(part.num_rows + 1))
                places: list[list] = [[] for _ in range(part.num_rows)]
                for text, at, k in sorted(zip(*(x.tolist() for x in self.base(ids, of)))):
                    places[text].append({"label": self.phrase_ids[k][0], "first": at - int(first[text])})
                spans: list[list] = [[] for _ in range(part.num_rows)]
                for text, template, a, b, share in self.spans(ids, of, first):
                    spans[text].append({"label": self.templates[template][0], "template": template, "first": a, "end": b,
                                        "share": share})
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(first).astype(np.int64)),
                     pa.array(places, pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64())]))),
                     pa.array(spans, pa.list_(pa.struct([("label", pa.string()), ("template", pa.int64()), ("first", pa.int64()),
                                                         ("end", pa.int64()), ("share", pa.float64())])))],
                    names=["doc_id", "n_words", "places", "spans"])


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, min_match: int = MIN_MATCH, max_gap: int = MAX_GAP,
         min_share: float = MIN_SHARE, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_words, places (label, first word) of the base phrases and spans (label, template, first word,
    end word, covered share) of the templates, for every row."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return src.mapInArrow(
        Scanner(templates, phrases, min_match, max_gap, min_share).run,
        "doc_id long, n_words long, places array<struct<label: string, first: long>>, "
        "spans array<struct<label: string, template: long, first: long, end: long, share: double>>")


def labelled(found: DataFrame) -> DataFrame:
    """One row a document: counts and labels of the base, labels of both, and ``score``, the largest covered
    share of a template, where a phrase of the base counts as a template that is covered in full."""
    def joined(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    base, more = F.col("places.label"), F.col("spans.label")
    share = F.coalesce(F.array_max("spans.share"), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.first").alias("first_word"), F.array_max("places.first").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, more)).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.least(share, F.lit(1.0))).alias("score"))
