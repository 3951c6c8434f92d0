"""License statements: exact phrases, and an exact set-similarity join with templates."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.scratch import map_arrow
from plumbline.llm.vectors import LOWER, Docs, slices, spans, words

#: Phrases and the labels they give wherever they stand.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Statements whose words a block must contain, and their labels.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
#: Share of a template's words that a block must contain.
CONTAINMENT = 0.95


class Vocabulary(NamedTuple):
    """The templates' words and the phrases' words, by hash."""

    hashes: np.ndarray  # sorted
    names: list[str]  # in the same order
    sieve: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Vocabulary:
        names = sorted({w for t in texts for w in t.split()})
        found = [words(d).hash for d in slices(pa.array(names, pa.large_string()), 1 << 16)]
        hashes = np.concatenate(found) if found else np.empty(0, np.uint64)
        order = np.argsort(hashes)
        sieve = np.zeros(1 << 16, dtype=bool)
        sieve[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
        return cls(hashes[order], [names[i] for i in order], sieve)

    def find(self, data: np.ndarray, w) -> tuple[np.ndarray, np.ndarray]:
        """Positions of words that belong to the vocabulary, and their number in it; compared byte by byte."""
        at = np.flatnonzero(self.sieve[(w.hash & np.uint64(0xFFFF)).astype(np.int64)])
        number = np.minimum(np.searchsorted(self.hashes, w.hash[at]), len(self.names) - 1)
        same = self.hashes[number] == w.hash[at]
        at, number = at[same], number[same]
        low = LOWER[data].tobytes()
        exact = [low[w.start[i] : w.end[i]] == self.names[k].encode() for i, k in zip(at.tolist(), number.tolist(), strict=True)]
        return at[exact], number[exact]


def _blocks(docs: Docs) -> tuple[np.ndarray, np.ndarray]:
    """Text blocks: lines that are not empty, as byte spans."""
    return spans(docs.data != 10, docs.at)


class Templates:
    """Template sets, their words ordered by how many blocks of the corpus have them, rarest first."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[str, int], containment: float, wrapped: bool = False) -> None:
        self.vocabulary = Vocabulary.of([*(t for _, t in templates), *PHRASES])
        number = {name: i for i, name in enumerate(self.vocabulary.names)}
        self.labels = [label for label, _ in templates]
        # The global order: words by how many blocks have them, rarest first.
        self.order = np.array(sorted(number.values(), key=lambda k: (frequency.get(self.vocabulary.names[k], 0), k)), dtype=np.int64)
        rank = np.argsort(self.order)
        sets = [sorted({number[w] for w in text.split()}, key=lambda k: rank[k]) for _, text in templates]
        self.size = np.array([len(s) for s in sets])
        # Words of a window: as many as the template's, and as much slack as the containment leaves.
        self.window = [math.ceil(len(text.split()) / containment - 1e-9) if wrapped else 0 for _, text in templates]
        self.need = np.array([math.ceil(len(s) * containment - 1e-9) for s in sets])
        # place[t, w]: position of word w in the order of template t, or past its end.
        self.place = np.full((len(sets), len(number)), 1 << 20)
        for t, s in enumerate(sets):
            self.place[t, s] = np.arange(len(s))
        self.has = self.place < self.size[:, None]
        # Prefix filter: a block that contains need words has one of the first size - need + 1.
        self.prefix = self.place < (self.size - self.need + 1)[:, None]
        self.rare = self.prefix.any(axis=0)
        self.phrases = [([number[w] for w in p.split()], label) for p, label in PHRASES.items()]

    def _windows(self, t: int, window: int, at: np.ndarray, number: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """How many words of template t stand in the window of a text that ends at each place, 0 where no prefix word is near."""
        share = np.zeros(at.size, np.int64)
        mine = np.flatnonzero(self.has[t][number])
        rare = at[mine[self.prefix[t][number[mine]]]]
        # Prefix filter: only windows that can reach a prefix word.
        near = np.searchsorted(rare, at[mine] + window, "left") > np.searchsorted(rare, at[mine] - window, "right")
        mine = mine[near]
        first = np.maximum(at[mine] - window + 1, floor[mine])
        for w in np.flatnonzero(self.has[t]).tolist():
            last = np.maximum.accumulate(np.where(number[mine] == w, at[mine], -1)) if mine.size else first
            share[mine] += last >= first
        return share

    def match(self, docs: Docs) -> dict[str, list]:
        w = words(docs)
        at, number = self.vocabulary.find(docs.data, w)
        n, doc = docs.n, np.searchsorted(w.at, at, "right") - 1
        labels: list[set[str]] = [set() for _ in range(n)]
        base: list[set[str]] = [set() for _ in range(n)]
        starts: list[list[int]] = [[] for _ in range(n)]
        score = np.zeros(n)
        for word, label in self.phrases:
            k = len(word)
            hit = np.ones(max(at.size - k + 1, 0), dtype=bool)
            for j in range(k):
                hit &= (number[j : j + hit.size] == word[j]) & (at[j : j + hit.size] == at[: hit.size] + j) & (doc[j : j + hit.size] == doc[: hit.size])
            for i in np.flatnonzero(hit).tolist():
                base[doc[i]].add(label)
                starts[doc[i]].append(int(at[i] - w.at[doc[i]]))
                score[doc[i]] = 1.0
        begin, end = _blocks(docs)
        block = np.searchsorted(begin, w.start[at], "right") - 1
        rare = np.unique(block[self.rare[number]])
        if rare.size:
            near = np.isin(block, rare)
            pair = np.unique(np.stack([np.searchsorted(rare, block[near]), number[near]]), axis=1)
            inside = np.zeros((rare.size, len(self.vocabulary.names)), dtype=bool)
            inside[pair[0], pair[1]] = True
            # Length filter: a block of fewer words than needed can't contain them.
            length = np.searchsorted(w.start, end[rare]) - np.searchsorted(w.start, begin[rare])
            of = np.searchsorted(docs.at, begin[rare], "right") - 1
            ordered = inside[:, self.order]
            ahead = ordered[:, ::-1].cumsum(axis=1)[:, ::-1]  # words of a block from each place of the global order on
            for t in range(self.size.size):
                some = np.flatnonzero((inside & self.prefix[t]).any(axis=1) & (length >= self.need[t]))
                if not some.size:
                    continue
                # Positional filter: after the first word that both have, neither side may be short of words.
                first = (ordered[some] & self.has[t][self.order]).argmax(axis=1)
                left = np.minimum(self.size[t] - self.place[t, self.order[first]], ahead[some, first])
                some = some[left >= self.need[t]]
                overlap = (inside[some] & self.has[t]).sum(axis=1)
                for r, o in zip(some.tolist(), overlap.tolist(), strict=True):
                    score[of[r]] = max(score[of[r]], o / self.size[t])
                    if o >= self.need[t]:
                        labels[of[r]].add(self.labels[t])
        for t, window in enumerate(self.window):
            if not window:
                continue
            share = self._windows(t, window, at, number, w.at[doc])
            met = np.flatnonzero(share)
            np.maximum.at(score, doc[met], share[met] / self.size[t])
            for i in np.unique(doc[share >= self.need[t]]).tolist():
                labels[i].add(self.labels[t])
        return {
            "n_words": np.diff(w.at),
            "n_base": [len(s) for s in starts],
            "first_word": [min(s, default=None) for s in starts],
            "last_word": [max(s, default=None) for s in starts],
            "base_labels": [",".join(sorted(b)) for b in base],
            "labels": [",".join(sorted(a | b)) for a, b in zip(labels, base, strict=True)],
            "score": score,
        }


def template_frequencies(docs: DataFrame, templates: list[tuple[str, str]], text: str = "text") -> dict[str, int]:
    """In how many blocks of all texts each word of the templates stands; as many rows as the templates have words."""
    vocabulary = Vocabulary.of([t for _, t in templates])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary.names), dtype=np.int64)
        for batch in batches:
            for part in slices(batch.column(0)):
                w = words(part)
                at, number = vocabulary.find(part.data, w)
                block = np.searchsorted(_blocks(part)[0], w.start[at], "right")
                total += np.bincount(np.unique(np.stack([block, number]), axis=1)[1], minlength=total.size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([vocabulary.names[i] for i in some], pa.string()), pa.array(total[some])], names=["word", "n"])

    counts = map_arrow(docs.select(text), count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r.word: r.n for r in counts.collect()}


def license_scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", templates: list[tuple[str, str]] | None = None, containment: float = CONTAINMENT, wrapped: bool = False) -> DataFrame:
    """License phrases and statements in every whole text, a row for each row of docs.

    Returns doc_id, n_words, n_base (places of phrases), first_word, last_word
    (their smallest and largest start, else null), base_labels, labels (the
    phrases' and those of templates whose words a line contains to the threshold
    `containment`), score (1 with a phrase, else the best containment among the
    blocks that pass the filters of the join). With wrapped, statements that run
    over several lines count too: a run of words about as long as the template
    is then a block as well as each line. Null and empty texts have no words and
    no labels; long ones are read whole, in a slice of their own; labels that
    tie are all given; repeated rows get equal results; an empty table gives an
    empty one; other columns are not read.

    Two passes: block frequencies of the templates' words over all texts (a row
    for each word and task), then the join. The templates are a fixed, small list.
    """
    templates = TEMPLATES if templates is None else templates
    table = Templates(templates, template_frequencies(docs, templates, text), containment, wrapped)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                found = shared.value.match(part)
                columns = [pa.array(found[name], kind) for name, kind in kinds.items()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, part.n), *columns], names=["doc_id", *kinds])

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_arrow(docs.select(doc_id, text), scan, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
