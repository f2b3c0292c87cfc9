"""License scans with a positional index of rare words.

Templates are short passages of licences; each names its label and the phrases without which
it doesn't hold.  The index lists, for every licence word, the templates and places where it
stands.  Words get weights by inverse document frequency, counted over all documents.

For a file, each template looks up the highest-weighted of its words that the file holds.  A
place in the file minus a place in the template is a relative position: postings of different
words that agree on it, give or take ``SLACK`` words, are intersected, and what is left are
alignments.  An alignment counts if every mandatory phrase stands in its stretch of the file;
its score is the weighted share of the template's words found in their places.

Next to that, base phrases are searched at every place, and they give their labels wherever
they stand.

Edge cases: a null text is empty; ids may be null or repeat: each row is judged on its own;
whole texts are read, in slices, as one number a word; ties of weights go to the smaller word;
a file without licence words has a score of 0 and an empty list of labels; an empty table gives
no rows, and only doc_id and text are read of a table.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.runtime import bound_batches

#: Words once A-Z are lower-cased, in UTF-8: digits, letters, and all beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BREAK = re.compile(rb"[^0-9a-z\x80-\xff]")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
CUT = 1 << 20

#: Phrases that give a label wherever their words stand next to each other.
BASE_PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Fixed values: (label, mandatory phrases, passage), in the wording of the licences and of the
#: notices that go with them.
TEMPLATES = [
    ("mit", ["mit license"], "released under the MIT License"),
    ("mit", ["permission is hereby granted", "without restriction"], "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", ["apache license"], "licensed under the Apache License, Version 2.0"),
    ("apache", ["apache org licenses license 2 0"], "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", ["general public license"], "licensed under the GNU General Public License, version 3"),
    ("gpl", ["gnu general public license"], "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl", ["lesser general public license"], "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", ["affero general public license"], "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", ["redistribution and use in source and binary forms"], "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", ["bsd license"], "released under the BSD License"),
    ("isc", ["permission to use copy modify"], "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", ["mozilla public license"], "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("epl", ["eclipse public license"], "made available under the terms of the Eclipse Public License 2.0"),
    ("unlicense", ["released into the public domain"], "This is free and unencumbered software released into the public domain"),
    ("zlib", ["provided as is", "freely subject to the following restrictions"], "This software is provided 'as-is', without any express or implied warranty. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("boost", ["boost software license"], "Distributed under the Boost Software License, Version 1.0"),
    ("cc0", ["cc0"], "dedicated to the public domain under CC0 1.0 Universal"),
    ("cc-by", ["cc by 4 0"], "licensed under CC BY 4.0"),
    ("cc-by", ["creative commons attribution 4 0"], "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", ["cc by sa"], "licensed under CC BY-SA 4.0"),
    ("cc-by-sa", ["creative commons attribution sharealike"], "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", ["cc by nc"], "licensed under CC BY-NC 4.0"),
    ("cc-by-nc", ["creative commons attribution noncommercial"], "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd", ["cc by nd"], "licensed under CC BY-ND 4.0"),
    ("cc-by-nd", ["creative commons attribution noderivatives"], "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
]

#: Highest-weighted words a template looks up in a file, and how many of those it holds must
#: agree on a relative position.
RARE, AGREE = 6, 2
#: Words that may be missing or added between two words that agree.
SLACK = 2


def words_of(text: str) -> list[str]:
    return [w.decode("utf-8", "replace") for w in WORD.findall(text.encode("utf-8", "replace").translate(LOWER))]


@dataclass
class Template:
    label: str
    words: np.ndarray
    phrases: list[np.ndarray]
    #: Places of each word, and the words from the highest weight down.
    places: dict[int, np.ndarray]
    ranked: list[int]
    weights: np.ndarray


class Index:
    """Templates by words, with weights; built anew in every task from few numbers."""

    def __init__(self, templates, base, weights: dict[str, float]):
        texts = [(label, words_of(passage), [words_of(p) for p in phrases]) for label, phrases, passage in templates]
        self.base = [(label, words_of(p)) for p, label in base]
        known = {w for _, ws, ps in texts for w in [*ws, *(x for p in ps for x in p)]} | {w for _, ws in self.base for w in ws}
        self.vocabulary = sorted(known)
        self.number = {w.encode(): k for k, w in enumerate(self.vocabulary)}
        of = {w: k for k, w in enumerate(self.vocabulary)}
        weight = np.array([weights.get(w, 1.0) for w in self.vocabulary])
        self.base = [(label, np.array([of[w] for w in ws])) for label, ws in self.base]
        self.templates = []
        for label, ws, ps in texts:
            ids = np.array([of[w] for w in ws])
            ranked = sorted(set(ids.tolist()), key=lambda k: (-weight[k], k))
            self.templates.append(Template(label, ids, [np.array([of[w] for w in p]) for p in ps], {k: np.flatnonzero(ids == k) for k in ranked}, ranked, weight[ids]))

    def numbers(self, text: str) -> np.ndarray:
        """Each word of a text as its number, -1 for words of no licence."""
        raw = text.encode("utf-8", "replace").translate(LOWER)
        get, at, parts = self.number.get, 0, []
        while at < len(raw):
            cut = BREAK.search(raw, at + CUT) if at + CUT < len(raw) else None
            end = cut.end() if cut else len(raw)
            found = WORD.findall(raw[at:end])
            parts.append(np.fromiter((get(w, -1) for w in found), np.int32, len(found)))
            at = end
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def phrase_places(ids: np.ndarray, phrase: np.ndarray, spots: dict[int, np.ndarray]) -> np.ndarray:
    """Where a phrase's words stand next to each other."""
    at = spots.get(int(phrase[0]), np.zeros(0, np.int64))
    at = at[at + len(phrase) <= len(ids)]
    for k, word in enumerate(phrase[1:].tolist(), 1):
        at = at[ids[at + k] == word]
    return at


def alignments(template: Template, spots: dict[int, np.ndarray]) -> np.ndarray:
    """Relative positions on which the template's rarest words of the file agree."""
    rare = [w for w in template.ranked if w in spots][:RARE]
    need = min(AGREE, len(template.ranked))
    if len(rare) < need:
        return np.zeros(0, np.int64)
    offsets = [np.unique((spots[w][:, None] - template.places[w][None, :]).ravel()) for w in rare]
    every = np.unique(np.concatenate(offsets))
    agreeing = np.zeros(len(every), np.int64)
    for own in offsets:
        agreeing += np.searchsorted(own, every + SLACK, "right") > np.searchsorted(own, every - SLACK, "left")
    return every[agreeing >= need]


def shares(template: Template, ids: np.ndarray, starts: np.ndarray) -> float:
    """The largest weighted share of the template's words found in their places."""
    best, total = 0.0, float(template.weights.sum())
    step = max(1, (1 << 20) // len(template.words))
    for a in range(0, len(starts), step):
        some = starts[a : a + step]
        hit = np.zeros((len(some), len(template.words)), bool)
        for shift in range(-SLACK, SLACK + 1):
            at = some[:, None] + np.arange(len(template.words)) + shift
            inside = (at >= 0) & (at < len(ids))
            hit |= inside & (ids[np.clip(at, 0, len(ids) - 1)] == template.words)
        best = max(best, float((hit @ template.weights).max()) / total)
    return min(best, 1.0)


def scan(index: Index, text: str) -> tuple[int, int, int | None, int | None, list[str], list[str], float]:
    """(words, base places, first and last of them, base labels, all labels, score) of a text."""
    ids = index.numbers(text)
    licence = np.flatnonzero(ids >= 0)
    order = licence[np.argsort(ids[licence], kind="stable")]
    names, start = np.unique(ids[order], return_index=True)
    spots = dict(zip(names.tolist(), np.split(order, start[1:]))) if len(names) else {}
    places, labels, score = [], set(), 0.0
    for label, phrase in index.base:
        at = phrase_places(ids, phrase, spots)
        if len(at):
            places.append(at)
            labels.add(label)
    found = set(labels)
    for template in index.templates:
        if any(int(w) not in spots for phrase in template.phrases for w in phrase):
            continue
        starts = alignments(template, spots)
        for phrase in template.phrases:
            at = phrase_places(ids, phrase, spots)
            low = np.searchsorted(at, starts - SLACK, "left")
            high = np.searchsorted(at, starts + len(template.words) + SLACK - len(phrase), "right")
            starts = starts[high > low]
        if len(starts):
            found.add(template.label)
            score = max(score, shares(template, ids, starts))
    if places:
        # A base phrase is found as a whole.
        score = 1.0
    every = np.concatenate(places) if places else np.zeros(0, np.int64)
    ends = (int(every.min()), int(every.max())) if len(every) else (None, None)
    return len(ids), len(every), *ends, sorted(labels), sorted(found), score


def _texts(docs: DataFrame) -> DataFrame:
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def word_weights(docs: DataFrame, templates=TEMPLATES, base=BASE_PHRASES) -> dict[str, float]:
    """Inverse document frequencies of all licence words, over all documents: as many numbers
    as the templates have words."""

    def run(batches):
        index = Index(templates, base, {})
        held, docs_seen = np.zeros(len(index.vocabulary), np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                ids = np.unique(index.numbers(text.as_py()))
                held[ids[ids >= 0]] += 1
                docs_seen += 1
        yield pa.RecordBatch.from_arrays([pa.array([*index.vocabulary, None], pa.string()), pa.array([*held.tolist(), docs_seen], pa.int64())], names=["word", "n"])

    rows = _texts(docs).select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {r.word: r.n for r in rows}
    total = n.pop(None, 0)
    return {w: math.log((total + 1) / (k + 1)) + 1.0 for w, k in n.items()}


def scan_licenses(docs: DataFrame, templates=TEMPLATES, base=BASE_PHRASES, weights: dict[str, float] | None = None) -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    weights = word_weights(docs, templates, base) if weights is None else weights

    def run(batches):
        index = Index(templates, base, weights)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = [scan(index, t.as_py()) for t in part.column("text")]
                n, k, first, last, own, every, score = zip(*rows)
                out = [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in (n, k, first, last)), *(pa.array([",".join(x) for x in c], pa.string()) for c in (own, every)), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
