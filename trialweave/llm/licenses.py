"""License scan with a positional rare-token index.

The index holds, for every template, the positions of its rarest words by IDF over the corpus (words
that at most ``common_share`` of the documents have). A file's hits on those words vote for (template,
file position minus template position). An alignment's place is a start that votes name, and its weight that of
the template's words that vote for starts within ``slack`` words of it; of places that near to each other the
heaviest stands. An alignment that reaches ``least_share`` of the template's IDF mass is a candidate, and it
counts if the template's mandatory key phrases stand around that place in the file. The score of a file is the largest share of any accepted template.

Words are runs of ASCII letters (lower-cased), digits and characters beyond ASCII. Nulls are empty
texts; a file without words has no labels and score 0. Every row is answered on its own; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .tokens import U, chunks, grams, tokenize

#: The phrases that name a licence, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Label, notice and mandatory key phrases of each template.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted", "without restriction")),
    ("apache", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("in compliance with the license", "apache")),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("general public license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("free software", "general public license")),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("lesser general public license",)),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ("affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use", "source and binary forms")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy", "with or without fee")),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain cc0 1 0 universal", ("cc0", "public domain")),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", ("eclipse public license",)),
)


def _hashes(text: str) -> np.ndarray:
    return tokenize(pa.array([text]), "alnum", lower=True).hash


class Index:
    """Templates' rare words with their positions, and the key phrases by length; a few hundred entries."""

    def __init__(self, weights: dict[int, float], common_share: float, docs: int, templates=TEMPLATES):
        self.labels = [t[0] for t in templates]
        words = [_hashes(t[1]) for t in templates]
        self.length = np.array([len(w) for w in words])
        limit = math.log((docs + 1) / (common_share * docs + 1)) if docs else 0.0
        post = []
        for k, w in enumerate(words):
            kept = [(int(h), k, p, weights[int(h)]) for p, h in enumerate(w) if weights[int(h)] >= limit]
            kept = kept or [(int(h), k, p, weights[int(h)]) for p, h in enumerate(w) if weights[int(h)] == max(weights[int(x)] for x in w)]
            post += kept
        post.sort()
        self.word = np.array([x[0] for x in post], U)
        self.template, self.place = np.array([x[1] for x in post]), np.array([x[2] for x in post])
        self.weight = np.array([x[3] for x in post])
        self.mass = np.bincount(self.template, self.weight, len(templates))
        self.keys = [[_hashes(p) for p in t[2]] for t in templates]


def vocabulary(templates=TEMPLATES) -> np.ndarray:
    return np.unique(np.concatenate([_hashes(t[1]) for t in templates]))


def build_index(documents: DataFrame, common_share: float = 0.2, templates=TEMPLATES) -> Index:
    """IDF over all documents, of the templates' words only: at most a row per word from each task."""
    ship(documents.sparkSession)
    vocab = vocabulary(templates)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs = np.zeros(len(vocab), np.int64), 0
        for batch in batches:
            for part in chunks(batch, "text"):
                t = tokenize(part["text"], "alnum", lower=True)
                at = np.minimum(np.searchsorted(vocab, t.hash), len(vocab) - 1)
                hit = np.flatnonzero(vocab[at] == t.hash)
                pair = np.unique(t.owner()[hit] * len(vocab) + at[hit])
                total += np.bincount(pair % len(vocab), minlength=len(vocab))
                docs += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(len(vocab)), -1)), pa.array(np.append(total, docs))], ["word", "n"])

    got = {r["word"]: r["n"] for r in documents.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    docs = got.get(-1, 0)
    weights = {int(h): math.log((docs + 1) / (got.get(i, 0) + 1)) + 1e-9 for i, h in enumerate(vocab)}
    return Index(weights, common_share, docs, templates)


def _starts(hashes: np.ndarray, owner: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where the words of a phrase stand consecutively inside one text."""
    at = np.flatnonzero(hashes[: len(hashes) - len(phrase) + 1] == phrase[0]) if len(hashes) >= len(phrase) else np.zeros(0, np.int64)
    for j in range(1, len(phrase)):
        at = at[hashes[at + j] == phrase[j]]
    return at[owner[at] == owner[at + len(phrase) - 1]] if len(at) else at


def scan_licenses(documents: DataFrame, index: Index, least_share: float = 0.6, slack: int = 4) -> DataFrame:
    """Each row's doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and matches (label, word, share)."""
    ship(documents.sparkSession)
    names = [(_hashes(p), label) for p, label in PHRASES.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                yield _scan(part, index, names, least_share, slack)

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,word:long,share:double>>"
    return documents.select("doc_id", "text").mapInArrow(run, schema)


def _scan(part: pa.RecordBatch, index: Index, names: list, least_share: float, slack: int) -> pa.RecordBatch:
    t = tokenize(part["text"], "alnum", lower=True)
    docs, owner = part.num_rows, t.owner()
    base: list[set] = [set() for _ in range(docs)]
    places: list[list] = [[] for _ in range(docs)]
    for phrase, label in names:
        for at in _starts(t.hash, owner, phrase):
            base[owner[at]].add(label)
            places[owner[at]].append(int(at - t.doc[owner[at]]))
    matches: list[list] = [[] for _ in range(docs)]
    for d, k, start, share in _alignments(t, owner, index, slack, least_share):
        lo, hi = max(t.doc[d], start - slack), min(t.doc[d + 1], start + index.length[k] + 2 * slack)
        here = t.hash[lo:hi]
        if all(len(_starts(here, np.zeros(len(here), int), key)) for key in index.keys[k]):
            matches[d].append({"label": index.labels[k], "word": max(0, int(start - t.doc[d])), "share": share})
    labels = [sorted(b | {m["label"] for m in ms}) for b, ms in zip(base, matches, strict=True)]
    columns = [
        part["doc_id"].cast(pa.int64()),
        pa.array(np.diff(t.doc)),
        pa.array([len(p) for p in places], pa.int64()),
        pa.array([min(p) if p else None for p in places], pa.int64()),
        pa.array([max(p) if p else None for p in places], pa.int64()),
        pa.array([",".join(sorted(b)) for b in base]),
        pa.array([",".join(x) for x in labels]),
        pa.array([max([m["share"] for m in ms], default=0.0) for ms in matches], pa.float64()),
        pa.array(matches, pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("share", pa.float64())]))),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])


def _alignments(t, owner: np.ndarray, index: Index, slack: int, least_share: float) -> list[tuple[int, int, int, float]]:
    """Candidate (text, template, first word, share of the IDF mass) where enough rare words agree on the place."""
    lo, hi = np.searchsorted(index.word, t.hash, "left"), np.searchsorted(index.word, t.hash, "right")
    hit = np.flatnonzero(hi > lo)
    if not len(hit):
        return []
    many = hi[hit] - lo[hit]
    at = np.repeat(hit, many)
    entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo[hit], many)
    k, start = index.template[entry], at - index.place[entry]
    order = np.lexsort((start, k, owner[at]))
    d, k, start, w, place = owner[at][order], k[order], start[order], index.weight[entry][order], index.place[entry][order]
    # each start that votes name, with the votes of one text and template within the slack of it
    pair = np.cumsum(np.r_[False, (d[1:] != d[:-1]) | (k[1:] != k[:-1])])
    line = pair * int(start.max() - start.min() + slack + 1) + start - start.min()
    first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    own = np.add.reduceat(w, first)
    lo, hi = np.searchsorted(line, line[first] - slack, "left"), np.searchsorted(line, line[first] + slack, "right")
    total = np.append(0.0, np.cumsum(w))
    some = np.flatnonzero(total[hi] - total[lo] >= least_share * index.mass[k[first]] - 1e-6)
    if not len(some):
        return []
    first, own, lo, many = first[some], own[some], lo[some], (hi - lo)[some]
    of = np.repeat(np.arange(len(some)), many)
    vote = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + lo[of]
    once = np.unique(of * 100_003 + place[vote], return_index=True)[1]  # a template's word votes once
    share = np.round(np.minimum(1.0, np.bincount(of[once], w[vote[once]], len(some)) / index.mass[k[first]]), 6)
    # the heaviest place stands for those within the slack of it; of equal ones that with most votes for itself
    kept: dict[tuple[int, int], list[tuple[int, float]]] = {}
    for i in np.lexsort((start[first], -own.round(6), -share)):
        if share[i] < least_share:
            break
        mine = kept.setdefault((int(d[first[i]]), int(k[first[i]])), [])
        if all(abs(start[first[i]] - other) > slack for other, _ in mine):
            mine.append((int(start[first[i]]), float(share[i])))
    return [(*key, at, weight) for key, mine in sorted(kept.items()) for at, weight in sorted(mine)]
