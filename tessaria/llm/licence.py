"""Licence scan: an exact set-similarity join of text blocks with licence templates.

A template is the set of its words; a text block is a window of twice the
template's length, moved by that length, so every stretch of a text as long as
the template lies in one block.  A block matches when it holds at least
``THRESHOLD`` of the template's words.  Tokens are in one global order, rarest
first by their counts over all documents; a block that matches must hold a
token of the template's prefix, be long enough, and at its first common token
have enough tokens left in that order (prefix, length and positional filters).
What is left is verified.  Every label with a matching block is told, so a
notice is also told under a label whose template differs from it in one word.
Base phrases are searched for in every word.

Templates and their counts are a fixed, small vocabulary; documents are read
twice and never shuffled.  Defined cases: null and empty texts have no words,
no labels, null places and score 0; repeated rows are each scanned.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DBL, LONG, STR, read_table, schema
from .textcore import ALNUM, as_bytes, span_hashes, spans

THRESHOLD = (4, 5)

# The base phrases with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Licence notices, as their licences tell one to write them.
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0"],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike"],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
}


def word_codes(text) -> np.ndarray:
    buf = np.frombuffer(as_bytes(text).lower(), dtype=np.uint8)
    return span_hashes(buf, *spans(buf, ALNUM))


@functools.cache
def _phrases() -> list[tuple[np.ndarray, str]]:
    return [(word_codes(p), label) for p, label in PHRASES.items()]


def base_places(w: np.ndarray) -> list[tuple[int, str]]:
    """(start, label) of every place of a base phrase."""
    out = []
    for p, label in _phrases():
        n = len(w) - len(p) + 1
        if n > 0:
            at = np.flatnonzero(w[:n] == p[0])
            for j in range(1, len(p)):
                at = at[w[at + j] == p[j]]
            out += [(int(i), label) for i in at]
    return out


class Templates:
    """Template sets in global order, and the index of their prefix tokens."""

    def __init__(self, templates: dict[str, list[str]], counts: dict[int, int]):
        self.rows = []  # label, words, ordered token array, needed overlap
        vocabulary: dict[int, int] = {}
        for label, texts in sorted(templates.items()):
            for text in texts:
                w = word_codes(text)
                tokens = sorted({int(x) for x in w}, key=lambda t: (counts.get(t, 0), t))
                self.rows.append((label, len(w), tokens, -(-THRESHOLD[0] * len(tokens) // THRESHOLD[1])))
                vocabulary |= dict.fromkeys(tokens, 0)
        self.rank = {t: i for i, t in enumerate(sorted(vocabulary, key=lambda t: (counts.get(t, 0), t)))}
        self.index: dict[int, list[int]] = {}
        for r, (_, _, tokens, need) in enumerate(self.rows):
            for t in tokens[: len(tokens) - need + 1]:
                self.index.setdefault(t, []).append(r)
        #: Labels that give way to others: none, every label with a block that meets the threshold is told.
        self.rivals: dict[str, set[str]] = {}
        self.prefix = np.array(sorted(self.index), dtype=np.uint64)
        self.vocabulary = np.array(sorted(self.rank), dtype=np.uint64)

    def search(self, w: np.ndarray) -> dict[str, float]:
        """Label to best containment, of all blocks that meet the threshold."""
        out: dict[str, float] = {}
        if not len(w) or not len(self.prefix):
            return out
        hits = np.flatnonzero(self.prefix[np.minimum(np.searchsorted(self.prefix, w), len(self.prefix) - 1)] == w)
        seen = set()
        for at in hits.tolist():
            for r in self.index[int(w[at])]:
                size = self.rows[r][1]
                for block in {max(at // size - 1, 0), at // size}:
                    if (r, block) not in seen:
                        seen.add((r, block))
                        self._verify(w[block * size : block * size + 2 * size], r, out)
        return out

    def _verify(self, block: np.ndarray, r: int, out: dict[str, float]) -> None:
        label, _, tokens, need = self.rows[r]
        if len(block) < need:
            return
        known = sorted({self.rank[int(x)] for x in block[np.isin(block, self.vocabulary)]})
        mine = [self.rank[t] for t in tokens]
        i = j = shared = 0
        while i < len(mine) and j < len(known):
            if shared + min(len(mine) - i, len(known) - j) < need:
                return
            if mine[i] == known[j]:
                shared += 1
                i += 1
                j += 1
            elif mine[i] < known[j]:
                i += 1
            else:
                j += 1
        if shared >= need:
            out[label] = max(out.get(label, 0.0), shared / len(mine))


def token_counts(docs: DataFrame, templates: dict[str, list[str]]) -> dict[int, int]:
    """Occurrences of each template token over all documents."""
    vocabulary = np.unique(np.concatenate([word_codes(t) for texts in templates.values() for t in texts]))

    def local(batches):
        n = np.zeros(len(vocabulary), dtype=np.int64)
        for b in batches:
            for t in b.column(0):
                w = word_codes(t.as_py())
                at = np.minimum(np.searchsorted(vocabulary, w), len(vocabulary) - 1)
                n += np.bincount(at[vocabulary[at] == w], minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(vocabulary.view(np.int64)), pa.array(n)], ["token", "n"])

    rows = docs.select("text").mapInArrow(local, schema(token=LONG, n=LONG)).groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {int(r["token"]) % (1 << 64): int(r["n"]) for r in rows}  # one row a template token


def licence_scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    templates = templates or TEMPLATES
    held = docs.sparkSession.sparkContext.broadcast(Templates(templates, token_counts(docs, templates)))
    out = schema(n_words=LONG, n_base=LONG, first_word=LONG, last_word=LONG, base_labels=STR, labels=STR, score=DBL)

    def local(batches):
        find = held.value
        for b in batches:
            rows = []
            for t in b.column(len(keys)):
                w = word_codes(t.as_py())
                base = base_places(w)
                more = find.search(w)
                places = [p for p, _ in base]
                own = {label for _, label in base}
                rows.append(
                    (
                        len(w),
                        len(base),
                        min(places, default=None),
                        max(places, default=None),
                        ",".join(sorted(own)),
                        ",".join(sorted(own | set(more))),
                        1.0 if own else max(more.values(), default=0.0),
                    )
                )
            arrays = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate([pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()])]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], *arrays], [*keys, *out.fieldNames()])

    return docs.select(*keys, "text").mapInArrow(local, type(out)([docs.schema[k] for k in keys] + out.fields))


def op4_licence_scan(spark, sf_dir: str) -> DataFrame:
    return licence_scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
