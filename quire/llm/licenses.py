"""License scans by an exact set-similarity join of text blocks with license templates.

A template is a short notice; its set is its distinct words. The blocks of a document, for a template of n words, are the
windows of 2 n words that start at every n-th word, so any passage of n words lies inside one block. Block and template
join when the block holds at least ``threshold`` of the template's set. The words of the templates are ordered by their
document frequency over all documents, rarest first, and the join is exact:

* prefix filter: a block that meets the threshold holds one of the template's first m - need + 1 words in that order;
* length filter: it has at least ``need`` words;
* positional filter: if the rarest word it shares stands at position p of the order, it shares at most m - p words, and no
  more than the number of its places that hold words of the template;
* verification counts the distinct shared words of the blocks that are left.

Templates are a bounded parameter (at most MAX_TEMPLATE_WORDS words) and go to every task; documents are not shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import _text as tx

MAX_TEMPLATE_WORDS = 100_000
THRESHOLD = 0.9

# Phrases whose presence alone names a license, and the wording of well-known public license notices.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc", "Licensed under CC BY-NC 4.0"),
    ("cc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


@dataclass
class _Template:
    label: str
    words: int
    need: int
    order: np.ndarray  # places of its set in the vocabulary, rarest first


def _compile(templates: list[tuple[str, str]], threshold: float, frequency: dict[int, int]) -> tuple[np.ndarray, list[_Template]]:
    hashed = tx.hash_words([t for _, t in templates], tx.ALPHANUMERIC)
    vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashed]))
    out = []
    for (label, _), h in zip(templates, hashed, strict=True):
        if len(h):
            own = sorted({int(x) for x in h}, key=lambda x: (frequency.get(x, 0), x))
            out.append(_Template(label, len(h), math.ceil(threshold * len(own) - 1e-9), np.searchsorted(vocabulary, np.array(own, np.uint64))))
    return vocabulary, out


def _document_of(first: np.ndarray, word: np.ndarray) -> np.ndarray:
    return np.searchsorted(first, word, side="right") - 1


def _blocks(t: _Template, where: np.ndarray, key: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start word, shared words) of the blocks that meet the template's threshold; where and key: places of vocabulary words."""
    m, step = len(t.order), t.words
    rank_of = np.full(size, m)
    rank_of[t.order] = np.arange(m)
    rank = rank_of[key]
    own = rank < m
    where, rank = where[own], rank[own]
    doc = _document_of(first, where)
    start = first[doc] + (where - first[doc]) // step * step
    earlier = start - step >= first[doc]  # each place stands in two blocks, or in the document's first one only
    start, rank, doc = np.r_[start, start[earlier] - step], np.r_[rank, rank[earlier]], np.r_[doc, doc[earlier]]
    ok = np.minimum(first[doc + 1], start + 2 * step) - start >= t.need
    start, rank = start[ok], rank[ok]
    candidates, places = np.unique(start, return_counts=True)
    rarest = np.full(len(candidates), m)
    at = np.searchsorted(candidates, start)
    np.minimum.at(rarest, at, rank)
    kept = (rarest <= m - t.need) & (np.minimum(m - rarest, places) >= t.need)
    pair = np.unique((at * m + rank)[kept[at]])
    shared = np.bincount(pair // m, minlength=len(candidates))
    found = np.flatnonzero(shared >= t.need)
    return candidates[found], shared[found]


def _scan(vocabulary: np.ndarray, templates: list[_Template], phrases: list[tuple[np.ndarray, str]]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = tx.Lookup(vocabulary)
        heads = tx.Lookup(np.array([p[0] for p, _ in phrases], np.uint64))
        for b in batches:
            for lo, hi, raw, off in tx.slices(b.column(1)):
                w = tx.Words(raw, off, tx.ALPHANUMERIC)
                h, n = w.hashes(), hi - lo
                base: list[list] = [[] for _ in range(n)]
                blocks: list[list] = [[] for _ in range(n)]
                at, _ = heads.find(h)
                for words, label in phrases:
                    p = at[h[at] == words[0]]
                    p = p[p + len(words) <= w.first[_document_of(w.first, p) + 1]]
                    for j in range(1, len(words)):
                        p = p[h[p + j] == words[j]]
                    for d, x in zip(_document_of(w.first, p).tolist(), p.tolist(), strict=True):
                        base[d].append({"label": label, "word": x - int(w.first[d])})
                where, key = lookup.find(h)
                for t in templates:
                    start, shared = _blocks(t, where, key, w.first, len(vocabulary))
                    for d, s, x in zip(_document_of(w.first, start).tolist(), start.tolist(), shared.tolist(), strict=True):
                        blocks[d].append({"label": t.label, "word": s - int(w.first[d]), "words": 2 * t.words, "containment": x / len(t.order)})
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, n), pa.array(w.counts.astype(np.int64)), pa.array(base, _PLACES), pa.array(blocks, _BLOCKS)], ["doc_id", "n_words", "phrases", "blocks"])

    return scan


_PLACES = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
_BLOCKS = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("words", pa.int64()), ("containment", pa.float64())]))


def _frequencies(vocabulary: np.ndarray):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, total = tx.Lookup(vocabulary), np.zeros(len(vocabulary), np.int64)
        for b in batches:
            for _, _, raw, off in tx.slices(b.column(0)):
                w = tx.Words(raw, off, tx.ALPHANUMERIC)
                at, key = lookup.find(w.hashes())
                pair = np.unique(_document_of(w.first, at) * len(vocabulary) + key)
                total += np.bincount(pair % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_pydict({"word": lookup.keys.view(np.int64), "df": total})

    return count


def find_licenses(documents: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of documents: doc_id, n_words, phrases (label, word: each place where a phrase stands), blocks (label,
    word, words, containment: each block that meets a template's threshold).

    Null, empty and wordless texts have no words, phrases or blocks. Rows that repeat are reported as often as they occur.
    Columns other than doc_id and text are ignored, whatever their names.
    """
    tx.importable(documents.sparkSession)
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    docs = documents.select(documents["doc_id"].cast("long").alias("doc_id"), tx.text_or_empty(documents).alias("text"))
    vocabulary, _ = _compile(templates, threshold, {})
    if len(vocabulary) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"the templates have {len(vocabulary)} distinct words; the most is {MAX_TEMPLATE_WORDS}")
    frequency = {}
    if len(vocabulary):
        counted = docs.select("text").mapInArrow(tx.released(_frequencies(vocabulary)), "word long, df long").groupBy("word").agg(F.sum("df").alias("df"))
        frequency = {r["word"] % (1 << 64): r["df"] for r in counted.collect()}  # a row for each word of the templates
    vocabulary, compiled = _compile(templates, threshold, frequency)
    hashed = [x for x in zip(tx.hash_words(list(phrases), tx.ALPHANUMERIC), phrases.values(), strict=True) if len(x[0])]
    return docs.mapInArrow(tx.released(_scan(vocabulary, compiled, hashed)), "doc_id long, n_words long, phrases array<struct<label string, word long>>, blocks array<struct<label string, word long, words long, containment double>>")


def report(found: DataFrame) -> DataFrame:
    """Labels and counts; score: 1 where a phrase stands, else the highest containment of a block that was found, else 0."""
    words = F.transform("phrases", lambda p: p["word"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("phrases", lambda p: p["label"]))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(F.transform("phrases", lambda p: p["label"]), F.transform("blocks", lambda b: b["label"]))), ",").alias("labels"),
        F.when(F.size("phrases") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0))).alias("score"),
    )
