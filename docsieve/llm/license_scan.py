"""Licence scan over a positional index of rare licence words.

The index lists, for every template, where its words stand. A file is looked up by its licence words in order of their
inverse document frequency over the whole corpus: each mandatory key phrase of a template is indexed under its rarest
word, so a file without that word can't hold the phrase and is never compared. Every place of such a word fixes the
template's position in the file; the places that the template's other words should have are intersected with the file's
words, and a template is accepted where the share found reaches ``least`` (and FEWEST words, so that short templates need
more of theirs) and every key phrase stands word by word within the window. Base phrases are templates that must stand whole.

Defined results: null text counts as empty; a file without words or licences has n_base 0, null places, empty labels and
score 0; overlapping places count each; repeated rows are rows of their own; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import utf8

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Phrases whose places are counted, and the labels that they give.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Words that an insertion or a deletion may shift a key phrase by.
SLACK = 6
#: Words of a template that must stand where they should, or all of a shorter one.
FEWEST = 4


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]


TEMPLATES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "deal in the software without restriction")),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("except in compliance with the license", "apache org licenses license 2 0")),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("free software you can redistribute it", "gnu general public license as published by")),
    Template("gpl-2.0", "gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-2.0", "gnu general public license v2", ("gnu general public license v2",)),
    Template("gpl-3.0", "gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-3.0", "gnu general public license v3", ("gnu general public license v3",)),
    Template("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl", "under the terms of the gnu affero general public license", ("gnu affero general public license",)),
    Template("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "the following conditions are met")),
    Template("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("neither the name of", "to endorse or promote products derived from this software")),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("epl-2.0", "made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", ("cc by nc sa 4 0",)),
    Template("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd 4 0",)),
    Template("cc-by", "licensed under a creative commons attribution international license", ("creative commons attribution",)),
    Template("cc0-1.0", "cc0 1 0 universal public domain dedication", ("cc0 1 0 universal",)),
)


def _places(words: list[bytes], phrase: list[bytes], first: int, last: int) -> bool:
    """Whether ``phrase`` starts somewhere in words[first : last + 1]."""
    n = len(phrase)
    return any(words[i : i + n] == phrase for i in range(max(0, first), min(len(words) - n, last) + 1))


class Index:
    """Templates under the rarest word of each of their key phrases."""

    def __init__(self, templates: tuple[Template, ...], idf: dict[bytes, float], least: float):
        self.idf, self.least = idf, least
        self.templates = [(t.label, t.text.encode().split(), [k.encode().split() for k in t.keys]) for t in templates]
        self.base = [(phrase.encode().split(), label) for phrase, label in BASE]
        self.postings: dict[bytes, list[tuple[int, int]]] = {}  # word: (template, its place there)
        self.base_postings: dict[bytes, list[tuple[int, int]]] = {}
        rarest = lambda phrase: max(phrase, key=lambda w: (idf.get(w, 0.0), w))
        for k, (_, words, keys) in enumerate(self.templates):
            for word in {rarest(key) for key in keys}:
                self.postings.setdefault(word, []).extend((k, j) for j, w in enumerate(words) if w == word)
        for k, (words, _) in enumerate(self.base):
            word = rarest(words)
            self.base_postings.setdefault(word, []).append((k, words.index(word)))
        self.vocabulary = frozenset(self.postings) | frozenset(self.base_postings)

    def scan(self, data: bytes) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
        words = WORD.findall(data.lower())
        hits = self.vocabulary.intersection(words)
        if not hits:
            return len(words), 0, None, None, "", "", 0.0
        where: dict[bytes, list[int]] = {}
        for i, w in enumerate(words):
            if w in hits:
                where.setdefault(w, []).append(i)
        starts: list[int] = []
        base, labels, best = set(), set(), 0.0
        for word in sorted(hits, key=lambda w: (-self.idf.get(w, 0.0), w)):
            for k, j in self.base_postings.get(word, ()):
                phrase, label = self.base[k]
                found = [i - j for i in where[word] if i >= j and words[i - j : i - j + len(phrase)] == phrase]
                if found:
                    starts += found
                    base.add(label)
                    best = 1.0
            for k, j in self.postings.get(word, ()):
                label, own, keys = self.templates[k]
                if best == 1.0 and label in labels:
                    continue
                for i in where[word]:
                    at = i - j
                    found = sum(0 <= at + n < len(words) and words[at + n] == w for n, w in enumerate(own))
                    share = found / len(own)
                    if share >= self.least and found >= min(FEWEST, len(own)) and all(_places(words, key, at - SLACK, at + len(own) + SLACK) for key in keys):
                        labels.add(label)
                        best = max(best, share)
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), best


def word_weights(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[bytes, float]:
    """Inverse document frequency over all documents of the words of templates and base phrases."""
    vocabulary = frozenset(w for t in [*(t.text for t in templates), *(p for p, _ in BASE)] for w in t.encode().split()) | {w for t in templates for k in t.keys for w in k.encode().split()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = dict.fromkeys(vocabulary, 0), 0
        for batch in batches:
            for data in utf8(batch.column(0)):
                n += 1
                for w in vocabulary.intersection(WORD.findall(data.lower())):
                    seen[w] += 1
        seen[b""] = n
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    got = {r[0].encode(): r[1] for r in docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n")).collect()}
    n = got.pop(b"", 0)
    return {w: log((n + 1) / (k + 1)) for w, k in got.items()}


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, least: float = 0.6) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score: the largest share of a template's words that stand where they should, of the accepted templates.
    """
    index = Index(templates, word_weights(docs, templates), least)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [index.scan(t) for t in utf8(batch.column(1))]
            if got:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*got, strict=True), kinds, strict=True))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
