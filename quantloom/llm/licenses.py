"""License scans: an exact set-similarity join of text blocks with license templates.

Tokens are ordered by their frequency in the corpus, rare ones first, as Spark
counted them. A template and a block can only reach the containment threshold
if they share a token of the template's prefix, if the block is long enough,
and if at the first shared token enough tokens remain on both sides; pairs
that pass these filters are counted exactly. A pair counts if the block also
holds the words that name the license, and as many of the template's words in
its order, close together; of templates alike, the one held best speaks.
Templates are a fixed, small table, so each block meets them in the task that
reads it."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit

# Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Notices by which works are licensed: label of the license, the words that name it, the notice.
TEMPLATES = {
    "apache-2.0": ("apache", "apache", "Licensed under the Apache License, Version 2.0"),
    "apache-2.0-notice": ("apache", "apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    "bsd-notice": ("bsd", "", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "bsd-short": ("bsd", "bsd", "Released under the BSD License"),
    "cc-by-4.0": ("cc-by", "attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "cc-by-4.0-short": ("cc-by", "cc by", "Licensed under CC BY 4.0"),
    "cc-by-nc-4.0": ("cc-by-nc", "nc", "Licensed under CC BY-NC 4.0"),
    "cc-by-sa-4.0": ("cc-by-sa", "sa", "Licensed under CC BY-SA 4.0"),
    "cc0-1.0": ("cc0", "waived", "To the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    "gpl-3.0": ("gpl", "gnu general", "This work is licensed under the GNU General Public License, version 3"),
    "gpl-notice": ("gpl", "gnu general", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    "lgpl-notice": ("lgpl", "gnu lesser", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    "mit-notice": ("mit", "", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    "mit-short": ("mit", "mit", "Released under the MIT License"),
    "mpl-2.0": ("mpl", "mozilla", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    "isc-notice": ("isc", "", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
}

_LETTER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_WORDS = bytes(c if chr(c).isalnum() or c >= 0x80 else 32 for c in range(128)) + bytes(range(128, 256))
_TO_WORDS = bytes(_WORDS[c] for c in _LETTER)


def words_of(text: bytes) -> bytes:
    """The text with A-Z lower-cased and every byte that is no letter, digit or non-ASCII byte turned into a space."""
    return text.translate(_TO_WORDS)


def _frequencies(batches: Iterator[pa.RecordBatch], vocabulary: frozenset[bytes]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for batch in batches:
        for text in textkit.texts(batch.column(0)):
            seen.update(filter(vocabulary.__contains__, words_of(text).split()))
    yield pa.record_batch([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])


class TemplateIndex:
    """Prefix index over the templates' token sets; tokens are numbered by corpus frequency, rare ones first."""

    def __init__(self, templates: dict[str, tuple[str, str, str]], frequency: dict[str, int], containment: float):
        self.labels = {k: label for k, (label, _, _) in templates.items()}
        self.named = {k: frozenset(words_of(w.encode()).split()) for k, (_, w, _) in templates.items()}
        self.notice = {k: words_of(v.encode()).split() for k, (_, _, v) in templates.items()}
        sets = {k: set(v) for k, v in self.notice.items()}
        self.alike = {k: {j for j in sets if len(sets[j] & s) >= containment * min(len(s), len(sets[j]))} for k, s in sets.items()}
        order = sorted({w for s in sets.values() for w in s}, key=lambda w: (frequency.get(w.decode(), 0), w))
        self.rank = {w: i for i, w in enumerate(order)}
        self.names = list(sets)
        self.tokens = [sorted(self.rank[w] for w in s) for s in sets.values()]
        self.need = [max(1, math.ceil(containment * len(s) - 1e-9)) for s in self.tokens]
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for t, s in enumerate(self.tokens):
            for i in range(len(s) - self.need[t] + 1):
                self.prefix.setdefault(s[i], []).append((t, i))
        self.first = min(self.need, default=1)

    def matches(self, words: list[bytes]) -> dict[str, float]:
        """Templates that the block contains to the threshold, with their containment; of templates alike only the best held, then longest."""
        held = frozenset(words)
        block = sorted({self.rank[w] for w in words if w in self.rank})
        out: dict[str, float] = {}
        if len(block) < self.first:
            return out
        seen: set[int] = set()
        for j, token in enumerate(block):
            for t, i in self.prefix.get(token, ()):
                if t in seen:
                    continue
                seen.add(t)
                need, own = self.need[t], self.tokens[t]
                if len(block) < need or 1 + min(len(own) - i - 1, len(block) - j - 1) < need:
                    continue  # the first shared token: everything rarer is not shared
                both = len(set(own).intersection(block))
                name = self.names[t]
                if both >= need and self.named[name] <= held and in_order(words, self.notice[name], need):
                    out[name] = both / len(own)
        weight = {k: (x, len(self.notice[k])) for k, x in out.items()}
        return {k: x for k, x in out.items() if all(weight[k] >= weight[j] for j in self.alike[k] & out.keys())}


def in_order(words: list[bytes], notice: list[bytes], need: int) -> bool:
    """Whether some run of twice as many words as the notice has holds `need` of its words in its order.

    A run is compared only if it holds that many of the notice's words at all,
    in whatever order, which sliding counts tell, and only once as many further
    words have come in as the run compared last fell short by."""
    wanted = Counter(notice)
    places = [(i, w) for i, w in enumerate(words) if w in wanted]
    held: Counter = Counter()
    enough = end = again = 0
    for k, (first, word) in enumerate(places):
        while end < len(places) and places[end][0] < first + 2 * len(notice):
            w = places[end][1]
            held[w] += 1
            enough += held[w] <= wanted[w]
            end += 1
        if enough >= need and end >= again:
            best = [0] * (len(notice) + 1)  # longest common subsequence, row by row
            for _, w in places[k:end]:
                before = 0
                for j, v in enumerate(notice, 1):
                    here = best[j]
                    best[j] = before + 1 if w == v else max(here, best[j - 1])
                    before = here
            if best[-1] >= need:
                return True
            again = end + need - best[-1]
        enough -= held[word] <= wanted[word]
        held[word] -= 1
    return False


def _scan(batches: Iterator[pa.RecordBatch], index: TemplateIndex, phrases: dict[str, str]) -> Iterator[pa.RecordBatch]:
    keys = [(f" {p} ".encode(), len(p.split()), label) for p, label in phrases.items()]
    for batch in textkit.parts(batches, 1):
        rows = []
        for text in textkit.texts(batch.column(1)):
            flat = words_of(text)
            words = flat.split()
            base, labels, starts, score = set(), {}, [], 0.0
            line = b" " + b" ".join(words) + b" "
            for key, _, label in keys:
                at, last, words_before = line.find(key), 0, -1
                while at >= 0:
                    words_before += line.count(b" ", last, at + 1)
                    last = at + 1
                    starts.append(words_before)
                    base.add(label)
                    at = line.find(key, at + 1)
            for block in _blocks(text):
                for name, share in index.matches(block.split()).items():
                    labels[index.labels[name]] = max(share, labels.get(index.labels[name], 0.0))
            score = 1.0 if base else max(labels.values(), default=0.0)
            rows.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels.keys())), float(score)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
        yield pa.record_batch(
            [batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))],
            names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
        )


def _blocks(text: bytes) -> list[bytes]:
    """Lines, and the paragraphs of several lines, as words."""
    lines = text.split(b"\n")
    out = [words_of(x) for x in lines]
    run: list[bytes] = []
    for x in [*lines, b""]:
        if x.strip():
            run.append(x)
        else:
            if len(run) > 1:
                out.append(words_of(b" ".join(run)))
            run = []
    return out


def scan(docs: DataFrame, containment: float = 0.8, templates: dict[str, tuple[str, str, str]] | None = None, phrases: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of ASCII letters, digits and non-ASCII characters of the
    A-Z lower-cased whole text. Base labels come from phrases whose words stand
    consecutively. A block, a line or a paragraph of several lines, gets the
    license of a template of whose distinct tokens it holds the share
    `containment` or more, in order and close together (`in_order`), and the
    words that name the license; of templates alike, only that held best, then
    the longest; templates that tie both count. The score is 1 with a base
    label, else the largest containment found. Texts of any length are read
    whole; an empty table gives an empty result. Null and empty texts: no words, null places, empty
    labels, score 0. Null and repeated ids are scanned like others; other
    columns are not read."""
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    vocabulary = frozenset(w for _, _, t in templates.values() for w in words_of(t.encode()).split())
    counted = src.select("text").mapInArrow(lambda it: _frequencies(it, vocabulary), "token string, n long").groupBy("token").agg(F.sum("n")).collect()
    index = TemplateIndex(templates, dict(counted), containment)  # as many rows as the templates have tokens
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return src.mapInArrow(lambda it: _scan(it, index, phrases), schema)
