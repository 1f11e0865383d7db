"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

A template is a list of words and its set of `WORDS`-word shingles; one of fewer words is looked up as a whole. Other templates and documents are cut
into overlapping windows of 1, 2, 4, .. `WIDEST` shingles; a template uses the widest that fits it, stepping by
an eighth of the width, and documents are cut into all widths that some template uses. A window's MinHash
signature has `BANDS` bands of `ROWS` values, and a document's window that shares a band with a template's window retrieves it.
Windows end with their text, and a text that is shorter than a window is one of its own length.
Windows at a similarity s collide with probability 1 - (1 - s ** ROWS) ** BANDS: 0.998 at s = 0.6, above 0.9999 at 0.8.

A retrieved template is verified in the document around the window: the share of the template's shingles that occur
within its length, with a quarter of it to spare on both sides, must reach `CONTAINMENT`. Each template is reported once
per document, at its best place (the first of equal ones).

The templates are a bounded list (`MOST_TEMPLATE_WORDS` words, checked) that every task holds; documents are never shuffled.

Cases: null and empty texts match nothing; templates without words are ignored; equal templates are all reported; equal rows
are reported alike; extra columns are ignored; no templates or no documents give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiline.llm.chosen_path import Shingler
from lexiline.llm.common import WORD, small_batches

WORDS = 5
CONTAINMENT = 0.8
WIDEST = 32
ROWS = 2
BANDS = 14
MOST_TEMPLATE_WORDS = 2_000_000

#: Notices in common use, and the openings of public license texts.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("apache-2.0-notice", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)

#: More notices and openings of usual families; no text of one list holds a template of another license.
FAMILIES = (
    ("all-rights-reserved", "All rights reserved."),
    ("gpl-2.0-text", "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users."),
    ("lgpl-2.1-notice", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl-3.0-text", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("mpl-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("isc-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("zlib-text", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-4.0-notice", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nd-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by-nc-sa-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("cc-by-nc-nd-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("cc-by-4.0-short", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0-short", "Licensed under CC BY-SA 4.0."),
)


class Index:
    """Band keys of the templates' windows, by width."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.shingler = Shingler(WORDS)
        rng = np.random.default_rng(97)
        self.factors = rng.integers(1, 1 << 31, size=ROWS * BANDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.offsets = rng.integers(0, 1 << 32, size=ROWS * BANDS, dtype=np.uint32)
        self.names, self.lengths, self.sets = [], [], []
        self.keys: dict[int, dict[int, list[tuple[int, int]]]] = {}
        self.short: dict[int, dict[int, list[str]]] = {}
        for name, text in templates:
            words = WORD.findall((text or "").lower())
            if not words:
                continue
            s = self.shingler.in_order(words)
            if len(words) < WORDS:
                self.short.setdefault(len(words), {}).setdefault(int(s[0]), []).append(name)
                continue
            width = 1
            while width * 2 <= min(len(s), WIDEST):
                width *= 2
            at = len(self.names)
            self.names.append(name)
            self.lengths.append(len(s))
            self.sets.append(np.unique(s))
            found = self.keys.setdefault(width, {})
            for band, (starts, keys) in enumerate(self.bands(s, np.array([0, len(s)]), {width})[width]):
                whole = starts <= len(s) - width
                for i, k in zip(starts[whole].tolist(), keys[whole].tolist(), strict=True):
                    found.setdefault(k * BANDS + band, []).append((at, i))
        self.flags = {}
        for width, found in self.keys.items():
            flags = np.zeros((BANDS, 1 << 16), dtype=bool)
            for k in found:
                flags[k % BANDS, k // BANDS >> 16] = True
            self.flags[width] = flags

    def bands(self, s: np.ndarray, bounds: np.ndarray, widths: set[int]) -> dict[int, list[tuple[np.ndarray, np.ndarray]]]:
        """For each width and band: starts of the windows and their keys (32 bits).

        Windows begin at every step of their text and end with it at the latest, so that they depend on their text alone.
        """
        out: dict[int, list] = {w: [] for w in widths}
        sizes = np.diff(bounds)
        inner = np.arange(len(s)) - np.repeat(bounds[:-1], sizes)
        # between texts, values that no minimum takes
        at = np.arange(len(s)) + np.repeat(np.arange(len(sizes)), sizes) * (WIDEST - 1)
        length = len(s) + len(sizes) * (WIDEST - 1) + WIDEST
        low = (s >> np.uint64(32)).astype(np.uint32)
        starts = {w: np.flatnonzero(inner % max(1, w // 8) == 0) for w in widths}
        for band in range(BANDS):
            rows = []
            for r in range(ROWS):
                row = np.full(length, 0xFFFFFFFF, np.uint32)
                row[at] = low * self.factors[ROWS * band + r] + self.offsets[ROWS * band + r]
                rows.append(row)
            width = 1
            while True:
                if width in widths:
                    places = at[starts[width]]
                    key = rows[0][places] * np.uint32(0x9E3779B1)
                    for r in rows[1:]:
                        key = (key ^ (key >> np.uint32(15))) * np.uint32(0x85EBCA77) + r[places]
                    out[width].append((starts[width], key ^ (key >> np.uint32(13))))
                if width >= max(widths):
                    break
                rows = [np.minimum(r[:-width], r[width:]) for r in rows]
                width *= 2
        return out

    def scan(self, texts: list[list[str]]) -> list[list[tuple[str, float, int, int]]]:
        """(template, containment, first word, last word) of the templates that each of a few texts holds."""
        s, bounds = self.shingler.batch(texts)
        candidates: set[tuple[int, int, int]] = set()
        for width, bands in self.bands(s, bounds, set(self.keys)).items() if self.keys else ():
            found = self.keys[width]
            for band, (starts, keys) in enumerate(bands):
                for i in np.flatnonzero(self.flags[width][band][keys >> np.uint32(16)]):
                    for t, at in found.get(int(keys[i]) * BANDS + band, ()):
                        d = int(np.searchsorted(bounds, starts[i], side="right")) - 1
                        candidates.add((d, t, int(starts[i]) - at))
        best: dict[tuple[int, int], tuple] = {}
        for d, t, start in sorted(candidates):
            spare = max(1, self.lengths[t] // 4)
            a, z = max(int(bounds[d]), start - spare), min(int(bounds[d + 1]), start + self.lengths[t] + spare)
            inside = np.flatnonzero(np.isin(s[a:z], self.sets[t]))
            share = len(np.unique(s[a:z][inside])) / len(self.sets[t])
            if share >= CONTAINMENT and ((d, t) not in best or share > best[d, t][0]):
                first, last = a - int(bounds[d]) + int(inside[0]), a - int(bounds[d]) + int(inside[-1])
                best[d, t] = (share, first, min(last + WORDS, len(texts[d])) - 1)
        out: list[list] = [[] for _ in texts]
        for (d, t), b in sorted(best.items()):
            out[d].append((self.names[t], *b))
        # Templates of fewer words than a shingle are looked up as they are, at their first place.
        flat = self.shingler.digests([w for t in texts for w in t]) if self.short else None
        ends = np.cumsum([len(t) for t in texts])
        for size, found in self.short.items():
            rolled = self.shingler.rolled(flat, size)
            seen = set()
            for i in np.flatnonzero(np.isin(rolled, np.array(list(found), np.uint64))).tolist():
                d = int(np.searchsorted(ends, i, side="right"))
                if i + size <= ends[d] and (d, int(rolled[i])) not in seen:
                    seen.add((d, int(rolled[i])))
                    first = i - int(ends[d]) + len(texts[d])
                    out[d] += [(name, 1.0, first, first + size - 1) for name in found[int(rolled[i])]]
        return out


def default_templates(spark) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES + FAMILIES), "template_id string, text string")


def scan(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """(doc_id, template_id, containment, first_word, last_word) for each document and template it holds."""
    size = templates.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0))).first()[0]
    if size > MOST_TEMPLATE_WORDS:
        raise ValueError(f"the templates have {size} words; at most {MOST_TEMPLATE_WORDS} fit into every task")
    given = sorted((r["template_id"], r["text"]) for r in templates.filter("template_id is not null").collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(given)
        for b in batches:
            found = index.scan([WORD.findall((t or "").lower()) for t in b.column("text").to_pylist()])
            rows = pa.array([i for i, f in enumerate(found) for _ in f], pa.int32())
            flat = [x for f in found for x in f]
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
            columns = [pa.array([x[k] for x in flat], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(rows), *columns], ["doc_id", "template_id", "containment", "first_word", "last_word"])

    small_batches(docs.sparkSession, 500)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, template_id string, containment double, first_word long, last_word long")
