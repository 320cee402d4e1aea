"""License scans: MinHash bands over overlapping text windows retrieve templates, containment verifies them.

Words are compared in lower case without punctuation at their ends; shingles are runs of five words. Templates are
put into size classes 1, 2, 4, 8, ... by their number of shingles n. In class c a window holds c + stride - 1
shingles, opens every stride = max(1, c // 4) shingles, and so lies over any occurrence of a template of its class
whole. Window and template then have a Jaccard similarity of at least

    0.8 n / (window + 0.2 n) > 0.8 / (2.5 + 0.2) = 0.296        (n > c / 2)

when 80 % of the template's shingles are there. With BANDS bands of one row each the chance that none agrees is at
most 0.704 ** BANDS, 0.001 at 20; a verbatim copy alone in its window agrees in all. Retrieved pairs are verified:
the share of the template's shingles that the window holds must reach ``containment``.

A template of fewer than five words is one shingle, its whole word sequence, and found where a text has these words in a row.

A window can only agree with a template in a band if it holds the template's least shingle there, so windows without
any shingle of any template are left out before hashing; that changes no result.

Null and empty texts match nothing; so does an empty table. One row for each text row and license found, with the best
share and the first window at which it was reached: of templates and windows with equal shares the first in the order of
size classes, then of windows, stays. Repeated rows are scanned each by itself, texts of any length whole. Only the two
columns named are read, whatever else the table holds.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from . import common

SHINGLE = 5
BANDS = 20
CONTAINMENT = 0.8
_MIX = np.uint64(0x9E3779B97F4A7C15)

#: (license, kind, notice): short forms of well-known license notices. Fixed values.
TEMPLATES = (
    ("MIT", "permissive", "Released under the MIT License."),
    ("MIT", "permissive", "This project is licensed under the MIT License."),
    ("MIT", "permissive", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "permissive", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("BSD", "permissive", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", "permissive", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "permissive", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-3.0", "copyleft", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "copyleft", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "copyleft", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL", "copyleft", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("AGPL-3.0", "copyleft", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("MPL-2.0", "copyleft", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("Unlicense", "public domain", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "public domain", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "permissive", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "permissive", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "copyleft", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "copyleft", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "non-commercial", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "non-commercial", "Licensed under CC BY-NC 4.0."),
)

#: SPDX ids of the licenses above, in the line "SPDX-License-Identifier: ID".
SPDX = (
    ("MIT", "permissive", "MIT"), ("Apache-2.0", "permissive", "Apache-2.0"), ("BSD", "permissive", "0BSD BSD-2-Clause BSD-3-Clause"), ("ISC", "permissive", "ISC"),
    ("GPL-3.0", "copyleft", "GPL-3.0 GPL-3.0+ GPL-3.0-only GPL-3.0-or-later"), ("GPL-2.0", "copyleft", "GPL-2.0 GPL-2.0+ GPL-2.0-only GPL-2.0-or-later"),
    ("LGPL", "copyleft", "LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1+ LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0+ LGPL-3.0-only LGPL-3.0-or-later"), ("AGPL-3.0", "copyleft", "AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later"),
    ("MPL-2.0", "copyleft", "MPL-2.0"), ("Unlicense", "public domain", "Unlicense"), ("CC0-1.0", "public domain", "CC0-1.0"), ("CC-BY-4.0", "permissive", "CC-BY-4.0"), ("CC-BY-SA-4.0", "copyleft", "CC-BY-SA-4.0"), ("CC-BY-NC-4.0", "non-commercial", "CC-BY-NC-4.0"),
)
#: Notices of fewer than five words.
SHORT_TEMPLATES = (
    ("All-rights-reserved", "proprietary", "All rights reserved."),
    *((name, kind, f"SPDX-License-Identifier: {i}") for name, kind, ids in SPDX for i in ids.split()),
)


def bare(word: str) -> str:
    return word.strip(".,;:!?()[]{}<>\"'`*#|/\\-_").lower()


class Words:
    def __init__(self):
        self.hashed = common.Memo(lambda w: xxhash.xxh64_intdigest(x.encode("utf-8", "replace")) | 1 if (x := bare(w)) else 0)

    def hashes(self, text: str | None) -> np.ndarray:
        """Hashes of the words of a text in order."""
        words = (text or "").split()
        w = np.fromiter(map(self.hashed.__getitem__, words), np.uint64, len(words))
        return w[w != 0]

    def __call__(self, text: str | None) -> np.ndarray:
        """Hashes of the shingles of a text in order."""
        return shingles(self.hashes(text), SHINGLE)


def shingles(w: np.ndarray, size: int) -> np.ndarray:
    if len(w) < size:
        return np.empty(0, np.uint64)
    h = w[: len(w) - size + 1].copy()
    for j in range(1, size):
        h *= _MIX
        h ^= h >> np.uint64(32)
        h += w[j : len(w) - size + 1 + j]
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def band_values(h: np.ndarray, bands: int) -> np.ndarray:
    """(bands, len(h)): the shingles under the bands' hash functions."""
    salts = np.random.default_rng(17).integers(1, 1 << 63, bands).astype(np.uint64) | np.uint64(1)
    x = h[None, :] * salts[:, None]
    x ^= x >> np.uint64(31)
    x *= _MIX
    return x ^ (x >> np.uint64(29))


class Scanner:
    def __init__(self, templates=TEMPLATES, bands: int = BANDS, containment: float = CONTAINMENT):
        self.words, self.bands, self.containment = Words(), bands, containment
        self.templates = []
        self.short: dict[int, dict[int, list[tuple[str, str]]]] = {}
        for name, kind, text in templates:
            w = self.words.hashes(text)
            if not len(w):
                raise ValueError(f"a template of {name} has no words")
            if len(w) < SHINGLE:
                self.short.setdefault(len(w), {}).setdefault(int(shingles(w, len(w))[0]), []).append((name, kind))
                continue
            s = np.unique(self.words(text))
            self.templates.append((name, kind, s))
        self.known = np.unique(np.concatenate([s for _, _, s in self.templates])) if self.templates else np.empty(0, np.uint64)
        self.ends = {n: np.array(sorted({x for x in table}), np.uint64) for n, table in self.short.items()}
        self.classes: dict[int, dict[tuple[int, int], list[int]]] = {}
        for k, (_, _, s) in enumerate(self.templates):
            c = 1 << (len(s) - 1).bit_length()
            for band, v in enumerate(band_values(s, bands).min(axis=1).tolist()):
                self.classes.setdefault(c, {}).setdefault((band, v), []).append(k)

    def scan(self, text: str | None) -> dict[str, tuple[str, float, int]]:
        """License: (kind, best share, first word of the first window that has it)."""
        w = self.words.hashes(text)
        h, found = shingles(w, SHINGLE), {}
        self.phrases(w, found)
        if not len(h) or not len(self.known):
            return found
        at = np.searchsorted(self.known, h)
        at[at == len(self.known)] = 0
        hits = np.flatnonzero(self.known[at] == h)
        if not len(hits):
            return found
        for c, index in self.classes.items():
            stride = max(1, c // 4)
            size = c + stride - 1
            last = max(0, len(h) - size + stride - 1) // stride
            opens = np.unique((hits // stride)[:, None] - np.arange(size // stride + 1)[None, :])
            for w in opens[(opens >= 0) & (opens <= last)]:
                window = h[w * stride : w * stride + size]
                near = {k for band, v in enumerate(band_values(window, self.bands).min(axis=1).tolist()) for k in index.get((band, v), ())}
                for k in sorted(near):
                    name, kind, s = self.templates[k]
                    share = np.isin(s, window).sum() / len(s)
                    if share >= self.containment and (name not in found or share > found[name][1]):
                        found[name] = (kind, float(share), int(w * stride))
        return found

    def phrases(self, w: np.ndarray, found: dict[str, tuple[str, float, int]]) -> None:
        """Short templates: the first place of each license."""
        for n, table in self.short.items():
            h, known = shingles(w, n), self.ends[n]
            at = np.searchsorted(known, h)
            at[at == len(known)] = 0
            for k in np.flatnonzero(known[at] == h).tolist():
                for name, kind in table[int(h[k])]:
                    if name not in found or k < found[name][2]:
                        found[name] = (kind, 1.0, k)


def scanner(templates, bands: int, containment: float) -> Scanner:
    return common.held(("licenses", templates, bands, containment), lambda: Scanner(templates, bands, containment))


def license_scan(docs: DataFrame, templates=TEMPLATES + SHORT_TEMPLATES, bands: int = BANDS, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, kind, containment, word): a row for each license found in a row of docs; one narrow pass."""
    df = common.id_text(docs, id_col, text_col)
    schema = f"doc_id {df.schema['doc_id'].dataType.simpleString()}, license string, kind string, containment double, word long"

    def run(batches):
        scan = scanner(tuple(templates), bands, containment).scan
        for b in common.pieces(batches):
            found = [scan(t) for t in b.column(1).to_pylist()]
            rows = [k for k, f in enumerate(found) for _ in f]
            hits = [(name, *v) for f in found for name, v in f.items()]
            cols = list(zip(*hits, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64())], names=["doc_id", "license", "kind", "containment", "word"])

    return df.mapInArrow(run, schema)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(common.table(spark, sf_dir, "documents"))
