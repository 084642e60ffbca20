"""Licence scan: sparse TF-IDF cosine of notices to templates, then inheritance from the nearest ancestor directory.

Every text is read whole, as lines and their sentences, runs of consecutive ones of these (up to the longest template's
number of terms between the first and the last), blank-line paragraphs, and the text itself. Templates are header
notices, the titles and openings of licence files, and the whole terms of short licences. A unit's licence is
the template of the highest cosine of at least ``threshold`` (of a template of up to three terms: ``TITLE``); a text's is that of its best unit. Terms are runs of
letters and digits, lower-cased, weighted ``(1 + log tf) * idf``; document frequencies of template terms are counted
over all texts, and other terms weigh as the median template term. Only units with one of the heavy terms of a template
are scored: a unit with none of them cannot reach the threshold, as the rest of that template's vector is too short.

A row is a licence file if its name says so (LICENSE, LICENCE, COPYING, COPYRIGHT, NOTICE), its whole text is
a template but for a few words, or its notice makes up at least half of its terms. Rows without a licence of their own take that of the licence file in the nearest directory above them: paths
are joined on their ancestors, after the distinct directories alone. Several licence files in a directory: the best
score, then the smallest path.

Result: ``id_col, path, license, score, line, origin`` (own, inherited, none), one row per input row, repeated rows
included. Null, empty and unmatched texts have no licence of their own; a null path inherits nothing. Ties between
templates go to the first name in alphabetical order, between units to the first. Very long texts are read like any other, in one pass over their lines.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.session import cut

from .frames import mapped
from .text import hash_words, slices
from .toxicity import WORDS

#: Notices, titles, openings and short terms of well-known licences: fixed values. A licence may have several.
TEMPLATES = {
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        'TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.',
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Released under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "BSL-1.0": [
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so.',
        "Distributed under the Boost Software License, Version 1.0.",
        "Boost Software License - Version 1.0 - August 17th, 2003",
    ],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International Public License"],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International Public License"],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.", "Creative Commons Attribution-ShareAlike 4.0 International Public License"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0 Universal.", "Creative Commons Legal Code CC0 1.0 Universal"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "Eclipse Public License - v 2.0", "SPDX-License-Identifier: EPL-2.0"],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 2.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "ISC License", "SPDX-License-Identifier: ISC"],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "MIT License",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Mozilla Public License Version 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", "SPDX-License-Identifier: Zlib"],
}
#: Parts that the rows of one directory are dealt to.
PARTS = 16
#: Cosine of a whole text from which it is a licence file whatever its name, and share of its terms that are in its notice.
FILE, SHARE = 0.85, 0.5
#: Least cosine to a template of up to three terms.
TITLE = 0.95
_TERM = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])[ \t]+")
_FILE = r"(?i)(^|/)(licen[cs]e|copying|copyright|notice)[^/]*$"


def terms(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for t in _TERM.findall(text.lower()):
        out[t] = out.get(t, 0) + 1
    return out


def document_frequencies(docs: DataFrame, vocabulary: list[str], text_col: str) -> tuple[dict[str, int], int]:
    """How many of all texts have each term, and the number of texts."""
    keys = hash_words(pa.array(vocabulary, pa.large_string()), WORDS, fold=True)[0]
    order = np.argsort(keys)
    known, names = keys[order], np.array(vocabulary)[order]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(known), np.int64), 0
        for batch in batches:
            for _, texts in slices(batch, text_col):
                rows += len(texts)
                words, first = hash_words(texts, WORDS, fold=True)
                at = np.minimum(np.searchsorted(known, words), len(known) - 1)
                hit = np.flatnonzero(known[at] == words)
                doc = np.searchsorted(first, hit, "right") - 1
                total += np.bincount(np.unique(doc * len(known) + at[hit]) % len(known), minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(known) + 1, dtype=np.int32)), pa.array(np.append(total, rows))], ["at", "n"])

    got = mapped(docs.select(text_col), run, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect()
    by = {r["at"]: r["n"] for r in got}
    return {str(names[k]): by.get(k, 0) for k in range(len(known))}, by.get(len(known), 0)


class Scanner:
    """Templates as sparse unit vectors, and the heavy terms that any matching unit must have one of."""

    def __init__(self, df: dict[str, int], n: int, threshold: float, templates: dict[str, list[str]] = TEMPLATES):
        self.idf = {t: math.log((1 + n) / (1 + c)) + 1 for t, c in df.items()}
        self.other = float(np.median(list(self.idf.values())))
        self.threshold = threshold
        self.templates = [(name, self.vector(text)) for name in sorted(templates) for text in templates[name]]
        self.least = [threshold if len(v) > 3 else max(threshold, TITLE) for _, v in self.templates]
        heavy = set()
        for (_, v), least in zip(self.templates, self.least, strict=True):
            rest, order = 1.0, sorted(v, key=lambda t: (-v[t], t))
            for t in order:
                if rest < least * least - 1e-9:
                    break
                heavy.add(t)
                rest -= v[t] * v[t]
        self.heavy = frozenset(heavy)
        self.longest = max(len(_TERM.findall(text)) for texts in templates.values() for text in texts)
        self.by_term: dict[str, list[tuple[int, float]]] = {}
        self.in_runs: dict[str, list[tuple[int, float]]] = {}  # of templates that may be spread over several pieces
        for k, (_, v) in enumerate(self.templates):
            for t, w in v.items():
                self.by_term.setdefault(t, []).append((k, w))
                if self.least[k] == threshold:
                    self.in_runs.setdefault(t, []).append((k, w))

    def vector(self, text: str) -> dict[str, float]:
        v = {t: (1 + math.log(c)) * self.idf.get(t, self.other) for t, c in terms(text).items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {t: x / norm for t, x in v.items()}

    def best(self, unit: str) -> tuple[float, str] | None:
        v = self.vector(unit)
        if self.heavy.isdisjoint(v):
            return None
        score = [0.0] * len(self.templates)
        for t, x in v.items():
            for k, w in self.by_term.get(t, ()):
                score[k] += w * x
        k = max((k for k, x in enumerate(score) if x >= self.least[k] - 1e-12), key=lambda k: (score[k], -k), default=None)
        return None if k is None else (min(1.0, score[k]), self.templates[k][0])

    def best_run(self, pieces: list[list[str]]) -> tuple[float, int, int]:
        """Cosine, first and last of those consecutive pieces (lists of terms), two at least, that come closest to a template that is no title."""
        total = np.concatenate([[0], np.cumsum([len(x) for x in pieces])]).tolist()
        cover, held = [0.0] * len(self.templates), {}  # of each template, what the terms in reach of a start are of its squared length
        best, last = (0.0, 0, 0), -1
        for i, own in enumerate(pieces):
            while last + 1 < len(pieces) and (last <= i or total[last + 1] - total[i + 1] <= self.longest):
                last += 1
                for t in pieces[last]:
                    if t in self.in_runs:
                        held[t] = held.get(t, 0) + 1
                        if held[t] == 1:
                            for k, w in self.in_runs[t]:
                                cover[k] += w * w
            if own and max(cover) >= self.threshold * self.threshold - 1e-6:  # else no run from here can reach the threshold
                count, score, norm = {}, [0.0] * len(self.templates), 0.0
                for j in range(i, last + 1):
                    for t in pieces[j]:
                        c = count[t] = count.get(t, 0) + 1
                        x = self.idf.get(t, self.other)
                        old, new = x * (1 + math.log(c - 1)) if c > 1 else 0.0, x * (1 + math.log(c))
                        norm += new * new - old * old
                        for k, w in self.in_runs.get(t, ()):
                            score[k] += w * (new - old)
                    if j > i and pieces[j] and (s := max(score) / math.sqrt(norm)) > best[0] + 1e-12:
                        best = (s, i, j)
            for t in own:
                if t in self.in_runs:
                    held[t] -= 1
                    if not held[t]:
                        for k, w in self.in_runs[t]:
                            cover[k] -= w * w
        return best

    def scan(self, text: str) -> tuple[float, str, int, bool] | None:
        """Score, licence, 1-based line of the best unit, and whether the whole text matches."""
        found: tuple[float, str, int] | None = None
        whole, notice = self.best(text), ""
        is_file = whole is not None and whole[0] >= FILE

        def offer(unit: str, line: int) -> None:
            nonlocal found, notice
            got = self.best(unit)
            if got and (found is None or got[0] > found[0] + 1e-12):
                found, notice = (*got, line), unit

        line, pieces = 1, []
        for paragraph in re.split(r"(\n[ \t\r]*\n)", text):
            if paragraph.strip():
                lines = paragraph.split("\n")
                if len(lines) > 1:
                    offer(paragraph, line)
                for k, one in enumerate(lines):
                    offer(one, line + k)
                    sentences = _SENTENCE.split(one)
                    pieces += [(s, line + k) for s in sentences]
                    if len(sentences) > 1:
                        for s in sentences:
                            offer(s, line + k)
            line += paragraph.count("\n")
        s, a, b = self.best_run([_TERM.findall(x.lower()) for x, _ in pieces])
        if s >= self.threshold - 1e-9:
            offer("\n".join(x for x, _ in pieces[a : b + 1]), pieces[a][1])
        if whole and (found is None or whole[0] >= found[0]):
            return (*whole, 1, True)
        return (*found, is_file or len(_TERM.findall(notice)) >= SHARE * len(_TERM.findall(text))) if found else None


def scan(docs: DataFrame, path: Column, threshold: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, path, own, own_score, line, is_file``: each row's own licence."""
    vocabulary = sorted({t for texts in TEMPLATES.values() for x in texts for t in terms(x)})
    scanner = Scanner(*document_frequencies(docs, vocabulary, text_col), threshold)
    pattern = r"(?i)(^|[^a-z0-9])(" + "|".join(sorted(scanner.heavy)) + r")($|[^a-z0-9])"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch, "text"):
                out = [None] * len(texts)
                for k in np.flatnonzero(pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)).tolist():
                    out[k] = scanner.scan(texts[k].as_py())
                cols = [pa.array([o[j] if o else None for o in out], t) for j, t in ((1, pa.string()), (0, pa.float64()), (2, pa.int32()))]
                yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("path"), *cols, pa.array([bool(o and o[3]) for o in out])], ["id", "path", "own", "own_score", "line", "whole"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = mapped(docs.select(F.col(id_col).alias("id"), path.cast("string").alias("path"), F.col(text_col).alias("text")), run, f"id {kind}, path string, own string, own_score double, line int, whole boolean")
    return found.withColumn("is_file", F.col("own").isNotNull() & (F.col("whole") | F.coalesce(F.col("path").rlike(_FILE), F.lit(False)))).drop("whole")


def inherit(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col, path, license, score, line, origin`` from the rows of :func:`scan`, which are kept: files, directories and rows come from one scan."""
    found = cut(found)
    folder = F.regexp_replace("path", r"(^|/)[^/]*$", "")
    rows = found.withColumn("dir", folder)
    files = rows.where("is_file AND path IS NOT NULL").groupBy(F.col("dir").alias("above")).agg(F.min(F.struct((-F.col("own_score")).alias("s"), "path", F.col("own").alias("license"))).alias("file"))
    dirs = rows.where("own IS NULL AND path IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("above")).distinct()
    nearest = above.join(files, "above").groupBy("dir").agg(F.max_by(F.struct("file.license", F.col("file.s").alias("s")), F.length("above")).alias("near"))
    # rows of one directory may be a large share of all: they are dealt to parts, each with its copy of the directory's row
    rows = rows.withColumn("part", F.pmod(F.xxhash64("path"), F.lit(PARTS)).cast("int"))
    out = rows.join(nearest.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), ["dir", "part"], "left")
    own = F.col("own").isNotNull()
    return out.select(
        F.col("id").alias(id_col),
        "path",
        F.when(own, F.col("own")).otherwise(F.col("near.license")).alias("license"),
        F.when(own, F.col("own_score")).otherwise(-F.col("near.s")).alias("score"),
        "line",
        F.when(own, F.lit("own")).when(F.col("near").isNotNull(), F.lit("inherited")).otherwise(F.lit("none")).alias("origin"),
    )
