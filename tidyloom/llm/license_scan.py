"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies.

Texts become words, and words shingles; windows of shingles overlap by half.  A window's circulant MinHash
signature is cut into bands, and a template with an equal band becomes its candidate.  A candidate counts if
the window holds at least the wanted share of the template's shingles, taken exactly.

Windows are twice as long as the templates of their size class and start at every half, so each stretch
as long as a template lies whole in one of them.  A window that holds the share ``c`` of a template then has a
Jaccard similarity of at least ``c / (4 + 1 - c)``; with ``bands`` bands of one row, it is missed with a chance of
``(1 - c / (5 - c)) ** bands``, 1e-6 for 0.8 and 64.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.llm.common import mix64, span_hashes, text_bytes, text_parts
from tidyloom.llm.minhash import circulant_signatures, shingles_in_order

# Public wording of license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met"
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction'
    ),
    "MIT-whole": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
        'SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
        "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    # The clauses that BSD-2 and BSD-3 have in common, and the third.
    "BSD-2-clauses": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "BSD-3-clause": "may be used to endorse or promote products derived from this software without specific prior written permission",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies"
    ),
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        'granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES'
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means"
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software"
    ),
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0",
    "MPL-1.1-header": "The contents of this file are subject to the Mozilla Public License Version 1.1",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "EPL-1.0-header": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0"
    ),
    "EPL-2.0-header": "are made available under the terms of the Eclipse Public License 2.0",
    "GPL-2.0": "GNU General Public License, version 2",
    "LGPL-2.1": "GNU Lesser General Public License, version 2.1",
    "LGPL-3.0": "GNU Lesser General Public License, version 3",
    "AGPL-3.0": "GNU Affero General Public License, version 3",
}
# The usual GNU header names one license and version: cut so that another one's header shares less than 0.8 of it.
for name, kind, version in (
    ("GPL-2.0", "General", "2"), ("GPL-3.0", "General", "3"), ("LGPL-2.0", "Library General", "2"),
    ("LGPL-2.1", "Lesser General", "2.1"), ("LGPL-3.0", "Lesser General", "3"), ("AGPL-3.0", "Affero General", "3"),
):
    TEMPLATES[f"{name}-header"] = (
        f"under the terms of the GNU {kind} Public License as published by the Free Software Foundation, either version {version} of the License"
    )
for code, terms in (
    ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
):
    for version, kind in (("3.0", "Unported"), ("4.0", "International")):
        TEMPLATES[f"CC-{code}-{version}"] = f"Licensed under CC {code} {version}"
        wording = terms.replace("NoDerivatives", "NoDerivs") if version == "3.0" else terms
        TEMPLATES[f"CC-{code}-{version}-notice"] = f"licensed under a Creative Commons {wording} {version} {kind} License"
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True


def public_licenses() -> dict[str, str]:
    """The notices of ``TEMPLATES`` and the whole texts in the folder ``licenses``, as ``<name>-text``."""
    folder = Path(__file__).parent / "licenses"
    return TEMPLATES | {f"{p.stem}-text": p.read_text(encoding="utf-8") for p in sorted(folder.glob("*.txt"))}


def ordered_shingles(data: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes in text order and their texts; words are runs of letters and digits, A-Z as a-z."""
    word = WORD[data] if len(data) else np.zeros(0, bool)
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    before, after = np.concatenate(([False], word)), np.concatenate((word, [False]))
    opens, closes = np.flatnonzero(after & (~before | edge)), np.flatnonzero(before & (~after | edge))
    return shingles_in_order(span_hashes(data, opens, closes), np.searchsorted(opens, starts), width)


class Templates:
    """Templates' shingle sets and, by size class, their bands."""

    def __init__(self, texts: dict[str, str], width: int, bands: int, rows: int):
        self.names, self.width, self.bands, self.rows = sorted(texts), width, bands, rows
        raw = [texts[n].encode() for n in self.names]
        shingles, owner = ordered_shingles(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))), width)
        self.sets = [np.unique(shingles[owner == i]) for i in range(len(raw))]
        self.all = np.unique(shingles)
        #: Window length by template: twice the next power of two of its shingles.
        self.window = [2 << max(0, int(len(s) - 1).bit_length()) for s in self.sets]
        keys = self.band_keys(np.concatenate(self.sets) if raw else np.zeros(0, np.uint64), np.concatenate(([0], np.cumsum([len(s) for s in self.sets]))).astype(np.int64))
        self.lookup: dict[tuple[int, int], set[int]] = {}
        for t, row in enumerate(keys.tolist()):
            for key in row:
                self.lookup.setdefault((self.window[t], key), set()).add(t)

    def band_keys(self, shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
        signatures = circulant_signatures(shingles, starts, self.bands * self.rows).astype(np.uint64)
        keys = np.zeros((len(signatures), self.bands), np.uint64)
        for r in range(self.rows):
            keys = mix64(keys * np.uint64(31) + signatures[:, r :: self.rows] + np.uint64(1))
        return mix64(keys + np.arange(self.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def scan(self, shingles: np.ndarray, least: float) -> list[tuple[str, float, int, int, int]]:
        """``name, containment, start, end, matches`` of each template in one text's ordered shingles.

        ``start`` and ``end``: words of the first match; windows that touch are one match.  A window without any
        template's shingle cannot share a band with one, so only windows around such shingles are signed.
        """
        hits = np.flatnonzero(np.isin(shingles, self.all))
        found: dict[int, list[tuple[int, int, float]]] = {}
        for size in sorted(set(self.window)) if len(hits) else ():
            half = size // 2
            last = max(0, -(-(len(shingles) - size) // half))
            windows = np.unique(np.clip(np.concatenate((hits // half - 1, hits // half)), 0, last))
            stops = np.minimum(windows * half + size, len(shingles))
            spans = np.concatenate([shingles[a:b] for a, b in zip(windows * half, stops)])
            starts = np.concatenate(([0], np.cumsum(stops - windows * half)))
            for w, keys in enumerate(self.band_keys(spans, starts).tolist()):
                inside = spans[starts[w] : starts[w + 1]]
                for t in set().union(*[self.lookup.get((size, key), ()) for key in keys]):
                    there = np.isin(inside, self.sets[t])
                    share = len(np.unique(inside[there])) / len(self.sets[t])
                    if share >= least:
                        places = np.flatnonzero(there) + windows[w] * half
                        found.setdefault(t, []).append((int(places[0]), int(places[-1]) + self.width, share))
        out = []
        for t, matches in sorted(found.items()):
            matches.sort()
            count, end = 0, -1
            for a, b, _ in matches:
                count += a >= end
                end = max(end, b)
            out.append((self.names[t], max(m[2] for m in matches), matches[0][0], matches[0][1], count))
        return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None, least: float = 0.8, width: int = 5, bands: int = 64, rows: int = 1) -> DataFrame:
    """``doc_id, license, containment, start_word, end_word, matches``: a row for each template found in a document.

    Whole texts of ``docs (doc_id, text, ...)`` are scanned row by row, without a shuffle.  Null and empty texts and
    documents with fewer than ``width`` words match nothing; a template needs ``width`` words.  Repeated rows give repeated
    results; other columns are not read.  ``templates``: texts by name, or a table ``license, text`` that fits in the driver; by
    default ``public_licenses()``.  Texts that share their wording, such as versions of one license, may match together:
    the highest ``containment`` tells them apart.
    """
    if isinstance(templates, DataFrame):
        named = [(r["license"], r["text"]) for r in templates.select("license", "text").dropna().collect()]
        templates = dict(named)
        if len(templates) < len(named):
            raise ValueError("templates need different names")
    known = Templates(public_licenses() if templates is None else templates, width, bands, rows)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch, "text"):
                shingles, owner = ordered_shingles(*text_bytes(part.column("text")), width)
                hit = np.unique(owner[np.isin(shingles, known.all)])
                begin = np.searchsorted(owner, np.arange(part.num_rows + 1))
                ids = part.column("doc_id")
                out = [(ids[i].as_py(), *m) for i in hit.tolist() for m in known.scan(shingles[begin[i] : begin[i + 1]], least)]
                types = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["doc_id", "license", "containment", "start_word", "end_word", "matches"])

    schema = "doc_id bigint, license string, containment double, start_word bigint, end_word bigint, matches bigint"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(scan, schema)
