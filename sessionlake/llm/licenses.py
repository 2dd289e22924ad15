"""License notices in whole texts: MinHash bands over overlapping windows retrieve templates, shingle containment verifies.

Words are lower-cased and cut at white space and ASCII punctuation. For a template of n words, windows of n + step words start every
step = max(1, n // 4) words, so any stretch of n words lies inside one window. A window and a template it contains to 0.75
then have a Jaccard similarity of at least 0.4 (collision_bound computes it for each length), and with BANDS = 24 bands of one MinHash each, a pair at that similarity
collides in a band with a probability over 1 - 1e-5. A band collision means that the template's smallest shingle under the band's order lies in
the window; windows that hold none of these shingles can't collide, so MinHashes are computed for the others only.
Colliding pairs are verified exactly: the share of the template's distinct shingles in the window must reach 0.75.

Templates compete for words. A match yields to one of another licence that holds more shingles within its span, or as many and more in all, or as
many in all and a greater share of its own; only matches that stay make others yield. So versions of one notice are told apart, a notice printed inside a
full text is not a grant of its own, and templates that fit equally well are all reported.

Templates are broadcast; their number is checked against MAX_TEMPLATES. Documents are not shuffled.

Defined cases: null and empty texts match nothing; texts or templates of fewer than five words are one shingle; blank
templates match nothing; repeated rows are reported each; the result has named columns only.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.common import pieces
from sessionlake.llm.words import mix, shingles, words

BANDS = 24
SHINGLE = 5
CONTAINMENT = 0.75
MAX_TEMPLATES = 20_000
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())

# fixed values: notices and first sentences of public licences, by SPDX identifier; default_templates adds NOTICES and the full texts
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0-or-later", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)

# full texts, a file each: named by the version alone, since a text does not say whether later versions are allowed
FULL_TEXTS = Path(__file__).parent / "licence_texts"

_GNU = "under the terms of the GNU {} as published by the Free Software Foundation"
_FAMILIES = (("GPL", "General Public License", (1, 2, 3)), ("LGPL", "Library General Public License", (2,)), ("LGPL", "Lesser General Public License", (2.1, 3)), ("AGPL", "Affero General Public License", (3,)))
_CREATIVE = (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
             ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))


def _notices() -> Iterator[tuple[str, str]]:
    """Standard notices by SPDX identifier."""
    for family, name, versions in _FAMILIES:
        for version in versions:
            for suffix, ending in (("only", f"version {version} of the License"), ("only", f"version {version}"), ("or-later", f"either version {version} of the License, or (at your option) any later version")):
                yield f"{family}-{float(version)}-{suffix}", f"{_GNU.format(name)}, {ending}"
            yield f"{family}-{float(version)}-only", f"This work is licensed under the GNU {name}, version {version}"
            yield f"{family}-{float(version)}-or-later", f"This work is licensed under the GNU {name}, version {version} or later"
    yield "GPL-2.0-or-later", f"{_GNU.format('General Public License')}; either version 2, or (at your option) any later version"
    for code, name in _CREATIVE:
        yield f"CC-{code}-4.0", f"Licensed under CC {code} 4.0"
        yield f"CC-{code}-4.0", f"This work is licensed under a Creative Commons {name} 4.0 International License"
        yield f"CC-{code}-4.0", f"This work is licensed under the Creative Commons {name} 4.0 International License"
        yield f"CC-{code}-3.0", f"This work is licensed under a Creative Commons {name} 3.0 Unported License"
    yield "CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"
    yield "CC0-1.0", "dedicated to the public domain under CC0 1.0 Universal"
    for version in ("1.0", "2.0"):
        yield f"EPL-{version}", f"This program and the accompanying materials are made available under the terms of the Eclipse Public License v{version}"
        yield f"EPL-{version}", f"Licensed under the Eclipse Public License, Version {version}"
    yield "EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"
    yield "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"
    yield "0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED AS IS"
    yield "ISC", "Released under the ISC License"
    yield "BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    yield "BSD-2-Clause", "Licensed under the BSD 2-Clause License"
    yield "BSD-3-Clause", "Licensed under the BSD 3-Clause License"


NOTICES = tuple(dict.fromkeys(pair for pair in _notices() if pair not in TEMPLATES))


def window_of(length: int) -> tuple[int, int]:
    """Words of a window, and words between window starts, for a template of so many words."""
    step = max(1, length // 4)
    return length + step, step


def collision_bound(length: int, bands: int = BANDS, containment: float = CONTAINMENT) -> float:
    """Least probability that a window that contains a template of so many words to `containment` shares a band with it."""
    own = max(1, length - SHINGLE + 1)
    held = int(np.ceil(containment * own))
    near = held / (max(1, window_of(length)[0] - SHINGLE + 1) + own - held)
    return 1 - (1 - near) ** bands


class Library:
    """Templates by length, their shingles, and their band keys."""

    def __init__(self, texts: list[str], bands: int = BANDS):
        self.seeds = mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.sets, self.lengths, keys = [], [], []
        self.bands: dict[tuple[int, int, int], list[int]] = {}
        for t, text in enumerate(texts):
            w = words(pa.array([text]), PUNCTUATION)
            h = np.unique(shingles(w, SHINGLE)[0])
            self.sets.append(h)
            self.lengths.append(len(w.hashes))
            if not len(h):
                continue
            order = mix(h[:, None] ^ self.seeds)
            for band, at in enumerate(order.argmin(axis=0)):
                self.bands.setdefault((len(w.hashes), band, int(order[at, band])), []).append(t)
                keys.append(h[at])
        self.keys = np.unique(np.array(keys, dtype=np.uint64))
        self.filter = np.zeros(1 << 16, dtype=bool)
        self.filter[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def holding(self, h: np.ndarray) -> np.ndarray:
        """Places of shingles that are some template's smallest in some band."""
        at = np.flatnonzero(self.filter[(h & np.uint64(0xFFFF)).astype(np.int64)])
        return at[np.isin(h[at], self.keys)]

    def match(self, h: np.ndarray, hits: np.ndarray, containment: float) -> Iterator[tuple[int, np.ndarray, int]]:
        """(template, places of its shingles, shared shingles) of windows of one text's shingles that contain a template."""
        # A text of fewer shingles than a template has to share can't contain it.
        for length in sorted({n for n, s in zip(self.lengths, self.sets) if len(s) and len(h) >= containment * len(s)}):
            size, step = window_of(length)
            span = max(1, size - SHINGLE + 1)
            starts = sorted({int(k) * step for hit in hits.tolist() for k in range(max(0, -(-(hit - span + 1) // step)), hit // step + 1)})
            for start in starts:
                window = np.unique(h[start:start + span])
                lowest = mix(window[:, None] ^ self.seeds).min(axis=0).tolist()
                near = {t for band, low in enumerate(lowest) for t in self.bands.get((length, band, low), ())}
                for t in sorted(near):
                    inside = np.isin(h[start:start + span], self.sets[t])
                    shared = len(np.unique(h[start:start + span][inside]))
                    if shared >= containment * len(self.sets[t]):
                        yield t, start + np.flatnonzero(inside), shared

    def settle(self, h: np.ndarray, matches: list[tuple[int, np.ndarray, int]], names: list) -> list[tuple[int, int, int, int]]:
        """(template, first word, words, shared shingles) of the matches that yield to none of another licence."""
        rank = lambda m: (m[2], m[2] / len(self.sets[m[0]]))
        stay: list[tuple[int, np.ndarray, int]] = []
        for m in sorted(matches, key=rank, reverse=True):
            first, last = m[1][0], m[1][-1]
            for other in stay:
                if names[other[0]] != names[m[0]] and other[1][0] <= last and other[1][-1] >= first:
                    over = other[1][(other[1] >= first) & (other[1] <= last)]
                    held = len(np.unique(h[over]))
                    if held > m[2] or held == m[2] and rank(other) > rank(m):
                        break
            else:
                stay.append(m)
        return [(t, int(places[0]), int(places[-1] - places[0]) + SHINGLE, shared) for t, places, shared in stay]


def scan_licenses(docs: DataFrame, templates: DataFrame, id_column: str = "doc_id", text: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """id, license, template_id, start_word, n_words, shared, shingles, n_windows: a row for each template a text contains, at its best window.

    templates: template_id long, license string, text string.
    """
    spark = docs.sparkSession
    rows = templates.select("template_id", "license", "text").limit(MAX_TEMPLATES + 1).collect()
    if len(rows) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates; scan in parts")
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2] or ""))
    shared_library = spark.sparkContext.broadcast((Library([r[2] or "" for r in rows]), [r[0] for r in rows], [r[1] for r in rows]))
    source = docs.select(docs[f"`{id_column}`"].alias("id"), docs[f"`{text}`"].alias("text"))
    id_type = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, ids, names = shared_library.value
        for batch in pieces(batches, "text"):
            h, bounds = shingles(words(batch.column("text"), PUNCTUATION), SHINGLE)
            hits = library.holding(h)
            text_of = np.searchsorted(bounds, hits, "right") - 1
            out = []
            for i in np.unique(text_of).tolist():
                best: dict[int, tuple] = {}
                count: dict[int, int] = {}
                own = h[bounds[i]:bounds[i + 1]]
                for t, start, length, shared in library.settle(own, list(library.match(own, hits[text_of == i] - bounds[i], containment)), names):
                    count[t] = count.get(t, 0) + 1
                    best[t] = min(best.get(t, (1,)), (-shared, start, length))
                out += [(i, t, best[t][1], best[t][2], -best[t][0], count[t]) for t in sorted(best)]
            pick = pa.array([r[0] for r in out], pa.int64())
            number = lambda k: pa.array([r[k] for r in out], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pick), pa.array([names[r[1]] for r in out], pa.string()), pa.array([ids[r[1]] for r in out], pa.int64()),
                                              number(2), number(3), number(4), pa.array([len(library.sets[r[1]]) for r in out], pa.int64()), number(5)],
                                             names=["id", "license", "template_id", "start_word", "n_words", "shared", "shingles", "n_windows"])

    return source.mapInArrow(run, f"id {id_type}, license string, template_id long, start_word long, n_words long, shared long, shingles long, n_windows long")


def default_templates(spark) -> DataFrame:
    full = tuple((path.stem, path.read_text(encoding="utf-8")) for path in sorted(FULL_TEXTS.glob("*.txt")))
    return spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(TEMPLATES + NOTICES + full)], "template_id long, license string, text string")


def license_rows(found: DataFrame) -> DataFrame:
    return found.select(F.col("id").alias("doc_id"), "license", "template_id", "start_word", "n_words", "shared", "shingles", "n_windows")
