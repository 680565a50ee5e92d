"""License scans: MinHash bands retrieve templates, exact containment verifies.

A text's words, without punctuation, become shingles of three; windows of two
neighbouring blocks of eight shingles overlap by one block, so every run of
up to nine shingles lies whole in one window. A template is cut into pieces of
at most eight shingles. A match holds a share of the template's shingles, so
of its pieces one at least has that share, and what a piece then has in common
with the window that it lies in bounds their likeness from below. The number of
bands, one hash each, follows from the least of these: some band meets with the
probability asked for. What meets is then verified exactly, by the share of the
template's shingles in a stretch of its own length.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _powers, mix, text_chunks, words

SHINGLE, BLOCK = 3, 8
CONTAINED = 0.8
SURE = 0.9999
# Notices by license.
TEMPLATES = {
    "AGPL-3.0": ["it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ],
    "BSD-2-Clause": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "LGPL-3.0": ["it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
_PLAIN = np.arange(256, dtype=np.uint8)
for _c in range(33, 127):
    if not chr(_c).isalnum():
        _PLAIN[_c] = 32


def located_shingles(offsets: np.ndarray, raw: np.ndarray):
    """(hash, text, first word within the text) of each shingle of a slice."""
    h, row, _, _ = words(offsets, _PLAIN[raw])
    n = max(len(h) - SHINGLE + 1, 0)
    out = np.zeros(n, np.uint64)
    for j, c in enumerate(_powers(np.uint64(0xD6E8FEB86659FD93), SHINGLE + 1)[1:]):
        out += h[j : j + n] * c
    at = np.flatnonzero(row[:n] == row[SHINGLE - 1 :]) if n else np.zeros(0, np.int64)
    first = np.searchsorted(row, np.arange(len(offsets)))
    return mix(out[at]), row[at], at - first[row[at]]


def least_likeness(n: int, contained: float) -> float:
    """Of a piece of ``n`` shingles, as many of which as a match has, and a full window around them."""
    held = max(math.ceil(contained * n - 1e-9), 1)
    return held / (2 * BLOCK + n - held)


class Index:
    """Templates, their pieces' minima, and the bands."""

    def __init__(self, templates: dict[str, list[str]], sure: float = SURE, contained: float = CONTAINED) -> None:
        self.names, self.shingles, pieces = [], [], []
        for name, notices in sorted(templates.items()):
            for notice in notices:
                raw = np.frombuffer(notice.encode(), np.uint8)
                s = located_shingles(np.array([0, len(raw)]), raw)[0]
                if not len(s):
                    raise ValueError(f"a template of fewer than {SHINGLE} words: {notice!r}")
                pieces += [(len(self.names), p) for p in np.array_split(s, -(-len(s) // BLOCK))]
                self.names.append(name)
                self.shingles.append(s)
        self.bands = math.ceil(math.log(1 - sure) / math.log(1 - min(least_likeness(len(np.unique(p)), contained) for _, p in pieces)))
        self.factors = mix(np.arange(1, self.bands + 1, dtype=np.uint64)) | np.uint64(1)
        self.owner = np.array([t for t, _ in pieces])
        self.minima = np.array([[(p * f).min() for f in self.factors] for _, p in pieces])

    def candidates(self, s: np.ndarray, row: np.ndarray, at: np.ndarray):
        """(first shingle, end shingle, template) of windows that meet a piece."""
        opens = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (at[1:] % BLOCK == 0)])
        ends = np.r_[opens[1:], len(s)]
        joined = np.r_[row[opens[1:]] == row[opens[:-1]], False] if len(opens) > 1 else np.zeros(len(opens), bool)
        stop = np.where(joined, np.r_[ends[1:], len(s)], ends)
        found = set()
        for band, f in enumerate(self.factors):
            low = np.minimum.reduceat(s * f, opens)
            both = np.where(joined, np.minimum(low, np.r_[low[1:], low[-1:]]), low)
            wanted = self.minima[:, band]
            order = np.argsort(wanted)
            place = np.minimum(np.searchsorted(wanted[order], both), len(wanted) - 1)
            for w in np.flatnonzero(wanted[order][place] == both):
                for p in np.flatnonzero(wanted == both[w]):
                    found.add((int(opens[w]), int(stop[w]), int(self.owner[p])))
        return sorted(found)

    def matches(self, s: np.ndarray, row: np.ndarray, at: np.ndarray, contained: float):
        """(text, template, first word, words, containment) of verified stretches."""
        best = {}
        for begin, end, t in self.candidates(s, row, at) if len(s) else ():
            own, n = self.shingles[t], len(self.shingles[t])
            lo, hi = begin - int(min(at[begin], n)), end
            while hi < len(s) and hi < end + n and row[hi] == row[begin]:
                hi += 1
            known = np.isin(s[lo:hi], own)
            sums = np.convolve(known, np.ones(min(n, len(known)), int), "valid") if len(known) else np.zeros(1)
            distinct = len(np.unique(own))
            for k in np.flatnonzero(sums >= contained * distinct - 1e-9) + lo:
                held = len(np.intersect1d(s[k : min(k + n, hi)], own))
                if held / distinct >= contained:
                    best.setdefault((int(row[begin]), t), {})[int(at[k])] = held
        out = []
        for (r, t), places in sorted(best.items()):
            n, distinct = len(self.shingles[t]) + SHINGLE - 1, len(np.unique(self.shingles[t]))
            out += [(r, self.names[t], w, n, places[w] / distinct) for w in _apart(places, n)]
        return _clearest(sorted(out, key=lambda x: (x[0], x[2], x[1])))


def _clearest(rows: list[tuple]) -> list[tuple]:
    """Matches that overlap no kept match of another license that holds more of its notice.

    They are asked by falling containment, so one that is put out itself puts
    out nothing. Rows come and go in order of text and place.
    """
    kept: list[int] = []
    places: dict[int, list[tuple]] = {}  # of each text, what is kept, by first word
    longest = max((n for _, _, _, n, _ in rows), default=0)
    for i in sorted(range(len(rows)), key=lambda i: (-rows[i][4], i)):
        text, name, begin, n, held = rows[i]
        near = places.setdefault(text, [])
        at = bisect.bisect_left(near, (begin - longest + 1,))
        while at < len(near) and near[at][0] < begin + n:
            first, past, other, more = near[at]
            if past > begin and other != name and more > held:
                break
            at += 1
        else:
            kept.append(i)
            bisect.insort(near, (begin, begin + n, name, held))
    return [rows[i] for i in sorted(kept)]


def _apart(places: dict[int, int], n: int) -> list[int]:
    """Places at least ``n`` words apart that hold the most shingles in all, the earliest of equal ones."""
    words = sorted(places)
    after = [bisect.bisect_left(words, w + n) for w in words]
    most = [0] * (len(words) + 1)
    for i in range(len(words) - 1, -1, -1):
        most[i] = max(most[i + 1], places[words[i]] + most[after[i]])
    out, i = [], 0
    while i < len(words):
        taken = places[words[i]] + most[after[i]] == most[i]
        if taken:
            out.append(words[i])
        i = after[i] if taken else i + 1
    return out


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, contained: float = CONTAINED, sure: float = SURE) -> DataFrame:
    """(doc_id, license, start, n_words, containment) of each notice found.

    ``start`` counts words from 0 with punctuation as white space, ``n_words``
    is the template's length and ``containment`` the share of its distinct
    shingles that the stretch holds. A null or empty text and one without a
    notice gives no row; equal texts give equal rows each; a notice that
    occurs several times gives a row for each place; where notices of
    different licenses overlap, as nearly equal ones do, those of the greatest
    containment stay; an empty table gives none. Extra columns are left out. Nothing is shuffled.
    """
    index = Index(TEMPLATES if templates is None else templates, sure, contained)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = []
            for row, offsets, raw in text_chunks(batch):
                rows += [(ids[row + r], *m) for r, *m in index.matches(*located_shingles(offsets, raw), contained)]
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "license", "start", "n_words", "containment"])

    schema = "doc_id long, license string, start long, n_words long, containment double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
