"""License scan: MinHash bands over overlapping word windows, then exact shingle containment.

For each template the windows of its own length, and of 1.25 and 1.5 times that (for notices
that other words interrupt), are compared with it. A window's signature
holds the least hash of its 5-word shingles under ``bands * rows`` seeded hashes; one equal
band retrieves the template. A window that holds 0.8 of a template's shingles has at least
similarity 0.8 / (w + 0.2), w being its length in template lengths: 0.67, 0.55 and 0.47. With 16
bands of 2 rows it is retrieved with probability 0.9999, 0.997 or 0.98, and several windows hold
it; an exact copy is always retrieved. What is retrieved is
verified by the share of the template's shingles that the window holds.

A band can only be equal where a shingle that is some template's least one occurs, so
documents without any such shingle are passed over before signatures are made.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import common as C
from tallyspark.session import ship_package

# fixed values: public license notices, by SPDX identifier
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
        "by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
        "language governing permissions and limitations under the License."),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution."),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "MIT": "Released under the MIT License.",
    "MIT-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
}


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    bands: int = 16
    rows: int = 2
    containment: float = 0.8
    widths: tuple[float, ...] = (1.0, 1.25, 1.5)  #: lengths of windows in template lengths
    seed: int = 97


_CODES = C.byte_codes(307, fold_case=True)
_LETTER = np.zeros(256, np.uint8)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = 1


def _words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word: runs of letters and digits, small and capital alike."""
    starts, ends, rows = C.runs(_LETTER[buf], offs)
    return C.span_hashes(buf, starts, ends, _CODES), rows


def _seeds(s: Settings) -> np.ndarray:
    return np.random.default_rng(s.seed).integers(1, 1 << 63, s.bands * s.rows, dtype=np.uint64)


def window_minima(h: np.ndarray, size: int) -> np.ndarray:
    """Least value in every window of ``size`` along the last axis, by doubling steps."""
    span = 1
    while 2 * span <= size:
        h = np.minimum(h[..., :h.shape[-1] - span], h[..., span:])
        span *= 2
    return np.minimum(h[..., :h.shape[-1] - (size - span)], h[..., size - span:]) if size > span else h


def _bands(minima: np.ndarray, s: Settings) -> np.ndarray:
    """Band keys (bands x windows) from minima (hashes x windows)."""
    m = minima.reshape(s.bands, s.rows, -1)
    key = m[:, 0].copy()
    for k in range(1, s.rows):
        key = C.mix(key * np.uint64(31) + m[:, k])
    return key + np.arange(s.bands, dtype=np.uint64)[:, None]


class Scanner:
    """Templates with their shingles and band keys."""

    def __init__(self, templates: dict[str, str], s: Settings) -> None:
        self.s, self.seeds = s, _seeds(s)
        self.names = sorted(templates)
        self.sets, self.lengths, bands, least = [], [], [], []
        for name in self.names:
            raw = np.frombuffer(templates[name].encode(), np.uint8)
            h, rows = _words(raw, np.array([0, len(raw)]))
            g, _ = C.ngram_hashes(h, rows, s.shingle)
            if not len(g):
                raise ValueError(f"template {name} has under {s.shingle} words")
            self.sets.append(np.unique(g))
            self.lengths.append(len(g))
            x = C.mix(g[None, :] ^ self.seeds[:, None])
            least.append(g[x.argmin(axis=1)])
            bands.append(_bands(x.min(axis=1)[:, None], s)[:, 0])
        self.bands, self.least = bands, np.unique(np.concatenate(least))

    def scan(self, g: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(template, first shingle, shingles, containment) of a document's matches; the best of overlapping ones."""
        s, out = self.s, []
        hashes = C.mix(g[None, :] ^ self.seeds[:, None])
        by_length: dict[int, np.ndarray] = {}
        for t, (own, size) in enumerate(zip(self.sets, self.lengths, strict=True)):
            found, mine = [], None
            for width in sorted({min(round(size * w), len(g)) for w in s.widths}):
                if width not in by_length:
                    by_length[width] = _bands(window_minima(hashes, width), s)
                at = np.flatnonzero((by_length[width] == self.bands[t][:, None]).any(axis=0))
                if len(at) and mine is None:
                    mine = np.isin(g, own)
                for k in at.tolist():
                    share = len(np.unique(g[k:k + width][mine[k:k + width]])) / len(own)
                    if share >= s.containment:
                        found.append((-share, width, k))
            taken: list[tuple[int, int]] = []
            for share, width, k in sorted(found):
                if all(k + width <= x or x + n <= k for x, n in taken):
                    taken.append((k, width))
                    out.append((t, k, width, -share))
        return sorted(out, key=lambda x: (x[1], x[0]))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, settings: Settings | None = None) -> DataFrame:
    """(doc_id, license, first_word, n_words, containment): one row per match.

    Matches of one template don't overlap (the best containment, then the shortest window, then the
    first, wins); matches of different templates may. Documents without a match, null and short texts have
    no row; repeated rows give their matches each; a null doc_id stays. An empty
    table gives no rows. Columns besides doc_id and text are ignored.
    """
    s = settings or Settings()
    ship_package(docs.sparkSession)
    given = dict(templates or TEMPLATES)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(given, s)
        for b in batches:
            ids, rows_out = b.column(0), []
            for lo, hi, buf, offs in C.text_batches(b.column(1)):
                h, rows = _words(buf, offs)
                g, at = C.ngram_hashes(h, rows, s.shingle)
                spot = np.minimum(np.searchsorted(scanner.least, g), len(scanner.least) - 1)
                for i in np.unique(at[scanner.least[spot] == g]).tolist():
                    own = g[np.searchsorted(at, i):np.searchsorted(at, i + 1)]
                    rows_out += [(lo + i, scanner.names[t], k, n + s.shingle - 1, c) for t, k, n, c in scanner.scan(own)]
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array([r[0] for r in rows_out], pa.int64())), pa.array([r[1] for r in rows_out], pa.string()),
                pa.array([r[2] for r in rows_out], pa.int64()), pa.array([r[3] for r in rows_out], pa.int64()),
                pa.array([r[4] for r in rows_out], pa.float64())], names=["doc_id", "license", "first_word", "n_words", "containment"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return rows.mapInArrow(task, "doc_id long, license string, first_word long, n_words long, containment double")
