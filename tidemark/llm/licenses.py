"""Licence scans: MinHash bands over overlapping text windows, then exact shingle containment.

Words are runs of ASCII letters and digits and of any other non-ASCII bytes, lower-cased; shingles are
five words, and for a template of fewer words as many as it has. Such a template is one shingle, looked up
by its hash among the text's shingles of that length. Any other template with n shingles belongs to the class c = 2**ceil(log2 n). Every text is cut into
windows of 2c shingles, c apart, so that a passage of c shingles lies whole in one of them. A passage that holds
``HELD`` of the template has a Jaccard similarity of ``HELD n / (2c + (1 - HELD) n)`` > 0.19 with its
window; with ``BANDS`` bands of one row the chance that no band agrees is (1 - 0.19)**64 < 2e-6. Retrieved
windows, widened by the template's length, are verified by exact containment of the template's shingles.

* A text with fewer words than a template's shingles doesn't hold it. Null and empty texts match nothing.
* A template found in several windows of a text is reported once, where most of it is found; ties go
  to the first place. Repeated rows are rows of their own; other columns are ignored.
* Templates are a parameter of the job. Their band keys are sent to every task, which is refused above
  ``MOST_KEYS`` keys (about 16 bytes each).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import documents, slices

SHINGLE = 5
HELD = 0.8
BANDS = 64
MOST_KEYS = 4_000_000

# Notices as they are published.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution."),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
}

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = base
    return np.multiply.accumulate(out)


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


class Hasher:
    """Word and shingle hashes of whole texts by prefix sums of a polynomial modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def words(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every word, and where each starts and ends."""
        codes = np.frombuffer(text, np.uint8)
        if len(codes) >= len(self.up):
            n = 2 * len(codes) + 2
            self.up, self.down = _powers(_BASE, n), _powers(_UNBASE, n)
        inside = np.r_[False, _IN_WORD[codes], False]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * self.up[:len(codes)], out=sums[1:])
        return _stir((sums[ends] - sums[starts]) * self.down[starts]), np.stack([starts, ends])

    def shingles(self, words: np.ndarray, length: int = SHINGLE) -> np.ndarray:
        """Hash of every run of ``length`` words, from the words' hashes."""
        n = max(0, len(words) - length + 1)
        out = np.zeros(n, np.uint64)
        for i in range(length):
            out = out * np.uint64(0x100000001B3) + words[i:i + n]
        return _stir(out)


def _rows(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(2)
    odd = draw.integers(0, 1 << 63, n, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, draw.integers(0, 1 << 63, n, np.int64).astype(np.uint64)


_ODD, _ADD = _rows(BANDS)


def _values(shingles: np.ndarray, band: int) -> np.ndarray:
    return (shingles * _ODD[band] + _ADD[band]) >> np.uint64(24)


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.encode().lower())


def runs(words: list[bytes], length: int) -> list[bytes]:
    return [b" ".join(words[i:i + length]) for i in range(len(words) - length + 1)]


def shingle_set(words: list[bytes]) -> list[bytes]:
    """The shingles of every length that a template may have."""
    return [s for length in range(1, SHINGLE + 1) for s in runs(words, length)]


class Matcher:
    def __init__(self, templates: dict[str, str], held: float = HELD):
        self.held, self.names = held, list(templates)
        words = [words_of(t) for t in templates.values()]
        self.lengths = [len(w) for w in words]
        self.widths = [min(SHINGLE, n) for n in self.lengths]
        self.sets = [set(runs(w, n)) if n else set() for w, n in zip(words, self.widths)]
        hasher = Hasher()
        groups: dict[int, list[tuple[int, np.ndarray]]] = {}
        short: dict[int, list[tuple[int, np.uint64]]] = {}
        for i, text in enumerate(templates.values()):
            if self.widths[i]:
                shingles = hasher.shingles(hasher.words(text.encode().lower())[0], self.widths[i])
                if self.widths[i] < SHINGLE:
                    short.setdefault(self.widths[i], []).append((i, shingles[0]))
                else:
                    groups.setdefault(1 << (len(shingles) - 1).bit_length(), []).append((i, shingles))
        self.short = {n: ([i for i, _ in members], np.array([s for _, s in members], np.uint64)) for n, members in short.items()}
        self.classes = {}
        for size, members in groups.items():
            keys = np.array([[_values(s, b).min() for b in range(BANDS)] for _, s in members], np.uint64)
            self.classes[size] = [i for i, _ in members], keys
        if sum(k.size for _, k in [*self.classes.values(), *self.short.values()]) > MOST_KEYS:
            raise ValueError("too many templates to send to every task")

    def retrieve(self, texts: list[np.ndarray]) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """By text and template: the windows (first and last shingle) that share a band. All texts at once."""
        sizes = np.array([len(t) for t in texts], np.int64)
        offsets = np.r_[0, np.cumsum(sizes)]
        shingles = np.concatenate(texts)
        cuts = {}
        for size in self.classes:
            per_text = -(-sizes // size)
            text_of = np.repeat(np.arange(len(texts)), per_text)
            inner = size * (np.arange(len(text_of)) - np.repeat(np.cumsum(per_text) - per_text, per_text))
            cuts[size] = offsets[text_of] + inner, text_of, inner, text_of == np.r_[text_of[1:], -1]
        found: dict[tuple[int, int], set[tuple[int, int]]] = {}
        for band in range(BANDS):
            hashed = _values(shingles, band)
            for size, (members, keys) in self.classes.items():
                starts, text_of, inner, more = cuts[size]
                least = np.minimum.reduceat(hashed, starts) if size > 1 else hashed
                least = np.minimum(least, np.where(more, np.r_[least[1:], least[:1]], least))  # a window is two blocks
                for at in np.flatnonzero(np.isin(least, keys[:, band])):
                    t, low = int(text_of[at]), int(inner[at])
                    for m in np.flatnonzero(keys[:, band] == least[at]):
                        found.setdefault((t, members[m]), set()).add((low, min(low + 2 * size, int(sizes[t]))))
        return {k: sorted(v) for k, v in found.items()}

    def retrieve_short(self, texts: list[np.ndarray], hasher: Hasher) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """By text and template of fewer than five words: the places of its hash, from the words' hashes."""
        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for length, (members, keys) in self.short.items():
            for t, words in enumerate(texts):
                shingles = hasher.shingles(words, length)
                for at in np.flatnonzero(np.isin(shingles, keys)):
                    for m in np.flatnonzero(keys == shingles[at]):
                        found.setdefault((t, members[m]), []).append((int(at), int(at) + 1))
        return found

    def verify(self, template: int, windows: list[tuple[int, int]], text: bytes,
               spans: np.ndarray) -> tuple[str, float, int, int] | None:
        """Template, share of its shingles held, and the place of the words that hold them (bytes)."""
        starts, ends = spans
        wanted, best, width = self.sets[template], None, self.widths[template]
        around = self.lengths[template] if width == SHINGLE else 0
        for low, high in windows:
            first = max(0, low - around)
            last = min(len(starts), high + width - 1 + around)
            here = runs([text[starts[i]:ends[i]] for i in range(first, last)], width)
            share = len(wanted.intersection(here)) / len(wanted)
            if share >= self.held and (best is None or share > best[1]):
                at = [i for i, s in enumerate(here) if s in wanted]
                end = min(first + at[-1] + width, last)
                best = self.names[template], share, int(starts[first + at[0]]), int(ends[end - 1])
            if best and best[1] == 1.0:
                break
        return best

    def matches(self, texts: list[str | None], hasher: Hasher) -> list[tuple[int, str, float, int, int]]:
        """The number of the text and what ``verify`` says, for every template that a text holds."""
        read = [(i, t.encode().lower()) for i, t in enumerate(texts) if t]
        hashed = [(i, t, *hasher.words(t)) for i, t in read]
        found = self.retrieve_short([h[2] for h in hashed], hasher)
        long = [(k, s) for k, h in enumerate(hashed) if len(s := hasher.shingles(h[2]))]
        if long and self.classes:
            found |= {(long[k][0], t): w for (k, t), w in self.retrieve([s for _, s in long]).items()}
        out = [(hashed[k][0], self.verify(t, windows, hashed[k][1], hashed[k][3])) for (k, t), windows in sorted(found.items())]
        return [(i, *m) for i, m in out if m]


def scan(df: DataFrame, templates: dict[str, str] = TEMPLATES, doc_id: str = "doc_id", text: str = "text",
         held: float = HELD) -> DataFrame:
    """``doc_id, template, containment, first_byte, end_byte``: a row per text and template it holds."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    matcher = Matcher(templates, held)

    def run(batches):
        hasher = Hasher()
        for batch in slices(batches, "text"):
            found = matcher.matches(batch.column("text").to_pylist(), hasher)
            at, *columns = zip(*found) if found else [()] * 5
            kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at, pa.int64())), *map(pa.array, columns, kinds)],
                ["doc_id", "template", "containment", "first_byte", "end_byte"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, template string, containment double, first_byte long, end_byte long")


def op2_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
