"""License scans: MinHash bands over overlapping windows, then containment.

A text's words give five-word shingles.  Windows of ``WINDOW`` shingles overlap
by half, so any run of ``WINDOW - STRIDE + 1`` shingles lies whole in one
window; templates are cut in pieces of at most that many.  Window and piece
meet in a band if the least of their shingles under the band's permutation is
the same.  A piece of one shingle in a window of four has similarity 1/4 and
meets it in one of ``BANDS`` = 32 bands with probability 1 - 0.75^32 = 0.9999;
longer pieces more surely.  Retrieved templates are verified exactly: the share
of the template's shingles that the text holds around the place found must be
at least ``CONTAINMENT``.

Templates are few and fixed; the scan is one map over the table, its memory a
slice of texts.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.common import documents_only, with_text_columns

SHINGLE_WORDS, CONTAINMENT = 5, 0.8
WINDOW, STRIDE, BANDS = 4, 2, 32
CACHE = 300_000
_STRIP = b".,;:!?()[]{}<>\"'`*#/\\|=_~-"
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)

#: Names licenses go by in notices.
NAMES = {
    "MIT": ["the MIT License", "the MIT license (MIT)", "the terms of the MIT license"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License"],
    "GPL-2.0": ["the GNU General Public License, version 2", "the GNU General Public License v2", "the GNU GPL, version 2"],
    "GPL-3.0": ["the GNU General Public License, version 3", "the GNU General Public License v3", "the GNU GPL, version 3"],
    "LGPL-2.1": ["the GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0", "the Mozilla Public License, v. 2.0"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the 2-clause BSD license"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the 3-clause BSD license"],
    "ISC": ["the ISC License"],
    "EPL-2.0": ["the Eclipse Public License 2.0", "the Eclipse Public License, version 2.0"],
    "Unlicense": ["the terms of the Unlicense"],
    "CC0-1.0": ["CC0 1.0 Universal", "the Creative Commons CC0 1.0 Universal license"],
    **{f"CC-{kind}-{v}": [f"CC {kind} {v}", f"a Creative Commons {name} {v} International License",
                          f"the Creative Commons {name} {v} License"]
       for kind, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"),
                          ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
                          ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")) for v in ("3.0", "4.0")},
}
#: How a notice begins, and passages of license texts.
BEGINNINGS = ["Licensed under", "Released under", "Distributed under", "Available under", "This work is licensed under",
              "This file is licensed under", "This project is licensed under", "This software is licensed under",
              "This program is licensed under", "This code is released under", "Published under"]
PASSAGES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
           "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "Apache-2.0": "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                  "http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
               "Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "GPL-2.0": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
               "Free Software Foundation, either version 2 of the License, or (at your option) any later version",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
               "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                    "the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
           "provided that the above copyright notice and this permission notice appear in all copies",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}


def templates() -> list[tuple[str, str]]:
    """(license, text): every beginning with every name, and the passages."""
    notices = [(i, f"{b} {n}") for i, names in NAMES.items() for n in names for b in BEGINNINGS]
    return notices + list(PASSAGES.items())


class WordHash(dict):
    """Hash of a word without the signs around it; 0 if none is left."""

    def __missing__(self, chunk: bytes) -> int:
        word = chunk.strip(_STRIP)
        value = xxhash.xxh3_64_intdigest(word) | 1 if word else 0
        if len(self) >= CACHE:
            self.clear()
        self[chunk] = value
        return value


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of every run of ``SHINGLE_WORDS`` word hashes."""
    n = len(words) - SHINGLE_WORDS + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(SHINGLE_WORDS):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out += words[j:j + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


class Scanner:
    """Templates, the bands of their pieces, and the scan of texts."""

    def __init__(self, known: list[tuple[str, str]], containment: float = CONTAINMENT):
        self.containment, self.words = containment, WordHash()
        rng = np.random.default_rng(11)
        self.factor = rng.integers(1, 1 << 63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.templates = []
        pieces, self.piece_of = [], []
        for name, text in known:
            sh = shingle_hashes(self._words(text.encode()))
            if len(sh) == 0:
                raise ValueError(f"a template needs {SHINGLE_WORDS} words: {text}")
            for at in range(0, len(sh), WINDOW - STRIDE + 1):
                pieces.append(sh[at:at + WINDOW - STRIDE + 1])
                self.piece_of.append((len(self.templates), at))
            self.templates.append((name, frozenset(sh.tolist()), len(sh)))
        self.keys, self.order, self.bits = [], [], []
        for f in self.factor:
            least = np.array([(p * f).min() for p in pieces], dtype=np.uint64)
            order = np.argsort(least, kind="stable")
            bits = np.zeros(1 << 18, dtype=bool)
            bits[(least >> np.uint64(46)).astype(np.int64)] = True
            self.keys.append(least[order])
            self.order.append(order)
            self.bits.append(bits)

    def _words(self, raw: bytes) -> np.ndarray:
        known = self.words
        out = np.array([known[w] for w in raw.lower().split()], dtype=np.uint64)
        return out[out != 0]

    def scan(self, texts: list[bytes]) -> list[dict[str, tuple[float, int, int]]]:
        """For each text: license -> (containment, first word, words)."""
        shingled = [shingle_hashes(self._words(t)) for t in texts]
        # texts end to end, each filled up to whole strides and one stride more
        sizes = np.array([len(s) for s in shingled], dtype=np.int64)
        room = -(-sizes // STRIDE) * STRIDE + STRIDE
        starts = np.concatenate([[0], np.cumsum(room)])
        line = np.zeros(starts[-1], dtype=np.uint64)
        there = np.zeros(starts[-1], dtype=bool)
        for s, at in zip(shingled, starts):
            line[at:at + len(s)] = s
            there[at:at + len(s)] = True
        gone = np.flatnonzero(~there)
        hits: set[tuple[int, int]] = set()  # window, piece
        for f, keys, order, bits in zip(self.factor, self.keys, self.order, self.bits):
            v = line * f
            v[gone] = _NONE
            half = v.reshape(-1, STRIDE).min(axis=1)
            least = np.minimum(half[:-1], half[1:])
            for w in np.flatnonzero(bits[(least >> np.uint64(46)).astype(np.int64)]):
                lo, hi = np.searchsorted(keys, least[w], "left"), np.searchsorted(keys, least[w], "right")
                hits.update((int(w), int(p)) for p in order[lo:hi])
        found: list[dict[str, tuple[float, int, int]]] = [{} for _ in texts]
        checked = set()
        for w, p in sorted(hits):
            d = int(np.searchsorted(starts, w * STRIDE, "right")) - 1
            t, offset = self.piece_of[p]
            at = w * STRIDE - int(starts[d])
            name, wanted, size = self.templates[t]
            if (d, t, at - offset) in checked:
                continue
            checked.add((d, t, at - offset))
            slack = WINDOW + size // 4
            lo, hi = max(0, at - offset - slack), min(int(sizes[d]), at - offset + size + slack)
            region = shingled[d][lo:hi].tolist()
            common = wanted.intersection(region)
            share = len(common) / len(wanted)
            if share >= self.containment:
                places = [i for i, s in enumerate(region) if s in common]
                new = (share, lo + places[0], places[-1] - places[0] + SHINGLE_WORDS)
                best = found[d].get(name)
                if best is None or (-share, -new[2], new[1]) < (-best[0], -best[2], best[1]):
                    found[d][name] = new
        return [self._distinct(f) for f in found]

    @staticmethod
    def _distinct(found: dict[str, tuple[float, int, int]]) -> dict[str, tuple[float, int, int]]:
        """Without licenses whose words another one matches better (as one
        version's notice resembles the next one's)."""
        return {n: m for n, m in found.items() if not any(
            o[0] > m[0] and o[1] < m[1] + m[2] and m[1] < o[1] + o[2] for o in found.values())}


_FIELD = T.StructField("found", T.ArrayType(T.StructType([
    T.StructField("license", T.StringType()), T.StructField("containment", T.DoubleType()),
    T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType())])))


def license_scan(docs: DataFrame, known: list[tuple[str, str]] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """One row for each document and license it holds: doc_id, license,
    containment, first_word and n_words of the best match (words without signs
    alone are not counted).

    Null and empty texts, and texts under five words, hold none.  Repeated rows
    give repeated rows; an empty table gives none.
    """
    known = templates() if known is None else known

    def factory():
        scanner = Scanner(known, containment)

        def run(raw: list[bytes]) -> list[pa.Array]:
            rows = [[{"license": n, "containment": c, "first_word": a, "n_words": w} for n, (c, a, w) in sorted(f.items())]
                    for f in scanner.scan(raw)]
            return [pa.array(rows, pa.list_(pa.struct([("license", pa.string()), ("containment", pa.float64()),
                                                       ("first_word", pa.int64()), ("n_words", pa.int64())])))]
        return run

    return with_text_columns(documents_only(docs), "text", [_FIELD], factory) \
        .select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")
