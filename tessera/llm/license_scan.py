"""License scans: winnowed fingerprints pick candidates, banded alignment confirms.

Templates are cut into words (runs of ASCII letters and digits or of non-ASCII
bytes, A-Z lower-cased); hashes of ``GRAM`` neighbouring words are winnowed with
``WINDOW`` into an inverted index from fingerprint to (template, position); templates
of under ``SHORT`` words have all their word pairs in it, so that one changed word leaves
a hit.  Every gram of every whole text is looked up in it, so a text that shares a
winnowed gram can't be missed.  Hits of a template near one diagonal are one candidate;
where the stretch has enough of the template's words, a banded local alignment gives the
matched words, the coverage (matched / template words) and the span.  The words of the
best match are taken and the rest aligned again, until nothing is left.

Defined cases: null and empty texts and texts without a match give no row; each
occurrence in a text is one row, also where notices stand next to each other, and of
overlapping ones of a template the best stays (ties: the first); repeated rows are
scanned each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, record, table
from tessera.llm.license_texts import FULL_TEXTS
from tessera.llm.text import Texts, ngrams, owners, pieces

GRAM, WINDOW, BAND, LEAST = 3, 4, 6, 0.8
#: Templates of fewer words are indexed by all word pairs.
SHORT = 10

#: Public notices as they stand in files, and full texts; a parameter of ``scan``.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at"
    ),
    "mit": "Released under the MIT License.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction'
    ),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation"
    ),
    "bsd-grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met"
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    **FULL_TEXTS,
}

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def _words(t: Texts):
    starts, ends = t.runs(_WORD[t.buf])
    return starts, ends, np.searchsorted(starts, t.offs)


def winnow(g: np.ndarray, window: int) -> np.ndarray:
    """Positions of the (rightmost) smallest hash of each window; all of a short list's smallest."""
    if not len(g):
        return np.zeros(0, np.int64)
    w = min(window, len(g))
    view = np.lib.stride_tricks.sliding_window_view(g, w)[:, ::-1]
    return np.unique(np.arange(len(view)) + w - 1 - view.argmin(1))


class Index:
    """Inverted index of the templates' fingerprints, one for each length of gram."""

    def __init__(self, templates: dict[str, str]):
        self.names, self.words = list(templates), []
        found: dict[int, list] = {2: [], GRAM: []}
        for k, text in enumerate(templates.values()):
            raw = np.frombuffer(text.encode(), np.uint8)
            t = Texts(raw, np.array([0, len(raw)]))
            s, e, _ = _words(t)
            h = t.hashes(s, e)
            self.words.append(h)
            n = 2 if len(h) < SHORT else GRAM
            g = ngrams(h, n)
            at = np.arange(len(g)) if n == 2 else winnow(g, WINDOW)
            found[n].append((g[at], np.full(len(at), k), at))
        self.grams = {}
        for n, parts in found.items():
            if parts:
                key, owner, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.argsort(key, kind="stable")
                self.grams[n] = key[order], owner[order], pos[order]


def align(template: np.ndarray, text: np.ndarray, shift: int) -> tuple[int, int, int]:
    """Banded local alignment: matched words and the first and last matched text word.

    Template word i is compared with text words i + shift +- BAND.  A match scores 2,
    a mismatch or gap costs 1.
    """
    best, rows = (0, 0, 0, 0), {}
    # a cell: score, matches, first and last matched word
    for i, w in enumerate(template):
        now = {}
        for j in range(max(0, i + shift - BAND), min(len(text), i + shift + BAND + 1)):
            diag = rows.get(j - 1, (0, 0, -1, -1))
            if text[j] == w:
                cell = (diag[0] + 2, diag[1] + 1, diag[2] if diag[1] else j, j)
            else:
                cell = max(((c[0] - 1, *c[1:]) for c in (diag, rows.get(j, (0, 0, -1, -1)), now.get(j - 1, (0, 0, -1, -1)))), key=lambda c: c[:2])
                if cell[0] <= 0:
                    cell = (0, 0, -1, -1)
            now[j] = cell
            if cell[:2] > best[:2]:
                best = cell
        rows = now
    return best[1], best[2], best[3]


def scan_piece(t: Texts, index: Index, least: float) -> list[tuple[int, int, int, int, int]]:
    """(document, template, matched words, first byte, end byte) of every match."""
    starts, ends, woffs = _words(t)
    h = t.hashes(starts, ends)
    own = owners(woffs)
    spots: dict[tuple[int, int], set[int]] = {}
    for n, (key, owner, pos) in index.grams.items():
        g = ngrams(h, n)
        lo = np.searchsorted(key, g)
        at = np.flatnonzero(key[np.minimum(lo, len(key) - 1)] == g) if len(key) else np.zeros(0, int)
        at = at[own[at] == own[at + n - 1]]
        for a in at.tolist():
            d, x = int(own[a]), int(lo[a])
            while x < len(key) and key[x] == g[a]:
                spots.setdefault((d, int(owner[x])), set()).add(a - int(woffs[d]) - int(pos[x]))
                x += 1
    out = []
    for (d, k), diagonals in spots.items():
        tpl, text = index.words[k], h[woffs[d] : woffs[d + 1]]
        kinds, count = np.unique(tpl, return_counts=True)
        need = least * len(tpl)
        free = np.ones(len(text), bool)

        def aligned(s):
            """(-matched, first word, last word) near a diagonal among the free words, or None."""
            base = max(0, s - BAND)
            end = min(len(text), s + len(tpl) + BAND)
            stretch, open_ = text[base:end], free[base:end]
            at = np.minimum(np.searchsorted(kinds, stretch), len(kinds) - 1)
            hit = (kinds[at] == stretch) & open_
            if np.minimum(np.bincount(at[hit], minlength=len(kinds)), count).sum() < need:
                return None
            words = np.where(hit, at, -1)
            m, first, last = align(np.searchsorted(kinds, tpl).tolist(), words.tolist(), s - base)
            return (-m, first + base, last + base) if m >= need else None

        live, last = {}, None
        for s in sorted(diagonals):
            if last is None or s - last > BAND // 2:  # else the band of the one before holds it
                live[s], last = aligned(s), s
        while live := {s: x for s, x in live.items() if x}:
            m, first, end = min(live.values())
            out.append((d, k, -m, int(starts[woffs[d] + first]), int(ends[woffs[d] + end])))
            free[first : end + 1] = False
            for s, x in live.items():
                if not (x[1] > end or x[2] < first):
                    live[s] = aligned(s)
    return sorted(out)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """One row a match: license, matched words, coverage, span in code points (end exclusive)."""
    index = Index(templates)

    def run(b: pa.RecordBatch):
        for lo, hi, t in pieces(b):
            hits = scan_piece(t, index, least)
            if not hits:
                continue
            d, k, m, s, e = (np.array(x, np.int64) for x in zip(*hits, strict=True))
            chars = np.concatenate([[0], np.cumsum((t.buf & 0xC0) != 0x80)])
            size = np.array([len(index.words[x]) for x in k])
            yield record(
                doc_id=b.column("doc_id").slice(lo, hi - lo).take(pa.array(d)), license=[index.names[x] for x in k],
                matched=m, template_words=size, coverage=m / size,
                span_start=chars[s] - chars[t.offs[d]], span_end=chars[e] - chars[t.offs[d]],
            )

    return map_batches(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run,
        "doc_id long, license string, matched long, template_words long, coverage double, span_start long, span_end long",
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
