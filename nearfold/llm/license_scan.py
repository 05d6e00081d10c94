"""License scans by conditional compression.

A block is the paragraph around a line with a licence word: the lines next to
it, up to a line without words or until as many words as a notice can have
lie on that side.  Each block
is compressed alone and with every template as zstandard raw dictionary; the
template that saves the greatest share of the block's size ranks first.  All
are confirmed, but for those too many of whose words the block lacks at any
place, by their exact wording differences: the words of the
template that the block lacks and the words it puts in between, on the best
alignment.  A template is found where at most DIFFERENT of its words differ.

Defined results: null and empty texts have no blocks and no rows; of templates
with equal wording difference the one that ranks first in compression is
given, then the one first in the list; a block can hold several notices, each
gives a row; null or repeated doc_ids keep their rows; an empty table gives an
empty table; further columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from difflib import SequenceMatcher
from itertools import accumulate
from math import ceil

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, fold_words, strings, table

# Licence names and the wording of their usual notices.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
]
#: Words of a cue may stand on different lines.
CUE = re.compile(r"licen[sc]|permission|redistribut|public[\W_]+domain|rights[\W_]+reserved|free[\W_]+software|\bcc0?[\W_]*(?:by|1\.0)", re.I)
#: Share of a template's words that may differ.
DIFFERENT = 0.15


def candidate_blocks(text: str) -> list[tuple[int, str]]:
    """(code point offset, block): the paragraphs around lines with a cue; those that touch are one."""
    cues = list(CUE.finditer(text))
    if not cues:
        return []
    lines = text.split("\n")
    starts = [0, *accumulate(len(x) + 1 for x in lines)]
    words: dict[int, int] = {}

    def reach(i: int, step: int) -> int:
        """The last line of the block on this side of line i."""
        held = 0
        while held < LONGEST and 0 <= i + step < len(lines):
            if i + step not in words:
                words[i + step] = len(_fold(lines[i + step]))
            if not words[i + step]:
                break
            i += step
            held += words[i]
        return i

    spans: list[list[int]] = []
    seen = -1
    for cue in cues:
        first, last = (bisect_right(starts, at) - 1 for at in (cue.start(), cue.end() - 1))
        if last == seen:
            continue
        seen, first, last = last, reach(first, -1), reach(last, 1)
        if spans and first <= spans[-1][1] + 1 and (first <= spans[-1][1] or words.get(first, 1)):
            spans[-1] = [min(first, spans[-1][0]), max(last, spans[-1][1])]
        else:
            spans.append([first, last])
    return [(starts[i], "\n".join(lines[i : j + 1])) for i, j in spans]


def _fold(text: str) -> list[bytes]:
    return fold_words(text.lower().encode("utf-8", "replace"))


#: Words of the longest notice that can be found: at most a DIFFERENT share is put in.
LONGEST = max(ceil((1 + DIFFERENT) * len(_fold(t))) for _, t in TEMPLATES)


class Scanner:
    def __init__(self):
        self.plain = zstandard.ZstdCompressor(level=6)
        self.words = [_fold(t) for _, t in TEMPLATES]
        self.counts = [Counter(w) for w in self.words]
        self.known = [zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(b" ".join(w), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for w in self.words]

    def rank(self, block: list[bytes]) -> list[tuple[float, int]]:
        """(share of the block's compressed size that the template saves, template), best first."""
        raw = b" ".join(block)
        alone = len(self.plain.compress(raw))
        return sorted(((1 - len(c.compress(raw)) / alone, i) for i, c in enumerate(self.known)), key=lambda x: (-x[0], x[1]))

    def difference(self, i: int, block: list[bytes]) -> tuple[int, int, int, list[str]]:
        """Words that differ on the best alignment, the span in the block, and the differences themselves."""
        target = self.words[i]
        ops = SequenceMatcher(None, target, block, autojunk=False).get_matching_blocks()
        # The run of matches within reach of each other that holds most of the template's words.
        best, k = (len(target), 0, 0, []), 0
        while k < len(ops) - 1:
            end = k
            while end + 1 < len(ops) - 1 and ops[end + 1].b - (ops[end].b + ops[end].size) <= 4 + len(target) // 4:
                end += 1
            run = ops[k : end + 1]
            a, b = run[0].b, run[-1].b + run[-1].size
            tags, missing, extra = [], len(target), 0
            missing -= sum(r.size for r in run)
            extra = (b - a) - sum(r.size for r in run)
            for tag, i1, i2, j1, j2 in SequenceMatcher(None, target, block[a:b], autojunk=False).get_opcodes():
                if tag != "equal":
                    tags.append(f"{b' '.join(target[i1:i2]).decode('utf-8', 'replace')} > {b' '.join(block[a + j1 : a + j2]).decode('utf-8', 'replace')}")
            if max(missing, extra) < best[0]:
                best = (max(missing, extra), a, b, tags)
            k = end + 1
        return best

    def possible(self, block: list[bytes]) -> set[int]:
        """Templates of whose words the block holds enough, wherever they stand."""
        held = Counter(block)
        return {i for i, c in enumerate(self.counts) if sum(max(n - held[w], 0) for w, n in c.items()) <= DIFFERENT * len(self.words[i])}

    def scan(self, text: str) -> list[dict]:
        out = []
        for at, block in candidate_blocks(text):
            words, taken = _fold(block), []
            while True:
                rest = [w for j, w in enumerate(words) if not any(a <= j < b for a, b in taken)] if taken else words
                if not rest:
                    break
                found, possible = [], self.possible(rest)
                if not possible:
                    break
                for place, (saved, i) in enumerate(self.rank(rest)):
                    if i not in possible:
                        continue
                    n, a, b, tags = self.difference(i, rest)
                    if n <= DIFFERENT * len(self.words[i]):
                        found.append((n / len(self.words[i]), -len(self.words[i]), place, i, saved, a, b, n, tags))
                if not found:
                    break
                _, _, _, i, saved, a, b, n, tags = min(found)
                out.append({"license": TEMPLATES[i][0], "template": i, "offset": at, "saved": round(saved, 4), "n_different": n, "differences": tags})
                words, taken = rest[:a] + rest[b:], []
        return out


_scanner: list[Scanner] = []
KIND = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("template", pa.int32()), ("offset", pa.int64()), ("saved", pa.float64()), ("n_different", pa.int32()), ("differences", pa.list_(pa.string()))])


def _scan(batches):
    if not _scanner:
        _scanner.append(Scanner())
    for b in batches:
        rows = [{"doc_id": d, **r} for d, t in zip(b.column(0).to_pylist(), strings(b.column(1))) for r in _scanner[0].scan(t)]
        yield pa.RecordBatch.from_pylist(rows, schema=KIND)


def scan(docs: DataFrame) -> DataFrame:
    """One row for each notice found: doc_id, license, template, offset of the block, share saved, wording differences."""
    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), _scan, "doc_id long, license string, template int, offset long, saved double, n_different int, differences array<string>")


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
