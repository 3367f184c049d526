"""License scan by conditional compression."""

from __future__ import annotations

import difflib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import raw_bytes, table, text_slices

#: Usual wordings of license notices, by SPDX name.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights. CC0 1.0 Universal."),
    ("Proprietary", "Copyright. All rights reserved. No part of this work may be reproduced without permission."),
]
CUE = re.compile(rb"licen[sc]|copyright|all rights reserved|redistribut|permission|spdx", re.I)
WORD = re.compile(rb"[\w.+-]*\w")
#: Share of its own saving that a template must reach on a window, or the window's words aren't compared. Of 2,600
#: notices inside prose of sf0.1, with as many words changed as wording allows, the least reaches 0.28.
SAVED = 0.1
#: Words that tell licenses apart: a stretch that lacks one of its template's is another license, as with versions.
NAMES = set("mit bsd apache gnu lesser affero mozilla by by-sa by-nc attribution attribution-noncommercial cc0".split())


def regions(text: bytes, reach: int) -> list[tuple[int, int]]:
    """Surroundings of all cues, ``reach`` bytes and the rest of a word to both sides, whatever the lines; those that meet are joined. Byte offsets."""
    found: list[list[int]] = []
    for m in CUE.finditer(text):
        a, z = max(0, m.start() - reach), min(len(text), m.end() + reach)
        while a > 0 and not text[a - 1 : a].isspace() and m.start() - a < 2 * reach:
            a -= 1
        while z < len(text) and not text[z : z + 1].isspace() and z - m.end() < 2 * reach:
            z += 1
        if found and a <= found[-1][1]:
            found[-1][1] = max(z, found[-1][1])
        else:
            found.append([a, z])
    return [(a, z) for a, z in found]


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], least: float, level: int = 6):
        self.templates, self.least = templates, least
        plain = {"level": level, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.alone = zstandard.ZstdCompressor(**plain)
        raw = [zstandard.ZstdCompressionDict(self.shape(t.encode()), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for _, t in templates]
        self.given = [zstandard.ZstdCompressor(dict_data=d, **plain) for d in raw]
        self.words = [[w for w, _, _ in self.split(t.encode())] for _, t in templates]
        self.counts = [Counter(w) for w in self.words]
        #: Size of each template alone, and the bytes that it saves on itself: what a whole notice saves, about.
        self.own = [len(self.alone.compress(self.shape(t.encode()))) for _, t in templates]
        self.whole = [n - len(c.compress(self.shape(t.encode()))) for n, c, (_, t) in zip(self.own, self.given, templates, strict=True)]
        #: Twice the longest template: room for indents, comment marks and added words.
        self.reach = 2 * max((len(t.encode()) for _, t in templates), default=0)

    @staticmethod
    def shape(text: bytes) -> bytes:
        return b" ".join(text.lower().split())

    @staticmethod
    def split(text: bytes) -> list[tuple[str, int, int]]:
        return [(m[0].decode(), m.start(), m.end()) for m in WORD.finditer(text.lower())]

    def savings(self, each: list[tuple[str, int, int]], text: bytes) -> dict[int, list[tuple[int, int]]]:
        """For each template the (first, last+1) words of all windows, joined where they meet, that it shortens by at least SAVED of what it saves on itself.

        Windows of one and a half times the longest stretch that wording allows
        begin every half template, so each such stretch lies in one of them.
        """
        out: dict[int, list[tuple[int, int]]] = {}
        alone: dict[bytes, int] = {}
        for i, n in enumerate(map(len, self.words)):
            long, step = int(1.5 * n / self.least) + 1, max(1, n // 2)
            for a in range(0, max(1, len(each) - long + step), step):
                if not (part := each[a : a + long]):
                    break
                block = self.shape(text[part[0][1] : part[-1][2]])
                size = alone[block] = alone.get(block) or len(self.alone.compress(block))
                if size - len(self.given[i].compress(block)) < SAVED * self.whole[i]:
                    continue
                spans = out.setdefault(i, [])
                if spans and a <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], a + len(part))
                else:
                    spans.append((a, a + len(part)))
        return out

    def wordings(self, i: int, words: list[str]) -> list[tuple]:
        """(first and last+1 word, equal, missing, added) of the stretches that the template's wording confirms."""
        want, n, least = self.words[i], len(self.words[i]), self.least
        need, width = math.ceil(least * n - 1e-9), int(n / least + 1e-9)
        have = Counter(words)
        if sum(min(c, have[w]) for w, c in self.counts[i].items()) < need:
            return []
        found, inside, shared = {}, Counter(), 0
        for z in range(len(words) + width):  # windows of ``width`` words that end before word z + 1
            if z < len(words):
                inside[words[z]] += 1
                shared += inside[words[z]] <= self.counts[i][words[z]]
            if (s := z - width) >= 0:
                shared -= inside[words[s]] <= self.counts[i][words[s]]
                inside[words[s]] -= 1
            first = max(0, s + 1)
            if shared < need or s >= 0 and words[first] not in self.counts[i]:
                continue
            part = words[first : z + 1]
            same = difflib.SequenceMatcher(None, want, part, autojunk=False).get_matching_blocks()
            matched = [m for m in same if m.size]
            if not matched:
                continue
            a, e = matched[0].b, matched[-1].b + matched[-1].size
            equal = sum(m.size for m in matched)
            if equal >= least * max(n, e - a) - 1e-9:
                missing = [w for x, y in zip([0, *[m.a + m.size for m in same]], [m.a for m in same], strict=False) for w in want[x:y]]
                added = [w for m, o in zip(matched, matched[1:], strict=False) for w in part[m.b + m.size : o.b]]
                if not any(w in NAMES or any(c.isdigit() for c in w) for w in missing):  # a version that differs is another license
                    found[first + a, first + e] = (first + a, first + e, equal, missing, added)
        return list(found.values())

    def judge(self, text: bytes) -> list[tuple]:
        """(first byte, end byte, license, template number, share of the size that the template saves, equal words, missing words, added words) of all notices.

        Only windows that a template shortens enough (``savings``) are compared
        with its wording. Of one template's stretches that overlap, the one with
        the most equal words, less those missing and added, is taken; between
        templates the one that saves most bytes of its stretch decides.
        """
        each = self.split(text)
        words, found, alone = [w for w, _, _ in each], [], {}
        for i, spans in self.savings(each, text).items():
            own = []
            for first, last in spans:
                for s, e, equal, missing, added in self.wordings(i, words[first:last]):
                    block = self.shape(text[each[first + s][1] : each[first + e - 1][2]])
                    size = alone[block] = alone.get(block) or len(self.alone.compress(block))
                    left = len(self.given[i].compress(block))
                    own.append(((len(missing) + len(added) - equal, left / size, left - size), first + s, first + e, equal, missing, added))
            found.extend(((saved, rank, part, i), *rest) for (rank, part, saved), *rest in apart(sorted(own)))
        return [(each[s][1], each[e - 1][2], self.templates[i][0], i, 1 - part, equal, missing, added) for (_, _, part, i), s, e, equal, missing, added in sorted(apart(sorted(found)), key=lambda x: x[1])]


def apart(ranked: list[tuple]) -> list[tuple]:
    """Those of (rank, first, last+1, ...) that overlap with none taken before."""
    taken: list[tuple] = []
    for x in ranked:
        if all(x[2] <= y[1] or x[1] >= y[2] for y in taken):
            taken.append(x)
    return taken


@lru_cache(maxsize=2)
def scanner(templates: tuple, least: float) -> Scanner:
    return Scanner(list(templates), least)


SCHEMA = "doc_id long, first_byte long, end_byte long, license string, template int, saved double, equal_words int, missing array<string>, added array<string>"


def licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """One row for each notice in a text that states a license, with the wording's differences from the template.

    Whole texts are searched around each cue, over lines and to twice the
    longest template's length on both sides. In there windows about as long as
    each template are compressed alone and with the template as raw dictionary;
    in those that get enough shorter, a stretch is confirmed by wording: the
    words that it shares with the template must make up at least ``least`` of
    both, and those that miss hold no digits and don't name the license. Of
    stretches that overlap, the template that saves most bytes has it (see
    ``judge``); all others give rows, so a text can state several licenses. Defined results: null
    and empty texts give none; a null doc_id stays, repeated rows too; an empty
    table gives no rows; other columns are not read.
    """
    kept = tuple(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach, judge = scanner(kept, least).reach, lru_cache(maxsize=20_000)(scanner(kept, least).judge)
        for part in text_slices(batches):
            rows = []
            for doc, raw in zip(part.column("doc_id").to_pylist(), raw_bytes(part.column("text")), strict=True):
                for a, z in regions(raw, reach):
                    rows.extend((doc, a + first, a + end, *found) for first, end, *found in judge(raw[a:z]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string())]
            names = ["doc_id", "first_byte", "end_byte", "license", "template", "saved", "equal_words", "missing", "added"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))
