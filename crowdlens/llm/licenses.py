"""License scan: Dice coefficient over word bigrams against license templates.

Units of a text are the text, its paragraphs (between blank lines) and its
lines; besides, every window of consecutive words is searched, so that a notice
inside a line or over several lines or paragraphs is found.  A template can only
reach the threshold t if the number of distinct bigrams lies within t / (2 - t)
and (2 - t) / t of its own; this size bound prunes the templates, and units and
windows in which too few bigrams occur in any template at all are passed over.
Both bounds are exact: a window that matches and is not given itself shares at
least half of its bytes with ranges that are given, or starts where a better one
of its template starts or repeats its first bigram.

Licenses of a family differ in a word or a number, which moves the coefficient
little.  So a match also needs the words that tell variants apart (``told``): the
same variant words and versions as the template, and no negation of its own.
A range that matches templates but none of them in this way is ``unknown``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdlens.llm.common import arrow_fields, byte_slices, no_clash, table
from crowdlens.llm.words import BASE, U, Words, joined_bytes, mix, split_words

THRESHOLD = 0.85
MAX_TEMPLATE_BYTES = 8 << 20  # templates are sent to every task
UNKNOWN = "unknown"
# Public license notices and declarations (name, text).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
     "in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
     "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
     "KIND, either express or implied. See the License for the specific language governing permissions and "
     "limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
     "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
     "of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
     "conditions: The above copyright notice and this permission notice shall be included in all copies or "
     "substantial portions of the Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
     "provided that the following conditions are met: Redistributions of source code must retain the above copyright "
     "notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the "
     "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
     "materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
     "provided that the following conditions are met: Redistributions of source code must retain the above copyright "
     "notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the "
     "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
     "materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
     "contributors may be used to endorse or promote products derived from this software without specific prior "
     "written permission."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
     "MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public "
     "License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors "
     "be held liable for any damages arising from the use of this software. Permission is granted to anyone to use "
     "this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
     "subject to the following restrictions"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, "
     "modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
     "binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring "
     "rights to this work."),
]
# Licenses of one wording (name, words, versions)
GNU = (("GPL", "", ("2", "3")), ("LGPL", "Lesser ", ("2.1", "3")), ("AGPL", "Affero ", ("3",)))
CREATIVE_COMMONS = (
    ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"),
    ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
for code, kind, versions in GNU:
    for version in versions:
        label = f"{code}-{version if '.' in version else version + '.0'}"
        TEMPLATES += [
            (label, f"This work is licensed under the GNU {kind}General Public License, version {version}."),
            (label, "This program is free software: you can redistribute it and/or modify it under the terms of the "
             f"GNU {kind}General Public License as published by the Free Software Foundation, either version {version} "
             "of the License, or (at your option) any later version.")]
for code, kind in CREATIVE_COMMONS:
    TEMPLATES += [
        (f"CC-{code}-4.0", f"Licensed under CC {code} 4.0."),
        (f"CC-{code}-4.0", f"This work is licensed under a Creative Commons {kind} 4.0 International License.")]
TEMPLATES = tuple(TEMPLATES)

# Words that tell variants of a license apart, by what they stand for
VARIANTS = {"affero": "affero", "agpl": "affero", "lesser": "lesser", "lgpl": "lesser", "library": "library",
            "sharealike": "sharealike", "sa": "sharealike", "noncommercial": "noncommercial", "nc": "noncommercial",
            "noderivatives": "noderivatives", "noderivs": "noderivatives", "nd": "noderivatives"}
VERSIONED = {"version", "v", "gpl", "lgpl", "agpl", "mpl", "epl", "attribution", "by", "cc0", "apache",
             *(w for w in VARIANTS if w != "library")}  # words that a version follows
LICENSE = {"license", "licence", "licenses", "licences"}  # these only before a number with a point
NEGATIONS = {"not", "never", "neither", "nor", "isn", "aren", "wasn", "doesn"}
LEAD = 3  # words before a range in which a negation counts
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text: str) -> list[str]:
    """The words of a text, ``gplv3`` and the like in two."""
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return WORD.findall(re.sub(r"\b([al]?gpl|mpl|epl)v(?=\d)", r"\1 ", text))


def told(words: list[str]) -> tuple[frozenset, dict[str, str]]:
    """Variants and versions (first number -> second, if there is one) in ``words``."""
    number = [w if w.isascii() and w.isdigit() and len(w) < 3 else "" for w in [*words, "", ""]]
    versions = {}
    for i, (before, major) in enumerate(zip(words, number[1:])):
        minor = number[i + 2]
        if major and (before in VERSIONED or before in LICENSE and minor):
            versions[major] = versions.get(major) or minor
    return frozenset(VARIANTS[w] for w in words if w in VARIANTS), versions


def tells_same(words: list[str], lead: list[str], template: list[str]) -> bool:
    """Whether a matching range has the variant and version of the template and
    no negation that the template has not."""
    (variants, versions), (wanted, numbers) = told(words), told(template)
    if variants != wanted or versions.keys() != numbers.keys() or any(
            versions[v] and numbers[v] and versions[v] != numbers[v] for v in numbers):
        return False
    own = set(zip(template, template[1:]))
    return not any(w in NEGATIONS for w in lead) and not any(
        a in NEGATIONS and (a, b) not in own for a, b in zip(words, [*words[1:], ""]))


BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def _bigrams(h: np.ndarray) -> np.ndarray:
    return np.unique(mix(h[:-1] * BASE + h[1:])) if len(h) > 1 else np.zeros(0, U)


class Templates:
    """Bigram sets of the templates, by size."""

    def __init__(self, templates, threshold: float):
        if sum(len(t.encode()) for _, t in templates) > MAX_TEMPLATE_BYTES:
            raise ValueError("templates are too large to be sent to every task")
        self.low, self.high = threshold / (2 - threshold), (2 - threshold) / threshold
        self.threshold = threshold
        sets = []
        for name, text in templates:
            words = split_words(*joined_bytes(pa.array([text])))
            sets.append((name, _bigrams(words.hash), plain_words(text)))
        held = sorted((x for x in sets if len(x[1])), key=lambda x: len(x[1]))
        self.sets = [(n, s) for n, s, _ in held]
        self.words = [w for *_, w in held]
        self.sizes = np.array([len(s) for _, s in self.sets])
        self.known = np.unique(np.concatenate([s for _, s in self.sets] or [np.zeros(0, U)]))
        self.spots = [np.searchsorted(self.known, s) for _, s in self.sets]
        # templates of each known bigram, joined, and where they begin
        spot = np.concatenate(self.spots or [np.zeros(0, np.int64)])
        self.having = np.repeat(np.arange(len(self.sets)), self.sizes.astype(np.int64))[np.argsort(spot, kind="stable")]
        self.begin = np.searchsorted(np.sort(spot), np.arange(len(self.known) + 1))

    def matches(self, own: np.ndarray) -> list[tuple[int, float]]:
        """(template, coefficient) of those that reach the threshold, best first;
        ties go to the name that sorts first."""
        n = len(own)
        lo = np.searchsorted(self.sizes, self.low * n - 1e-9)
        hi = np.searchsorted(self.sizes, self.high * n + 1e-9, "right")
        found = []
        for k in range(lo, hi):
            name, s = self.sets[k]
            dice = 2 * len(np.intersect1d(own, s, assume_unique=True)) / (n + len(s))
            if dice >= self.threshold:
                found.append((-dice, name, k))
        return [(k, -d) for d, _, k in sorted(found)]

    def fits(self, k: int, text: bytes, start: int, end: int) -> bool:
        """Whether bytes ``start`` to ``end`` of ``text`` tell the variant of template k."""
        lead = plain_words(text[max(0, start - 80):start].decode(errors="ignore"))[-LEAD:]
        return tells_same(plain_words(text[start:end].decode(errors="ignore")), lead, self.words[k])

    def scan(self, words: Words, marks: np.ndarray) -> list[tuple[int, list[tuple[int, float]]]]:
        """(unit, matches) of the units between ``marks`` that have some."""
        if len(words.hash) < 2 or not len(self.sets):
            return []
        pairs = mix(words.hash[:-1] * BASE + words.hash[1:])
        unit = np.repeat(np.arange(len(marks) - 1), np.diff(words.first))
        whole = unit[:-1] == unit[1:]
        pairs, unit = pairs[whole], unit[:-1][whole]
        seen = np.isin(pairs, self.known)
        hits = np.bincount(unit[seen], minlength=len(marks) - 1)
        out = []
        at = np.searchsorted(unit, np.arange(len(marks)))
        # a unit needs low x (its distinct bigrams) known ones, and those of the smallest template
        for i in np.flatnonzero(hits >= self.low * self.sizes[0] - 1e-9).tolist():
            own = np.unique(pairs[at[i]:at[i + 1]])
            if np.isin(own, self.known).sum() >= self.low * len(own) - 1e-9 and (found := self.matches(own)):
                out.append((i, found))
        return out

    def windows(self, words: Words) -> Iterator[tuple[int, list[tuple[int, int, int, float]]]]:
        """For each text that has some: its windows that match a template, as
        (first byte, end byte, template, coefficient), larger templates first, then
        the higher coefficient."""
        if len(words.hash) < 2 or not len(self.sets):
            return
        pairs = mix(words.hash[:-1] * BASE + words.hash[1:])
        text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
        spot = np.minimum(np.searchsorted(self.known, pairs), len(self.known) - 1)
        spot[(self.known[spot] != pairs) | (text[:-1] != text[1:])] = len(self.known)  # not known
        seen = np.flatnonzero(spot < len(self.known))
        # distinct bigrams of each template in each text: a window has no more than its text
        held, of = np.divmod(np.unique(text[seen] * len(self.known) + spot[seen]), len(self.known))
        count = self.begin[of + 1] - self.begin[of]
        at = np.repeat(self.begin[of] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        which, n = np.unique(np.repeat(held, count) * len(self.sets) + self.having[at], return_counts=True)
        which = which[n >= self.low * self.sizes[which % len(self.sets)] - 1e-9]
        for i in np.unique(which // len(self.sets)).tolist():
            a, b = int(words.first[i]), int(words.first[i + 1]) - 1
            near, found = neighbours(pairs[a:b]), []
            for k in (which[which // len(self.sets) == i] % len(self.sets)).tolist():
                own = np.zeros(len(self.known) + 1, dtype=bool)
                own[self.spots[k]] = True
                found += [(-len(self.spots[k]), -dice, int(words.start[a + s]), int(words.end[a + e + 1]), self.sets[k][0], k)
                          for s, e, dice in self._matches(own[spot[a:b]], *near, len(self.spots[k]))]
            if found:
                yield i, [(s, e, k, -dice) for _, dice, s, e, _, k in sorted(found)]

    def _matches(self, hit: np.ndarray, before: np.ndarray, after: np.ndarray, m: int) -> list[tuple[int, int, float]]:
        """(first, last, coefficient): the best window from each bigram that has
        one.  Best windows start and end with bigrams of the template (``hit``)
        and end before their first bigram returns: shortened to that they lose no
        common bigram.  Bigrams are counted once, where they are new (``before``
        lies before the window).  The range then takes in the neighbouring bigrams
        of the template that change neither count."""
        hits = np.concatenate(([0], np.cumsum(hit)))
        fresh = np.concatenate(([0], np.cumsum(before < 0)))  # new in the text, so in every window
        first = np.flatnonzero(hit)
        stop = np.minimum(after[first], np.searchsorted(fresh, fresh[first] + self.high * m + 1e-9, "right") - 1)
        enough = hits[stop] - hits[first] >= self.low * m - 1e-9
        out = []
        for s, e in zip(first[enough].tolist(), stop[enough].tolist()):
            new = before[s:e] < s
            dice = 2 * np.cumsum(new & hit[s:e]) / (np.cumsum(new) + m)
            top = float(dice.max())
            if top >= self.threshold:
                last = s + int(np.flatnonzero((dice == top) & hit[s:e])[-1])
                lead = s  # bigrams of the template that return inside change no count: at most m of them
                while lead > max(0, s - m) and hit[lead - 1] and after[lead - 1] <= last:
                    lead -= 1
                out.append((lead, last, top))
        return out


def neighbours(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the same value before (-1: none) and after (length: none)."""
    order = np.argsort(pairs, kind="stable")
    same = np.flatnonzero(pairs[order[1:]] == pairs[order[:-1]])
    before, after = np.full(len(pairs), -1), np.full(len(pairs), len(pairs))
    before[order[same + 1]], after[order[same]] = order[same], order[same + 1]
    return before, after


def units(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Byte marks that cut the joined texts into texts, paragraphs and lines.
    A line with nothing but spaces, tabs and carriage returns is blank."""
    line = np.flatnonzero(data == 10)
    solid = np.concatenate(([0], np.cumsum(~BLANK[data])))
    text = np.searchsorted(offsets, line, "right")
    blank = line[:-1][(solid[line[1:]] == solid[line[:-1]]) & (text[1:] == text[:-1])]
    return {"text": offsets, "paragraph": np.union1d(offsets, blank + 1), "line": np.union1d(offsets, line + 1)}


def scan(df: DataFrame, text: str, keep: list[str], templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns and ``licenses``: array of (start, end, license, dice)
    with byte ranges, in order.  A range that several units share is given
    once.  Units are named by their best template that fits; then windows of words
    are given unless at least half of them lies in ranges given before: larger
    templates and better windows go first.  What matches templates of which none
    fits and is not covered so is ``unknown``.  Null and empty texts, and texts of
    one word, have none.  ``keep`` must not hold ``licenses`` or ``_text``."""
    no_clash(keep, "licenses _text")
    found = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("dice", pa.float64())])
    base = df.select(*keep, F.col(text).alias("_text"))

    def run(batches):
        own = Templates(templates, threshold)
        for batch in byte_slices(batches, "_text"):
            data, offsets = joined_bytes(batch.column("_text"))
            units_of: dict[int, list] = {}  # by text: (start, end, matches)
            whole = split_words(data, offsets)
            for marks in units(data, offsets).values():
                words = whole
                if marks is not offsets:  # equal marks (empty texts) hold nothing
                    marks = np.unique(marks)
                    words = split_words(data, marks)
                for i, matches in own.scan(words, marks):
                    row = int(np.searchsorted(offsets, marks[i], "right")) - 1
                    end = int(marks[i + 1])
                    end -= int(end > marks[i] and data[end - 1] == 10)
                    units_of.setdefault(row, []).append((int(marks[i] - offsets[row]), int(end - offsets[row]), matches))
            windows_of = {row: [(s - int(offsets[row]), e - int(offsets[row]), [(k, dice)]) for s, e, k, dice in found_]
                          for row, found_ in own.windows(whole)}
            rows: list[list] = [[] for _ in range(batch.num_rows)]
            for row in units_of.keys() | windows_of.keys():
                body = data[offsets[row]:offsets[row + 1]].tobytes()
                rows[row] = [dict(zip(("start", "end", "license", "dice"), x)) for x in sorted(
                    _named(own, body, units_of.get(row, []), windows_of.get(row, [])))]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(rows, pa.list_(found))], [*keep, "licenses"])

    return base.mapInArrow(run, arrow_fields(base, keep)
                           + "licenses array<struct<start:long,end:long,license:string,dice:double>>")


def _named(own: Templates, body: bytes, whole: list, windows: list) -> set[tuple[int, int, str, float]]:
    """The ranges that are given for one text, from its matching units and windows."""
    given = np.zeros(len(body), dtype=bool)
    out, left = set(), []
    for is_unit, (start, end, matches) in [*((True, x) for x in whole), *((False, x) for x in windows)]:
        fitting = [(own.sets[k][0], dice) for k, dice in matches if own.fits(k, body, start, end)]
        if not fitting:
            left.append((start, end, matches[0][1]))
        elif is_unit or 2 * np.count_nonzero(given[start:end]) < end - start:
            given[start:end] = True
            out.add((start, end, *fitting[0]))
    for start, end, dice in left:
        if 2 * np.count_nonzero(given[start:end]) < end - start:
            given[start:end] = True
            out.add((start, end, UNKNOWN, dice))
    return out


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licenses of all ``documents``: number of ranges, the distinct names and
    the ranges with their coefficients."""
    rows = scan(table(spark, sf_dir, "documents"), "text", ["doc_id"])
    return rows.select(
        "doc_id", F.size("licenses").cast("long").alias("n_ranges"),
        F.array_join(F.array_sort(F.array_distinct(F.col("licenses.license"))), ",").alias("names"),
        F.array_join(F.transform("licenses", lambda x: F.concat_ws(
            ":", x["license"], x["start"], x["end"], F.format_number(x["dice"], 4))), ",").alias("ranges"))
