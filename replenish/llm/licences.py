"""Licence scan: parts of texts against licence templates by the Dice coefficient of word bigrams.

Text and templates are lower-cased and cut to words of letters and digits. A coefficient of t is
only possible between bigram counts a and b with t / (2 - t) <= a / b <= (2 - t) / t, so the number of
words leaves few templates or none; parts with too few bigrams of any template, and templates that
share too few words to reach t, are passed over, and the rest are compared. Parts are sentences, lines, paragraphs and whole texts.

Notices that are none of these, as those wrapped in a longer comment or inside a line, are passages:
runs of words over line ends from a shared bigram to another one, whose coefficient reaches the
threshold. Only starts with enough shared bigrams within the largest possible run are tried.

Close relatives differ in a word or a number of long notices, so a coefficient can't tell them apart: what is found
must also have its template's telling words (kind, version, clauses). If it has others, it is ``ambiguous``.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame

THRESHOLD = 0.8
AMBIGUOUS = "ambiguous"
_GNU = (
    "is free software: you can redistribute it and/or modify it under the terms of the {0} as published by the Free Software "
    "Foundation, either version {1} of the License, or (at your option) any later version."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission.",
)


def _gnu(program: str, title: str, version: str) -> tuple[str, ...]:
    return f"This work is licensed under the {title}, version {version}.", f"This {program} {_GNU.format(title, version)}"


def _commons() -> dict[str, tuple[str, ...]]:
    """Short and long notices of the six Creative Commons licences in two versions."""
    words = {"SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
    out = {}
    for version, reach in (("4.0", "International"), ("3.0", "Unported")):
        for terms in ((), ("SA",), ("NC",), ("ND",), ("NC", "SA"), ("NC", "ND")):
            short, title = "-".join(["BY", *terms]), "-".join(["Attribution", *[words[t] for t in terms]])
            out[f"CC-{short}-{version}"] = (
                f"Licensed under CC {short} {version}.", f"This work is licensed under a Creative Commons {title} {version} {reach} License.",
            )
    return out


# fixed values: the wording of notices and short licences
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "GPL-3.0": _gnu("program", "GNU General Public License", "3"),
    "GPL-2.0": _gnu("program", "GNU General Public License", "2"),
    "LGPL-2.1": _gnu("library", "GNU Lesser General Public License", "2.1"),
    "LGPL-3.0": _gnu("library", "GNU Lesser General Public License", "3"),
    "AGPL-3.0": _gnu("program", "GNU Affero General Public License", "3"),
    **_commons(),
    "CC0-1.0": ("Released under CC0 1.0.", "This work is dedicated to the public domain under the Creative Commons CC0 1.0 Universal Public Domain Dedication."),
    # the first condition is that of all, so alone it does not say which
    "BSD": (_BSD[0],),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", " ".join(_BSD[:2])),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", " ".join(_BSD)),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
# fixed values: words that tell close relatives apart, besides the numbers of versions and clauses
TELLING = {"lesser", "affero", "nc", "noncommercial", "sa", "sharealike", "nd", "noderivatives", "noderivs", "cc0", "neither", "endorse"}
_VERSION = re.compile(r"v?([1-9]\d?)")
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])[ \t]+")
_PARAGRAPH = re.compile(r"\n[ \t]*\n\s*")


def normal(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def dice(a: Counter, b: Counter) -> float:
    """Twice the shared bigrams over all, repeats counted."""
    total = sum(a.values()) + sum(b.values())
    return 2 * (a & b).total() / total if total else 0.0


def telling(words: list[str]) -> frozenset[str]:
    """The telling words and small numbers among ``words``; 2.0 is 2 and v3 is 3."""
    numbers = (_VERSION.fullmatch(w) for w in words)
    return frozenset(m[1] for m in numbers if m) | TELLING.intersection(words)


def _half(run: tuple[int, int], span: tuple[int, int]) -> bool:
    """Whether half of the run's words lie in the span."""
    return 2 * (min(run[1], span[1]) - max(run[0], span[0])) >= run[1] - run[0]


class Templates:
    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.all, self.telling = [], []
        for name, texts in templates.items():
            for text in texts:
                words = normal(text)
                self.all.append((name, frozenset(words), Counter(zip(words, words[1:]))))
                self.telling.append(telling(words))
        ratio = threshold / (2 - threshold)
        self.by_size: dict[int, list] = {}
        for number, (_, _, bigrams) in enumerate(self.all):
            b = bigrams.total()
            for a in range(1, int(b / ratio) + 2):
                if b * ratio <= a + 1e-9 and a * ratio <= b + 1e-9:
                    self.by_size.setdefault(a, []).append(number)
        # the fewest shared bigrams that any template takes of a part of that size
        self.need = {a: min(threshold * (a + self.all[n][2].total()) / 2 for n in near) for a, near in self.by_size.items()}
        # of runs whose shared bigrams are two thirds, and four at least of a template's, three lie within five places
        self.dense = 4 if threshold >= 0.8 and min((b.total() for _, _, b in self.all), default=0) >= 4 else None
        self.ratio = ratio
        self.with_bigram: dict[tuple[str, str], list[int]] = {}
        for number, (_, _, bigrams) in enumerate(self.all):
            for g in bigrams:
                self.with_bigram.setdefault(g, []).append(number)

    def agrees(self, words: list[str], number: int) -> bool:
        """Whether what lies between the first and the last shared bigram has the template's telling words, and no others."""
        bigrams = self.all[number][2]
        shared = [i for i, g in enumerate(zip(words, words[1:])) if g in bigrams]
        return telling(words[shared[0] : shared[-1] + 2]) == self.telling[number]

    def best(self, words: list[str]) -> tuple[str, float] | None:
        """Of the templates with a coefficient of the threshold or more that agree in the telling words the most alike, of equals the first by name.

        If none agrees, a relative without a template is there, and the name is ``ambiguous``.
        """
        size = len(words) - 1
        near = self.by_size.get(size)
        if not near:
            return None
        found, own = [], None
        for number in near:
            name, vocabulary, bigrams = self.all[number]
            need = self.threshold * (size + bigrams.total()) / 2
            # every shared bigram starts at a shared word
            if sum(w in vocabulary for w in words) < need:
                continue
            own = own or Counter(zip(words, words[1:]))
            score = dice(own, bigrams)
            if score >= self.threshold:
                found.append((not self.agrees(words, number), -score, name))
        if not found:
            return None
        other, score, name = min(found)
        return AMBIGUOUS if other else name, -score

    def parts(self, text: str):
        """(kind, first line, last line, words, place of the first word) of every part; a part that is all of a larger one comes once."""
        line_number = 0
        everything: list[str] = []
        paragraphs = _PARAGRAPH.split(text)
        gaps = _PARAGRAPH.findall(text) + [""]
        for paragraph, gap in zip(paragraphs, gaps):
            first, of_paragraph, start = line_number, [], len(everything)
            for line in paragraph.split("\n"):
                words = normal(line)
                at = start + len(of_paragraph)
                yield "line", line_number, line_number, words, at
                sentences = _SENTENCE.split(line)
                if len(sentences) > 1:
                    for sentence in sentences:
                        of_sentence = normal(sentence)
                        yield "sentence", line_number, line_number, of_sentence, at
                        at += len(of_sentence)
                of_paragraph += words
                line_number += 1
            if line_number > first + 1:
                yield "paragraph", first, line_number - 1, of_paragraph, start
            everything += of_paragraph
            line_number += gap.count("\n") - 1
        if len(paragraphs) > 1:
            yield "text", 0, line_number, everything, 0

    def known(self, words: list[str]) -> list[int]:
        """Places of the bigrams that some template has."""
        return [i for i, g in enumerate(zip(words, words[1:])) if g in self.with_bigram]

    def passages(self, words: list[str], places: list[int] | None = None):
        """(first word, word after the last, licence, dice) of runs like a template; of those that overlap the one that shares most.

        Runs that agree in the telling words go before others, so a run is ``ambiguous`` only where no template agrees.
        """
        places = self.known(words) if places is None else places
        if self.dense and not any(b - a <= self.dense for a, b in zip(places, places[2:])):
            return
        placed: dict[int, list[tuple[int, tuple[str, str]]]] = {}
        for i in places:
            g = words[i], words[i + 1]
            for number in self.with_bigram[g]:
                placed.setdefault(number, []).append((i, g))
        found = []
        for number, hits in placed.items():
            name, _, bigrams = self.all[number]
            size = bigrams.total()
            least, most = ceil(size * self.ratio - 1e-9), int(size / self.ratio + 1e-9)
            for k in range(len(hits) - least + 1):
                first = hits[k][0]
                if hits[k + least - 1][0] - first >= most:
                    continue
                left, shared, best = dict(bigrams), 0, None
                for i, g in hits[k : k + most]:
                    if i - first >= most:
                        break
                    if left[g]:
                        left[g] -= 1
                        shared += 1
                        score = 2 * shared / (i - first + 1 + size)
                        if score >= self.threshold and (best is None or score > best[1]):
                            best = shared, score, i + 2
                if best:
                    other = telling(words[first : best[2]]) != self.telling[number]
                    found.append((other, -best[0], -best[1], name, first, best[2]))
        taken: list[tuple[int, int]] = []
        for other, _, score, name, first, end in sorted(found):
            k = bisect_right(taken, (first, end))
            if (k == 0 or taken[k - 1][1] <= first) and (k == len(taken) or end <= taken[k][0]):
                taken.insert(k, (first, end))
                yield first, end, AMBIGUOUS if other else name, -score

    def found(self, text: str):
        """(kind, first line, last line, licence, dice); a passage comes if no part that is found holds half of its words.

        A part that is ``ambiguous`` as a whole gives way to a passage in it that is not.
        """
        parts, sized, starts, numbers, everything = [], [], [], [], []
        for kind, first, last, words, at in self.parts(text):
            if kind == "line":
                starts.append(at)
                numbers.append(first)
                everything += words
            if len(words) - 1 in self.need:
                sized.append((kind, first, last, words, at))
        places = self.known(everything)
        for kind, first, last, words, at in sized:
            size = len(words) - 1
            if bisect_left(places, at + size) - bisect_left(places, at) >= self.need[size] and (best := self.best(words)):
                parts.append((at, at + len(words), kind, first, last, *best))
        passages = sorted(self.passages(everything, places))
        named = [(first, end) for first, end, licence, _ in passages if licence != AMBIGUOUS]
        spans = []
        for a, b, *part in parts:
            if part[3] != AMBIGUOUS or not any(_half(run, (a, b)) for run in named):
                spans.append((a, b))
                yield tuple(part)
        line = lambda place: numbers[bisect_right(starts, place) - 1]
        for first, end, *best in passages:
            if not any(_half((first, end), span) for span in spans):
                yield "passage", line(first), line(end - 1), *best


def _scan(templates, threshold):
    def rows(batches):
        own = Templates(templates, threshold)
        for batch in batches:
            ids, found = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for row in own.found(text or ""):
                    ids.append(doc_id)
                    found.append(row)
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), *(pa.array(c) for c in zip(*found))],
                    names=["doc_id", "part", "first_line", "last_line", "licence", "dice"],
                )

    return rows


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, part, first_line, last_line, licence, dice) of every part or passage of a text that is like a template.

    Null and empty texts have none; repeated rows are scanned each, repeated notices come each; other
    columns are not read. One pass over the texts, nothing is moved.
    """
    schema = "doc_id long, part string, first_line long, last_line long, licence string, dice double"
    return docs.select("doc_id", "text").mapInArrow(_scan(templates, threshold), schema)
