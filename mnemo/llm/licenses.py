"""License scans by patience alignment of texts with notice templates.

Words that occur once in both the template and a stretch of text are anchors; the longest
increasing run of anchors is kept, and the gaps between its members are aligned the same way. The
matched share of the template's words is its coverage.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType, DoubleType, LongType, StringType, StructField, StructType,
)

from mnemo.llm.common import per_text

#: The notices that projects put in their files, by SPDX name.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

HIT = StructType([
    StructField("license", StringType()), StructField("coverage", DoubleType()),
    StructField("start", LongType()), StructField("length", LongType()),
])
_EDGE = re.compile(r"^\W+|\W+$")


@dataclass(frozen=True)
class LicenseConfig:
    templates: dict[str, str] = field(default_factory=lambda: dict(NOTICES))
    #: Least share of the template's words that a hit matches, in order.
    coverage: float = 0.8


def words(text: str) -> list[str]:
    """Lower-case words between ASCII white space, without signs at their ends."""
    return [_EDGE.sub("", w) for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence of distinct values, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        p = bisect_left(tops, v)
        before.append(piles[p - 1] if p else -1)
        tops[p: p + 1] = [v]
        piles[p: p + 1] = [i]
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Index pairs of equal words, increasing in both lists."""
    pairs, work = [], [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        once: list[dict[str, int]] = []
        for x, s, t in ((a, a0, a1), (b, b0, b1)):
            place: dict[str, int] = {}
            for i in range(s, t):
                place[x[i]] = -1 if x[i] in place else i
            once.append(place)
        anchors = sorted((i, once[1].get(w, -1)) for w, i in once[0].items() if i >= 0 and once[1].get(w, -1) >= 0)
        kept = [anchors[i] for i in increasing([j for _, j in anchors])]
        if not kept:
            continue
        pairs += kept
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *kept], [*kept, (a1, b1)]):
            if i + 1 < k and j + 1 < m:
                work.append((i + 1, k, j + 1, m))
    return sorted(pairs)


class Scanner:
    def __init__(self, config: LicenseConfig):
        self.least = config.coverage
        self.templates = {n: words(t) for n, t in sorted(config.templates.items())}
        self.sets = {n: set(t) for n, t in self.templates.items()}
        self.all = set().union(*self.sets.values()) if self.sets else set()

    def __call__(self, text: str) -> list[dict]:
        """All hits, by start; of overlapping ones that of most matched words, then of most coverage."""
        own = words(text)
        where = [i for i, w in enumerate(own) if w in self.all]
        hits = []
        for name, template in self.templates.items():
            size, used = len(template), self.sets[name]
            # A hit has at least this many of the template's distinct words.
            need = self.least * size - (size - len(used))
            places = [i for i in where if own[i] in used]
            at = 0
            while at < len(places):
                start = places[at]
                end = start + 2 * size
                stop = bisect_left(places, end, at)
                if len({own[i] for i in places[at:stop]}) < need:
                    at += 1
                    continue
                pairs = align(own[start:end], template)
                if len(pairs) < self.least * size:
                    at += 1
                    continue
                first, last = start + pairs[0][0], start + pairs[-1][0]
                hits.append((-len(pairs), -len(pairs) / size, name, first, last + 1))
                at = bisect_left(places, last + 1, at + 1)
        hits.sort()
        taken: list[tuple] = []
        for hit in hits:
            if all(hit[4] <= other[3] or hit[3] >= other[4] for other in taken):
                taken.append(hit)
        return [
            {"license": h[2], "coverage": -h[1], "start": h[3], "length": h[4] - h[3]}
            for h in sorted(taken, key=lambda h: h[3])
        ]


def scan(docs: DataFrame, config: LicenseConfig = LicenseConfig()) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id and ``hits``: license, coverage, first word, words spanned.

    One row per row; null and empty texts and texts without a notice have no hits.
    """
    def compute(texts):
        scanner = Scanner(config)
        return [scanner(t.decode("utf-8", "replace")) for t in texts]

    return docs.select("doc_id", per_text(ArrayType(HIT), compute)(F.col("text")).alias("hits"))
