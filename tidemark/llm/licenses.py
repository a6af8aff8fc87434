"""License scans by patience alignment of whole texts with license templates.

A text and a template are word sequences (A-Z lower-cased). The alignment anchors on words that occur once in the text
and once in the template, takes the longest increasing subsequence of these anchors, and aligns the gaps between them
in the same way, where other words are unique; beside an anchor, equal neighbours match too. Coverage is the share of
the template's words that match, density the share of matching words from the first to the last of them in the text.

Words of a notice that stands twice in a text are not unique in it, so the alignment is made for each region of the
text in which the template's word pairs stand in about the template's order, and for chains of neighbouring regions, as
far as the density allows a notice to be stretched by inserted words. Between the findings, every stretch of that length
that holds enough of the template's words, in any order, is aligned as well. A template is found where coverage and
density reach their thresholds and its telling words (the license's name and version) match. Of overlapping findings the
one with most matching words stays, then the best coverage, then the first name.

Each text is judged by itself, so the plan is one pass without a shuffle. Texts that lack too many of a template's words
to reach the coverage are not aligned with it; this drops no finding.

Cases: a null or empty text has no findings; repeated rows each get a row; a null id is kept; an empty table gives no
rows; texts are read whole, whatever their length; other columns are not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches

COVERAGE, DENSITY = 0.8, 0.5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""
_BSD3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the {} General Public
License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {} General Public License for more
details."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means."""

# Fixed values: (license, template, telling words), the public texts of common licenses and the usual short notices.
TEMPLATES = [
    ("MIT", _MIT, "permission"),
    ("MIT", "Released under the MIT License.", "mit license"),
    ("MIT", "Licensed under the MIT License.", "mit license"),
    ("BSD-2-Clause", f"{_BSD} {_BSD_END}", "redistribution"),
    ("BSD-3-Clause", f"{_BSD} {_BSD3} {_BSD_END}", "redistribution neither endorse"),
    ("ISC", _ISC, "permission fee"),
    ("Apache-2.0", _APACHE, "apache"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache license 2 0"),
    ("GPL-2.0", _GPL.format("GNU", "2", "GNU"), "gnu general 2"),
    ("GPL-3.0", _GPL.format("GNU", "3", "GNU"), "gnu general 3"),
    ("AGPL-3.0", _GPL.format("GNU Affero", "3", "GNU Affero"), "gnu affero 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", "gnu general public 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "gnu general public 3"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.", "gnu lesser public 3"),
    ("MPL-2.0", _MPL, "mozilla mpl"),
    ("Unlicense", _UNLICENSE, "unencumbered"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", "cc by 4 0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", "cc by sa 4 0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "cc by nc 4 0"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0.", "cc by nc sa 4 0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0.", "cc by nd 4 0"),
    ("CC0-1.0", "Licensed under CC0 1.0.", "cc0 1 0"),
]

_FINDING = "array<struct<license:string,start:int,stop:int,matched:int,coverage:double,density:double>>"


class Template(NamedTuple):
    license: str
    words: list[str]
    telling: set[str]
    rare_first: list[tuple[str, int]]
    pairs: dict[tuple[str, str], list[int]]
    need: dict[str, int]


def template(license: str, text: str, telling: str) -> Template:
    words = re.findall(WORD, text.lower())
    pairs = defaultdict(list)
    for k, pair in enumerate(zip(words, words[1:])):
        pairs[pair].append(k)
    rare_first = sorted(Counter(words).items(), key=lambda x: (-len(x[0]), x[0]))
    return Template(license, words, set(telling.split()), rare_first, dict(pairs), dict(rare_first))


def increasing(xs: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence."""
    tops, piles, back = [], [], []
    for i, x in enumerate(xs):
        k = bisect_left(tops, x)
        if k == len(tops):
            tops.append(x)
            piles.append(i)
        else:
            tops[k], piles[k] = x, i
        back.append(piles[k - 1] if k else -1)
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs (i, j) with a[i] == b[j], increasing in both, by patience alignment."""
    found, gaps = [], [(0, len(a), 0, len(b), False, False)]
    while gaps:
        i, m, j, n, left, right = gaps.pop()
        while left and i < m and j < n and a[i] == b[j]:  # beside the anchor before
            found.append((i, j))
            i, j = i + 1, j + 1
        while right and i < m and j < n and a[m - 1] == b[n - 1]:  # beside the anchor behind
            m, n = m - 1, n - 1
            found.append((m, n))
        if i == m or j == n:
            continue
        ours, theirs = Counter(a[i:m]), Counter(b[j:n])
        at = {w: k for k, w in enumerate(b[j:n], j) if theirs[w] == 1}
        both = [(k, at[w]) for k, w in enumerate(a[i:m], i) if w in at and ours[w] == 1]
        anchors = [both[k] for k in increasing([y for _, y in both])]
        if not anchors:
            continue
        found += anchors
        x, y = i, j
        for k, (p, q) in enumerate(anchors):
            gaps.append((x, p, y, q, left or k > 0, True))
            x, y = p + 1, q + 1
        gaps.append((x, m, y, n, True, right))
    return sorted(found)


def possible(low: str, t: Template, coverage: float) -> bool:
    """Whether the text holds enough of the template's words; a word within a longer one counts, so none is missed."""
    spare = len(t.words) * (1 - coverage) + 1e-9
    for word, n in t.rare_first:
        if word not in low:
            spare -= n
            if spare < 0 or word in t.telling:
                return False
    return True


def regions(words: list[str], t: Template, density: float = DENSITY) -> list[tuple[int, int]]:
    """Stretches of the text where the template's word pairs point to about the same beginning, and chains of them."""
    n, slack = len(t.words), max(1, len(t.words) // 4)
    reach = stretch(t, density, len(words))
    starts = sorted({p - k for p, pair in enumerate(zip(words, words[1:])) for k in t.pairs.get(pair, ())})
    out, groups, k = [], [], 0
    while k < len(starts):
        first = last = starts[k]
        while k < len(starts) and starts[k] - last <= slack:
            last = starts[k]
            k += 1
        if last - first > n:  # many copies in a row
            out += [(x - slack, x + n + slack) for x in range(first, last + 1, slack)]
        out.append((first - slack, last + n + slack))
        groups.append((first, last))
    for i, (first, _) in enumerate(groups):
        for begin, last in groups[i + 1 :]:
            if begin - first > reach:
                break
            out.append((first - slack, min(last, first + reach) + n + slack))
    return list(dict.fromkeys((max(0, x), min(len(words), y)) for x, y in out))


def stretch(t: Template, density: float, most: int) -> int:
    """The most words that a notice of the template can span."""
    return min(most, int(len(t.words) / density + 1e-9)) if density > 0 else most


def crowded(words: list[str], t: Template, lo: int, hi: int, coverage: float, density: float):
    """Stretches from lo to hi, as long as a notice can be, that hold enough of the template's words and the telling ones."""
    least, length = len(t.words) * coverage - 1e-9, stretch(t, density, hi - lo)
    hits = [p for p in range(lo, hi) if words[p] in t.need]
    if len(hits) < least:
        return
    have, total, begin, end = Counter(), 0, 0, 0
    for a in sorted({lo, *(p + 1 for p in hits[:-1]), *(max(lo, p - length + 1) for p in hits)}):  # where the words held change
        while end < len(hits) and hits[end] < a + length:
            w = words[hits[end]]
            have[w] += 1
            total += have[w] <= t.need[w]
            end += 1
        while hits[begin] < a:
            w = words[hits[begin]]
            total -= have[w] <= t.need[w]
            have[w] -= 1
            begin += 1
        if total >= least and all(have[w] for w in t.telling):
            yield a, min(a + length, hi)


def findings(text: str | None, templates: list[Template], coverage: float = COVERAGE, density: float = DENSITY, sift: bool = True) -> list[dict]:
    """Licenses of a text: license, start and stop in code points (end exclusive), matched words, coverage, density."""
    low = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    wanted = [t for t in templates if not sift or possible(low, t, coverage)]
    if not wanted:
        return []
    places = [m.span() for m in re.finditer(WORD, low)]
    words, found = [low[a:b] for a, b in places], []
    known = set(words)

    def judge(t: Template, a: int, b: int) -> tuple[int, int] | None:
        pairs = align(words[a:b], t.words)
        if not pairs or not t.telling <= {t.words[j] for _, j in pairs}:
            return None
        first, last = a + pairs[0][0], a + pairs[-1][0]
        covered, dense = len(pairs) / len(t.words), len(pairs) / (last - first + 1)
        if covered < coverage or dense < density:
            return None
        found.append({"license": t.license, "start": places[first][0], "stop": places[last][1], "matched": len(pairs), "coverage": covered, "density": dense})
        return first, last + 1

    for t in wanted:
        if sift and not t.telling <= known:
            continue
        spans = sorted(x for a, b in regions(words, t, density) if (x := judge(t, a, b)))
        lo = 0
        for first, last in (*spans, (len(words), len(words))):
            at = lo
            for a, b in crowded(words, t, lo, first, coverage, density):
                if a >= at and (x := judge(t, a, b)):
                    at = x[1]
            lo = max(lo, last)
    kept, begins = [], []
    for x in sorted(found, key=lambda x: (-x["matched"], -x["coverage"], x["license"], x["start"], x["stop"])):
        k = bisect_left(begins, x["stop"])  # the kept ones are apart, so only the last that begins before x ends can overlap
        if not k or kept[k - 1]["stop"] <= x["start"]:
            begins.insert(k, x["start"])
            kept.insert(k, x)
    return kept


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str, str]] | None = None,
         coverage: float = COVERAGE, density: float = DENSITY) -> DataFrame:
    """One row per document: id, findings (as in `findings`), sorted by start."""
    ready = [template(*t) for t in (TEMPLATES if templates is None else templates)]

    def run(parts):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("matched", pa.int32()), ("coverage", pa.float64()), ("density", pa.float64())]))
        for part in parts:
            found = [findings(text.as_py(), ready, coverage, density) for text in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], names=["id", "findings"])

    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id long, findings {_FINDING}").withColumnRenamed("id", id_col)
