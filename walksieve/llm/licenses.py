"""License scans by patience alignment of texts with license templates.

Words are runs of ASCII letters and digits, lower-cased. Text and template are aligned by
anchoring on words that occur once in each, keeping the longest increasing subsequence of
anchors and aligning every gap between them in the same way; equal words at the ends of a
gap are matched first. Coverage is the share of the template's words that are aligned.

A notice lies within twice the template's length. Windows start at the template's words in
the text, so where a notice stands does not matter; of the alignments that meet in one place
the one with most aligned and fewest skipped words counts. What it aligned is taken out and
the rest is aligned again until nothing reaches the coverage. Texts and windows that hold
too few of the template's words to reach the coverage are left out: that bound is exact.
Templates that meet in one place compete for it in the same way. The words that tell a
short notice's license apart (name and version) must all be aligned.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[A-Za-z0-9]+")

# Public license notices and texts.
TEMPLATES = {
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""",
    "gpl-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details.""",
    "mpl-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
}

_GNU = """This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published
by the Free Software Foundation; either version {version} of the License, or (at your option) any later version. This {what}
is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."""
for _key, _what, _name, _version in (
        ("gpl-1.0", "program", "General Public License", "1"), ("gpl-2.0", "program", "General Public License", "2"),
        ("lgpl-2.0", "library", "Library General Public License", "2"), ("lgpl-2.1", "library", "Lesser General Public License", "2.1"),
        ("lgpl-3.0", "library", "Lesser General Public License", "3"), ("agpl-3.0", "program", "Affero General Public License", "3")):
    TEMPLATES[f"{_key}-header"] = _GNU.format(what=_what, name=_name, version=_version)
    TEMPLATES[f"{_key}-notice"] = f"This work is licensed under the GNU {_name}, version {_version}."
#: License, and how short notices name it.
_NAMES = {
    "apache-1.1": ["Apache License, Version 1.1"], "apache-2.0": ["Apache License 2.0", "Apache License, Version 2", "Apache 2.0 License"],
    "bsd": ["BSD License"], "bsd-2-clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "bsd-3-clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License"], "bsd-4-clause": ["BSD 4-Clause License"],
    "0bsd": ["BSD Zero Clause License", "0BSD License"], "mit-0": ["MIT No Attribution License", "MIT-0 License"], "isc": ["ISC License"],
    "mpl-1.1": ["Mozilla Public License, Version 1.1"], "mpl-2.0": ["Mozilla Public License, Version 2.0"],
    "epl-1.0": ["Eclipse Public License, Version 1.0"], "epl-2.0": ["Eclipse Public License, Version 2.0"],
    "eupl-1.1": ["European Union Public Licence, Version 1.1"], "eupl-1.2": ["European Union Public Licence, Version 1.2"],
    "cddl-1.0": ["Common Development and Distribution License, Version 1.0"], "bsl-1.0": ["Boost Software License, Version 1.0"],
    "artistic-1.0": ["Artistic License 1.0"], "artistic-2.0": ["Artistic License 2.0"], "zlib": ["zlib License"], "unlicense": ["Unlicense"],
    "gfdl-1.2": ["GNU Free Documentation License, version 1.2"], "gfdl-1.3": ["GNU Free Documentation License, version 1.3"],
    "cc0-1.0": ["CC0 1.0", "Creative Commons Zero 1.0 Universal License"],
}
for _short, _name, _versions in (("gpl", "General Public License", "1.0 2.0 3.0"), ("lgpl", "Library General Public License", "2.0"),
                                 ("lgpl", "Lesser General Public License", "2.1 3.0"), ("agpl", "Affero General Public License", "3.0")):
    for _version in _versions.split():
        _v = _version.removesuffix(".0")
        _NAMES[f"{_short}-{_version}"] = [f"GNU {_name}, version {_v}", f"GNU {_name} v{_v}", f"{_short}v{_v}", f"{_short}-{_version}", f"GNU {_short} version {_v}"]
_PARTS = {"by": "Attribution", "nc": "NonCommercial", "nd": "NoDerivatives", "sa": "ShareAlike"}
for _kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"):
    for _version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
        _long = "-".join(_PARTS[x] for x in _kind.split("-"))
        _NAMES[f"cc-{_kind}-{_version}"] = [f"CC {_kind} {_version}", f"Creative Commons {_long} {_version} License"]
for _key, _forms in _NAMES.items():
    for _i, _name in enumerate(_forms):  # what follows # tells forms of one notice apart
        TEMPLATES.setdefault(f"{_key}-notice" + (f"#{_i}" if _i or f"{_key}-notice" in TEMPLATES else ""), f"Licensed under the {_name}.".replace("the CC", "CC"))

#: Words that every alignment with these headers must hold; short notices need all words but the common ones.
TELLS = {
    "apache-2.0-header": "apache 2", "mpl-2.0-header": "mozilla 2", "gpl-1.0-header": "gnu 1", "gpl-2.0-header": "gnu 2", "gpl-3.0-header": "gnu 3",
    "lgpl-2.0-header": "library 2", "lgpl-2.1-header": "lesser 2 1", "lgpl-3.0-header": "lesser 3", "agpl-3.0-header": "affero 3",
}
_SHORT = 25
_COMMON = frozenset("a and is in it license licensed licence licenced of or released terms the this under version work".split())

_AGPL_13 = """13. Remote Network Interaction; Use with the GNU General Public License. Notwithstanding any other provision of this
License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through
a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your
version by providing access to the Corresponding Source from a network server at no charge, through some standard or customary
means of facilitating copying of software. This Corresponding Source shall include the Corresponding Source for any work covered
by version 3 of the GNU General Public License that is incorporated pursuant to the following paragraph. Notwithstanding any
other provision of this License, you have permission to link or combine any covered work with a work licensed under version 3 of
the GNU General Public License into a single combined work, and to convey the resulting work. The terms of this License will
continue to apply to the part which is the covered work, but the work with which it is combined will remain governed by version 3
of the GNU General Public License. """


@cache
def public_templates() -> dict[str, str]:
    """TEMPLATES and the full texts beside this module (read on the driver; executors get prepared templates).

    The BSD variants and AGPL 3 are the texts of BSD 3 and GPL 3 with their own clauses; AGPL's preamble stays GPL's.
    """
    texts = {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
    bsd, gpl = texts["bsd-3-clause"], texts["gpl-3.0"]
    third, after = bsd.index("3. Neither"), bsd.index("THIS SOFTWARE")
    texts["bsd-2-clause"] = bsd[:third] + bsd[after:]
    texts["bsd-4-clause"] = (bsd[:third] + "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: "
                             "This product includes software developed by the organization. 4. " + bsd[third + 3:])
    a, b = gpl.index("13. Use with"), gpl.index("14. Revised Versions")
    named = lambda t: re.sub(r"(?i)(GNU)(\s+General\s+Public)", r"\1 Affero\2", t)
    texts["agpl-3.0"] = named(gpl[:a]) + _AGPL_13 + named(gpl[b:])
    return TEMPLATES | texts


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence."""
    tails, last, before = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        tails[k:k + 1] = [v]
        last[k:k + 1] = [i]
        before[i] = last[k - 1] if k else -1
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Aligned (text position, template position) pairs, increasing in both."""
    pairs, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        if a == b or c == d:
            continue
        there, here = Counter(text[a:b]), Counter(template[c:d])
        at = {w: i for i, w in enumerate(text[a:b], a) if there[w] == 1}
        anchors = [(at[w], j) for j, w in enumerate(template[c:d], c) if here[w] == 1 and w in at]
        anchors = [anchors[i] for i in increasing([x for x, _ in anchors])]
        if not anchors:
            continue
        pairs += anchors
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        todo += [(x + 1, y, u + 1, v) for (x, u), (y, v) in zip(edges, edges[1:])]
    return sorted(pairs)


@dataclass
class Template:
    name: str
    words: list[str]
    counts: Counter
    tells: frozenset  # all of them are in every alignment
    first: frozenset  # every alignment that reaches the coverage begins with one of them
    need: float  # aligned words, at least


def prepare(templates: dict[str, str], coverage: float) -> list[Template]:
    made = []
    for name, text in templates.items():
        w = words(text)
        if not w:
            raise ValueError(f"template {name} has no word")
        need = coverage * len(w) - 1e-9
        tells = TELLS[name].split() if name in TELLS and templates.get(name) == TEMPLATES.get(name) else set(w) - _COMMON if len(w) <= _SHORT else ()
        made.append(Template(name.split("#")[0], w, Counter(w), frozenset(tells), frozenset(w[:int(len(w) - need) + 1]), need))
    return made


@dataclass
class Hit:
    name: str
    size: int
    at: list[int]  # positions of the aligned words

    @property
    def score(self) -> float:
        """Aligned words, less half of what was left out of the template and of the text between the first and the last."""
        n = len(self.at)
        return n - (self.size - n) / 2 - (self.at[-1] + 1 - self.at[0] - n) / 2


def _rank(h: Hit) -> tuple:
    return -h.score, -len(h.at) / h.size, h.at[0], h.name


def _gaps(at: list[int], least: float) -> list[tuple[int, int]]:
    """Runs of at least so many words between the positions."""
    return [(x + 1, y) for x, y in zip(at, at[1:]) if y - x - 1 >= least]


def _best(tokens: list[str], places: list[int], p: int, t: Template) -> tuple[Hit | None, int]:
    """The best alignment whose window starts at places[p], over window lengths up to twice the template's, and the most aligned words."""
    size, best, seen, most = len(t.words), None, 0, 0
    short = size <= _SHORT
    for length in range(max(1, round(t.need)), 2 * size + 1) if short else (size, size * 5 // 4, size * 3 // 2, 2 * size):
        r = bisect_left(places, places[p] + length)
        if r == seen or r - p < t.need:
            continue
        seen, window = r, places[p:r]
        pairs = patience([tokens[i] for i in window], t.words)
        most = max(most, len(pairs))
        if len(pairs) >= t.need and t.tells.issubset(t.words[j] for _, j in pairs):
            hit = Hit(t.name, size, [window[i] for i, _ in pairs])
            best = min(best or hit, hit, key=_rank)
    return best, most


def _hits(tokens: list[str], lo: int, hi: int, t: Template) -> list[Hit]:
    """Alignments of one template with tokens[lo:hi] that share no word: one per place, the rest aligned again."""
    out, todo = [], [(lo, hi)]
    while todo:
        lo, hi = todo.pop()
        places = [i for i in range(lo, hi) if tokens[i] in t.counts]
        size, have, enough, q, p = len(t.words), Counter(), 0, 0, 0
        while p < len(places) and len(places) - p >= t.need:
            while q < len(places) and places[q] < places[p] + 2 * size:
                w = tokens[places[q]]
                enough += have[w] < t.counts[w]
                have[w] += 1
                q += 1
            hit, on = None, p + 1
            if enough >= t.need and tokens[places[p]] in t.first:
                hit, most = _best(tokens, places, p, t)
                if size > _SHORT:  # a window aligns at most one word more for each place it moves; half of that, as anchors change
                    on = p + max(1, int(t.need - most) // 2)
                if hit:
                    end = bisect_left(places, hit.at[-1])
                    for k in range(p + 1, end + 1):  # a later start may do better
                        if tokens[places[k]] in t.first if size <= _SHORT else [tokens[i] for i in places[k:k + 2]] == t.words[:2]:
                            hit = min(hit, _best(tokens, places, k, t)[0] or hit, key=_rank)
                    on = bisect_left(places, hit.at[-1]) + 1
                    out.append(hit)
                    before = places[p]
                    if (before, hit.at[0]) != (lo, hi) and hit.at[0] - before >= t.need:
                        todo.append((before, hit.at[0]))
                    todo += _gaps(hit.at, t.need)
            for k in range(p, min(on, q)):
                w = tokens[places[k]]
                have[w] -= 1
                enough -= have[w] < t.counts[w]
            p, q = on, max(q, on)
    return out


def scan_text(text: str, templates: list[Template], coverage: float) -> list[tuple]:
    """(license, coverage, start, end, matched words) of every notice; start and end are code point offsets."""
    tokens = words(text)
    have = Counter(tokens)
    near = [t for t in templates if t.need <= len(tokens) and t.tells <= have.keys() and t.need <= sum(min(n, have[w]) for w, n in t.counts.items() if w in have)]
    if not near:
        return []
    won: list[Hit] = []
    used: set[int] = set()
    todo = [(0, len(tokens), near)]
    while todo:
        lo, hi, some = todo.pop()
        met = sorted(((h, t) for t in some for h in _hits(tokens, lo, hi, t)), key=lambda x: _rank(x[0]))
        for h, t in met:
            if sum(i not in used for i in h.at) >= t.need:
                used.update(h.at)
                won.append(h)
        # templates that lost a place look once more at the words that no winner aligned
        lost = [t for t in some if any(u is t and all(h is not w for w in won) for h, u in met)]
        if lost:
            inside = sorted(i for i in used if lo <= i < hi)
            todo += [(a, b, lost) for a, b in _gaps([lo - 1, *inside, hi], min(t.need for t in lost))]
    if not won:
        return []
    spans = [m.span() for m in _WORD.finditer(text)]
    found = [(h.name, len(h.at) / h.size, spans[h.at[0]][0], spans[h.at[-1]][1], len(h.at)) for h in won]
    return sorted(found, key=lambda h: (h[2], -h[4], h[0]))


def _check(df: DataFrame, text: str) -> None:
    if text not in df.columns:
        raise ValueError(f"no column {text}")


def scan(df: DataFrame, *, templates: dict[str, str] | None = None, coverage: float = 0.8, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """One row per row of `df`: the `keep` columns and `notices`, an array of (license, coverage, start, end, n_words).

    Notices are ordered by place. Null and empty texts have none; repeated rows and keys are scanned one by one.
    Texts that hold too few of every template's words are left after one pass over their words. Without templates of
    the caller's, public_templates() are looked for. Words of a template of up to 25 words that are not common to all
    notices must all be aligned; from # on, a template's name is not part of the license.
    """
    _check(df, text)
    prepared = prepare(templates or public_templates(), coverage)
    notice = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64()), ("n_words", pa.int64())])
    names = [f.name for f in notice]

    def run(batches):
        for b in batches:
            found = [[dict(zip(names, h)) for h in scan_text(v, prepared, coverage)] if v else [] for v in b.column(b.schema.get_field_index(text)).to_pylist()]
            cols = [b.column(b.schema.get_field_index(k)) for k in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(found, pa.list_(notice))], names=[*keep, "notices"])

    kept = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keep)
    schema = f"{kept}notices array<struct<license:string,coverage:double,start:bigint,end:bigint,n_words:bigint>>"
    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def summary(scanned: DataFrame, *, keep=("doc_id",)) -> DataFrame:
    """Per row: how many notices, their licenses (sorted, distinct) and the one that aligns most words."""
    best = F.array_max(F.transform("notices", lambda n: F.struct(
        n["n_words"].alias("n_words"), n["coverage"].alias("coverage"), (-n["start"]).alias("before"), n["license"].alias("license"), n["end"].alias("end"))))
    return scanned.select(
        *keep, F.size("notices").cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("notices", lambda n: n["license"]))), ",").alias("licenses"),
        best["license"].alias("license"), best["coverage"].alias("coverage"), (-best["before"]).alias("start"), best["end"].alias("end"))
