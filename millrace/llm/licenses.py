"""Licence scans: normalised text held against licence templates by the Dice coefficient of word bigrams."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass
from functools import lru_cache
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.tables import text_slices
from millrace.llm.words import Words, mixed

_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:"""
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
_BSD_END = """IN NO EVENT SHALL THE {} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Fixed texts: licences, and notices by which they are granted or named, in public use. A licence may have several notices.
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MIT notice": "Released under the MIT License.",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS"
AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR
IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE
COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. """
    + _BSD_END.format("COPYRIGHT HOLDER OR CONTRIBUTORS"),
    "BSD-3-Clause": f"""{_BSD_START} 1. Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the
copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without
specific prior written permission. {_BSD_AS_IS} {_BSD_END.format("COPYRIGHT HOLDER OR CONTRIBUTORS")}""",
    "BSD-4-Clause": f"""{_BSD_START} 1. Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution. 3. All advertising materials
mentioning features or use of this software must display the following acknowledgement: This product includes software developed by
the organization. 4. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission. {_BSD_AS_IS}
{_BSD_END.format("COPYRIGHT HOLDER OR CONTRIBUTORS")}""",
    "MIT-0": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to
do so. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR
ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this
software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product,
an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly
marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any
source distribution.""",
    "WTFPL": """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004 Everyone is permitted to copy and distribute verbatim
or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO
PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law
or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS
OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
License.""",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This
program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This
program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a
copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0 notice": "This work is dedicated to the public domain under CC0 1.0 Universal.",
    "all rights reserved": "Copyright. All rights reserved.",
}
for _name, _long, _versions in (
    ("GPL", "GNU General Public License", ("1", "2", "3")),
    ("LGPL", "GNU Library General Public License", ("2",)),
    ("LGPL", "GNU Lesser General Public License", ("2.1", "3")),
    ("AGPL", "GNU Affero General Public License", ("1", "3")),
):
    TEMPLATES[f"{_name} notice"] = f"Licensed under the {_long}."
    for _v in _versions:
        _id = f"{_name}-{_v if '.' in _v else _v + '.0'}"
        TEMPLATES.setdefault(
            _id,
            f"""This program is free software: you can redistribute it and/or modify it under the terms of the {_long} as published by
the Free Software Foundation, either version {_v} of the License, or (at your option) any later version. This program is distributed
in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
PARTICULAR PURPOSE. See the {_long} for more details.""",
        )
        TEMPLATES.setdefault(f"{_id} notice", f"This work is licensed under the {_long}, version {_v}.")
        TEMPLATES[f"{_id} notice (2)"] = f"Licensed under the {_long} v{_v}."
        TEMPLATES[f"{_id} notice (3)"] = f"Licensed under the {_name}v{_v}."
        TEMPLATES[f"{_id} notice (4)"] = f"Licensed under {_name} version {_v}."
        TEMPLATES[f"{_id} notice (5)"] = f"Under the {_long}, version {_v}."
for _id, *_forms in (
    ("MIT", "Licensed under the MIT License.", "Licensed under MIT."),
    ("ISC", "Licensed under the ISC License."),
    ("BSD", "Licensed under the BSD License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License.", "Licensed under the Simplified BSD License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License.", "Licensed under the New BSD License.", "Licensed under the Modified BSD License."),
    ("Apache-1.1", "Licensed under the Apache License, Version 1.1."),
    ("Apache-2.0", "Licensed under the Apache License 2.0.", "Licensed under Apache 2.0."),
    ("MPL-1.1", "Licensed under the Mozilla Public License, Version 1.1.", "Licensed under the MPL 1.1."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0.", "Licensed under the Mozilla Public License 2.0.", "Licensed under the MPL 2.0."),
    ("EPL-1.0", "Licensed under the Eclipse Public License, Version 1.0.", "Licensed under the Eclipse Public License v1.0."),
    ("EPL-2.0", "Licensed under the Eclipse Public License, Version 2.0.", "Licensed under the Eclipse Public License v2.0."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Zlib", "Licensed under the zlib License."),
    ("Unlicense", "Released under the Unlicense."),
    ("WTFPL", "Licensed under the WTFPL."),
    ("Artistic-2.0", "Licensed under the Artistic License 2.0."),
    ("OFL-1.1", "Licensed under the SIL Open Font License, Version 1.1."),
    ("GFDL-1.3", "Licensed under the GNU Free Documentation License, Version 1.3."),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal.", "Released under CC0 1.0."),
    ("all rights reserved", "Copyright (c) All rights reserved."),
):
    for _form in _forms:
        _k = 1
        while (_key := f"{_id} notice" + (f" ({_k})" if _k > 1 else "")) in TEMPLATES:
            _k += 1
        TEMPLATES[_key] = _form
for _v, _area in (("4.0", "International"), ("3.0", "Unported")):
    for _by, _long in (
        ("BY", "Attribution"),
        ("BY-SA", "Attribution-ShareAlike"),
        ("BY-ND", "Attribution-NoDerivatives" if _v == "4.0" else "Attribution-NoDerivs"),
        ("BY-NC", "Attribution-NonCommercial"),
        ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
        ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives" if _v == "4.0" else "Attribution-NonCommercial-NoDerivs"),
    ):
        for _form in (
            f"Licensed under CC {_by} {_v}.",
            f"This work is licensed under a Creative Commons {_long} {_v} {_area} License.",
            f"Licensed under the Creative Commons {_long} {_v} License.",
        ):
            if _form not in TEMPLATES.values():
                _k = 1
                while (_key := f"CC-{_by}-{_v} notice" + (f" ({_k})" if _k > 1 else "")) in TEMPLATES:
                    _k += 1
                TEMPLATES[_key] = _form
#: Whole licences, a file each.
for _file in sorted(files(__package__).joinpath("license_texts").iterdir(), key=lambda f: f.name):
    if _file.name.endswith(".txt"):
        TEMPLATES[f"{_file.name[:-4]} text"] = _file.read_text(encoding="utf-8")
THRESHOLD = 80
#: Whole licences with close siblings of which no text is here, the words by which these are told, and the name they get.
SIBLINGS = {
    "CC-BY-4.0 text": ((b"noncommercial", b"noderivatives", b"sharealike"), "CC, version unknown"),
    "CC-BY-SA-4.0 text": ((b"noncommercial", b"noderivatives"), "CC, version unknown"),
}
#: Normalising: A-Z in lower case, every other byte that is no letter, digit or part of a longer UTF-8 character is a space.
_NORMAL = np.full(256, 0x20, np.uint8)
_NORMAL[0x0A] = 0x0A
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _NORMAL[_b] = _b
for _b in range(0x41, 0x5B):
    _NORMAL[_b] = _b + 32
_FIRST, _SECOND = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def _bigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(unit, hash)`` of the distinct pairs of neighbouring words; a unit of one word has that word as its only pair."""
    words = Words(data, offsets)
    h = words.hashes()
    same = words.doc[1:] == words.doc[:-1]
    pair, doc = mixed(h[:-1] * _FIRST + h[1:] * _SECOND)[same], words.doc[:-1][same]
    first = np.cumsum(words.count) - words.count
    alone = np.flatnonzero(words.count == 1)
    pair, doc = np.concatenate([pair, mixed(h[first[alone]] * _FIRST)]), np.concatenate([doc, alone])
    order = np.lexsort((pair, doc))
    pair, doc = pair[order], doc[order]
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], pair[new]


@dataclass(frozen=True)
class _Library:
    """The templates' pairs, as an inverted list: ``pairs`` ascending and the template each is in; ``own`` by template.

    The list of a pair ascends by the templates' sizes: ``different`` has each pair once, ``sized`` for every entry the number
    of its pair times ``largest + 1`` plus its template's size, so templates within bounds of size are one slice.
    """

    names: list[str]
    sizes: np.ndarray
    pairs: np.ndarray
    template: np.ndarray
    own: list[np.ndarray]
    different: np.ndarray
    sized: np.ndarray
    largest: int

    @classmethod
    def of(cls, templates: dict[str, str]) -> _Library:
        raw = [t.encode() for t in templates.values()]
        data = _NORMAL[np.frombuffer(b"".join(raw), np.uint8)]
        data = np.where(data == 0x0A, np.uint8(0x20), data)
        template, pairs = _bigrams(data, np.concatenate([[0], np.cumsum([len(t) for t in raw])]))
        sizes = np.bincount(template, minlength=len(raw))
        order = np.lexsort((sizes[template], pairs))
        different, number = np.unique(pairs[order], return_inverse=True)
        largest = int(sizes.max(initial=0))
        sized = number * (largest + 1) + sizes[template[order]]
        own = np.split(pairs, np.cumsum(sizes)[:-1])
        return cls(list(templates), sizes, pairs[order], template[order], own, different, sized, largest)


@lru_cache(2)
def _library(templates: tuple[tuple[str, str], ...]) -> _Library:
    return _Library.of(dict(templates))


def _best(library: _Library, unit: np.ndarray, pair: np.ndarray, n: int, threshold: int):
    """For each unit the template with the largest coefficient of at least ``threshold`` hundredths (-1: none), and that.

    2 |A and B| / (|A| + |B|) is at most 2 min(|A|, |B|) / (|A| + |B|), so sizes alone rule most templates out: of a pair's list
    only templates of a possible size are read, and pairs in common are counted for these alone.
    """
    size = np.bincount(unit, minlength=n)
    number = np.searchsorted(library.different, pair)
    hit = np.append(library.different, np.uint64(0))[number] == pair
    hit &= number < len(library.different)
    unit, number = unit[hit], number[hit]
    least = -(-threshold * size // (200 - threshold))
    most = np.minimum(size * (200 - threshold) // threshold, library.largest)
    least = np.minimum(least, library.largest + 1)
    place = np.searchsorted(library.sized, number * (library.largest + 1) + least[unit], "left")
    many = np.searchsorted(library.sized, number * (library.largest + 1) + most[unit], "right") - place
    hit = many > 0
    unit, place, many = unit[hit], place[hit], many[hit]
    at = np.repeat(place - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    key, common = np.unique(np.repeat(unit, many) * len(library.names) + library.template[at], return_counts=True)
    unit, template = key // len(library.names), key % len(library.names)
    both = size[unit] + library.sizes[template]
    enough = 200 * common >= threshold * both
    unit, template, dice = unit[enough], template[enough], 2 * common[enough] / both[enough]
    order = np.lexsort((template, -dice, unit))
    unit, template, dice = unit[order], template[order], dice[order]
    first = np.ones(len(unit), bool)
    first[1:] = unit[1:] != unit[:-1]
    name, best = np.full(n, -1), np.zeros(n)
    name[unit[first]], best[unit[first]] = template[first], dice[first]
    return name, best


def _windows(library: _Library, k: int, pair: np.ndarray, before: np.ndarray, total: int, threshold: int) -> list[tuple]:
    """Stretches of a text's pairs that reach ``threshold`` with template ``k``: ``(score, dice, first pair, last pair, k)``.

    ``before`` has the last earlier place of each pair, ``total`` is the number of the template's pairs in the text. To take
    in a pair of the template never lowers the coefficient, so the best stretches begin where a run of such pairs does. For
    each beginning the best end is told, for any width that the template's size allows.
    """
    own, size = library.own[k], int(library.sizes[k])
    hit = own[np.minimum(np.searchsorted(own, pair), size - 1)] == pair
    ends = np.append(np.flatnonzero(~hit), len(hit))
    widest, out = size * (200 - threshold) // threshold, []
    for first in np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1]])).tolist():
        width = 2 * widest + 8
        while True:
            new = before[first : first + width] < first
            held, common = np.cumsum(new), np.cumsum(new & hit[first : first + width])
            if held[-1] > widest or common[-1] == total or first + width >= len(pair):
                break
            width *= 2
        dice = 2 * common / (held + size)
        last = int(dice.argmax())
        if 200 * int(common[last]) >= threshold * int(held[last] + size):
            d = float(dice[last])
            # The rest of the run are pairs that stood before in it.
            out.append((int(common[last]) * d * d, d, first, int(ends[np.searchsorted(ends, first + last)]) - 1, k))
    return out


def _spans(library: _Library, data: np.ndarray, offsets: np.ndarray, threshold: int):
    """Templates at any place of the texts: ``(row, template, dice, from, to)``, those of a text apart from one another.

    A text can hold a template only if it has enough of its pairs. Where stretches meet, the one with more pairs in common goes
    first: by their number times the square of the coefficient, so that a notice within a licence gives way to the licence.
    """
    words = Words(data, offsets)
    h = words.hashes()
    at = np.flatnonzero(words.doc[1:] == words.doc[:-1])
    pair, doc = mixed(h[:-1] * _FIRST + h[1:] * _SECOND)[at], words.doc[at]
    place = np.searchsorted(library.pairs, pair, "left")
    known = np.flatnonzero(np.append(library.pairs, np.uint64(0))[place] == pair)
    known = known[np.lexsort((pair[known], doc[known]))]
    new = np.ones(len(known), bool)
    new[1:] = (pair[known[1:]] != pair[known[:-1]]) | (doc[known[1:]] != doc[known[:-1]])
    known = known[new]
    many = np.searchsorted(library.pairs, pair[known], "right") - place[known]
    entry = np.repeat(place[known] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    key, common = np.unique(np.repeat(doc[known], many) * len(library.names) + library.template[entry], return_counts=True)
    enough = 200 * common >= threshold * (common + library.sizes[key % len(library.names)])
    key, common = key[enough], common[enough]
    out, lows = [], np.searchsorted(doc, np.arange(len(offsets)))
    for row, these in _grouped(key // len(library.names)):
        lo, hi = lows[row], lows[row + 1]
        own = pair[lo:hi]
        order = np.argsort(own, kind="stable")
        before = np.full(len(own), -1)
        again = own[order[1:]] == own[order[:-1]]
        before[order[1:][again]] = order[:-1][again]
        found = []
        for x in these:
            found += _windows(library, int(key[x] % len(library.names)), own, before, int(common[x]), threshold)
        taken = []
        for _, dice, a, b, k in sorted(found, key=lambda f: (-f[0], -f[1], f[4], f[2])):
            # Stretches in ``taken`` are apart, so only the neighbours can meet [a, b].
            n = bisect_left(taken, (a, b))
            if (n and taken[n - 1][1] >= a) or (n < len(taken) and taken[n][0] <= b):
                continue
            insort(taken, (a, b))
            start, end = words.starts[at[lo + a]], words.ends[at[lo + b] + 1]
            out.append((row, k, dice, start - offsets[row], end - offsets[row]))
    return out


def _grouped(rows: np.ndarray):
    """Each different value of an ascending array, with its places."""
    ends = np.append(np.flatnonzero(rows[1:] != rows[:-1]) + 1, len(rows)) if len(rows) else []
    lo = 0
    for hi in ends:
        yield int(rows[lo]), range(lo, int(hi))
        lo = int(hi)


def _untold(library: _Library, spans: list[tuple], kinds: list[tuple]) -> list[tuple]:
    """The spans that no unit they meet tells: one with the same licence, or with a coefficient as large.

    Units of one kind are apart and ascend by row and place, so those that meet a span are neighbours, found by binary search.
    """
    licence = [re.sub(r" (notice|text)( \(\d+\))?$", "", name) for name in library.names]
    units = [(list(zip(rows.tolist(), tos.tolist())), froms.tolist(), names.tolist(), dices.tolist()) for rows, names, dices, froms, tos in kinds]

    def told(row: int, k: int, dice: float, lo: int, hi: int) -> bool:
        for ends, froms, names, dices in units:
            n = bisect_right(ends, (row, lo))
            while n < len(ends) and ends[n][0] == row and froms[n] < hi:
                if licence[names[n]] == licence[k] or dices[n] >= dice:
                    return True
                n += 1
        return False

    return [s for s in spans if not told(*s)]


def _named(name: str, siblings: dict, data: np.ndarray, start: int, end: int) -> str:
    """The template's name, or that of its family if the text has a word that only a sibling has."""
    if name not in siblings:
        return name
    words, family = siblings[name]
    text = data[start:end].tobytes()
    return family if any(w in text for w in words) else name


def _scan(templates: tuple[tuple[str, str], ...] | None, threshold: int):
    def run(batches):
        library = _library(tuple(TEMPLATES.items()) if templates is None else templates)
        siblings = SIBLINGS if templates is None else {}
        for batch in batches:
            for lo, hi, raw, offsets in text_slices(batch.column(1)):
                data = _NORMAL[raw]
                # Units: every whole text, every paragraph and every line; a text's size grows the work three times at most.
                lines = np.union1d(np.flatnonzero(data == 0x0A) + 1, offsets)
                ends = np.flatnonzero(raw == 0x0A)
                empty = (raw[ends - 1] == 0x0A) | ((raw[ends - 1] == 0x0D) & (raw[ends - 2] == 0x0A) & (ends > 1))
                blank = ends[empty & (ends > 0)] + 1
                spaced = np.where(data == 0x0A, np.uint8(0x20), data)
                rows, names, dices, froms, tos, whole = [], [], [], [], [], []
                for bounds, is_whole in ((offsets, True), (np.union1d(blank, offsets), False), (lines, False)):
                    bounds = np.asarray(bounds)
                    n = len(bounds) - 1
                    if n < 1:
                        continue
                    unit, pair = _bigrams(spaced, bounds)
                    name, dice = _best(library, unit, pair, n, threshold)
                    found = np.flatnonzero(name >= 0)
                    owner = np.searchsorted(offsets, bounds[found], "right") - 1 if not is_whole else found
                    rows.append(owner), names.append(name[found]), dices.append(dice[found])
                    froms.append(bounds[found] - offsets[owner]), tos.append(bounds[found + 1] - offsets[owner])
                    whole.append(np.full(len(found), is_whole))
                if not rows:
                    continue
                kinds = list(zip(rows, names, dices, froms, tos))
                spans = _untold(library, _spans(library, spaced, offsets, threshold), kinds)
                rows, names, dices, froms, tos, whole = map(np.concatenate, (rows, names, dices, froms, tos, whole))
                if spans:
                    more = [np.array(x) for x in zip(*spans)] + [np.zeros(len(spans), bool)]
                    rows, names, dices, froms, tos, whole = map(np.concatenate, zip((rows, names, dices, froms, tos, whole), more))
                if not len(rows):
                    continue
                # One row per span and text: a line that is a paragraph or the text itself is told once.
                order = np.lexsort((~whole, tos, froms, rows))
                rows, names, dices, froms, tos, whole = (x[order] for x in (rows, names, dices, froms, tos, whole))
                new = np.ones(len(rows), bool)
                new[1:] = (rows[1:] != rows[:-1]) | (froms[1:] != froms[:-1]) | (tos[1:] != tos[:-1])
                keep = np.flatnonzero(new)
                told = [
                    _named(library.names[k], siblings, spaced, offsets[row] + a, offsets[row] + b)
                    for row, k, a, b in zip(rows[keep], names[keep], froms[keep], tos[keep])
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(lo + rows[keep])),
                        pa.array(told, pa.string()),
                        pa.array(dices[keep]),
                        pa.array(froms[keep].astype(np.int64)),
                        pa.array(tos[keep].astype(np.int64)),
                        pa.array(whole[keep]),
                    ],
                    ["id", "license", "dice", "from_byte", "to_byte", "whole_text"],
                )

    return run


def scan_licenses(
    docs: DataFrame, id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, threshold: int = THRESHOLD
) -> DataFrame:
    """Licences that a text states, as a whole, in a paragraph or line of its own or at any other place.

    Texts are normalised (A-Z in lower case; other than letters, digits and non-ASCII characters all is white space) and split
    into units: the whole text, its paragraphs (between empty lines, which may end in CR LF) and its lines. A unit is compared
    with a template by the Dice coefficient of their sets of word bigrams; templates whose size rules out ``threshold`` / 100
    (from 1 to 100) are not compared. Per unit the best template counts, of equal ones the first listed.

    Spans of words anywhere in a text, over line and paragraph ends, are compared in the same way: for each place where a run of
    a template's bigrams begins, the best end. Of spans that meet one is told, and none that meets a unit found with the same
    licence or with as large a coefficient. A template of one word is looked for in units only. Whole Creative Commons licences with
    words of siblings that are no templates (``SIBLINGS``) are named by their family, not by the sibling's name.

    Returns a row for each unit or span found: the id, ``license``, ``dice``, ``from_byte`` and ``to_byte`` (its place in the UTF-8
    text, for units line breaks at the end included) and ``whole_text``. Null, empty and other texts without a licence give none. Ids may
    be null or repeat, other columns are not read, an empty table gives an empty one. Bigrams are compared by 64-bit hashes.
    """
    chosen = None if templates is None else tuple(templates.items())
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, license string, dice double, from_byte long, to_byte long, whole_text boolean"
    return rows.mapInArrow(_scan(chosen, threshold), schema).withColumnRenamed("id", id)
