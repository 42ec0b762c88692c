"""License scans by conditional compression.

Every wording holds a cue, so whatever is like one lies within its length of a cue: a block is the text so far around a cue, and
blocks that meet are one, across lines and paragraphs. A block is scored as a whole against the notices (licence texts and
standard headers), and its sentences and lines that hold a cue, one by one, against the citations. A candidate is compressed by
zstandard alone, and with each licence's wordings as a raw dictionary; a wording whose licence saves at least `share` of the bytes that
it saves on the wording itself is confirmed: the wording is aligned with the stretch of the candidate that it fits best, and the
words that this stretch lacks, or has besides, are counted exactly, wherever it lies and whatever stands around it. A licence
is confirmed with at most `most_changed` of the wording's words; a citation must have the words that tell its licence apart. Of
verdicts that overlap, the one with the smallest share of changed words stays (then the longer wording, the larger saving, the
name); all others are reported, so a candidate may have several licences. Beside a confirmed citation, the exact name of another
licence counts, too ("or the MIT License"); a line that is nothing but a name is a title.

Licences beyond the short ones (Apache, GNU, Mozilla, Creative Commons) are known by their standard headers and citations; `templates`
takes others, texts of any length included.

Whole texts are scanned in place; nothing is shuffled, and a long text costs its own length. Nulls and edges: null and empty
texts have no blocks; equal blocks get equal answers; repeated rows are reported each; a null id is reported as null; other
columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG = 1 << 16
OUT = "doc_id long, block int, start long, n_chars int, license string, plain_bytes int, given_bytes int, saved double, n_missing int, n_added int, exact boolean"
CUE_PARTS = ("licen", "copyright", "©", "(c)", "redistribut", "hereby granted", "as is", "as-is", "public domain", "rights reserved", "spdx", "creative commons", "cc by", "cc-by", "cc0", "gpl")
CUE = re.compile(r"licen[sc]e|copyright|©|\(c\)|redistribut|hereby granted|\bas[ -]is\b|public domain|rights reserved|spdx|creative commons|\bcc[ -]by\b|\bcc0\b|\b[al]?gpl\b", re.I)
SENTENCE = re.compile(r"(?<=[.!?;])\s+|\n")
WORD = re.compile(r"\w+(?:[.\-+]\w+)*\+?")

#: Names under which licenses are cited, by SPDX identifier. Fixed values.
NAMES = {
    "MIT": ("MIT License", "MIT license"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "GPL-2.0": ("GNU General Public License, version 2", "GPL version 2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GPL version 3"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPL version 3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPL version 3"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"),
    "ISC": ("ISC License",),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal Public Domain Dedication"),
    "Unlicense": ("Unlicense",),
    "Zlib": ("zlib License",),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
}
#: Licence texts and standard headers. Fixed values.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GNU = """This {what} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.
This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.
You should have received a copy of the GNU {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"""
_CC0 = """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."""
_GNU_KINDS = {
    "GPL-2.0": ("program", ";", "General Public License", "2"),
    "GPL-3.0": ("program", ":", "General Public License", "3"),
    "LGPL-3.0": ("library", ":", "Lesser General Public License", "3"),
    "AGPL-3.0": ("program", ":", "Affero General Public License", "3"),
}
NOTICES = {
    "MIT": (_MIT, _MIT.split("\n")[0]),
    "Apache-2.0": (_APACHE,),
    "BSD-2-Clause": ("\n".join([_BSD, _BSD_END]), _BSD),
    "BSD-3-Clause": ("\n".join([_BSD, _BSD_THIRD, _BSD_END]), "\n".join([_BSD, _BSD_THIRD])),
    "ISC": (_ISC, _ISC.split("\n")[0]),
    "MPL-2.0": (_MPL,),
    "Unlicense": (_UNLICENSE, _UNLICENSE.split("\n")[0]),
    "Zlib": (_ZLIB,),
    "BSL-1.0": (_BOOST,),
    "CC0-1.0": (_CC0,),
} | {key: tuple(_GNU.format(what=w, colon=colon, name=name, version=version) for w in ("program", *({what} - {"program"}))) for key, (what, colon, name, version) in _GNU_KINDS.items()}
#: Words of a notice that tell its licence apart. Fixed values.
TOLD = {"GPL-2.0": {"2"}, "GPL-3.0": {"3"}, "LGPL-3.0": {"3", "lesser"}, "AGPL-3.0": {"3", "affero"}, "BSD-3-Clause": {"endorse", "promote"}}
#: Ways to cite a license by its name, and by its identifier. Fixed values.
WAYS = ("Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "This work is licensed under the {}.", "This work is licensed under a {}.", "Distributed under the terms of the {}.", "Available under the {}.", "License: {}.")
ID_WAYS = ("SPDX-License-Identifier: {}", "License: {}", "Licensed under {}", '"license": "{}"', 'license = "{}"', "license: {}")
#: Words of names that many licences have, which don't tell them apart. Fixed values.
COMMON = {"license", "licence", "version", "the", "international", "public", "general", "gnu", "new", "universal", "domain", "dedication", "creative", "commons", "software", "a", "v", "attribution"}
GNU_ENDS = ("", "-only", "-or-later", "+")


@dataclass(frozen=True)
class Wording:
    text: str
    words: tuple[str, ...]
    must: frozenset[str]  # words that can't be changed

    @staticmethod
    def of(text: str, must: frozenset[str] = frozenset()) -> Wording:
        return Wording(text, tuple(split(text)), must)


@dataclass(frozen=True)
class Template:
    citations: tuple[Wording, ...]
    notices: tuple[Wording, ...]
    names: tuple[tuple[str, ...], ...] = ()


def split(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def wordings() -> dict[str, Template]:
    out = {}
    for key, names in NAMES.items():
        ids = [key + end for end in (GNU_ENDS if "GPL" in key else ("",))]
        told = lambda n: frozenset(set(split(n)) - COMMON)
        cited = [Wording.of(w.format(n), told(n)) for n in names for w in WAYS] + [Wording.of(w.format(i), told(i)) for i in ids for w in ID_WAYS]
        out[key] = Template(tuple(cited), tuple(Wording.of(n, frozenset(TOLD.get(key, ()))) for n in NOTICES.get(key, ())), tuple(tuple(split(n)) for n in (*names, *ids)))
    return out


def fitted(wording: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Fewest words missing or added where the wording fits words best, and the first and last (exclusive) of them (the first such place)."""

    def ends(w: np.ndarray, b: np.ndarray) -> np.ndarray:
        ramp = np.arange(len(b) + 1)
        row = np.zeros(len(b) + 1, np.int64)
        for x in w:
            new = row + 1
            np.minimum(new[1:], np.where(b == x, row[:-1], new[1:]), out=new[1:])
            row = np.minimum.accumulate(new - ramp) + ramp
        return row

    row = ends(wording, words)
    end = int(row.argmin())
    back = ends(wording[::-1], words[:end][::-1])
    return int(row[end]), end - int(np.flatnonzero(back == back.min())[0]), end


class Scanner:
    def __init__(self, templates: dict[str, Template], most_changed: float, share: float) -> None:
        self.most_changed, self.share, self.templates = most_changed, share, templates
        options = zstandard.ZstdCompressionParameters.from_level(9, write_content_size=0, write_checksum=0, write_dict_id=0)
        self.plain = zstandard.ZstdCompressor(compression_params=options)
        self.given, self.wordings = [], []
        self.code: dict[str, int] = {}
        for part in ("citations", "notices"):
            some = {k: getattr(t, part) for k, t in sorted(templates.items()) if getattr(t, part)}
            self.given.append({k: zstandard.ZstdCompressor(compression_params=options, dict_data=zstandard.ZstdCompressionDict("\n".join(w.text for w in ws).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for k, ws in some.items()})
            self.wordings.append({k: [(w, Counter(w.words), np.array([self.code.setdefault(x, len(self.code)) for x in w.words])) for w in ws] for k, ws in some.items()})
        self.worth = [{k: [self._saved(w.text, k, wide) for w, _, _ in ws] for k, ws in part.items()} for wide, part in enumerate(self.wordings)]
        self.reach = 2 * max((len(w.text) for t in templates.values() for w in (*t.citations, *t.notices)), default=0)
        self.names = {n: k for k, t in sorted(templates.items(), reverse=True) for n in t.names}
        self.verdicts = lru_cache(1 << 14)(self._verdicts)

    def _saved(self, text: str, key: str, wide: int) -> int:
        data = text.encode(errors="replace")
        return len(self.plain.compress(data)) - len(self.given[wide][key].compress(data))

    def _verdicts(self, text: str, wide: bool) -> list[tuple]:
        """begin, end (characters), license, plain, given, missing, added of each licence confirmed in the candidate."""
        data = text.encode(errors="replace")
        plain = len(self.plain.compress(data))
        sizes = {k: len(c.compress(data)) for k, c in self.given[wide].items()}
        at = [(m.start(), m.end()) for m in WORD.finditer(text)]
        word = split(text)
        count, code = Counter(word), np.array([self.code.get(w, -1) for w in word])
        found = []
        for key in sorted(sizes, key=lambda k: (sizes[k], k)):
            for (w, has, codes), worth in zip(self.wordings[wide][key], self.worth[wide][key], strict=True):
                most = int(self.most_changed * len(w.words))
                if plain - sizes[key] < self.share * worth or any(x not in count for x in w.must) or sum((has - count).values()) > most:
                    continue
                n, s, e = fitted(codes, code)
                if n <= most and w.must <= set(word[s:e]):
                    same = (len(w.words) + e - s - n) // 2
                    found.append((n / len(w.words), -len(w.words), sizes[key], key, s, e, len(w.words) - same, e - s - same))
        out: list[tuple] = []
        taken: list[tuple[int, int]] = []
        for _, _, size, key, s, e, missing, added in sorted(found):
            if all(e <= a or b <= s for a, b in taken):
                taken.append((s, e))
                out.append((at[s][0], at[e - 1][1], key, plain, size, missing, added))
        if not wide:
            out += [(at[s][0], at[e - 1][1], key, plain, sizes[key], 0, 0) for key, s, e in self.named(word, taken)]
        return sorted(out)

    def named(self, word: list[str], taken: list[tuple[int, int]]) -> Iterator[tuple[str, int, int]]:
        """Names of licences beside a confirmed one, or alone on their line; the longest name first."""
        alone = word[1:] if word[:1] == ["the"] else word
        for name in sorted(self.names, key=lambda n: (-len(n), n)):
            key, n = self.names[name], len(name)
            for s in range(len(word) - n + 1):
                if tuple(word[s : s + n]) == name and all(s + n <= a or b <= s for a, b in taken) and (taken or (len(name) > 1 and tuple(alone) == name)):
                    taken.append((s, s + n))
                    yield key, s, s + n

    def scan(self, text: str) -> Iterator[tuple]:
        for n, (begin, end, parts) in enumerate(blocks(text, self.reach)):
            rows: list[tuple] = []
            for a in range(begin, max(end - self.reach, begin + 1), LONG):  # so that the dictionary stays in the compressor's window; the parts overlap
                for s, e, *rest in self.verdicts(text[a : min(end, a + LONG + self.reach)], True):
                    if all(a + e <= x[0] or x[1] <= a + s for x in rows):
                        rows.append((a + s, a + e, True, *rest))
            for a, b in parts:
                for s, e, *rest in self.verdicts(text[a:b], False):
                    if all(a + e <= x[0] or x[1] <= a + s for x in rows if x[2]):  # a header's own citation is a part of it
                        rows.append((a + s, a + e, False, *rest))
            for s, e, _, key, plain, given, missing, added in sorted(rows):
                yield n, s, e - s, key, plain, given, 1 - given / plain, missing, added, missing == added == 0


def blocks(text: str, reach: int) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Begin and end of each block, and of its sentences and lines that hold a cue."""
    low = text.lower()
    if not any(c in low for c in CUE_PARTS):
        return
    merged: list[tuple[int, int, list[tuple[int, int]]]] = []
    for m in CUE.finditer(text):
        begin, end = max(0, m.start() - reach), min(len(text), m.end() + reach)
        if merged and begin <= merged[-1][1]:
            merged[-1][2].append(m.span())
            merged[-1] = (merged[-1][0], end, merged[-1][2])
        else:
            merged.append((begin, end, [m.span()]))
    for begin, end, cues in merged:
        while begin > 0 and not text[begin - 1].isspace():
            begin -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        cut = [begin, *(x for m in SENTENCE.finditer(text, begin, end) for x in m.span()), end]
        parts, k = [], 0
        for a, b in zip(cut[::2], cut[1::2], strict=True):
            while k < len(cues) and cues[k][1] <= a:
                k += 1
            if k < len(cues) and cues[k][0] < b:
                parts.append((a, b))
        yield begin, end, parts


def scanned(docs: DataFrame, *, templates: dict[str, Template] | None = None, most_changed: float = 0.3, share: float = 0.3) -> DataFrame:
    """One row for each place where a license is confirmed: doc_id, block, start and n_chars of the wording, license, bytes of its candidate alone and given the license, changed words."""
    templates = templates or wordings()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, most_changed, share)
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            rows = [(ids[i].as_py(), *x) for i in range(b.num_rows) for x in scanner.scan(texts[i].as_py() or "")]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.bool_()]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in OUT.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, OUT)
