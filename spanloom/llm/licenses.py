"""License scans by conditional compression.

The surroundings of words that license notices have are candidate blocks. A block is compressed alone and
with each template as zstandard raw dictionary; the templates are ranked by the bytes that the dictionary
saves. In that order their wording is held against the block: a template is confirmed where the block has
all its words, one after another, with nothing between but punctuation, line breaks, marks of comments and
what its placeholders stand for. A notice that is denied in its sentence, by a word such as "not" in front
of it, is none, and a short one has to end where a clause may end.

SPDX tags and fields that name a license by its identifier are exact statements and need no ranking.
"""

from __future__ import annotations

import bisect
import functools
import re
from dataclasses import dataclass
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Wordings of public licenses and of the notices that name them. <...> stands for up to PLACE words, <#> for the number of a clause or none.
MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of <the> software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <parts> shall be included in all copies or substantial portions of the Software.'
MIT_END = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <the holders> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND <the author> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <the author> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
BSD_2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <#> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <#> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_3 = BSD_2 + " <#> Neither the name of <the holder> nor the names of <its contributors> may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_END = 'THIS SOFTWARE IS PROVIDED BY <the holders> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <the holder> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: <#> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. <#> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. <#> This notice may not be removed or altered from any source distribution."
APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at <address>'
APACHE_END = ' Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
UNLICENSE = "This is free and unencumbered software released into the public domain."
UNLICENSE_END = " Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
MPL_END = " If a copy of the MPL was not distributed with this file, You can obtain one at <address>"


def gnu(name: str, version: str) -> str:
    return f"{'This library' if name.startswith('GNU Lesser') else 'This program'} is free software; you can redistribute it and/or modify it under the terms of the {name} General Public License as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."


#: (license, wording)
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", MIT),
    ("MIT", f"{MIT} {MIT_END}"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Distributed under the MIT License"),
    ("ISC", ISC),
    ("ISC", f"{ISC} {ISC_END}"),
    ("ISC", "Licensed under the ISC License"),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + ISC_END),
    ("BSD-2-Clause", BSD_2),
    ("BSD-2-Clause", f"{BSD_2} {BSD_END}"),
    ("BSD-2-Clause", "Licensed under the 2-Clause BSD License"),
    ("BSD-3-Clause", BSD_3),
    ("BSD-3-Clause", f"{BSD_3} {BSD_END}"),
    ("BSD-3-Clause", "Licensed under the 3-Clause BSD License"),
    ("Zlib", ZLIB),
    ("Apache-2.0", APACHE),
    ("Apache-2.0", APACHE + APACHE_END),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache 2.0 License"),
    ("MPL-2.0", MPL),
    ("MPL-2.0", MPL + MPL_END),
    ("Unlicense", UNLICENSE),
    ("Unlicense", UNLICENSE + UNLICENSE_END),
    ("CC0-1.0", "To the extent possible under law, <the author> has waived all copyright and related or neighboring rights to <this work>"),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal"),
    ("GPL-2.0-or-later", gnu("GNU", "2")),
    ("GPL-3.0-or-later", gnu("GNU", "3")),
    ("LGPL-2.1-or-later", gnu("GNU Lesser", "2.1")),
    ("LGPL-3.0-or-later", gnu("GNU Lesser", "3")),
    ("AGPL-3.0-or-later", gnu("GNU Affero", "3")),
    *((f"{short}-{version}.0", f"Licensed under the {name} General Public License, version {version}") for short, name, version in (("GPL", "GNU", "2"), ("GPL", "GNU", "3"), ("LGPL", "GNU Lesser", "3"), ("AGPL", "GNU Affero", "3"))),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1"),
    *((f"CC-{parts}-4.0", f"Licensed under CC {parts} 4.0") for parts in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")),
    *((f"CC-{parts}-4.0", f"Licensed under a Creative Commons {name} 4.0 International License") for parts, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))),
    ("all-rights-reserved", "All rights reserved"),
]
#: Identifiers that tags and fields may name.
SPDX = sorted({n for n, _ in TEMPLATES if n != "all-rights-reserved"} | {"GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "AGPL-3.0-only", "EPL-2.0", "BSL-1.0", "WTFPL", "Artistic-2.0", "EUPL-1.2", "PostgreSQL", "Python-2.0", "OFL-1.1"})
#: Words that deny what follows them in a sentence.
DENIAL = r"(?i)\b(?:not|never|no|nor|neither|without|cannot|unless|hardly)\b|n['’]t\b"
#: What may stand behind a short notice: the end of a line or clause, or a word that goes on after one.
CLAUSE_END = r"(?i)[ \t]*(?:$|[\n\r.,;:!?)\]\"'*/#|<(–—-]|(?:see|and|or|as|by|with|which|for|to)\b)"
#: Words of which a candidate has one; a line break, and a mark of comments after it, may stand in them.
ANCHOR = r"(?i)licen[cs]|copyright|rights reserved|public domain|creative commons|hereby granted|redistribut|unencumbered|mozilla public|without any express|waived all|\bcc0\b".replace(" ", r"\s+(?:[#*/;%!-]+\s+)?")
#: Level of the compressor, bytes that a template saves at least, words of a placeholder, and words from which on a template is a long one.
LEVEL, LEAST_SAVED, PLACE, LONG_TEMPLATE = 6, 4, 12, 20

_ANCHOR, _SENTENCE = re.compile(ANCHOR), re.compile(r"[^\n]+?(?:(?<!\bv)[.!?](?=\s)|$|(?=\n))", re.M)
_TOKEN = re.compile(r"\d+(?:\.\d+)+|[^\W_]+")
_PLACE = re.compile(r"<[^>]*>")
_BREAK = re.compile(r"[ \t\r]*\n[ \t\r\n#*/;%!-]*")
_STOP, _DENIAL, _CLAUSE_END = re.compile(r"[.!?](?=\s)|\n[ \t\r#*/;%!-]*\n"), re.compile(DENIAL), re.compile(CLAUSE_END)
_TAG = re.compile(r"SPDX-License-Identifier:[ \t]*([^\n\r]*?)[ \t]*(?:\*/|-->|$)", re.M)
_FIELD = re.compile(r"^[ \t#*/;%!\"'-]*licen[cs]e[\"']?[ \t]*[:=][ \t]*[\"']?([A-Za-z0-9.+-]+)[\"']?[ \t]*,?[ \t\r]*$", re.M | re.I)
#: Words that a match can reach from a word that it has.
REACH = max(len(_TOKEN.findall(w)) + PLACE * len(_PLACE.findall(w)) for _, w in TEMPLATES) + 1


@dataclass(frozen=True)
class Finding:
    start: int
    end: int
    license: str
    saved: int
    share: float  #: of the bytes that the block takes alone
    missing: tuple[str, ...]
    extra: tuple[str, ...]
    confirmed: bool


def tokens(text: str) -> list[str]:
    return [t.lower() for t in _TOKEN.findall(text)]


def pattern(wording: str) -> re.Pattern:
    """Matches all words of a template in a row, and what its placeholders stand for; "licence" counts as "license"."""
    word = lambda t: re.sub("licen[cs]e", "licen[cs]e", re.escape(t))
    parts, gap = [], r"[\W_]+"
    wording = re.sub(r"\s*<[^>]*>\s*$", "", wording)  # what stands last may be anything
    kinds = _PLACE.findall(wording)
    for i, piece in enumerate(_PLACE.split(wording)):
        if i:
            parts.append(r"(?:[0-9a-z]{1,2}[\W_]+)?" if kinds[i - 1] == "<#>" else rf"(?:[^\s]+\s+(?:[#*/;%!-]+\s+)?){{0,{PLACE}}}?")
        found = tokens(piece)
        if found:
            parts.append(gap.join(map(word, found)) + (gap if i < len(kinds) else ""))
    return re.compile(r"(?<![^\W_])" + "".join(parts) + r"(?![^\W_]|\.\d)", re.I)


@functools.lru_cache(maxsize=1)
def patterns() -> list[re.Pattern]:
    return [pattern(w) for _, w in TEMPLATES]


@functools.lru_cache(maxsize=1)
def compressors() -> list:
    import zstandard

    out = []
    for _, text in TEMPLATES:
        book = zstandard.ZstdCompressionDict(_PLACE.sub("", text).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        book.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(dict_data=book, write_content_size=False, write_dict_id=False))
    return [zstandard.ZstdCompressor(level=LEVEL, write_content_size=False), *out]


def savings(block: str) -> tuple[int, list[int]]:
    """The bytes that a block takes alone, and those that each template saves."""
    raw, (plain, *with_template) = _BREAK.sub(" ", block).encode("utf-8", "surrogatepass"), compressors()
    alone = len(plain.compress(raw))
    return alone, [alone - len(c.compress(raw)) for c in with_template]


def blocks(text: str, low: int = 0, high: int | None = None) -> list[tuple[int, int]]:
    """Spans of the sentences between ``low`` and ``high`` that have an anchor; those that touch but for white space are one."""
    out: list[tuple[int, int]] = []
    for line in re.compile(r"[^\n]+").finditer(text, low, len(text) if high is None else high):
        if not _ANCHOR.search(line.group()):
            continue
        for m in _SENTENCE.finditer(line.group()):
            a, b = line.start() + m.start(), line.start() + m.end()
            a += len(text[a:b]) - len(text[a:b].lstrip())
            if a < b and _ANCHOR.search(text[a:b]):
                if out and not text[out[-1][1] : a].strip():
                    out[-1] = (out[-1][0], b)
                else:
                    out.append((a, b))
    return out


def differences(block: list[str], template: list[str]) -> tuple[list[str], list[str]]:
    missing, extra = [], []
    for kind, a, b, c, d in SequenceMatcher(None, template, block, autojunk=False).get_opcodes():
        if kind != "equal":
            missing += template[a:b]
            extra += block[c:d]
    return missing, extra


def identify(block: str) -> tuple[str, int, float, list[str], list[str]]:
    """The best template's license for a block that no wording is confirmed in, its saved bytes and their share, and both differences."""
    alone, saved = savings(block)
    i = max(range(len(saved)), key=lambda k: (saved[k], -k))
    words = tokens(block)
    if saved[i] < LEAST_SAVED:
        return "unknown", saved[i], saved[i] / alone, [], words
    return TEMPLATES[i][0], saved[i], saved[i] / alone, *differences(words, tokens(_PLACE.sub("", TEMPLATES[i][1])))


def expression(text: str) -> str | None:
    """An SPDX expression in its usual spelling, if all its identifiers are known."""
    known = {x.lower(): x for x in SPDX}
    out = []
    for part in re.findall(r"[()]|[^\s()]+", text):
        if part in "()" or part.upper() in ("AND", "OR"):
            out.append(part.upper())
        elif part.lower() in known:
            out.append(known[part.lower()])
        else:
            return None
    return " ".join(out).replace("( ", "(").replace(" )", ")") if any(x in SPDX for x in out) else None


def tags(text: str) -> list[Finding]:
    """Tags and fields that name licenses by identifiers."""
    out = []
    for p in (_TAG, _FIELD):
        for m in p.finditer(text):
            name = expression(m.group(1))
            if name:
                out.append(Finding(m.start(), m.end(), name, 0, 0.0, (), (), True))
    return out


def stated(text: str, start: int, end: int, short: bool) -> bool:
    """Whether a match is a statement: not denied in front, and if it is short, the end of a clause."""
    low = max(0, start - 4096)
    stops = [m.end() for m in _STOP.finditer(text, low, start)]
    if _DENIAL.search(text, stops[-1] if stops else low, start):
        return False
    return not short or bool(_CLAUSE_END.match(text, end))


def wordings(text: str, low: int, high: int) -> list[Finding]:
    """Confirmed notices between ``low`` and ``high``, those of better ranked templates first; none overlap."""
    alone, saved = savings(text[low:high])
    for a, b in blocks(text, low, high):
        saved = [max(x, y) for x, y in zip(saved, savings(text[a:b])[1], strict=True)]
    out: list[Finding] = []
    for i in sorted(range(len(saved)), key=lambda k: (-saved[k], k)):
        if saved[i] < LEAST_SAVED:
            break
        template = tokens(_PLACE.sub("", TEMPLATES[i][1]))
        short = len(template) < LONG_TEMPLATE and not TEMPLATES[i][1].endswith(">")
        for m in patterns()[i].finditer(text, low, high):
            if all(m.end() <= f.start or f.end <= m.start() for f in out) and stated(text, m.start(), m.end(), short):
                part = text[m.start() : m.end()]
                own, each = savings(part)
                missing, extra = differences(tokens(part), template)
                out.append(Finding(m.start(), m.end(), TEMPLATES[i][0], each[i], each[i] / own, tuple(missing), tuple(extra), True))
    return out


def notices(text: str) -> list[Finding]:
    """Confirmed notices of a text, in order: long surroundings of anchors go in overlapping pieces, each for the notices that begin in its first two thirds."""
    words = list(_TOKEN.finditer(text))
    starts = [w.start() for w in words]
    spans: list[list[int]] = []
    for m in _ANCHOR.finditer(text):
        i = bisect.bisect_right(starts, m.start())
        low, high = max(0, i - REACH), min(len(words), i + REACH)
        if spans and low <= spans[-1][1]:
            spans[-1][1] = high
        else:
            spans.append([low, high])
    out: list[Finding] = []
    for first, last in spans:
        at = first
        while at < last:
            end = min(at + 3 * REACH, last)
            after = starts[at + 2 * REACH] if at + 2 * REACH < last else len(text)
            done = out[-1].end if out else 0
            found = [f for f in wordings(text, max(starts[at], done), words[end - 1].end() + 1) if f.start < after]
            out += sorted(found, key=lambda f: f.start)
            at += 2 * REACH
    return out


def findings(text: str) -> list[Finding]:
    """Confirmed notices, and the candidate sentences that none of them covers, with the best template's license."""
    if not _ANCHOR.search(text):
        return []
    sure: list[Finding] = []
    for f in sorted(tags(text) + notices(text), key=lambda f: (f.start, -f.end)):
        if not sure or f.start >= sure[-1].end:
            sure.append(f)
    ends, out, k = [f.end for f in sure], list(sure), 0
    for a, b in blocks(text):
        k = bisect.bisect_right(ends, a)
        at = a
        while at < b:
            here = sure[k] if k < len(sure) and sure[k].start < b else None
            stop = max(at, here.start) if here else b
            for x, y in blocks(text, at, stop):
                name, saved, share, missing, extra = identify(text[x:y])
                out.append(Finding(x, y, name, saved, share, tuple(missing), tuple(extra), False))
            at, k = (here.end, k + 1) if here else (b, k)
    return sorted(out, key=lambda f: f.start)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each confirmed notice and each other candidate block of (id, text): its span in characters, its text, the best template's license and the differences of wording.

    Texts that are null, empty or without anchor words have no rows; equal rows each give theirs; equal ranks
    go by the order of the templates; other columns are ignored. Texts of any length are read to their end.
    """
    plain = common.pick(docs, id_col, text_col).toDF("id_", "text").where(F.col("text").rlike(ANCHOR))

    def step(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("id_", "start", "end", "block", "license", "saved_bytes", "saved_share", "missing", "extra", "confirmed")}
        for key, text in zip(batch.column("id_").to_pylist(), common.texts_of(batch), strict=True):
            for f in findings(text):
                row = (key, f.start, f.end, text[f.start : f.end], f.license, f.saved, f.share, " ".join(f.missing), " ".join(f.extra), f.confirmed)
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
        return out

    return common.map_slices(plain, step, f"id_ {plain.schema['id_'].dataType.simpleString()}, start int, end int, block string, license string, saved_bytes int, saved_share double, missing string, extra string, confirmed boolean").withColumnRenamed("id_", id_col)
