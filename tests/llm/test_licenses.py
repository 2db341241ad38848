import random
import re

import pytest

from spanloom.llm import licenses
from spanloom.llm.licenses import TEMPLATES, tokens


def confirmed(text):
    return [f.license for f in licenses.findings(text) if f.confirmed]


def filled(wording, rng):
    """A wording with something in its placeholders."""
    return re.sub("<[^>]*>", lambda m: str(rng.randrange(1, 5)) + "." if m.group() == "<#>" else rng.choice(["", "Some Body and others", "2019"]), wording)


def test_every_template_is_its_own():
    rng = random.Random(0)
    for name, wording in TEMPLATES:
        for _ in range(4):
            found = confirmed("Before it.\n" + filled(wording, rng) + ".\nAfter it.")
            assert found == [name], (name, wording, found)


def words_in_a_row(text):
    """All templates without placeholders whose words stand in a row in ``text`` and end a clause, the longest first."""
    at = list(re.finditer(r"\d+(?:\.\d+)+|[^\W_]+", text))
    have, out = [m.group().lower() for m in at], []
    for name, wording in TEMPLATES:
        t = tokens(wording)
        for i in range(len(have) - len(t) + 1):
            if "<" not in wording and have[i : i + len(t)] == t:
                after = have[i + len(t)] if i + len(t) < len(have) else ""
                if len(t) >= 20 or not after or text[at[i + len(t) - 1].end()] in ".,;:)" or after in "see and or as by with which for to".split():
                    out.append((len(t), name))
    return [n for _, n in sorted(out, reverse=True)]


def test_against_brute_force():
    """Sentences with words taken out, put in and exchanged: confirmed only if all words of a template stand in a row."""
    rng = random.Random(1)
    plain = [(n, w) for n, w in TEMPLATES if "<" not in w]
    hits = 0
    for _ in range(600):
        words = rng.choice(plain)[1].split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            k = rng.randrange(len(words))
            words[k : k + 1] = rng.choice([[], [words[k], "zebra"], ["zebra"], [words[k], words[k]]])
        text = "Here it begins. " + " ".join(words) + "."
        expected = words_in_a_row(text)
        got = confirmed(text)
        assert got[:1] == expected[:1], (text, got, expected)
        hits += bool(got)
    assert 150 < hits < 450


@pytest.mark.parametrize(
    "text",
    [
        "The driver lost his licence in the rain.",
        "Licensed under CC BY-NQ 4.0.",
        "Licensed under the Zebra License, Version 7.",
        "A copyright question of no interest.",
        "all right reserved seats",
        "This is not released under the MIT License.",
        "It isn't licensed under the MIT License.",
        "All rights reserved seats were taken.",
        "The GNU General Public License, version 2, was written by lawyers in 1991.",
        "We have never been licensed under the Apache 2.0 licence by anyone.",
        "Licensed under the GNU Lesser General Public License, version 2.",
        "Licensed under CC BY 4.0.1",
        "License: see below",
        "SPDX-License-Identifier: Nonesuch-1.0",
    ],
)
def test_others_are_not_confirmed(text):
    assert confirmed(text) == []


def test_identifiers():
    assert confirmed("License: MIT") == ["MIT"]
    assert confirmed("# SPDX-License-Identifier: Apache-2.0\nimport os") == ["Apache-2.0"]
    assert confirmed("/* SPDX-License-Identifier: (mit OR GPL-2.0-only) */") == ["(MIT OR GPL-2.0-only)"]
    assert confirmed('  "license": "BSD-3-Clause",') == ["BSD-3-Clause"]


def test_spans():
    text = "First line here. Released under the MIT License. More\nAll rights reserved.\nLicensed under CC BY-NC 4.0.\nend of the license"
    found = licenses.findings(text)
    assert [(text[f.start : f.end], f.license, f.confirmed) for f in found] == [("Released under the MIT License", "MIT", True), ("All rights reserved", "all-rights-reserved", True), ("Licensed under CC BY-NC 4.0", "CC-BY-NC-4.0", True), ("end of the license", found[3].license, False)]


def test_differences_name_what_departs():
    (f,) = licenses.findings("Released under the purple MIT License.")
    assert (f.license, f.confirmed, f.missing, f.extra) == ("MIT", False, (), ("purple",))


def test_frames(spark):
    long = "w " * 50000 + "\nReleased under the MIT License." + " v" * 50000
    rows = [(1, "x\nAll rights reserved.\ny", 1), (1, "x\nAll rights reserved.\ny", 1), (2, None, 1), (3, "", 1), (None, "Released under the MIT License.", 1), (4, long, 1)]
    got = sorted(((r.doc_id, r.license, r.confirmed) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, block int")).collect()), key=str)
    assert got == sorted([(1, "all-rights-reserved", True), (1, "all-rights-reserved", True), (None, "MIT", True), (4, "MIT", True)], key=str)
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


MIT = """MIT License

Copyright (c) 2019 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
BSD_2 = """Copyright (c) 2019, Some Body
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_3 = (
    BSD_2
    + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
)
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
ISC = """Copyright 2019 Some Body

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
GPL = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""


def test_wrapped_notices():
    for name, text in (("MIT", MIT), ("BSD-2-Clause", BSD_2 + BSD_END), ("BSD-3-Clause", BSD_3 + BSD_END), ("ISC", ISC), ("GPL-2.0-or-later", GPL), ("GPL-3.0-or-later", GPL.replace("version 2", "version 3"))):
        for mark in ("", "# ", " * ", "// "):
            notice = "".join(mark + line for line in text.splitlines(True))
            for whole in (notice, "Some prose stands here.\n\n" + notice + "\n\nint main() { return 0; }\n"):
                found = [f for f in licenses.findings(whole) if f.confirmed]
                assert {f.license for f in found} - {"all-rights-reserved"} == {name}, (name, mark, found)
                assert max(f.end - f.start for f in found) > 130  # more than any line


def test_half_a_license_is_not_confirmed():
    lines = MIT.splitlines(True)
    assert confirmed("".join(lines[:8])) == [] and confirmed("".join(lines[:6] + lines[7:])) == []


def test_wrapped_short_notices():
    text = "It is\nlong ago. Released under the\nMIT License. And more of\nthe same."
    (found,) = licenses.findings(text)
    assert (found.license, found.confirmed, text[found.start : found.end]) == ("MIT", True, "Released under the\nMIT License")
    assert confirmed("// All rights\n// reserved.") == ["all-rights-reserved"]
    assert confirmed("The license was\nseen by all the driver's\nrights and it reserved\nthe seats of the public\ndomain") == []


def test_many_wrapped_notices():
    text = (MIT + "\nint f();\n\n" + ISC + "\nint g();\n\n") * 20
    assert confirmed(text) == ["MIT", "ISC"] * 20
