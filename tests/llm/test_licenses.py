"""Licence texts as they are found: wrapped, in prose, beside others, changed a little; against all wordings by brute force."""

import random
import textwrap

import numpy as np

from runstore.llm import licenses

DOCS = "doc_id long, text string, license string, block int"


def found(texts, **options):
    scanner = licenses.Scanner(licenses.wordings(), options.get("most_changed", 0.3), options.get("share", 0.3))
    return [[x[3] for x in scanner.scan(t)] for t in texts]


def test_samples():
    mit, bsd = licenses.NOTICES["MIT"][0], licenses.NOTICES["BSD-3-Clause"][0]
    wrapped = "\n".join(textwrap.fill(x, 78) + "\n" for x in mit.split("\n"))
    apache = "\n".join("# " + x for x in textwrap.wrap(licenses.NOTICES["Apache-2.0"][0].replace("\n", " "), 76))
    gpl = "\n".join(" * " + x for x in textwrap.wrap(licenses.NOTICES["GPL-3.0"][0], 70))
    texts = {
        "MIT": ["MIT License\n\nCopyright (c) 2020 Jane Doe\n\n" + wrapped, mit.replace("\n", " "), "x\nMIT License\ny", "The MIT License (MIT)", '  "license": "MIT",', "Released under the MIT License.",
                "The parser is small and has no dependencies. Licensed under the MIT License. Patches are welcome.", "Copyright (c) 2020 Jane Doe\nLicensed under the MIT License.", "word " * 4000 + "released under the MIT license " + "word " * 4000, mit.replace("sublicense", "sub-license")],
        "Apache-2.0": [apache, "word. " * 300 + "Licensed under the Apache License, Version 2.0. " + "word. " * 300],
        "BSD-3-Clause": ["\n\n".join(textwrap.fill(x, 70) for x in bsd.split("\n"))],
        "BSD-2-Clause": [licenses.NOTICES["BSD-2-Clause"][0]],
        "GPL-3.0": [gpl, "This work is licensed under the GNU General Public License, version 3."],
        "GPL-2.0": ["// SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0+", "This work is licensed under the GNU General Public License, version 2."],
        "LGPL-3.0": [licenses.NOTICES["LGPL-3.0"][0].replace("library", "program")],
        "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."], "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."], "CC-BY-4.0": ["Licensed under CC BY 4.0."],
    }
    for key, some in texts.items():
        for t, got in zip(some, found(some), strict=True):
            assert set(got) == {key}, (key, t, got)


def test_several_in_one_place():
    assert set(found(["Licensed under the MIT License or the Apache License, Version 2.0."])[0]) == {"MIT", "Apache-2.0"}
    assert set(found(["Licensed under the Apache License, Version 2.0 or the MIT license, at your option."])[0]) == {"MIT", "Apache-2.0"}
    both = licenses.NOTICES["MIT"][0] + "\n\n\n" + licenses.NOTICES["MPL-2.0"][0] + "\n\n" + licenses.NOTICES["Zlib"][0]
    assert sorted(found([both])[0]) == ["MIT", "MPL-2.0", "Zlib"]


def test_what_is_none():
    prose = ["", "no cue", "the license of the driver was lost in the river", "licence " * 20000, "Copyright 2020 Jane Doe. All rights reserved.", "Licensed under the Foo License.", "They licensed the song under their own terms.",
             "We discussed whether the MIT License would suit us.", "The work is as is, and we redistribute it weekly."]
    assert found(prose) == [[] for _ in prose]


def test_every_wording():
    """Each wording is found alone, wrapped, and in prose, under its licence."""
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    for key, t in licenses.wordings().items():
        for w in (*t.citations, *t.notices):
            texts = [w.text, "\n".join(textwrap.wrap(w.text, 60)) if w in t.notices else w.text, prose(300) + ".\n" + w.text + "\n" + prose(300)]
            for got in found(texts):
                assert key in got, (key, w.text)


def slow_fit(a, b):
    """Fewest words missing or added, over all stretches of b."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] if x == y else 10**9))
        row = new
    return min(row)


def test_fitted_against_all_stretches():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(1, 9)), rng.integers(0, 6, rng.integers(0, 20))
        n, s, e = licenses.fitted(a, b)
        assert n == slow_fit(a.tolist(), b.tolist()) and 0 <= s <= e <= len(b)
        x = b[s:e].tolist()
        lcs = np.zeros((len(a) + 1, len(x) + 1), int)
        for i in range(len(a)):
            for j in range(len(x)):
                lcs[i + 1, j + 1] = lcs[i, j] + 1 if a[i] == x[j] else max(lcs[i, j + 1], lcs[i + 1, j])
        assert len(a) + len(x) - 2 * lcs[-1, -1] == n


def test_scanned(spark):
    mit = licenses.NOTICES["MIT"][0]
    texts = ["x\nReleased under the MIT License.\ny", None, "", mit.replace("sublicense", "sub-license"), "licence " * 200_000 + "\n" + mit]
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(texts)] + [(None, texts[0], "", 1), (0, texts[0], "", 1)], DOCS)
    rows = licenses.scanned(docs).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.license) for r in rows) == [(-1, "MIT"), (0, "MIT"), (0, "MIT"), (3, "MIT"), (4, "MIT")]
    by = {r.doc_id: r for r in rows}
    assert by[0].exact and by[0].start == 2 and by[0].n_chars == 30 and not by[3].exact and by[3].n_missing == by[3].n_added == 1
    assert all(r.given_bytes < r.plain_bytes for r in rows)
    assert licenses.scanned(docs.limit(0)).count() == 0
