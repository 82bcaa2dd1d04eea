import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from helixframe.llm import licenses as L


def scan(spark, rows):
    df = spark.createDataFrame([(i, t, p, "x") for i, t, p in rows], "doc_id long, text string, where string, score string")
    return {r.doc_id: r for r in L.scan_licenses(df, "doc_id", "text", F.col("where")).collect()}


def test_every_notice_is_told(spark):
    rows = [(i, f"Some words here.\n// {t}\nmore text", f"d{i}/f.txt") for i, t in enumerate(L.TEMPLATES.values())]
    got = scan(spark, rows)
    assert [got[i].license for i in range(len(rows))] == list(L.TEMPLATES)
    assert all(r.score > 0.9 for r in got.values())


def test_inheritance(spark):
    mit, gpl = L.TEMPLATES["MIT"], L.TEMPLATES["GPL-3.0"]
    rows = [(1, mit, "a/LICENSE"), (2, gpl, "a/b/LICENSE"), (3, "code", "a/b/c/x.py"), (4, "code", "a/y.py"), (5, "code", "z.py"), (6, None, "a/b/n.py"), (7, "", None), (8, f"long\n{gpl}\n" + "line\n" * 30, "a/own.py"), (9, "the licence of this is a matter of debate among many people", "a/q.py"), (4, "code", "a/y.py"), (10, mit, "a/B2")]
    got = scan(spark, rows)
    assert {i: (r.license, r.inherited, r.inherited_from) for i, r in got.items()} == {
        1: ("MIT", None, None), 2: ("GPL-3.0", None, None), 3: (None, "GPL-3.0", "a/b"), 4: (None, "MIT", "a"), 5: (None, None, None), 6: (None, "GPL-3.0", "a/b"), 7: (None, None, None), 8: ("GPL-3.0", None, None), 9: (None, "MIT", "a"), 10: ("MIT", None, None),
    }


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, where string")
    assert L.scan_licenses(df, "doc_id", "text", F.col("where")).count() == 0


#: Wordings beside the notices; not held out: the weight of names was chosen after the
#: scores of most of them had been seen.
WORDINGS = [
    ("Licensed under the MIT License.", "MIT"),
    ("MIT License", "MIT"),
    ("This software is released under the Apache License 2.0.", "Apache-2.0"),
    ("This project is licensed under the MIT License.", "MIT"),
    ("// SPDX-License-Identifier: MIT", "MIT"),
    ("SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
    ("# SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"),
    ("This module is free software under the GNU GPL v3 licence.", "GPL-3.0"),
    ("Our code is published under the 3-clause BSD license.", "BSD-3-Clause"),
    ("All content here is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
    ("The package is available under the Mozilla Public License Version 2.0", "MPL-2.0"),
    ("licence: ISC", "ISC"),
    ("Text may be reused under CC BY-NC 4.0 by anyone", "CC-BY-NC-4.0"),
    ("Distributed under Apache 2.0", "Apache-2.0"),
    ("Published as free software: GNU Affero General Public License v3.0", "AGPL-3.0"),
    ("MIT License was a topic of the debate among many people in town", None),
    ("See the LICENSE file for details.", None),
    ("Copyright (c) 2020 Jane Doe. All rights reserved.", None),
    ("It is a licence that nobody at MIT ever wrote, and the town council met to talk about something else", None),
    ("Copyright 2020 mit allen Rechten, Lizenz auf Anfrage", None),
    ("In some countries the public domain is a matter of copyright law", None),
    ("Licensed under the GNU General Public License.", None),
]


def test_other_wordings(spark):
    got = scan(spark, [(i, f"Some words here.\n{t}\nmore text", None) for i, (t, _) in enumerate(WORDINGS)])
    assert [(t, got[i].license) for i, (t, _) in enumerate(WORDINGS)] == WORDINGS


def test_headers_and_whole_files(spark):
    mit = 'Copyright (c) 2019 Jane Doe and friends\n\nPermission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation\nfiles (the "Software"), to deal in the Software without\nrestriction, including without limitation the rights to use,\ncopy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the\nSoftware is furnished to do so, subject to the following\nconditions:\n\nThe above copyright notice and this permission notice shall be\nincluded in all copies or substantial portions of the Software.\n'
    bsd = "Copyright (c) 2001, Some Lab.\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n* Redistributions of source code must retain the above copyright notice, this\n  list of conditions and the following disclaimer.\n\n* Redistributions in binary form must reproduce the above copyright notice,\n  this list of conditions and the following disclaimer in the documentation\n  and/or other materials provided with the distribution.\n"
    lab = "\n* Neither the name of Some Lab nor the names of its contributors may be used\n  to endorse or promote products derived from this software without specific\n  prior written permission.\n"
    as_is = '\nTHIS SOFTWARE IS PROVIDED BY THE AUTHORS "AS IS" AND ANY EXPRESS OR IMPLIED\nWARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF\nMERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT\nSHALL THE AUTHORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,\nEXEMPLARY, OR CONSEQUENTIAL DAMAGES HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,\nWHETHER IN CONTRACT, STRICT LIABILITY, OR TORT ARISING IN ANY WAY OUT OF THE USE\nOF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.\n'
    header = '/*\n * Licensed under the Apache License, Version 2.0 (the "License");\n * you may not use this file except in compliance with the License.\n * You may obtain a copy of the License at\n *\n *     http://www.apache.org/licenses/LICENSE-2.0\n */\nint main() {}\n' + "x = 1;\n" * 60
    gnu = "/* This file is part of Tool.\n *\n * Tool is free software: you can redistribute it and/or modify it under the\n * terms of the GNU Lesser General Public License as published by the Free\n * Software Foundation, either version 3 of the License, or (at your option) any\n * later version.\n */\nint x;\n"
    gpl = dict(L.whole_texts())["GPL-3.0"]
    rows = [(1, mit, "m/TERMS"), (2, "code", "m/x.py"), (3, bsd + as_is, "b2/TERMS"), (4, bsd + lab + as_is, "b3/TERMS"), (5, "code", "b3/a/x.py"), (6, header, "h/x.c"), (7, "code", "h/y.c"), (8, gnu, "g/x.c"), (9, gpl.split("\n", 6)[6], "p/TERMS"), (10, "code", "p/x.py"), (11, "code", "b2/q")]
    got = scan(spark, rows)
    assert {i: r.license or r.inherited for i, r in got.items()} == {1: "MIT", 2: "MIT", 3: "BSD-2-Clause", 4: "BSD-3-Clause", 5: "BSD-3-Clause", 6: "Apache-2.0", 7: None, 8: "LGPL-3.0", 9: "GPL-3.0", 10: "GPL-3.0", 11: "BSD-2-Clause"}


def brute(rows):
    """doc -> (licence, inherited) of (doc, text, path): cosines and directories by loops."""
    short, long = L.all_templates(L.TEMPLATES)
    idf, having = {}, {}
    for name, words in short + long:
        for w in words:
            having.setdefault(w, set()).add(name)
    total = len({n for n, _ in short + long})
    idf = {w: (math.log((1 + total) / (1 + len(n))) + 1) * (L.NAME_WEIGHT if w.startswith("id:") else 1.0) for w, n in having.items()}
    vectors = [(n, {w: c * idf[w] for w, c in Counter(words).items()}) for n, words in short + long]

    def cosine(unit, template):
        own = {w: c * idf.get(w, 0.0) for w, c in Counter(unit).items()}
        norm = math.sqrt(max(1.0, sum(v * v for v in own.values()) + sum(c for w, c in Counter(unit).items() if w not in idf)))
        return sum(v * template.get(w, 0.0) for w, v in own.items()) / norm / math.sqrt(sum(v * v for v in template.values()))

    named = lambda x: re.search(L.UNIT, x) is not None
    judged = {}
    for i, text, path in rows:
        text = text or ""
        lines = [x for x in text.split("\n") if x.strip(" ")]
        parts = [x for x in re.split(r"\n[^\w\n]*(?=\n)", text) if "\n" in x.strip(" ")]
        units = [text, *(x for x in lines if named(x)), *(x for x in parts if named(x))] if named(text) else []
        best = [min((-round(cosine(L.template_words(u), v), 6), n) for n, v in vectors) for u in units]
        score, name = min(best, default=(0, None))
        good = -score >= L.THRESHOLD
        file = good and (-best[0][0] >= L.THRESHOLD or sum(map(named, lines)) >= L.FILE_SHARE * len(lines) or bool(path and re.search(L.LICENSE_FILE, path)))
        judged[i] = (name if good else None, file, path)
    given = {}
    for i, (name, file, path) in judged.items():
        if file and path is not None:
            folder = path.rpartition("/")[0]
            given[folder] = min(given.get(folder, (path, name)), (path, name))
    out = {}
    for i, (name, _, path) in judged.items():
        folder, inherited = (path or "").rpartition("/")[0], None
        while path is not None and name is None:
            if folder in given or not folder:
                inherited = given.get(folder, (None, None))[1]
                break
            folder = folder.rpartition("/")[0]
        out[i] = (name, inherited)
    return out


def test_equals_a_loop(spark, docs):
    rnd = random.Random(4)
    notices = [*L.TEMPLATES.values(), "// SPDX-License-Identifier: MIT", "Copyright 2020 someone\n# all rights reserved", "This license is of no kind", *[t for _, t in L.TEXTS[:4]]]
    rows = []
    for i in range(160):
        lines = [" ".join(rnd.choice(["word", "value", "main", "text", "license", "of"]) for _ in range(rnd.randint(1, 9))) for _ in range(rnd.randint(0, 8))]
        if rnd.random() < 0.4:
            lines.insert(rnd.randint(0, len(lines)), rnd.choice(notices))
        if rnd.random() < 0.3:
            lines.insert(rnd.randint(0, len(lines)), rnd.choice(["", " * ", "#"]))
        path = "/".join(rnd.choice("abc") for _ in range(rnd.randint(0, 3))) + rnd.choice(["/f.c", "/LICENSE", "/copying.txt"]) + str(i)
        rows.append((i, rnd.choice(["\n".join(lines)] * 9 + [None]), rnd.choice([path.lstrip("/")] * 9 + [None])))
    table = spark.createDataFrame(rows, "doc_id long, text string, path string")
    got = {r.doc_id: (r.license, r.inherited) for r in L.scan_licenses(table, "doc_id", "text", F.col("path")).collect()}
    want = brute(rows)
    assert got == want
    assert sum(a is not None for a, _ in want.values()) > 20 and sum(b is not None for _, b in want.values()) > 10
