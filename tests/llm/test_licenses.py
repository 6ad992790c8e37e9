import math
import re
from collections import Counter

from groundphrase.llm import licenses as lic
from groundphrase.llm.queries import file_path, op7_licenses
from groundphrase.sources import table

SF = "/root/testdata/sf0.01"


def tokens(t):
    return re.findall(r"[a-z0-9]+(?:[-.][a-z0-9]+)*", t.lower())


def split_units(path, text, keys):
    lines = re.split(r"\r\n|[\n\r]", text)
    has = [bool(set(tokens(x)) & keys) for x in lines]
    out = {x for x, h in zip(lines, has) if h}
    for blanks in (False, True):
        run = []
        for x, h in [*zip(lines, has), ("end", False)]:
            if h or blanks and not re.search(r"[^\W_]", x):
                run.append(x)
            else:
                out.add("\n".join(run))
                run = []
    return out | ({text} if re.search(lic.LICENCE_FILE, path) else set())


def brute(files, templates=lic.TEMPLATES):
    """All lines, runs and licence files against all templates; lines are compared whether they have key words or not."""
    texts = [t for _, t in files if t is not None]
    n, df = len(texts), Counter(w for t in texts for w in set(tokens(t)))
    idf = lambda w: math.log((1 + n) / (1 + df[w])) + 1
    vec = lambda t: {w: c * idf(w) for w, c in Counter(tokens(t)).items()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    known = [(name, v, size(v)) for name, v in ((name, vec(t)) for name, t in templates)]
    keys = set()
    for _, v, length in known:
        left = 1.0
        for _, x, w in sorted((-idf(w), x / length, w) for w, x in v.items()):
            if left < lic.LEAST**2 - 1e-9:
                break
            keys.add(w)
            left -= x**2
    own = {}
    for p, t in files:
        found = [(2, 0.0, 1.0, x) for x in re.findall(lic.SPDX, t or "")]
        head = vec(" ".join([x for x in re.split(r"\r\n|[\n\r]", t or "") if re.search(r"[^\W_]", x)][:2]))
        if head and re.search(lic.LICENCE_FILE, p):
            titles = [(name, round(sum(head[w] * u[w] for w in head if w in u) / m / size(head), 6)) for name, u, m in known]
            found += [(1, 0.0, score, name) for name, score in titles if score >= lic.TITLE]
        for x in split_units(p, t or "", keys) | set(re.split(r"[\n\r]", t or "")):
            v = vec(x)
            if v:
                length = size(v)
                dots = [(name, sum(v[w] * u[w] for w in v if w in u) / m) for name, u, m in known]
                found += [(0, round(d, 3), round(d / length, 6), name) for name, d in dots]
        found = [f for f in found if f[2] >= lic.LEAST]
        if found:
            own[p] = max(found)[2:]
    holders = {}
    for p in sorted(own):
        if re.search(lic.LICENCE_FILE, p):
            holders.setdefault(p.rpartition("/")[0], p)
    out = {}
    for p, _ in files:
        if p in own:
            out[p] = (own[p][1], "own", own[p][0], None)
            continue
        d, out[p] = p, (None, "none", None, None)
        while d:
            d = d.rpartition("/")[0]
            if d in holders:
                h = holders[d]
                out[p] = (own[h][1], "inherited", own[h][0], h)
                break
    return out


def test_query_against_brute_force(spark):
    files = [tuple(r) for r in table(spark, SF, "documents").select(file_path().alias("p"), "text").collect()]
    got = {r.path: (r.license, r.how, r.score, r.origin) for r in op7_licenses(spark, SF).collect()}
    want = brute(files)
    assert len(got) == len(files) and any(v[1] == "own" for v in want.values())
    for p, w in want.items():
        g = got[p]
        assert (g[0], g[1], g[3]) == (w[0], w[1], w[3]) and abs((g[2] or 0) - (w[2] or 0)) < 2e-6, (p, g, w)


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
TEXTS = {name: text for name, text in lic.TEMPLATES if len(text) > 600}


def wrapped(text, mark, width=70):
    import textwrap

    return "\n".join(f"{mark} {x}".rstrip() for p in text.split("\n") for x in textwrap.wrap(p, width) or [""])


def test_standard_headers_and_files(spark):
    code = "import os\n\ndef main(argument):\n    return os.path.join(argument, 'x')\n"
    cases = {"a/apache_c.c": (f"/*\n{wrapped(APACHE, ' *')}\n */\n{code}", "Apache-2.0"), "a/apache_line.txt": (APACHE.replace("\n", " "), "Apache-2.0"),
             "a/apache_prose.txt": (f"Once upon a time there was a river.\n{APACHE}\nThe river ran into the sea.", "Apache-2.0"),
             "a/gpl.py": (f"{wrapped(GPL, '#')}\n\n{code}", "GPL-3.0"), "a/gpl_line.txt": (GPL.replace("\n", " "), "GPL-3.0"),
             "a/spdx.rs": ("// SPDX-License-Identifier: MIT\nfn main() {}\n", "MIT"),
             "a/said.txt": ("The driver showed a licence to the guard, who looked at the licence and the car.\n" + code, None),
             "a/none.txt": (code, None)}
    for name in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "BSL-1.0", "Unlicense"):
        cases[f"l/{name}/LICENSE"] = (f"Copyright (c) 2021 A. N. Author\n\n{wrapped(TEXTS[name], '')}\n", name)
        cases[f"l/{name}.js"] = (f"{wrapped(TEXTS[name], '//')}\n{code}", name)
    cases |= {f"p/{i}.txt": (f"report {i} of the river and the mill near the road number {i % 7}\n", None) for i in range(40)}
    df = spark.createDataFrame([(p, t) for p, (t, _) in cases.items()], "path string, text string")
    got = {r.path: r.license for r in lic.scan_licenses(df).collect()}
    assert {p: got[p] for p in cases} == {p: want for p, (_, want) in cases.items()}
    few = [(p, t) for p, (t, _) in cases.items() if p in ("a/apache_c.c", "a/gpl.py", "l/BSD-2-Clause.js", "a/none.txt")]
    few = {r.path: r.license for r in lic.scan_licenses(spark.createDataFrame(few, "path string, text string")).collect()}
    assert few == {"a/apache_c.c": "Apache-2.0", "a/gpl.py": "GPL-3.0", "l/BSD-2-Clause.js": "BSD-2-Clause", "a/none.txt": None}


def test_inheritance_and_edges(spark):
    apache, mit = "Licensed under the Apache License, Version 2.0.", "Intro\nReleased under the MIT License.\n"
    rows = [("LICENSE", apache), ("a.txt", "x"), ("d/COPYING.md", mit), ("d/e/f/b.txt", None), ("d/LICENSE", "none here"),
            ("g/h.txt", ""), ("own.txt", "y\n" + mit), (None, mit), ("g/k/LICENSE", "a licence of our own invention")]
    df = spark.createDataFrame([(*r, "w") for r in rows], "path string, text string, word string")
    got = {r.path: (r.license, r.how, r.origin) for r in lic.scan_licenses(df).collect()}
    assert got["a.txt"] == ("Apache-2.0", "inherited", "LICENSE") and got["g/h.txt"][0] == "Apache-2.0"
    assert got["d/e/f/b.txt"] == ("MIT", "inherited", "d/COPYING.md") == got["d/LICENSE"][:2] + ("d/COPYING.md",)
    assert got["own.txt"] == ("MIT", "own", None) and got[None] == (None, "none", None)
    assert len(got) == len(rows)
    assert lic.scan_licenses(df.limit(0)).count() == 0


def test_expressions_notes_and_titles(spark):
    """Whole SPDX expressions, a note that names no licence as proprietary, titles of files whose text is no template."""
    body = "\n".join(f"{i}. The library, the program or the work may be conveyed under the terms of version {i % 4} of this license." for i in range(60))
    title = lambda kind, version: f"                  {kind}\n                       {version}\n\n Everyone is permitted to copy it.\n\n{body}"
    note = "// Copyright (c) 2009 The Go Authors. All rights reserved.\n// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.\n"
    tag = lambda x: f"// SPDX-License-Identifier: {x}\nfn main() {{}}\n"
    cases = {"a.rs": (tag("(MIT OR Apache-2.0)"), "MIT OR Apache-2.0"), "b.rs": (tag("MIT OR Apache-2.0"), "MIT OR Apache-2.0"),
             "c.rs": (tag("GPL-2.0-only WITH Classpath-exception-2.0"), "GPL-2.0-only WITH Classpath-exception-2.0"),
             "d.rs": (tag("(MIT AND (ISC OR Zlib))"), "(MIT AND (ISC OR Zlib))"), "e.md": ("(SPDX-License-Identifier: MIT) or later", "MIT"),
             "go.go": (note, "BSD-3-Clause"), "bare.txt": ("Copyright (c) 2020 Some Body. All rights reserved.\n\nThe story begins.\n", None),
             "mini.js": ("/*! (c) me | MIT License */\nvar a=1\n", "MIT"),
             "x.c": ("/* Confidential and proprietary.\n * Unauthorized copying of this file, via any medium,\n * is strictly prohibited. */\n", "Proprietary"),
             "l3/COPYING": (title("GNU LESSER GENERAL PUBLIC LICENSE", "Version 3, 29 June 2007"), "LGPL-3.0"),
             "l2/COPYING": (title("GNU LESSER GENERAL PUBLIC LICENSE", "Version 2.1, February 1999"), "LGPL-2.1"),
             "g3/LICENSE": (title("GNU GENERAL PUBLIC LICENSE", "Version 3, 29 June 2007"), "GPL-3.0"),
             "g1/LICENSE": (title("GNU GENERAL PUBLIC LICENSE", "Version 1, February 1989"), "GPL-1.0"),
             "a3/LICENSE": (title("GNU AFFERO GENERAL PUBLIC LICENSE", "Version 3, 19 November 2007"), "AGPL-3.0"),
             "f3/LICENSE": (title("GNU Free Documentation License", "Version 1.3, 3 November 2008"), "GFDL-1.3"),
             "c0/LICENSE": (title("Creative Commons Legal Code", "CC0 1.0 Universal"), "CC0-1.0"),
             "m1/LICENSE": (title("Mozilla Public License", "Version 1.1"), "MPL-1.1")}
    cases |= {f"p/{i}.txt": (f"report {i} of the river and the mill, for me, near the road number {i % 7}\n", None) for i in range(400)}
    df = spark.createDataFrame([(p, t) for p, (t, _) in cases.items()], "path string, text string")
    got = {r.path: r.license for r in lic.scan_licenses(df).collect()}
    assert {p: got[p] for p in cases if got[p] != cases[p][1]} == {}
