"""License scan against a plain version, with every awkward case."""

import math
from collections import Counter

import cases
import pytest

from milepost.llm import licenses


def plain_cosines(files):
    """Per file: best (cosine, licence) of the lines, runs of lines and the text; of the text to full texts."""
    given = sorted([(n, t, False) for n, ts in licenses.TEMPLATES.items() for t in ts]
                   + [(n, t, True) for n, t in licenses.FULL_TEXTS.items()], key=lambda g: g[0])
    vocabulary = {w for _, t, _ in given for w in cases.words(t)}
    n = len(files)
    df = Counter(w for _, text in files for w in set(cases.words(text)) & vocabulary)
    idf = lambda w: math.log((1 + n) / (1 + df[w])) + 1
    rare = math.log((1 + n) / 2) + 1
    templates = []
    for name, t, full in given:
        v = {w: k * idf(w) for w, k in Counter(cases.words(t)).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        templates.append((name, {w: x / size for w, x in v.items()}, full))

    def runs(text):
        lines = (text or "").split("\n")
        able = [len(w) > 0 and sum(x in vocabulary for x in w) >= max(2, len(w) / 2)
                for w in map(cases.words, lines)]
        for i in range(len(lines)):
            for j in range(i + 2, min(len(lines), i + licenses.RUN_LINES) + 1):
                if all(able[i:j]):
                    yield "\n".join(lines[i:j])

    def best(text, only_full=False):
        count = Counter(cases.words(text))
        v = {w: k * idf(w) for w, k in count.items() if w in vocabulary}
        norm = math.sqrt(sum(x * x for x in v.values())
                         + sum(k for w, k in count.items() if w not in vocabulary) * rare ** 2) or 1.0
        scored = [(round(sum(x * t.get(w, 0) for w, x in v.items()) / norm, 9), name)
                  for name, t, full in templates if full or not only_full]
        top = max(s for s, _ in scored)
        return top, min(name for s, name in scored if s == top)

    out = []
    for _, text in files:
        whole = best(text)
        units = [best(u) for u in (text or "").split("\n") + list(runs(text))] + [whole]
        top = max(s for s, _ in units)
        out.append(((top, min(name for s, name in units if s == top)), best(text, only_full=True)))
    return out


FILES = [
    ("a/LICENSE", "Released under the MIT License.\nplus two extra words here"),
    ("a/x.py", "some code without any notice"), ("a/b/y.py", "more code"),
    ("a/b/c/z.py", "Licensed under the Apache License, Version 2.0.\ncode"),
    ("a/b/n.txt", "All rights reserved."), ("d/e.py", "nothing"), ("top.py", "nothing here"),
    ("d/COPYING", "no licence in this one"), ("q/r/s/t.py", None), ("q/w.txt", "Licensed under CC BY-NC 4.0."),
    (None, "no path"), (None, "All rights reserved."), ("a/x.py", "some code without any notice"),
    ("m/v.py", "This work is licensed under the GNU General Public License, version 3.\n" + "word " * 300),
    ("m/u.py", ""), ("a/b", "file named as a directory"), ("", "empty path"),
]


def files_of(spark, rows):
    return spark.createDataFrame([(i, p, t, "clash", 1.0) for i, (p, t) in enumerate(rows)],
                                 "doc_id long, path string, text string, own string, score double")


def test_scan_and_inheritance(spark):
    got = {r.doc_id: r for r in licenses.scan(files_of(spark, FILES)).collect()}
    assert len(got) == len(FILES)
    for i, ((score, name), _) in enumerate(plain_cosines(FILES)):
        if score >= licenses.MIN_COSINE:
            assert (got[i].license, got[i].inherited) == (name, False)
            assert got[i].score == pytest.approx(score, abs=1e-6)
    # notices in files of other names (a/b/n.txt, q/w.txt) hold for these files alone
    expected = {1: ("MIT", "a"), 2: ("MIT", "a"), 12: ("MIT", "a"), 15: ("MIT", "a")}
    for i, r in got.items():
        if i in expected:
            assert (r.license, r.license_dir, r.inherited) == (*expected[i], True)
        else:
            assert r.license_dir is None and not r.inherited
    for i in (5, 6, 7, 8, 10, 14, 16):
        assert got[i].license is None


GPL2 = licenses.TEMPLATES["GPL-2.0"][1]


def wrapped(text, width, mark="# "):
    import textwrap
    return "\n".join(mark + line for line in textwrap.wrap(text, width))


def test_wrapping_does_not_matter(spark):
    code = "\n\nimport os\nprint(os.getcwd())\n"
    rows = [(f"w/{width}.py", "#!/bin/python\n" + wrapped(GPL2, width, mark) + code)
            for width in (48, 60, 72, 79, 400) for mark in ("# ", " * ")]
    rows += [("w/lgpl.h", wrapped(licenses.TEMPLATES["LGPL-3.0"][1], 70, "// ") + code),
             ("w/gpl3.h", wrapped(licenses.TEMPLATES["GPL-3.0"][1], 66, "// ") + code)]
    got = {r.doc_id: r.license for r in licenses.scan(files_of(spark, rows)).collect()}
    assert [got[i] for i in range(len(rows))] == ["GPL-2.0"] * 10 + ["LGPL-3.0", "GPL-3.0"]
    for i, ((score, name), _) in enumerate(plain_cosines(rows)):
        assert score >= licenses.MIN_COSINE and name == got[i]


def test_full_texts_are_licence_files(spark):
    mit = "Copyright (c) 2020 Some One\n\n" + wrapped(licenses.FULL_TEXTS["MIT"], 78, "")
    bsd = "Copyright 2021 Nobody\n" + wrapped(licenses.FULL_TEXTS["BSD-3-Clause"], 70, "")
    mention = "Some words of prose stand here. Released under the MIT License."
    rows = [("c/deep/text.md", mit), ("c/deep/er/x.py", "code"), ("c/y.py", "code"), ("e/f/g.txt", bsd),
            ("e/f/h/i.py", "code"), ("k/m.txt", "All rights reserved."), ("k/n.txt", "code"),
            ("k/o.txt", mention + "\nThis work is licensed under the GNU General Public License, version 3."),
            ("k/p/q.txt", "words")]
    got = {r.doc_id: (r.license, r.inherited, r.license_dir) for r in licenses.scan(files_of(spark, rows)).collect()}
    assert got[0] == ("MIT", False, None) and got[1] == ("MIT", True, "c/deep") and got[2] == (None, False, None)
    assert got[3] == ("BSD-3-Clause", False, None) and got[4] == ("BSD-3-Clause", True, "e/f")
    assert got[5][0] == "all-rights-reserved" and got[6] == got[8] == (None, False, None)


def test_mentions_are_not_inherited(spark):
    got = licenses.op3_license_scan(spark, "/root/testdata/sf0.01")
    assert got.where("inherited").count() == 0 and got.where("license is not null").count() > 30


def test_query_equals_the_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    own = plain_cosines([(None, r.text) for r in docs])
    held = {}
    for r, (_, (whole, name)) in zip(docs, own):
        if whole >= licenses.FILE_COSINE:
            held[r.lang, r.source] = min(held.get((r.lang, r.source), (0, "")), (-whole, name))
    for r in licenses.op3_license_scan(spark, sf).collect():
        (score, name), _ = own[[d.doc_id for d in docs].index(r.doc_id)]
        source = next((d.lang, d.source) for d in docs if d.doc_id == r.doc_id)
        if score >= licenses.MIN_COSINE:
            assert r.license == name and not r.inherited
        else:
            assert r.license == (held[source][1] if source in held else None)


def test_awkward_rows_and_empty_tables(spark):
    docs = cases.documents(spark).selectExpr("*", "concat('d/', source, '/', doc_id) as path")
    assert licenses.scan(docs).count() == docs.count()
    assert licenses.scan(docs.limit(0)).count() == 0
