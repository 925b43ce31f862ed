import random
import re

import duckdb
from lexmill.llm import license_scan as S
from pyspark.sql import functions as F

TEXTS = [
    None, "", "...", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.",
    "under the mit license under the MIT license. under-the mit, license", "cc by nc cc by nc-sa 4.0 cc by", "mit licence mit-license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "SPDX-License-Identifier: BSD-3-Clause\nAll rights reserved.", "É under the mit licenseé under the mit license", "apache license version 2", "the license of the permit was mit", "Licensed under the Apache License, Version 2.0. " * 2000,
    "https://creativecommons.org/licenses/by-sa/4.0/", "plain words " * 20000,
    "licensed under the mit license apache license all rights reserved", "Licensed under the Expat License", "Released under the terms of the GNU GPL license", "under the mit license apache license " * 300,
    "SPDX-License-Identifier: Apache-2.0 OR MIT", "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", "sous licence MIT. Tous droits réservés", "unter der Apache-2.0-Lizenz", "Bajo la licencia BSD 3-Clause",
]


def brute_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = [(i, label) for phrase, label in S.BASE.items() for p in [phrase.split()] for i in range(len(w)) if w[i : i + len(p)] == p]
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_against_python_and_sql(spark, tmp_path):
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int, detections string").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in S.op5(spark, str(tmp_path)).collect()}
    for i, t in enumerate(TEXTS):
        assert tuple(got[i])[1:6] == brute_base(t), i
    assert [got[i].labels for i in range(3, 9)] == ["mit", "apache-2", "cc-by-nc", "gpl-3.0", "mit", "cc-by-nc"]
    assert [got[i].labels for i in (10, 11, 14, 15, 16, 17)] == ["mit", "bsd-3-clause,proprietary", "", "apache-2", "cc-by-sa", ""]
    assert [got[i].labels for i in range(18, 21)] == ["apache-2,mit,proprietary", "mit", "gpl"]
    assert [got[i].labels for i in range(22, 27)] == ["apache-2,mit", "classpath-exception,gpl-2.0", "mit,proprietary", "apache-2", "bsd-3-clause"]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = {r[0]: r for r in con.execute(S.SQL5).fetchall()}
    assert {k: tuple(v) for k, v in got.items()} == want


def test_rules_are_bounded():
    own = S.rules()
    assert len(own) > 500 and len(S.SIGNATURES) > 100
    for r in own:
        re.compile(r.pattern)
        assert not re.search(r"[+*]|\{\d*,\}", r.pattern) and max(map(len, matches_of(S.parser.parse(r.pattern)))) < S.MOST


def test_priority_against_a_loop(spark):
    """Random matches, none within another: a match stays unless it overlaps one that stayed before."""
    rnd = random.Random(8)
    rows, want = [], {}
    for d in range(200):
        at, end, own = 0, 0, []
        for _ in range(rnd.randrange(40)):
            at, end = at + rnd.randrange(1, 12), end + rnd.randrange(1, 12)
            if end <= at:
                end = at + 1
            own.append((at, -end, rnd.randrange(12)))
        last, kept = {}, []  # a rule's matches don't overlap
        own = [m for m in own if not (m[0] < last.get(m[2], 0)) and not last.update({m[2]: -m[1]})]
        for m in sorted(own, key=lambda m: (m[2], m[0])):
            if not any(m[0] < -k[1] and k[0] < -m[1] for k in kept):
                kept.append(m)
        want[d] = sorted(kept)
        rows.append((d, [(*m, 0.5, "x") for m in own]))
    df = spark.createDataFrame(rows, "d int, s array<struct<start:bigint,less:bigint,rule:int,score:double,label:string>>")
    assert {r.d: [tuple(x)[:3] for x in r.s] for r in df.select("d", S._ranked(F.col("s")).alias("s")).collect()} == want


def test_tables(spark):
    df = spark.createDataFrame([(None, "MIT license", "z")] * 3, "doc_id long, text string, base string")
    got = S.scan(df)
    assert got.columns == ["doc_id", "text", "n_words", "base", "detections"] and got.count() == 3 and S.scan(df.limit(0)).count() == 0
    assert [d.label for d in got.first().detections] == ["mit"]


def matches_of(tree):
    """A match for each alternative of a parsed pattern, its optional parts left out."""
    out = [""]
    for op, arg in tree:
        if str(op) == "LITERAL":
            more = [chr(arg)]
        elif str(op) == "IN":
            more = [chr(a if str(kind) == "LITERAL" else a[0]) for kind, a in arg]
        elif str(op) == "SUBPATTERN":
            more = matches_of(arg[-1])
        elif str(op) == "BRANCH":
            more = [m for way in arg[1] for m in matches_of(way)]
        else:
            assert str(op) == "MAX_REPEAT" and arg[0] == 0
            more = [""]
        out = [a + b for a in out for b in more]
    return out


def test_gates_hold_for_a_match_of_every_alternative():
    own, n = S.rules(), 0
    anchors = re.compile(S.anchors(own))
    for r in own:
        for t in matches_of(S.parser.parse(r.pattern)):
            n += 1
            assert re.fullmatch(r.pattern, t) and anchors.search(t) and all(any(g in t for g in x) for x in S.gates(r.pattern)), (r, t)
    assert n > 1000


def test_matches_without_the_old_keywords(spark):
    texts = {"Released under the GNU GPL version 2": "gpl", "Released under CC BY-SA 4.0": "cc-by-sa", "Distributed under Apache 2.0": "apache-2", "confidential and proprietary": "proprietary", "gnu.org/copyleft/gpl.html": "gpl", "Licensed under the Expat license": "mit"}
    got = S.scan(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert {r.text: [d.label for d in r.detections] for r in got.collect()} == {t: [x] for t, x in texts.items()}
