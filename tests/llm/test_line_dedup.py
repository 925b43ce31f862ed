import hashlib
import random
import re
from itertools import combinations

import duckdb
from lexmill.llm import line_dedup as S


def kept_lines(rows, depth=3, least=8, docs_of_short=5):
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    docs = [(S.LAST if d is None else d, None if t is None else t.split("\n")) for d, t in rows]

    def keys(line):
        w = ["<*>" if re.search("[0-9]", x) else x for x in re.findall(r"[^ \t\x0b\f\r]+", low(line))]
        if len(w) < least:
            return [("short", *w)] if w else []
        return [(free, len(w), tuple(x for k, x in enumerate(w) if k < depth or (k - depth) % 5 not in free)) for free in combinations(range(5), 2)]

    where = {}
    for d, lines in docs:
        for line in lines or []:
            for k in keys(line):
                where.setdefault(k, set()).add(d)
    recurs = {k: min(v) for k, v in where.items() if len(v) >= (docs_of_short if k[0] == "short" else 2)}
    return [[x for x in lines or [] if not any(recurs.get(k, d) < d for k in keys(x))] for d, lines in docs]


def kept_texts(rows):
    return ["\n".join(kept) for kept in kept_lines(rows)]


def brute(rows):
    out = []
    for (d, t), kept in zip(rows, kept_lines(rows), strict=True):
        n, text = 0 if t is None else t.count("\n") + 1, "\n".join(kept)
        out.append((d, n, n - len(kept), len(text), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows():
    rnd = random.Random(2)
    common = "Subscribe to our weekly newsletter now and save 10 percent of all"
    passage = " ".join(f"p{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    out = [(None, "a b c\n" + passage), (None, passage + "\nx"), (1000, None), (1001, ""), (1002, "\n\n"), (1003, "é ü " * 9), (1004, "É ü " * 9), (1005, "É ü " * 9), (1006, "user 1 logged in from host aa at noon"), (1007, "user 22 logged in from host bb at noon"), (1008, "user 22 logged out of host cc by noon"), (5000, "w " * 50000 + "\n" + "q" * 100000 + "\n" + common)]
    for i in range(80):
        lines = [" ".join(f"{rnd.choice('abcdefgh')}{rnd.choice('xyz')}" for _ in range(rnd.randrange(14))) for _ in range(rnd.randrange(6))]
        if rnd.random() < 0.5:
            lines.insert(rnd.randrange(len(lines) + 1), common.replace("10", str(rnd.randrange(99))).replace("weekly", rnd.choice(["weekly", "daily"])))
        if rnd.random() < 0.2:
            lines.append(passage)
        out.append((i, "\n".join(lines)))
    for i in range(6):
        out.append((2000 + i, f"All rights reserved {i}\nonly twice {'ab'[i % 2]}{i // 2 * 'c'}\nand.\n \n"))
    return out + out[20:24]


def test_against_python_and_sql(spark, tmp_path):
    spark.createDataFrame([(d, t, 5, "z") for d, t in rows()], "doc_id long, text string, n_lines int, line string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in S.op7(spark, str(tmp_path)).collect()), key=repr)
    assert got == brute(rows())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(S.SQL7).fetchall(), key=repr) == got


def test_templates_with_two_free_fields(spark):
    """Lines of a template that differ in any two words after the leading ones, a two-word field included, all meet; others of the leaf stay."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    rows, planted = [], set()
    for t in range(200):
        n = rnd.randrange(8, 40)
        base, (a, b) = [word() for _ in range(n)], sorted(rnd.sample(range(3, n), 2))
        if t % 3 == 0:
            b = a + 1 if a + 1 < n else a - 1
        for i in range(3):
            line = list(base)
            line[a], line[b] = word(), word()
            rows.append((len(rows), " ".join(line)))
            if i:
                planted.add(rows[-1][0])
        other = base[:3] + [word() if k % 2 else base[k] for k in range(3, n)]
        rows.append((len(rows), " ".join(other if n > 11 else [*base[:3], *[word() for _ in range(n - 3)]])))
    gone = {r.doc_id for r in S.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("n_dropped > 0").collect()}
    assert planted <= gone and len(gone - planted) <= 4  # half of the places differ in the others
    two = ["the service reports user anna in town rome as late", "the service reports user bert in town oslo as late"]
    three = ["one two three a five b seven c", "one two three x five y seven z"]
    df = spark.createDataFrame(list(enumerate(two + three)), "doc_id long, text string")
    assert [r.n_dropped for r in S.dedup_lines(df).orderBy("doc_id").collect()] == [0, 1, 0, 0]


def test_options_and_tables(spark):
    line = "one two three four five six seven {} nine"
    df = spark.createDataFrame([(i, line.format(i) + "\nshort line", "z") for i in range(3)] + [(9, line.format("x"), "y")], "doc_id long, text string, d string")
    got = S.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "d", "n_lines", "n_dropped"]
    assert {r.text for r in S.dedup_lines(df, short_docs=2).where("doc_id = 1").collect()} == {""}
    assert [(r.doc_id, r.text, r.n_dropped) for r in got.orderBy("doc_id").collect()] == [(0, line.format(0) + "\nshort line", 0), (1, "short line", 1), (2, "short line", 1), (9, "", 1)]
    assert {r.text for r in S.dedup_lines(df, keep_first=False).collect()} == {"short line", ""}
    assert S.dedup_lines(df, least_docs=5).where("n_dropped > 0").count() == 0 and S.dedup_lines(df, least_docs=4).where("n_dropped > 0").count() == 3
    assert S.dedup_lines(df.limit(0)).count() == 0
