import random
import re
from collections import Counter

import duckdb
from lexmill.llm import quality_rules as S


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    hit = {i + j for i, w in enumerate(windows) if many[w] > 1 for j in range(3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def texts():
    rnd = random.Random(3)
    out = [None, "", " \n\t ", "a", "a a a a", "a\na\n\n \na", "é É x #*$%&|<>", "x " * 60000]
    for _ in range(150):
        v = [f"w{i}" for i in range(rnd.choice([3, 20, 2000]))]
        out.append(rnd.choice([" ", "  ", "\t", "\n"]).join(rnd.choice(v) for _ in range(rnd.randrange(400))))
    return out


def test_counts_against_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_words int").repartition(4)
    got = {r.doc_id: r for r in S.apply_rules(df).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), repr(t)[:99]
        assert not (r.kept and r.base_failed)


def test_thresholds_follow_language_and_source(spark):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    text = lambda n: " ".join(word(rnd.randrange(n - 1, n + 2)) for _ in range(100))
    rows = [(i, text(5), "en", "a") for i in range(300)] + [(1000 + i, text(15), "xx", "a") for i in range(300)]
    rows += [(2000, text(15), "en", "a"), (2001, text(15), "xx", "rare"), (2002, text(5), None, None), (2003, text(5).replace(" ", "### "), "en", "a"), (2004, text(5), "en", "a"), (2004, text(5), "en", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = Counter((r.doc_id, r.kept) for r in S.apply_rules(df, keep=["doc_id"]).collect())
    assert all(kept[i, True] for i in range(300)) and all(kept[1000 + i, True] for i in range(300))
    assert kept[2000, False] and kept[2001, True] and kept[2002, True] and kept[2003, False] and kept[2004, True] == 2


def test_small_sketches_against_sql(spark):
    """With few rows asked for, the languages' and sources' own sketches set the bounds; the SQL gives the same verdicts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    verdicts = []
    for least_rows in (1, 5, 20, 200):
        got = sorted(tuple(r) for r in S.apply_rules(docs, least_rows, keep=["doc_id"]).collect())
        assert got == sorted(con.execute(S._sql3(least_rows)).fetchall())
        verdicts.append([r[-1] for r in got])
    assert verdicts[1] != verdicts[3] and verdicts[2] != verdicts[3]
    groups = docs.groupBy("lang", "source").count()
    assert groups.where("count >= 5").count() > 0.8 * groups.count()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, kept string")
    got = S.apply_rules(df)
    assert got.columns == ["doc_id", "text", "lang", "source", *S.COUNTS, "base_failed", "kept"] and got.count() == 0
