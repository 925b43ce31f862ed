import html
import random

import pytest
from lexmill.functions import clean, split, tokens
from pyspark.sql import functions as F


def col(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").repartition(2)
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_cleaning_cases(spark):
    assert col(spark, ["888【（括号去除的状态）】888", "https://pypi.douban.com/simple", "html 转义的情况: &nbsp;      |    okok", None, ""], clean.clean) == ["888888", "", "html 转义的情况: | okok", None, ""]
    assert col(spark, ["&lt;b&gt; <b>x</b>"], clean.clean) == ["<b> x"]
    assert col(spark, ["ａＢ！　１", "a!!!b  c\n\n\nd。。", "x​y\x07z"], lambda c: clean.odd_to_space(clean.collapse_runs(clean.half_width(c)))) == ["aB! 1", "a!b c\nd。", "x y z"]
    assert col(spark, ["tel 13812345678", "13812345678,13912345678 end", "010-12345678", "+1 (811) 555-3281", "me@x.example.org!", "12345678901234567890"], lambda c: clean.remove_emails(clean.remove_phones(c))) == ["tel ", ", end", "", "", "!", "12345678901234567890"]
    assert col(spark, ["&eacute;&#233;&notanentity; &amp;lt;", None], clean.unescape) == [html.unescape("&eacute;&#233;&notanentity; &amp;lt;"), None]
    assert col(spark, ["a $x$\n$y$ $"], clean.double_dollars) == ["a $$x$$\n$y$ $"]
    assert col(spark, ["　  a b\t"], clean.strip) == ["a b"]


def peeled(t):
    while True:
        n = len(t)
        import re

        for a, b in clean.PAIRS:
            t = re.sub(f"{re.escape(a)}[^{re.escape(a)}{re.escape(b)}]*{re.escape(b)}", "", t)
        if len(t) == n:
            return t


def test_brackets_to_the_fixpoint(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab()[]（）") for _ in range(rnd.randrange(30))) for _ in range(300)] + ["(" * 12 + "x" + ")" * 12, "(a[b(c[d(e[f(g)])])])"]
    assert col(spark, texts, clean.remove_brackets) == [peeled(t) for t in texts]


def by_rules(text, p):
    out, cur = [], ""
    for i, c in enumerate(text):
        if cur:
            a, b = text[i - 1], text[i - 2] if i > 1 else ""
            if a in p and c == "“" or a in p.replace("“", "").replace("”", "") and c not in p or a == "”" and b and b in p and c not in p:
                out.append(cur)
                cur = ""
        cur += c
    return out + [cur] * bool(cur)


@pytest.mark.parametrize("criterion", list(split.MARKS))
def test_split_is_lossless_and_follows_the_rules(spark, criterion):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("ab。“”！？\n，.!") for _ in range(rnd.randrange(20))) for _ in range(400)] + ["", "。” 呵呵", "。。。。。。哈哈"]
    got = col(spark, texts, lambda c: split.sentences(c, criterion))
    for t, s in zip(texts, got, strict=True):
        assert "".join(s) == t and s == by_rules(t, split.MARKS[criterion]), repr(t)


def test_split_cases(spark):
    assert col(spark, ["今天的天气真好, “清空万里。” 明天不知道怎么样？出来玩吗", None], lambda c: split.sentences(c)) == [["今天的天气真好, “清空万里。”", " 明天不知道怎么样？", "出来玩吗"], None]
    with pytest.raises(ValueError):
        split.sentences(F.col("x"), "other")


def test_token_filters(spark):
    words = ["的", "上周末", "北京市", "123", "３", "abc", "天气", "天气", "not", "no", "12:30", "monday"]
    assert col(spark, [words, None, []], tokens.filter_tokens, "array<string>") == [["天气", "天气"], None, []]
    assert col(spark, [words], lambda c: tokens.drop_stop_words(c, keep_negative=True), "array<string>")[0][-4:-2] == ["not", "no"]
    assert col(spark, [words], lambda c: tokens.drop_places(c, F.array(F.lit("天气"))), "array<string>") == [[w for w in words if w not in ("北京市", "天气")]]
    assert col(spark, ["我爱天安门 广场"], lambda c: tokens.segment(c, ["天安门", "安门", "广场"])) == [["我", "爱", "天安门", "广场"]]
    assert col(spark, ["nr1", "x", "n", None], tokens.normal_tag) == ["nr", "nz", "n", None]


def test_analyzer_gives_a_part_of_the_tokens(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    for r in df.select(tokens.analyze(F.col("text")).alias("a"), tokens.tokenize(clean.clean(F.col("text"))).alias("t")).collect():
        rest = iter(r.t)
        assert all(any(x == a for x in rest) for a in r.a) and all(2 <= len(a) <= 6 for a in r.a)
