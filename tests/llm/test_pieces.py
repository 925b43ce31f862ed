import math
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lexmill.llm import pieces as S
from sentencepiece import sentencepiece_model_pb2

PATH = public_tokenizers.path("piece_bpe_32k.model")
CASES = ["", " ", "  x   y ", "\n\n a\t", "▁a", "é ﬁ Å 你好 😀😀", "<s> </s> <unk> <0x41>", "a" * 3000, " " * 40, "aaaa bbbb    cccc", "x\x00y", "def f(x):\n        return x  # no"]


def as_unigram():
    spec = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        spec.ParseFromString(f.read())
    spec.trainer_spec.model_type = 1
    rnd = random.Random(0)
    for i, p in enumerate(spec.pieces):
        if p.type == 1:
            p.score = -math.log(i + 1) * (1 + rnd.random() / 5)
    return S.Model(proto=spec.SerializeToString())


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text("abcdet hin ▁\n.é你1=()", max_size=80)))
def test_bpe_gives_the_library_s_ids(text):
    m = S.model(PATH)
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    ids = m.encode(text)
    assert ids == m.library.encode(text) and m.decode(ids) == text.replace("▁", " ")


def test_documents_and_cases(spark):
    m = S.model(PATH)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + CASES
    for t in texts:
        assert m.encode(t) == m.library.encode(t)


def test_unigram_gives_the_library_s_scores():
    m = as_unigram()
    value = lambda ids: sum(m.score.get(m.text[i], 0.0) for i in ids)
    rnd = random.Random(4)
    texts = CASES + [" ".join(rnd.choice(["the", "house", "&&&", "fünf", "running", "ñandú", "x1"]) + rnd.choice(["", "ing", "s."]) for _ in range(30)) for _ in range(60)]
    for t in texts:
        ids, want = m.encode(t), m.library.encode(t)
        assert m.decode(ids) == t.replace("▁", " ")
        assert ids == want or len([i for i in ids if i in m.bytes]) == len([i for i in want if i in m.bytes]) and value(ids) == pytest.approx(value(want), abs=1e-3)


def test_tables(spark):
    rows = [(i, t, "z") for i, t in enumerate(CASES)] + [(None, None, "z"), (None, "a b", "z"), (3, "a b", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = S.encode(df, PATH)
    assert got.columns == ["doc_id", "text", "ids", "round_trip"]
    back = S.decode(got, PATH, text="decoded").collect()
    assert len(back) == len(rows)
    for r in back:
        assert r.round_trip and r.decoded == (r.text or "").replace("▁", " ") and r.ids == S.model(PATH).library.encode(r.text or "")
    assert S.encode(df.limit(0), PATH).count() == 0
