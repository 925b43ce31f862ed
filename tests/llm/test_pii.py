import hashlib
import re

import duckdb
import pytest
from lexmill.llm import pii as S

TEXTS = [
    None, "", "none here", "a@b.c x_y%z+1@mail.example.com@d.e a@b", "x@y.z_q@w.v", "1.2.3.4.5.6.7.8 256.1.1.1 010.0.0.255 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111",
    "+1 (811) 555-3281 +12345 +49 30 1234 5678 9012 34 5 +1", "é😀 a@b.co 😀 1.2.3.4", "IBAN DE89 3704 0044 0532 0130 00 DE89370400440532013000 DE88370400440532013000 XDE89370400440532013000",
    "my ssn 123-45-6789 is", "123-45-6789", "social security number: 123-45-6789 000-12-3456", 'token = "b44e15e09fd311aabb" Password: hunter2hunter2hunter2', "9" * 100_000, "a" * 200_000, "+" + "1(" * 50_000 + "1",
    "a@b.c " * 3000, "1.1.1.1.", "4" * 13, "0" * 16, "a@b-.-c.d", "+1234567890", "card 4012888888881881",
]


def brute(text):
    t, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t if "@" in t else ""):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t if "." in t else ""):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return [f"{k}:{a}:{b}" for k, a, b in out]


def test_base_against_python_and_all_against_sql(spark, tmp_path):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, pii string, n_email int").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in S.op10(spark, str(tmp_path)).collect()}
    for i, t in enumerate(TEXTS):
        want = brute(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (i, want[:5], got[i].spans[:200])
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(w.startswith(k + ":") for w in want) for k in S.BASE)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet' where length(coalesce(text, '')) < 30000")
    for r in con.execute(S.SQL10).fetchall():
        assert tuple(got[r[0]]) == r


def test_own_kinds_need_their_checks_and_context(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    kinds = {r.doc_id: [(s.kind, round(s.score, 2)) for s in r.pii] for r in S.find_pii(df, keep=["doc_id"]).collect()}
    assert kinds[9] == [("iban", 1.0), ("iban", 0.7)] and kinds[10] == [("ssn", 0.6)] and kinds[11] == [] and [k for k, _ in kinds[12]] == ["ssn"] and [k for k, _ in kinds[13]] == ["secret", "secret"]
    assert ("card", 1.0) in kinds[23]


@pytest.mark.parametrize("n", [0, 3])
def test_tables(spark, n):
    df = spark.createDataFrame([(None, "a@b.c", "z")] * 3, "doc_id long, text string, extra string").limit(n)
    got = S.find_pii(df)
    assert got.columns == ["doc_id", "text", "extra", "pii"] and got.count() == n
