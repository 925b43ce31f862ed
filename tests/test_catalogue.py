"""Each query against its SQL on the smallest tables."""

import math
import sys

import duckdb
import pytest

sys.path.insert(0, __file__.rsplit("/", 2)[0])
from lexmill import catalogue  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    return float(f"{v:.9g}") + 0.0 if isinstance(v, float) and not math.isnan(v) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_against_sql(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    cur = con.execute(catalogue.oracle_sql()[name])
    head = [d[0] for d in cur.description]
    assert sorted(head) == sorted(df.columns)
    want = sorted(([norm(r[head.index(c)]) for c in df.columns] for r in cur.fetchall()), key=repr)
    assert sorted(([norm(x) for x in r] for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", ["html_unescape_full", "textrank_keywords", "textrank_sentences", "textrank_summary", "lda_clusters"])
def test_query_without_sql_gives_rows(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_mmr_chooses_over_all_vectors_of_a_label(spark, tmp_path):
    rows = [(i, [1.0, 0.01 * (i % 7), 0.0], 0) for i in range(150)] + [(200, [60.0, 0.0, 80.0], 0), (300, [1.0, 0.0, 0.0], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalogue.queries()["mmr_selection"](spark, str(tmp_path)).collect()
    assert [r.item for r in got if r.key == 0 and r.rank == 2] == [200] and sorted(r.rank for r in got if r.key == 0) == [1, 2, 3, 4, 5]
    assert [(r.item, r.rank) for r in got if r.key == 1] == [(300, 1)]
