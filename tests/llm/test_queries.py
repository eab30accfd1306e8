"""Every query of the subpackage that has SQL equals it; the others keep their contracts."""

import duckdb
import pytest

from oficina.llm import queries as q
from tests_plain import SF, plain


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = q.queries()[name](spark, SF)
    got = duck.execute(q.oracle_sql()[name])
    cols = [d[0] for d in got.description]
    assert sorted(cols) == sorted(df.columns)
    assert plain(map(tuple, df.select(*cols).collect())) == plain(got.fetchall())


def test_one_row_for_each_document(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op4_sentencepiece", "op6_token_counts", "op7_language_id", "op8_toxicity"):
        ids = [r[0] for r in q.queries()[name](spark, SF).select("doc_id").collect()]
        assert len(ids) == len(set(ids)) == n, name
