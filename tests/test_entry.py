"""Every query with SQL equals DuckDB on the smallest tables; the entry runs without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from oficina.plans import queries as plans

SF = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parent.parent


def plain(rows):
    def one(v):
        if v is None or v != v:
            return None
        if isinstance(v, bool):
            return v
        return round(float(v), 9) if isinstance(v, (int, float)) else v

    return sorted(repr([one(v) for v in r]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    got = duck.execute(plans.oracle_sql()[name])
    cols = [d[0] for d in got.description]
    assert sorted(cols) == sorted(df.columns)
    assert plain(map(tuple, df.select(*cols).collect())) == plain(got.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert plans.queries()[name](spark, SF).count() > 0


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_entry_imports_without_the_training_data_operators(tmp_path):
    for f in ("__spark_entry__.py", "bench.py"):
        (tmp_path / f).write_text((REPO / f).read_text())
    (tmp_path / "oficina").mkdir()
    for f in (REPO / "oficina").iterdir():
        if f.name != "llm":
            (tmp_path / "oficina" / f.name).symlink_to(f)
    code = "import __spark_entry__ as e; n = set(e.queries()); assert 'price_insights' in n and not any(x.startswith('op') for x in n); assert set(e.oracle_sql()) <= n"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
