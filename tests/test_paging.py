"""Deep pages against the plain order; display order; listings of several stores."""

import random

import pytest
from pyspark.sql import functions as F

from oficina.functions import text
from oficina.operators import catalog, paging
from oficina.sources import pages


@pytest.mark.parametrize("down", [True, False])
def test_every_page_equals_the_plain_query_and_reads_its_part(spark, tmp_path, down):
    rng = random.Random(3)
    # A third of all rows have one price, some have none.
    rows = [(i, None if i % 11 == 0 else 5.0 if i % 3 == 0 else float(rng.randrange(40))) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, price double")
    order, path = [F.desc("price") if down else F.asc("price"), F.asc("id")], str(tmp_path / "o")
    paging.write(df, order, path, parts=7)
    ends = paging.counts(spark, path)
    assert ends[-1][1] == 700 and len(ends) > 3
    whole = [tuple(r) for r in df.orderBy(*order).collect()]
    for offset in (-5, 0, 90, 340, 650, 699, 700, 9000):
        got = paging.page(spark, path, df.schema, order, ends, offset, 60)
        assert [tuple(r) for r in got.collect()] == whole[max(offset, 0) : max(offset, 0) + 60]
    plan = paging.page(spark, path, df.schema, order, ends, ends[2][1] + 1, 5)._jdf.queryExecution().executedPlan().toString()
    assert "part#" in plan and f"= {ends[3][0]})" in plan.split("PartitionFilters")[1]


def test_an_empty_order_has_no_pages(spark, tmp_path):
    df = spark.createDataFrame([], "id long, price double")
    paging.write(df, [F.asc("id")], str(tmp_path / "o"))
    assert paging.page(spark, str(tmp_path / "o"), df.schema, [F.asc("id")], paging.counts(spark, str(tmp_path / "o")), 0, 10).count() == 0


def test_display_order_and_unknown_categories(spark):
    df = spark.createDataFrame([(1, "cooler", 1), (1, "cpu", 2), (1, None, 3), (1, "x", 4), (1, "memory", 5), (1, "memory", 4), (2, "psu", 1)], "b int, category string, seq int")
    got = {(r.b, r.category, r.seq): r.position for r in catalog.in_display_order(df, "b", "seq").collect()}
    assert got == {(1, "cpu", 2): 1, (1, "memory", 4): 2, (1, "memory", 5): 3, (1, "cooler", 1): 4, (1, None, 3): 5, (1, "x", 4): 6, (2, "psu", 1): 1}


def test_listings_of_stores_keep_all_rows(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x")], "code long, title string")
    b = spark.createDataFrame([(2, 9.0)], "code long, price double")
    assert sorted(map(repr, (tuple(r) for r in pages.together(a, b, a).collect()))) == sorted(map(repr, [(1, "x", None)] * 4 + [(2, None, 9.0)]))
    assert [r[0] for r in spark.range(1).select(F.explode(F.array(text.public_url(F.lit("k.png")), text.public_url(F.lit("k.png"), "https://i.example/")))).collect()] == ["/images/k.png", "https://i.example/k.png"]
