"""The scan over ranges against a window over each key."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from oficina.operators import ranges

ROWS = "k long, t int, id int, price decimal(12,2), stock boolean, other string"


@pytest.mark.parametrize("n,parts,batch", [(400, 7, 10), (400, 1, 10_000), (60, 40, 3), (1, 4, 10), (0, 4, 10)])
def test_equal_to_a_window(spark, n, parts, batch):
    from decimal import Decimal

    rng = random.Random(n)
    # A key with most of the rows, a null key, null states, equal rows.
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.randrange(50), rng.randrange(5), rng.choice([None, Decimal("1.00"), Decimal("2.00")]), rng.choice([None, True, False]), f"x{rng.randrange(3)}") for _ in range(n)]
    df = spark.createDataFrame(rows + rows[:20], ROWS)
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = sorted(map(repr, ranges.differing_in_order(df, "k", ["price", "stock"], ["t", "id"]).select("k", "t", "id", "price", "stock").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old[1])
    w = Window.partitionBy("k").orderBy("t", "id", "price", "stock")
    state = F.struct("price", "stock")
    want = df.withColumn("b", F.lag(state).over(w)).where(~F.col("b").eqNullSafe(state)).select("k", "t", "id", "price", "stock")
    assert got == sorted(map(repr, want.collect()))


def test_the_history_is_shuffled_once(spark):
    df = spark.range(5000).select(F.lit(1).cast("long").alias("k"), F.col("id").cast("int").alias("t"), (F.col("id") % 3).alias("price"))
    spark.conf.set("spark.sql.shuffle.partitions", 5)
    try:
        out = ranges.differing_in_order(df, "k", ["price"], ["t"])
        assert out.count() == 5000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    # What is left to shuffle after the scan are the ends of the ranges.
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD" in plan and "Join" not in plan
