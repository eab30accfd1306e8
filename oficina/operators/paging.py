"""Deep pages: an order that is written once in ranges, so that a page far down reads the range it lies in and no other.

``write`` deals rows out by ranges of the order, sorts each range and writes it as a part; ``counts`` says how many rows each part
has. The rows before a part are a sum over these counts, at most one number a part on the driver. ``page`` reads the parts
that an offset and a limit touch, and sorts only these.

Defined results: the last column of the order has to be unique, so that the order is total; nulls stand where the order puts them; an
offset behind the last row gives no rows; an empty table has no parts. A negative offset is 0, a limit is at least 1.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

#: Parts of an order. A part is what one page reads, so it should hold some ten thousand rows.
PARTS = 64


def write(rows: DataFrame, order: list[Column], path: str, parts: int = PARTS) -> None:
    """Write ``rows`` by ranges of ``order`` (ascending or descending columns) under ``path``."""
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt.withColumn("part", F.spark_partition_id()).write.mode("overwrite").partitionBy("part").parquet(path)


def counts(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(part, rows before it and in it), by part; parquet's own row counts, no column is read."""
    found = spark.read.schema("part int").parquet(path).groupBy("part").agg(F.count("*").alias("n")).collect()
    found = sorted((r.part, r.n) for r in found)
    return list(zip([p for p, _ in found], accumulate(n for _, n in found)))


def page(spark: SparkSession, path: str, schema: StructType, order: list[Column], ends: list[tuple[int, int]], offset: int, limit: int) -> DataFrame:
    """The rows ``offset`` to ``offset + limit`` of the whole order; ``schema`` is that of the rows written, ``ends`` what ``counts`` gave."""
    offset, limit = max(0, offset), max(1, limit)
    starts = [0, *(end for _, end in ends)]
    touched = [(part, start) for (part, end), start in zip(ends, starts) if end > offset and start < offset + limit]
    if not touched:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(StructType(schema.fields).add("part", IntegerType())).parquet(path).where(F.col("part").isin([p for p, _ in touched])).drop("part")
    return rows.orderBy(*order).offset(offset - touched[0][1]).limit(limit)
