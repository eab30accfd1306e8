"""Standing tables of the price engine, written in parts: a batch rewrites the parts that it touches and no other.

* ``history`` lies by day and batch. A batch writes its own parts, so one that runs again overwrites what it wrote and adds nothing.
* ``listings`` lie in a fixed number of parts by the hash of (store, SKU). A batch reads the parts that its rows fall into, puts its rows
  over them, and overwrites these parts.
* ``daily`` lies by day. The days of a batch are computed anew from the history and overwritten.

All three use dynamic partition overwrite: new files are written aside and moved when the job is done, so a
table may be read and written in one job, and a batch that is interrupted has changed whole steps only. Each step gives the same
result when it is run again, so an interrupted batch is simply run again, before the next one.

Defined results: an empty batch writes nothing. Rows of one (store, SKU) in one batch: the last by ``seq`` counts for the listing. A row
without a time goes to the part of the null day. Tables that don't exist yet are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ingest import upsert
from ..operators.prices import daily_minimum

#: Parts of the listing table. It belongs to the table: one written with another number has to be rewritten.
PARTS = 64
KEYS = ["store_id", "store_sku"]


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A table as it stands; empty if it does not exist."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def _overwrite(rows: DataFrame, path: str, *by: str) -> None:
    # A part's rows go to few files; rebalancing splits a part that holds very many.
    rows.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def part_of(parts: int = PARTS) -> Column:
    """The part that a listing falls into."""
    return F.pmod(F.xxhash64(*KEYS), F.lit(parts)).cast("int")


def write_history(changes: DataFrame, path: str, batch: int) -> None:
    """Append a batch's changes (with ``day``); the same batch again replaces its rows."""
    _overwrite(changes.withColumn("batch", F.lit(batch).cast("long")), path, "day", "batch")


def touched(listings: DataFrame, now: DataFrame, parts: int = PARTS) -> DataFrame:
    """The rows of the listing table that lie in a part which a batch falls into; other parts are not read.

    At most ``parts`` numbers go to the driver.
    """
    numbers = [r[0] for r in now.select(part_of(parts).alias("part")).distinct().collect()]
    return listings.where(F.col("part").isin(numbers)) if numbers else listings.limit(0)


def write_listings(now: DataFrame, path: str, overwrite: list[str], fill: list[str], parts: int = PARTS) -> None:
    """Put a batch's rows (store_id, store_sku, seq and the columns named) over the listing table."""
    spark = now.sparkSession
    columns = [*KEYS, *overwrite, *fill]
    last = now.groupBy(*KEYS).agg(F.max_by(F.struct(*overwrite, *fill), "seq").alias("__v")).select(*KEYS, "__v.*")
    schema = StructType([*now.select(*columns).schema, *now.select(part_of(parts).alias("part")).schema])
    old = touched(read(spark, path, schema), last, parts).select(*columns)
    _overwrite(upsert(old, last, KEYS, overwrite, fill).withColumn("part", part_of(parts)), path, "part")


def write_daily(history: DataFrame, path: str, days: DataFrame) -> None:
    """Compute the daily minimum of ``days`` (one column ``day``) anew and overwrite their parts.

    A day that has no price any more keeps its last part; retention removes it with its day.
    """
    wanted = days.select("day").distinct()
    _overwrite(daily_minimum(history.join(wanted, "day", "left_semi")), path, "day")


def write_batch(folder: str, batch: int, now: DataFrame, changes: DataFrame, history_schema: StructType, overwrite: list[str], fill: list[str], parts: int = PARTS) -> None:
    """All writes of one batch, each of which may be repeated.

    ``now`` are the batch's listing rows, ``changes`` those of them that differ from before, with ``day``.
    """
    spark = now.sparkSession
    write_history(changes, f"{folder}/history", batch)
    write_daily(read(spark, f"{folder}/history", history_schema), f"{folder}/daily", changes)
    write_listings(now, f"{folder}/listings", overwrite, fill, parts)


def drop_days(spark: SparkSession, path: str, before: str) -> list[str]:
    """Retention: remove the day parts of a table that lie before a day (ISO text); gives back their names.

    Whole parts go, so nothing is read or rewritten.
    """
    if not exists(spark, path):
        return []
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory())
    old = [n for n in names if n.startswith("day=") and n[4:] < before and n[4:5].isdigit()]
    for n in old:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(root, n), True)
    return old
