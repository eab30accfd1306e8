"""Streaming forms of the price pipeline: change-only history, daily minimum, request limits (alerts: ``alerts``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prices import differing

def read_stream(spark: SparkSession, folder: str, schema, files: str = "*.parquet") -> DataFrame:
    """Landed observation files as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder)


def change_batches(stream: DataFrame, folder: str, name: str = "changes") -> DataFrame:
    """Observations that differ from the listing's latest one: each micro-batch meets the last price and stock of its listings.

    ``stream`` has (listing_id, price_cash, in_stock, collected_at, event_id); of observations at one time the order is that of
    their ids. A batch writes its changes and the listings' last rows under its number, so a batch that runs again writes
    the same. Gives back all changes.
    """
    spark = stream.sparkSession
    columns = ["listing_id", "price_cash", "in_stock", "collected_at", "event_id"]
    out, last = f"{folder}/{name}-out", f"{folder}/{name}-last"
    schema = stream.select(*columns).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{out}/none")

    def step(batch: DataFrame, n: int) -> None:
        rows = batch.select(*columns, F.to_date("collected_at").alias("day"), F.lit(1).alias("turn"))
        if n > 0:  # what was last seen comes before everything: its day is null
            seen = batch.sparkSession.read.schema(schema).parquet(f"{last}/{n - 1}")
            rows = rows.unionByName(seen.withColumns({"day": F.lit(None).cast("date"), "turn": F.lit(0)}))
        new = differing(rows, "day", ["collected_at", "event_id"]).where("turn = 1").select(*columns)
        new.withColumn("price_cash", F.coalesce("price_cash", F.lit(0.0))).write.mode("overwrite").parquet(f"{out}/{n}")
        ends = rows.groupBy("listing_id").agg(F.max_by(F.struct("price_cash", "in_stock", "collected_at", "event_id"), F.struct("turn", "collected_at", "event_id")).alias("x"))
        ends.select("listing_id", "x.*").write.mode("overwrite").parquet(f"{last}/{n}")

    q = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/*")


def daily_minimum(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Smallest positive in-stock price per product and day, final once the watermark has passed the day."""
    rows = stream.where("in_stock AND price_cash > 0").withWatermark("collected_at", late)
    out = rows.groupBy(F.window("collected_at", "1 day").alias("w"), "product_id").agg(F.min("price_cash").alias("min_price"))
    return out.select("product_id", F.to_date("w.start").alias("day"), "min_price")


def over_limit(stream: DataFrame, key: str, at: str, most: int = 60, late: str = "1 minute") -> DataFrame:
    """Keys with more than ``most`` rows in a fixed minute."""
    n = stream.withWatermark(at, late).groupBy(F.window(at, "1 minute").alias("w"), key).agg(F.count("*").alias("n"))
    return n.where(F.col("n") > most).select(F.col("w.start").alias("minute"), key, "n")


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drive a stream over everything that has landed and give back what it wrote, as a batch."""
    out = f"{checkpoint}/{name}-out"
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{checkpoint}/{name}-state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)
