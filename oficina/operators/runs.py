"""Collection jobs and their run log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Categories in display order, stores, schedules.
CATEGORIES = ["cpu", "motherboard", "gpu", "memory", "storage", "psu", "cooler", "case"]
DAILY, HOT = "30 4 * * *", "0 */6 * * *"
HOT_CATEGORIES = ["cpu", "gpu"]


def job_matrix(spark: SparkSession, stores: DataFrame) -> DataFrame:
    """A job for each store and category; hot categories run every six hours."""
    cats = F.posexplode(F.array(*map(F.lit, CATEGORIES))).alias("display_order", "category")
    cron = F.when(F.col("category").isin(HOT_CATEGORIES), HOT).otherwise(DAILY)
    return stores.select("*", cats).select("store_id", "slug", "category", "display_order", cron.alias("cron"), F.col("is_active").alias("enabled"))


def enabled_jobs(jobs: DataFrame, store: str | None = None, category: str | None = None) -> DataFrame:
    out = jobs.where("enabled")
    if store is not None:
        out = out.where(F.col("slug") == store)
    return out if category is None else out.where(F.col("category") == category)


def seed_if_empty(table: DataFrame, seeds: DataFrame) -> DataFrame:
    """The table, or the seeds where it has no rows yet."""
    return seeds if table.isEmpty() else table


def finished(runs: DataFrame, run_id, at: Column, found: int, new: int, error: str | None = None) -> DataFrame:
    """The run log after a run ended: status, counts, duration and an error of 2000 characters at most."""
    hit = F.col("run_id") == run_id
    change = {
        "status": F.lit("failed" if error else "ok"), "items_found": F.lit(found), "items_new": F.lit(new), "error": F.substring(F.lit(error).cast("string"), 1, 2000),
        "duration_ms": ((at.cast("double") - F.col("started_at").cast("double")) * 1000).cast("long"), "finished_at": at,
    }
    return runs.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in change.items()})


def collected_images(listings: DataFrame, column: str = "image_url") -> DataFrame:
    """Rows whose image is still an outside address."""
    return listings.where(F.col(column).startswith("http"))
