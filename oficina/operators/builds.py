"""Builds: slots, totals, per-store baskets, best single offers; alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import dealt
from .prices import sellable

MULTI_SLOTS = ["memory", "storage"]


def set_part(items: DataFrame, build_id, category: str, product_id, listing_id=None) -> DataFrame:
    """Replace all parts of a build's category by one."""
    kept = items.where(~((F.col("build_id") == build_id) & (F.col("category") == category)))
    return kept.unionByName(_row(items, build_id, category, product_id, listing_id))


def add_part(items: DataFrame, build_id, category: str, product_id, listing_id=None) -> DataFrame:
    """One more part; only memory and storage take several."""
    if category not in MULTI_SLOTS:
        raise ValueError(f"{category} takes one part only")
    return items.unionByName(_row(items, build_id, category, product_id, listing_id))


def remove_category(items: DataFrame, build_id, category: str) -> DataFrame:
    return items.where(~((F.col("build_id") == build_id) & (F.col("category") == category)))


def remove_one(items: DataFrame, build_id, category: str, product_id) -> DataFrame:
    """One occurrence of a part (the one with the smallest listing id, nulls first) goes."""
    w = Window.partitionBy("build_id", "category", "product_id").orderBy("listing_id")
    mine = (F.col("build_id") == build_id) & (F.col("category") == category) & (F.col("product_id") == product_id)
    return items.withColumn("__n", F.row_number().over(w)).where(~(mine & (F.col("__n") == 1))).drop("__n")


def _row(items: DataFrame, *values) -> DataFrame:
    schema = items.select("build_id", "category", "product_id", "listing_id").schema
    return items.sparkSession.createDataFrame([values], schema)


def offers_by_store(listings: DataFrame, stores: DataFrame, active_only: bool = True) -> DataFrame:
    """Smallest sellable price of each product in each store."""
    s = stores.where("is_active") if active_only else stores
    return listings.where(sellable()).join(s, "store_id").groupBy("product_id", "slug").agg(F.min("price_cash").alias("price"))


def baskets(items: DataFrame, by_store: DataFrame) -> DataFrame:
    """Per build and store: price of the different products it has, and how many items they cover.

    Two equal parts cover two items but are priced once.
    Neither rows of (build, product) nor of (build, store) shrink within the task that made them, so both are dealt out and aggregated once.
    """
    times = dealt(items.where("product_id IS NOT NULL"), "build_id", "product_id").groupBy("build_id", "product_id").agg(F.count("*").alias("times"))
    total = times.groupBy("build_id").agg(F.sum("times").alias("total_items"))
    out = dealt(times.join(by_store, "product_id"), "build_id").groupBy("build_id", "slug").agg(F.sum("price").alias("total"), F.sum("times").alias("covered_items"))
    return out.join(total, "build_id")


def best_offers(items: DataFrame, listings: DataFrame, stores: DataFrame, by_store: DataFrame) -> DataFrame:
    """Each item with its pinned listing's price if that is in stock, else the cheapest store's (first slug among equals)."""
    pinned = listings.join(stores, "store_id").where("in_stock").select(F.col("listing_id"), F.col("price_cash").alias("pin_price"), F.col("slug").alias("pin_slug"))
    cheap = by_store.groupBy("product_id").agg(F.min(F.struct("price", "slug")).alias("c"))
    # Most items have no pinned listing: they stay out of that join, where their null would be one key.
    rows = items.where("product_id IS NOT NULL")
    with_pin = rows.where("listing_id IS NOT NULL").join(pinned, "listing_id", "left").select(*items.columns, "pin_price", "pin_slug")
    without = rows.where("listing_id IS NULL").select(*items.columns, F.lit(None).cast(pinned.schema["pin_price"].dataType).alias("pin_price"), F.lit(None).cast("string").alias("pin_slug"))
    out = with_pin.unionByName(without).join(cheap, "product_id", "left")
    is_pinned = F.col("pin_slug").isNotNull()
    return out.select(*[F.col(c) for c in items.columns], F.when(is_pinned, F.col("pin_price")).otherwise(F.col("c.price")).alias("price"), F.when(is_pinned, F.col("pin_slug")).otherwise(F.col("c.slug")).alias("store"))


def totals(best: DataFrame) -> DataFrame:
    """Total of a build, items without a price counting 0."""
    return best.groupBy("build_id").agg(F.coalesce(F.sum("price"), F.lit(0)).cast("decimal(22,2)").alias("total"))


# --- alerts -------------------------------------------------------------------------


def confirm(alerts: DataFrame, token: str, now: Column) -> DataFrame:
    hit = F.col("token") == token
    return alerts.withColumns({"confirmed": F.col("confirmed") | hit, "confirmed_at": F.when(hit & F.col("confirmed_at").isNull(), now).otherwise(F.col("confirmed_at"))})


def cancel(alerts: DataFrame, token: str) -> DataFrame:
    return alerts.where(F.col("token") != token)


def create_alert(alerts: DataFrame, rows: list[tuple], spark: SparkSession) -> DataFrame:
    return alerts.unionByName(spark.createDataFrame(rows, alerts.schema))


def due_alerts(alerts: DataFrame, listings: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Confirmed alerts whose target is reached by a sellable listing and that rested for ``hours``, with that listing."""
    cheap = listings.where(sellable()).groupBy("product_id").agg(F.min(F.struct("price_cash", "listing_id")).alias("c"))
    rested = F.col("last_triggered_at").isNull() | (F.col("last_triggered_at") < now - F.expr(f"INTERVAL {int(hours)} HOURS"))
    out = alerts.where(F.col("confirmed") & rested).join(cheap, "product_id").where(F.col("target_price") >= F.col("c.price_cash"))
    return out.select("alert_id", "product_id", F.col("c.listing_id").alias("listing_id"), F.col("c.price_cash").alias("price_at_trigger"))


def stamped(alerts: DataFrame, fired: DataFrame, now: Column) -> DataFrame:
    """Alerts after the fired ones were stamped and counted."""
    hit = fired.select("alert_id", F.lit(True).alias("__hit")).distinct()
    out = alerts.join(hit, "alert_id", "left")
    return out.withColumns({"last_triggered_at": F.when(F.col("__hit"), now).otherwise(F.col("last_triggered_at")), "trigger_count": F.col("trigger_count") + F.coalesce(F.col("__hit").cast("int"), F.lit(0))}).drop("__hit")
