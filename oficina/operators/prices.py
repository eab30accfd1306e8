"""Price history, daily rollup, insights, offers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import differing_in_order

RAW_DAYS = 90
DAILY_MONTHS = 24
#: A price under this share (in %) of the 30-day median is an anomaly.
ANOMALY = 85


def sellable() -> Column:
    return F.col("in_stock") & F.col("price_cash").isNotNull()


def differing(rows: DataFrame, part: str, order: list[str]) -> DataFrame:
    """Rows of each listing whose price or stock differs from the row before, by ``part`` and then ``order``.

    Rows are compared within a part, and the first of a part with the last of the part before, so that a
    listing with very many rows is dealt out by its parts.
    """
    now = F.struct("price_cash", "in_stock")
    within = Window.partitionBy("listing_id", part).orderBy(*order)
    out = rows.withColumns({"__n": F.row_number().over(within), "__before": F.lag(now).over(within)})
    ends = rows.groupBy(F.col("listing_id").alias("__l"), F.col(part).alias("__p")).agg(F.max_by(now, F.struct(*order)).alias("__last"))
    ends = ends.select("__l", "__p", F.lag("__last").over(Window.partitionBy("__l").orderBy("__p")).alias("__prev"))
    out = out.join(ends, F.col("listing_id").eqNullSafe(F.col("__l")) & F.col(part).eqNullSafe(F.col("__p")))
    before = F.when(F.col("__n") == 1, F.col("__prev")).otherwise(F.col("__before"))
    return out.where(~before.eqNullSafe(now)).select(*rows.columns)


def changes_only(history: DataFrame) -> DataFrame:
    """The observations of each listing that differ in price or stock from the one before; null prices become 0."""
    kept = differing(history, "day", ["collected_at", "event_id"])
    return kept.withColumn("price_cash", F.coalesce("price_cash", F.lit(0).cast("decimal(12,2)")))


def changes_by_ranges(history: DataFrame) -> DataFrame:
    """As ``changes_only``, by one shuffle into ranges of (listing, time): for listings that hold very many rows of a day."""
    kept = differing_in_order(history, "listing_id", ["price_cash", "in_stock"], ["collected_at", "event_id"])
    return kept.withColumn("price_cash", F.coalesce("price_cash", F.lit(0).cast("decimal(12,2)")))


def daily_minimum(history: DataFrame, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """(product, day) with its smallest positive in-stock price and the listing that had it (smallest id among equals)."""
    rows = history.where(F.col("in_stock") & (F.col("price_cash") > 0))
    if since is not None:
        rows = rows.where(F.col("day") >= since)
    if until is not None:
        rows = rows.where(F.col("day") <= until)
    best = F.min(F.struct("price_cash", "listing_id"))
    return rows.groupBy("product_id", "day").agg(best.alias("b")).select("product_id", "day", F.col("b.price_cash").alias("min_price"), F.col("b.listing_id").alias("listing_id"))


def upsert_daily(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rollup after recomputed days replace the old rows of the same product and day."""
    return old.join(new, ["product_id", "day"], "left_anti").unionByName(new)


def retained(history: DataFrame, daily: DataFrame, today: Column) -> tuple[DataFrame, DataFrame]:
    """Raw rows of the last 90 days and daily rows of the last 24 months."""
    raw = history.where(F.col("day") >= F.date_sub(today, RAW_DAYS))
    return raw, daily.where(F.col("day") >= F.add_months(today, -DAILY_MONTHS))


def price_series(history: DataFrame) -> DataFrame:
    """Smallest raw price of each product and day, in stock or not."""
    return history.groupBy("product_id", "day").agg(F.min("price_cash").alias("min_price"))


def recent_series(daily: DataFrame, today: Column, days: int = 90) -> DataFrame:
    """A daily series over the last 1 to 365 days, oldest first within a product."""
    return daily.where(F.col("day") >= F.date_sub(today, max(1, min(days, 365))))


def insights(series: DataFrame, price: str = "min_price") -> DataFrame:
    """One row per product of a daily series: current price, drops over 1 and 7 days,
    "lowest in N days" and the anomaly flag. One shuffle; a product's series is at most its retained days."""
    s = series.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("day", F.col(price).alias("p")))).alias("s"))
    s = s.withColumns({"cur": F.element_at("s", -1), "past": F.slice("s", F.lit(1), F.size("s") - 1)})
    start = lambda days: F.get(F.filter("past", lambda x: x["day"] >= F.date_sub(F.col("cur.day"), days)), F.lit(0))["p"]
    s = s.withColumns({
        "price_24h": start(1), "price_7d": start(7),
        "lower": F.array_max(F.transform(F.filter("past", lambda x: x["p"] < F.col("cur.p")), lambda x: x["day"])),
        "w": F.array_sort(F.transform(F.filter("s", lambda x: x["day"] >= F.date_sub(F.col("cur.day"), 30)), lambda x: x["p"])),
    })
    since = F.get(F.filter("past", lambda x: F.col("lower").isNull() | (x["day"] > F.col("lower"))), F.lit(0))["day"]
    n = F.size("w")
    # Twice the median, so that no digit is lost: 200 * current < 85 * (low + high).
    twice = F.element_at("w", F.floor((n + 1) / 2).cast("int")) + F.element_at("w", (F.floor(n / 2) + 1).cast("int"))
    drop = lambda c: F.when(F.col(c) > 0, (F.col(c).cast("double") - F.col("cur.p").cast("double")) / F.col(c).cast("double"))
    return s.select(
        "product_id", F.col("cur.day").alias("day"), F.col("cur.p").alias("current_price"), "price_24h", "price_7d",
        drop("price_24h").alias("drop_24h"), drop("price_7d").alias("drop_7d"),
        F.coalesce(F.datediff(F.col("cur.day"), since) + 1, F.lit(0)).alias("lowest_in_days"),
        ((n >= 3) & (twice > 0) & (200 * F.col("cur.p") < ANOMALY * twice)).alias("is_anomaly"),
    )


def offers(daily: DataFrame, listings: DataFrame, today: Column, period: str = "7d", limit: int = 30, min_price: float | None = None) -> DataFrame:
    """Products whose price fell in the period, largest drop first (a top-k report of 1 to 100 rows)."""
    current = listings.where(sellable()).groupBy("product_id").agg(F.min("price_cash").alias("now"))
    if min_price is not None:
        current = current.where(F.col("now") >= F.lit(min_price).cast("decimal(12,2)"))
    recent = daily.where(F.col("day") >= F.date_sub(today, 30)).join(current, "product_id", "left_semi").select("product_id", "day", "min_price")
    # Only products that have a series get today's price as its last point, if it has none yet.
    missing = recent.groupBy("product_id").agg(F.max("day").alias("last")).where(F.col("last") < today)
    added = missing.join(current, "product_id").select("product_id", today.alias("day"), F.col("now").alias("min_price"))
    found = insights(recent.unionByName(added))
    drop = "drop_24h" if period == "24h" else "drop_7d"
    return found.where(F.col(drop) > 0).orderBy(F.desc(drop), "product_id").limit(max(1, min(limit, 100)))


def price_drops(batch: DataFrame, history: DataFrame) -> DataFrame:
    """(store_id, product_id) of a batch that are in stock under the smallest in-stock price that their store has had so far.

    ``history`` is as of the batch's start, so a drop within the batch is no baseline for the next row of it.
    """
    base = history.where(sellable()).groupBy("store_id", "product_id").agg(F.min("price_cash").alias("lowest"))
    return batch.where(sellable()).join(base, ["store_id", "product_id"]).where("price_cash < lowest").select("store_id", "product_id").distinct()
