"""Catalog questions: search, detail, store counts, latest run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prices import sellable


# Categories in the order in which they are shown.
CATEGORY_ORDER = ["cpu", "motherboard", "gpu", "memory", "storage", "psu", "case", "cooler"]


def display_order(category: Column) -> Column:
    """A category's place in lists, from 1; unknown ones come last, by null."""
    return F.nullif(F.array_position(F.lit(CATEGORY_ORDER), category), F.lit(0))


def in_display_order(items: DataFrame, by: str, *then: str) -> DataFrame:
    """Adds ``position``, from 1, of each row of ``by`` (a build, a cart): by its category's place, then by the columns named."""
    w = Window.partitionBy(by).orderBy(display_order(F.col("category")).asc_nulls_last(), *then)
    return items.withColumn("position", F.row_number().over(w))


def priced(products: DataFrame, listings: DataFrame) -> DataFrame:
    """Products with min_price (sellable listings) and in_stock_listings (price or not)."""
    agg = listings.groupBy("product_id").agg(F.min(F.when(sellable(), F.col("price_cash"))).alias("min_price"), F.count_if("in_stock").alias("in_stock_listings"))
    return products.join(agg, "product_id", "left").withColumn("in_stock_listings", F.coalesce("in_stock_listings", F.lit(0)))


def having_attribute(products: DataFrame, attributes: DataFrame, key: str, value: str) -> DataFrame:
    """Products with an attribute whose text equals the value, spaces aside."""
    plain = F.replace(F.col("value_text"), F.lit(" "), F.lit(""))
    hit = attributes.where((F.col("key") == key) & ((F.col("value_text") == value) | (plain == value.replace(" ", ""))))
    return products.join(hit, "product_id", "left_semi")


ORDERS = {
    "price_asc": [F.asc, "min_price"],
    "price_desc": [F.desc, "min_price"],
    "name": [F.asc, "name"],
    "newest": [F.desc, "created_on"],
}


def search(
    products: DataFrame, listings: DataFrame, attributes: DataFrame | None = None, category: str | None = None, brand: str | None = None,
    q: str | None = None, attrs: dict[str, str] | None = None, min_price: float | None = None, max_price: float | None = None,
    ids: DataFrame | None = None, sort: str = "price_asc", limit: int = 50, offset: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """(all matches, the page): filters, then the price range over the aggregated price, then order and page.

    ``q`` is a case-blind pattern in which % and _ act as wildcards. ``ids`` keeps
    products of a compatible set. Products without a price are left out.
    """
    p = products
    if category:
        p = p.where(F.col("category") == category)
    if brand:
        p = p.where(F.col("brand") == brand)
    if q:
        p = p.where(F.col("name").ilike(f"%{q}%"))
    for key, value in (attrs or {}).items():
        p = having_attribute(p, attributes, key, value)
    if ids is not None:
        p = p.join(ids.select("product_id"), "product_id", "left_semi")
    p = priced(p, listings).where("min_price IS NOT NULL")
    if min_price is not None:
        p = p.where(F.col("min_price") >= F.lit(min_price).cast("decimal(12,2)"))
    if max_price is not None:
        p = p.where(F.col("min_price") <= F.lit(max_price).cast("decimal(12,2)"))
    way, col = ORDERS.get(sort, ORDERS["price_asc"])
    return p, p.orderBy(way(col), "product_id").offset(max(0, offset)).limit(max(1, min(limit, 5000)))


def detail(products: DataFrame, attributes: DataFrame, listings: DataFrame) -> DataFrame:
    """Each product with its specs and listings as nested arrays (empty, not null, without any)."""
    specs = attributes.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("key", "value_text", "source"))).alias("specs"))
    offers = listings.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("listing_id", "store_id", "price_cash", "in_stock"))).alias("listings"))
    out = products.join(specs, "product_id", "left").join(offers, "product_id", "left")
    return out.withColumns({"specs": F.coalesce("specs", F.array()), "listings": F.coalesce("listings", F.array())})


def store_counts(stores: DataFrame, listings: DataFrame) -> DataFrame:
    """Active stores with the number of different products they list (0 without any)."""
    n = listings.groupBy("store_id").agg(F.count_distinct("product_id").alias("products"))
    return stores.where("is_active").join(n, "store_id", "left").select("store_id", "slug", F.coalesce("products", F.lit(0)).alias("products"))


def latest_per_store(runs: DataFrame, at: str, *values: str) -> DataFrame:
    """The latest row of each store by time (then by the values, largest first)."""
    return runs.groupBy("store_id").agg(F.max(F.struct(at, *values)).alias("r")).select("store_id", "r.*")


def stale_batch(listings: DataFrame, at: str, now: Column, days: int, seen: str, limit: int = 50) -> DataFrame:
    """The next listings to visit: stale ones, newest seen first, a batch of 1 to 200."""
    return stale(listings, at, now, days).orderBy(F.desc_nulls_last(seen), "listing_id").limit(max(1, min(limit, 200)))


def stale(listings: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    """Listings never visited or last visited more than ``days`` days ago."""
    return listings.where(F.col(at).isNull() | (F.col(at) < F.date_sub(now, days)))
