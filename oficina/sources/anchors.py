"""A standing index of what products are known by, so that a batch finds its products without moving the catalog.

One table, bucketed by ``key`` and partitioned by ``batch``, with a row for each anchor:

* a (store, SKU): the product that its listing shows, and that product's category; the row of the latest batch counts;
* a (category, part number) and a (category, model): of several products the one with the smallest id counts;
* a product that has a part number, so that a later batch gives it no second one.

A batch looks its own keys up (only they are shuffled, into the table's buckets), is resolved against what was found, and adds the
anchors that are new. It sees the batches before it only and overwrites its own partition, so a batch that is repeated, or was
interrupted, finds and writes the same rows. Batches have to be numbered in order.

Defined results: an item without a part number or match key asks for none; a null store, SKU or category is a value
like others; a batch that adds no anchor leaves an empty partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_part_number
from .shared import cut
from .tables import exists

#: Buckets of the index. They belong to the table: one file of each is read by one task of the lookup.
BUCKETS = 64
_SKU, _PART, _MODEL, _NUMBERED = "sku", "part", "model", "numbered"


def _key(kind: str, *values: Column) -> Column:
    """A kind and its values as one text; null and empty values stay apart, and no value runs into the next."""
    texts = [F.coalesce(F.concat(F.length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.concat_ws(" ", F.lit(kind), *texts)


def sku_key() -> Column:
    return _key(_SKU, F.col("store_id"), F.col("store_sku"))


def create(spark: SparkSession, name: str, path: str, buckets: int = BUCKETS) -> None:
    """Register the index that lies (or will lie) under ``path`` as table ``name``."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (key STRING, product_id STRING, category STRING, batch BIGINT) USING parquet "
        f"PARTITIONED BY (batch) CLUSTERED BY (key) INTO {int(buckets)} BUCKETS LOCATION '{path}'"
    )
    if exists(spark, path):
        spark.sql(f"MSCK REPAIR TABLE {name}")


def _write(rows: DataFrame, name: str, batch: int) -> None:
    spark = rows.sparkSession
    buckets = int(next(r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect() if r.col_name == "Num Buckets"))
    # A task holds whole buckets, so each bucket gets one file of a batch.
    rows = rows.select("key", "product_id", "category").repartition(buckets, "key")
    spark.sql(f"INSERT OVERWRITE TABLE {name} PARTITION (batch = {int(batch)}) SELECT * FROM {{rows}}", rows=rows)


def seed(products: DataFrame, listings: DataFrame, name: str, batch: int = 0) -> None:
    """Write the anchors of a catalog as it stands, once."""
    own = products.where("part_number IS NOT NULL")
    shown = listings.select("store_id", "store_sku", "product_id").join(products.select("product_id", "category"), "product_id")
    rows = shown.select(sku_key().alias("key"), "product_id", "category")
    rows = rows.unionByName(own.select(_key(_PART, F.col("category"), F.col("part_number")).alias("key"), "product_id", "category"))
    rows = rows.unionByName(products.where("model IS NOT NULL").select(_key(_MODEL, F.col("category"), F.col("model")).alias("key"), "product_id", "category"))
    rows = rows.unionByName(own.select(_key(_NUMBERED, F.col("product_id")).alias("key"), "product_id", "category"))
    _write(rows, name, batch)


def _found(keys: DataFrame, name: str, batch: int) -> DataFrame:
    """The anchors of the keys asked for: smallest product of each key, and the row of the latest batch."""
    index = keys.sparkSession.table(name).where(F.col("batch") < batch)
    # Buckets lie by key already, so neither the join nor the aggregate moves the index.
    met = index.join(keys.distinct(), "key", "left_semi")
    return met.groupBy("key").agg(F.min("product_id").alias("smallest"), F.max_by(F.struct("product_id", "category"), F.struct("batch", "product_id")).alias("latest"))


def lookup(items: DataFrame, name: str, batch: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(SKUs, part numbers, match keys) that a batch's items ask for, in the form that ``ingest.resolve`` takes.

    ``items`` has store_id, store_sku, category, part_number and match_key. All three are as large as the batch at most.
    """
    part = normalize_part_number(F.col("part_number"))
    asked = items.select(
        "store_id", "store_sku", "category", part.alias("part_number"), "match_key", sku_key().alias("s"),
        F.when(part.isNotNull(), _key(_PART, F.col("category"), part)).alias("p"), F.when(F.col("match_key").isNotNull(), _key(_MODEL, F.col("category"), F.col("match_key"))).alias("m"),
    )
    hits = _found(asked.select(F.explode(F.array("s", "p", "m")).alias("key")).where("key IS NOT NULL"), name, batch)
    skus = asked.select("store_id", "store_sku", F.col("s").alias("key")).distinct().join(hits, "key").select("latest.category", "store_id", "store_sku", "latest.product_id")
    parts = asked.select("category", "part_number", F.col("p").alias("key")).distinct().join(hits, "key").select("category", "part_number", F.col("smallest").alias("product_id"))
    models = asked.select("category", "match_key", F.col("m").alias("key")).distinct().join(hits, "key").select("category", "match_key", F.col("smallest").alias("product_id"))
    return skus, parts, models


def extend(resolved: DataFrame, name: str, batch: int) -> None:
    """Add the anchors of a resolved batch (``ingest.resolve`` over items with category, part_number and match_key)."""
    part = normalize_part_number(F.col("part_number"))
    shown = resolved.groupBy("store_id", "store_sku").agg(F.max_by(F.struct("product_id", "category"), "seq").alias("v")).select(sku_key().alias("key"), "v.*")
    made = resolved.where("is_new").select(_key(_MODEL, F.col("category"), F.coalesce("match_key", "product_id")).alias("key"), "product_id", "category")
    first = resolved.where(part.isNotNull()).groupBy("product_id").agg(F.min_by(F.struct(part.alias("part_number"), "category"), "seq").alias("v"))
    first = first.select("product_id", "v.*", _key(_NUMBERED, F.col("product_id")).alias("numbered"))
    before = cut(_found(first.select(F.col("numbered").alias("key")).unionByName(shown.select("key")), name, batch))
    first = first.join(before.select(F.col("key").alias("numbered")), "numbered", "left_anti")
    same = F.struct("product_id", "category").eqNullSafe(F.col("latest"))
    rows = shown.join(before, "key", "left").where(~same).select("key", "product_id", "category")
    rows = rows.unionByName(made)
    rows = rows.unionByName(first.select(_key(_PART, F.col("category"), F.col("part_number")).alias("key"), "product_id", "category"))
    rows = rows.unionByName(first.select(F.col("numbered").alias("key"), "product_id", "category"))
    # ``before`` is a checkpoint: a table is not written by a plan that reads it.
    _write(rows, name, batch)
