"""From raw listings to catalog tables: dedup, resolution, upserts, attributes, noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.specs import extract, value_bool, value_num
from ..functions.noise import is_noise
from ..functions.text import brand, chip_id, clean_title, match_key, normalize_part_number, part_number
from ..sources.shared import cut, dealt
from .prices import price_drops

# Precedence of attribute sources.
PRECEDENCE = {"reference": 0, "title": 1, "page": 2, "manual": 3}
OTHER = 1


def keep_first(items: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in arrival order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return items.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def resolve(items: DataFrame, known_skus: DataFrame, known_parts: DataFrame, known_keys: DataFrame, rounds: int = 50) -> DataFrame:
    """Adds product_id and is_new to a batch of items (seq, store_id, store_sku, part_number, match_key).

    A known (store, SKU) decides, then a known part number, then a known match key. Where items have a ``category``, so
    have the known tables, and nothing is matched across categories.
    The others are resolved within the batch as if taken in ``seq`` order: an item makes a new product,
    named after its seq, unless an earlier maker has its part number or, failing
    that, its match key.

    Only the first item of each pair of keys can be a maker, so makers are looked for among those pairs, in rounds: an open pair that is the
    earliest by both its keys makes a product, and the pairs that share a key with it are closed. How often a pair is repeated adds no
    round. Then every item takes the earlier maker of its part number, else of its match key.
    """
    # An item without a key gets one of its own, so that null keys neither meet nor gather in one task.
    own = F.concat(F.lit("\u0000"), F.col("seq").cast("string"))
    within = ["category"] if "category" in items.columns else []
    keyed = lambda c: F.concat(*[x for w in within for x in (F.coalesce(w, F.lit("")), F.lit("\u0001"))], c)
    base = items.withColumns({"__a": F.coalesce(keyed(normalize_part_number(F.col("part_number"))), own), "__b": F.coalesce(keyed(F.col("match_key")), own)})
    base = base.join(known_skus.select(*within, "store_id", "store_sku", F.col("product_id").alias("__s")), [*within, "store_id", "store_sku"], "left")
    base = base.join(known_parts.select(keyed(F.col("part_number")).alias("__a"), F.col("product_id").alias("__p")), "__a", "left")
    base = base.join(known_keys.select(keyed(F.col("match_key")).alias("__b"), F.col("product_id").alias("__k")), "__b", "left")
    base = cut(base.select("seq", *[c for c in items.columns if c != "seq"], "__a", "__b", F.coalesce("__s", "__p", "__k").cast("string").alias("__known")))
    shared = lambda key: F.when(F.col(key) != own, F.col(key)).alias(key)
    pairs = base.where((F.col("__known").isNull()) & ((F.col("__a") != own) | (F.col("__b") != own))).select("seq", shared("__a"), shared("__b"))
    pairs = pairs.groupBy("__a", "__b").agg(F.min("seq").alias("seq"))
    todo = cut(pairs.select("seq", F.coalesce("__a", own).alias("__a"), F.coalesce("__b", own).alias("__b")))
    made = todo.limit(0)
    for _ in range(rounds):
        if todo.isEmpty():
            break
        # Only semi and anti joins: Spark multiplies the estimated sizes of the sides of others, and such products would grow without bound over the rounds.
        first = lambda key: todo.groupBy(key).agg(F.min("seq").alias("seq"))  # noqa: B023, E731
        makers = cut(todo.join(first("__a"), ["__a", "seq"], "left_semi").join(first("__b"), ["__b", "seq"], "left_semi").select("seq", "__a", "__b"))
        # Every round is a checkpoint, so this union of rounds stays flat.
        made = made.unionByName(makers)
        todo = cut(todo.join(makers.select("__a"), "__a", "left_anti").join(makers.select("__b"), "__b", "left_anti").select("seq", "__a", "__b"))
    else:
        if not todo.isEmpty():
            raise RuntimeError("resolution did not settle")
    name = lambda seq: F.concat(F.lit("new-"), F.col(seq).cast("string"))
    out = base.join(made.select("__a", F.col("seq").alias("__by_a")), "__a", "left").join(made.select("__b", F.col("seq").alias("__by_b")), "__b", "left")
    earlier = F.coalesce(*[F.when(F.col(by) < F.col("seq"), name(by)) for by in ("__by_a", "__by_b")])
    found = F.coalesce("__known", earlier)
    return out.select("seq", *[c for c in items.columns if c != "seq"], F.coalesce(found, name("seq")).alias("product_id"), found.isNull().alias("is_new"))


def reference_specs(items: DataFrame, reference: DataFrame, *keep: str) -> DataFrame:
    """(product_id, key, value_text, source) for items (product_id, category, title) whose chip a reference table knows.

    ``reference`` has (category, chip_id, name, launch, specs map); name and launch become attributes too.
    """
    known = items.withColumn("chip_id", chip_id(F.col("category"), F.col("title"))).where("chip_id IS NOT NULL").join(reference, ["category", "chip_id"])
    own = F.map_filter(F.create_map(F.lit("reference_model"), F.col("name"), F.lit("launch"), F.col("launch")), lambda _, v: v.isNotNull() & (v != ""))
    pairs = F.concat(F.map_entries(F.map_filter(own, lambda k, _: ~F.map_contains_key("specs", k))), F.map_entries("specs"))
    return known.select("product_id", *keep, F.explode(pairs).alias("p")).select("product_id", *keep, F.col("p.key").alias("key"), F.col("p.value").alias("value_text"), F.lit("reference").alias("source"))


#: What a listing takes from each new observation, and what only fills a gap.
OBSERVED = ["product_id", "url", "title", "price_cash", "price_card", "installments", "installment_text", "in_stock"]
FIRST_SEEN = ["thumbnail"]


def known(listings: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The anchors of ``resolve``, from the tables as they stand: (store, SKU), part numbers and models, by category.

    Of products that share an anchor the one with the smallest id counts.
    """
    by = lambda key, name: products.where(F.col(key).isNotNull()).groupBy("category", F.col(key).alias(name)).agg(F.min("product_id").alias("product_id"))
    skus = listings.select("store_id", "store_sku", "product_id").join(products.select("product_id", "category"), "product_id")
    return skus, by("part_number", "part_number"), by("model", "match_key")


def arrivals(raw: DataFrame, noise: bool = True) -> DataFrame:
    """Raw listings without noise (unless it was taken out before), of a (store, SKU) the first, with the keys that products are matched by."""
    kept = raw.where(~F.coalesce(is_noise(F.col("category"), F.col("title")), F.lit(False))) if noise else raw
    first = keep_first(kept, ["store_id", "store_sku"], ["seq"])
    return first.withColumns({"match_key": match_key(F.col("title")), "part_number": part_number(F.col("title"))})


def run(
    raw: DataFrame, known_skus: DataFrame, known_parts: DataFrame, known_keys: DataFrame, listings: DataFrame,
    products: DataFrame | None = None, history: DataFrame | None = None, attributes: DataFrame | None = None, reference: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """One batch from raw listings to tables. What is known comes from ``known`` or, without moving the catalog, from ``anchors.lookup``.

    ``raw`` has (seq, store_id, store_sku, category, title, maker, price_cash, in_stock) and any of url, thumbnail, price_card,
    installments, installment_text. Noise goes, of a (store, SKU) the first arrival stays, items are resolved to products of their
    category, and listings are upserted. ``changes`` are the listings whose price or stock differs from before.

    With ``products`` (product_id, category, brand, model, name, part_number, image_url) ``catalog`` is that table after the batch;
    with ``history`` (store_id, product_id, price_cash, in_stock) ``drops`` are the products under their store's lowest price; with
    ``attributes`` (product_id, key, value_text, source) ``attributes`` is that table after the batch and ``attribute_changes`` how
    often each value changed, by the title and, with ``reference``, by the chip.
    """
    resolved = cut(resolve(arrivals(raw), known_skus, known_parts, known_keys))
    observed, first_seen = ([c for c in cols if c in resolved.columns] for cols in (OBSERVED, FIRST_SEEN))
    now = resolved.select("store_id", "store_sku", *observed, *first_seen)
    missing = {c: F.lit(None).cast(now.schema[c].dataType) for c in [*observed, *first_seen] if c not in listings.columns}
    after = upsert(listings.withColumns(missing), now, ["store_id", "store_sku"], observed, first_seen)
    before = listings.select("store_id", "store_sku", F.struct("price_cash", "in_stock").alias("__old"))
    changes = now.join(before, ["store_id", "store_sku"], "left").where(~F.struct("price_cash", "in_stock").eqNullSafe(F.col("__old"))).drop("__old")
    out = {"resolved": resolved, "products": new_products(resolved), "listings": after, "changes": changes, "review": review_queue(resolved)}
    if products is not None:
        out["catalog"] = updated_products(products, resolved)
    if history is not None:
        out["drops"] = price_drops(now, history)
    if attributes is not None:
        derived = derived_attributes(resolved, reference)
        out["attributes"] = merge_attributes(attributes.withColumn("seq", F.lit(-1).cast("long")).unionByName(derived))
        out["attribute_changes"] = attribute_changes(attributes, derived)
    return out


def updated_products(products: DataFrame, resolved: DataFrame) -> DataFrame:
    """The product table after a batch: new products are added; every product that an item was resolved to takes the last
    item's name, and the first image and part number where it has none."""
    image = F.col("thumbnail") if "thumbnail" in resolved.columns else F.lit(None).cast("string")
    items = resolved.withColumns({"__image": image, "__part": normalize_part_number(F.col("part_number")), "__made": F.when(F.col("is_new"), F.struct("category", brand(F.col("maker"), F.col("title")).alias("brand"), F.coalesce("match_key", "product_id").alias("model")))})
    earliest = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    seen = items.groupBy("product_id").agg(F.max_by(clean_title(F.col("title")), "seq").alias("n"), earliest("__image").alias("i"), earliest("__part").alias("p"), earliest("__made").alias("m"))
    both = products.alias("o").join(seen.alias("s"), "product_id", "full").where(F.col("o.name").isNotNull() | F.col("o.category").isNotNull() | F.col("m").isNotNull())
    pick = lambda c, new: F.coalesce(F.col(f"o.{c}"), new).alias(c)
    return both.select(
        "product_id", pick("category", F.col("m.category")), pick("brand", F.col("m.brand")), pick("model", F.col("m.model")),
        F.coalesce("n", "o.name").alias("name"), pick("part_number", F.col("p")), pick("image_url", F.col("i")),
    )


def derived_attributes(resolved: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """(product_id, key, value_text, source, seq) that a batch says of its products: by the title and, with a table, by the chip."""
    own = resolved.select("product_id", "seq", F.explode(extract(F.col("category"), F.col("title"))).alias("key", "value_text")).where("value_text IS NOT NULL")
    out = own.select("product_id", "key", F.col("value_text").cast("string").alias("value_text"), F.lit("title").alias("source"), F.col("seq").cast("long").alias("seq"))
    if reference is None:
        return out
    chips = reference_specs(resolved.select("product_id", "category", "title", "seq"), reference, "seq")
    return out.unionByName(chips.select("product_id", "key", "value_text", "source", F.col("seq").cast("long").alias("seq")))


def attribute_changes(attributes: DataFrame, derived: DataFrame) -> DataFrame:
    """(product_id, key, changes): how often a value changes when ``derived`` rows are applied to a table in the order of seq.

    A row counts if its source stands as high as every one before it; it is a change if its text differs from that of the last that counted.
    Within an item the lower source comes first. Texts are compared as they are kept, cut at 256 characters.
    """
    level = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PRECEDENCE.items() for x in kv]), F.col("source")), F.lit(OTHER))
    rows = attributes.select("product_id", "key", "value_text", "source", F.lit(-1).cast("long").alias("seq")).unionByName(derived)
    rows = rows.where("value_text <> ''").withColumns({"__level": level, "__text": F.substring("value_text", 1, 256)})
    order = Window.partitionBy("product_id", "key").orderBy("seq", "__level")
    counted = rows.withColumn("__top", F.max("__level").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("__level >= __top")
    changed = counted.withColumn("__before", F.lag("__text").over(order)).where((F.col("seq") >= 0) & ~F.col("__text").eqNullSafe(F.col("__before")))
    return changed.groupBy("product_id", "key").agg(F.count("*").alias("changes"))


def new_products(resolved: DataFrame) -> DataFrame:
    """Rows for the products that a batch made."""
    made = resolved.where("is_new")
    return made.select("product_id", "category", brand(F.col("maker"), F.col("title")).alias("brand"), F.coalesce("match_key", "product_id").alias("model"), clean_title(F.col("title")).alias("name"), normalize_part_number(F.col("part_number")).alias("part_number"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], overwrite: list[str], fill: list[str]) -> DataFrame:
    """Full outer upsert: ``overwrite`` columns take the new value where the key came again (null too), ``fill`` columns only fill nulls."""
    o, n = old.alias("o"), new.withColumn("__in", F.lit(True)).alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    both = o.join(n, cond, "full")
    pick = {k: F.coalesce(f"o.{k}", f"n.{k}") for k in keys}
    pick |= {c: F.when(F.col("n.__in"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) for c in overwrite}
    pick |= {c: F.coalesce(f"o.{c}", f"n.{c}") for c in fill}
    return both.select(*[v.alias(k) for k, v in pick.items()])


def merge_attributes(rows: DataFrame) -> DataFrame:
    """One row per (product, key): the highest source wins, the latest among equals; blank values are skipped.

    Text is cut at 256 characters; number and truth value stand beside it where the text is one.
    The aggregate sorts, since its buffer holds texts. A narrow product table is few files, so rows are dealt out before it and not sorted by the task that made them.
    """
    level = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PRECEDENCE.items() for x in kv]), F.col("source")), F.lit(OTHER))
    best = dealt(rows.where(F.trim("value_text") != ""), "product_id", "key").groupBy("product_id", "key").agg(F.max_by(F.struct(F.substring("value_text", 1, 256).alias("value_text"), "source"), F.struct(level, "seq")).alias("v"))
    out = best.select("product_id", "key", "v.*")
    return out.withColumns({"value_num": value_num(F.col("value_text")), "value_bool": value_bool(F.col("value_text"))})


def backfill(attributes: DataFrame, derived: DataFrame) -> DataFrame:
    """Derived (product_id, key, value_text) rows whose product lacks the key."""
    return derived.where("value_text IS NOT NULL").join(attributes, ["product_id", "key"], "left_anti")


def review_queue(resolved: DataFrame) -> DataFrame:
    """New processors and cards that have neither a part number nor a match key."""
    return resolved.where(F.col("is_new") & F.col("category").isin("cpu", "gpu") & F.col("part_number").isNull() & F.col("match_key").isNull()).withColumn("reason", F.lit("no_anchor"))


def noise_report(titles: DataFrame, noise: Column) -> DataFrame:
    """Dry run of the cleanup: noisy titles by category, with one as a sample."""
    return titles.where(noise).groupBy("category").agg(F.count("*").alias("n"), F.min("title").alias("sample"))
