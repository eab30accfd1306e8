"""Further registered queries: other orders and filters of the catalog, product pages, one ingest batch, builds and alerts as tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import specs, text
from ..operators import builds, catalog, compatibility, ingest, paging, prices, runs, search, spec_sheet
from ..sources import anchors, bindings, pages, tables
from ..sources.bindings import table, view
from ..sources.shared import cut, dealt, own_folder
from .queries import _COMPAT, _MATCH, _N, _NOISE, _PART, _PRICED, _first_build, _parts, query, today

_P = _PRICED + " SELECT product_id, name, created_on, min_price FROM p WHERE min_price IS NOT NULL"


def _search(spark, sf, **asked):
    return catalog.search(view(spark, sf, "products"), view(spark, sf, "listings"), **asked)


@query(_P + " AND category = 'cpu' AND brand = 'Brand#13' ORDER BY created_on DESC, product_id LIMIT 40", created_on="d", min_price="n")
def catalog_newest(spark, sf):
    """FLT2, SRT1: a category and a brand, newest first."""
    return _search(spark, sf, category="cpu", brand="Brand#13", sort="newest", limit=40)[1].select("product_id", "name", "created_on", "min_price")


@query(_P + " AND product_id IN (SELECT l_partkey % 50 FROM lineitem WHERE l_quantity > 30) ORDER BY name, product_id LIMIT 60 OFFSET 2", created_on="d", min_price="n")
def catalog_by_name(spark, sf):
    """FLT9, JN4, SRT1: only products of a compatible set, by name."""
    ids = table(spark, sf, "lineitem").where("l_quantity > 30").select((F.col("l_partkey") % 50).alias("product_id"))
    return _search(spark, sf, ids=ids, sort="name", limit=60, offset=2)[1].select("product_id", "name", "created_on", "min_price")


@query(_PRICED + " SELECT category, count(*) AS total FROM p WHERE min_price IS NOT NULL AND min_price >= 5 GROUP BY category")
def catalog_totals(spark, sf):
    """AGG12: how many products a search matches, beside its page."""
    return _search(spark, sf, min_price=5, limit=1)[0].groupBy("category").agg(F.count("*").alias("total"))


@query(bindings.sql("listings") + " SELECT listing_id, last_seen_at FROM listings WHERE last_seen_at < DATE '2024-01-30' ORDER BY last_seen_at DESC, listing_id LIMIT 80", last_seen_at="d")
def stale_batch(spark, sf):
    """SRT5, FLT16: the next batch of listings to visit, newest seen first (a limited batch by feature)."""
    return catalog.stale_batch(view(spark, sf, "listings"), "last_seen_at", today(), 0, "last_seen_at", 80).select("listing_id", "last_seen_at")


@query(bindings.sql("history") + " SELECT product_id, day, min(price_cash) AS min_price FROM history WHERE in_stock AND price_cash > 0 AND day >= DATE '2024-01-30' - 10 GROUP BY product_id, day", day="d", min_price="n")
def recent_series(spark, sf):
    """FLT16: the daily series over a number of days."""
    return prices.recent_series(prices.daily_minimum(view(spark, sf, "history")), today(), 10).select("product_id", "day", "min_price")


@query("SELECT p_partkey AS product_id, CASE p_size % 3 WHEN 0 THEN 'DDR5|ddr4' WHEN 1 THEN 'ddr4' ELSE 'Ddr4|DDR5' END AS kinds, 'a&ç ã€\"' AS shown FROM part")
def text_folds(spark, sf):
    """SET4, SRC7: different texts case aside, first spelling first; character references."""
    size = F.col("p_size")
    values = F.when(size % 3 == 0, F.array(F.lit("DDR5"), F.lit("ddr4"), F.lit("ddr5"))).when(size % 3 == 1, F.array(F.lit("ddr4"), F.lit("DDR4"))).otherwise(F.array(F.lit("Ddr4"), F.lit("DDR5"), F.lit("DDR4")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("product_id"), F.array_join(specs.distinct_fold(values), "|").alias("kinds"), pages.unescaped(F.lit("a&amp;&ccedil; &#227;&#x20AC;&quot;")).alias("shown"))


@query("""WITH e AS (SELECT p_partkey AS page_id, unnest([{'k': 'memory_gb', 'v': CAST(8 + p_size AS VARCHAR)}, {'k': 'memory_type', 'v': 'gddr7'}, {'k': 'interface', 'v': 'pcie5'},
  {'k': 'power_connectors', 'v': CASE p_size % 2 WHEN 0 THEN '2x8pin' ELSE '1x12pin' END}, {'k': 'cuda_cores', 'v': '21760'}, {'k': 'hdcp', 'v': CASE WHEN p_partkey % 3 = 0 THEN 'true' END}]) AS x FROM part)
SELECT page_id, x.k AS key, x.v AS value FROM e WHERE x.v IS NOT NULL""")
def product_page_specs(spark, sf):
    """SRC8, FN30-31: server-rendered product pages; the technical text wins over the description, whose other sections do not count."""
    p = dealt(table(spark, sf, "part"), "p_partkey")
    free = F.concat(
        F.lit("<p>Oferta:</p><ul><li>HDCP: n&atilde;o</li></ul><br><p>Especifica&ccedil;&otilde;es t&eacute;cnicas:</p><ul><li>Mem&oacute;ria: GDDR6 4 GB</li><li>N&uacute;cleos CUDA: 21760 Unidades</li>"),
        F.when(F.col("p_partkey") % 3 == 0, "<li>Suporte HDCP: Sim</li>").otherwise(""), F.lit("</ul>"),
    )
    technical = F.concat(
        F.lit("<ul><li>Memória: GDDR7 "), (8 + F.col("p_size")).cast("string"), F.lit(" GB</li><li>Padrão de ônibus: PCI Express® Gen 5, alimentação 2x 8 pinos</li><li>Conectores de energia: "),
        F.when(F.col("p_size") % 2 == 0, "02 x 8 pinos").otherwise("1 x 12 pinos"), F.lit("</li></ul>"),
    )
    doc = F.to_json(F.struct(F.struct(F.struct(F.struct(free.alias("description"), F.struct(technical.alias("text")).alias("technicalInformation")).alias("product")).alias("pageProps")).alias("props")))
    html = F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), doc, F.lit("</script></html>"))
    pairs = pages.product_sheets(p.select(F.col("p_partkey").alias("page_id"), html.alias("html")), ["page_id"], "html")
    return spec_sheet.mapped(pairs.withColumn("category", F.lit("gpu")), spec_sheet.rules(spark))


@query("""WITH e AS (SELECT p_partkey AS page_id, unnest([{'k': 'socket', 'v': CASE p_size % 2 WHEN 0 THEN 'am5' ELSE 'lga1700' END}, {'k': 'tdp_w', 'v': CAST(65 + p_size AS VARCHAR)}, {'k': 'cores', 'v': '16'}, {'k': 'base_clock_mhz', 'v': '3800'}]) AS x FROM part)
SELECT page_id, x.k AS key, x.v AS value FROM e""")
def table_page_specs(spark, sf):
    """SRC9: tables of label and value cells, and paragraphs with a bold label."""
    p = dealt(table(spark, sf, "part"), "p_partkey")
    html = F.concat(
        F.lit('<table class="s"><tr><th>Soquete:</th><td> '), F.when(F.col("p_size") % 2 == 0, "AM5").otherwise("LGA 1700"), F.lit("</td></tr>\n<tr><th> TDP </th><td><b>"), (65 + F.col("p_size")).cast("string"),
        F.lit(" W</b></td></tr><tr><td>no label</td></tr></table><div><p><strong>N&uacute;cleos:</strong><br> : 16</p><p>plain</p><p><strong>Clock base</strong> 3.8 GHz</p></div>"),
    )
    pairs = pages.table_pairs(p.select(F.col("p_partkey").alias("page_id"), html.alias("html")), ["page_id"], "html")
    return spec_sheet.mapped(pairs.withColumn("category", F.lit("cpu")), spec_sheet.rules(spark))


@query(bindings.sql("titles") + r""", r AS (SELECT product_id, regexp_extract(lower(title), 'rtx (\d)070 ti', 1) AS d FROM titles WHERE category = 'gpu' AND regexp_matches(lower(title), 'rtx [45]070 ti')),
u AS (SELECT product_id, unnest(['cuda_cores', 'reference_model', 'launch']) AS key, unnest([CASE d WHEN '4' THEN '7680' ELSE '8960' END, CASE d WHEN '4' THEN 'RTX 4070 Ti' ELSE 'RTX 5070 Ti' END, CASE d WHEN '4' THEN '2023' END]) AS value_text FROM r)
SELECT product_id, key, value_text, 'reference' AS source FROM u WHERE value_text IS NOT NULL""")
def reference_specs(spark, sf):
    """FN8: attributes of the chips that a reference table knows."""
    known = spark.sql("SELECT * FROM VALUES ('gpu', 'rtx4070ti', 'RTX 4070 Ti', '2023', map('cuda_cores', '7680')), ('gpu', 'rtx5070ti', 'RTX 5070 Ti', NULL, map('cuda_cores', '8960')) AS t(category, chip_id, name, launch, specs)")
    return ingest.reference_specs(view(spark, sf, "titles"), known)


# --- one ingest batch ---------------------------------------------------------------------


def _batch(spark, sf):
    """Listings of all titles in two stores, repeated for every third; what is known: SKUs of one store, keys of early titles."""
    t = view(spark, sf, "titles")
    raw = t.select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")).where("k < 2 OR product_id % 3 = 0")
    raw = raw.select(
        (F.col("product_id") * 4 + F.col("k")).alias("seq"), (F.col("k") % 2).alias("store_id"), F.col("product_id").cast("string").alias("store_sku"), "category", "title", F.lit(None).cast("string").alias("maker"),
        (F.col("product_id") % 90 + F.col("k")).cast("decimal(12,2)").alias("price_cash"), (F.col("product_id") % 5 != 0).alias("in_stock"),
    )
    skus = t.where("product_id % 4 = 0").select("category", F.lit(0).alias("store_id"), F.col("product_id").cast("string").alias("store_sku"), F.concat(F.lit("old-"), F.col("product_id").cast("string")).alias("product_id"))
    old = skus.drop("category").select("*", (F.col("store_sku").cast("long") % 90).cast("decimal(12,2)").alias("price_cash"), (F.col("store_sku").cast("long") % 2 == 0).alias("in_stock"))
    none = spark.createDataFrame([], "category string, product_id string, part_number string, match_key string")
    return ingest.run(raw, skus, none, none, old)


_RAW = f"""{_NOISE}, rw AS (SELECT x.product_id * 4 + k AS seq, k % 2 AS store_id, x.product_id AS sku, x.category, CAST(x.product_id % 90 + k AS DECIMAL(12,2)) AS price_cash, x.product_id % 5 <> 0 AS in_stock
  FROM x, (SELECT unnest([0, 1, 2]) AS k) WHERE NOT is_noise AND (k < 2 OR x.product_id % 3 = 0)),
fr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id, sku ORDER BY seq) AS n FROM rw) WHERE n = 1)"""


@query(_RAW + """ SELECT f.store_id, CAST(sku AS VARCHAR) AS store_sku, price_cash, in_stock FROM fr f WHERE NOT (f.store_id = 0 AND sku % 4 = 0 AND sku % 90 = price_cash AND in_stock = (sku % 2 = 0))""", price_cash="n")
def ingest_changes(spark, sf):
    """SNK1, SNK3, SRC4, FLT13: listings whose price or stock a batch changed, from raw rows through noise, first arrivals and resolution."""
    return _batch(spark, sf)["changes"].select(F.col("store_id").cast("int").alias("store_id"), "store_sku", "price_cash", "in_stock")


@query(_RAW + """ SELECT CASE WHEN store_id = 0 AND sku % 4 = 0 THEN 'known' WHEN part_number IS NULL AND match_key IS NULL THEN 'own' ELSE 'keyed' END AS kind, count(*) AS n
FROM (SELECT fr.*, k.match_key, k.part_number FROM fr JOIN (SELECT product_id, """ + _MATCH + " AS match_key, " + _PART + " AS part_number FROM (SELECT *, trim(regexp_replace(regexp_replace(lower(strip_accents(title)), '[^\\p{L}\\p{N} ]', '', 'g'), ' +', ' ', 'g')) AS n FROM titles)) k ON k.product_id = fr.sku) GROUP BY 1")
def ingest_resolution(spark, sf):
    """JN8: how the rows of a batch are resolved: by a known SKU, as products of their own (no key), or by a key."""
    r = _batch(spark, sf)["resolved"]
    own = (F.col("part_number").isNull() & F.col("match_key").isNull()) & F.col("is_new")
    return r.groupBy(F.when(F.col("product_id").startswith("old-") & (F.col("store_id") == 0) & (F.col("store_sku").cast("long") % 4 == 0), "known").when(own, "own").otherwise("keyed").alias("kind")).agg(F.count("*").alias("n"))


@query()
def ingest_products(spark, sf):
    """SNK2: products that a batch made (order-dependent; held against a sequential version in the tests)."""
    return _batch(spark, sf)["products"]


# --- builds and alerts as tables ------------------------------------------------------------


@query("""WITH i AS (SELECT l_orderkey AS build_id, CASE l_linenumber WHEN 1 THEN 'cpu' WHEN 2 THEN 'gpu' WHEN 3 THEN 'memory' ELSE 'storage' END AS category, l_partkey AS product_id FROM lineitem WHERE l_linenumber < 5)
SELECT category, count(*) AS n, sum(product_id) AS total FROM (SELECT * FROM i WHERE NOT (build_id = 1 AND category IN ('cpu', 'gpu'))
UNION ALL SELECT 1, 'cpu', 77 UNION ALL SELECT 1, 'memory', 5) GROUP BY category""")
def build_edits(spark, sf):
    """SNK11, SET2-3: parts set, added and removed (one added storage part goes again)."""
    slot = F.col("l_linenumber")
    items = table(spark, sf, "lineitem").where("l_linenumber < 5").select(
        F.col("l_orderkey").alias("build_id"), F.when(slot == 1, "cpu").when(slot == 2, "gpu").when(slot == 3, "memory").otherwise("storage").alias("category"), F.col("l_partkey").alias("product_id"), F.lit(None).cast("long").alias("listing_id"),
    )
    items = builds.add_part(builds.add_part(builds.set_part(items, 1, "cpu", 77), 1, "memory", 5), 1, "storage", -1)
    items = builds.remove_one(builds.remove_category(items, 1, "gpu"), 1, "storage", -1)
    return items.groupBy("category").agg(F.count("*").alias("n"), F.sum("product_id").alias("total"))


@query("""SELECT confirmed, count(*) AS n, sum(product_id) AS total FROM (SELECT c_custkey % 50 AS product_id, c_custkey % 4 <> 0 OR c_custkey = 8 AS confirmed FROM customer WHERE c_custkey <> 12 UNION ALL SELECT 3, false) GROUP BY confirmed""")
def alert_book(spark, sf):
    """SNK12: alerts created, confirmed and cancelled by their token."""
    a = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("alert_id"), (F.col("c_custkey") % 50).alias("product_id"), F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("token"), (F.col("c_custkey") % 4 != 0).alias("confirmed"), F.lit(None).cast("timestamp").alias("confirmed_at"),
    )
    a = builds.create_alert(a, [(-1, 3, "new", False, None)], spark)
    a = builds.cancel(builds.confirm(a, "t8", F.to_timestamp(F.lit("2024-01-30"))), "t12")
    return a.groupBy("confirmed").agg(F.count("*").alias("n"), F.sum("product_id").alias("total"))


@query("""SELECT status, count(*) AS n, sum(length(error)) AS error_chars, max(duration_ms) AS longest FROM (SELECT CASE WHEN o_orderkey = 1 THEN 'failed' ELSE 'running' END AS status, CASE WHEN o_orderkey = 1 THEN repeat('x', 2000) END AS error,
CASE WHEN o_orderkey = 1 THEN 60000 END AS duration_ms FROM orders) GROUP BY status""", error_chars="n", longest="n")
def run_log(spark, sf):
    """SNK7: a run that ended with a long error."""
    at = F.to_timestamp(F.lit("2024-01-30 00:00:00"))
    log = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.lit("running").alias("status"), F.lit(0).alias("items_found"), F.lit(0).alias("items_new"), F.lit(None).cast("string").alias("error"),
        at.alias("started_at"), F.lit(None).cast("long").alias("duration_ms"), F.lit(None).cast("timestamp").alias("finished_at"),
    )
    log = runs.finished(log, 1, F.to_timestamp(F.lit("2024-01-30 00:01:00")), 5, 1, "x" * 3000)
    return log.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.length("error")).cast("double").alias("error_chars"), F.max("duration_ms").cast("double").alias("longest"))


@query("SELECT count(*) AS n FROM part WHERE p_partkey % 2 = 0")
def image_queue(spark, sf):
    """FLT15: listings whose image is still an outside address."""
    urls = table(spark, sf, "part").select(F.when(F.col("p_partkey") % 2 == 0, "https://x.example/i.png").when(F.col("p_partkey") % 3 == 0, "images/i.png").alias("image_url"))
    return runs.collected_images(urls).agg(F.count("*").alias("n"))


@query(_COMPAT.replace("it AS (SELECT b.build_id, b.seq, pw.*", """cand AS (SELECT p_partkey AS part_id FROM part WHERE p_partkey % 8 = 2),
fb AS (SELECT build_id, seq, part_id FROM build_items WHERE build_id = (SELECT min(build_id) FROM build_items)),
hyp AS (SELECT -c.part_id AS build_id, fb.seq, fb.part_id FROM cand c, fb WHERE fb.part_id % 8 <> 2 UNION ALL SELECT -part_id, 0, part_id FROM cand),
it AS (SELECT b.build_id, b.seq, pw.*""").replace("FROM build_items b JOIN pw", "FROM hyp b JOIN pw") + """
SELECT -w.build_id AS product_id, count(code) FILTER (severity = 'E') = 0 AS compatible, coalesce(string_agg(code, ',' ORDER BY code) FILTER (severity = 'E'), '') AS reasons FROM w LEFT JOIN i ON i.build_id = w.build_id GROUP BY w.build_id""")
def candidate_boards(spark, sf):
    """CMP18, JN13, FLT9, FLT18: which motherboards fit into the first build, and why the others do not."""
    return compatibility.candidates(_first_build(spark, sf), _parts(spark, sf), "motherboard").select("product_id", "compatible", F.array_join(F.array_sort("reasons"), ",").alias("reasons"))


# --- standing tables and search ----------------------------------------------------------------


@query(bindings.sql("history") + """, r AS (SELECT *, CASE WHEN day < DATE '2024-01-15' THEN 0 ELSE 1 END AS b, CASE WHEN event_id % 3 = 0 THEN 't' || event_id END AS thumb FROM history),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY listing_id, b ORDER BY event_id DESC) AS n FROM r) WHERE n = 1)
SELECT coalesce(x.listing_id, y.listing_id) AS listing_id, CASE WHEN y.listing_id IS NOT NULL THEN y.price_cash ELSE x.price_cash END AS price_cash, CASE WHEN y.listing_id IS NOT NULL THEN y.in_stock ELSE x.in_stock END AS in_stock, coalesce(x.thumb, y.thumb) AS thumbnail
FROM (SELECT * FROM l WHERE b = 0) x FULL JOIN (SELECT * FROM l WHERE b = 1) y ON x.listing_id = y.listing_id""", price_cash="n")
def standing_listings(spark, sf):
    """SNK1: the listing table after two batches, the second run twice; only the parts that a batch touches are written."""
    folder = _standing(spark, sf)
    return spark.read.parquet(f"{folder}/listings").select("listing_id", "price_cash", "in_stock", "thumbnail")


@query(bindings.sql("history") + ", d AS (SELECT *, row_number() OVER (PARTITION BY product_id, day ORDER BY price_cash, listing_id) AS n FROM history WHERE in_stock AND price_cash > 0) SELECT product_id, day, price_cash AS min_price, listing_id FROM d WHERE n = 1", day="d", min_price="n")
def standing_daily(spark, sf):
    """SNK5: the daily rollup after the same batches, a part for each day."""
    return spark.read.parquet(f"{_standing(spark, sf)}/daily").select("product_id", "day", "min_price", "listing_id")


def _standing(spark, sf) -> str:
    folder = own_folder(spark, "standing")
    rows = view(spark, sf, "history").select(
        F.col("event_id").alias("seq"), "store_id", F.col("listing_id").cast("string").alias("store_sku"), "listing_id", "product_id", "price_cash", "in_stock", "day",
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("t"), F.col("event_id").cast("string"))).alias("thumbnail"),
    )
    schema = rows.withColumn("batch", F.lit(0).cast("long")).schema
    for batch in (0, 1, 1):
        now = rows.where("day < DATE '2024-01-15'" if batch == 0 else "day >= DATE '2024-01-15'")
        tables.write_batch(folder, batch, now, now, schema, ["listing_id", "product_id", "price_cash", "in_stock"], ["thumbnail"], parts=16)
    return folder


@query(bindings.sql("products") + " SELECT product_id, name FROM products WHERE name ILIKE '%ryzen%7_00%' UNION ALL SELECT product_id, name FROM products WHERE name ILIKE '%5%'")
def catalog_by_trigrams(spark, sf):
    """FLT3, FLT9: names that contain a query with wildcards, by their trigrams; and a query too short for one, tried on every name."""
    p = view(spark, sf, "products").select("product_id", "name")
    index = search.postings(p)
    return search.named(p, index, "ryzen%7_00").unionAll(search.named(p, index, "5"))


@query(f"""{bindings.sql("titles")}, k AS (SELECT product_id, category, {_MATCH} AS m, {_PART} AS p FROM (SELECT *, {_N} AS n FROM titles)),
s AS (SELECT * FROM k WHERE product_id % 3 <> 0), sm AS (SELECT category, m, min(CAST(product_id AS VARCHAR)) AS f FROM s GROUP BY ALL), sp AS (SELECT category, p, min(CAST(product_id AS VARCHAR)) AS f FROM s GROUP BY ALL)
SELECT k.product_id, CASE WHEN k.product_id % 3 <> 0 THEN CAST(k.product_id AS VARCHAR) END AS by_sku, sp.f AS by_part, sm.f AS by_model
FROM k LEFT JOIN sp ON sp.category = k.category AND sp.p = k.p LEFT JOIN sm ON sm.category = k.category AND sm.m = k.m""")
def standing_anchors(spark, sf):
    """JN8, SNK2: the product that each title's SKU, part number and match key lead to, through the standing index after a catalog and a batch."""
    pid = F.col("product_id").cast("string")
    t = ingest.arrivals(view(spark, sf, "titles").select("*", F.col("product_id").alias("seq"), F.lit(0).alias("store_id"), pid.alias("store_sku")), noise=False)
    products = t.where("product_id % 3 = 1").select(pid.alias("product_id"), "store_id", "store_sku", "category", "part_number", F.col("match_key").alias("model"))
    name = f"anchors_{uuid.uuid4().hex}"
    anchors.create(spark, name, own_folder(spark, "anchors"), buckets=16)
    anchors.seed(products, products, name, 0)
    anchors.extend(t.where("product_id % 3 = 2").withColumns({"product_id": pid, "is_new": F.lit(True)}), name, 1)
    skus, parts, models = anchors.lookup(t, name, 2)
    own = lambda found, to: found.withColumnRenamed("product_id", to)
    out = t.join(own(skus, "by_sku"), ["category", "store_id", "store_sku"], "left").join(own(parts, "by_part"), ["category", "part_number"], "left").join(own(models, "by_model"), ["category", "match_key"], "left")
    out = cut(out.select("product_id", "by_sku", "by_part", "by_model"))
    spark.sql(f"DROP TABLE {name}")
    return out


@query("""SELECT CASE s WHEN 0 THEN 'alfa' ELSE 'beta' END AS store, p_partkey AS code, CAST(p_retailprice AS DECIMAL(12,2)) AS price_cash, 'ddr' || (4 + p_partkey % 2) AS memory_type,
CASE WHEN s = 0 AND p_partkey % 4 <> 0 THEN p_partkey % 12 || 'x' END AS installment_text, CASE s WHEN 0 THEN '/images/' ELSE 'https://img.example/x/' END || sha256('https://' || p_name || '.JPG')[1:40] || '.jpg' AS image
FROM part, (SELECT unnest([0, 1]) AS s) WHERE s = 0 OR p_partkey % 3 = 0""", price_cash="n")
def listings_of_stores(spark, sf):
    """SRC3, SET5, FN22: listing pages of two stores as one table, with what titles say by category, installments and image addresses."""
    p = table(spark, sf, "part")
    title = F.concat("p_name", F.lit(" DDR"), (4 + F.col("p_partkey") % 2).cast("string"))
    url = F.concat(F.lit("https://"), "p_name", F.lit(".JPG"))

    def store(name, parts, installment, base):
        item = F.struct(F.col("p_partkey").alias("code"), title.alias("name"), F.col("p_name").alias("friendlyName"), F.col("p_retailprice").alias("price"), installment.alias("maxInstallment"), url.alias("thumbnail"))
        page = parts.groupBy(F.floor(F.col("p_partkey") / 60).alias("page")).agg(F.collect_list(item).alias("data"))
        outer = F.to_json(F.struct(F.struct(F.struct(F.to_json(F.struct(F.struct("data").alias("catalogServer"))).alias("data")).alias("pageProps")).alias("props")))
        html = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), outer, F.lit("</script>"))
        found = pages.listing(pages.listing_items(page.select("page", html.alias("html")))[0], name, f"https://{name}.example", F.lit("memory"))
        return found.withColumn("image", text.public_url(text.image_key(F.col("thumbnail")), base))

    alfa = store("alfa", p, F.when(F.col("p_partkey") % 4 != 0, F.concat((F.col("p_partkey") % 12).cast("string"), F.lit("x"))), None)
    beta = store("beta", p.where("p_partkey % 3 = 0"), F.lit(None).cast("string"), "https://img.example/x/")
    return pages.together(alfa, beta.drop("installment_text")).select("store", "code", "price_cash", F.col("specs")["type"].alias("memory_type"), "installment_text", "image")


@query(bindings.sql("titles", "build_items") + """ SELECT build_id, part_id, row_number() OVER (PARTITION BY build_id ORDER BY CASE category WHEN 'cpu' THEN 1 WHEN 'motherboard' THEN 2 WHEN 'gpu' THEN 3 WHEN 'memory' THEN 4 WHEN 'storage' THEN 5 WHEN 'psu' THEN 6 WHEN 'case' THEN 7 ELSE 8 END, seq) AS position
FROM build_items b JOIN titles t ON t.product_id = b.part_id""")
def build_lines(spark, sf):
    """SRT4: the parts of every build in the order in which their categories are shown."""
    items = view(spark, sf, "build_items").drop("product_id").join(view(spark, sf, "titles").select(F.col("product_id").alias("part_id"), "category"), "part_id")
    return catalog.in_display_order(items, "build_id", "seq").select("build_id", "part_id", "position")


@query(_P + " ORDER BY min_price DESC, product_id LIMIT 20 OFFSET 25", created_on="d", min_price="n")
def deep_page(spark, sf):
    """SRT2: a page far down an order that is written in ranges; it reads the range that it lies in (a limited page by feature)."""
    rows = _search(spark, sf)[0].select("product_id", "name", "created_on", "min_price")
    path, order = own_folder(spark, "order"), [F.desc("min_price"), F.asc("product_id")]
    paging.write(rows, order, path, parts=16)
    return paging.page(spark, path, rows.schema, order, paging.counts(spark, path), 25, 20)
