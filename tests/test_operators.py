"""Operators on small fixtures, among them brute-force versions of those without SQL."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from oficina.operators import builds, catalog, compatibility, ingest, prices, spec_sheet
from oficina.sources import pages
from oficina.streaming import prices as streams

NOW = dt.date(2026, 8, 8)


@pytest.mark.parametrize("series, wanted", [
    ([(7, 1000), (0, 800)], (None, 1000, None, 0.2, 8 - 8, False)),
    ([(3, 900), (1, 1000), (0, 850)], (1000, 900, 0.15, 0.0556, 0, False)),
    ([(10, 1100), (5, 1000), (2, 1000), (0, 950)], (None, 1000, None, 0.05, 11, False)),
    ([(1, 1000), (0, 1200)], (1000, 1000, -0.2, -0.2, 0, False)),
    ([(d, 1000) for d in range(30, 0, -1)] + [(0, 800)], (1000, 1000, 0.2, 0.2, 31, True)),
    ([(1, 1000), (0, 800)], (1000, 1000, 0.2, 0.2, 2, False)),
])
def test_insights(spark, series, wanted):
    rows = [(1, NOW - dt.timedelta(days=d), Decimal(p)) for d, p in series]
    r = prices.insights(spark.createDataFrame(rows, "product_id int, day date, min_price decimal(12,2)")).first()
    p24, p7, d24, d7, _, anomaly = wanted
    num = lambda x: None if x is None else round(float(x), 4)
    assert (num(r.price_24h), num(r.price_7d), num(r.drop_24h), num(r.drop_7d), r.is_anomaly) == (p24, p7, d24, d7, anomaly)
    past = sorted(series, reverse=True)[:-1]
    lowest = 0
    for d, p in reversed(past):
        if p < series[-1][1]:
            break
        lowest = max(lowest, d + 1)
    assert r.lowest_in_days == lowest


def test_insights_of_nothing(spark):
    assert prices.insights(spark.createDataFrame([], "product_id int, day date, min_price decimal(12,2)")).count() == 0


def resolved(items):
    """Sequential resolution, one item after the other."""
    by_part, by_key, out = {}, {}, {}
    for seq, pn, key in items:
        hit = by_part.get(pn) if pn is not None and pn in by_part else by_key.get(key) if key is not None and key in by_key else None
        if hit is None:
            hit = f"new-{seq}"
            if pn is not None:
                by_part[pn] = hit
            if key is not None:
                by_key[key] = hit
            out[seq] = (hit, True)
        else:
            out[seq] = (hit, False)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_resolution_equals_the_sequential_one(spark, seed):
    rng = random.Random(seed)
    items = [(i, rng.choice([None, *"ABCDEF"]), rng.choice([None, *"uvwxyz"])) for i in range(40)]
    df = spark.createDataFrame([(i, 0, str(i), p, k) for i, p, k in items], "seq int, store_id int, store_sku string, part_number string, match_key string")
    none = spark.createDataFrame([], "store_id int, store_sku string, product_id string, part_number string, match_key string")
    got = {r.seq: (r.product_id, r.is_new) for r in ingest.resolve(df, none, none, none).collect()}
    assert got == resolved(items)


def test_repeated_pairs_of_keys_settle_in_one_round(spark):
    """Forty items with one part number whose model another product has: no round for each of them, and no plan that grows by rounds."""
    items = [(0, "A", "u"), *[(i, "B", "u") for i in range(1, 41)], (41, None, "u"), (42, "B", "v"), (43, "B", "w"), (44, None, "v")]
    df = spark.createDataFrame([(i, 0, str(i), p, k) for i, p, k in items], "seq int, store_id int, store_sku string, part_number string, match_key string")
    none = spark.createDataFrame([], "store_id int, store_sku string, product_id string, part_number string, match_key string")
    out = ingest.resolve(df, none, none, none, rounds=2)
    assert {r.seq: (r.product_id, r.is_new) for r in out.collect()} == resolved(items)


@pytest.mark.parametrize("seed", range(2))
def test_long_chains_of_keys_equal_the_sequential_resolution(spark, seed):
    """Every pair waits for the one before it: the estimates of sizes stay numbers that the driver can hold."""
    rng = random.Random(seed)
    chain = [(i, f"P{(i + 1) // 2}", f"k{i // 2}") for i in range(16)]
    items = chain + [(16 + i, *rng.choice(chain)[1:]) for i in range(30)] + [(46 + i, rng.choice([None, f"P{i % 9}"]), rng.choice([None, f"k{i % 7}"])) for i in range(16)]
    df = spark.createDataFrame([(i, 0, str(i), p, k) for i, p, k in items], "seq int, store_id int, store_sku string, part_number string, match_key string")
    none = spark.createDataFrame([], "store_id int, store_sku string, product_id string, part_number string, match_key string")
    out = ingest.resolve(df, none, none, none)
    assert {r.seq: (r.product_id, r.is_new) for r in out.collect()} == resolved(items)
    assert int(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()).bit_length() < 2000


def test_resolution_prefers_the_known(spark):
    df = spark.createDataFrame([(0, 1, "s", "P1", "k1"), (1, 1, "t", "p-1", "k9"), (2, 1, "u", None, "k1"), (3, 1, "v", None, None)], "seq int, store_id int, store_sku string, part_number string, match_key string")
    skus = spark.createDataFrame([(1, "s", "a")], "store_id int, store_sku string, product_id string")
    parts = spark.createDataFrame([("P1", "b")], "part_number string, product_id string")
    keys = spark.createDataFrame([("k1", "c")], "match_key string, product_id string")
    got = {r.seq: (r.product_id, r.is_new) for r in ingest.resolve(df, skus, parts, keys).collect()}
    assert got == {0: ("a", False), 1: ("b", False), 2: ("c", False), 3: ("new-3", True)}


def test_upsert_overwrites_and_fills(spark):
    old = spark.createDataFrame([(1, 10, None), (2, 20, "b")], "k int, price int, image string")
    new = spark.createDataFrame([(1, None, "a"), (3, 30, "c")], "k int, price int, image string")
    got = {tuple(r) for r in ingest.upsert(old, new, ["k"], ["price"], ["image"]).collect()}
    assert got == {(1, None, "a"), (2, 20, "b"), (3, 30, "c")}


def test_attributes_by_precedence(spark):
    rows = [(1, "tdp_w", "100", "reference", 1), (1, "tdp_w", "6144", "title", 2), (1, "igpu", "False", "page", 3), (1, "igpu", "true", "title", 4), (1, "x", " ", "manual", 5), (1, "y", "a", "page", 6), (1, "y", "b", "page", 7)]
    got = {r.key: (r.value_text, None if r.value_num is None else float(r.value_num), r.value_bool) for r in ingest.merge_attributes(spark.createDataFrame(rows, "product_id int, key string, value_text string, source string, seq int")).collect()}
    assert got == {"tdp_w": ("6144", 6144.0, None), "igpu": ("False", None, False), "y": ("b", None, None)}


def test_build_slots(spark):
    items = spark.createDataFrame([(1, "memory", 5, None), (1, "memory", 5, None), (1, "cpu", 2, None)], "build_id int, category string, product_id int, listing_id int")
    assert sorted(r.product_id for r in builds.set_part(items, 1, "cpu", 9).where("category = 'cpu'").collect()) == [9]
    assert builds.add_part(items, 1, "memory", 5).count() == 4
    assert builds.remove_one(items, 1, "memory", 5).count() == 2
    assert builds.remove_category(items, 1, "memory").count() == 1
    with pytest.raises(ValueError):
        builds.add_part(items, 1, "cpu", 3)


def test_two_equal_parts_cover_two_items_and_cost_once(spark):
    items = spark.createDataFrame([(1, "memory", 5, None), (1, "memory", 5, None)], "build_id int, category string, product_id int, listing_id int")
    by_store = spark.createDataFrame([(5, "alfa", 100)], "product_id int, slug string, price int")
    r = builds.baskets(items, by_store).first()
    assert (r.total, r.covered_items, r.total_items) == (100, 2, 2)


PART = "build_id int, seq int, category string, product_id string, model string, name string, attrs map<string,string>"


def codes(spark, *parts):
    rows = [(1, i, c, f"p{i}", m, m, a) for i, (c, m, a) in enumerate(parts)]
    b = compatibility.with_seeds(compatibility.snapshot(spark.createDataFrame(rows, PART)))
    return {r.code for r in compatibility.issues(b).collect()}, compatibility.summary(b).first()


@pytest.mark.parametrize("parts, wanted", [
    ([("cpu", "amd 7600x", {"socket": "AM5"}), ("motherboard", "b", {"socket": "am5", "chipset": "B650M"})], set()),
    ([("cpu", "amd 7600x", {"socket": "AM5"}), ("motherboard", "b", {"socket": "am4", "chipset": "b450"})], {"CPU_SOCKET_MISMATCH"}),
    ([("cpu", "amd 7600x", {}), ("motherboard", "b", {"socket": "am4", "chipset": "AMD B450"})], {"CPU_CHIPSET_UNSUPPORTED"}),
    ([("cpu", "amd 5700", {}), ("motherboard", "b", {"chipset": "b450"})], {"BIOS_UPDATE_NEEDED"}),
    ([("cpu", "amd 7600x", {}), ("motherboard", "b", {"chipset": "unknown"})], set()),
    ([("memory", "m", {"type": "ddr4"}), ("motherboard", "b", {"memory_type": "DDR5"})], {"RAM_TYPE_MISMATCH"}),
    ([("memory", "m", {"type": "ddr4"}), ("motherboard", "b", {"memory_type": "ambos"})], set()),
    ([("memory", "m", {"capacity_gb": "32", "modules": "2"}), ("memory", "m", {"capacity_gb": "32", "modules": "1"}), ("motherboard", "b", {"max_memory_gb": "64", "memory_slots": "2"})], {"RAM_SLOT_OVERFLOW"}),
    ([("memory", "m", {"capacity_gb": "96"}), ("memory", "m", {}), ("motherboard", "b", {"max_memory_gb": "64"})], {"RAM_CAPACITY_EXCEEDED"}),
    ([("gpu", "g", {"length_mm": "300"}), ("case", "c", {"max_gpu_length_mm": "300"})], set()),
    ([("gpu", "g", {"length_mm": "300,5"}), ("case", "c", {"max_gpu_length_mm": "300"})], {"GPU_CASE_LENGTH"}),
    ([("cooler", "k", {"type": "aio", "height_mm": "200", "radiator_mm": "280"}), ("case", "c", {"max_cooler_height_mm": "160", "radiator_support_mm": "[240,360]"})], {"AIO_RADIATOR_FIT"}),
    ([("cooler", "k", {"height_mm": "200"}), ("case", "c", {"max_cooler_height_mm": "160"})], {"COOLER_CASE_HEIGHT"}),
    ([("cooler", "k", {"socket_support": '["am4"]'}), ("cpu", "c", {"socket": "AM5", "has_igpu": "true"})], {"COOLER_SOCKET_MISMATCH"}),
    ([("motherboard", "b", {"form_factor": "ATX"}), ("case", "c", {"form_factor_support": "matx, itx"})], {"MOBO_CASE_FORM_FACTOR"}),
    ([("storage", "s", {"interface": "NVMe"}), ("storage", "s", {"interface": "nvme"}), ("motherboard", "b", {"m2_slots": "1"})], {"STORAGE_M2_OVERFLOW"}),
    ([("psu", "p", {"connectors": "1x6 pinos"}), ("gpu", "g", {"power_connectors": "2x8 pinos"})], {"PSU_CONNECTOR_MISSING"}),
    ([("psu", "p", {"wattage": "400"}), ("gpu", "g", {"tdp_w": "300"})], {"PSU_WATTAGE_LOW"}),
    ([("psu", "p", {"wattage": "10"}), ("gpu", "g", {})], set()),
    ([("memory", "m", {"speed_mhz": "6000"}), ("cpu", "c", {"max_memory_speed_mhz": "5600", "has_igpu": "x"})], {"RAM_SPEED_CAPPED"}),
    ([("cpu", "c", {"has_igpu": "false"})], {"NO_GPU_NO_IGPU"}),
])
def test_rules(spark, parts, wanted):
    assert codes(spark, *parts)[0] == wanted


def test_watts(spark):
    s = codes(spark, ("cpu", "x", {"tdp_w": "105"}), ("gpu", "y", {"tdp_w": "200"}))[1]
    assert (float(s.base_w), float(s.recommended_w)) == (405, 567)
    s = codes(spark, ("gpu", "RTX 4070 Super", {}))[1]
    assert float(s.base_w) == 320
    assert codes(spark, ("gpu", "unknown", {}))[1].base_w is None


def test_candidates(spark):
    rows = [(1, 0, "cpu", "c", "amd 7600x", "n", {"socket": "AM5"})]
    parts = spark.createDataFrame([("b1", "motherboard", "m", "n", {"socket": "am5"}), ("b2", "motherboard", "m", "n", {"socket": "am4"})], "product_id string, category string, model string, name string, attrs map<string,string>")
    got = {r.product_id: (r.compatible, r.reasons) for r in compatibility.candidates(compatibility.snapshot(spark.createDataFrame(rows, PART)), parts, "motherboard").collect()}
    assert got == {"b1": (True, []), "b2": (False, ["CPU_SOCKET_MISMATCH"])}


def test_alerts_rest_and_stamp(spark):
    t = dt.datetime(2024, 1, 30)
    a = spark.createDataFrame([(1, 7, Decimal(10), True, None, 0), (2, 7, Decimal(10), True, t - dt.timedelta(hours=2), 1), (3, 7, Decimal(1), True, None, 0), (4, 7, Decimal(10), False, None, 0)], "alert_id int, product_id int, target_price decimal(12,2), confirmed boolean, last_triggered_at timestamp, trigger_count int")
    listings = spark.createDataFrame([(70, 7, Decimal(9), True), (71, 7, None, True), (72, 7, Decimal(1), False)], "listing_id int, product_id int, price_cash decimal(12,2), in_stock boolean")
    now = F.lit(t)
    due = builds.due_alerts(a, listings, now)
    assert [(r.alert_id, r.listing_id) for r in due.collect()] == [(1, 70)]
    assert {r.alert_id: r.trigger_count for r in builds.stamped(a, due, now).collect()} == {1: 1, 2: 1, 3: 0, 4: 0}


def test_store_card(spark):
    card = "Frete\nProcessador AMD Ryzen 5 7600X3D longo nome\nà vista\nR$ 1.599,99 no PIX\n12x de R$ 150,00"
    df = spark.createDataFrame([("https://x/p/99", card), ("https://x/p/1", "sem preço")], "href string, txt string")
    r = pages.cards(df, "href", "txt", r"R\$\s*([\d.,]+) no PIX", "à vista", r"/(\d+)$").collect()
    assert [(float(x.price_cash), x.installments, x.in_stock, x.match_key, x.store_sku) for x in r] == [(1599.99, 12, True, "amd 7600x3d", "99")]


def test_pages_without_a_catalog_are_kept_apart(spark):
    good = '<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"data":"{\\"catalogServer\\":{\\"data\\":[{\\"code\\":7,\\"name\\":\\"A\\",\\"price\\":5.0,\\"priceWithDiscount\\":0}]}}"}}}</script>'
    items, bad = pages.listing_items(spark.createDataFrame([(1, good), (2, "<html>"), (3, None)], "page int, html string"))
    assert [(r.code, float(r.price_cash), r.in_stock) for r in items.collect()] == [(7, 5.0, False)]
    assert {r.page for r in bad.collect()} == {2, 3}


def test_gated_spec_pairs(spark):
    html = "<p>DESTAQUE:</p><li>Cor: azul<br>Especificações<br/><li>Memória: 8 GB<li>solta"
    df = spark.createDataFrame([(1, html)], "page int, html string")
    assert [(r.label, r.value) for r in pages.spec_pairs(df, ["page"], "html", gated=True).collect()] == [("Memória", "8 GB"), ("Especificações", "solta")]


def test_longest_label_wins(spark):
    pairs = spark.createDataFrame([(1, 0, "gpu", "Interface de memória", "256 bits"), (1, 1, "gpu", "Tipo de interface", "HDMI"), (1, 2, "gpu", "Uma memória com rótulo bem longo", "8 GB")], "page_id int, pos int, category string, label string, value string")
    got = {r.key: r.value for r in spec_sheet.mapped(pairs, spec_sheet.rules(spark)).collect()}
    assert got == {"memory_bus_bits": "256", "video_outputs": "HDMI"}


def test_search_pages_and_clamps(spark):
    p = spark.createDataFrame([(i, f"n{i}", "gpu", "b", NOW) for i in range(5)], "product_id int, name string, category string, brand string, created_on date")
    listings = spark.createDataFrame([(i, Decimal(i), True) for i in range(4)] + [(4, None, True)], "product_id int, price_cash decimal(12,2), in_stock boolean")
    found, page = catalog.search(p, listings, sort="price_desc", limit=2, offset=1)
    assert found.count() == 4 and [r.product_id for r in page.collect()] == [2, 1]


def test_streams(spark, tmp_path):
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [(1, 1, 5.0, True, t(0)), (1, 1, 5.0, True, t(1)), (1, 1, 4.0, True, t(2)), (1, 1, 4.0, False, t(3)), (2, 1, None, True, t(1)), (1, 1, 9.0, True, t(200))]
    schema = "listing_id long, product_id long, price_cash double, in_stock boolean, collected_at timestamp"
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(folder)
    stream = lambda: streams.read_stream(spark, folder, spark.createDataFrame([], schema).schema)
    daily = streams.run_once(streams.daily_minimum(stream(), "1 hour"), "daily", str(tmp_path))
    assert [(r.product_id, r.day, r.min_price) for r in daily.collect()] == [(1, dt.date(2024, 1, 1), 4.0)]
