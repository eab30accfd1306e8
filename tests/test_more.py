"""Spec sheet values, product pages, label tables, and one whole ingest batch against a sequential version."""

import json
import random

import pytest
from pyspark.sql import functions as F

from oficina.functions import noise, specs, text
from oficina.operators import builds, compatibility, ingest, runs, spec_sheet
from oficina.sources import pages
from test_operators import resolved


@pytest.mark.parametrize("kind, raw, wanted", [
    ("pcie", "PCI Express 5.0 x16", "pcie5.0x16"), ("pcie", "PCI Express® Gen 5", "pcie5"), ("pcie", "PCIe 4.0 x8", "pcie4.0x8"), ("pcie", "PCI Express 4.0, alimentação 2x 8 pinos", "pcie4.0"), ("pcie", "PCI Express", None),
    ("power", "1 x 8 pinos", "1x8pin"), ("power", "02 x 8 pinos", "2x8pin"), ("power", "1 x 12 pin", "1x12pin"), ("power", "1 x 16 pinos", "1x16pin"), ("power", "12V-2x6", "1x16pin"), ("power", "8 pinos", "1x8pin"), ("power", "nenhum", "nenhum (slot)"),
    ("mem_type", "LPDDR5", None), ("mem_type", "16GB DDR4L", "ddr4l"), ("mem_type", "GDDR6X 12 GB", "gddr6x"), ("mem_type", "DDR5-6000", "ddr5"),
    ("int", "21760 Unidades", "21760"), ("mhz", "Boost: 3290 MHz", "3290"), ("mhz", "3.8 GHz", "3800"), ("int", "sem valor numérico", None), ("bool", "Sim", "true"), ("bool", "Não", "false"),
])
def test_sheet_values(spark, kind, raw, wanted):
    got = spark.range(1).select(specs.parsed(F.lit(kind), F.lit("k"), F.lit(raw)).alias("x")).first().x
    assert [v.value for v in got] == ([] if wanted is None else [wanted])


def sheet(spark, category, *pairs):
    df = spark.createDataFrame([(1, i, category, a, b) for i, (a, b) in enumerate(pairs)], "page_id int, pos int, category string, label string, value string")
    return {r.key: r.value for r in spec_sheet.mapped(df, spec_sheet.rules(spark)).collect()}


def test_sheets(spark):
    assert sheet(spark, "gpu", ("Memória", "GDDR6 16 GB")) == {"memory_type": "gddr6", "memory_gb": "16"}
    assert sheet(spark, "gpu", ("Relógio do motor", "Boost Clock: 3290 MHz\nGame Clock: 2700 MHz"), ("Cor da carcaça", "preta")) == {"boost_clock_mhz": "3290", "game_clock_mhz": "2700"}
    assert sheet(spark, "gpu", ("Dimensões", "359 x 149 x 70 mm"), ("Interface de memória", "256 bits"), ("Relógio de memória", "21 Gbps")) == {"length_mm": "359", "width_mm": "149", "height_mm": "70", "memory_bus_bits": "256", "memory_clock_gbps": "21.0"}
    assert len(sheet(spark, "gpu", ("Entradas", "A" * 300))["video_outputs"]) == 256
    assert sheet(spark, "cpu", ("Soquete", "LGA 1700"), ("Núcleos", "900")) == {"socket": "lga1700"}


def test_label_tables_are_read_and_refused(spark, tmp_path):
    rows = [{"category": "gpu", "label": "Taxa (de) Quadros", "key": "fps", "kind": "int"}, {"category": "gpu", "label": "Taxa de quadros", "key": "fps", "kind": "int"}]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, rows)))
    assert [tuple(r) for r in spec_sheet.read_rules(spark, str(tmp_path / "a.json")).collect()] == [("gpu", "taxa de quadros", "fps", "int")]
    (tmp_path / "b.json").write_text(json.dumps(rows[0] | {"kind": "fraction"}))
    with pytest.raises(ValueError, match="fraction"):
        spec_sheet.read_rules(spark, str(tmp_path / "b.json"))


def test_a_rule_with_signs_is_text(spark):
    table = spark.createDataFrame([("gpu", "m.2 (x4", "slots", "int")], "category string, rule string, key string, kind string")
    df = spark.createDataFrame([(1, 0, "gpu", "abc", "4")], "page_id int, pos int, category string, label string, value string")
    assert spec_sheet.mapped(df, table).count() == 0


def test_references_and_tables(spark):
    df = spark.createDataFrame([(1, "<tr><th>A&ccedil;&#xE3;o:</th><td>1&nbsp;&lt; 2 &bogus; &#0;</td></tr><p><strong>B</strong><br>: x<br>y</p>")], "id int, html string")
    assert [(r.label, r.value) for r in pages.table_pairs(df, ["id"], "html").collect()] == [("Ação:", "1 < 2 &bogus; &#0;"), ("B", "x\ny")]


def test_a_batch_equals_the_sequential_version(spark):
    rng = random.Random(9)
    titles = ["Processador AMD Ryzen 7 7700X, AM5 - 100-100000591WOF", "Processador AMD Ryzen 7 7700X AM5", "Memória Kingston Fury 16GB DDR5 6000MHz", "Contact Frame para LGA 1700", "Processador Intel Core i5-13400F, LGA 1700", "SSD WD Black 1TB NVMe"]
    cats = ["cpu", "cpu", "memory", "cpu", "cpu", "storage"]
    raw = [(i, rng.randrange(2), str(rng.randrange(60)), cats[k], titles[k], None, float(rng.randrange(9)), True) for i, k in enumerate(rng.choices(range(6), k=200))]
    df = spark.createDataFrame(raw, "seq long, store_id int, store_sku string, category string, title string, maker string, price_cash double, in_stock boolean")
    known = spark.createDataFrame([(c, 0, "5", "old") for c in sorted(set(cats))], "category string, store_id int, store_sku string, product_id string")
    none = spark.createDataFrame([], "category string, product_id string, part_number string, match_key string")
    before = spark.createDataFrame([(0, "5", "old", -1.0, True), (7, "1", "other", 2.0, True)], "store_id int, store_sku string, product_id string, price_cash double, in_stock boolean")
    out = ingest.run(df, known, none, none, before)
    marks = {r.seq: r for r in df.select("seq", noise.is_noise(F.col("category"), F.col("title")).alias("noise"), text.match_key(F.col("title")).alias("key"), text.normalize_part_number(text.part_number(F.col("title"))).alias("pn")).collect()}
    first = {}
    for r in raw:
        if not marks[r[0]].noise:
            first.setdefault((r[1], r[2]), r)
    items = [r for k, r in first.items() if k != (0, "5")]
    within = {r[0]: r[3] for r in raw}
    wanted = {}
    for cat in set(cats):
        wanted |= resolved(sorted((r[0], marks[r[0]].pn, marks[r[0]].key) for r in items if within[r[0]] == cat))
    got = {r.seq: (r.product_id, r.is_new) for r in out["resolved"].collect()}
    assert {s: v for s, v in got.items() if v[0] != "old"} == wanted and len(got) == len(first)
    assert {r.product_id for r in out["products"].collect()} == {p for p, new in wanted.values() if new}
    listings = {(r.store_id, r.store_sku): (r.product_id, r.price_cash) for r in out["listings"].collect()}
    assert set(listings) == set(first) | {(0, "5"), (7, "1")} and listings[7, "1"] == ("other", 2.0)
    assert {(r.store_id, r.store_sku) for r in out["changes"].collect()} == set(first)


def test_null_keys_do_not_gather(spark):
    """A batch without any key resolves in one round: every item is a product of its own."""
    df = spark.range(500).select(F.col("id").alias("seq"), F.lit(0).alias("store_id"), F.col("id").cast("string").alias("store_sku"), F.lit(None).cast("string").alias("part_number"), F.lit(None).cast("string").alias("match_key"))
    none = spark.createDataFrame([], "store_id int, store_sku string, product_id string, part_number string, match_key string")
    out = ingest.resolve(df, none, none, none, rounds=1)
    assert out.where("is_new").select("product_id").distinct().count() == 500
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_pinned_listing_without_a_pin(spark):
    items = spark.createDataFrame([(1, "cpu", 5, 9), (1, "gpu", 6, None), (1, "psu", None, None)], "build_id int, category string, product_id int, listing_id int")
    listings = spark.createDataFrame([(9, 5, 0, 8.0, True), (10, 5, 1, 3.0, True), (11, 6, 1, 4.0, True)], "listing_id int, product_id int, store_id int, price_cash double, in_stock boolean")
    stores = spark.createDataFrame([(0, "a", True), (1, "b", True)], "store_id int, slug string, is_active boolean")
    best = builds.best_offers(items, listings, stores, builds.offers_by_store(listings, stores))
    assert sorted((r.category, r.price, r.store) for r in best.collect()) == [("cpu", 8.0, "a"), ("gpu", 4.0, "b")]


def test_jobs_are_seeded_once(spark):
    a, b = spark.range(3), spark.range(5)
    assert runs.seed_if_empty(a, b).count() == 3 and runs.seed_if_empty(a.limit(0), b).count() == 5


def test_changes_over_batches_equal_one_pass(spark, tmp_path):
    """Files taken one by one, the last price of a listing carried over; days are parts."""
    import datetime as dt

    from oficina.streaming import prices as streams

    rng = random.Random(11)
    rows = [(rng.randrange(4), rng.choice([1.0, 2.0, None]), rng.random() < 0.8, dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * (i - i % 3) + rng.randrange(5)), i) for i in range(120)]
    schema = "listing_id long, price_cash double, in_stock boolean, collected_at timestamp, event_id long"
    for n, at in enumerate(range(0, 120, 40)):
        spark.createDataFrame(rows[at : at + 40], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    got = streams.change_batches(stream, str(tmp_path / "a"))
    wanted, last = [], {}
    for r in sorted(rows, key=lambda r: r[3:]):
        if last.get(r[0]) != r[1:3]:
            wanted.append((r[0], r[1] or 0.0, *r[2:]))
        last[r[0]] = r[1:3]
    assert sorted(map(tuple, got.collect())) == sorted(wanted)
    one = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    many = streams.change_batches(one, str(tmp_path / "b"))
    assert many.count() >= len(wanted) and (tmp_path / "b" / "changes-last" / "2").exists()


def test_a_build_is_judged_once_and_dealt_out_once(spark):
    """No filter repeats the rules before the issues are listed, and parts of builds are moved once, not aggregated where they lie."""
    items = spark.createDataFrame([(1, 1, "cpu", 5), (1, 2, "gpu", 6)], "build_id int, seq int, category string, product_id int").withColumns({"model": F.lit(None).cast("string"), "name": F.lit("x"), "attrs": F.expr("map('has_igpu', 'false')")})
    out = compatibility.issues(compatibility.with_seeds(compatibility.snapshot(items)))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CPU_SOCKET_MISMATCH") == 1 and "RepartitionByExpression [build_id" in plan
