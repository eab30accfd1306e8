"""Two whole ingest batches in a row against a sequential version; categories, stores and sheets that must not mix."""

import random

import pytest
from pyspark.sql import functions as F

from oficina.functions import noise, specs, text
from oficina.operators import ingest, prices, spec_sheet
from oficina.sources import anchors, pages

RAW = "seq long, store_id int, store_sku string, category string, title string, maker string, price_cash double, in_stock boolean, url string, thumbnail string, price_card double, installment_text string"
PRODUCTS = "product_id string, category string, brand string, model string, name string, part_number string, image_url string"
LISTINGS = "store_id int, store_sku string, product_id string, price_cash double, in_stock boolean, title string, url string, thumbnail string, price_card double, installment_text string"
ATTRIBUTES = "product_id string, key string, value_text string, source string"
HISTORY = "store_id int, product_id string, price_cash double, in_stock boolean"
TITLES = [
    ("cpu", "Processador AMD Ryzen 7 7700X, AM5, 8 Núcleos - 100-100000591WOF"), ("cpu", "Processador AMD Ryzen 7 7700X AM5 8 Núcleos"), ("cpu", "Processador AMD Ryzen 5 5600, AM4, 6 Núcleos"), ("cpu", "AMD Ryzen 5 5600 AM4 12 Threads"),
    ("cpu", "Contact Frame para LGA 1700"), ("cpu", "Processador Intel Core i5-13400F, LGA 1700"), ("memory", "Memória Kingston Fury 16GB DDR5 6000MHz"), ("motherboard", "Placa-Mãe Asus TUF B650M AM5 DDR5 Ryzen 5 5600"), ("storage", "SSD WD Black 1TB NVMe"),
]


def simulated(raw, facts, tables):
    """One batch after the other tables, an item at a time."""
    products, listings, attributes, history = ({**t} if isinstance(t, dict) else list(t) for t in tables)
    by_part, by_model = {}, {}
    for pid in sorted(products):
        p = products[pid]
        if p["part_number"] is not None:
            by_part.setdefault((p["category"], p["part_number"]), pid)
        if p["model"] is not None:
            by_model.setdefault((p["category"], p["model"]), pid)
    lowest = {}
    for store, pid, price, stock in history:
        if stock and price is not None:
            lowest[store, pid] = min(price, lowest.get((store, pid), price))
    drops, changed, seen = set(), {}, set()
    for r in sorted(raw, key=lambda r: r[0]):
        seq, store, sku, category, title, _, price, stock, url, thumb, card, text_ = r
        f = facts[seq]
        if f["noise"] or (store, sku) in seen:
            continue
        seen.add((store, sku))
        old = listings.get((store, sku))
        pid = old["product_id"] if old and products.get(old["product_id"], {}).get("category") == category else None
        pid = pid or by_part.get((category, f["pn"])) or by_model.get((category, f["key"]))
        if pid is None:
            pid = f"new-{seq}"
            products[pid] = {"category": category, "brand": f["brand"], "model": f["key"] or pid, "name": f["name"], "part_number": f["pn"], "image_url": thumb}
            if f["pn"]:
                by_part[category, f["pn"]] = pid
            if f["key"]:
                by_model[category, f["key"]] = pid
        else:
            p = products[pid] = {**products[pid], "name": f["name"]}
            p["image_url"] = p["image_url"] if p["image_url"] is not None else thumb
            p["part_number"] = p["part_number"] if p["part_number"] is not None else f["pn"]
        for key, value in f["specs"].items():
            had = attributes.get((pid, key))
            if had is None or (ingest.PRECEDENCE["title"] >= ingest.PRECEDENCE[had[1]] and had[0] != value):
                attributes[pid, key] = (value, "title")
                changed[pid, key] = changed.get((pid, key), 0) + 1
        listings[store, sku] = {"product_id": pid, "price_cash": price, "in_stock": stock, "title": title, "url": url, "thumbnail": old["thumbnail"] if old and old["thumbnail"] is not None else thumb, "price_card": card, "installment_text": text_}
        if stock and price is not None and (store, pid) in lowest and price < lowest[store, pid]:
            drops.add((store, pid))
    return products, listings, attributes, drops, changed


@pytest.mark.parametrize("seed", range(2))
def test_two_batches_equal_the_sequential_version(spark, seed):
    rng = random.Random(seed)

    def batch(first):
        out = []
        for i in range(first, first + 60):
            category, title = rng.choice(TITLES)
            out.append((i, rng.randrange(2), str(rng.randrange(25)), category, title, rng.choice([None, "AMD"]), rng.choice([None, 10.0, 20.0, 30.0]), rng.random() < 0.8, f"u{i}", rng.choice([None, f"t{i}"]), rng.choice([None, 11.0]), rng.choice([None, "10x"])))
        return out

    products = {"p1": {"category": "cpu", "brand": "AMD", "model": "amd 7700x", "name": "old", "part_number": None, "image_url": None}, "p2": {"category": "motherboard", "brand": "Asus", "model": "amd 5600", "name": "board", "part_number": None, "image_url": "i"}}
    listings = {(0, "3"): {"product_id": "p1", "price_cash": 10.0, "in_stock": True, "title": "old", "url": "u", "thumbnail": None, "price_card": None, "installment_text": None}}
    attributes = {("p1", "socket"): ("am4", "page"), ("p1", "cores"): ("6", "reference")}
    history = [(0, "p1", 25.0, True), (1, "p1", 5.0, True), (0, "p1", 1.0, False), (0, "p1", None, True)]
    for raw in (batch(100), batch(200)):
        df = spark.createDataFrame(raw, RAW)
        facts = {r["seq"]: r.asDict() for r in df.select("seq", noise.is_noise(F.col("category"), F.col("title")).alias("noise"), text.match_key(F.col("title")).alias("key"), text.normalize_part_number(text.part_number(F.col("title"))).alias("pn"), text.brand(F.col("maker"), F.col("title")).alias("brand"), text.clean_title(F.col("title")).alias("name"), specs.extract(F.col("category"), F.col("title")).alias("specs")).collect()}
        for f in facts.values():
            f["noise"] = bool(f["noise"])
            f["specs"] = {k: v for k, v in (f["specs"] or {}).items() if v}
        p = spark.createDataFrame([(k, *v.values()) for k, v in products.items()], PRODUCTS)
        l = spark.createDataFrame([(*k, *v.values()) for k, v in listings.items()], LISTINGS)  # noqa: E741
        a = spark.createDataFrame([(*k, *v) for k, v in attributes.items()], ATTRIBUTES)
        h = spark.createDataFrame(history, HISTORY)
        out = ingest.run(df, *ingest.known(l, p), l, p, h, a)
        products, listings, attributes, drops, changed = simulated(raw, facts, (products, listings, attributes, history))
        got = {r.product_id: {k: v for k, v in r.asDict().items() if k != "product_id"} for r in out["catalog"].collect()}
        assert got == products
        assert {(r.store_id, r.store_sku): {c: r[c] for c in next(iter(listings.values()))} for r in out["listings"].collect()} == listings
        assert {(r.store_id, r.product_id) for r in out["drops"].collect()} == drops
        assert {(r.product_id, r.key): (r.value_text, r.source) for r in out["attributes"].collect()} == attributes
        assert {(r.product_id, r.key): r.changes for r in out["attribute_changes"].collect()} == changed
        history = history + [(k[0], v["product_id"], v["price_cash"], v["in_stock"]) for k, v in listings.items()]


def test_products_of_two_categories_stay_two(spark):
    raw = [(1, 0, "a", "cpu", "Processador AMD Ryzen 5 5600, AM4"), (2, 0, "b", "motherboard", "Placa-Mãe B550 AM4 com Ryzen 5 5600"), (3, 1, "c", "cpu", "AMD Ryzen 5 5600 AM4")]
    df = spark.createDataFrame(raw, "seq long, store_id int, store_sku string, category string, title string").withColumns({"match_key": text.match_key(F.col("title")), "part_number": F.lit(None).cast("string")})
    assert {r.match_key for r in df.collect()} == {"amd 5600"}
    none = spark.createDataFrame([], "category string, store_id int, store_sku string, product_id string, part_number string, match_key string")
    got = {r.seq: (r.product_id, r.is_new) for r in ingest.resolve(df, none, none, none).collect()}
    assert got == {1: ("new-1", True), 2: ("new-2", True), 3: ("new-1", False)}


def test_drops_are_within_a_store(spark):
    batch = spark.createDataFrame([(0, "p", 9.0, True), (1, "p", 9.0, True), (1, "q", 1.0, False), (2, "p", 1.0, True)], HISTORY)
    history = spark.createDataFrame([(0, "p", 10.0, True), (1, "p", 8.0, True), (1, "q", 5.0, True), (0, "p", 1.0, False)], HISTORY)
    assert [tuple(r) for r in prices.price_drops(batch, history).collect()] == [(0, "p")]


def test_the_second_sheet_wins_whole_keys(spark):
    import json

    doc = {"props": {"pageProps": {"product": {"description": "<p>Especificações</p><ul><li>Saídas de vídeo: HDMI  2.1, DP</li><li>Comprimento:\t300 mm\t</li></ul>", "technicalInformation": {"text": "<ul><li>Saídas de vídeo: DP\t 1.4a</li></ul>"}}}}}
    html = f'<script id="__NEXT_DATA__" type="application/json">{json.dumps(doc)}</script>'
    pairs = pages.product_sheets(spark.createDataFrame([(1, html)], "page_id int, html string"), ["page_id"], "html")
    got = {r.key: r.value for r in spec_sheet.mapped(pairs.withColumn("category", F.lit("gpu")), spec_sheet.rules(spark)).collect()}
    assert got == {"video_outputs": "DP 1.4a", "length_mm": "300"}


def test_blanks_of_any_kind_go(spark):
    df = spark.createDataFrame([(1, "<tr><th>\tCor </th><td>\t16 GB \t</td></tr><p><strong>A</strong>:\t b \n</p>")], "id int, html string")
    assert [(r.label, r.value) for r in pages.table_pairs(df, ["id"], "html").collect()] == [("Cor", "16 GB"), ("A", "b")]
    got = spark.range(1).select(specs.parsed(F.lit("list"), F.lit("k"), F.lit("HDMI  2.1 x,\t- DP\t1.4 -\n\n|x")).alias("x")).first().x
    assert [v.value for v in got] == ["HDMI 2.1 x, DP 1.4, x"]


def raw_batch(rng, first, n=60):
    out = []
    for i in range(first, first + n):
        category, title = rng.choice(TITLES)
        out.append((i, rng.randrange(2), str(rng.randrange(25)), category, title, rng.choice([None, "AMD"]), rng.choice([None, 10.0, 20.0]), rng.random() < 0.8, f"u{i}", None, None, None))
    return out


def scans(plan, name):
    """How many scans of a table a physical plan has, and how many of them stand under a shuffle of their own rows."""
    n = moved = 0

    def walk(node, shuffled):
        nonlocal n, moved
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan(), shuffled)
        if kind == "FileSourceScanExec" and name in node.toString():
            n += 1
            moved += shuffled
        for i in range(node.children().size()):
            # What comes out of a join or an aggregate has the size of the batch.
            walk(node.children().apply(i), kind == "ShuffleExchangeExec" or (shuffled and kind not in ("SortMergeJoinExec", "BroadcastHashJoinExec", "ShuffledHashJoinExec")))

    walk(plan, False)
    return n, moved


def test_batches_through_the_standing_index_equal_the_sequential_version(spark, tmp_path):
    rng = random.Random(10)
    name = "anchors_two"
    anchors.create(spark, name, str(tmp_path / "anchors"), buckets=8)
    products = {"p1": {"category": "cpu", "brand": "AMD", "model": "amd 7700x", "name": "old", "part_number": None, "image_url": None}, "p2": {"category": "motherboard", "brand": "Asus", "model": "amd 5600", "name": "board", "part_number": None, "image_url": "i"}}
    listings = {(0, "3"): {"product_id": "p1", "price_cash": 10.0, "in_stock": True, "title": "old", "url": "u", "thumbnail": None, "price_card": None, "installment_text": None}}
    frame = lambda t, schema: spark.createDataFrame([(*(k if isinstance(k, tuple) else (k,)), *v.values()) for k, v in t.items()], schema)
    anchors.seed(frame(products, PRODUCTS), frame(listings, LISTINGS), name, 0)
    for number, raw in enumerate((raw_batch(rng, 100), raw_batch(rng, 200)), 1):
        df = spark.createDataFrame(raw, RAW)
        facts = {r["seq"]: r.asDict() for r in df.select("seq", F.coalesce(noise.is_noise(F.col("category"), F.col("title")), F.lit(False)).alias("noise"), text.match_key(F.col("title")).alias("key"), text.normalize_part_number(text.part_number(F.col("title"))).alias("pn"), text.brand(F.col("maker"), F.col("title")).alias("brand"), text.clean_title(F.col("title")).alias("name")).collect()}
        for f in facts.values():
            f["specs"] = {}
        # Twice: a repeated batch finds and writes the same.
        for _ in range(2):
            out = ingest.run(df, *anchors.lookup(ingest.arrivals(df), name, number), frame(listings, LISTINGS), frame(products, PRODUCTS))
            anchors.extend(out["resolved"], name, number)
        after = simulated(raw, facts, (products, listings, {}, []))
        assert {r.product_id: {k: v for k, v in r.asDict().items() if k != "product_id"} for r in out["catalog"].collect()} == after[0]
        assert {(r.store_id, r.store_sku): r.product_id for r in out["listings"].collect()} == {k: v["product_id"] for k, v in after[1].items()}
        products, listings = after[:2]
        # The index stands as if it were written anew from the catalog: same answers to every key.
        again = ingest.known(frame(listings, LISTINGS), frame(products, PRODUCTS))
        items = ingest.arrivals(spark.createDataFrame(raw_batch(random.Random(99), 1000, 200), RAW)).select("store_id", "store_sku", "category", "part_number", "match_key")
        for mine, theirs in zip(anchors.lookup(items, name, number + 1), again):
            keys = [c for c in theirs.columns if c != "product_id"]
            theirs = theirs.join(items.withColumn("part_number", text.normalize_part_number(F.col("part_number"))).select(*[c for c in keys if c != "category"], *(["category"] if "store_id" not in keys else [])).distinct(), [c for c in keys if c != "category" or "store_id" not in keys], "left_semi")
            assert sorted(map(repr, (r.asDict() for r in mine.select(sorted(mine.columns)).collect()))) == sorted(map(repr, (r.asDict() for r in theirs.select(sorted(theirs.columns)).collect())))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for frame_ in anchors.lookup(ingest.arrivals(df), name, 9):
            assert scans(frame_._jdf.queryExecution().executedPlan(), name) == (1, 0)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE {name}")


def test_an_index_registered_again_is_the_same_and_odd_keys_stay_apart(spark, tmp_path):
    path, schema = str(tmp_path / "a"), "seq long, store_id int, store_sku string, category string, part_number string, match_key string, product_id string, is_new boolean"
    rows = [(1, None, "1 2", "cpu", None, None, "a", True), (2, 1, None, "cpu", "", "", "b", True), (3, 1, "", None, None, "x", "c", True)]
    anchors.create(spark, "anchors_a", path, buckets=4)
    anchors.extend(spark.createDataFrame(rows, schema), "anchors_a", 1)
    anchors.extend(spark.createDataFrame([], schema), "anchors_a", 2)
    spark.sql("DROP TABLE anchors_a")
    anchors.create(spark, "anchors_b", path, buckets=4)
    skus, parts, models = anchors.lookup(spark.createDataFrame(rows, schema), "anchors_b", 3)
    assert sorted((r.store_id is None, r.store_sku or "", r.product_id) for r in skus.collect()) == [(False, "", "b"), (False, "", "c"), (True, "1 2", "a")]
    assert sorted((r.match_key, r.product_id) for r in models.collect()) == [("", "b"), ("x", "c")]
    assert anchors.lookup(spark.createDataFrame(rows, schema), "anchors_b", 1)[0].isEmpty()
    spark.sql("DROP TABLE anchors_b")
