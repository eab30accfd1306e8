"""The price and catalog views over the driver's tables.

Each view is one portable SELECT, written once: Spark runs it over DataFrames,
DuckDB over the tables of the same names. ``view`` gives the DataFrame, ``sql`` the
common table expressions that a query's own SQL starts with.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF = "DATE '2024-01-30'"

_K = "CAST(floor(p_partkey / 8.0) AS BIGINT)"
VIEWS = {
    # A title for each part, in one of eight categories.
    "titles": f"""
SELECT p_partkey AS product_id, p_brand AS maker,
  CASE p_partkey % 8 WHEN 0 THEN 'cpu' WHEN 1 THEN 'gpu' WHEN 2 THEN 'motherboard' WHEN 3 THEN 'memory'
    WHEN 4 THEN 'storage' WHEN 5 THEN 'psu' WHEN 6 THEN 'cooler' ELSE 'case' END AS category,
  CASE p_partkey % 8
    WHEN 0 THEN CASE {_K} % 4
      WHEN 0 THEN 'Processador AMD Ryzen 7 ' || CAST(1000 * (1 + {_K} % 9) + 700 AS STRING) || 'X, 3.8GHz, 8 Núcleos, 16 Threads, AM5 - 100-100000' || lpad(CAST({_K} % 1000 AS STRING), 3, '0') || 'WOF'
      WHEN 1 THEN 'Processador Intel Core i5-' || CAST(10 + {_K} % 6 AS STRING) || '400F, LGA 1700, TDP 65W, sem vídeo'
      WHEN 2 THEN 'Processador Intel Core Ultra 5 2' || CAST(25 + {_K} % 40 AS STRING) || 'K bx8076825' || CAST({_K} % 10 AS STRING) || 'k gráficos integrados'
      ELSE CASE {_K} % 3 WHEN 0 THEN 'AMD Athlon 3000G, 3.5GHz' WHEN 1 THEN 'Contact Frame para LGA 1700' ELSE 'AMD A10-5800K, 3.8GHz, FM2' END END
    WHEN 1 THEN CASE {_K} % 5
      WHEN 0 THEN 'Placa de vídeo MSI GeForce RTX ' || CAST(2 + {_K} % 8 AS STRING) || '070 Ti 16GB GDDR7'
      WHEN 1 THEN 'Placa de vídeo Gigabyte Radeon RX ' || CAST(5 + {_K} % 5 AS STRING) || '800 XT 12GB'
      WHEN 2 THEN 'Gigabyte GTX 1660 Super 06GB' WHEN 3 THEN 'Asus RTX 3050 6GB' ELSE 'Suporte para placa de vídeo RGB' END
    WHEN 2 THEN CASE {_K} % 3 WHEN 0 THEN 'Placa-Mãe Asus TUF Gaming B650M-Plus Wifi, DDR5, Socket AM5, M-ATX'
      WHEN 1 THEN 'Placa Mãe Gigabyte H610M, Chipset H610, LGA 1700, DDR4, Micro-ATX' ELSE 'Placa-Mãe G41 LGA 775 DDR3' END
    WHEN 3 THEN CASE {_K} % 4 WHEN 0 THEN 'Memória Kingston Fury 16GB DDR5 6000MHz' WHEN 1 THEN 'Memória Corsair 8GB DDR4 para notebook'
      WHEN 2 THEN 'Memória XPG 32GB DDR5 para desktop' ELSE 'Memória Dell PowerEdge 16GB ECC DDR4' END
    WHEN 4 THEN CASE {_K} % 3 WHEN 0 THEN 'SSD WD Black 1TB NVMe' WHEN 1 THEN 'Adaptador SSD NVMe USB' ELSE 'HD Seagate Barracuda 2TB' END
    WHEN 5 THEN CASE {_K} % 3 WHEN 0 THEN 'Fonte Corsair ' || CAST(300 + 50 * ({_K} % 12) AS STRING) || 'W 80 Plus Gold' WHEN 1 THEN 'Fonte MSI 80 Plus Bronze' ELSE 'Carregador de bateria 650W' END
    WHEN 6 THEN CASE {_K} % 4 WHEN 0 THEN 'Air Cooler DeepCool AK400, AM5, LGA 1700' WHEN 1 THEN 'Cooler Fan 120mm RGB' WHEN 2 THEN 'Water Cooler 240mm AIO' ELSE 'Cooler Acer Nitro 5' END
    ELSE CASE {_K} % 2 WHEN 0 THEN 'Gabinete Gamer Mid Tower' ELSE 'Gabinete com SSD NVMe' END END AS title
FROM part""",
    # Raw specification attributes of a part: (key, text, source) with several sources.
    "spec_rows": f"""
SELECT p_partkey AS product_id, k.key, CASE k.key
    WHEN 'socket' THEN CASE p_partkey % 3 WHEN 0 THEN 'AM5' WHEN 1 THEN 'lga1700' ELSE 'am4' END
    WHEN 'tdp_w' THEN CAST(65 + 20 * (p_partkey % 12) AS STRING) || CASE p_partkey % 2 WHEN 0 THEN ',5' ELSE '' END
    WHEN 'has_igpu' THEN CASE p_partkey % 3 WHEN 0 THEN 'True' WHEN 1 THEN 'false' ELSE 'talvez' END
    ELSE CAST(p_size AS STRING) END || CASE WHEN k.key = 'size' AND k.source = 'page' THEN '0' ELSE '' END AS value_text,
  k.source, k.seq
FROM part CROSS JOIN (SELECT * FROM (VALUES ('socket', 'title', 1), ('socket', 'page', 2), ('tdp_w', 'reference', 3), ('tdp_w', 'title', 4),
  ('has_igpu', 'title', 5), ('size', 'page', 6), ('size', 'title', 7), ('size', 'manual', 8)) AS v(key, source, seq)) k
WHERE (p_partkey + k.seq) % 3 <> 0""",
    # Price observations; three listings of a product, one for each store.
    "history": """
SELECT user_id AS listing_id, CAST(floor(user_id / 3.0) AS BIGINT) AS product_id, user_id % 3 AS store_id,
  CAST(value AS DECIMAL(12,2)) AS price_cash, event_type <> 'error' AS in_stock, ts AS collected_at, CAST(ts AS DATE) AS day, event_id
FROM events""",
    # The latest observation of each listing; every fourth store is closed, every seventh price is missing.
    "listings": """
SELECT listing_id, product_id, store_id, CASE WHEN listing_id % 7 = 6 THEN NULL ELSE price_cash END AS price_cash, in_stock, collected_at AS last_seen_at FROM (
  SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY collected_at DESC, event_id DESC) AS rn FROM history) h WHERE rn = 1""",
    "stores": "SELECT v.store_id, v.slug, v.is_active FROM (VALUES (0, 'alfa', true), (1, 'beta', true), (2, 'gama', false)) AS v(store_id, slug, is_active)",
    # Products of the price views: named after parts, every listing's product has one.
    "products": """
SELECT p.product_id, t.title AS name, t.category, t.maker AS brand, date_add(DATE '2023-01-01', CAST(p.product_id % 300 AS INT)) AS created_on
FROM (SELECT DISTINCT product_id FROM history) p JOIN titles t ON t.product_id = p.product_id + 1""",
    # Builds: orders with the parts of their lines, in line order.
    "build_items": """
SELECT l_orderkey AS build_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS seq,
  l_partkey AS part_id, l_partkey % (SELECT CAST(floor(count(DISTINCT user_id) / 3.0) AS BIGINT) FROM events) AS product_id, l_linenumber AS slot, l_quantity AS quantity FROM lineitem""",
}
_NEEDS = {name: re.findall(r"\b(?:FROM|JOIN)\s+\(?(\w+)", text) for name, text in VIEWS.items()}
_NEEDS["products"] = ["history", "titles"]
_TABLES = ["part", "events", "orders", "lineitem", "customer", "supplier", "pages", "nation", "region"]


def _closure(names: list[str]) -> list[str]:
    """The views, each after those that it reads."""
    out: list[str] = []
    for n in names:
        for x in [*_closure([m for m in _NEEDS.get(n, []) if m in VIEWS]), n]:
            if x in VIEWS and x not in out:
                out.append(x)
    return out


def sql(*names: str) -> str:
    """``WITH`` and the views by name, for DuckDB; ends without a comma."""
    text = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in _closure(list(names)))
    return "WITH " + re.sub(r"date_add\((DATE '[^']*'), CAST\(([^()]*) AS INT\)\)", r"CAST(\1 + CAST(\2 AS INT) AS DATE)", text)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    frames: dict[str, DataFrame] = {}
    for n in _closure([name]):
        text = VIEWS[n]
        used = [t for t in (*frames, *_TABLES) if re.search(rf"\b(FROM|JOIN)\s+{t}\b", text)]
        for t in used:
            text = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", text)
        frames[n] = spark.sql(text, **{t: frames[t] if t in frames else table(spark, sf_dir, t) for t in used})
    return frames[name]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
