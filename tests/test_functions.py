"""Single values of the title and spec functions."""

import pytest
from pyspark.sql import functions as F

from oficina.functions import noise, specs, text


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize("f, given, wanted", [
    (text.normalize, "  Relógio  do MOTOR i5-12400F! ", "relogio do motor i512400f"),
    (text.part_number, "Processador AMD Ryzen 7 - 100-100000926WOF", "100100000926WOF"),
    (text.part_number, "Intel Core Ultra 5 bx80768250k", "BX80768250K"),
    (text.part_number, "Cooler Master Hyper 212", None),
    (text.match_key, "Processador Intel Core i5-12400F, LGA 1700", "intel 12400f"),
    (text.match_key, "Placa de vídeo Radeon RX 7800 XT 16GB", "amd 7800xt"),
    (text.match_key, "Memória Kingston Fury 16GB DDR5", None),
    (text.match_key, None, None),
    (text.price_br, "1.599,99", 1599.99), (text.price_br, "12.345,67", 12345.67), (text.price_br, "abc", None), (text.price_br, "nan", None), (text.price_br, "", None),
    (text.gpu_series, "Nvidia Geforce Msi RTX5070ti 16gb Gddr7", "rtx50"), (text.gpu_series, "Placa de vídeo RTX 9070 12GB", None),
    (text.cpu_generation, "amd 7600", "zen4"), (text.cpu_generation, "amd 1600", "zen1"), (text.cpu_generation, "intel 265f", "arrow-lake"),
    (text.cpu_generation, "intel 10400", None), (text.cpu_generation, "AMD A10-5800K, 3.8GHz, FM2", None), (text.cpu_generation, "amd 6800h", None),
    (text.clean_title, "PLACA DE VÍDEO Memória X", "Memória X"), (text.clean_title, "Outra coisa", "Outra coisa"),
])
def test_title_functions(spark, f, given, wanted):
    got = one(spark, f(F.col("t")), t=given)
    assert (float(got) if wanted.__class__ is float else got) == wanted


@pytest.mark.parametrize("category, title, wanted", [("gpu", "RTX 3050 6GB", "rtx3050-6gb"), ("cpu", "Ryzen 7 7800X3D", "r77800x3d"), ("cpu", "Core Ultra 5 245K", "u5245k"), ("gpu", "Arc B580", "arcb580"), ("psu", "RTX 3050", None)])
def test_chip_id(spark, category, title, wanted):
    assert one(spark, text.chip_id(F.col("c"), F.col("t")), c=category, t=title) == wanted


def test_brand_takes_the_first_in_order(spark):
    assert one(spark, text.brand(F.col("m"), F.col("t")), m=None, t="Placa Asus com chip AMD") == "amd"
    assert one(spark, text.brand(F.col("m"), F.col("t")), m="WD", t="AMD") == "Western Digital"
    assert one(spark, text.brand(F.col("m"), F.col("t")), m=None, t="x") == "Outros"


def test_extract_from_a_board_title(spark):
    got = one(spark, specs.extract(F.col("c"), F.col("t")), c="motherboard", t="Placa-Mãe Asus TUF Gaming B650M-Plus Wifi, DDR5, Socket AM5, M-ATX")
    assert got == {"socket": "am5", "chipset": "b650", "form_factor": "matx", "memory_type": "ddr5"}


@pytest.mark.parametrize("raw, wanted", [("2x6+2 pinos", (0, 2, 0)), ("1x12v-2x6", (1, 0, 0)), ("16 pinos", (1, 0, 0)), ("nada", None), ("", None), (None, None)])
def test_connectors(spark, raw, wanted):
    got = one(spark, specs.connectors(F.col("t")), t=raw)
    assert (tuple(got) if got else got) == wanted


@pytest.mark.parametrize("raw, wanted", [('["am4","am5"]', ["am4", "am5"]), ("am4, am5,", ["am4", "am5"]), ("[broken", []), (None, [])])
def test_text_list(spark, raw, wanted):
    assert one(spark, specs.text_list(F.col("t")), t=raw) == wanted


def test_number_list_drops_what_is_no_number(spark):
    assert [float(x) for x in one(spark, specs.number_list(F.col("t")), t="[240, 360]")] == [240, 360]
    assert [float(x) for x in one(spark, specs.number_list(F.col("t")), t="120,x,140")] == [120, 140]


@pytest.mark.parametrize("kind, raw, wanted", [
    ("gpu_memory", "GDDR6 16 GB", {"memory_type": "gddr6", "memory_gb": "16"}), ("dims", "359 x 149 x 70 mm", {"length_mm": "359", "width_mm": "149", "height_mm": "70"}),
    ("socket", "LGA 1700", {"k": "lga1700"}), ("mhz", "3,5 GHz", {"k": "3500"}), ("power", "2 x 8 pinos", {"k": "2x8pin"}), ("power", "12V-2x6", {"k": "1x16pin"}), ("pcie", "PCIe 4.0 x8", {"k": "pcie4.0x8"}),
    ("list", "HDMI / DP; DVI", {"k": "HDMI, DP, DVI"}), ("bool", "Sim", {"k": "true"}), ("bool", "Não", {"k": "false"}), ("storage_iface", "M.2 NVMe SATA", {"k": "nvme"}), ("skip", "x", {}), ("int", "  ", {}),
    ("clock_block", "Base: 1500 MHz, Boost: 2.5 GHz, Game: 2100", {"base_clock_mhz": "1500", "boost_clock_mhz": "2500", "game_clock_mhz": "2100"}), ("gpu_name_or_chip", "GB 206", {"gpu_chip": "GB 206"}),
])
def test_sheet_values(spark, kind, raw, wanted):
    assert {x["key"]: x["value"] for x in one(spark, specs.parsed(F.col("kind"), F.lit("k"), F.col("raw")), kind=kind, raw=raw)} == wanted


@pytest.mark.parametrize("key, value, wanted", [("tdp_w", "29", False), ("tdp_w", "30", True), ("tdp_w", "x", True), ("other", "9", True)])
def test_sane(spark, key, value, wanted):
    assert one(spark, specs.sane(F.col("k"), F.col("v")), k=key, v=value) is wanted


@pytest.mark.parametrize("category, title, wanted", [
    ("cpu", "Processador AMD Ryzen 5 7600X", False), ("cpu", "Contact Frame LGA 1700", True), ("cpu", "AMD Athlon 3000G", True), ("gpu", "Suporte para placa de vídeo", True), ("gpu", "Placa de vídeo RTX 5070", False),
    ("psu", "Fonte Corsair 450W 80 Plus", True), ("psu", "Fonte Corsair 750W", False), ("psu", "Fonte 80 Plus Gold", False), ("memory", "Memória 8GB DDR4 non ECC", False), ("memory", "Memória 8GB DDR4 ECC", True),
    ("storage", "SSD NVMe 1TB", False), ("storage", "Case para SSD", True), ("cooler", "Cooler Fan 120mm", True), ("cooler", "Air Cooler AK400", False), ("case", "Gabinete Gamer", False), ("case", "Gabinete com SSD", True), ("cpu", "", False), ("cpu", None, False),
])
def test_noise(spark, category, title, wanted):
    assert one(spark, noise.is_noise(F.col("c"), F.col("t")), c=category, t=title) is wanted
