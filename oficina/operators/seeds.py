"""Editorial seeds: consumption by name or model, and which processor generations a chipset supports. Readers for other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATEGORIES = ["cpu", "gpu"]
TARGETS = ["name", "model"]

# Fixed values: (category, target, pattern, watts); the first pattern that fits counts, those for names before those for models.
WATTS = [
    ("cpu", "model", "amd 5700x3d", 105),
    ("cpu", "model", "amd 5700(x|g|ge)?", 65),
    ("cpu", "model", "amd 5600x3d", 105),
    ("cpu", "model", "amd 5600(x|g|ge|gt)?", 65),
    ("cpu", "model", "amd 5500(gt)?", 65),
    ("cpu", "model", "amd 5800x3d", 105),
    ("cpu", "model", "amd 5800x", 105),
    ("cpu", "model", "amd 5800(g)?", 65),
    ("cpu", "model", "amd 5900x", 105),
    ("cpu", "model", "amd 5950x", 105),
    ("cpu", "model", "amd 7600x3d", 65),
    ("cpu", "model", "amd 7600x", 105),
    ("cpu", "model", "amd 7600", 65),
    ("cpu", "model", "amd 7700x", 105),
    ("cpu", "model", "amd 7700", 65),
    ("cpu", "model", "amd 7800x3d", 120),
    ("cpu", "model", "amd 7900x3d", 120),
    ("cpu", "model", "amd 7900x", 170),
    ("cpu", "model", "amd 7900", 65),
    ("cpu", "model", "amd 7950x3d", 120),
    ("cpu", "model", "amd 7950x", 170),
    ("cpu", "model", "amd 8400f", 65),
    ("cpu", "model", "amd 8600g", 65),
    ("cpu", "model", "amd 8700g", 65),
    ("cpu", "model", "amd 9600x", 65),
    ("cpu", "model", "amd 9600", 65),
    ("cpu", "model", "amd 9700x", 65),
    ("cpu", "model", "amd 9700", 65),
    ("cpu", "model", "amd 9800x3d", 120),
    ("cpu", "model", "amd 9900x3d", 120),
    ("cpu", "model", "amd 9900x", 120),
    ("cpu", "model", "amd 9900", 65),
    ("cpu", "model", "amd 9950x3d", 170),
    ("cpu", "model", "amd 9950x", 170),
    ("cpu", "model", "intel i3 1[234]100(f|t)?", 60),
    ("cpu", "model", "intel i5 9400(f)?", 65),
    ("cpu", "model", "intel i5 10[46]00(f)?", 65),
    ("cpu", "model", "intel i5 11[46]00(f)?", 65),
    ("cpu", "model", "intel i5 1[234]400(f)?", 65),
    ("cpu", "model", "intel i5 1[234]600k(f)?", 125),
    ("cpu", "model", "intel i7 9700(f)?", 65),
    ("cpu", "model", "intel i7 10[79]00(f)?", 65),
    ("cpu", "model", "intel i7 11700(f)?", 65),
    ("cpu", "model", "intel i7 1[234]700(f)?", 65),
    ("cpu", "model", "intel i7 1[234]700k(f)?", 125),
    ("cpu", "model", "intel i9 9900k(f)?", 95),
    ("cpu", "model", "intel i9 10900k(f)?", 125),
    ("cpu", "model", "intel i9 10900(f)?", 65),
    ("cpu", "model", "intel i9 11900k", 125),
    ("cpu", "model", "intel i9 11900(f)?", 65),
    ("cpu", "model", "intel i9 1[234]900k(f)?", 125),
    ("cpu", "model", "intel i9 1[234]900(f)?", 65),
    ("cpu", "model", "intel ultra [579] 2[48]5k(f)?", 125),
    ("gpu", "name", "rtx 5090", 575),
    ("gpu", "name", "rtx 5080", 360),
    ("gpu", "name", "rtx 5070 ti", 300),
    ("gpu", "name", "rtx 5070", 250),
    ("gpu", "name", "rtx 5060 ti", 180),
    ("gpu", "name", "rtx 5060", 145),
    ("gpu", "name", "rtx 4090", 450),
    ("gpu", "name", "rtx 4080 super", 320),
    ("gpu", "name", "rtx 4080", 320),
    ("gpu", "name", "rtx 4070 ti super", 285),
    ("gpu", "name", "rtx 4070 super", 220),
    ("gpu", "name", "rtx 4070 ti", 285),
    ("gpu", "name", "rtx 4070", 200),
    ("gpu", "name", "rtx 4060 ti", 160),
    ("gpu", "name", "rtx 4060", 115),
    ("gpu", "name", "rtx 3090 ti", 450),
    ("gpu", "name", "rtx 3090", 350),
    ("gpu", "name", "rtx 3080 ti", 350),
    ("gpu", "name", "rtx 3080", 320),
    ("gpu", "name", "rtx 3070 ti", 290),
    ("gpu", "name", "rtx 3070", 220),
    ("gpu", "name", "rtx 3060 ti", 200),
    ("gpu", "name", "rtx 3060", 170),
    ("gpu", "name", "rtx 3050", 130),
    ("gpu", "name", "gtx 1660 super", 125),
    ("gpu", "name", "gtx 1660 ti", 120),
    ("gpu", "name", "gtx 1660", 120),
    ("gpu", "name", "gtx 1650 super", 100),
    ("gpu", "name", "gtx 1650", 75),
    ("gpu", "name", "gtx 1630", 75),
    ("gpu", "name", "rx 9070 xt", 304),
    ("gpu", "name", "rx 9070", 220),
    ("gpu", "name", "rx 9060 xt 16gb", 250),
    ("gpu", "name", "rx 9060 xt 8gb", 225),
    ("gpu", "name", "rx 9060 xt", 250),
    ("gpu", "name", "rx 7900 xtx", 355),
    ("gpu", "name", "rx 7900 xt", 315),
    ("gpu", "name", "rx 7900 gre", 260),
    ("gpu", "name", "rx 7800 xt", 263),
    ("gpu", "name", "rx 7700 xt", 245),
    ("gpu", "name", "rx 7600 xt", 150),
    ("gpu", "name", "rx 7600", 165),
    ("gpu", "name", "rx 6950 xt", 335),
    ("gpu", "name", "rx 6900 xt", 300),
    ("gpu", "name", "rx 6800 xt", 300),
    ("gpu", "name", "rx 6800", 250),
    ("gpu", "name", "rx 6750 xt", 250),
    ("gpu", "name", "rx 6700 xt", 230),
    ("gpu", "name", "rx 6700", 175),
    ("gpu", "name", "rx 6650 xt", 176),
    ("gpu", "name", "rx 6600 xt", 160),
    ("gpu", "name", "rx 6600", 132),
    ("gpu", "name", "rx 6500 xt", 107),
    ("gpu", "name", "rx 6400", 53),
    ("gpu", "name", "rx 5700 xt", 225),
    ("gpu", "name", "rx 5700", 185),
    ("gpu", "name", "rx 5600 xt", 160),
    ("gpu", "name", "rx 5500 xt", 160),
    ("gpu", "name", "rx 590", 225),
    ("gpu", "name", "rx 580", 185),
    ("gpu", "name", "rx 570", 150),
    ("gpu", "name", "rx 480", 150),
    ("gpu", "name", "arc a770", 225),
    ("gpu", "name", "arc a750", 150),
    ("gpu", "name", "arc a380", 75),
    ("gpu", "model", "nvidia 4090", 450),
    ("gpu", "model", "nvidia 4080", 320),
    ("gpu", "model", "nvidia 4070", 200),
    ("gpu", "model", "nvidia 4060", 160),
    ("gpu", "model", "nvidia 3090", 350),
    ("gpu", "model", "nvidia 3080", 320),
    ("gpu", "model", "nvidia 3070", 220),
    ("gpu", "model", "nvidia 3060", 170),
    ("gpu", "model", "nvidia 3050", 130),
    ("gpu", "model", "amd 9060xt", 250),
    ("gpu", "model", "amd 9070xt", 304),
    ("gpu", "model", "amd 9070", 220),
    ("gpu", "model", "amd 7900xtx", 355),
    ("gpu", "model", "amd 7900xt", 315),
    ("gpu", "model", "amd 7800xt", 263),
    ("gpu", "model", "amd 7700xt", 245),
    ("gpu", "model", "amd 7600", 165),
    ("gpu", "model", "amd 6600", 132),
    ("gpu", "model", "amd 5700", 185),
    ("gpu", "model", "amd 580", 185),
]

# Fixed values: (chipset, socket, generation, BIOS that the generation needs).
CHIPSETS = [
    ("a320", "am4", "zen1", None),
    ("a320", "am4", "zen2", None),
    ("a320", "am4", "zen3", "AGESA ComboAM4v2 PI 1.2.0.7"),
    ("b350", "am4", "zen1", None),
    ("b350", "am4", "zen2", None),
    ("b350", "am4", "zen3", "AGESA ComboAM4v2 PI 1.2.0.7"),
    ("x370", "am4", "zen1", None),
    ("x370", "am4", "zen2", None),
    ("x370", "am4", "zen3", "AGESA ComboAM4v2 PI 1.2.0.7"),
    ("b450", "am4", "zen1", None),
    ("b450", "am4", "zen2", None),
    ("b450", "am4", "zen3", "AGESA ComboAM4v2 PI 1.2.0.7"),
    ("x470", "am4", "zen1", None),
    ("x470", "am4", "zen2", None),
    ("x470", "am4", "zen3", "AGESA ComboAM4v2 PI 1.2.0.7"),
    ("a520", "am4", "zen2", None),
    ("a520", "am4", "zen3", None),
    ("b550", "am4", "zen2", None),
    ("b550", "am4", "zen3", None),
    ("x570", "am4", "zen2", None),
    ("x570", "am4", "zen3", None),
    ("a620", "am5", "zen4", None),
    ("a620", "am5", "zen5", "AGESA 1.2.0.2"),
    ("b650", "am5", "zen4", None),
    ("b650", "am5", "zen5", "AGESA 1.2.0.2"),
    ("x670", "am5", "zen4", None),
    ("x670", "am5", "zen5", "AGESA 1.2.0.2"),
    ("b840", "am5", "zen4", None),
    ("b840", "am5", "zen5", None),
    ("x870", "am5", "zen4", None),
    ("x870", "am5", "zen5", None),
    ("h610", "lga1700", "alder-lake", None),
    ("h610", "lga1700", "raptor-lake", None),
    ("h610", "lga1700", "raptor-lake-refresh", "BIOS 2402"),
    ("b660", "lga1700", "alder-lake", None),
    ("b660", "lga1700", "raptor-lake", None),
    ("b660", "lga1700", "raptor-lake-refresh", "BIOS 2402"),
    ("h670", "lga1700", "alder-lake", None),
    ("h670", "lga1700", "raptor-lake", None),
    ("h670", "lga1700", "raptor-lake-refresh", "BIOS 2402"),
    ("z690", "lga1700", "alder-lake", None),
    ("z690", "lga1700", "raptor-lake", None),
    ("z690", "lga1700", "raptor-lake-refresh", "BIOS 2402"),
    ("b760", "lga1700", "alder-lake", None),
    ("b760", "lga1700", "raptor-lake", None),
    ("b760", "lga1700", "raptor-lake-refresh", None),
    ("z790", "lga1700", "alder-lake", None),
    ("z790", "lga1700", "raptor-lake", None),
    ("z790", "lga1700", "raptor-lake-refresh", None),
    ("h810", "lga1851", "arrow-lake", None),
    ("b860", "lga1851", "arrow-lake", None),
    ("z890", "lga1851", "arrow-lake", None),
]


def watts(spark: SparkSession) -> DataFrame:
    """(pos, category, target, pattern, watts) of the seeds above."""
    return spark.createDataFrame([(i, *w) for i, w in enumerate(WATTS)], "pos long, category string, target string, pattern string, watts int")


def chipsets(spark: SparkSession) -> DataFrame:
    """(chipset, socket, generation, bios) of the seeds above."""
    return spark.createDataFrame(CHIPSETS, "chipset string, socket string, generation string, bios string")


def _entries(spark: SparkSession, path: str, schema: str, name: str) -> DataFrame:
    """Numbered entries of the list ``name`` in a JSON document; anything that is not such a document is refused."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", f"{name} array<struct<{schema}>>").alias("d"))
    rows = text.select(F.explode_outer(f"d.{name}").alias("e"), F.col("d").isNull().alias("broken"), F.col(f"d.{name}").isNull().alias("empty"))
    if rows.where("broken OR empty").limit(1).collect():
        raise ValueError(f"no list of {name} in {path}")
    return text.select(F.posexplode(f"d.{name}").alias("pos", "e"))


def read_watts(spark: SparkSession, path: str) -> DataFrame:
    """Consumption seeds from a JSON document with ``entries``; unknown categories and targets, missing patterns and watts are refused."""
    table = _entries(spark, path, "category string, target string, pattern string, watts int", "entries").select(F.col("pos").cast("long").alias("pos"), "e.*")
    fit = F.col("category").isin(CATEGORIES) & F.col("target").isin(TARGETS) & F.col("pattern").isNotNull() & F.col("watts").isNotNull()
    odd = table.where(~F.coalesce(fit, F.lit(False))).orderBy("pos").limit(1).collect()
    if odd:
        raise ValueError(f"not a consumption seed: {odd[0].asDict()}")
    return table


def read_chipsets(spark: SparkSession, path: str) -> DataFrame:
    """Chipset seeds from a JSON document with ``chipsets``, a row for each generation; nameless ones are refused."""
    table = _entries(spark, path, "name string, socket string, generations array<struct<id: string, bios: string>>", "chipsets").select("e.*")
    rows = table.select(F.col("name").alias("chipset"), "socket", F.explode_outer("generations").alias("g")).select("chipset", "socket", F.col("g.id").alias("generation"), "g.bios")
    odd = rows.where("coalesce(chipset, '') = '' OR coalesce(generation, '') = ''").limit(1).collect()
    if odd:
        raise ValueError(f"not a chipset seed: {odd[0].asDict()}")
    return rows
