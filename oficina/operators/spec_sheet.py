"""Spec sheet pairs to canonical attributes by a table of label rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.specs import parsed, sane
from ..functions.text import normalize
from ..sources.shared import cut, stored
from .matching import longest_label

LEFT_OVER = 12
#: Labels with a rule that are sent to every task; of more, the rows meet them in a plain join.
SENT = 100_000
JOINED_KINDS = ["list", "iface_or_outputs"]
# Fixed values: (category, normalised label, key or null, kind). A larger table is given as a DataFrame.
LABELS = [
    ("gpu", "memoria", None, "gpu_memory"), ("gpu", "dimensoes", None, "dims"), ("gpu", "interface de memoria", "memory_bus_bits", "bits"), ("gpu", "interface", None, "iface_or_outputs"),
    ("gpu", "clock", None, "clock_block"), ("gpu", "nucleos cuda", "cuda_cores", "int"), ("gpu", "conectores de energia", "power_connectors", "power"), ("gpu", "fonte recomendada", "recommended_psu_w", "int"),
    ("gpu", "suporte a apis", None, "apis_block"), ("gpu", "gpu", None, "gpu_name_or_chip"), ("gpu", "garantia", None, "skip"), ("cpu", "soquete", "socket", "socket"), ("cpu", "nucleos", "cores", "int"),
    ("cpu", "threads", "threads", "int"), ("cpu", "tdp", "tdp_w", "int"), ("cpu", "clock base", "base_clock_mhz", "mhz"), ("cpu", "graficos integrados", "has_igpu", "bool"),
    ("gpu", "motor grafico", "gpu_model", "text"), ("gpu", "arquitetura", "gpu_architecture", "text"), ("gpu", "padrao de onibus", "interface", "pcie"), ("gpu", "barramento", "interface", "pcie"),
    ("gpu", "directx", "directx", "text"), ("gpu", "opengl", "opengl", "text"), ("gpu", "relogio do motor", None, "clock_block"), ("gpu", "relogio base", "base_clock_mhz", "mhz"),
    ("gpu", "relogio boost", "boost_clock_mhz", "mhz"), ("gpu", "relogio de memoria", "memory_clock_gbps", "gbps"), ("gpu", "tamanho de memoria", None, "gpu_memory"), ("gpu", "tipo de memoria", "memory_type", "mem_type"),
    ("gpu", "largura de banda", "bandwidth_gbps", "gbps"), ("gpu", "processadores de fluxo", "stream_processors", "int"), ("gpu", "nucleos tensor", "tensor_cores", "int"), ("gpu", "nucleos rt", "rt_cores", "int"),
    ("gpu", "resolucao maxima", "max_resolution", "text"), ("gpu", "saidas de video", "video_outputs", "list"), ("gpu", "entradas", "video_outputs", "list"), ("gpu", "hdcp", "hdcp", "bool"),
    ("gpu", "consumo", "tdp_w", "int"), ("gpu", "tdp", "tdp_w", "int"), ("gpu", "comprimento", "length_mm", "int"), ("gpu", "litografia", "process_nm", "int"), ("gpu", "peso", "weight", "text"), ("gpu", "marca", None, "skip"), ("gpu", "modelo", None, "skip"),
    ("cpu", "clock boost", "boost_clock_mhz", "mhz"), ("cpu", "cache l2", "cache_l2_mb", "int"), ("cpu", "cache l3", "cache_l3_mb", "int"), ("cpu", "tipo de memoria", "memory_type", "mem_type"),
    ("cpu", "cooler incluso", "cooler_included", "bool"), ("cpu", "litografia", "process_nm", "int"), ("cpu", "marca", None, "skip"), ("cpu", "modelo", None, "skip"),
    ("memory", "capacidade", "capacity_gb", "int"), ("memory", "velocidade", "speed_mhz", "int"), ("memory", "latencia", "cas_latency", "int"), ("memory", "tensao", "voltage_v", "num"), ("memory", "rgb", "rgb", "bool"),
    ("storage", "capacidade", "capacity_gb", "int"), ("storage", "leitura", "read_mbps", "int"), ("storage", "gravacao", "write_mbps", "int"), ("storage", "tbw", "tbw", "int"), ("storage", "formato", "form_factor", "text"),
    ("psu", "eficiencia", "efficiency", "text"), ("psu", "modular", "modular", "bool"), ("psu", "conectores", "connectors", "list"), ("psu", "ventoinha", "fan_mm", "int"), ("psu", "dimensoes", None, "dims"),
    ("motherboard", "soquete", "socket", "socket"), ("motherboard", "memoria maxima", "max_memory_gb", "int"), ("motherboard", "slots m.2", "m2_slots", "int"), ("motherboard", "sata", "sata_ports", "int"), ("motherboard", "rede", "network", "text"),
    ("cooler", "soquetes suportados", "socket_support", "list"), ("cooler", "altura", "height_mm", "int"), ("cooler", "radiador", "radiator_mm", "int"), ("cooler", "rpm", "max_rpm", "int"), ("cooler", "ruido", "noise_dba", "num"),
    ("case", "formatos suportados", "supported_form_factors", "list"), ("case", "placa de video", "max_gpu_length_mm", "int"), ("case", "altura cooler", "max_cooler_height_mm", "int"), ("case", "radiador", "radiator_support_mm", "list"), ("case", "dimensoes", None, "dims"),
    ("motherboard", "memoria", None, "mobo_memory"), ("motherboard", "chipset", "chipset", "chipset"), ("motherboard", "formato", "form_factor", "form_factor"),
    ("storage", "interface", "interface", "storage_iface"), ("cooler", "tipo", "type", "cooler_type"), ("memory", "tipo", "type", "mem_type"), ("psu", "potencia", "wattage", "int"),
]


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LABELS, "category string, rule string, key string, kind string").withColumn("rule", normalize(F.col("rule")))


KINDS = [
    "int", "num", "mhz", "gbps", "bits", "pcie", "power", "bool", "list", "mem_type", "socket", "form_factor", "chipset", "storage_iface", "cooler_type", "text", "skip",
    "gpu_memory", "mobo_memory", "clock_block", "dims", "iface_or_outputs", "apis_block", "gpu_name_or_chip",
]


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """A whole label table from JSON lines (category, label, key, kind): labels normalised, unknown kinds refused."""
    table = spark.read.schema("category string, label string, key string, kind string").json(path)
    odd = table.where(F.col("category").isNull() | F.col("label").isNull() | ~F.coalesce(F.col("kind").isin(KINDS), F.lit(False))).limit(1).collect()
    if odd:
        raise ValueError(f"not a label rule: {odd[0].asDict()}")
    return table.select("category", normalize(F.col("label")).alias("rule"), "key", "kind").distinct()


def matched(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Pairs with the rule of their label: the equal label, else the longest one inside it that leaves at most 12 characters.

    Each label of a category is looked up once, through an index of the rules. The pairs are stored first, so that pages are read into
    lines once, not for their labels and again for their values.
    """
    rows = stored(pairs.withColumn("__label", normalize(F.col("label"))), "pairs")
    labels = rows.select("category", F.col("__label").alias("label")).distinct()
    best = cut(longest_label(labels, table, LEFT_OVER).withColumnsRenamed({"category": "__c", "label": "__l"}))
    # A table of pairs is small on disk and large in memory: without a hint the driver might be the one to hold it.
    best = best.hint("broadcast") if best.limit(SENT + 1).count() <= SENT else best.hint("merge")
    return rows.join(best, (F.col("category") == F.col("__c")) & (F.col("__label") == F.col("__l"))).drop("__c", "__l", "__label")


def mapped(pairs: DataFrame, table: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, key, value): the last value of each key; list kinds are joined in order; each part cut at 256 characters.

    Where pairs have a ``sheet``, each sheet is mapped by itself and the highest one that has a key gives its value.
    """
    m = matched(pairs if "sheet" in pairs.columns else pairs.withColumn("sheet", F.lit(0)), table)
    # Outer, since Spark would otherwise parse every value twice more to drop those that give nothing.
    v = m.select(page, "sheet", "pos", "kind", F.posexplode_outer(parsed(F.col("kind"), F.col("key"), F.col("value"))).alias("sub", "x")).where("x IS NOT NULL").select(page, "sheet", "pos", "sub", "kind", "x.*")
    v = v.where(sane(F.col("key"), F.col("value"))).withColumn("value", F.substring("value", 1, 256))
    at = F.struct("pos", "sub")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sub", "value"))), lambda x: x["value"]), ", ")
    g = v.groupBy(page, "key", "sheet").agg(joined.alias("__all"), F.max_by("value", at).alias("__last"), F.max_by("kind", at).alias("__kind"))
    value = F.when(F.col("__kind").isin(*JOINED_KINDS), F.col("__all")).otherwise(F.col("__last"))
    return g.groupBy(page, "key").agg(F.max_by(value, "sheet").alias("value"))
