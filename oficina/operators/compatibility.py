"""Do the parts of a build fit together? Sixteen rules over one row per build.

A part is (category, product_id, model, name, attrs): attrs maps lower-case keys to
text. What the rules look at is read and parsed once per part (``typed``), before parts meet builds. A rule fires only when everything it looks at is known; Spark's three-valued logic
gives that for free, since ``when(NULL)`` does not fire.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.specs import chipset_key, connectors, number_list, satisfies, text_list, value_bool, value_num
from ..functions.text import cpu_generation, normalize, once
from . import seeds
from .matching import first_pattern

SINGLE = ["cpu", "gpu", "motherboard", "psu", "cooler", "case"]
MANY = ["memory", "storage"]
OVERHEAD_W = 100
HEADROOM = "1.4"
def attribute_map(attributes: DataFrame) -> DataFrame:
    """(product_id, attrs): merged attributes as one map with lower-case keys."""
    pair = F.struct(F.lower("key").alias("k"), "value_text")
    latest = attributes.groupBy("product_id", F.lower("key").alias("key")).agg(F.max("value_text").alias("value_text"))
    return latest.groupBy("product_id").agg(F.map_from_entries(F.collect_list(pair)).alias("attrs"))


#: Attributes that the rules look at, as texts and as numbers.
TEXTS = ["socket", "chipset", "memory_type", "type", "form_factor", "form_factor_support", "socket_support", "radiator_support_mm", "interface", "connectors", "power_connectors", "has_igpu"]
NUMBERS = [
    "tdp_w", "max_memory_gb", "memory_slots", "capacity_gb", "modules", "speed_mhz", "max_memory_speed_mhz", "length_mm", "max_gpu_length_mm",
    "height_mm", "max_cooler_height_mm", "radiator_mm", "m2_slots", "wattage", "recommended_psu_w",
]


def seeded(parts: DataFrame, seed_watts: DataFrame | None = None) -> DataFrame:
    """Adds ``seed_w``: what the consumption seeds say of a processor or card, by its name or model.

    Each pair of name and model is looked up once, however many parts and builds have it.
    """
    table = seeds.watts(parts.sparkSession) if seed_watts is None else seed_watts
    names = parts.where(F.col("category").isin(seeds.CATEGORIES)).select("category", "name", "model").distinct()
    found = first_pattern(names.withColumns({"__name": normalize(F.col("name")), "__model": F.lower("model")}), table)
    found = found.select(F.col("category").alias("__c"), F.col("name").alias("__n"), F.col("model").alias("__m"), F.col("watts").cast("decimal(18,4)").alias("seed_w"))
    same = (F.col("category") == F.col("__c")) & F.col("name").eqNullSafe(F.col("__n")) & F.col("model").eqNullSafe(F.col("__m"))
    return parts.join(found, same, "left").drop("__c", "__n", "__m")


def typed(parts: DataFrame, *keep: str, seed_watts: DataFrame | None = None) -> DataFrame:
    """(keep..., product_id, category, part): each part as a struct of its names and of the attributes that rules look at."""
    parts = seeded(parts, seed_watts)
    raw = lambda k: F.nullif(F.trim(F.try_element_at("attrs", F.lit(k))), F.lit(""))
    fields = [*[raw(k).alias(k) for k in TEXTS], *[value_num(raw(k)).alias(f"{k}_n") for k in NUMBERS]]
    return parts.select(*keep, "product_id", "category", F.struct("product_id", "model", "name", "seed_w", *fields).alias("part"))


def snapshot(items: DataFrame) -> DataFrame:
    """One row per build from (build_id, seq, category, part): the first part of each single category, all memory and storage parts.

    Parts that aren't typed yet (model, name, attrs) are typed first.
    """
    if "part" not in items.columns:
        items = typed(items, "build_id", "seq")
    first = lambda cat: F.min_by(F.when(F.col("category") == cat, F.col("part")), F.when(F.col("category") == cat, F.col("seq")))
    every = lambda cat: F.transform(F.array_sort(F.collect_list(F.when(F.col("category") == cat, F.struct("seq", "part")))), lambda x: x["part"])
    # Rows lie by part here, so a first aggregation where they lie would join nothing and only make them wider.
    return items.repartition("build_id").groupBy("build_id").agg(*[first(c).alias(c) for c in SINGLE], *[every(c).alias(c) for c in MANY])


def text(slot: Column, key: str) -> Column:
    return slot[key]


def low(slot: Column, key: str) -> Column:
    return F.lower(text(slot, key))


def num(slot: Column, key: str) -> Column:
    return slot[f"{key}_n"]


def flag(slot: Column, key: str) -> Column:
    return value_bool(text(slot, key))


def _sum(parts: Column, key: str) -> Column:
    known = F.filter(F.transform(parts, lambda m: num(m, key)), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0).cast("decimal(28,4)"), lambda a, x: (a + x).cast("decimal(28,4)")))


def _not_in(values: Column, wanted: Column) -> Column:
    return once(F.struct(values.alias("values"), wanted.alias("wanted")), lambda v: (F.size(v["values"]) > 0) & v["wanted"].isNotNull() & ~F.exists(v["values"], lambda x: F.lower(x) == v["wanted"]))


def _diverge() -> Column:
    return F.coalesce(low(F.col("cpu"), "socket") != low(F.col("motherboard"), "socket"), F.lit(False))


def watts(build: DataFrame) -> DataFrame:
    """Adds base_w, recommended_w and watts_known: processor and card plus a fixed part, 40 % on top, half to even."""
    c, g = F.coalesce(num(F.col("cpu"), "tdp_w"), F.col("cpu.seed_w")), F.coalesce(num(F.col("gpu"), "tdp_w"), F.col("gpu.seed_w"))
    zero = F.lit(0).cast("decimal(18,4)")
    base = (F.coalesce(c, zero) + F.coalesce(g, zero) + OVERHEAD_W).cast("decimal(18,4)")
    known = (F.col("cpu").isNull() | c.isNotNull()) & (F.col("gpu").isNull() | g.isNotNull())
    return build.withColumns({"base_w": base, "recommended_w": F.bround(base * F.lit(HEADROOM).cast("decimal(4,2)"), 0), "watts_known": known})


def with_seeds(builds: DataFrame, chipsets: DataFrame | None = None) -> DataFrame:
    """Adds what the chipset table says of a build: support of the processor's generation; and its power."""
    if chipsets is None:
        chipsets = seeds.chipsets(builds.sparkSession)
    key = chipset_key(text(F.col("motherboard"), "chipset"))
    out = builds.withColumns({"generation": cpu_generation(F.col("cpu.model")), "__chip": key})
    names = chipsets.select(F.col("chipset").alias("__name")).distinct()
    short = F.when((F.length("__chip") > 4) & F.col("__chip").rlike("[me]$"), F.expr("substring(__chip, 1, length(__chip) - 1)"))
    out = out.join(names, F.col("__chip") == F.col("__name"), "left").withColumnRenamed("__name", "__exact").withColumn("__short", short)
    out = out.join(names, F.col("__short") == F.col("__name"), "left").withColumn("chipset", F.coalesce("__exact", "__name"))
    support = chipsets.select(F.col("chipset").alias("__c"), F.col("generation").alias("__g"), "bios", F.lit(True).alias("supported"))
    out = out.join(support, (F.col("chipset") == F.col("__c")) & (F.col("generation") == F.col("__g")), "left")
    return watts(out.drop("__chip", "__exact", "__short", "__name", "__c", "__g"))


@dataclass(frozen=True)
class Rule:
    code: str
    severity: str
    fires: Callable[[], Column]
    parts: tuple[str, ...]


_c = F.col
RULES = [
    Rule("CPU_SOCKET_MISMATCH", "E", lambda: low(_c("cpu"), "socket") != low(_c("motherboard"), "socket"), ("cpu", "motherboard")),
    Rule("CPU_CHIPSET_UNSUPPORTED", "E", lambda: ~_diverge() & _c("generation").isNotNull() & _c("chipset").isNotNull() & _c("supported").isNull(), ("cpu", "motherboard")),
    Rule("RAM_TYPE_MISMATCH", "E", lambda: F.exists("memory", lambda m: low(m, "type") != low(_c("motherboard"), "memory_type")) & (text(_c("motherboard"), "memory_type") != "ambos"), ("motherboard",)),
    Rule("RAM_CAPACITY_EXCEEDED", "E", lambda: _sum(_c("memory"), "capacity_gb") > num(_c("motherboard"), "max_memory_gb"), ("motherboard",)),
    Rule("RAM_SLOT_OVERFLOW", "E", lambda: (_sum(_c("memory"), "modules") != 0) & (_sum(_c("memory"), "modules") > num(_c("motherboard"), "memory_slots")), ("motherboard",)),
    Rule("MOBO_CASE_FORM_FACTOR", "E", lambda: _not_in(text_list(text(_c("case"), "form_factor_support")), low(_c("motherboard"), "form_factor")), ("motherboard", "case")),
    Rule("GPU_CASE_LENGTH", "E", lambda: num(_c("gpu"), "length_mm") > num(_c("case"), "max_gpu_length_mm"), ("gpu", "case")),
    Rule("COOLER_SOCKET_MISMATCH", "E", lambda: _not_in(text_list(text(_c("cooler"), "socket_support")), low(_c("cpu"), "socket")), ("cooler", "cpu")),
    Rule("COOLER_CASE_HEIGHT", "E", lambda: (F.coalesce(low(_c("cooler"), "type"), F.lit("")) != "aio") & (num(_c("cooler"), "height_mm") > num(_c("case"), "max_cooler_height_mm")), ("cooler", "case")),
    Rule("AIO_RADIATOR_FIT", "E", lambda: once(number_list(text(_c("case"), "radiator_support_mm")), lambda sizes: (F.size(sizes) > 0) & ~F.array_contains(sizes, num(_c("cooler"), "radiator_mm"))), ("cooler", "case")),
    Rule("STORAGE_M2_OVERFLOW", "E", lambda: F.size(F.filter("storage", lambda s: low(s, "interface") == "nvme")) > num(_c("motherboard"), "m2_slots"), ("motherboard",)),
    Rule("PSU_CONNECTOR_MISSING", "E", lambda: ~satisfies(connectors(text(_c("psu"), "connectors")), connectors(text(_c("gpu"), "power_connectors"))), ("psu", "gpu")),
    Rule("PSU_WATTAGE_LOW", "W", lambda: (_c("cpu").isNotNull() | _c("gpu").isNotNull()) & _c("watts_known") & (num(_c("psu"), "wattage") < F.greatest(_c("recommended_w"), num(_c("gpu"), "recommended_psu_w"))), ("psu",)),
    Rule("RAM_SPEED_CAPPED", "W", lambda: F.exists("memory", lambda m: num(m, "speed_mhz") > num(_c("cpu"), "max_memory_speed_mhz")), ("cpu",)),
    Rule("NO_GPU_NO_IGPU", "W", lambda: _c("gpu").isNull() & _c("cpu").isNotNull() & ~flag(_c("cpu"), "has_igpu"), ("cpu",)),
    Rule("BIOS_UPDATE_NEEDED", "W", lambda: _c("supported") & _c("bios").isNotNull() & ~_diverge(), ("cpu", "motherboard")),
]


def evaluated(builds: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Adds issues: array of struct(severity, code, product_ids) of every rule that fires."""
    found = [F.when(r.fires(), F.struct(F.lit(r.severity).alias("severity"), F.lit(r.code).alias("code"), F.array(*[F.col(f"{p}.product_id") for p in r.parts]).alias("product_ids"))) for r in rules]
    return builds.withColumn("issues", F.array_compact(F.array(*found)))


def issues(builds: DataFrame) -> DataFrame:
    """(build_id, severity, code, product_ids), a row for each issue."""
    # An inner explode would have Spark filter by the array's size first, and with that judge every build three times.
    return evaluated(builds).select("build_id", F.explode_outer("issues").alias("i")).where("i IS NOT NULL").select("build_id", "i.*")


def summary(builds: DataFrame) -> DataFrame:
    """Per build: number of errors and warnings, whether it is compatible, and its power."""
    e = evaluated(builds)
    n = lambda s: F.size(F.filter("issues", lambda i: i["severity"] == s))
    return e.select("build_id", n("E").alias("errors"), n("W").alias("warnings"), (n("E") == 0).alias("compatible"), F.when(F.col("watts_known"), F.col("base_w")).alias("base_w"), F.when(F.col("watts_known"), F.col("recommended_w")).alias("recommended_w"))


def candidates(build: DataFrame, parts: DataFrame, category: str, chipsets: DataFrame | None = None, seed_watts: DataFrame | None = None) -> DataFrame:
    """(product_id, compatible, reasons) for each part of a category, put into the one build that ``build`` holds.

    A part replaces its slot; memory and storage are added. Any error of the
    resulting build rejects the part.
    """
    one = build.limit(2).collect()
    if len(one) != 1:
        raise ValueError("exactly one build is asked for")
    slots = [c for c in SINGLE + MANY]
    frozen = build.sparkSession.createDataFrame(one, build.schema).select(*slots)
    rows = typed(parts.where(F.col("category") == category), seed_watts=seed_watts).select(F.col("product_id").alias("build_id"), F.col("part").alias("__new")).join(F.broadcast(frozen))
    put = F.concat(category, F.array("__new")) if category in MANY else F.col("__new")
    judged = evaluated(with_seeds(rows.withColumn(category, put).drop("__new"), chipsets))
    errors = F.transform(F.filter("issues", lambda i: i["severity"] == "E"), lambda i: i["code"])
    return judged.select(F.col("build_id").alias("product_id"), (F.size(errors) == 0).alias("compatible"), errors.alias("reasons"))
