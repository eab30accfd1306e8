"""Specifications from titles and spec sheets, as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import choose, found, gpu_series, normalize, once, stripped

# Patterns of single specifications.
SOCKET = r"(?iu)\b(AM5|AM4|LGA\s?1?[0-9]{3}|sTR5|sTRX50|sTRX40)\b"
TDP = r"(?iu)(?:TDP|consumo|pot[eê]ncia)[^0-9]{0,20}(\d{2,4})\s*W"
CORES = r"(\d{1,2})\s*[Nn][úu]cleos?"
THREADS = r"(\d{1,3})\s*[Tt]hreads?"
MEMORY_TYPE = r"(?iu)\b(DDR[45])\b"
PSU_WATTAGE = r"(?iu)\b(\d{3,4})\s*W(?:atts?)?\b"
CHIPSET = r"(?iu)(?:^|[^A-Za-z0-9])(?:AMD|Intel\s+)?([ABXHZ]\d{3})"
FORM_FACTOR = r"(?iu)\b(M(?:icro)?-?ATX|Mini-?ITX|E-?ATX|ATX|ITX)\b"
GPU_MEMORY = r"(?iu)(\d{2,3})\s*GB"
LENGTH = r"(?iu)(\d{3})\s*x\s*\d{2,3}\s*x\s*\d{1,3}\s*mm"
CONNECTORS = r"(?iu)(?:conectores|alimenta[çc][ãa]o|power)[^0-9]{0,20}(\d+\s*x\s*\d+\s*(?:pinos?|pin)|16\s*pinos?|8\s*pinos?|12V-?2x?6?)"
NO_GRAPHICS = r"(?iu)sem v[íi]deo|without graphics|no i?gpu|sem placa"
GRAPHICS = r"(?iu)com v[íi]deo|gr[áa]ficos integrados|integrated graphics|radeon graphics|uhd graphics|hd graphics|iris"
FORM_FACTORS = {"mini-itx": "itx", "miniitx": "itx", "m-atx": "matx", "matx": "matx", "micro-atx": "matx", "microatx": "matx", "e-atx": "eatx", "eatx": "eatx", "atx": "atx", "itx": "itx"}
# Sane ranges by key, both ends included.
SANE = {
    "cuda_cores": (100, 100000), "stream_processors": (100, 100000), "compute_units": (4, 512), "tensor_cores": (32, 10000), "rt_cores": (8, 10000),
    "xe_cores": (4, 512), "base_clock_mhz": (500, 6000), "boost_clock_mhz": (800, 5000), "game_clock_mhz": (500, 5000), "memory_gb": (1, 64),
    "memory_bus_bits": (32, 1024), "memory_clock_gbps": (5, 40), "bandwidth_gbps": (50, 2500), "tdp_w": (30, 1000), "recommended_psu_w": (200, 1600),
    "process_nm": (3, 14), "length_mm": (50, 500), "width_mm": (50, 500), "height_mm": (10, 200), "cores": (1, 64), "threads": (1, 128),
}


def socket(value: Column) -> Column:
    return F.nullif(F.replace(F.lower(value), F.lit(" "), F.lit("")), F.lit(""))


def form_factor(value: Column) -> Column:
    v = F.lower(value)
    return F.coalesce(choose(v, FORM_FACTORS), v)


def chipset(value: Column) -> Column:
    return F.nullif(F.regexp_replace(F.replace(F.lower(value), F.lit(" "), F.lit("")), "^(amd|intel)", ""), F.lit(""))


def has_igpu(title: Column, sheet: Column) -> Column:
    both = F.concat_ws(" ", title, sheet)
    return F.when(both.rlike(NO_GRAPHICS), "false").when(both.rlike(GRAPHICS), "true")


def extract(category: Column, title: Column, sheet: Column | None = None) -> Column:
    """map<string,string> of what the title (and spec text) of a product says, by category."""
    sheet = F.lit(None).cast("string") if sheet is None else sheet
    sheet_first = lambda p: F.coalesce(found(sheet, p), found(title, p))
    title_first = lambda p: F.coalesce(found(title, p), found(sheet, p))
    ddr = F.lower(found(title, MEMORY_TYPE))
    by = {
        "cpu": {"socket": socket(sheet_first(SOCKET)), "tdp_w": sheet_first(TDP), "cores": title_first(CORES), "threads": title_first(THREADS), "memory_type": sheet_first(MEMORY_TYPE), "has_igpu": has_igpu(title, sheet)},
        "gpu": {"memory_gb": title_first(GPU_MEMORY), "tdp_w": sheet_first(TDP), "length_mm": found(sheet, LENGTH), "power_connectors": found(sheet, CONNECTORS), "series": gpu_series(title)},
        "memory": {"type": ddr},
        "psu": {"wattage": found(title, PSU_WATTAGE)},
        "motherboard": {"socket": socket(found(title, SOCKET)), "chipset": chipset(found(title, CHIPSET)), "form_factor": form_factor(found(title, FORM_FACTOR)), "memory_type": ddr},
    }
    out = F.create_map().cast("map<string,string>")
    for cat, keys in by.items():
        m = F.create_map(*[x for k, v in keys.items() for x in (F.lit(k), F.trim(v))])
        out = F.when(category == cat, F.map_filter(m, lambda k, v: v.isNotNull())).otherwise(out)
    return out


def value_num(text: Column) -> Column:
    """Number beside a text attribute (comma or point), decimal(18,4); null if the text is none."""
    t = F.replace(F.trim(text), F.lit(","), F.lit("."))
    return F.when(t.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$"), t.try_cast("decimal(18,4)"))


def value_bool(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t == "true", F.lit(True)).when(t == "false", F.lit(False))


def text_list(text: Column) -> Column:
    """List kept as text: a JSON array, or comma-separated; a malformed array is an empty list."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(text.isNull(), F.array().cast("array<string>")).when(
        F.ltrim(text).startswith("["), F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
    ).otherwise(parts)


def number_list(text: Column) -> Column:
    numbers = F.transform(text_list(text), lambda x: x.try_cast("decimal(18,4)"))
    return F.filter(numbers, lambda x: x.isNotNull())


def connectors(raw: Column) -> Column:
    """struct(sixteen, eight, six) of a power connector text; null if it names none."""
    t = F.replace(F.lower(raw), F.lit("6+2"), F.lit("8"))
    t = F.replace(F.translate(t, " -+", ""), F.lit("pinos"), F.lit("pin"))

    def count(t: Column, token: str) -> Column:
        total = F.aggregate(F.regexp_extract_all(t, F.lit(rf"(\d+)x{token}"), F.lit(1)), F.lit(0), lambda a, x: a + x.cast("int"))
        return once(total, lambda n: F.when(n > 0, n).when(t.rlike(rf"(?<!\d){token}"), 1).otherwise(0))

    counted = lambda t: F.struct((count(t, "16pin") + count(t, "12v2x6") + count(t, "12vhpwr")).alias("sixteen"), count(t, "8pin").alias("eight"), count(t, "6pin").alias("six"))
    return F.when(F.trim(raw) != "", once(once(t, counted), lambda s: F.when(s["sixteen"] + s["eight"] + s["six"] > 0, s)))


def satisfies(psu: Column, gpu: Column) -> Column:
    """Whether a supply's connectors meet a card's: 16-pin before 8-pin before 6-pin."""
    return once(F.struct(psu.alias("psu"), gpu.alias("gpu")), lambda x: _satisfies(x["psu"], x["gpu"]))


def _satisfies(psu: Column, gpu: Column) -> Column:
    return (
        F.when(gpu["sixteen"] > 0, psu["sixteen"] >= gpu["sixteen"])
        .when(gpu["eight"] > 0, psu["eight"] >= gpu["eight"])
        .otherwise((gpu["six"] > 0) & ((psu["eight"] >= 1) | (psu["six"] >= 1)))
    )


def distinct_fold(values: Column) -> Column:
    """Different texts of an array, case aside; of each the first spelling stays, in order."""
    low = F.transform(values, lambda x: F.lower(x))
    return F.filter(values, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def chipset_key(raw: Column) -> Column:
    """Chipset name for the support table: letters and digits, without the maker."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(raw), r"[^\p{L}\p{N}]", ""), "^(amd|intel)", ""), F.lit(""))


# --- spec sheets: label rules, value kinds, sanity -------------------------------------

_NUMBER = r"\d+(?:[.,]\d+)?"
# How sheets write memory kinds, buses and power plugs.
DDR = r"(?iu)\b(g?ddr\d\w*)\b"
PCIE = r"(?iu)pci\s*-?\s*e(?:xpress)?\s*(?:gen\s*)?(\d+(?:\.\d+)?)?(?:\s*x\s*(\d+))?"
PIN = r"(\d+)\s*x\s*(\d+)\s*pi?n"


def _number(v: Column) -> Column:
    return F.replace(found(v, _NUMBER, 0), F.lit(","), F.lit(".")).try_cast("double")


def _whole(v: Column) -> Column:
    return F.floor(v).cast("bigint").cast("string")


def _one(key: Column | str, value: Column) -> Column:
    return F.array(F.struct((F.lit(key) if isinstance(key, str) else key).alias("key"), value.alias("value")))


def parsed(kind: Column, key: Column, raw: Column) -> Column:
    """array<struct<key,value>> that a raw sheet value gives under a rule's kind."""
    given = F.struct(kind.alias("kind"), key.alias("key"), stripped(raw).alias("value"))
    return once(given, lambda x: _parsed(x["kind"], x["key"], x["value"]))


def _parsed(kind: Column, key: Column, v: Column) -> Column:
    low = F.lower(v)
    plain = stripped(F.regexp_replace(v, r"(?U)\s+", " "))
    mhz, ghz = found(low, rf"({_NUMBER})\s*mhz"), found(low, rf"({_NUMBER})\s*ghz")
    point = lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast("double")
    items = F.filter(F.transform(F.split(v, r"[\n/|,;]"), lambda p: F.regexp_replace(F.regexp_replace(p, r"(?U)\s+", " "), "^[ -]+|[ -]+$", "")), lambda p: p != "")
    listed = F.nullif(F.array_join(items, ", "), F.lit(""))
    norm = normalize(v)
    many = F.regexp_replace(found(norm, PIN, 1), "^0+(?=.)", "")
    power = (
        F.when(norm.rlike(r"12v2x6|12vhpwr|\b16\s*pin"), "1x16pin")
        .when(many.isNotNull(), F.concat(F.when(many == "0", "1").otherwise(many), F.lit("x"), found(norm, PIN, 2), F.lit("pin")))
        .when(norm.rlike(r"\b8\s*pin"), "1x8pin")
        .when(norm.rlike(r"\b6\s*pin"), "1x6pin")
        .when(norm.rlike("sem|slot|nenhum"), "nenhum (slot)")
    )
    bus = F.regexp_replace(v, "[®™]", "")
    gen, lanes = found(bus, PCIE, 1), found(bus, PCIE, 2)
    pcie = F.concat(F.lit("pcie"), gen, F.coalesce(F.concat(F.lit("x"), lanes), F.lit("")))
    ddr = F.lower(found(v, DDR))
    single = (
        F.when(kind.isin("int", "bits"), _whole(_number(v)))
        .when(kind.isin("num", "gbps"), _number(v).cast("string"))
        .when(kind == "mhz", F.coalesce(_whole(point(mhz)), _whole(point(ghz) * 1000)))
        .when(kind == "pcie", pcie)
        .when(kind == "power", power)
        .when(kind == "bool", F.when(low.rlike("sim|yes|true|com |tem |suporta"), "true").when(low.rlike("nao|não|no|false|sem "), "false"))
        .when(kind == "list", listed)
        .when(kind == "mem_type", ddr)
        .when(kind == "socket", socket(v))
        .when(kind == "form_factor", form_factor(v))
        .when(kind == "chipset", chipset(v))
        .when(kind == "storage_iface", F.when(low.contains("nvme"), "nvme").when(low.contains("sata"), "sata").otherwise(plain))
        .when(kind == "cooler_type", F.when(low.rlike("aio|water|liquido"), "aio").when(low.rlike("air|tower"), "air").otherwise(plain))
        .when(kind == "text", plain)
    )
    sizes = F.regexp_extract_all(v, F.lit(_NUMBER), F.lit(0))
    size = lambda i: _whole(point(F.get(sizes, F.lit(i))))
    gb = _whole(point(found(low, rf"({_NUMBER})\s*gb")))
    clock = r"(base|boost|game|turbo|oc|extreme|performance|silent|gaming|standard|default)\s*[^0-9:]{0,10}:\s*(" + _NUMBER + r")\s*(mhz|ghz)?"
    lines = F.filter(F.split(low, r"[\n,;]"), lambda x: x.rlike(clock))
    ticks = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, clock, 1).alias("name"), F.floor(point(F.regexp_extract(x, clock, 2)) * F.when(F.regexp_extract(x, clock, 3) == "ghz", 1000).otherwise(1)).alias("mhz")))
    of = lambda *names: F.transform(F.filter(ticks, lambda t: t["name"].isin(*names)), lambda t: t["mhz"])
    boost = F.transform(F.filter(ticks, lambda t: ~t["name"].isin("base", "standard", "default", "game")), lambda t: t["mhz"])
    outputs = low.rlike("hdmi|display|dp|vga|dvi")
    multi = (
        F.when(kind == "gpu_memory", F.concat(_one("memory_type", ddr), _one("memory_gb", gb)))
        .when(kind == "mobo_memory", F.concat(_one("memory_type", ddr), _one("memory_slots", found(low, r"(\d+)\s*x")), _one("max_memory_gb", gb)))
        .when(kind == "dims", F.when(F.size(sizes) < 3, _one("length_mm", size(0))).otherwise(F.concat(_one("length_mm", size(0)), _one("width_mm", size(1)), _one("height_mm", size(2)))))
        .when(kind == "clock_block", F.concat(_one("base_clock_mhz", F.array_min(of("base", "standard", "default")).cast("string")), _one("boost_clock_mhz", F.array_max(boost).cast("string")), _one("game_clock_mhz", F.try_element_at(of("game"), F.lit(-1)).cast("string"))))
        .when(kind == "iface_or_outputs", F.when(outputs, _one("video_outputs", listed)).otherwise(_one("interface", pcie)))
        .when(kind == "apis_block", F.concat(_one("directx", found(plain, r"(?iu)directx\s*[\d.]+\s*\w*", 0)), _one("opengl", found(plain, r"(?iu)opengl\s*[\d.]+", 0)), _one("vulkan", found(plain, r"(?iu)vulkan\s*[\d.]+", 0))))
        .when(kind == "gpu_name_or_chip", F.when(v.rlike(r"(?iu)^(GB|AD|GA|TU|Navi|ACM|BMG|DG)\b"), _one("gpu_chip", v)).otherwise(_one("gpu_model", plain)))
    )
    out = F.coalesce(multi, _one(key, single))
    return F.filter(out, lambda x: x["key"].isNotNull() & x["value"].isNotNull() & (x["value"] != "") & (v != ""))


def sane(key: Column, value: Column) -> Column:
    """False for a number outside the range of its key; texts and other keys pass."""
    n = F.when(value.rlike(rf"^{_NUMBER}$"), F.replace(value, F.lit(","), F.lit(".")).try_cast("double"))
    low, high = (choose(key, {k: str(r[i]) for k, r in SANE.items()}).cast("double") for i in (0, 1))
    return F.coalesce(n.between(low, high), F.lit(True))
