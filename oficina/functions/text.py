"""Title normalisation and the keys derived from titles, as native Column expressions.

Every function takes and returns Columns; a null or blank title gives null unless
the docstring says otherwise. No Python runs per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"

# Brand order and display names, title prefixes.
BRANDS = ["amd", "intel", "nvidia", "gigabyte", "asus", "msi", "kingston", "corsair", "samsung", "wd", "seagate", "xpg", "teamgroup", "coolermaster", "deepcool"]
BRAND_NAMES = {"wd": "Western Digital", "teamgroup": "TeamGroup", "coolermaster": "Cooler Master"}
OTHER_BRAND = "Outros"
TITLE_PREFIXES = ["Processador ", "Placa de vídeo ", "Memória ", "Gabinete "]
# Processor generations and card series by leading digit(s).
AMD_GENERATIONS = {"1": "zen1", "2": "zen2", "3": "zen2", "4": "zen2", "5": "zen3", "7": "zen4", "8": "zen4", "9": "zen5"}
INTEL_GENERATIONS = {"12": "alder-lake", "13": "raptor-lake", "14": "raptor-lake-refresh"}
RTX_SERIES = {"2": "rtx20", "3": "rtx30", "4": "rtx40", "5": "rtx50"}
RX_SERIES = {"5": "rx5000", "6": "rx6000", "7": "rx7000", "9": "rx9000"}


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null where the pattern has no match or the group is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row, however often the body names it and wherever the optimizer moves the expression."""
    return F.transform(F.array(value), body)[0]


def choose(key: Column, values: dict[str, str]) -> Column:
    """Value of ``key`` in a small constant map, else null."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def normalize(text: Column) -> Column:
    """Lower case, no accents, only letters, digits and single spaces."""
    kept = F.regexp_replace(F.translate(text, _ACCENTED, _PLAIN), r"[^\p{L}\p{N} ]", "")
    return F.trim(F.regexp_replace(F.lower(kept), " +", " "))


def clean_title(title: Column) -> Column:
    """The title without the one product-type prefix it may start with."""
    return F.regexp_replace(F.trim(title), "(?iu)^(" + "|".join(TITLE_PREFIXES) + ")", "")


def brand(maker: Column, title: Column) -> Column:
    """First known brand inside the maker (or, without one, the title)."""
    text = normalize(F.coalesce(F.nullif(maker, F.lit("")), title))
    out = F.lit(OTHER_BRAND)
    for b in reversed(BRANDS):
        out = F.when(text.contains(b), F.lit(BRAND_NAMES.get(b, b))).otherwise(out)
    return out


_CPU_AMD = r"\bryzen\s+(?:[3579]\s*)?(\d{3,5}[a-z0-9]*)\b"
_CPU_INTEL = r"\b(?:core\s+)?(?:ultra\s+)?(?:i[3579]|ultra\s*[579])\s*-?\s*(\d{3,5}[a-z0-9]*)\b"
_GPU_NVIDIA = r"\b(?:rtx|gtx|titan)\s*(\d{3,4}[a-z0-9]*\s*(?:ti|super)?)"
_GPU_AMD = r"\b(?:radeon\s+)?rx\s*(\d{3,4}[a-z0-9]*\s*(?:xt|gre)?)\b"


def match_key(title: Column) -> Column:
    """"maker model" of a processor or card title: first pattern that fits."""
    key = lambda text, who, p: F.concat(F.lit(who + " "), F.replace(found(text, p), F.lit(" "), F.lit("")))
    return once(normalize(title), lambda t: F.coalesce(key(t, "amd", _CPU_AMD), key(t, "intel", _CPU_INTEL), key(t, "nvidia", _GPU_NVIDIA), key(t, "amd", _GPU_AMD)))


def normalize_part_number(value: Column) -> Column:
    return F.upper(F.regexp_replace(value, r"[^\p{L}\p{N}]", ""))


def part_number(text: Column) -> Column:
    """Maker's part number in a text, letters and digits only, upper case."""
    first = lambda t: F.coalesce(found(t, r"(?iu)\b\d{3}-\d{9}[A-Z]{2,4}\b", 0), found(t, r"(?iu)\bBX\d{6,9}[A-Z0-9]*\b", 0))
    return normalize_part_number(once(text, first))


def price_br(text: Column) -> Column:
    """Brazilian price text ("1.599,99") as decimal(12,2); null if it is none."""
    plain = F.replace(F.replace(F.trim(text), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), plain.try_cast("decimal(12,2)"))


def cpu_generation(model: Column) -> Column:
    """Desktop generation of a processor title or model key, else null."""
    m = F.lower(model)
    no = m.rlike(r"athlon|sempron|phenom|opteron|\ba\d{1,2}\b|\bfx\b")
    amd = choose(F.substring(found(m, r"(?<!\d)(\d{4})(?!\d)"), 1, 1), AMD_GENERATIONS)
    five = found(m, r"(?<!\d)(1[2-4]\d{3})(?!\d)")
    intel = F.when(five.isNotNull(), choose(F.substring(five, 1, 2), INTEL_GENERATIONS)).when(m.rlike(r"(?<!\d)2\d{2}(?!\d)"), "arrow-lake")
    return F.when(~no & (m.contains("ryzen") | m.startswith("amd")), amd).when(~no & (m.rlike("core|ultra") | m.startswith("intel")), intel)


def gpu_series(title: Column) -> Column:
    """Series of a graphics card title, else null."""
    t = F.lower(title)
    rtx, rx = found(t, r"\brtx\s*(\d{4})"), found(t, r"\b(?:rx|radeon)\s*(\d{4})")
    return (
        F.when(rtx.isNotNull(), choose(F.substring(rtx, 1, 1), RTX_SERIES))
        .when(t.rlike(r"\bgtx\s*16\d{2}"), "gtx16")
        .when(rx.isNotNull(), choose(F.substring(rx, 1, 1), RX_SERIES))
        .when(t.rlike(r"\barc\s*[ab]\d{3}"), "arc")
    )


def chip_id(category: Column, title: Column) -> Column:
    """Key of a chip in the reference specifications, e.g. ``rtx5070ti`` or ``r77800x3d``."""
    t = normalize(title)
    parts = lambda p, *groups: F.when(t.rlike(p), F.concat(*[F.regexp_extract(t, p, g) if isinstance(g, int) else F.lit(g) for g in groups]))
    nvidia = parts(r"\b(rtx|gtx)\s*(\d{3,4})\s*(ti|super)?", 1, 2, 3)
    nvidia = F.when((nvidia == "rtx3050") & t.rlike(r"\b6\s*gb\b"), "rtx3050-6gb").otherwise(nvidia)
    gpu = F.coalesce(nvidia, parts(r"\b(?:radeon\s+)?rx\s*(\d{3,4})\s*(xtx|xt|gre)?", "rx", 1, 2), parts(r"\barc\s*([ab])(\d{3})", "arc", 1, 2))
    intel = r"\b(?:core\s+)?(ultra\s+)?(?:i)?([3579])\s*-?\s*(\d{3,5})([kf]{1,2})?"
    prefix = F.when(F.regexp_extract(t, intel, 1) != "", "u").otherwise("i")
    cpu = F.coalesce(
        parts(r"\b(?:ryzen|r)\s*([3579])\s*-?\s*(\d{4})(x3d|xt|gt|x|g|f)?", "r", 1, 2, 3),
        F.when(t.rlike(intel), F.concat(prefix, F.regexp_extract(t, intel, 2), F.regexp_extract(t, intel, 3), F.regexp_extract(t, intel, 4))),
    )
    return F.when(category == "gpu", gpu).when(category == "cpu", cpu)


def image_key(url: Column) -> Column:
    """Object-store key of an image: 40 hex digits of the url's SHA-256 and its extension."""
    ext = found(F.lower(url), r"(\.[a-z0-9]{2,5})(?:[?#].*)?$")
    return F.concat(F.substring(F.sha2(url.cast("binary"), 256), 1, 40), F.coalesce(ext, F.lit(".img")))


def public_url(key: Column, base: str | None = None) -> Column:
    """The address that an image is shown under: below ``base``, else below the site's own image path."""
    return F.concat(F.lit(f"{base.rstrip('/') if base else '/images'}/"), key)


def slug(seed: Column) -> Column:
    """Eight lower-case characters that follow from the seed (no random state)."""
    return F.substring(F.translate(F.sha2(seed.cast("binary"), 256), "0123456789", "ghjkmnpqrs"), 1, 8)


def stripped(text: Column) -> Column:
    """The text without blanks of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
