"""Landed store pages to rows: listing pages with embedded JSON, cards, spec sheets."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.specs import extract
from ..functions.text import found, match_key, once, part_number, price_br, stripped

ITEM = "array<struct<code:bigint,name:string,friendlyName:string,manufacturer:struct<name:string>,priceWithDiscount:double,price:double,maxInstallment:string,available:boolean,thumbnail:string>>"
_EMBEDDED = r'(?s)<script id="__NEXT_DATA__" type="application/json">(.*?)</script>'
# Words of section titles that open a specification section.
SPEC_SECTIONS = "especifica|caracter|ficha|informac|detalhe"


def embedded(html: Column) -> Column:
    """The JSON document inside a server-rendered page, null if there is none."""
    return found(html, _EMBEDDED)


def listing_items(pages: DataFrame, html_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """(items, rejected): a row for each product of each page, and the pages without a readable catalog.

    The page's data is JSON text inside JSON. A discount price of zero or less is null.
    """
    inner = F.get_json_object(embedded(F.col(html_col)), "$.props.pageProps.data")
    read = pages.withColumn("__items", F.from_json(F.get_json_object(inner, "$.catalogServer.data"), ITEM))
    rest = [c for c in pages.columns if c != html_col]
    items = read.where(F.col("__items").isNotNull()).select(*rest, F.explode("__items").alias("i"))
    cash = F.when(F.col("i.priceWithDiscount") > 0, F.col("i.priceWithDiscount"))
    items = items.select(
        *rest,
        F.col("i.code").alias("code"),
        F.coalesce("i.name", F.lit("")).alias("title"),
        F.coalesce("i.friendlyName", F.lit("")).alias("friendly_name"),
        F.col("i.manufacturer.name").alias("maker"),
        F.coalesce(cash, F.col("i.price")).cast("decimal(12,2)").alias("price_cash"),
        F.col("i.price").cast("decimal(12,2)").alias("price_card"),
        F.coalesce("i.available", F.lit(False)).alias("in_stock"),
        F.col("i.thumbnail").alias("thumbnail"),
        F.col("i.maxInstallment").alias("installment_text"),
    )
    return items, read.where(F.col("__items").isNull()).select(*pages.columns)


def listing(items: DataFrame, store: str, base_url: str, category: Column | None = None) -> DataFrame:
    """Items of a listing page as raw listings with url, SKU and derived keys; with a category also ``category`` and the ``specs`` that its titles say.

    Such pages name installments as a text only, so ``installments`` is null.
    """
    if category is not None:
        items = items.withColumn("category", category).withColumns({"specs": extract(F.col("category"), F.col("title")), "installments": F.lit(None).cast("int")})
    url = F.concat(F.lit(base_url + "/produto/"), F.col("code").cast("string"), F.lit("/"), F.col("friendly_name"))
    return items.withColumns({"store": F.lit(store), "store_sku": F.col("code").cast("string"), "product_url": url, "match_key": match_key(F.col("title")), "part_number": part_number(F.col("title"))})


def together(*listings: DataFrame) -> DataFrame:
    """Raw listings of several pages and stores as one table; a column that a store does not give is null. Repeated rows stay."""
    out = listings[0]
    for more in listings[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def cards(df: DataFrame, href_col: str, text_col: str, price_pattern: str, marker: str, sku_pattern: str) -> DataFrame:
    """Store cards (link and visible text) as raw listings; a card without a price is dropped.

    The name is the longest line before the price marker, the first among equals.
    """
    text, href = F.col(text_col), F.col(href_col)
    head = F.split(text, marker, 2)[0]
    lines = F.filter(F.transform(F.split(head, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    best = F.array_max(F.transform(lines, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("at"), x.alias("line"))))
    plan = r"(?iu)(\d{1,3})x\s*de\s*R\$\s*[\d.,]+"
    name = F.coalesce(best["line"], F.lit(""))
    out = df.withColumns({"price_cash": price_br(found(text, price_pattern)), "title": name}).where("price_cash IS NOT NULL")
    return out.withColumns({
        "installments": found(text, plan).cast("int"),
        "installment_text": found(text, plan, 0),
        "in_stock": ~F.lower(text).contains("esgotado"),
        "store_sku": F.substring(found(href, sku_pattern), 1, 255),
        "match_key": match_key(F.col("title")),
        "part_number": part_number(F.concat_ws(" ", "title", href)),
    })


def unescaped(html: Column) -> Column:
    """Named and numbered character references as characters; unknown ones stay."""
    ref = "&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,15});"
    named = F.str_to_map(F.lit(";".join(f"{name}={chr(code)}" for name, code in name2codepoint.items())), F.lit(";"), F.lit("="))

    def char(r: Column) -> Column:
        number = F.when(r.rlike("^#[xX]"), F.conv(F.substring(r, 3, 9), 16, 10)).when(r.startswith("#"), F.substring(r, 2, 9)).cast("int")
        coded = F.when(number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        return F.coalesce(F.element_at(named, r), coded, F.concat(F.lit("&"), r, F.lit(";")))

    def replaced(t: Column) -> Column:
        chars = F.concat(F.transform(F.regexp_extract_all(t, F.lit(ref), F.lit(1)), char), F.array(F.lit("")))
        joined = F.array_join(F.flatten(F.zip_with(F.split(t, ref, -1), chars, lambda a, b: F.array(a, b))), "")
        return F.when(t.rlike(ref), joined).otherwise(t)

    return once(html, replaced)


def _plain(html: Column) -> Column:
    """Text of HTML without its tags: breaks as line ends, references as characters, a no-break space as a blank."""
    t = F.regexp_replace(F.regexp_replace(html, r"<br\s*/?>|</p>", "\n"), "<[^>]+>", "")
    return F.replace(unescaped(t), F.lit("\u00a0"), F.lit(" "))


def product_sheets(pages: DataFrame, id_cols: list[str], html_col: str) -> DataFrame:
    """(id..., sheet, pos, label, value) of server-rendered product pages.

    A page has two sheets: the free description (0), of which only specification sections count, and the
    technical text (1), all of which counts. Each is mapped by itself; the latter wins where both have a key.
    """
    product = F.get_json_object(embedded(F.col(html_col)), "$.props.pageProps.product")
    both = pages.select(*id_cols, F.get_json_object(product, "$.description").alias("__d"), F.get_json_object(product, "$.technicalInformation.text").alias("__t"))
    free = spec_pairs(both.where("__d <> ''"), id_cols, "__d", gated=True)
    technical = spec_pairs(both.where("__t <> ''"), id_cols, "__t")
    return free.withColumn("sheet", F.lit(0)).unionByName(technical.withColumn("sheet", F.lit(1)))


def table_pairs(pages: DataFrame, id_cols: list[str], html_col: str) -> DataFrame:
    """(id..., pos, label, value) of tables (``th`` and ``td`` of a row) and of paragraphs that start with a bold label."""
    html = F.col(html_col)
    rows = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)), lambda r: F.struct(found(r, r"(?is)<th[^>]*>(.*?)</th>").alias("label"), found(r, r"(?is)<td[^>]*>(.*?)</td>").alias("value")))
    bold = r"(?is)<strong[^>]*>(.*?)</strong>"
    paragraphs = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1)), lambda r: F.struct(found(r, bold).alias("label"), F.regexp_replace(r, bold, "").alias("value")))
    out = pages.select(*id_cols, F.posexplode_outer(F.concat(rows, paragraphs)).alias("pos", "x")).where("pos IS NOT NULL")
    label, value = stripped(_plain(F.col("x.label"))), stripped(F.regexp_replace(_plain(F.col("x.value")), r"^\s*:?\s*", ""))
    return out.select(*id_cols, "pos", label.alias("label"), value.alias("value")).where("label <> '' AND value <> ''")


def spec_pairs(df: DataFrame, id_cols: list[str], html_col: str, gated: bool = False) -> DataFrame:
    """(id..., pos, label, value) of spec sheets in HTML.

    Bulleted lines are "label: value", or values under the heading above; with
    ``gated`` only lines under a heading that names a specification section count.
    """
    t = F.regexp_replace(F.regexp_replace(F.col(html_col), r"<br\s*/?>|</p>", "\n"), "<li[^>]*>", "\n- ")
    t = F.regexp_replace(t, "<[^>]+>", "")
    t = F.replace(unescaped(t), F.lit("\u00a0"), F.lit(" "))
    lines = F.filter(F.transform(F.split(t, r"\r?\n"), stripped), lambda x: ~x.isin("", "-", "•", "*"))
    rows = df.select(*id_cols, F.posexplode_outer(lines).alias("pos", "line")).where("pos IS NOT NULL")
    bullet = F.substring("line", 1, 1).isin("-", "•", "*")
    body = F.regexp_replace("line", r"^[-•*][ \t\-•*]*|[ \t\-•*]+$", "")
    header = stripped(F.regexp_replace("line", ":+$", ""))
    is_header = ~bullet & (header != "") & (F.length(header) <= 48)
    above = Window.partitionBy(*id_cols).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.last(F.when(is_header, header), ignorenulls=True).over(above))
    rows = rows.where(bullet & (body != ""))
    if gated:
        rows = rows.where(F.regexp_replace(F.lower("section"), "[^a-z0-9 ]", "").rlike(SPEC_SECTIONS))
    pair = body.contains(":")
    label = F.when(pair, stripped(F.substring_index(body, ":", 1))).otherwise(F.col("section"))
    value = F.when(pair, stripped(F.expr("substring(__b, instr(__b, ':') + 1)"))).otherwise(body)
    return rows.withColumn("__b", body).select(*id_cols, "pos", label.alias("label"), value.alias("value")).where("label IS NOT NULL")
