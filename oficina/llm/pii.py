"""Personal data: base patterns and information-theoretic sanitisation, in DataFrame expressions only.

Base: leftmost non-overlapping matches of four kinds; a match that fails its check
is dropped. Each distinct value of a match is a protected entity.

Method: how strongly a word reveals an entity is estimated from the corpus. With N
texts, df(e) and df(t) of them holding the entity e and the word t, and n(e, t) of
them both, the pointwise mutual information of t and e is at most the entity's
information content -log(df(e) / N). A word that comes to ``7/8`` of it or more
discloses the entity:

    log(r) >= -1/8 * -log(df(e)/N)   <=>   r^8 >= df(e)/N,   r = n(e, t)/df(t) * m/(m + 1)

m is the number of different texts among the n(e, t), so few texts count for less,
and no value is left unjudged. Words of any length, with digits too, are counted
outside base spans over whole texts. A disclosing word is taken out wherever it
stands, in every text: removed if no text holds it without the entity, and
generalised otherwise. A run of a script without blanks is one word.

Patterns are written so that their cost grows with the text and not its square:
runs are possessive, and a run is only tried from its start or from the end of the
match before it (which gives the same matches).

Edge cases: null counts as empty: no span, the hash of an empty string; equal rows
keep a row each and each counts as a text; overlapping kinds all count in ``spans``
and are replaced once in ``sanitized``; with no entity in the corpus only base
results appear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, stored

KINDS = ["email", "ip", "card", "phone", "term"]
#: Words that are looked for in texts without an entity are sent to the tasks up to this number, and beyond it joined.
MOST_BROADCAST = 50_000
#: A word: letters with their marks, and digits, of any length.
WORD = r"[\p{L}\p{M}\p{N}]++"
_LOCAL = "[A-Za-z0-9._%+-]"
#: The contract's patterns, with possessive runs and starts bound to the start of a run.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap look that a text without any match fails.
LOOKS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"(?:[0-9][\x20-]?){11}[0-9]"),
    "phone": lambda t: t.contains("+"),
}
_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"
_BLOCK = 128


def _running(sizes: str, first: Column) -> Column:
    """Start of each element of an array<struct<gap,size>> column, in blocks so that long arrays stay cheap."""

    def within(part: Column, start: Column) -> Column:
        step = lambda acc, x: F.struct(
            (acc["pos"] + x["gap"] + x["size"]).alias("pos"), F.concat(acc["out"], F.array(acc["pos"] + x["gap"])).alias("out")
        )
        zero = F.struct(start.cast("int").alias("pos"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, zero, step, lambda acc: acc["out"])

    n = F.size(sizes)
    blocks = F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int"))
    part = lambda b: F.slice(sizes, b * _BLOCK + 1, F.lit(_BLOCK))
    width = F.transform(blocks, lambda b: F.struct(F.lit(0).alias("gap"), F.aggregate(part(b), F.lit(0), lambda a, x: a + x["gap"] + x["size"]).alias("size")))
    starts = within(width, first)
    return F.flatten(F.zip_with(blocks, starts, lambda b, s: within(part(b), s)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    d = _digits(value)
    digit = lambda i: F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int")
    doubled = lambda i: F.when(i % 2 == 1, digit(i)).when(digit(i) > 4, 2 * digit(i) - 9).otherwise(2 * digit(i))
    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + doubled(i))
    return F.when(F.length(d).between(12, 19), total % 10 == 0).otherwise(False)


def _ip_ok(value: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.lpad(part(p), 3, "0") <= "255"))


CHECKS = {
    "email": lambda v: F.lit(True),
    "ip": _ip_ok,
    "card": _luhn,
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}


def base_spans(df: DataFrame, text_col: str) -> DataFrame:
    """Adds ``__spans``: struct(start, kind, end, value) of every base match, in order."""
    text = F.col(text_col)
    for k, kind in enumerate(KINDS[:4]):
        pattern = PATTERNS[kind]
        df = df.withColumn("__m", F.when(LOOKS[kind](text), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
        some = F.size("__m") > 0
        df = df.withColumn("__g", F.when(some, F.split(text, pattern, -1)))
        sizes = F.zip_with("__m", F.slice("__g", F.lit(1), F.size("__m")), lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m).alias("size")))
        df = df.withColumn("__z", F.when(some, sizes)).drop("__g")
        df = df.withColumn("__at", F.when(some, _running("__z", F.lit(0)))).drop("__z")
        spans = F.zip_with("__m", "__at", lambda m, s: F.struct(s.alias("start"), F.lit(k).alias("kind"), (s + F.length(m)).alias("end"), m.alias("value")))
        spans = F.filter(spans, lambda x: CHECKS[kind](x["value"]))
        df = df.withColumn(f"__s{k}", F.when(some, spans).otherwise(F.array().cast(_SPAN))).drop("__m", "__at")
    return df.withColumn("__spans", F.array_sort(F.concat(*[f"__s{k}" for k in range(4)]))).drop(*[f"__s{k}" for k in range(4)])


def _entity(x: Column) -> Column:
    value = F.when(x["kind"] == 0, F.lower(x["value"])).when(x["kind"] == 1, x["value"]).otherwise(_digits(x["value"]))
    return F.concat(x["kind"].cast("string"), F.lit(":"), value)


def _blanked(text: Column, spans: Column) -> Column:
    """The text with blanks in place of all spans: words keep their places."""
    step = lambda acc, x: F.struct(
        F.greatest(acc["end"], x["end"]).alias("end"),
        F.concat(acc["out"], F.array(F.struct(acc["end"].alias("from"), F.greatest(x["start"], acc["end"]).alias("to"), F.greatest(x["end"], acc["end"]).alias("next")))).alias("out"),
    )
    zero = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<from:int,to:int,next:int>>").alias("out"))
    piece = lambda p: F.concat(F.substring(text, p["from"] + 1, p["to"] - p["from"]), F.repeat(F.lit(" "), p["next"] - p["to"]))
    done = lambda acc: F.concat(F.array_join(F.transform(acc["out"], piece), ""), F.substring(text, acc["end"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, zero, step, done)).otherwise(text)


def _words(body: str = "__body") -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(body), F.lit(WORD), F.lit(0)))


def disclosed(kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, term, alone) and (entity, terms): words that disclose an entity, with every text that holds them.

    Counted over whole texts. Entities that stand in the same texts have the same counts, so
    they are judged once. A pair can only pass with df(t)^8 <= df(e)^7 * N, since n(e, t) is at most df(e): words
    of a text that are more frequent than its entities allow are given up at once.
    """
    n = float(kept.count())
    counts = kept.select("__row", F.explode(_words()).alias("term")).groupBy("term").agg(F.count("*").alias("df_t"), F.min("__row").alias("low"), F.max("__row").alias("high"))
    holding = kept.where(F.size("__spans") > 0).groupBy("__row").agg(F.first("__spans").alias("__spans"), F.first("__body").alias("__body"), F.count("*").alias("k"))
    at = holding.select("__row", "k", F.explode(F.array_distinct(F.transform("__spans", _entity))).alias("entity"))
    same = [F.bit_xor(F.xxhash64("__row", F.lit(i))).alias(f"x{i}") for i in range(2)]
    entities = stored(at.groupBy("entity").agg(F.sum("k").alias("df_e"), *same), "entities")
    key = ["df_e", "x0", "x1"]
    owned = stored(at.join(entities, "entity").select("__row", "k", *key).distinct(), "owned")
    most = lambda df_e: F.pow(F.pow(df_e, F.lit(7.0)) * n, F.lit(0.125)) + 1e-6
    top = owned.groupBy("__row").agg(most(F.max("df_e").cast("double")).alias("top"))
    dearest = entities.agg(most(F.max("df_e").cast("double"))).first()[0] or 0.0
    scarce = holding.select("__row", "__body").join(top, "__row").select("__row", "top", F.explode(_words()).alias("term"))
    scarce = scarce.join(counts.where(F.col("df_t") <= dearest), "term").where("df_t <= top").drop("top")
    scarce = stored(scarce, "scarce")
    pairs = scarce.join(owned, "__row").where(F.col("df_t") <= most(F.col("df_e").cast("double")))
    pairs = pairs.groupBy("term", "df_t", "low", "high", *key).agg(F.sum("k").alias("n_et"), F.count("*").alias("m"))
    r = F.col("n_et").cast("double") / F.col("df_t") * F.col("m") / (F.col("m") + 1)
    r2 = r * r
    pairs = stored(pairs.where((r2 * r2) * (r2 * r2) * n >= F.col("df_e")), "disclosing")
    by_entity = entities.join(pairs.groupBy(*key).agg(F.count("*").alias("terms")), key, "left")
    by_entity = by_entity.select("entity", F.coalesce("terms", F.lit(0)).alias("terms"))
    terms = stored(pairs.groupBy("term", "df_t", "low", "high").agg(F.max(F.col("n_et") >= F.col("df_t")).alias("alone")), "terms")
    # Texts with an entity have been met with their words already. Others can only hold a term that isn't alone: one
    # with two texts at most names them, the rest are looked for in all these texts.
    found = scarce.select("__row", "term").join(terms.select("term", "alone"), "term").select("__row", "term", "alone")
    other = terms.where("not alone")
    found = found.union(other.where("df_t <= 2").select(F.explode(F.array("low", "high")).alias("__row"), "term", "alone"))
    wide = other.where("df_t > 2").select("term", "alone")
    if wide.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        wide = F.broadcast(wide)
    found = found.union(kept.where(F.size("__spans") == 0).select("__row", F.explode(_words()).alias("term")).join(wide, "term").select("__row", "term", "alone"))
    return found, by_entity


def _term_spans(kept: DataFrame) -> DataFrame:
    """Adds ``__terms``: a span at every place of the words ``__found`` in the whole text."""
    some = F.col("__found").isNotNull()
    df = kept.withColumn("__m", F.when(some, F.regexp_extract_all("__body", F.lit(WORD), F.lit(0)))).withColumn("__g", F.when(some, F.split("__body", WORD, -1)))
    df = df.withColumn("__z", F.zip_with("__m", F.slice("__g", F.lit(1), F.size("__m")), lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m).alias("size")))).drop("__g")
    df = df.withColumn("__at", F.when(some, _running("__z", F.lit(0)))).drop("__z")
    how = lambda m: F.when(F.array_contains("__found.remove", F.lower(m)), "remove").when(F.array_contains("__found.generalise", F.lower(m)), "generalise")
    spans = F.zip_with("__m", "__at", lambda m, s: F.struct(s.alias("start"), F.lit(4).alias("kind"), (s + F.length(m)).alias("end"), how(m).alias("value")))
    return df.withColumn("__terms", F.coalesce(F.filter(spans, lambda x: x["value"].isNotNull()), F.array().cast(_SPAN)))


def analysed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, hash of the text, base spans, spans of disclosing words) for every row: words are
    counted over whole texts and found wherever they stand, in every text."""
    texts = df.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    rows = base_spans(texts, "__text").withColumn("__row", F.xxhash64("__text"))
    kept = stored(rows.select("__id", "__row", "__spans", _blanked(F.col("__text"), F.col("__spans")).alias("__body")), "spans")
    found, _ = disclosed(kept)
    of = lambda cond, name: F.collect_set(F.when(cond, F.col("term"))).alias(name)
    found = found.groupBy("__row").agg(of(F.col("alone"), "remove"), of(~F.col("alone"), "generalise"))
    found = found.select("__row", F.struct("remove", "generalise").alias("__found"))
    return _term_spans(kept.join(found, "__row", "left")).select("__id", "__row", "__spans", "__terms")


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    text = lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(spans, text), ",")


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, counts by kind, the hash of the base spans and all spans, for every row."""
    a = analysed(df, id_col, text_col)
    number = lambda k: F.size(F.filter("__spans", lambda x: x["kind"] == k)).cast("long")
    return a.select(
        F.col("__id").alias(id_col),
        *[number(k).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(_joined(F.col("__spans")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("__spans", "__terms"))).alias("spans"),
    )


def sanitized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with base spans replaced by a tag of their kind and disclosing words generalised or removed."""
    # Written first: a filter on spans would be moved into the expressions that find them and repeat these.
    found = stored(analysed(df, id_col, text_col), "analysed").where((F.size("__spans") > 0) | (F.size("__terms") > 0))
    found = found.groupBy("__id", "__row").agg(F.first(F.array_sort(F.concat("__spans", "__terms"))).alias("__all"))
    columns = df.columns
    docs = df.select(F.struct(*columns).alias("doc"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"))
    out = docs.join(found, F.col("id").eqNullSafe(F.col("__id")) & (F.col("hash") == F.col("__row")), "left")
    tag = lambda x: F.when(x["kind"] < 4, F.concat(F.lit("["), F.upper(F.get(F.array(*map(F.lit, KINDS)), x["kind"])), F.lit("]"))).when(x["value"] == "generalise", "[WORD]").otherwise("")
    step = lambda acc, x: F.struct(
        F.greatest(acc["end"], x["end"]).alias("end"),
        F.concat(acc["out"], F.array(F.struct(acc["end"].alias("from"), F.greatest(x["start"], acc["end"]).alias("to"), F.when(x["start"] >= acc["end"], tag(x)).otherwise("").alias("tag")))).alias("out"),
    )
    zero = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<from:int,to:int,tag:string>>").alias("out"))
    out = out.withColumn("__cuts", F.when(F.col("__all").isNotNull(), F.aggregate("__all", zero, step)))
    text = F.col("text")
    body = F.array_join(F.transform("__cuts.out", lambda p: F.concat(F.substring(text, p["from"] + 1, p["to"] - p["from"]), p["tag"])), "")
    clean = F.concat(body, F.substring(text, F.col("__cuts.end") + 1, F.length(text)))
    return out.select(*[F.when(F.col("__cuts").isNull(), text).otherwise(clean).alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir))


_RE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _sql() -> str:
    def found(k: int, kind: str) -> str:
        check = {
            "email": "true",
            "ip": "len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3 OR lpad(ltrim(p, '0'), 3, '0') > '255')) = 0",
            "card": "length(g) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(g) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(g[length(g) - i + 1] AS INT) "
            "WHEN CAST(g[length(g) - i + 1] AS INT) > 4 THEN 2 * CAST(g[length(g) - i + 1] AS INT) - 9 ELSE 2 * CAST(g[length(g) - i + 1] AS INT) END)) % 10 = 0",
            "phone": "length(g) BETWEEN 9 AND 15",
        }[kind]
        return f"""
x{k} AS (SELECT rid, text, regexp_extract_all(text, '{_RE[kind]}') AS ms, string_split_regex(text, '{_RE[kind]}') AS gs FROM d WHERE regexp_matches(text, '{_RE[kind]}')),
y{k} AS (SELECT rid, unnest(ms) AS v, unnest(range(1, len(ms) + 1)) AS i, unnest(list_transform(ms, lambda m: length(m))) AS size, unnest(list_transform(gs[1:len(ms)], lambda m: length(m))) AS gap FROM x{k}),
z{k} AS (SELECT rid, v, regexp_replace(v, '[^0-9]', '', 'g') AS g, sum(size + gap) OVER (PARTITION BY rid ORDER BY i) - size AS s, size FROM y{k}),
f{k} AS (SELECT rid, {k} AS kind, CAST(s AS BIGINT) AS s, CAST(s + size AS BIGINT) AS e, {"lower(v)" if kind == "email" else "v" if kind == "ip" else "g"} AS value FROM z{k} WHERE {check}),"""

    word = r"[\p{L}\p{M}\p{N}]+"
    names = "['email', 'ip', 'card', 'phone', 'term']"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),{"".join(found(k, kind) for k, kind in enumerate(KINDS[:4]))}
b AS (SELECT * FROM f0 UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3),
iv AS (SELECT b.rid, s, e, kind, text, coalesce(max(e) OVER (PARTITION BY b.rid ORDER BY s, kind, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM b JOIN d ON d.rid = b.rid),
hd AS (SELECT rid, max(e) AS last, string_agg(substr(text, p + 1, greatest(s, p) - p) || repeat(' ', greatest(e, p) - greatest(s, p)), '' ORDER BY s, kind, e) AS head FROM iv GROUP BY rid),
bd AS (SELECT d.rid, text, coalesce(head, '') || substr(text, coalesce(last, 0) + 1) AS body FROM d LEFT JOIN hd ON hd.rid = d.rid),
w AS (SELECT rid, text, unnest(list_distinct(regexp_extract_all(lower(body), '{word}'))) AS term FROM bd),
dt AS (SELECT term, count(*) AS df_t FROM w GROUP BY term),
ow AS (SELECT DISTINCT rid, kind || ':' || value AS entity FROM b),
de AS (SELECT entity, count(*) AS df_e FROM ow GROUP BY 1),
et AS (SELECT entity, term, count(*) AS n_et, count(DISTINCT text) AS m FROM ow JOIN w USING (rid) GROUP BY ALL),
q AS (SELECT term, n_et::DOUBLE / df_t * m / (m + 1) AS r, df_e FROM et JOIN de USING (entity) JOIN dt USING (term)),
o AS (SELECT DISTINCT term FROM q WHERE ((r * r) * (r * r)) * ((r * r) * (r * r)) * (SELECT count(*) FROM d)::DOUBLE >= df_e),
pl AS (SELECT rid, regexp_extract_all(body, '{word}') AS ms, string_split_regex(body, '{word}') AS gs FROM bd WHERE rid IN (SELECT rid FROM w JOIN o USING (term))),
wp AS (SELECT rid, unnest(ms) AS v, unnest(range(1, len(ms) + 1)) AS i, unnest(list_transform(gs[1:len(ms)], lambda x: length(x))) AS gap FROM pl),
pe AS (SELECT rid, lower(v) AS term, sum(length(v) + gap) OVER (PARTITION BY rid ORDER BY i) AS e, length(v) AS size FROM wp),
ts AS (SELECT rid, 4 AS kind, CAST(e - size AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM pe JOIN o USING (term)),
a AS (SELECT rid, kind, s, e FROM b UNION ALL SELECT * FROM ts),
g AS (SELECT rid, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip, count(*) FILTER (kind = 2) AS n_card, count(*) FILTER (kind = 3) AS n_phone,
  string_agg({names}[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind, e) FILTER (kind < 4) AS base, string_agg({names}[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind, e) AS spans FROM a GROUP BY rid)
SELECT d.doc_id, CAST(coalesce(n_email, 0) AS BIGINT) AS n_email, CAST(coalesce(n_ip, 0) AS BIGINT) AS n_ip, CAST(coalesce(n_card, 0) AS BIGINT) AS n_card,
  CAST(coalesce(n_phone, 0) AS BIGINT) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON g.rid = d.rid
"""


SQL = _sql()
