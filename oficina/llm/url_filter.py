"""URL filter by a path-template tree, in DataFrame expressions only.

Rules (host suffix and path prefix) judge what they fit; the longest rule wins. For
the other urls the rules' verdicts are labels to learn from:

1. Distinct (host, path) rows with their counts are cut into segments, however many there are.
2. Level by level, a segment becomes the wildcard ``*`` if its parent has many
   different children or too few pages for each; else it stays literal.
3. Templates under one parent are merged with their siblings unless a chi-square
   test (2.5 %-ish, ``ALIKE``) tells their share of blocked labels from the siblings'.
4. The share of blocked labels of a template (or its merged branch) is smoothed by
   the host's, the host's by that of all labels; from one half up it is blocked.

Counts are aggregated before every shuffle, so a host with a third of all pages
costs each task one row per distinct path; nodes, templates and addresses over more than a thousandth of all paths or rows are
dealt out where they meet their verdicts (an address by the kept columns, so rows equal in all of them stay together).

Edge cases: a null url, or one without ``://``, has an empty host and path and is
judged as the template of that empty host; without any label everything is judged
by an even prior; equal rules are one rule; repeated rows keep a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

#: (verdict, host and path) in the order of the contract.
RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]
#: Levels of the registered SQL only; the operator goes down to the last segment.
DEPTH = 4
#: After so many levels the paths are stored, and those that have ended are set aside.
LEVELS = 2
CHILDREN = 8
ALIKE = 5.0
WEIGHT = 4.0
SALTS = 32
#: A tree node over more than this share (1 / HOT_NODES) of all distinct paths is salted.
HOT_NODES = 1_000
#: Longer lists belong into a table and a join on host suffixes.
MOST_RULES = 1_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(F.translate(raw, _UPPER, _UPPER.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def by_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    if len(rules) > MOST_RULES:
        raise ValueError("too many rules for one expression")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        suffix, start = text.partition("/")[0], "/" + text.partition("/")[2]
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _dealt(rows: DataFrame, facts: DataFrame, keys: list[str], spread: list[str], total: int) -> DataFrame:
    """``rows`` with the facts of their key. A key whose ``__n`` is over 1 / HOT_NODES of ``total`` is dealt out.

    There are at most HOT_NODES such keys, so their list may be broadcast; their facts are
    repeated SALTS times and meet their rows in that many parts, by the columns ``spread``.
    """
    hot = facts.where(F.col("__n") * HOT_NODES > total).select(*keys, F.lit(SALTS).alias("__parts"))
    rows = rows.join(F.broadcast(hot), keys, "left")
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
    parts = F.when(F.col("__n") * HOT_NODES > total, SALTS - 1).otherwise(0)
    facts = facts.withColumn("__salt", F.explode(F.sequence(F.lit(0), parts))).drop("__n")
    return rows.join(facts, [*keys, "__salt"], "left").drop("__salt")


def templates(labelled: DataFrame) -> DataFrame:
    """(host, path) -> (template, parent, pages, labels, blocked) from pages with host, path and rule verdict."""
    label = F.col("__verdict")
    t = labelled.groupBy("host", "path").agg(
        F.count("*").alias("pages"), F.count(label).alias("labels"), F.sum(F.coalesce((label == "block").cast("long"), F.lit(0))).alias("blocked")
    )
    t = t.select("*", F.array_remove(F.split("path", "/", -1), "").alias("__segments"), F.lit("").alias("template"), F.lit("").alias("parent"))
    t = stored(t, "paths")
    total, deepest = t.agg(F.count("*"), F.max(F.size("__segments"))).first()
    ended = []
    for d in range(deepest or 0):
        if d and d % LEVELS == 0:
            t = stored(t, "level")
            ended.append(t.where(F.size("__segments") <= d))
            t = t.where(F.size("__segments") > d)
        seg = F.get("__segments", F.lit(d))
        children = t.where(F.size("__segments") > d).groupBy("host", "template", seg.alias("__seg")).agg(F.sum("pages").alias("pages"), F.count("*").alias("paths"))
        wild = children.groupBy("host", "template").agg(((F.count("*") > CHILDREN) | (F.sum("pages") < 2 * F.count("*"))).alias("__wild"), F.sum("paths").alias("__n"))
        t = _dealt(t, wild, ["host", "template"], ["path"], total)
        deeper = F.size("__segments") > d
        step = F.when(F.col("__wild"), F.lit("*")).otherwise(seg)
        t = t.select(
            "host", "path", "pages", "labels", "blocked", "__segments",
            F.when(deeper, F.concat("template", F.lit("/"), step)).otherwise(F.col("template")).alias("template"),
            F.when(deeper, F.col("template")).otherwise(F.col("parent")).alias("parent"),
        )
    for part in ended:
        t = t.union(part.select(*t.columns))
    return t.drop("__segments")


def judged_templates(paths: DataFrame) -> DataFrame:
    """(host, template) with the smoothed purity, the verdict and the number of paths, ``__n``."""
    branch = paths.groupBy("host", "parent", "template").agg(F.count("*").alias("__n"), F.sum("labels").cast("double").alias("m"), F.sum("blocked").cast("double").alias("b"))
    pool = branch.groupBy("host", "parent").agg(F.sum("m").alias("mm"), F.sum("b").alias("bb"))
    branch = branch.join(pool, ["host", "parent"])
    m, b, mm, bb = (F.col(c) for c in ("m", "b", "mm", "bb"))
    apart = b * (mm - m) - (bb - b) * m
    alike = (m == 0) | (bb * (mm - bb) == 0) | (apart * apart * mm < ALIKE * (m * (mm - m) * (bb * (mm - bb))))
    branch = branch.withColumn("merged", alike)
    together = branch.where("merged").groupBy("host", "parent").agg(F.sum("m").alias("gm"), F.sum("b").alias("gb"))
    hosts = branch.groupBy("host").agg(F.sum("m").alias("hm"), F.sum("b").alias("hb"))
    total = hosts.agg(F.sum("hm"), F.sum("hb")).first()
    prior = ((total[1] or 0.0) + 1.0) / ((total[0] or 0.0) + 2.0)
    # One host may have most templates: its totals meet them in SALTS parts.
    hosts = hosts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    branch = branch.withColumn("__salt", F.pmod(F.xxhash64("template"), F.lit(SALTS)).cast("int"))
    branch = branch.join(together, ["host", "parent"], "left").join(hosts, ["host", "__salt"])
    own_m, own_b = (F.when(F.col("merged"), F.col(g)).otherwise(F.col(o)) for g, o in (("gm", "m"), ("gb", "b")))
    of_host = (F.col("hb") + WEIGHT * prior) / (F.col("hm") + WEIGHT)
    purity = (own_b + WEIGHT * of_host) / (own_m + WEIGHT)
    return branch.select("host", "template", "merged", "__n", purity.alias("purity")).withColumn("verdict", F.when(F.col("purity") >= 0.5, "block").otherwise("allow"))


def judge(pages: DataFrame, keep: list[str], url_col: str, rules=RULES) -> DataFrame:
    """``keep``, host, path, rule, verdict, template and purity for every row of ``pages``."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], host.alias("host"), path.alias("path"))
    rule, verdict = by_rules(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("__verdict"))
    paths = stored(templates(rows), "templates")
    n_paths, n_rows = paths.agg(F.count("*"), F.coalesce(F.sum("pages"), F.lit(0))).first()
    # A template of the wildcard may hold most paths, an address (or the lack of one) most rows.
    of_template = stored(judged_templates(paths).select("host", "template", "verdict", "purity", "__n"), "judged")
    found = _dealt(paths.select("host", "path", "template", "pages"), of_template, ["host", "template"], ["path"], n_paths)
    found = stored(found.withColumnRenamed("pages", "__n"), "found")
    out = _dealt(rows, found, ["host", "path"], [f"__k{i}" for i in range(len(keep))] or ["path"], n_rows)
    return out.select(
        *[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], "host", "path", "rule",
        F.coalesce("__verdict", "verdict").alias("verdict"), "template", "purity",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id"], "url").drop("purity")


def _sql() -> str:
    longest = sorted(RULES, key=lambda r: (len(r[1]), r[1]), reverse=True)
    case = ""
    for _, text in longest:
        suffix, start = text.partition("/")[0], "/" + text.partition("/")[2]
        case += f" WHEN (host = '{suffix}' OR ends_with(host, '.{suffix}')) AND starts_with(path, '{start}') THEN '{text}'"
    verdicts = " ".join(f"WHEN '{text}' THEN '{what}'" for what, text in RULES)
    levels = ""
    for d in range(1, DEPTH + 1):
        levels += f""",
c{d} AS (SELECT host, template, segs[{d}] AS seg, sum(pages) AS pages FROM t{d - 1} WHERE len(segs) >= {d} GROUP BY ALL),
w{d} AS (SELECT host, template, count(*) > {CHILDREN} OR sum(pages) < 2 * count(*) AS wild FROM c{d} GROUP BY ALL),
t{d} AS (SELECT t.host, path, pages, labels, blocked, segs,
  CASE WHEN len(segs) >= {d} THEN t.template || '/' || CASE WHEN wild THEN '*' ELSE segs[{d}] END ELSE t.template END AS template,
  CASE WHEN len(segs) >= {d} THEN t.template ELSE parent END AS parent
  FROM t{d - 1} t LEFT JOIN w{d} w ON w.host = t.host AND w.template = t.template)"""
    return rf"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM a),
p AS (SELECT page_id, translate(raw, '{_UPPER}', '{_UPPER.lower()}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT *, CASE{case} END AS rule FROM p),
v AS (SELECT *, CASE rule {verdicts} END AS v FROM r),
t0 AS (SELECT host, path, count(*) AS pages, count(v) AS labels, sum(CASE WHEN v = 'block' THEN 1 ELSE 0 END) AS blocked,
  list_filter(string_split(path, '/'), lambda x: x <> '')[1:{DEPTH}] AS segs, '' AS template, '' AS parent FROM v GROUP BY host, path){levels},
b AS (SELECT host, parent, template, sum(labels)::DOUBLE AS m, sum(blocked)::DOUBLE AS b FROM t{DEPTH} GROUP BY ALL),
q AS (SELECT *, sum(m) OVER (PARTITION BY host, parent) AS mm, sum(b) OVER (PARTITION BY host, parent) AS bb,
  sum(m) OVER (PARTITION BY host) AS hm, sum(b) OVER (PARTITION BY host) AS hb, sum(m) OVER () AS tm, sum(b) OVER () AS tb FROM b),
k AS (SELECT *, m = 0 OR bb * (mm - bb) = 0 OR (b * (mm - m) - (bb - b) * m) * (b * (mm - m) - (bb - b) * m) * mm < {ALIKE} * (m * (mm - m) * (bb * (mm - bb))) AS merged FROM q),
g AS (SELECT *, sum(CASE WHEN merged THEN m ELSE 0 END) OVER (PARTITION BY host, parent) AS gm, sum(CASE WHEN merged THEN b ELSE 0 END) OVER (PARTITION BY host, parent) AS gb FROM k),
u AS (SELECT host, template, ((CASE WHEN merged THEN gb ELSE b END) + {WEIGHT} * ((hb + {WEIGHT} * ((tb + 1.0) / (tm + 2.0))) / (hm + {WEIGHT}))) / ((CASE WHEN merged THEN gm ELSE m END) + {WEIGHT}) AS purity FROM g)
SELECT v.page_id, v.host, v.path, v.rule, coalesce(v.v, CASE WHEN u.purity >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict, t.template
FROM v JOIN t{DEPTH} t ON t.host = v.host AND t.path = v.path JOIN u ON u.host = t.host AND u.template = t.template
"""


SQL = _sql()
