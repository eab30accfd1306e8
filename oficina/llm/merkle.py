"""Merkle manifest of a dataset: a tree for each group of rows, a tree over the groups, proofs by coordinates.

A leaf is the digest of a row's columns. Leaves of a group ascend by id; every ``FAN`` consecutive
nodes become the digest of their joined hex digests, until one is left, the group's root. The group
roots, ordered by group, are the leaves of one more tree, whose root stands for the dataset.

Trees are built ``DEEP`` levels at a time, so a task holds blocks of FAN ** DEEP digests and never a
group. The node table (group, level, place, digest) is written to the shared folder. For a proof a leaf
gives the coordinates of its siblings, known from its place and the size of its group alone; they are
exploded, joined with the node table, put in order and concatenated. This too goes by ``DEEP`` levels: a
leaf looks up its siblings within its block, the block's own proof is looked up once for all its leaves, and
so on up to the dataset. So no node is asked for by more than FAN ** DEEP rows, whatever a group's size, and both sides
are shuffled once, by block: for that the session's ``spark.sql.requireAllClusterKeysForCoPartition`` is set to false.

Defined results: a null value counts as ``-``, a value as its length in UTF-8 bytes, a colon and itself, so
no two rows share a digest input. A null group is a group, the first one. A null id comes first in its group.
Rows of one id are leaves of their own, ordered by digest (equal rows are interchangeable). A lone leaf is its
group's root, with no siblings below it. An empty table has no rows and no root. Other columns do not matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, remainder, stored

FAN = 3
#: Levels built, and looked up, in one step.
DEEP = 6
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the joined parts."""
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[str], **instead: Column) -> Column:
    """The digest of a row, with other values for some of its columns."""
    return digest(*[encoded(instead.get(c, F.col(f"`{c}`"))) for c in columns])


def numbered(df: DataFrame, group: str, order: list[str], name: str, fan: int = FAN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their place in a range, the ranges' starts in their groups, and the groups.

    Rows are dealt out by ranges of (group, order) and written with the range (``__range``) and their place in it
    (``__row``); a range's start within a group is a running sum over ranges. So a group of any size is spread over
    many tasks. ``placed`` adds the place in the group to the rows, and the group's ``size`` and tree height ``h``.
    """
    sort = [group, *order]
    rows = df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("__at", F.monotonically_increasing_id())
    rows = stored(rows, name).withColumns({"__range": F.shiftright("__at", 33), "__row": F.col("__at").bitwiseAND((1 << 33) - 1)}).drop("__at")
    ranges = rows.groupBy(F.col(group).alias("__group"), F.col("__range").alias("__r")).agg(F.min("__row").alias("__first"), F.count("*").alias("__n"))
    whole = Window.partitionBy("__group")
    so_far = whole.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("__group", "__r", (F.coalesce(F.sum("__n").over(so_far), F.lit(0)) - F.col("__first")).alias("__start"), F.sum("__n").over(whole).alias("size"))
    groups = ranges.groupBy(F.col("__group").alias(group)).agg(F.sum("__n").alias("size"))
    return rows, starts.withColumn("h", height("size", fan)), groups.withColumn("h", height("size", fan))


def placed(rows: DataFrame, starts: DataFrame, group: str) -> DataFrame:
    out = rows.join(starts, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__range") == F.col("__r")))
    return out.withColumn("place", F.col("__row") + F.col("__start")).drop("__group", "__range", "__r", "__row", "__start")


def height(size: str, fan: int) -> Column:
    """Levels from the leaves of a group to its root: the least h with fan ** h >= size."""
    powers = [fan**e for e in range(64) if fan**e < 1 << 62]
    return F.size(F.filter(F.array(*[F.lit(p).cast("long") for p in powers]), lambda p: p < F.col(size)))


def tree(leaves: DataFrame, groups: DataFrame, name: str, fan: int = FAN, deep: int = DEEP) -> tuple[list[DataFrame], DataFrame]:
    """The node table and the roots of leaves (g, size, h, place, digest).

    The table is a list of parts (g, size, h, level, place, block, digest), each with ``deep`` levels and the lowest nodes of
    the next part; roots are (g, size, h, digest). One number, the greatest height, goes to the driver.
    """
    most = groups.agg(F.max("h").alias("h")).first()["h"] or 0
    parts, units, block = [], leaves, fan**deep
    for low in range(0, max(most, 1), deep):
        levels = [F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"])]
        rows = units.groupBy("g", "size", "h", F.expr(f"place div {block}").alias("__block")).agg(levels[0].alias("__0"))
        for k in range(1, deep + 1):
            below = f"__{k - 1}"
            runs = F.transform(F.sequence(F.lit(0), F.expr(f"(size({below}) + {fan - 1}) div {fan} - 1").cast("int")), lambda i: F.sha2(F.array_join(F.slice(below, i * fan + 1, fan), ""), 256))  # noqa: B023
            rows = rows.withColumn(f"__{k}", F.when(F.col("h") >= low + k, runs))
        rows = rows.select("g", "size", "h", "__block", F.posexplode(F.array(*[f"__{k}" for k in range(deep + 1)])).alias("__k", "__nodes"))
        rows = rows.select("g", "size", "h", "__block", "__k", F.posexplode("__nodes").alias("__p", "digest"))
        width = F.element_at(F.array(*[F.lit(fan ** (deep - k)).cast("long") for k in range(deep + 1)]), F.col("__k") + 1)
        rows = rows.select("g", "size", "h", (F.col("__k") + low).alias("level"), (F.col("__block") * width + F.col("__p")).alias("place"), F.col("__block").alias("block"), "digest")
        parts.append(stored(rows, f"{name}-nodes-{low}"))
        units = parts[-1].where((F.col("level") == low + deep) & (F.col("h") > low + deep)).drop("level", "block")
    # A part's highest level stands in the next part again, so each takes the roots that it is the first to have.
    tops = [p.where((F.col("level") == F.col("h")) & (F.col("h") >= (i * deep + 1 if i else 0))) for i, p in enumerate(parts)]
    return parts, reduce(DataFrame.unionByName, tops).select("g", "size", "h", "digest")


def _levels(low: int, fan: int, deep: int) -> Column:
    """For k levels above ``low``: the level, the width of its nodes in nodes of ``low`` and in leaves."""
    return F.array(*[F.struct(F.lit(low + k).alias("level"), F.lit(fan**k).cast("long").alias("width"), F.lit(fan ** (low + k)).cast("long").alias("leaves")) for k in range(deep)])


def _whole(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _coordinates(low: int, fan: int, deep: int) -> Column:
    """The siblings, as (level, at), of the node at ``place`` of level ``low`` on its way up through ``deep`` levels."""

    def run(x: Column) -> Column:
        here, nodes = _whole(F.col("place"), x["width"]), _whole(F.col("size") + x["leaves"] - 1, x["leaves"])
        whole = F.transform(F.array(*[F.lit(i) for i in range(fan)]), lambda i: F.struct(x["level"].alias("level"), (_whole(here, F.lit(fan)) * fan + i).alias("at")))
        return F.filter(whole, lambda c: (c["at"] != here) & (c["at"] < nodes))

    return F.flatten(F.transform(F.filter(_levels(low, fan, deep), lambda x: x["level"] < F.col("h")), run))


def paths(leaves: DataFrame, parts: list[DataFrame], above: DataFrame, name: str, fan: int = FAN, deep: int = DEEP) -> DataFrame:
    """``leaves`` with ``path``, from the leaf's level up: what stands before and after the own digest in each run.

    ``above`` has a row for each group: (g, h, path, ...), with the path of the group's root; its other columns are added.
    """
    more = [c for c in above.columns if c not in ("g", "size", "h", "path")]
    # Rows that are dealt out by block stay there when they are joined by block and coordinate.
    leaves.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    upper = None
    for i in reversed(range(len(parts))):
        low = i * deep
        if i:
            units, own = parts[i].where(F.col("level") == low).select("g", "size", "h", "place"), []
        else:
            units, own = leaves, [c for c in leaves.columns if c not in ("g", "size", "h", "place")]
        # A block's units, their coordinates and its nodes are dealt out by the block once, for both joins and the grouping.
        units = units.withColumn("block", F.expr(f"place div {fan**deep}")).repartition("g", "block")
        asked = units.select("g", "block", "size", "h", "place", *own, F.posexplode_outer(_coordinates(low, fan, deep)).alias("__n", "__c"))
        # A unit's own columns travel with its first coordinate only.
        carried = F.when(F.coalesce(F.col("__n"), F.lit(0)) == 0, F.struct(F.lit(True).alias("__"), *own))
        asked = asked.select("g", "block", "size", "h", "place", carried.alias("__own"), F.col("__c.level").alias("__level"), F.col("__c.at").alias("__at"))
        nodes = parts[i].where(F.col("level") < low + deep).select(F.col("g").alias("__g"), F.col("block").alias("__b"), F.col("level").alias("__l"), F.col("place").alias("__p"), "digest").repartition("__g", "__b")
        found = asked.join(nodes, (F.col("g") == F.col("__g")) & (F.col("block") == F.col("__b")) & (F.col("__level") == F.col("__l")) & (F.col("__at") == F.col("__p")), "left")
        sibling = F.when(F.col("digest").isNotNull(), F.struct("__level", "__at", "digest"))
        rows = found.groupBy("g", "block", "size", "h", "place").agg(F.max("__own").alias("__own"), F.array_sort(F.collect_list(sibling)).alias("__s"))

        def step(x: Column) -> Column:
            here, run = _whole(F.col("place"), x["width"]), F.filter("__s", lambda s: s["__level"] == x["level"])
            joined = lambda side: F.array_join(F.transform(F.filter(run, lambda s: side(s["__at"])), lambda s: s["digest"]), "")
            return F.struct(joined(lambda at: at < here).alias("before"), joined(lambda at: at > here).alias("after"))

        steps = F.transform(F.filter(_levels(low, fan, deep), lambda x: x["level"] < F.col("h")), step)
        rows = rows.select("g", "block", "size", "h", "place", *[f"__own.`{c}`" for c in own], steps.alias("__path"))
        # Above a block stands the next part's unit of its number, or, where the group ends here, the group.
        ends = above.where((F.col("h") <= low + deep) & (F.col("h") > (low if i else -1))).withColumn("__block", F.lit(0).cast("long")).drop("size", "h")
        over = ends if upper is None else ends.unionByName(upper.select("g", "path", *more, F.col("place").alias("__block")))
        over = over.withColumnsRenamed({"g": "__g", "path": "__above"})
        rows = rows.join(over, (F.col("g") == F.col("__g")) & (F.col("block") == F.col("__block")))
        rows = rows.select("g", "size", "h", "place", *own, F.concat("__path", "__above").alias("path"), *more)
        upper = stored(rows, f"{name}-paths-{i}") if i else rows
    return upper


def folded(start: Column, path: str = "path") -> Column:
    """The root that a leaf's digest and its path give."""
    return F.aggregate(path, start, lambda acc, p: F.sha2(F.concat(p["before"], acc, p["after"]), 256))


def siblings(path: str = "path") -> Column:
    """The digests of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), "")


def manifest(leaves: DataFrame, group: str, order: list[str], fan: int = FAN, deep: int = DEEP) -> DataFrame:
    """``leaves`` (``group``, ``digest`` and any other columns) with ``path``, ``subroot`` and ``root``.

    ``order`` puts the leaves of a group into their places; the digest is the last key.
    """
    rows, starts, groups = numbered(leaves, group, [*order, "digest"], "leaves", fan)
    # The groups' own tree: one group, named 0, whose leaves are the groups in order.
    named = groups.select(F.lit(0).cast("long").alias("g"), F.col(group).alias("__name"), F.col("h").alias("__rows_h"))
    named, named_starts, all_groups = numbered(named, "g", ["__name"], "groups", fan)
    numbers = stored(placed(named, named_starts, "g"), "group-numbers")
    names = numbers.select("__name", F.col("place").alias("g"))
    rows = placed(rows, starts.join(names, F.col("__group").eqNullSafe(F.col("__name"))).drop("__name"), group)
    parts, roots = tree(rows.select("g", "size", "h", "place", "digest"), numbers.select(F.col("__rows_h").alias("h")), "rows", fan, deep)
    tops = numbers.select("g", "size", "h", "place").join(roots.select(F.col("g").alias("place"), "digest"), "place")
    tops = stored(tops.select("g", "size", "h", "place", "digest"), "subroots")
    top_parts, root = tree(tops, all_groups, "groups", fan, deep)
    start = root.select("g", "h", F.array().cast("array<struct<before:string,after:string>>").alias("path"), F.col("digest").alias("root"))
    above = paths(tops.withColumnRenamed("digest", "subroot"), top_parts, start, "groups", fan, deep)
    above = numbers.select(F.col("place").alias("g"), F.col("__rows_h").alias("h")).join(above.select(F.col("place").alias("g"), "path", "subroot", "root"), "g")
    return paths(rows, parts, stored(above, "groups-above"), "rows", fan, deep).drop("g", "size", "h", "place")


def tampered(id_col: str, text_col: str) -> Column:
    """The text, without its line ends where 2 divides the crc32 of the id."""
    return F.when(F.coalesce(remainder(id_col, 2) == 0, F.lit(False)), F.replace(F.col(text_col), F.lit("\n"), F.lit(""))).otherwise(F.col(text_col))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(*COLUMNS)
    leaves = docs.select("doc_id", "source", leaf(COLUMNS).alias("digest"), leaf(COLUMNS, text=tampered("doc_id", "text")).alias("altered"))
    out = manifest(leaves, "source", ["doc_id"])
    return out.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(siblings(), 256).alias("proof_sha256"), folded(F.col("altered")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _crc32(value: str) -> str:
    """DuckDB: crc32 of a text, a bit at a time (256 in the list of steps means one shift)."""
    steps = f"flatten(list_transform(string_split(CAST({value} AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, 256, 256, 256, 256, 256, 256, 256, 256]))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, s: CASE WHEN s < 256 THEN xor(c, s) ELSE xor(c >> 1, 3988292384::BIGINT * (c & 1)) END), 4294967295::BIGINT)"


def _sql() -> str:
    part = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR)))::VARCHAR || ':' || CAST({c} AS VARCHAR), '-')"
    joined = " || ".join(part(c) for c in COLUMNS)
    altered = joined.replace("text AS", "t AS")
    climb = lambda name, first: f"""
{name}(g, level, place, n, digest) AS (
  {first}
  UNION ALL
  SELECT g, level + 1, place // {FAN}, (min(n) + {FAN - 1}) // {FAN}, sha256(string_agg(digest, '' ORDER BY place)) FROM {name} WHERE n > 1 GROUP BY g, level, place // {FAN})"""  # noqa: E731
    sides = f"""LEFT JOIN LATERAL (SELECT string_agg(s.digest, '' ORDER BY s.place) FILTER (s.place < w.place) AS b, string_agg(s.digest, '' ORDER BY s.place) FILTER (s.place > w.place) AS a
      FROM {{0}} s WHERE s.g = w.g AND s.level = w.level AND s.place // {FAN} = w.place // {FAN} AND s.place <> w.place) x ON true"""
    return f"""
WITH RECURSIVE d AS (SELECT *, CASE WHEN {_crc32('doc_id')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS t FROM documents),
l AS (SELECT doc_id, source, sha256({joined}) AS leaf, sha256({altered}) AS altered FROM d),
p AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM l),
{climb('nodes', 'SELECT g, 0, place, n, leaf FROM p')},
subs AS (SELECT g, digest AS subroot FROM nodes WHERE n = 1),
{climb('tops', 'SELECT 0::BIGINT, 0, g, (SELECT count(*) FROM subs), subroot FROM subs')},
w(id, g, level, place, n, cur, proof) AS (
  SELECT row_number() OVER (), g, 0, place, n, altered, '' FROM p
  UNION ALL
  SELECT w.id, w.g, w.level + 1, w.place // {FAN}, (w.n + {FAN - 1}) // {FAN}, sha256(coalesce(x.b, '') || w.cur || coalesce(x.a, '')), w.proof || coalesce(x.b, '') || coalesce(x.a, '')
  FROM w {sides.format('nodes')} WHERE w.n > 1),
v(id, g, level, place, n, cur, proof) AS (
  SELECT id, 0::BIGINT, 0, g, (SELECT count(*) FROM subs), cur, proof FROM w WHERE n = 1
  UNION ALL
  SELECT w.id, w.g, w.level + 1, w.place // {FAN}, (w.n + {FAN - 1}) // {FAN}, sha256(coalesce(x.b, '') || w.cur || coalesce(x.a, '')), w.proof || coalesce(x.b, '') || coalesce(x.a, '')
  FROM v w {sides.format('tops')} WHERE w.n > 1),
q AS (SELECT *, row_number() OVER () AS id FROM p)
SELECT q.doc_id, q.leaf, s.subroot, r.digest AS root, sha256(v.proof) AS proof_sha256, v.cur AS folded_root, v.cur = r.digest AS verified
FROM q JOIN v ON v.id = q.id AND v.n = 1 JOIN subs s ON s.g = q.g JOIN tops r ON r.n = 1"""


SQL = _sql()
