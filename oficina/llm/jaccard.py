"""N-gram Jaccard join by a token-group matrix.

A text's tokens are its distinct 5-word shingles, as 64-bit hashes (two different
shingles of two texts agree with probability 2^-64). Two texts link when
``100 * |A & B| >= percent * |A | B|``. The answer is, for each row, the smallest id
reachable by links. No link between different texts is lost:

1. Texts with equal sets (by a 128-bit hash of the whole set) form a class with a
   number of its own; from here on only classes are compared.
2. Classes are partitioned into groups of similar ones: classes that agree on a pair
   of minimum hashes are compared with one centre class of theirs, true links are
   followed by connected components, and a component is a group. This only decides
   the grouping; what it misses, step 4 finds.
3. The token-group matrix: for each group the union of its members' tokens. Of a
   member only the tokens that every link must meet are stored: with tokens in one
   global order (rare first), a link shares one of the first
   ``n - ceil(percent * n / 100) + 1`` tokens of either set. Cells of groups are
   aggregated before the shuffle, so a group of any size has one cell per token.
   A cell bounds the overlap: two sets whose first common token stands at place i
   of n share n - i tokens at most, so the cell keeps the largest partner that its
   place leaves open (``reach``) and the sizes of its members.
4. Cells meet where the bound leaves a link open. The smaller of two linked sets has its
   first common token where partners of its own size are still open, so one side of that
   join holds only such cells (``near``): a token that many texts have late in their order
   meets nothing. A pair that meets is bounded again by all its common stored tokens. Of each pair of groups the two members that meet in the most tokens are compared first,
   on their whole texts; a link connects the groups and nothing more is asked of them.
   Of the pairs of groups still apart, the members of the smaller one are queries to the larger:
   each query's tokens in which the two groups meet are bounded against the group's cells, and only for what qualifies is the group
   opened, its members met under their own sizes and verified on whole texts.
5. Components over groups give the result.

The order comes from a count of tokens that are frequent within a stretch of
rows; it has at most ``FREQUENT`` entries, is the only thing that is broadcast, and
only makes the work less: any order gives the same links.

Edge cases: texts with fewer than 5 words have their whole sequence as one token; null
texts and texts without words have no token, link with nothing and are their own
component; a null id takes its group's smallest id (null if it has none); repeated
rows keep a row each; with one id on different texts, each row follows its own text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, documents, grams, lower_words, mixed, short_batches, stored
from .components import connected

WIDTH = 5
PERCENT = 80
FREQUENT = 1 << 20
_OFTEN = 4
_WINDOW = 3_000_000
_BINS = 64
_HASHES = WordHashes()


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct token hashes of a whole text."""
    h = _HASHES.of(lower_words(text))
    return np.unique(grams(h, min(width, len(h))) if len(h) else h)


def need(n: int, percent: int) -> int:
    """Least overlap of a set of n with any partner."""
    return -(-percent * n // 100)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _class(s: np.ndarray) -> tuple[int, int]:
    """Both halves of a 128-bit hash of a whole set."""
    h1, h2 = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
    return int(h1), int(h2)


def _minima(s: np.ndarray, parts: int) -> np.ndarray:
    """Smallest hash of each of ``parts`` equal ranges; an empty range takes the next one's."""
    cuts = (np.arange(parts, dtype=np.uint64) << np.uint64(64 - parts.bit_length() + 1))
    return s[np.searchsorted(s, cuts) % len(s)]


def _bands(s: np.ndarray) -> list[int]:
    m = _minima(s, 8)
    i = np.array([0, 2, 4, 6, 0, 1, 4, 5])
    j = np.array([1, 3, 5, 7, 2, 3, 6, 7])
    return mixed(m[i] * np.uint64(31) + m[j] + np.arange(8, dtype=np.uint64)).astype(np.int64).tolist()


def signatures(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """For each row (id, n, h1, h2, bands, sig, key); beside them rows with n = -1: a token in
    ``h1`` that ``times`` rows of one stretch have. ``key`` is the text's hash, for rows with a null id only."""
    short_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    id_type = df.select(id_col).limit(0).toArrow().schema.field(0).type

    def work(batches):
        names = ["id", "n", "h1", "h2", "bands", "sig", "times", "key"]
        kept: list[np.ndarray] = []
        size = 0

        def frequent():
            tokens, times = np.unique(np.concatenate(kept), return_counts=True) if kept else (np.zeros(0, np.uint64), np.zeros(0, int))
            often = times >= _OFTEN
            k = int(often.sum())
            none = lambda t: pa.nulls(k, t)
            return pa.RecordBatch.from_arrays(
                [none(id_type), pa.array(np.full(k, -1, np.int32)), pa.array(tokens[often].astype(np.int64)), none(pa.int64()), none(pa.list_(pa.int64())), none(pa.binary()), pa.array(times[often].astype(np.int32)), none(pa.int64())],
                names=names,
            )

        for b in batches:
            n, cls, bands, sig = [], [], [], []
            for t in b.column(1).to_pylist():
                s = shingles(t, width)
                n.append(len(s))
                cls.append(_class(s))
                bands.append(_bands(s) if len(s) else [])
                sig.append((_minima(s, _BINS) >> np.uint64(20)).astype(np.uint8).tobytes() if len(s) else b"")
                kept.append(s)
                size += len(s)
                if size >= _WINDOW:
                    yield frequent()
                    kept, size = [], 0
            h1, h2 = (pa.array([c[i] for c in cls], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int32()), h1, h2, pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary()), pa.nulls(len(n), pa.int32()), b.column(2)], names=names
            )
        yield frequent()

    key = F.when(F.col(id_col).isNull(), F.xxhash64(text_col))
    return df.select(id_col, text_col, key).mapInArrow(work, f"id {kind}, n int, h1 long, h2 long, bands array<long>, sig binary, times int, key long")


def _frequent(sigs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, row counts) of the most frequent tokens, at most FREQUENT, by token."""
    found = stored(sigs.where("n = -1").groupBy(F.col("h1").alias("token")).agg(F.sum("times").alias("times")).where("times >= 8"), "frequent")
    least = 8
    while found.where(F.col("times") >= least).count() > FREQUENT:
        least *= 2
    got = found.where(F.col("times") >= least).toArrow()
    tokens = got.column("token").to_numpy().astype(np.uint64) if len(got) else np.zeros(0, np.uint64)
    times = got.column("times").to_numpy() if len(got) else np.zeros(0, np.int64)
    at = np.argsort(tokens)
    return tokens[at], times[at]


def prefixes(df: DataFrame, id_col: str, text_col: str, frequent: tuple[np.ndarray, np.ndarray], width: int, percent: int) -> DataFrame:
    """(id, h1, h2, tokens): the tokens of a row's set that every link must meet, rare first."""
    shared = df.sparkSession.sparkContext.broadcast(frequent)
    kind = df.schema[id_col].dataType.simpleString()

    def work(batches):
        often, times = shared.value
        for b in batches:
            cls, lists = [], []
            for t in b.column(1).to_pylist():
                s = shingles(t, width)
                cls.append(_class(s))
                if not len(s):
                    lists.append(s)
                    continue
                keep = len(s) - need(len(s), percent) + 1
                if len(often):
                    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    rank = np.where(often[at] == s, times[at], 0)
                    s = s[np.argsort(rank, kind="stable")]
                lists.append(s[:keep])
            ends = np.cumsum([0] + [len(x) for x in lists])
            flat = np.concatenate(lists).astype(np.int64) if lists else np.zeros(0, np.int64)
            h1, h2 = (pa.array([c[i] for c in cls], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), h1, h2, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["id", "h1", "h2", "tokens"])

    return df.select(id_col, text_col).mapInArrow(work, f"id {kind}, h1 long, h2 long, tokens array<long>")


def verified(pairs: DataFrame, classes: DataFrame, df: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b: classes) that link, by their whole texts."""
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct().join(classes.select("cls", "h1", "h2", "rep", "key"), "cls")
    columns = ["cls", "h1", "h2", "text"]
    texts = df.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text")).join(wanted.drop("key"), "rep").select(*columns)
    nameless = df.where(F.col(id_col).isNull()).select(F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    texts = texts.union(nameless.join(wanted.where("rep IS NULL").drop("rep"), "key").select(*columns).dropDuplicates(["cls"]))
    side = lambda c: texts.select(F.col("cls").alias(c), F.struct("h1", "h2", "text").alias(f"t{c}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")

    def work(batches):
        sets: dict[int, np.ndarray] = {}
        held = 0

        def of(cls, row):
            nonlocal held
            s = sets.get(cls)
            if s is None:
                s = shingles(row["text"], width)
                if _class(s) != (row["h1"], row["h2"]):  # another text under the same id
                    return s[:0]
                if held > 2_000_000:
                    sets.clear()
                    held = 0
                sets[cls] = s
                held += len(s)
            return s

        for b in batches:
            a_, b_ = b.column(0).to_pylist(), b.column(1).to_pylist()
            ok = [linked(of(x, tx), of(y, ty), percent) for x, y, tx, ty in zip(a_, b_, b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return rows.mapInArrow(work, "a long, b long").distinct()


def _centre_pairs(classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): a centre of each set of classes with one band key, and the others there that look alike."""
    cells = classes.select("cls", "n", "sig", "rep", F.posexplode("bands").alias("band", "key"))
    centre = cells.groupBy("band", "key").agg(F.min(F.struct("rep", "cls", "n", "sig")).alias("c"), F.count("*").alias("k")).where("k > 1").drop("k")
    pairs = cells.join(centre, ["band", "key"]).where("cls <> c.cls")
    pairs = pairs.where((100 * F.least("n", "c.n")) >= percent * F.greatest("n", "c.n"))
    byte = lambda col, i: F.substring(col, i + 1, 1)
    same = sum((byte("sig", i) == byte("c.sig", i)).cast("int") for i in range(_BINS))
    alike = same >= int(_BINS * (percent - 15) / 100)
    return pairs.select(F.least("cls", "c.cls").alias("a"), F.greatest("cls", "c.cls").alias("b"), alike.alias("alike")).where("alike").select("a", "b").distinct()


def _flat(cells: DataFrame, percent: int) -> DataFrame:
    """(token, g, single, cls, n, reach): every stored token with the largest partner that its place leaves open."""
    rows = cells.select(F.posexplode("tokens").alias("at", "token"), "g", "single", "cls", "n")
    return rows.select("token", "g", "single", "cls", "n", F.expr(f"int((n - at) * {100 + percent} div {percent} - n)").alias("reach"))


def _open(l: str, r: str, percent: int):
    """Whether the sizes and places of two cells leave a link open."""
    c = lambda name, s: F.col(f"{name}_{s}")
    sizes = (100 * c("hi", l) >= percent * c("lo", r)) & (100 * c("hi", r) >= percent * c("lo", l))
    return sizes & (c("reach", l) >= c("lo", r)) & (c("reach", r) >= c("lo", l))


def _bounded(pairs: DataFrame, cells: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b, ...) whose common stored tokens, with all that may lie behind the stored ones, can reach a link.

    Of the two lists of stored tokens one ends first in the common order; every common token up to
    there is among the common stored ones, and behind it the set has ``need - 1`` tokens left.
    """
    out = pairs
    for c in "ab":
        out = out.join(cells.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("tokens").alias(f"tokens_{c}")), c)
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    left = F.floor((percent * F.greatest("n_a", "n_b") + 99) / 100) - 1
    fits = (100 + percent) * (common + left) >= percent * (F.col("n_a") + F.col("n_b"))
    return out.where(fits).select(*pairs.columns).distinct()


def _asking(cells: DataFrame, ask: DataFrame, percent: int) -> DataFrame:
    """(token, g, q, a, lo_q, hi_q, reach_q): for each (q, g) of ``ask`` the members a of q, by the tokens in which the two groups meet.

    As in the matrix, one side of a meeting is near. The first token that a link shares is such a token, so no link is lost, and a
    query's other tokens are not repeated for every group that it asks.
    """
    asking = _flat(cells.join(ask.select(F.col("q").alias("g")).distinct(), "g", "left_semi"), percent).withColumnRenamed("g", "q")
    inside = _flat(cells.join(ask.select("g").distinct(), "g", "left_semi"), percent)
    cell = lambda rows, s: rows.groupBy("token", s).agg(F.min("n").alias(f"lo_{s}"), F.max("n").alias(f"hi_{s}"), F.max("reach").alias(f"reach_{s}"), F.max(F.col("reach") >= F.col("n")).alias(f"near_{s}"))
    of = {"q": cell(asking, "q"), "g": cell(inside, "g")}
    meet = lambda s, o: of[s].where(f"near_{s}").join(of[o], "token").where((F.col(f"lo_{s}") <= F.col(f"hi_{o}")) & _open("q", "g", percent)).select("token", "q", "g")
    by = meet("q", "g").union(meet("g", "q")).join(ask, ["q", "g"], "left_semi").distinct()
    return asking.join(by, ["token", "q"]).select("token", "g", "q", F.col("cls").alias("a"), F.col("n").alias("lo_q"), F.col("n").alias("hi_q"), F.col("reach").alias("reach_q"))


def _labelled(df: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """(id, n, key, c, component_id) for every row of ``df``; c is the component (null without tokens)."""
    whole_set = ["h1", "h2"]
    sigs = stored(signatures(df, id_col, text_col, width), "signatures")
    rows = sigs.where("n >= 0").select("id", "n", *whole_set, "key")
    # Numbers are given once and written, so they are the same for all that follows.
    classes = sigs.where("n > 0").groupBy(*whole_set).agg(F.min("id").alias("rep"), F.min("key").alias("key"), F.max("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = stored(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    # 2: groups of similar classes.
    near = verified(stored(_centre_pairs(classes, percent), "centres"), classes, df, id_col, text_col, width, percent)
    members = connected(near)
    groups = classes.select("cls", *whole_set, "rep", "n").join(members.withColumnRenamed("node", "cls"), "cls", "left")
    groups = stored(groups.select("cls", *whole_set, "rep", "n", F.coalesce("component", "cls").alias("g"), F.col("component").isNull().alias("single")), "groups")
    # 3: the matrix.
    frequent = _frequent(sigs)
    cells = prefixes(df.where(F.col(id_col).isNotNull()), id_col, text_col, frequent, width, percent)
    columns = ["cls", "n", "g", "single", "tokens"]
    named = cells.join(groups.select("cls", *whole_set, F.col("rep").alias("id"), "n", "g", "single"), [*whole_set, "id"])
    # A class without any id is represented by any of its rows.
    nameless = prefixes(df.where(F.col(id_col).isNull()), id_col, text_col, frequent, width, percent)
    nameless = nameless.join(groups.where("rep IS NULL").select("cls", *whole_set, "n", "g", "single"), whole_set).select(*columns)
    cells = stored(named.select(*columns).union(nameless.dropDuplicates(["cls"])), "cells")
    # Rows that repeat an id and a text would each bring their cells.
    if not sigs.where("n > 0").groupBy("id", *whole_set).agg(F.count("*").alias("k")).where("k > 1").isEmpty():
        cells = stored(cells.dropDuplicates(["cls"]), "cells")
    flat = _flat(cells, percent)
    close = F.col("reach") >= F.col("n")
    many = flat.where("not single").groupBy("token", "g").agg(F.min("cls").alias("cls"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("reach").alias("reach"), F.max(close).alias("near"))
    matrix = flat.where("single").select("token", "g", "cls", F.col("n").alias("lo"), F.col("n").alias("hi"), "reach", close.alias("near")).union(many).repartition("token")
    side = lambda s: matrix.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("g", "cls", "lo", "hi", "reach", "near")])
    # 4: bound, open, verify. Cells of one size meet once; l is the side of the smaller set.
    once = (F.col("lo_l") < F.col("lo_r")) | ((F.col("lo_l") == F.col("lo_r")) & (F.col("g_l") < F.col("g_r"))) | (F.col("hi_l") > F.col("lo_l")) | (F.col("hi_r") > F.col("lo_r"))
    met = side("l").where("near_l").join(side("r"), "token").where(F.col("g_l") != F.col("g_r")).where((F.col("lo_l") <= F.col("hi_r")) & once & _open("l", "r", percent))
    ends = [F.least("g_l", "g_r").alias("x"), F.greatest("g_l", "g_r").alias("y")]
    pair = [F.when(F.col("g_l") < F.col("g_r"), F.col(f"cls_{s}")).otherwise(F.col(f"cls_{o}")).alias(c) for s, o, c in (("l", "r", "a"), ("r", "l", "b"))]
    met = met.select(*ends, *pair).groupBy("x", "y", "a", "b").agg(F.count("*").alias("common"))
    met = met.groupBy("x", "y").agg(F.max(F.struct("common", "a", "b")).alias("best"))
    opened = stored(met.select("x", "y", "best.a", "best.b"), "opened")
    tried = stored(_bounded(opened.select("a", "b"), cells, percent), "tried")
    links = verified(tried, classes, df, id_col, text_col, width, percent).join(opened, ["a", "b"]).select("x", "y")
    links = stored(links, "links")
    first = connected(links.select(F.col("x").alias("a"), F.col("y").alias("b")))
    # What is not connected yet is opened, if it has members that were not compared: those of
    # the group with fewer members are queries to the other.
    component = lambda s: first.select(F.col("node").alias(s), F.col("component").alias(f"c_{s}"))
    left_over = opened.select("x", "y").join(component("x"), "x", "left").join(component("y"), "y", "left")
    left_over = left_over.where(F.coalesce("c_x", "x") != F.coalesce("c_y", "y")).select("x", "y")
    several = groups.where("not single").groupBy("g").agg(F.count("*").alias("k"))
    for s in ("x", "y"):
        left_over = left_over.join(several.select(F.col("g").alias(s), F.col("k").alias(f"k_{s}")), s, "left")
    fewer = F.coalesce("k_x", F.lit(1)) <= F.coalesce("k_y", F.lit(1))
    ask = left_over.where("k_x > 1 OR k_y > 1").select(F.when(fewer, F.col("x")).otherwise(F.col("y")).alias("q"), F.when(fewer, F.col("y")).otherwise(F.col("x")).alias("g"))
    ask = stored(ask, "queries")
    asking = _asking(cells, ask, percent)
    inside = _flat(cells.join(ask.select("g").distinct(), "g", "left_semi"), percent).select("token", "g", F.col("cls").alias("b"), "n", "reach")
    union = inside.groupBy("token", "g").agg(F.min("n").alias("lo_g"), F.max("n").alias("hi_g"), F.max("reach").alias("reach_g"))
    asking = asking.join(union, ["token", "g"]).where(_open("q", "g", percent)).drop("lo_g", "hi_g", "reach_g")
    inside = inside.select("token", "g", "b", F.col("n").alias("lo_m"), F.col("n").alias("hi_m"), F.col("reach").alias("reach_m"))
    pairs = asking.join(inside, ["token", "g"]).where(_open("q", "m", percent)).select("a", "b", F.col("q").alias("x"), F.col("g").alias("y")).distinct()
    pairs = stored(_bounded(pairs, cells, percent), "pairs")
    more = verified(pairs.select("a", "b"), classes, df, id_col, text_col, width, percent).join(pairs, ["a", "b"]).select("x", "y")
    links = links.union(more)
    # 5: components over groups.
    final = connected(links.select(F.col("x").alias("a"), F.col("y").alias("b")))
    whole = groups.join(final.withColumnRenamed("node", "g"), "g", "left").select(*whole_set, "rep", F.coalesce("component", "g").alias("c"))
    smallest = whole.groupBy("c").agg(F.min("rep").alias("component_id"))
    labels = whole.join(smallest, "c").select(*whole_set, "c", "component_id")
    out = rows.join(labels, whole_set, "left")
    component_id = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select("id", "n", "key", "c", component_id.alias("component_id"))


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``df``."""
    out = _labelled(df, id_col, text_col, width, percent)
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stand for their group: those with its smallest id.

    Rows that repeat an id and a text stay once; an id that is kept for one of
    several texts is kept for all of them. Rows with a null id are told apart by their
    text: in a group without any id one text stays, and none beside an id.
    """
    rows = stored(_labelled(df, id_col, text_col, WIDTH, PERCENT), "labelled")
    docs = df.select(F.struct(*df.columns).alias("doc"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    named = docs.where("id IS NOT NULL")
    kept = named.join(rows.where("component_id = id").select("id").distinct(), "id", "left_semi")
    again = named.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").select("id")
    kept = kept.join(again, "id", "left_anti").select("doc").union(kept.join(again, "id", "left_semi").dropDuplicates(["id", "text"]).select("doc"))
    nameless = rows.where("id IS NULL AND component_id IS NULL")
    keys = nameless.where("n > 0").groupBy("c").agg(F.min("key").alias("key")).select("key").union(nameless.where("n = 0").select("key").distinct())
    other = docs.where("id IS NULL").join(keys, F.xxhash64("text") == keys["key"], "left_semi")
    return kept.select("doc").union(other.dropDuplicates(["text"]).select("doc")).select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir))


SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT rid, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
i AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.rid <> b.rid GROUP BY a.rid, b.rid),
e AS (SELECT i.x, i.y FROM i JOIN n p ON p.rid = i.x JOIN n q ON q.rid = i.y WHERE 100 * c >= 80 * (p.n + q.n - c)),
r(x, y) AS (SELECT rid, rid FROM w UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
m AS (SELECT r.x AS rid, min(w.doc_id) AS component_id FROM r JOIN w ON w.rid = r.y GROUP BY r.x)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM w LEFT JOIN n ON n.rid = w.rid JOIN m ON m.rid = w.rid
"""
