"""Benchmark decontamination by pigeonhole edit matching.

Texts and benchmark items are normalised (A-Z lower-cased, runs of other ASCII
characters than letters and digits become one blank). An item of m characters may
stand in a text with up to k = m * ``rate`` edits. It is cut into k + 1 pieces: if
it stands there, one piece stands there unchanged. An automaton of all pieces finds
those in one pass over the text; around each hit Myers' bit-parallel algorithm
gives the smallest edit distance of the item to any stretch of the window.

The benchmark is taken in blocks of at most ``BLOCK_CHARS`` characters, so what a
task holds is bounded however large the benchmark is; each block is one pass.

An occurrence is a run of neighbouring ends in the text at which the item's distance to a
stretch ending there is at most k; it is reported once, at the first of its nearest
ends, with the shortest stretch of that distance. The windows around hits are joined
where they touch, so these runs are those of the whole text.

Edge cases: null and empty texts have no hit, texts of any length are searched; items
without a word character have nothing to find; items shorter than ``words_below``
characters must stand as whole words without an edit, so that a word inside a word is no hit (0: every item has
the edits that ``rate`` gives; ``least`` leaves out items shorter than it; by default none is); equal items with different ids are all
reported, a repeated (id, text) row of the benchmark counts once; repeated rows are matched one
by one, with null ids too; an empty benchmark or table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import documents, fresh, plain_words, short_batches, stored

RATE = 0.08
#: Default of ``words_below``: shorter items are matched as whole words, without edits.
WORDS_BELOW = 24
BLOCK_CHARS = 4_000_000


def normal(text: str | None) -> str:
    return b" ".join(plain_words(text)).decode("utf-8", "replace")


def budget(item: str, rate: float, words_below: int = WORDS_BELOW) -> int:
    return int(len(item) * rate) if len(item) >= words_below else 0


def cut(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length with their offsets."""
    m, n = len(item), k + 1
    ends = [m * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(ends, ends[1:]) if b > a]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def steps(peq: dict[str, int], m: int, text, anchored: bool = False) -> Iterator[int]:
    """Myers: the pattern's distance at each end in the text, to any stretch or (anchored) to all before the end."""
    full, top, carry = (1 << m) - 1, 1 << (m - 1), int(anchored)
    pv, mv, score = full, 0, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | carry) & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        yield score


def nearest(peq: dict[str, int], m: int, window: str) -> tuple[int, int]:
    """(smallest distance of the pattern to a stretch of the window, the first end with it)."""
    best, end = m, 0
    for e, d in enumerate(steps(peq, m, window), 1):
        if d < best:
            best, end = d, e
    return best, end


def runs(peq: dict[str, int], m: int, k: int, window: str) -> list[tuple[int, int]]:
    """(smallest distance, first end with it) of each run of ends within k edits."""
    out: list[tuple[int, int]] = []
    inside = False
    for end, d in enumerate(steps(peq, m, window), 1):
        if d > k:
            inside = False
        elif not inside or d < out[-1][0]:
            out[len(out) - inside :] = [(d, end)]
            inside = True
    return out


def start_of(back: dict[str, int], m: int, text: str, end: int, d: int) -> int:
    """Start of the shortest stretch up to ``end`` at distance d; ``back`` are the reversed pattern's masks."""
    if d == 0:
        return end - m
    before = reversed(text[max(0, end - m - d) : end])
    return end - next(n for n, x in enumerate(steps(back, m, before, anchored=True), 1) if x == d)


class Matcher:
    def __init__(self, items: list[tuple[object, str]], rate: float, words_below: int = WORDS_BELOW):
        import ahocorasick

        self.words_below = words_below
        self.items = [(i, t, budget(t, rate, words_below), masks(t), masks(t[::-1])) for i, t in items]
        at: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k, _, _) in enumerate(self.items):
            for offset, piece in cut(t, k):
                at.setdefault(piece, []).append((n, offset))
        self.pieces = ahocorasick.Automaton()
        for piece, places in at.items():
            self.pieces.add_word(piece, (len(piece), places))
        self.pieces.make_automaton()

    def find(self, text: str) -> list[tuple[object, int, int, int]]:
        """(item id, start, end, distance) in the normalised text."""
        starts: dict[int, list[int]] = {}
        for end, (size, places) in self.pieces.iter(text):
            for n, offset in places:
                starts.setdefault(n, []).append(end + 1 - size - offset)
        out = []
        for n, found in starts.items():
            key, item, k, peq, back = self.items[n]
            m = len(item)
            if m < self.words_below:
                out += [(key, a, a + m, 0) for a in found if text[max(0, a - 1) : a].strip() + text[a + m : a + m + 1].strip() == ""]
                continue
            found.sort()
            i = 0
            while i < len(found):
                low, high = max(0, found[i] - k), found[i] + m + k
                while i < len(found) and found[i] - k <= high:
                    high = found[i] + m + k
                    i += 1
                for d, end in runs(peq, m, k, text[low : max(0, high)]):
                    out.append((key, start_of(back, m, text, low + end, d), low + end, d))
        return out


_BUILT: dict[str, Matcher] = {}


def _matcher(shared, key: str, rate: float, words_below: int) -> Matcher:
    """One matcher for each worker process, of the block last asked for."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Matcher(shared.value, rate, words_below)
    return _BUILT[key]


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int = BLOCK_CHARS, least: int = 1) -> Iterator[list[tuple[object, str]]]:
    """Normalised items in lists of about ``block_chars`` characters."""
    rows = benchmark.where(F.col(text_col).isNotNull()).select(item_col, text_col).distinct()
    total = rows.agg(F.sum(F.length(text_col) + 16)).first()[0] or 0
    n = 1 + total // block_chars
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64(item_col, text_col), F.lit(n)) == b)
        items = [(r[0], normal(r[1])) for r in part.collect()]
        items = sorted(((i, t) for i, t in items if len(t) >= max(1, least)), key=lambda x: (x[1], str(x[0])))
        if items:
            yield items


def matches(df: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str = "item_id", item_text: str = "text", rate: float = RATE, least: int = 1, block_chars: int = BLOCK_CHARS, words_below: int = WORDS_BELOW) -> DataFrame:
    """(id, item_id, start, end, distance): every place where an item stands, within its edit budget.

    One block is matched when the result is read. Of several, each is matched, written to the shared folder
    and given up before the next, so neither the driver nor a task holds more than one.
    """
    spark = df.sparkSession
    short_batches(spark)
    fields = [(id_col, df.schema[id_col].dataType), ("item_id", benchmark.schema[item_col].dataType)]
    schema = ", ".join(f"`{n}` {t.simpleString()}" for n, t in fields) + ", start long, end long, distance int"
    names, kinds = [id_col, "item_id", "start", "end", "distance"], [*(to_arrow_type(t) for _, t in fields), pa.int64(), pa.int64(), pa.int32()]
    rows = df.where(F.length(text_col) > 0).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def found_in(held):
        key = uuid.uuid4().hex

        def work(batches):
            m = _matcher(held, key, rate, words_below)
            for b in batches:
                hits = [(i, *hit) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for hit in m.find(normal(t))]
                columns = list(zip(*hits)) if hits else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        return rows.mapInArrow(work, schema)

    out, held = None, None
    for items in blocks(benchmark, item_col, item_text, block_chars, least):
        if held is not None:
            part = stored(found_in(held), "matches")
            out = part if out is None else out.unionByName(part)
            held.destroy()
        held = spark.sparkContext.broadcast(items)
    if held is not None:
        part = found_in(held)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def clean(df: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, rate: float = RATE, least: int = 1, words_below: int = WORDS_BELOW) -> DataFrame:
    """The rows of ``df`` in whose text no benchmark item stands; judged by the text's hash, so ids may be null or repeat."""
    key = fresh("__key", df.columns)
    hit = matches(df.select(F.xxhash64(text_col).alias(key), text_col), benchmark, key, text_col, rate=rate, least=least, words_below=words_below).select(key).distinct()
    return df.join(hit, F.xxhash64(text_col) == F.col(key), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "doc_id", "text")
