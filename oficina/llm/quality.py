"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Every rule is a condition over measures of a text. On a sample of at most about
``sample_rows`` rows each rule is run alone: its share of rejected rows and the seconds
that it takes beyond reading the sample are its selectivity and its cost. The rules are
ordered by rejection per cost, and the verdict is one CASE expression in that order.

A measure that is not among the ``counts`` to be returned stands inside the CASE and is
only computed for rows that all rules before it let pass. A measure that is returned has to be
computed for every row, so a rule over such measures alone costs next to nothing and comes
early. With ``counts=()`` every measure is computed late. The order changes the work and which
rule is named, never the verdict.

Edge cases: a null text counts as empty and fails ``few_words``; ties in the order go by
rule name; an empty table gives an empty result and rules by name; repeated rows, rows with a
null id and very long texts are judged one by one and whole; other columns do not matter.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_share, stored

SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: A rule that takes less than ``BRIEF`` seconds on the sample is timed again on ``AGAIN`` copies of it.
BRIEF, AGAIN = 0.05, 16
_BLANKS = "\t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets a function that gives a measure's column or expression by name."""

    name: str
    rejects: Callable[[Callable[[str], Column]], Column]


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` as an array."""
    return F.array_remove(F.split(F.translate(text, _BLANKS, " " * len(_BLANKS)), " ", -1), "")


def lines_of(text: Column) -> Column:
    """\\n-split lines that have a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, _BLANKS + " ", "")) > 0)


def count_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def repeat_words(words: Column, width: int = 8) -> Column:
    """Words in windows of 8 words that the text has twice or more.

    Window hashes come from halves: 2 words, 4 words, 8 words. Only where the window
    hashes aren't all distinct a sort finds the places.
    """
    assert width == 8
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    joined = lambda h, gap: F.zip_with(F.slice(h, F.lit(1), F.size(h) - gap), F.slice(h, F.lit(1 + gap), F.size(h) - gap), lambda a, b: F.xxhash64(a, b))
    windows = let(let(let(hashes, lambda h: joined(h, 1)), lambda h: joined(h, 2)), lambda h: joined(h, 4))

    def places(h: Column) -> Column:
        at = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        both = lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))
        return let(at, lambda s: F.array_sort(F.array_distinct(F.flatten(F.zip_with(F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1), both)))))

    def covered(p: Column) -> Column:
        steps = F.zip_with(F.slice(p, F.lit(2), F.size(p) - 1), F.slice(p, F.lit(1), F.size(p) - 1), lambda a, b: F.least(a - b, F.lit(width)))
        return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x) + width

    found = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), let(places(h), covered)).otherwise(0))
    return F.when(F.size(words) >= width, found).otherwise(0).cast("long")


def measures(text: Column) -> dict[str, Column]:
    """Every measure as an expression over the text."""
    return {
        "n_words": F.size(words_of(text)).cast("long"),
        "word_chars": F.length(F.translate(text, _BLANKS + " ", "")).cast("long"),
        "n_symbols": count_of(text, SYMBOLS),
        "n_lines": F.size(lines_of(text)).cast("long"),
        "n_dup_lines": let(lines_of(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "n_repeat_words": let(words_of(text), repeat_words),
        "n_bangs": count_of(text, "!"),
        "n_upper": count_of(text, _UPPER),
        "n_letters": count_of(text, _UPPER + _UPPER.lower()),
    }


def counted(df: DataFrame, keep: list[str], text_col: str, counts: tuple[str, ...]) -> DataFrame:
    """``keep``, ``__text`` (null as empty) and the measures named in ``counts``."""
    out = df.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    if {"n_words", "n_repeat_words"} & set(counts):  # the words are split once for both
        out = out.withColumn("__words", words_of(F.col("__text")))
    by_name = measures(F.col("__text")) | {"n_words": F.size("__words").cast("long"), "n_repeat_words": repeat_words(F.col("__words"))}
    return out.select(*keep, "__text", *[by_name[c].alias(c) for c in counts])


def standard_rules() -> list[Rule]:
    return [
        Rule("few_words", lambda m: m("n_words") < 20),
        Rule("repeats", lambda m: 100 * m("n_repeat_words") > 30 * m("n_words")),
        Rule("symbols", lambda m: 10 * m("n_symbols") > 3 * m("n_words")),
        Rule("bangs", lambda m: 2 * m("n_bangs") > m("n_words")),
        Rule("capitals", lambda m: (m("n_letters") >= 20) & (10 * m("n_upper") > 6 * m("n_letters"))),
        Rule("same_lines", lambda m: (m("n_dup_lines") > 0) & (2 * m("n_dup_lines") > m("n_lines"))),
        Rule("word_length", lambda m: (m("word_chars") > 12 * m("n_words")) | (m("word_chars") < 2 * m("n_words"))),
    ]


def _timed(sample: DataFrame, rejects: Column, copies: int = 1) -> tuple[float, float]:
    """(share of rejected rows, seconds) of one condition over so many copies of the sample; the better of two runs if they are brief."""
    rows = sample if copies == 1 else sample.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    job = rows.agg(F.avg(rejects.cast("double")).alias("share"))
    took: list[float] = []
    while not took or len(took) < 2 and took[0] < 4 * BRIEF:
        began = time.perf_counter()
        share = job.first()["share"]
        took.append(time.perf_counter() - began)
    return share or 0.0, min(took)


def ordered(sample: DataFrame, rules: list[Rule], measure: Callable[[str], Column]) -> list[tuple[Rule, float, float]]:
    """(rule, rejected share, seconds) by rejection per cost, as the (bounded, stored) sample shows them."""
    idle = {copies: _timed(sample, F.length("__text") < 0, copies)[1] for copies in (1, AGAIN)}
    found = []
    for r in rules:
        rejects = F.coalesce(r.rejects(measure), F.lit(False))
        share, took = _timed(sample, rejects)
        cost = took - idle[1]
        if cost < BRIEF:
            cost = (_timed(sample, rejects, AGAIN)[1] - idle[AGAIN]) / AGAIN
        found.append((r, share, max(cost, 1e-5)))
    return sorted(found, key=lambda x: (-x[1] / x[2], x[0].name))


def first_failure(rules: list[Rule], measure: Callable[[str], Column]) -> Column:
    """Name of the first rule in order that rejects the row, null if none does."""
    out = F.when(rules[0].rejects(measure), F.lit(rules[0].name))
    for r in rules[1:]:
        out = out.when(r.rejects(measure), F.lit(r.name))
    return out


def judge(df: DataFrame, keep: list[str], text_col: str, counts: tuple[str, ...] = COUNTS, rules: list[Rule] | None = None, sample_rows: int = 1_000) -> DataFrame:
    """``keep``, the measures in ``counts``, failed_rule and kept for every row."""
    rules = standard_rules() if rules is None else rules
    late = {k: v for k, v in measures(F.col("__text")).items() if k not in counts}
    measure = lambda name: late[name] if name in late else F.col(name)
    sample = bounded_share(df.select(*dict.fromkeys([keep[0], text_col])), sample_rows, *dict.fromkeys([keep[0], text_col]))
    sample = stored(counted(sample, [], text_col, counts).coalesce(1), "sample")
    order = [r for r, _, _ in ordered(sample, rules, measure)]
    out = counted(df, keep, text_col, counts).withColumn("failed_rule", first_failure(order, measure))
    return out.withColumn("kept", F.col("failed_rule").isNull()).drop("__text")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = judge(docs, ["doc_id"], "text")
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.select("doc_id", *COUNTS, base_failed.alias("base_failed"), "kept")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
u AS (SELECT rid, unnest(words) AS word, unnest(range(len(words))) AS i FROM w),
g AS (SELECT rid, i, string_agg(word, ' ') OVER q AS win, count(*) OVER q AS k FROM u
      WINDOW q AS (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM g WHERE k = 8),
p AS (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM r WHERE c >= 2),
rep AS (SELECT rid, sum(CASE WHEN nx IS NULL THEN 8 ELSE least(8, nx - i) END) AS n FROM p GROUP BY rid),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) AS BIGINT) AS n_lines,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        length(text) - length(replace(text, '!', '')) AS n_bangs,
        length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
        length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS n_letters,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN rep ON rep.rid = w.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > 3 * n_words
       OR 2 * n_bangs > n_words OR (n_letters >= 20 AND 10 * n_upper > 6 * n_letters)
       OR 2 * n_dup_lines > n_lines OR word_chars > 12 * n_words OR word_chars < 2 * n_words) AS kept
FROM m
"""
