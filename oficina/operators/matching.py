"""Tables of patterns and of labels met through an index: equi-joins that leave a few candidates, then the exact test.

A pattern is a regular expression that stands for many names. Every text that it matches contains its literals, so
each pattern is filed under one short run of characters (a gram) of them, the one that the fewest patterns share; a text meets the
patterns filed under its own grams, and only these are tried. Patterns without a literal are filed under the empty gram, which every text has.

A label that lies inside another text shares all its words but the first and last, which may be part of a
longer word; so labels are filed by gram as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Length of the grams; shorter literals are filed under all of themselves.
GRAM = 3


def literals(pattern: str) -> list[str]:
    """Runs of characters that every match of a regular expression contains.

    Groups, classes, alternatives and what a quantifier makes optional end a run and give nothing.
    """
    runs, run, i, depth = [], "", 0, 0

    def end() -> None:
        nonlocal run
        if run:
            runs.append(run)
        run = ""

    while i < len(pattern):
        c = pattern[i]
        if c == "|" and depth == 0:
            return []
        if c == "\\":
            # An escaped sign stands for itself, an escaped letter for a class or a place.
            literal, i = (pattern[i + 1 : i + 2], i + 2)
            c = literal if literal and not literal.isalnum() else ""
        elif c == "[":
            i = pattern.index("]", i + 2) + 1
            c = ""
        else:
            i += 1
            if c in "()":
                depth += 1 if c == "(" else -1
                end()
                continue
            if c in "^$.*+?{}":
                if c == "{":
                    i = pattern.index("}", i) + 1
                end()
                continue
        if depth:
            continue
        after = pattern[i : i + 1]
        if not c or after in ("?", "*", "{"):
            end()
        else:
            run += c
    end()
    return runs


def _grams(text: Column) -> Column:
    """All runs of 0 to GRAM characters of a text, each once."""
    one = lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))
    found = [F.when(F.length(text) >= n, one(n)).otherwise(F.array().cast("array<string>")) for n in range(1, GRAM + 1)]
    return F.array_distinct(F.concat(F.array(F.lit("")), *found))


def filed(table: DataFrame, required: Column, keys: list[str]) -> DataFrame:
    """Adds ``gram`` to a table: of the grams of ``required`` (an array of literals) the one that the fewest rows share.

    Equal rows become one.
    """
    runs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - GRAM + 1), lambda i: F.substring(r, i, F.lit(GRAM)))
    whole = F.filter(F.flatten(F.transform(required, lambda r: F.when(F.length(r) < GRAM, F.array(F.lower(r))).otherwise(runs(F.lower(r))))), lambda g: g != "")
    longest = F.array_max(F.transform(whole, lambda g: F.length(g)))
    grams = F.array_distinct(F.filter(whole, lambda g: F.length(g) == longest))
    each = table.withColumn("gram", F.explode(F.when(F.size(grams) > 0, grams).otherwise(F.array(F.lit("")))))
    shared = each.withColumn("__n", F.count("*").over(Window.partitionBy(*keys, "gram")))
    return shared.groupBy(*table.columns).agg(F.min_by("gram", F.struct("__n", "gram")).alias("gram"))


def candidates(texts: DataFrame, text_col: str, table: DataFrame, keys: list[str]) -> DataFrame:
    """``texts`` joined with the rows of a ``filed`` table whose gram they contain, by ``keys`` and gram.

    Only grams that the table files are taken from the texts, so the join carries a few rows for each text.
    """
    used = table.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("gram").alias("__gram")).distinct()
    each = texts.withColumn("__g", F.explode(_grams(F.col(text_col))))
    same = F.col("__g") == F.col("__gram")
    for k in keys:
        same = same & (F.col(k) == F.col(f"__k_{k}"))
    each = each.join(used, same, "left_semi")
    filed_under = table.withColumnsRenamed({k: f"__k_{k}" for k in keys} | {"gram": "__gram"})
    return each.join(filed_under, same).drop("__g", "__gram", *[f"__k_{k}" for k in keys])


def first_pattern(names: DataFrame, table: DataFrame) -> DataFrame:
    """(category, name, model, watts): of the patterns that fit a name or a model the first, those for names before those for models.

    ``names`` has distinct (category, name, model), ``table`` (pos, category, target, pattern, watts). A pattern for names stands
    between word bounds of the normalised name, one for models is the whole model.
    """
    required = F.udf(literals, "array<string>", useArrow=False)(F.col("pattern"))
    index = filed(table.withColumn("__required", required), F.col("__required"), ["category", "target"]).drop("__required")
    both = F.array(F.struct(F.lit("name").alias("target"), F.col("__name").alias("text")), F.struct(F.lit("model").alias("target"), F.col("__model").alias("text")))
    texts = names.select("category", "name", "model", F.explode(both).alias("x")).select("category", "name", "model", "x.target", F.lower("x.text").alias("text")).where("text IS NOT NULL")
    tried = candidates(texts, "text", index, ["category", "target"])
    whole = F.when(F.col("target") == "name", F.concat(F.lit(r"(?i)\b(?:"), F.col("pattern"), F.lit(r")\b"))).otherwise(F.concat(F.lit("(?i)^(?:"), F.col("pattern"), F.lit(")$")))
    hits = tried.where(F.rlike(F.col("text"), whole))
    return hits.groupBy("category", "name", "model").agg(F.min_by("watts", F.struct(F.when(F.col("target") == "name", 0).otherwise(1), "pos")).alias("watts"))


def longest_label(labels: DataFrame, table: DataFrame, left_over: int) -> DataFrame:
    """(category, label, and the table's other columns): the rule equal to a label, else the longest one inside it that leaves few characters.

    ``labels`` has distinct (category, label), both normalised; ``table`` (category, rule, ...). Of rules of one length the first by
    name counts.
    """
    rest = [c for c in table.columns if c not in ("category", "rule")]
    index = filed(table.where("rule <> ''"), F.array("rule"), ["category"])
    tried = candidates(labels.select("category", "label"), "label", index, ["category"])
    at = F.instr(F.col("label"), F.col("rule"))
    outside = F.length(F.trim(F.concat(F.substring(F.col("label"), F.lit(1), at - 1), F.substring(F.col("label"), at + F.length("rule"), F.length("label")))))
    equal = F.col("label") == F.col("rule")
    fits = tried.where(equal | (F.contains("label", "rule") & (outside <= left_over)))
    best = fits.groupBy("category", "label").agg(F.min_by(F.struct(*rest), F.struct(F.when(equal, 0).otherwise(1), -F.length("rule"), "rule")).alias("r"))
    return best.select("category", "label", "r.*")
