"""Name search through trigrams: a posting table narrows a pattern before it is tried.

A query is a pattern as of ``%query%`` with its wildcards. They split it into runs of characters that every hit contains. Each trigram
of these runs is looked up in the posting table (gram, product_id), which is written once for a catalog, in order of
grams; a name is tried only if it has all of them. Queries whose runs are all shorter than three characters have no
trigram: for them every name is tried, which is the exact way.

Defined results: upper and lower case are one; ``%`` stands for any run, ``_`` for one character, a backslash before one of them for
itself. A null name is never found; an empty query finds every name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

N = 3


def postings(products: DataFrame) -> DataFrame:
    """(gram, product_id): every trigram of every lower-cased name, in ranges of grams, so that a look-up reads few files."""
    name = F.lower("name")
    grams = F.when(F.length(name) >= N, F.transform(F.sequence(F.lit(1), F.length(name) - (N - 1)), lambda i: F.substring(name, i, F.lit(N))))
    rows = products.select("product_id", F.explode(F.array_distinct(grams)).alias("gram"))
    return rows.select("gram", "product_id").repartitionByRange("gram", "product_id").sortWithinPartitions("gram", "product_id")


def runs(query: str) -> list[str]:
    """The runs of characters between a query's wildcards, in lower case."""
    out, run, i = [], "", 0
    while i < len(query):
        c = query[i]
        if c == "\\" and query[i + 1 : i + 2] in ("%", "_", "\\"):
            run += query[i + 1]
            i += 2
            continue
        if c in "%_":
            out.append(run)
            run = ""
        else:
            run += c
        i += 1
    return [r.lower() for r in [*out, run] if r]


def trigrams(query: str) -> list[str]:
    return sorted({r[i : i + N] for r in runs(query) for i in range(len(r) - N + 1)})


def named(products: DataFrame, index: DataFrame, query: str) -> DataFrame:
    """The products whose name contains the query."""
    wanted = trigrams(query)
    if wanted:
        have = index.where(F.col("gram").isin(wanted)).groupBy("product_id").agg(F.count("*").alias("__n")).where(F.col("__n") == len(wanted))
        products = products.join(have, "product_id", "left_semi")
    return products.where(F.col("name").ilike(f"%{query}%"))
