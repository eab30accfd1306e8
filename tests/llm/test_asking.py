"""Queries ask the other groups by the tokens in which they meet, and lose no link by it."""

import random

import numpy as np
from pyspark.sql import functions as F

from oficina.llm import jaccard


def test_a_query_does_not_repeat_its_tokens_for_every_group(spark):
    # 30 groups of two, all with token 0 first, and 20 tokens of each member's own.
    cells = spark.createDataFrame([(2 * g + m, 100, g, False, [0, *range(1000 * (2 * g + m) + 1, 1000 * (2 * g + m) + 21)]) for g in range(30) for m in (0, 1)], "cls long, n int, g long, single boolean, tokens array<long>")
    ask = spark.createDataFrame([(q, g) for g in range(30) for q in range(g)], "q long, g long")
    assert jaccard._asking(cells, ask, 80).count() == 2 * 30 * 29 // 2


def test_members_that_link_are_asked(spark):
    rng = random.Random(5)
    pool = range(400)
    sets, rows = {}, []
    for g in range(12):
        base = rng.sample(pool, rng.choice([10, 30]))
        for m in range(3):
            s = set(base) - set(rng.sample(base, rng.randrange(0, 4)))
            s = sorted(s | set(rng.sample(pool, rng.randrange(0, 3))))
            cls = 3 * g + m
            sets[cls] = np.array(s)
            rows.append((cls, len(s), g % 12, False, [int(x) for x in s[: len(s) - jaccard.need(len(s), 80) + 1]]))
    # Groups are mixed up, so that links stand between them.
    rows = [(cls, n, (cls * 5) % 12, single, tokens) for cls, n, _, single, tokens in rows]
    group = {r[0]: r[2] for r in rows}
    cells = spark.createDataFrame(rows, "cls long, n int, g long, single boolean, tokens array<long>")
    ask = spark.createDataFrame([(q, g) for q in range(12) for g in range(12) if q != g], "q long, g long")
    got = {(r.a, r.g) for r in jaccard._asking(cells, ask, 80).select("a", "g").where(F.lit(True)).collect()}
    want = {(a, group[b]) for a in sets for b in sets if group[a] != group[b] and jaccard.linked(sets[a], sets[b], 80)}
    assert want and want <= got
