"""Indexed matching against trying everything; seed tables and their readers."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from oficina.operators import compatibility, matching, seeds, spec_sheet


@pytest.mark.parametrize("pattern,wanted", [
    ("amd 5700(x|g|ge)?", ["amd 5700"]), ("rtx 4070 (ti|super)", ["rtx 4070 "]), ("intel i5 1[234]600k(f)?", ["intel i5 1", "600k"]), ("intel i9 13900kf?", ["intel i9 13900k"]),
    ("a|b", []), ("(a|b)", []), ("", []), (r"1\.5\d x+y*z", ["1.5", " x", "z"]), ("ab{2}c", ["a", "c"]), ("^abc$", ["abc"]), ("[]x]abc", ["abc"]),
])
def test_literals(pattern, wanted):
    assert matching.literals(pattern) == wanted


def test_every_match_contains_the_literals():
    rng = random.Random(1)
    for _, _, pattern, _ in seeds.WATTS:
        found = matching.literals(pattern)
        assert found and max(map(len, found)) >= matching.GRAM
        some = re.sub(r"\[(.)[^\]]*\]", r"\1", pattern)
        some = re.sub(r"\(([^)|]*)[^)]*\)\??", lambda m: m[1] if rng.random() < 0.5 or not m[0].endswith("?") else "", some)
        assert re.fullmatch(pattern, some) and all(x in some for x in found)


def test_first_pattern_equals_trying_all_in_order(spark):
    rng = random.Random(3)
    words = ["rtx", "gtx", "rx", "amd", "intel", "i5", "4070", "4070ti", "5070", "ti", "super", "xt", "16gb", "9", "5700", "5700x", "x"]
    names = {(rng.choice(["cpu", "gpu"]), " ".join(rng.choices(words, k=rng.randint(1, 6))), " ".join(rng.choices(words, k=2)) if rng.random() < 0.8 else None) for _ in range(300)} | {("gpu", None, "nvidia 4070"), ("gpu", "", None)}
    table = [*seeds.WATTS, ("gpu", "name", "4070|5070", 1), ("gpu", "name", "[0-9]+", 2), ("gpu", "name", "x", 3), ("cpu", "name", "I5", 4), ("cpu", "model", ".*", 5), ("gpu", "model", r"\D+", 6)]
    rng.shuffle(table)

    def plain(category, name, model):
        for target, flags in (("name", rf"\b(?:{{}})\b"), ("model", "^(?:{})$")):
            value = {"name": name, "model": model}[target]
            for c, t, p, w in table:
                if c == category and t == target and value is not None and re.search(flags.format(p), value, re.I):
                    return w
        return None

    df = spark.createDataFrame(list(names), "category string, name string, model string")
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(table)], "pos long, category string, target string, pattern string, watts int")
    found = matching.first_pattern(df.withColumns({"__name": F.col("name"), "__model": F.col("model")}), rows)
    got = {(r.category, r.name, r.model): r.watts for r in found.collect()}
    assert got == {n: plain(*n) for n in names if plain(*n) is not None}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_plan_does_not_grow_with_the_table(spark):
    names = spark.createDataFrame([("gpu", "rtx 4070", "nvidia 4070")], "category string, name string, model string").withColumns({"__name": F.col("name"), "__model": F.col("model")})
    sizes = []
    for n in (10, 20_000):
        table = spark.createDataFrame([(i, "gpu", "name", f"rtx {i + 4000}", i) for i in range(n)], "pos long, category string, target string, pattern string, watts int")
        found = matching.first_pattern(names, table)
        sizes.append(len(re.findall(r"\n", found._jdf.queryExecution().optimizedPlan().toString())))
        assert [r.watts for r in found.collect()] == ([] if n == 10 else [70])
    assert sizes[0] == sizes[1]


def test_labels_equal_trying_all(spark):
    rng = random.Random(5)
    words = ["memoria", "tipo", "de", "clock", "base", "interface", "gpu", "tdp", "max", "a", "rgb"]
    label = lambda: " ".join(rng.choices(words, k=rng.randint(1, 4)))
    table = sorted({(rng.choice("xy"), label()) for _ in range(60)} | {("x", "a"), ("y", "de")})
    labels = {(rng.choice("xyz"), label() + rng.choice(["", "s", " (extra)", " com um resto bem longo"])) for _ in range(200)} | {("x", "")}

    def plain(category, text_):
        best = None
        for c, rule in table:
            if c != category or rule not in text_:
                continue
            at = text_.index(rule)
            if text_ != rule and len((text_[:at] + text_[at + len(rule) :]).strip(" ")) > 12:
                continue
            key = (text_ != rule, -len(rule), rule)
            best = min(best, key) if best else key
        return best[2] if best else None

    found = matching.longest_label(spark.createDataFrame(list(labels), "category string, label string"), spark.createDataFrame([(c, r, r) for c, r in table], "category string, rule string, key string"), 12)
    assert {(r.category, r.label): r.key for r in found.collect()} == {x: plain(*x) for x in labels if plain(*x)}
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_sheet_of_every_category(spark):
    pairs = [(c, i, rule) for i, (c, rule, _, kind) in enumerate(spec_sheet.LABELS) if kind != "skip"]
    df = spark.createDataFrame([(i, 0, c, rule.title(), "x") for c, i, rule in pairs], "page_id int, pos int, category string, label string, value string")
    got = {r.page_id: r.rule_kind for r in spec_sheet.matched(df, spec_sheet.rules(spark)).withColumnRenamed("kind", "rule_kind").collect()}
    assert got == {i: spec_sheet.LABELS[i][3] for _, i, _ in pairs}


def test_seeds_are_read_and_refused(spark, tmp_path):
    def write(name, doc):
        (tmp_path / name).write_text(doc if isinstance(doc, str) else json.dumps(doc, indent=1))
        return str(tmp_path / name)

    entries = [{"category": c, "target": t, "pattern": p, "watts": w} for c, t, p, w in seeds.WATTS]
    read = seeds.read_watts(spark, write("a.json", {"$comment": "x", "entries": entries}))
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, seeds.watts(spark).collect())) and read.count() == 138
    for bad in ({"category": "psu"}, {"target": "title"}, {"pattern": None}, {"watts": None}):
        with pytest.raises(ValueError, match="not a consumption seed"):
            seeds.read_watts(spark, write("b.json", {"entries": [entries[0], entries[1] | bad]}))
    for broken in ("no json", "{}", '{"entries": 3}'):
        with pytest.raises(ValueError, match="no list of entries"):
            seeds.read_watts(spark, write("c.json", broken))
    chips = {}
    for name, socket, generation, bios in seeds.CHIPSETS:
        chips.setdefault((name, socket), []).append({"id": generation, "bios": bios})
    doc = {"chipsets": [{"name": n, "socket": s, "generations": g} for (n, s), g in chips.items()]}
    assert sorted(map(repr, seeds.read_chipsets(spark, write("d.json", doc)).collect())) == sorted(map(repr, seeds.chipsets(spark).collect())) and len(chips) == 22
    doc["chipsets"][3]["name"] = ""
    with pytest.raises(ValueError, match="not a chipset seed"):
        seeds.read_chipsets(spark, write("e.json", doc))


def test_watts_of_parts(spark):
    parts = [(1, "gpu", None, "Placa de Vídeo RTX 4070 Ti SUPER 16GB"), (2, "gpu", "nvidia 4070", "4070"), (3, "cpu", "amd 5700x3d", None), (4, "memory", None, "RTX 4070"), (5, "cpu", "AMD 5700G", "x"), (5, "cpu", "AMD 5700G", "x")]
    df = spark.createDataFrame(parts, "product_id int, category string, model string, name string")
    got = sorted((r.product_id, r.seed_w and int(r.seed_w)) for r in compatibility.seeded(df).collect())
    assert got == [(1, 285), (2, 200), (3, 105), (4, None), (5, 65), (5, 65)]


def test_pages_are_read_into_lines_once_and_pairs_never_go_through_the_driver(spark):
    """The plan of mapped sheets starts from stored pairs; the table of labels is what every task gets."""
    pairs = spark.range(200).selectExpr("id AS page_id", "0 AS pos", "'gpu' AS category", "concat('Comprimento', '') AS label", "concat(300 + id % 9, ' mm') AS value").where(F.col("value").rlike("^3"))
    out = spec_sheet.mapped(pairs, spec_sheet.rules(spark))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range") == 0 and "rlike" not in plan.lower().split("join inner")[-1] and "rightHint=(strategy=broadcast)" in plan
    assert {(r.page_id, r.key, r.value) for r in out.collect()} == {(i, "length_mm", str(300 + i % 9)) for i in range(200)}
