"""Each method against a plain version of itself, and the pipeline's stages on odd rows."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from oficina.llm import common, decontaminate, jaccard, langid, licenses, pieces, pii, quality, queries, token_counts, toxicity, url_filter
from test_edges import components
from tests_plain import SF


# --- samples


@pytest.mark.parametrize("rows", [2_000, 10**6, 10**9, 10**10, 10**11, 10**13])
@pytest.mark.parametrize("most", [1_000, 2_000, 16_000])
def test_a_sample_is_never_empty_because_of_the_size(rows, most):
    share = (common.share_bound(rows, most) + 2**63) / 2**64
    assert share * rows == pytest.approx(min(rows, most), rel=1e-3)


def test_copies_and_null_ids_do_not_flood_a_sample(spark):
    df = spark.range(4_000).select(F.when(F.col("id") > 2_000, F.col("id")).alias("id"), F.when(F.col("id") <= 1_000, "copy").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    n = common.bounded_share(df, 500, "id", "text").count()
    assert 200 < n < 700
    assert common.bounded_share(df, 10_000, "id", "text").count() == 3_000


# --- edit matching


def rows_of(pattern, text, anchored=False):
    row = [j if anchored else 0 for j in range(len(text) + 1)]
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return row


def occurrences(items, text, rate):
    """All runs of ends within the budget, by the whole table; the start by trying all stretches."""
    out = []
    for key, p in items:
        k = decontaminate.budget(p, rate)
        row = rows_of(p, text)
        for near, run in itertools.groupby(range(1, len(text) + 1), key=lambda e: row[e] <= k):
            if near:
                e = min(run, key=lambda e: row[e])
                out.append((key, next(s for s in range(e, -1, -1) if rows_of(p, text[s:e], True)[-1] == row[e]), e, row[e]))
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_places_equal_the_whole_table(seed):
    rng = random.Random(seed)
    for _ in range(25):
        word = lambda n: "".join(rng.choice(letters) for _ in range(n))
        letters = rng.choice(["ab ", "abcdefgh ", "ab"])
        items = [(i, word(rng.randint(24, 60))) for i in range(3)] + [(9, "ab" * 20)]
        text = word(rng.randint(0, 60))
        for _ in range(rng.randint(0, 4)):
            x = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, 4)):
                x[rng.randrange(len(x))] = rng.choice(["", "z", "qq"])
            text += "".join(x) + word(rng.choice([0, 0, 3, 30]))
        assert sorted(decontaminate.Matcher(items, 0.08).find(text)) == occurrences(items, text, 0.08)


def test_short_texts_short_items_and_blocks(spark):
    item = "the quick brown foxes jump"  # 26 characters, two edits
    docs = spark.createDataFrame([(None, item[:10] + item[12:]), (2, "a yes b"), (3, "eyes"), (4, None), (5, ""), (6, f"{item} {item}")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (1, item), (2, "Yes!"), (3, None), (4, "..."), (5, "no such item in any of the texts")], "item_id long, text string")
    want = [(None, 1, 0, 24, 2), (2, 2, 2, 5, 0), (6, 1, 0, 26, 0), (6, 1, 27, 53, 0)]
    for block in (4_000_000, 30):
        got = decontaminate.matches(docs, bench, "doc_id", "text", block_chars=block).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)), block
    assert {r.doc_id for r in decontaminate.clean(docs, bench, "doc_id", "text").collect()} == {3, 4, 5}
    assert {r.doc_id for r in decontaminate.clean(docs, bench, "doc_id", "text", least=24).collect()} == {2, 3, 4, 5}


def test_op3_query_equals_brute_force(spark):
    items = [(r.item_id, decontaminate.normal(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = {r.doc_id: decontaminate.normal(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 600").collect()}
    got = sorted(tuple(r) for r in queries.queries()["op3_decontamination"](spark, SF).collect() if r.doc_id in docs)
    near = [i for i in items[:6]]
    assert [r for r in got if r[1] in {i for i, _ in near}] == sorted((d, *hit) for d, t in docs.items() for hit in occurrences(near, t, decontaminate.RATE))


# --- pieces


def test_shortest_path_equals_viterbi_where_weights_decide():
    rng = random.Random(4)
    for _ in range(30):
        words = {"".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(12)} | {pieces.MARK, pieces.MARK + "a"}
        vocab = [(w, -rng.random() * 9, "normal") for w in sorted(words)] + [(f"<0x{b:02X}>", 0.0, "byte") for b in range(256)]
        t = pieces.Transducer(vocab, merges=False)
        cost = {w: -s for w, s, k in vocab if k == "normal"}
        for _ in range(20):
            text = "".join(rng.choices("abcd é", k=rng.randint(0, 14)))
            s = pieces.MARK + text.replace(" ", pieces.MARK) if text else ""
            best = [0.0] + [math.inf] * len(s)
            for e in range(1, len(s) + 1):
                for b in range(e):
                    p = s[b:e]
                    w = cost.get(p, t.byte_weight * len(p.encode()) if len(p) == 1 else math.inf)
                    best[e] = min(best[e], best[b] + w)
            ids = t.encode(text)
            total = sum(-vocab[i][1] if vocab[i][2] == "normal" else t.byte_weight for i in ids)
            assert total == pytest.approx(best[-1]) and t.decode(ids) == text


def test_op4_query_equals_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.queries()["op4_sentencepiece"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.ids == sp.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) and r.lossless == (sp.decode(r.ids) == texts[r.doc_id])
        assert r.n_byte_tokens == sum(sp.is_byte(i) for i in r.ids)


def test_op6_query_equals_greedy_splitting(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=token_counts.MODEL)
    vocab = {sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    longest, seen = max(map(len, vocab)), {}

    def greedy(word):
        if word not in seen:
            n, at, rest = 0, 0, "▁" + word
            while at < len(rest):
                end = next((e for e in range(min(len(rest), at + longest), at, -1) if rest[at:e] in vocab), None)
                n, at = (n + 1, end) if end else (n + len(rest[at].encode()), at + 1)
            seen[word] = n
        return seen[word]

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.queries()["op6_token_counts"](spark, SF).collect():
        words = [w.decode() for w in texts[r.doc_id].encode().split()]
        assert (r.n_words, r.n_tokens) == (len(words), sum(map(greedy, words)))


# --- near duplicates


def test_one_group_and_many_texts_beside_it(spark):
    """A chain of near copies, texts that share much with it and link with none, and a line that all of them have."""
    rng = random.Random(5)
    core = [f"c{i}" for i in range(100)]
    line = " ".join(f"l{i}" for i in range(40))
    docs = []
    for i in range(120):  # a word or two apart: one group
        w = list(core)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    for i in range(200, 260):  # six words apart: near the group, not in it
        w = list(core)
        for k in rng.sample(range(0, 100, 6), 6):
            w[k] = f"y{rng.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    docs += [(1000 + i, f"{line} {' '.join(f'u{i}_{k}' for k in range(10))}") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df).collect()}
    assert got == components(docs)


def test_a_line_that_all_texts_have_meets_nothing(spark, monkeypatch):
    """Rows that meet are counted: a third of unlinked texts with one long common line may not pair up."""
    line = " ".join(f"l{i}" for i in range(40))
    docs = [(i, f"{line} {' '.join(f'u{i}_{k}' for k in range(10))}") for i in range(400)]
    seen = {}
    real = jaccard.stored
    monkeypatch.setattr(jaccard, "stored", lambda df, name: seen.setdefault(name, real(df, name)))
    out = jaccard.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len({r.component_id for r in out}) == 400
    assert seen["opened"].count() == 0 and seen["centres"].count() <= 3_200


# --- quality


def verdicts(df, **kw):
    return sorted(map(tuple, quality.judge(df, ["doc_id"], "text", **kw).select("doc_id", "kept").collect()))


def test_verdicts_do_not_depend_on_order_or_on_what_is_returned(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame([(None, None)], "doc_id long, text string"), allowMissingColumns=True)
    rules = quality.standard_rules()
    want = sorted(map(repr, quality.judge(df, ["doc_id"], "text").select("doc_id", "kept").collect()))
    assert want == sorted(map(repr, quality.judge(df, ["doc_id"], "text", counts=(), rules=rules[::-1]).select("doc_id", "kept").collect()))


def test_cost_and_selectivity_are_measured(spark):
    rules = [
        quality.Rule("a_dear", lambda m: m("n_repeat_words") >= 0),
        quality.Rule("b_cheap", lambda m: m("n_bangs") >= 0),
        quality.Rule("c_never", lambda m: m("n_bangs") < 0),
    ]
    sample = common.stored(spark.range(400).select(F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.concat(F.lit("w"), i + F.col("id")))).alias("__text")), "sample")
    found = quality.ordered(sample, rules, quality.measures(F.col("__text")).__getitem__)
    assert [r.name for r, _, _ in found] == ["b_cheap", "a_dear", "c_never"]
    assert [share for _, share, _ in found] == [1.0, 1.0, 0.0]
    assert found[1][2] > 3 * found[0][2]


def test_measures_that_are_not_returned_stand_inside_the_case(spark):
    plan = quality.query(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    projects = [part for part in plan.split("Project [") if "translate(__text" in part and ", !, )" in part]
    assert len(projects) == 1 and " AS kept" in projects[0]
    assert projects[0].index("CASE WHEN") < projects[0].index(", !, )") < projects[0].index(" AS kept")


# --- personal data


def test_op1_result_has_terms_and_they_equal_the_sql(spark):
    found = queries.queries()["op1_pii"](spark, "/root/testdata/sf0.01")
    assert found.where("spans LIKE '%term:%'").count() > 20


# --- licenses


def test_whole_notices_with_edits_and_their_kin(spark):
    notice = {label: text for label, text, _ in licenses.NOTICES[::-1]}
    words = notice["lgpl-3"].split()
    edited = " ".join(words[:5] + ["surely"] + words[5:15] + words[16:])
    half = " ".join(notice["isc"].split()[:10])
    docs = [(1, notice["gpl-3"].upper()), (2, f"x {edited} y"), (3, f"{half} and then {half} and {half} {half} {half}"), (4, notice["agpl-3"]), (5, "SPDX-License-Identifier: GPL-2.0-only"), (6, notice["gpl-2"])]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {i: r.labels for i, r in got.items()} == {1: "gpl-3", 2: "lgpl-3", 3: "", 4: "agpl-3", 5: "gpl-2", 6: "gpl-2"}
    assert (got[2].spans[0].first_word, got[1].score) == (1, 1.0) and got[2].score < 1


# --- URLs


def test_a_hot_host_is_dealt_out(spark, monkeypatch):
    """With every node counted as hot the verdicts stay the same."""
    rows = spark.range(600).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.com/"), F.when(F.col("id") % 3 == 0, "en/").otherwise("x/"), (F.col("id") % 7).cast("string"), F.lit("/"), F.col("id").cast("string")).alias("url"))
    judged = lambda: sorted(map(tuple, url_filter.judge(rows, ["page_id"], "url").select("page_id", "verdict", "template", "purity").collect()))
    salted = judged()
    monkeypatch.setattr(url_filter, "HOT_NODES", 0)
    assert judged() == salted


# --- classifiers


def test_op7_scores_equal_a_plain_sum(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs, "text", "lang", "doc_id")
    buckets = model.table.shape[0] - 1
    got = {r.doc_id: r for r in langid.predict(docs, model, "text", ["doc_id"]).collect()}
    fold = lambda b: b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32
    for r in docs.where("length(text) < 1500").collect():
        f = [32, *map(fold, r.text.encode()), 32]
        total, n = np.zeros(len(model.langs)), 0
        for size in (2, 3, 4):
            for a in range(len(f) - size + 1):
                g = f[a : a + size]
                if 32 in g[1:-1] or g == [32, 32]:
                    continue
                code = size
                for b in g:
                    code = (code * 0x01000193 + b) % 2**32
                code ^= code >> 15
                total += model.table[((code * 0x9E3779B1) % 2**32 >> 8) % buckets][:-1]
                n += 1
        z = (total / max(1, n) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        x = got[r.doc_id]
        if any(c.isalpha() for c in r.text):
            assert x.score == pytest.approx(p.max(), abs=1e-4) and (x.lang_pred == model.langs[int(p.argmax())] or p.max() - np.sort(p)[-2] < 1e-4)
            assert x.accepted == (x.score >= model.reject_below)


def test_equal_scores_go_to_the_first_language(spark):
    model = langid.LangIdModel(["de", "en"], np.zeros((9, 3), np.float32), np.zeros(2, np.float32), 1.0, 0.6)
    got = langid.predict(spark.createDataFrame([(1, "some text")], "doc_id long, text string"), model, "text", ["doc_id"]).first()
    assert (got.lang_pred, got.score, got.accepted) == ("de", 0.5, False)


def test_op8_weights_equal_a_plain_loop(spark):
    """FTRL-proximal by a dictionary and one coordinate at a time; repeated labels take the largest."""
    rng = random.Random(6)
    text = lambda bad: " ".join(rng.choice(["vile", "awful"] if bad and rng.random() < 0.4 else ["a", "b", "c", "d", "e"]) for _ in range(12))
    docs = [(i, text(i % 3 == 0)) for i in range(60)]
    labels = [(i, int(i % 3 == 0)) for i in range(60)] + [(0, 0), (3, 0), (7, 2), (None, 1), (999, 1)]
    p = toxicity.ToxicityParams(bits=12, epochs=2, l1=0.5)
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(d, lab, "doc_id", "text", "toxic", p)
    data = sorted((str(i), t, int(i % 3 == 0)) for i, t in docs)
    z, n, order, shuffle = {}, {}, np.arange(len(data)), np.random.default_rng(p.seed)

    def weight(j, l1):
        zj = z.get(j, 0.0)
        return 0.0 if abs(zj) <= l1 else -(zj - math.copysign(l1, zj)) / ((p.beta + n.get(j, 0.0) ** 0.5) / p.alpha + (p.l2 if l1 else 0))

    for _ in range(p.epochs):
        shuffle.shuffle(order)
        for o in order:
            _, t, y = data[o]
            xs = [*toxicity.feature_ids(t, p.bits).tolist(), "bias"]
            w = {j: weight(j, 0 if j == "bias" else p.l1) for j in xs}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for j in xs:
                s = ((n.get(j, 0.0) + g * g) ** 0.5 - n.get(j, 0.0) ** 0.5) / p.alpha
                z[j] = z.get(j, 0.0) + g - s * w[j]
                n[j] = n.get(j, 0.0) + g * g
    assert model.bias == pytest.approx(weight("bias", 0), rel=1e-6)
    assert np.flatnonzero(model.weights).tolist() == sorted(j for j in z if j != "bias" and weight(j, p.l1))
    for j in np.flatnonzero(model.weights):
        assert model.weights[j] == pytest.approx(weight(int(j), p.l1), rel=1e-5)
    for r in toxicity.predict(d, model, "text", ["doc_id"]).collect():
        x = sum(float(model.weights[j]) for j in toxicity.feature_ids(dict(docs)[r.doc_id], p.bits)) + model.bias
        assert r.score == pytest.approx(1 / (1 + math.exp(-x)), rel=1e-6)


def test_most_toxic_rows_are_found(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic IS NOT NULL").select("doc_id", "toxic")
    held = queries.op8_toxicity(spark, sf).where("held_out").join(labels, "doc_id")
    hit, wrong = held.agg(F.avg(F.when(F.col("toxic") == 1, F.col("predicted").cast("double"))), F.avg(F.when(F.col("toxic") == 0, F.col("predicted").cast("double")))).first()
    assert hit >= 0.8 and wrong < 0.005


# --- the pipeline's stages


ODD = 10**9


def odd_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    plain = docs.where("lang = 'en' AND length(text) > 400").orderBy("doc_id").first().text
    rows = [(None, None), (None, ""), (1, None), (2, ""), (3, " \n"), (None, plain), (4, plain), (4, plain), (5, plain + " " + plain), (None, f"{plain} {item}"), (6, " ".join([plain] * 60)), (7, f"{plain} mail bob.k@site.example"), (8, "12 34 ... !")]
    rows = [(i and ODD + i, t) for i, t in rows]
    odd = spark.createDataFrame(rows, "doc_id long, text string")
    return docs.unionByName(odd, allowMissingColumns=True).withColumn("__text", F.lit("clash")).withColumn("n", F.lit(1)), item, plain


def test_stages_on_odd_rows(spark):
    docs, item, plain = odd_documents(spark)
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: sorted(map(repr, df.select("doc_id", "text").collect()))
    there = rows(docs)
    kept = stages["language"](spark, docs, SF)
    assert kept.columns == docs.columns and set(rows(kept)) <= set(there) and not kept.where("text IS NULL OR text = '' OR text = ' \n' OR doc_id = 1000000008").count()
    kept = stages["near_duplicates"](spark, docs, SF)
    assert kept.columns == docs.columns and kept.where(F.col("text") == plain).count() == 1 and kept.where("doc_id > 1000000000 AND doc_id < 1000000004").count() == 3
    kept = stages["decontamination"](spark, docs, SF)
    assert kept.columns == docs.columns and not kept.where(F.instr("text", item) > 0).count() and kept.where("text IS NULL").count() == docs.where("text IS NULL").count()
    kept = stages["personal_data"](spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() == docs.count() and not kept.where("text LIKE '%bob.k@site.example%'").count() and kept.where("doc_id = 1000000001 AND text IS NULL").count() == 1
    out = stages["sentence_pieces"](spark, docs, SF)
    assert out.count() == docs.count() and out.where("doc_id = 1000000001").first().ids == []


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_an_empty_table(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, SF).count() == 0
