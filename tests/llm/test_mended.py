"""Order of license spans, long stretches without blanks, few labelled rows, short benchmark items."""

import random
import resource

import pytest
from pyspark.sql import functions as F

from oficina.llm import decontaminate, langid, licenses, pieces


def labels_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in licenses.scan(df).collect()}


def test_license_words_must_come_in_order(spark):
    notice = next(t for label, t, _ in licenses.NOTICES if label == "mit").split()
    fours = [notice[i : i + 4] for i in range(0, len(notice), 4)]
    rng = random.Random(2)
    mixed = rng.sample(fours, len(fours))
    inserted = [w for i, w in enumerate(notice) for w in ([w, "extra", "words", "here"] if i % 20 == 10 else [w])]
    third = len(notice) // 5
    moved = notice[-third:] + notice[:-third]
    texts = [" ".join(notice), " ".join(w for f in reversed(fours) for w in f), " ".join(w for f in mixed for w in f), " ".join(inserted), " ".join(moved), " ".join(notice) + " x " + " ".join(notice)]
    got = labels_of(spark, texts)
    assert [got[i]["labels"] for i in range(6)] == ["mit", "", "", "mit", "mit", "mit"]
    assert got[0]["score"] == 1.0 and got[1]["score"] < 0.3


@pytest.mark.parametrize("values", [[], [1], [3, 2, 1], [1, 5, 2, 3, 9, 4], [2, 2, 2], [0, 8, 4, 12, 2, 10, 6, 14, 1, 9]])
def test_longest_rise(spark, values):
    best = []
    for i, x in enumerate(values):
        best.append(1 + max([best[j] for j in range(i) if values[j] < x], default=0))
    df = spark.createDataFrame([(values,)], "v array<int>")
    assert df.select(licenses.longest_rise(F.col("v")).alias("n")).first()["n"] == max(best, default=0)


def test_a_long_stretch_without_blanks_in_bounded_memory():
    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    t = pieces.Transducer(pieces.load())
    rng = random.Random(4)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGH0123456789+/é", k=300_000))
    t.ids(text[:20_000])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    got = t.ids(text)
    grown = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024
    assert got.tolist() == sp.encode(text) and t.decode(got) == text
    assert grown < 60, grown
    # One stretch that no pair of characters cuts.
    text = "the" * 60_000
    assert t.ids(text).tolist() == sp.encode(text)


def test_weights_alone_over_long_stretches():
    vocabulary = [("▁", -2.0, "normal"), ("a", -1.0, "normal"), ("aa", -1.5, "normal"), ("ab", -1.2, "normal"), ("b", -1.1, "normal")]
    t = pieces.Transducer(vocabulary, merges=False)
    rng = random.Random(1)
    for _ in range(50):
        text = "".join(rng.choices("ab", k=30))
        s = "▁" + text
        best = [0.0] + [1e9] * len(s)
        for i in range(len(s)):
            for p, w, _ in vocabulary:
                if s.startswith(p, i):
                    best[i + len(p)] = min(best[i + len(p)], best[i] - w)
        assert abs(sum(-vocabulary[i][1] for i in t.encode(text)) - best[-1]) < 1e-9


@pytest.mark.parametrize("n", [1, 4, 5, 30])
def test_language_of_few_labelled_rows(spark, n):
    texts = {"de": "der hund und die katze sind im haus und der garten", "en": "the dog and the cat are in the house and the garden"}
    rows = [(i, f"{texts['de' if i % 2 else 'en']} {i}", "de" if i % 2 else "en") for i in range(n)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text", "lang", "doc_id")
    assert model.langs == sorted({r[2] for r in rows})
    if n < 5:
        assert model.temperature == 1.0 and model.reject_below == 0.0


def test_short_items_follow_the_rate_where_words_below_is_zero(spark):
    docs = spark.createDataFrame([(1, "xx the quick brwn fox yy"), (2, "a quick brown foxes"), (3, "none")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "quick brown fox")], "item_id long, text string")
    found = lambda **k: sorted((r["doc_id"], r["distance"]) for r in decontaminate.matches(docs, bench, "doc_id", "text", **k).collect())
    assert found() == [] and found(words_below=0) == [(1, 1), (2, 0)]
