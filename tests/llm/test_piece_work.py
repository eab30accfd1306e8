"""Work of the piece search: places relaxed, cuts over blocks, many pairs of characters."""

import random

import pytest

from oficina.llm import pieces

WORDS = ["▁international", "▁unbelievable", "▁straightforwardness", "▁thingenanonreouat", "▁communications", "▁éelleçque"]


@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


class Counted(dict):
    """The lexicon's first arcs, which are asked for once a relaxed place."""

    asked = 0

    def get(self, *a):
        self.asked += 1
        return super().get(*a)


def test_places_off_the_path_are_not_relaxed():
    t = pieces.Transducer(pieces.load())
    t.lexicon[0] = Counted(t.lexicon[0])
    found = sum(len(t.path(w)) for w in WORDS)
    # About one for each piece, where each of the characters was one.
    assert t.lexicon[0].asked <= 1.5 * found < 0.75 * sum(map(len, WORDS))


def test_cuts_do_not_depend_on_blocks(library, monkeypatch):
    t = pieces.Transducer(pieces.load())
    rng = random.Random(5)
    texts = ["".join(rng.choices("abehlo THE.,-▁é\n0123456789ßж日😀", k=n)) for n in (*range(1, 30), 300, 2000)]
    texts += ["the" * 300, " " * 50, "x" + " " * 33 + "y"]
    wanted = [library.encode(x) for x in texts]
    for block in (1, 2, 7, 64, 1 << 16):
        monkeypatch.setattr(pieces, "BLOCK", block)
        t.forget()
        assert [t.encode(x) for x in texts] == wanted
        for x in texts:
            assert "".join(s for run in t.stretches(x) for s in run) == x


def test_very_many_pairs_of_characters(library, monkeypatch):
    monkeypatch.setattr(pieces, "MOST_PAIRS", 0)
    t = pieces.Transducer(pieces.load())
    assert t.apart is None
    for x in ("Hello wörld, 日本語 テスト 😀", "a  b▁c\n\nthe end.", "é" * 80):
        assert t.encode(x) == library.encode(x)


def test_paths_of_a_full_table_are_kept_as_the_older_one():
    t = pieces.Transducer(pieces.load(), stretches=5, pairs=10)
    whole = pieces.Transducer(pieces.load())
    text = " ".join("alpha beta gamma delta epsilon zeta eta theta alpha iota kappa beta".split() * 3) + "!" * 100
    assert t.encode(text) == whole.encode(text)
    assert len(t.paths) <= 5 and len(t.paths.older) <= 5


def test_lone_surrogates_are_cut_like_other_characters():
    t = pieces.Transducer(pieces.load())
    ids = t.encode("a\ud800b")
    assert [t.bytes_of[i] for i in ids][-4:] == [b"\xed", b"\xa0", b"\x80", b"b"]
