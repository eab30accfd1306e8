"""Token counts by a linear longest-match automaton.

Greedy word-piece splitting takes, again and again, the longest piece that starts
the rest of a word. The automaton is the trie of all pieces (word-initial ones from
one root, continuing ones from another) with a failure link for each node and, with
each link, the number of pieces that following it completes. A word is then counted
in one pass over its characters, and no piece is ever built.

The vocabulary is read from a public SentencePiece file whose path is a parameter:
pieces that begin with the word mark are word-initial, the others continue a word.
A word that no word-initial piece starts begins with the lone mark as a piece of its
own; a character that no piece starts with is counted as its UTF-8 byte pieces.
The automaton's size follows the vocabulary alone (refused above ``MOST_PIECES``),
so it is broadcast; words seen lately keep their count in a bounded table.

Edge cases: a word without a full split (only where the file has no lone mark or not
all byte pieces) counts as one unknown piece; null and empty
texts have 0 words and 0 tokens; whole texts of any length are read word by word;
repeated rows are counted one by one.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, lower_words, short_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
MOST_PIECES = 1_000_000
_UNKNOWN = 1 << 40


def vocabulary(path: str = MODEL) -> tuple[list[str], list[str], bool, bool]:
    """(word-initial pieces, continuing pieces, has the lone mark, has all byte pieces) of a SentencePiece file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    first = sorted({p[1:] for p in pieces if p[0] == MARK and len(p) > 1 and MARK not in p[1:]})
    return first, sorted({p for p in pieces if MARK not in p}), MARK in pieces, sum(sp.is_byte(i) for i in range(sp.get_piece_size())) == 256


def _n_bytes(c: int) -> int:
    return 1 if c < 0x80 else 2 if c < 0x800 else 3 if c < 0x10000 else 4


class Automaton:
    """Trie with failure links; ``pops[v]`` pieces are complete when the link of v is taken."""

    FIRST, NEXT = 0, 1

    def __init__(self, first: list[str], following: list[str], mark: bool = False, by_bytes: bool = False):
        if len(first) + len(following) > MOST_PIECES:
            raise ValueError("too many pieces to broadcast")
        goto: dict[int, int] = {}
        ends = [False, False]
        children: list[list[tuple[int, int]]] = [[], []]
        for root, pieces in ((self.FIRST, first), (self.NEXT, following)):
            for piece in pieces:
                u = root
                for c in map(ord, piece):
                    v = goto.get(u << 21 | c)
                    if v is None:
                        v = goto[u << 21 | c] = len(ends)
                        ends.append(False)
                        children.append([])
                        children[u].append((c, v))
                    u = v
                ends[u] = True
        fail, pops = [-1] * len(ends), [0] * len(ends)
        if mark:
            fail[self.FIRST], pops[self.FIRST] = self.NEXT, 1
        level = [self.FIRST, self.NEXT]
        while level:
            below = []
            for u in level:
                for c, v in children[u]:
                    below.append(v)
                    if ends[v]:
                        fail[v], pops[v] = self.NEXT, 1
                        continue
                    if by_bytes and u == self.NEXT:
                        fail[v], pops[v] = self.NEXT, _n_bytes(c)
                        continue
                    z, n = fail[u], pops[u]
                    while z >= 0 and (z << 21 | c) not in goto and not (by_bytes and z == self.NEXT):
                        n += pops[z]
                        z = fail[z]
                    if z >= 0:
                        w = goto.get(z << 21 | c)
                        fail[v], pops[v] = (self.NEXT, n + _n_bytes(c)) if w is None else (w, n)
            level = below
        self.goto, self.fail, self.pops, self.by_bytes = goto, fail, pops, by_bytes

    def count(self, word: str) -> int:
        """Pieces of the word, or -1 if it has no full split."""
        goto, fail, pops = self.goto, self.fail, self.pops
        u, n = self.FIRST, 0
        for c in map(ord, word):
            v = goto.get(u << 21 | c)
            while v is None:
                if u == self.NEXT and self.by_bytes:
                    n += _n_bytes(c)
                    v = u
                    break
                n += pops[u]
                u = fail[u]
                if u < 0:
                    return -1
                v = goto.get(u << 21 | c)
            u = v
        while u != self.NEXT:
            n += pops[u]
            u = fail[u]
            if u < 0:
                return -1
        return n


class _Counts(dict):
    def __init__(self, automaton: Automaton, limit: int = 300_000):
        super().__init__()
        self.automaton, self.limit = automaton, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        n = self.automaton.count(word.decode("utf-8", "surrogatepass"))
        self[word] = n = 1 + _UNKNOWN if n < 0 else n
        return n


def count(df: DataFrame, keep: list[str], text_col: str, model_path: str = MODEL, lower: bool = False) -> DataFrame:
    """``keep``, n_words, n_tokens and n_unknown for every row, over its whole text."""
    spark = df.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(Automaton(*vocabulary(model_path)))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)

    def work(batches):
        counts = _Counts(shared.value)
        for b in batches:
            words, tokens, unknown = [], [], []
            for t in b.column(b.num_columns - 1).to_pylist():
                w = lower_words(t) if lower else t.encode("utf-8", "surrogatepass").split() if t else []
                n = sum(map(counts.__getitem__, w))
                words.append(len(w))
                tokens.append(n % _UNKNOWN)
                unknown.append(n // _UNKNOWN)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array(unknown, pa.int64())],
                names=[*b.schema.names[:-1], "n_words", "n_tokens", "n_unknown"],
            )

    return df.select(*keep, df[text_col].alias("__text")).mapInArrow(work, f"{kinds}, n_words long, n_tokens long, n_unknown long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(documents(spark, sf_dir), ["doc_id"], "text")
