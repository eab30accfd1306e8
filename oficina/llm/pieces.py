"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The machines are compiled from a public model file (its path is a parameter):

* the normaliser, a transducer of one state: an arc reads a character and writes its
  replacement (blank to word mark), and one arc writes a word mark before the text;
* the lexicon, a trie of the pieces closed into a loop: a piece's arc weighs minus its
  score. A character that is no piece goes by an arc of its UTF-8 bytes, each dearer than any piece;
* for a merge vocabulary, the pair acceptor, whose state is the last piece: its arc weighs 0 if
  merging the joined text of two neighbours gives back exactly these two, else infinity.
  Scores alone would not give the merge order. Its arcs are made when first needed.

An input is composed with them state by state (a place and its last piece) and the shortest path in the
tropical semiring is taken: each arc relaxes ``min(old, cost + weight)``. Without
a pair acceptor (``merges=False``) the state is the place alone and the scores decide.

A text's path falls apart between two characters that no piece holds side by side, so before every mark
that follows another character (no piece has one there, which is checked). These cuts are found for a block of characters at
once, and the paths of the stretches between them are remembered, as bytes, in a table of bounded size.

Edge cases: null and empty texts have no ids and decode to an empty text; characters
outside the vocabulary become UTF-8 byte pieces; a literal word mark in a text decodes
to a blank (the row says so in ``lossless``); of equally light paths the one whose last
piece is longest is taken; repeated rows are encoded one by one, null ids are kept; an empty table gives no rows.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, fresh, short_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: The normaliser's arcs: what each character becomes; all others stay. No arc reads what another writes.
RULES = {" ": MARK}
MOST_PIECES = 1_000_000
#: Characters of a stretch up to which its path is remembered, and searched in lists and not in arrays.
SHORT = 64
#: Characters of a text that are cut at once.
BLOCK = 1 << 16
#: Pairs of characters up to which a table says which of them some piece holds.
MOST_PAIRS = 1 << 24


def load(path: str = MODEL) -> list[tuple[str, float, str]]:
    """(piece, score, kind) by id; kind: normal, byte or special."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "byte" if sp.is_byte(i) else "special" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "normal"
    out = [(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())]
    if len(out) > MOST_PIECES:
        raise ValueError("too many pieces to broadcast")
    return out


_NONE: dict = {}
_END: list = [{}, None]


class Paths(dict):
    """Ids, as bytes, of the shortest paths of stretches; short ones are remembered, a full table as the older one."""

    def __init__(self, path: Callable[[str], array], most: int):
        super().__init__()
        self.path, self.most = path, most
        self.older: dict[str, bytes] = {}

    def __missing__(self, s: str) -> bytes:
        got = self.older.get(s)
        if got is None:
            got = self.path(s).tobytes()
        if len(s) <= SHORT:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[s] = got
        return got


class Transducer:
    def __init__(self, pieces: list[tuple[str, float, str]], merges: bool = True, stretches: int = 400_000, pairs: int = 500_000):
        self.id = {p: i for i, (p, _, k) in enumerate(pieces) if k == "normal"}
        self.score = {p: s for p, s, k in pieces if k == "normal"}
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece has a word mark inside")
        self.merges = merges
        self.lexicon: list = [{}, None]  # a node: what characters lead to, and (piece, weight) where a piece ends
        for p, s in self.score.items():
            node = self.lexicon
            for c in p:
                node = node[0].setdefault(c, [{}, None])
            node[1] = (p, -s)
        self.byte_weight = 10.0 - min(self.score.values(), default=0.0)
        inner = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}  # character pairs that some piece holds
        lefts, rights = ({c: i for i, c in enumerate(sorted({p[k] for p in inner}), 1)} for k in (0, 1))
        # A pair's number is left + right, 0 for characters that no pair has there.
        self.left, self.right = np.zeros(0x110000, np.int64), np.zeros(0x110000, np.int64)
        for c, i in lefts.items():
            self.left[ord(c)] = i * (len(rights) + 1)
        for c, i in rights.items():
            self.right[ord(c)] = i
        self.inner = np.array(sorted(self.left[ord(a)] + self.right[ord(b)] for a, b in inner), np.int64)
        self.apart = None
        if (len(lefts) + 1) * (len(rights) + 1) <= MOST_PAIRS:
            self.apart = np.ones((len(lefts) + 1) * (len(rights) + 1), np.bool_)
            self.apart[self.inner] = False
        self.byte = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == "byte"}
        self.bytes_of = [bytes([int(p[3:5], 16)]) if k == "byte" else b"" if k == "special" else p.replace(MARK, " ").encode() for p, _, k in pieces]
        self.most_paths, self.most_fits = stretches, pairs
        self.forget()
        self.fits: dict[str, dict[str, bool]] = {}
        self.n_fits = 0

    def merged(self, text: str) -> list[str]:
        """Merges of a short text (a pair of pieces): best score first, leftmost among equals."""
        s = list(text)
        score = self.score
        while len(s) > 1:
            best, at = None, -1
            for i in range(len(s) - 1):
                x = score.get(s[i] + s[i + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, i
            if best is None:
                break
            s[at : at + 2] = [s[at] + s[at + 1]]
        return s

    def fit(self, a: str, b: str) -> bool:
        """Arc of the pair acceptor; an empty ``a`` asks for ``b`` at the start of a stretch."""
        got = self.fits.get(a, _NONE).get(b)
        if got is None:
            if self.n_fits >= self.most_fits:
                self.fits.clear()
                self.n_fits = 0
            if a and a + b in self.id and self.fit("", a + b):
                got = False  # the two would become one piece
            else:
                got = self.merged(a + b) == ([a, b] if a else [b])
            self.fits.setdefault(a, {})[b] = got
            self.n_fits += 1
        return got

    def path(self, s: str) -> array:
        """Ids of the shortest path of a stretch.

        Under the pair acceptor what is reached at a place with a finite weight is the merge encoding of
        what lies before it, and without it the place alone is the state. So a place has one state, and at most 24 bytes
        in a long stretch: its weight so far, its last piece and its turn in the queue. With the acceptor the weight is
        final when the place is reached, so the queue is a stack with the farthest place on top, and the search ends at
        the last place. Without it places are relaxed in their order.
        """
        n, fits, fit, merges, root = len(s), self.fits, self.fit, self.merges, self.lexicon[0]
        cost = [0.0] * (n + 1) if n <= SHORT else array("d", bytes(8 * (n + 1)))
        piece: list[str | None] = [None] * (n + 1)
        piece[0] = ""
        order = [0] if merges else range(n - 1, -1, -1)
        todo = list(order) if n <= SHORT else array("q", order)
        while todo:
            i = todo.pop()
            last = piece[i]
            if i == n:
                break
            if last is None:
                continue
            known, base = fits.get(last, _NONE) if merges else _NONE, cost[i]
            j, c = i + 1, s[i]
            node = root.get(c, _END)
            arc = node[1] or (c, self.byte_weight * len(c.encode("utf-8", "surrogatepass")))
            while True:  # the lexicon's arcs from this place, shortest first
                # Under the pair acceptor a place that has been reached has its only state.
                if arc is not None and (piece[j] is None or not merges):
                    p, weight = arc
                    ok = known.get(p)
                    if ok is None:
                        ok = not merges or fit(last, p)
                    if ok and (piece[j] is None or base + weight < cost[j]):
                        piece[j], cost[j] = p, base + weight
                        if merges:
                            todo.append(j)
                if j == n:
                    break
                node = node[0].get(s[j])
                if node is None:
                    break
                j += 1
                arc = node[1]
        i, out = n, array("i")
        while i:
            p = piece[i]
            got = self.id.get(p)
            if got is not None:
                out.append(got)
            else:
                out.extend([self.byte[b] for b in reversed(p.encode("utf-8", "surrogatepass"))])
            i -= len(p)
        out.reverse()
        return out

    def stretches(self, s: str) -> Iterator[list[str]]:
        """``s`` cut between characters that no piece holds side by side, a list for each block."""
        n, at = len(s), 0
        for begin in range(0, n, BLOCK):
            codes = np.frombuffer(s[begin : begin + BLOCK + 1].encode("utf-32-le", "surrogatepass"), "<u4")
            pairs = self.left[codes[:-1]] + self.right[codes[1:]]
            apart = np.isin(pairs, self.inner, invert=True) if self.apart is None else self.apart[pairs]
            ends = (np.flatnonzero(apart) + (begin + 1)).tolist()
            if begin + BLOCK >= n:
                ends.append(n)
            yield [s[a:b] for a, b in zip([at, *ends], ends)]
            at = ends[-1] if ends else at

    def ids(self, text: str | None) -> array:
        out = array("i")
        if text:
            for a, b in RULES.items():
                text = text.replace(a, b)
            for stretches in self.stretches(MARK + text):
                out.frombytes(b"".join(map(self.paths.__getitem__, stretches)))
        return out

    def encode(self, text: str | None) -> list[int]:
        return self.ids(text).tolist()

    def forget(self) -> None:
        """Give up the remembered paths, which a worker that goes on to other work need not hold."""
        self.paths = Paths(self.path, self.most_paths)

    def decode(self, ids) -> str:
        """Text of the ids: pieces and bytes joined, the leading mark dropped."""
        out = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if out[:1] == " " else out


_BUILT: dict[int, Transducer] = {}


def _transducer(pieces: list[tuple[str, float, str]], key: int) -> Transducer:
    """One transducer for each worker process; ``key`` tells vocabularies apart."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Transducer(pieces)
    return _BUILT[key]


def _mapped(df: DataFrame, keep: list[str], col: str, schema: str, names: list[str], model_path: str, each) -> DataFrame:
    spark = df.sparkSession
    short_batches(spark)
    loaded = load(model_path)
    pieces, key = spark.sparkContext.broadcast(loaded), hash(tuple(loaded))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)

    def work(batches):
        t = _transducer(pieces.value, key)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *each(t, b.column(b.num_columns - 1))], names=[*b.schema.names[:-1], *names])
        t.forget()

    return df.select(*keep, df[col].alias(fresh("__in", keep))).mapInArrow(work, f"{kinds}, {schema}")


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(x) for x in ids])
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def encode(df: DataFrame, keep: list[str], text_col: str, model_path: str = MODEL) -> DataFrame:
    """``keep``, ids, n_tokens, n_byte_tokens and lossless (decoding gives the text back) for every row."""

    def each(t: Transducer, texts):
        ids, n_bytes, same = [], [], []
        low, high = min(t.byte.values(), default=0), max(t.byte.values(), default=-1)
        for text in texts.to_pylist():
            x = t.ids(text)
            a = np.frombuffer(x, np.int32)
            ids.append(a)
            n_bytes.append(int(((a >= low) & (a <= high)).sum()))
            same.append(t.decode(x) == (text or ""))
        return [_lists(ids), pa.array([len(x) for x in ids], pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(same, pa.bool_())]

    return _mapped(df, keep, text_col, "ids array<int>, n_tokens long, n_byte_tokens long, lossless boolean", ["ids", "n_tokens", "n_byte_tokens", "lossless"], model_path, each)


def decode(df: DataFrame, keep: list[str], ids_col: str, model_path: str = MODEL) -> DataFrame:
    """``keep`` and text for every row of ids."""
    return _mapped(df, keep, ids_col, "text string", ["text"], model_path, lambda t, ids: [pa.array([t.decode(x or []) for x in ids.to_pylist()], pa.string())])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir), ["doc_id"], "text")
