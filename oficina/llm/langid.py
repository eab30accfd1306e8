"""Language ID: averaged hashed subword embeddings with a linear softmax.

A text's subwords are its byte n-grams (2 to 4 bytes, one word gap counts as a
byte at either end). Each is hashed to a row of an embedding table; the average
of the rows goes through a linear softmax. Both are trained by stochastic
gradient descent in numpy on a bounded sample of labelled rows
(``LangIdParams.train_rows``). A temperature, fitted on a held-back part of the
sample, calibrates the score, and ``reject_below`` is the score that all but
``reject_share`` of that part's correctly labelled texts reach.

Because the model is linear after the average, prediction folds embeddings and
softmax weights into one small table that goes to the tasks by closure; its size
is ``buckets * languages`` floats, whatever the corpus.

Edge cases: a null text or one without a letter gets ``und`` with score 0 and is
rejected; a corpus without labelled rows gives ``und`` for all; equal scores go
to the language that sorts first; repeated rows are judged one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_share, by_bytes, fresh, short_batches

_GAP = 32
_FOLD = np.array(
    [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else _GAP for c in range(256)],
    np.uint8,
)
UND = "und"


@dataclass(frozen=True)
class LangIdParams:
    buckets: int = 1 << 13
    dim: int = 16
    train_rows: int = 2_000
    epochs: int = 12
    rate: float = 0.5
    batch: int = 32
    reject_share: float = 0.001
    reject_most: float = 0.5
    seed: int = 11


@dataclass
class LangIdModel:
    langs: list[str]
    table: np.ndarray  # (buckets + 1, langs + 1): folded weights and a count; last row: zeros
    bias: np.ndarray
    temperature: float
    reject_below: float


def subword_ids(folded: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """For each start, the bucket of the n-gram there, or ``buckets`` if a gap lies inside."""
    m = len(folded) - n + 1
    if m <= 0:
        return np.zeros(0, np.int32)
    code = np.full(m, n, np.uint32)
    for i in range(n):
        code = code * np.uint32(0x01000193) + folded[i : i + m]
    code ^= code >> np.uint32(15)
    ids = ((code * np.uint32(0x9E3779B1)) >> np.uint32(8)).astype(np.int32) % buckets
    if n == 2:
        bad = (folded[:m] == _GAP) & (folded[1 : m + 1] == _GAP)
    else:
        bad = folded[1 : m + 1] == _GAP
        for i in range(2, n - 1):
            bad |= folded[i : i + m] == _GAP
    ids[bad] = buckets
    return ids


def _folded(text: bytes) -> np.ndarray:
    return _FOLD[np.frombuffer(b" " + text + b" ", np.uint8)]


def _counts(text: bytes, buckets: int, step: int = 1 << 20) -> np.ndarray:
    """Subword counts of a whole text, a stretch at a time."""
    f = _folded(text)
    out = np.zeros(buckets + 1, np.int64)
    for n in (2, 3, 4):
        for a in range(0, len(f), step):
            out += np.bincount(subword_ids(f[a : a + step + n - 1], n, buckets), minlength=buckets + 1)
    return out[:buckets]


def train(df: DataFrame, text_col: str, lang_col: str, id_col: str, params: LangIdParams = LangIdParams()) -> LangIdModel | None:
    """Fit on at most about ``train_rows`` rows of ``df`` that have a language and a letter.

    A fifth of them is held out for the temperature and the bound of rejection, however many there are; under five
    rows that is none, so the temperature is 1 and nothing is rejected.
    """
    p = params
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    rows = bounded_share(rows.select(id_col, F.col(text_col).alias("text"), F.col(lang_col).alias("lang")), p.train_rows, id_col, "text", "lang")
    short_batches(df.sparkSession)
    buckets = p.buckets

    def features(parts):
        for pdf in parts:
            found = []
            for t in pdf["text"]:
                c = _counts(t.encode("utf-8", "surrogatepass"), buckets)
                at = np.flatnonzero(c)
                found.append((at.astype(np.int32).tobytes(), (c[at] / max(1, c.sum())).astype(np.float32).tobytes()))
            yield pd.DataFrame({"id": pdf[id_col].astype(str), "lang": pdf["lang"], "at": [x[0] for x in found], "x": [x[1] for x in found]})

    got = rows.mapInPandas(features, "id string, lang string, at binary, x binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: (str(r.id), r.lang, bytes(r.at)))
    langs = sorted({r.lang for r in got})
    feats = [(np.frombuffer(bytes(r.at), np.int32), np.frombuffer(bytes(r.x), np.float32)) for r in got]
    y = np.array([langs.index(r.lang) for r in got])
    rng = np.random.default_rng(p.seed)
    order = rng.permutation(len(got))
    held, fit = order[: len(order) // 5], order[len(order) // 5 :]
    emb = rng.normal(0, 0.1, (buckets, p.dim)).astype(np.float32)
    soft = np.zeros((p.dim, len(langs)), np.float32)
    soft += rng.normal(0, 0.1, soft.shape).astype(np.float32)
    bias = np.zeros(len(langs), np.float32)

    def dense(rows_):
        x = np.zeros((len(rows_), buckets), np.float32)
        for k, i in enumerate(rows_):
            x[k, feats[i][0]] = feats[i][1]
        return x

    def softmax(z):
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    steps = max(1, p.epochs * max(1, len(fit) // p.batch))
    done = 0
    # The average of n rows has gradients that small counts make small: scale them up.
    boost = 50.0
    for _ in range(max(p.epochs, 200 * p.batch // max(1, len(fit)))):
        rng.shuffle(fit)
        for a in range(0, len(fit), p.batch):
            rows_ = fit[a : a + p.batch]
            x = dense(rows_)
            hidden = x @ emb
            g = softmax(hidden @ soft + bias)
            g[np.arange(len(rows_)), y[rows_]] -= 1
            g /= len(rows_)
            rate = p.rate * max(0.05, 1 - done / steps)
            back = g @ soft.T
            soft -= rate * (hidden.T @ g) * 4
            bias -= rate * 0.1 * g.sum(0)
            emb -= rate * boost * (x.T @ back)
            done += 1
    z = np.concatenate([np.zeros((0, len(langs)), np.float32), *[dense(held[a : a + 64]) @ emb @ soft + bias for a in range(0, len(held), 64)]])
    nll = lambda t: -np.log(softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean()
    heat = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=nll) if len(held) else 1.0
    own = np.sort(softmax(z / heat)[np.arange(len(held)), y[held]])
    below = min(p.reject_most, float(own[int(p.reject_share * len(own))])) if len(held) else 0.0
    table = np.zeros((buckets + 1, len(langs) + 1), np.float32)
    table[:buckets, :-1] = emb @ soft
    table[:buckets, -1] = 1
    return LangIdModel(langs, table, bias, float(heat), below)


def scores(texts: list[bytes], model: LangIdModel, step: int = 1 << 19) -> np.ndarray:
    """Calibrated probabilities by text; texts go through in stretches of bounded size."""
    buckets, width = model.table.shape[0] - 1, model.table.shape[1]
    total = np.zeros((len(texts), width))
    buf = np.concatenate([_folded(t)[:-1] for t in texts] + [np.array([_GAP], np.uint8)])
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    for a in range(0, len(buf) - 1, step):
        b = min(len(buf) - 1, a + step)
        first = np.searchsorted(starts, a, "right") - 1
        last = np.searchsorted(starts, b, "left")
        cuts = np.maximum(starts[first:last], a) - a
        for n in (2, 3, 4):
            ids = np.full(b - a, buckets, np.int32)
            got = subword_ids(buf[a : min(len(buf), b + n - 1)], n, buckets)[: b - a]
            ids[: len(got)] = got
            total[first:last] += np.add.reduceat(model.table[ids], cuts, axis=0)
    z = (total[:, :-1] / np.maximum(1, total[:, -1:]) + model.bias) / model.temperature
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def predict(df: DataFrame, model: LangIdModel | None, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` columns, lang_pred, score (0 to 1) and accepted, for every row."""
    spark = df.sparkSession
    short_batches(spark)
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = df.select(*keep, F.when(letters, F.col(text_col)).alias(fresh("__text", keep)))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    if model is None:
        return rows.select(*keep, F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))

    def judge(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            lang, score, ok = [], [], []
            at = 0
            for run in by_bytes(texts, 1 << 19):
                p = scores(run, model)
                best = p.argmax(1)
                for k, i in enumerate(best):
                    none = texts[at + k] is None
                    s = 0.0 if none else float(p[k, i])
                    lang.append(UND if none else model.langs[i])
                    score.append(s)
                    ok.append(not none and s >= model.reject_below)
                at += len(run)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ok, pa.bool_())],
                names=[*batch.schema.names[:-1], "lang_pred", "score", "accepted"],
            )

    return rows.mapInArrow(judge, f"{kinds}, lang_pred string, score double, accepted boolean")
