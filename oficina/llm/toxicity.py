"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct buckets of its words, word pairs and pairs
with one word between them. Rates are per coordinate and L1 keeps most weights at
zero, so the weights that go to the tasks are a short list of (bucket, weight).
Training reads at most about ``train_rows`` labelled rows and, of these, as many by hash as have
about ``train_features`` buckets in all (both are parameters); the features are hashed on the executors, only the buckets,
four bytes each, reach the driver.

Edge cases: null and empty texts score as the bias alone; labels other than 0 and
1 are ignored; of repeated labels of an id the largest counts, of repeated texts too; without any label
every score is 0; repeated rows are scored one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, bounded_share, fresh, mixed, plain_words, share_bound, short_batches, stored


@dataclass(frozen=True)
class ToxicityParams:
    bits: int = 21
    train_rows: int = 16_000
    train_features: int = 64_000_000
    epochs: int = 4
    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.1
    seed: int = 5


@dataclass
class ToxicityModel:
    bits: int
    weights: np.ndarray  # float32 by bucket, mostly zero
    bias: float


_HASHES = WordHashes()


def feature_ids(text: str | None, bits: int) -> np.ndarray:
    """Distinct buckets of the whole text's n-grams and skip-grams, sorted."""
    h = _HASHES.of(plain_words(text))
    shift = np.uint64(64 - bits)
    parts = [mixed(h) >> shift]
    for gap, seed in ((1, 0x632BE59BD9B4E019), (2, 0xD6E8FEB86659FD93)):
        if len(h) > gap:
            parts.append(mixed(h[:-gap] * np.uint64(seed) + h[gap:]) >> shift)
    return np.unique(np.concatenate(parts)).astype(np.int32)


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    p = params
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    marks = marks.groupBy(id_col).agg(F.max(label_col).cast("int").alias("__label"))
    marks = bounded_share(marks, p.train_rows, id_col)
    # At most about train_rows ids and labels: a proven bound for the broadcast.
    rows = docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(marks), id_col)
    # An id on many rows counts once, with its largest text.
    rows = rows.groupBy(id_col).agg(F.max("text").alias("text"), F.max("__label").alias("__label"))
    short_batches(docs.sparkSession)
    bits = p.bits

    def features(batches):
        for b in batches:
            x = [feature_ids(t, bits).tobytes() for t in b.column(1).to_pylist()]
            tie = pa.array([xxhash.xxh3_64_intdigest(v) >> 1 for v in x], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.binary()), tie], names=["id", "label", "x", "tie"])

    made = stored(rows.select(F.col(id_col).cast("string"), "text", "__label").mapInArrow(features, "id string, label int, x binary, tie long"), "features")
    total = (made.agg(F.sum(F.length("x"))).first()[0] or 0) // 4
    if total > p.train_features:
        made = made.where(F.xxhash64("id", "tie", F.lit(11)) < F.lit(share_bound(total, p.train_features)).cast("long"))
    # Bounded by train_features; kept as Arrow buffers, of which each step sees a slice.
    got = made.toArrow()
    y = got.column("label").to_numpy()
    chunks = [c for c in got.column("x").chunks if len(c)]
    ends = [np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1] // 4 for c in chunks]
    flat = [np.frombuffer(c.buffers()[2] or b"", np.int32) for c in chunks]
    place = [(k, i) for k, c in enumerate(chunks) for i in range(len(c))]
    first = sorted(range(len(got)), key=list(zip(got.column("id").to_pylist(), got.column("tie").to_pylist())).__getitem__)
    z = np.zeros(1 << bits)
    n = np.zeros(1 << bits)
    z0 = n0 = 0.0
    rng = np.random.default_rng(p.seed)
    order = np.arange(len(got))
    if not y.any():
        return ToxicityModel(bits, np.zeros(1 << bits, np.float32), -50.0)

    def weights(zs, ns):
        w = -(zs - np.sign(zs) * p.l1) / ((p.beta + np.sqrt(ns)) / p.alpha + p.l2)
        return np.where(np.abs(zs) <= p.l1, 0.0, w)

    for _ in range(p.epochs):
        rng.shuffle(order)
        for o in order:
            k, i = place[first[o]]
            at = flat[k][ends[k][i] : ends[k][i + 1]]
            w = weights(z[at], n[at])
            w0 = -z0 / ((p.beta + n0**0.5) / p.alpha)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + w0, -35, 35))) - y[first[o]]
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / p.alpha
            z[at] += g - s * w
            n[at] += g * g
            s0 = ((n0 + g * g) ** 0.5 - n0**0.5) / p.alpha
            z0 += g - s0 * w0
            n0 += g * g
    kept = np.flatnonzero(np.abs(z) > p.l1)
    table = np.zeros(1 << bits, np.float32)
    table[kept] = weights(z[kept], n[kept])
    return ToxicityModel(bits, table, float(-z0 / ((p.beta + n0**0.5) / p.alpha)))


def predict(docs: DataFrame, model: ToxicityModel, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and score for every row, over its whole text."""
    short_batches(docs.sparkSession)
    at = np.flatnonzero(model.weights).astype(np.int32)
    value, bits, bias = model.weights[at], model.bits, model.bias
    rows = docs.select(*keep, F.col(text_col).alias(fresh("__text", keep)))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def judge(batches):
        table = np.zeros(1 << bits)
        table[at] = value
        for batch in batches:
            total = [table[feature_ids(t, bits)].sum() + bias for t in batch.column(batch.num_columns - 1).to_pylist()]
            score = 1 / (1 + np.exp(-np.clip(np.array(total, float), -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64())], names=[*batch.schema.names[:-1], "score"])

    return rows.mapInArrow(judge, f"{kinds}, score double")
