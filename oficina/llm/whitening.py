"""Whitening of embeddings by a singular value decomposition of the centred rows.

A vector's entries c become the whole numbers x = floor(256 * c). The fit list holds each distinct x
vector once; n is its length, S its sum. The centred rows x - S / n, one for each vector of the fit list, are
the rows of a distributed matrix. Its right singular vectors are the components, its singular values s
give the eigenvalues s ** 2 / n of the covariance. The total variance does not come from the decomposition:
it is the sum of the exact squared deviations (n * x - S) ** 2, divided by n ** 3.

The rows are multiplied where they lie; the driver gets the sums and the matrix of products (dimensions
squared), and MLlib's dense solver decomposes that there, which is exact to double precision. So the driver's memory
grows with the square of the dimensions (1,000: 8 MB) and not with the rows. The table is read three times (lengths,
distinct vectors, result), the written fit list once for each sum over it; nothing else is shuffled.

Defined results: a vector that is null or holds null, a NaN or an infinity is dropped. So is a vector of
another length than most have (the longer one among equals), since it is no point of the same space. Components
whose singular value is under 1e-7 of the largest do not exist (their direction is rounding error), so a table
whose vectors all lie on a line has one component and one of equal vectors has none, and no rows. Repeated rows and null ids
keep a row for each component. A deviation beyond 64 bits is null. Equal eigenvalues: any basis of their plane. Of the two
signs the one with which the largest entry is positive. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

SCALE = 256
COMPONENTS = 4
#: Singular values under this share of the largest are rounding error.
LEAST = 1e-7
#: Deviations from here on are summed as doubles.
EXACT = 10**27
_SCORES = "w array<double>, deviation decimal(38,0), rough double"


@dataclass
class Model:
    """What whitening needs: n, S, the components (rows) with their eigenvalues, the total variance, the check."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    variance: float
    identity_error: float

    @property
    def explained(self) -> list[float]:
        return [float(e) / self.variance for e in self.eigenvalues]


def whole(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * c) of each entry, null where an entry is null, NaN or infinite."""
    sound = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(sound, F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long")))


def points(df: DataFrame, vector_col: str, keep: list[str], scale: int = SCALE) -> DataFrame:
    """``keep`` and ``x`` of the rows whose vector is sound and as long as most are."""
    rows = df.select(*keep, whole(F.col(vector_col), scale).alias("x")).where("x IS NOT NULL")
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (length["d"] if length else 0))


def _matrix(x: pa.Array, d: int) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    total = [0] * d
    n = 0
    for b in batches:
        m = _matrix(b.column("x"), d)
        # Halves of 32 bits, so that no sum leaves 64 bits.
        low, high = (m & 0xFFFFFFFF).sum(axis=0), (m >> 32).sum(axis=0)
        total = [t + int(l) + (int(h) << 32) for t, l, h in zip(total, low, high)]
        n += len(m)
    places = list(range(d)) + [d]
    yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array([Decimal(v) for v in [*total, n]], pa.decimal128(38, 0))], ["place", "v"])


def deviations(m: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n * x - S) ** 2, exact."""
    s = np.array(sums, dtype=object)
    reach = n * max(int(m.max(initial=0)), -int(m.min(initial=0)), 1) + max(map(abs, sums), default=0)
    if reach * reach * max(len(sums), 1) < 1 << 62:
        gaps = m * n - s.astype(np.int64)
        return (gaps * gaps).sum(axis=1).tolist()
    gaps = m.astype(object) * n - s
    return (gaps * gaps).sum(axis=1).tolist()


def whitened(m: np.ndarray, model: Model) -> np.ndarray:
    """Centred rows on the components, over the root of the eigenvalues; each row by itself, so that batches do not matter."""
    centre = np.array([s / model.n for s in model.sums])
    unit = model.components / np.sqrt(model.eigenvalues)[:, None]
    return np.stack([((m - centre) * u).sum(axis=1) for u in unit], axis=1) if len(unit) else np.empty((len(m), 0))


def fit(rows: DataFrame, components: int = COMPONENTS) -> Model:
    """The model of the distinct ``x`` of ``rows``."""
    fit_list = stored(rows.select("x").distinct(), "whitening")
    d = fit_list.select(F.coalesce(F.max(F.size("x")), F.lit(0)).alias("d")).first()["d"]
    none = Model(0, [0] * d, np.empty((0, d)), np.empty(0), 0.0, 0.0)
    if not d:
        return none
    parts = fit_list.mapInArrow(lambda b: _sums(b, d), "place int, v decimal(38,0)").groupBy("place").agg(F.sum("v").cast("decimal(38,0)").alias("v"))
    sums = {r["place"]: int(r["v"]) for r in parts.collect()}
    n = sums.pop(d)
    model = Model(n, [sums[i] for i in range(d)], np.empty((0, d)), np.empty(0), 0.0, 0.0)
    both = fit_list.mapInArrow(lambda b: _scores(b, model), _SCORES).agg(F.sum("deviation").alias("exact"), F.sum("rough").alias("rough")).first()
    total = int(both["exact"] or 0) + int(both["rough"] or 0)
    if not total:
        return model
    model.variance = total / n**3
    centred = F.zip_with("x", F.array(*[F.lit(s / n) for s in model.sums]), lambda x, c: x - c)
    vectors = MLUtils.convertVectorColumnsFromML(fit_list.select(array_to_vector(centred).alias("v")), "v")
    # More than half of all values are asked for, so that MLlib takes its dense solver for any d up to 15,000.
    found = RowMatrix(vectors, n, d).computeSVD(max(min(components, d), d // 2 + 1), rCond=LEAST)
    s = found.s.toArray()[:components]
    v = found.V.toArray().T[: len(s)]
    signs = np.sign(v[np.arange(len(v)), np.abs(v).argmax(axis=1)])
    model.components, model.eigenvalues = v * signs[:, None], s * s / n
    model.identity_error = identity_error(fit_list, model)
    return model


def _scores(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        m = _matrix(b.column("x"), len(model.sums))
        found = deviations(m, model.n, model.sums)
        exact = pa.array([Decimal(v) if v < EXACT else None for v in found], pa.decimal128(38, 0))
        rough = pa.array([None if v < EXACT else float(v) for v in found], pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(whitened(m, model).tolist(), pa.list_(pa.float64())), exact, rough], ["w", "deviation", "rough"])


def identity_error(fit_list: DataFrame, model: Model) -> float:
    """The largest absolute entry of the whitened fit list's covariance, centred, less the identity."""
    k = len(model.eigenvalues)
    w = fit_list.mapInArrow(lambda b: _scores(b, model), _SCORES).select(*[F.col("w")[i].alias(f"w{i}") for i in range(k)])
    mean = w.agg(*[F.avg(c).alias(c) for c in w.columns]).first()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cov = w.agg(*[F.avg((F.col(f"w{i}") - mean[i]) * (F.col(f"w{j}") - mean[j])).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(cov, pairs))


def _rows(batches: Iterator[pa.RecordBatch], model: Model, keep: list[str]) -> Iterator[pa.RecordBatch]:
    k = len(model.eigenvalues)
    for b in batches:
        m = _matrix(b.column("x"), len(model.sums))
        exact = [v if v < 1 << 63 else None for v in deviations(m, model.n, model.sums)]
        at = pa.array(np.repeat(np.arange(len(m)), k))
        out = [b.column(c).take(at) for c in keep]
        out += [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(m))), pa.array([model.n] * (len(m) * k), pa.int64()), pa.array(exact, pa.int64()).take(at)]
        out += [pa.array(whitened(m, model).reshape(-1)), pa.array(np.tile(np.array(model.explained), len(m))), pa.array([model.identity_error] * (len(m) * k), pa.float64())]
        yield pa.RecordBatch.from_arrays(out, [*keep, "component", "n", "deviation", "whitened", "explained", "identity_error"])


def whiten(rows: DataFrame, model: Model) -> DataFrame:
    """A row for each of ``rows`` (any columns and ``x``) and component."""
    keep = [c for c in rows.columns if c != "x"]
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.drop("x").dtypes)
    return rows.mapInArrow(lambda b: _rows(b, model, keep), f"{schema}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding", ["vec_id"])
    return whiten(rows, fit(rows))
