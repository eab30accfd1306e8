"""What the operators of this subpackage share: shared storage, hashing, sampling.

Conventions that hold for every operator here:

* an operator reads only the columns it is given by name, so further columns
  of any name do not matter;
* a null text counts as an empty text, a null id is an ordinary value;
* repeated rows are judged row by row (an operator says so where it groups them).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import own_folder

#: Rows of one Arrow batch. Texts may be long, so batches are kept short.
BATCH_ROWS = 256

_TO_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32
    for c in range(256)
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what one Arrow batch of texts can hold (a session setting)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives
    lost executors, and is removed when the driver's JVM ends."""
    spark = df.sparkSession
    path = own_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lower_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def plain_words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and bytes from 0x80, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split() if text else []


class WordHashes(dict):
    """64-bit hashes of words, remembered for up to ``limit`` words."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit values."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return h[:0]
    out = h[:n].copy()
    for i in range(1, k):
        out = out * np.uint64(0x100000001B3) + h[i : i + n]
    return mixed(out)


def by_bytes(texts: Iterable[str | None], most: int) -> Iterator[list[bytes]]:
    """The texts as UTF-8, in runs of about ``most`` bytes."""
    run: list[bytes] = []
    size = 0
    for t in texts:
        b = (t or "").encode("utf-8", "surrogatepass")
        if run and size + len(b) > most:
            yield run
            run, size = [], 0
        run.append(b)
        size += len(b)
    if run:
        yield run


def fresh(name: str, taken: list[str]) -> str:
    """A column name that is not among ``taken``."""
    have = {t.lower() for t in taken}
    while name.lower() in have:
        name = "_" + name
    return name


def remainder(id_col: str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by`` (null for a null id)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % by


def share_bound(rows: int, at_most: int) -> int:
    """The signed 64-bit hash below which about ``at_most`` of ``rows`` hashes lie."""
    return min(-(1 << 63) + (1 << 64) * at_most // max(rows, 1), (1 << 63) - 1)


def bounded_share(df: DataFrame, at_most: int, *by: str) -> DataFrame:
    """About ``at_most`` rows, chosen by a 64-bit hash of the columns ``by``: the same ones on every run.

    Rows equal in ``by`` count once, so many copies of a row (or many null ids, as long as a
    text is among the columns) are no more than one row. Never empty because of the size of ``df``.
    """
    rows = df.count()
    if rows > at_most:
        df = df.where(F.xxhash64(*by, F.lit(7)) < F.lit(share_bound(rows, at_most)).cast("long"))
    return df.dropDuplicates(list(by))
