"""Standing tables: repeated and interrupted batches, untouched parts; name search through trigrams."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from oficina.operators import prices, search
from oficina.sources import tables

NOW = "seq long, store_id int, store_sku string, listing_id long, product_id long, price_cash double, in_stock boolean, thumbnail string, day date"
OVER, FILL = ["listing_id", "product_id", "price_cash", "in_stock"], ["thumbnail"]
HISTORY = "seq long, store_id int, store_sku string, listing_id long, product_id long, price_cash double, in_stock boolean, thumbnail string, day date, batch long"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def state(spark, folder):
    history = sorted(map(repr, (tuple(r) for r in spark.read.schema(HISTORY).parquet(f"{folder}/history").collect())))
    listings = sorted(repr(tuple(r)) for r in spark.read.parquet(f"{folder}/listings").select(*tables.KEYS, *OVER, *FILL).collect())
    daily = sorted(repr((r.product_id, str(r.day), r.min_price, r.listing_id)) for r in spark.read.parquet(f"{folder}/daily").collect())
    return history, listings, daily


def batches(n=3):
    rng = random.Random(4)
    out = []
    for b in range(n):
        rows = []
        for i in range(40):
            k = rng.randrange(30)
            rows.append((b * 100 + i, k % 2, f"s{k}", k, k // 3, rng.choice([None, 1.0, 2.0, 3.0]), rng.random() < 0.8, rng.choice([None, f"t{b}"]), dt.date(2024, 1, 1 + b + rng.randrange(2))))
        out.append(rows)
    return out


def write(spark, folder, b, rows):
    df = spark.createDataFrame(rows, NOW)
    tables.write_batch(folder, b, df, df, spark.createDataFrame([], HISTORY).schema, OVER, FILL, parts=8)


def test_batches_equal_the_sequential_version(spark, tmp_path):
    listings, all_rows = {}, []
    for b, rows in enumerate(batches()):
        write(spark, str(tmp_path), b, rows)
        all_rows += [(*r, b) for r in rows]
        last = {}
        for r in rows:
            last[r[1], r[2]] = r
        for key, r in last.items():
            old = listings.get(key)
            listings[key] = (*key, *r[3:7], old[6] if old and old[6] is not None else r[7])
    history, got, daily = state(spark, str(tmp_path))
    assert got == sorted(map(repr, listings.values()))
    assert history == sorted(map(repr, all_rows))
    best = {}
    for r in all_rows:
        if r[6] and r[5] is not None and r[5] > 0:
            key = (r[4], str(r[8]))
            best[key] = min(best.get(key, (9.0, 99)), (r[5], r[3]))
    assert daily == sorted(repr((*k, *v)) for k, v in best.items())


def test_a_batch_again_changes_nothing(spark, tmp_path):
    for b, rows in enumerate(batches()):
        write(spark, str(tmp_path), b, rows)
    before = state(spark, str(tmp_path))
    write(spark, str(tmp_path), 2, batches()[2])
    assert state(spark, str(tmp_path)) == before


@pytest.mark.parametrize("step", ["write_daily", "write_listings"])
def test_an_interrupted_batch_is_run_again(spark, tmp_path, monkeypatch, step):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    for n, rows in enumerate(batches()):
        write(spark, a, n, rows)
    for n, rows in enumerate(batches()[:2]):
        write(spark, b, n, rows)

    def broken(*args, **kwargs):
        raise OSError("interrupted")

    with monkeypatch.context() as m:
        m.setattr(tables, step, broken)
        with pytest.raises(OSError):
            write(spark, b, 2, batches()[2])
    write(spark, b, 2, batches()[2])
    assert state(spark, a) == state(spark, b)


def test_only_touched_parts_are_written(spark, tmp_path):
    for n, rows in enumerate(batches()):
        write(spark, str(tmp_path), n, rows)
    before = files(tmp_path)
    write(spark, str(tmp_path), 9, [(900, 0, "s4", 4, 1, 7.0, True, None, dt.date(2024, 2, 1))])
    after = files(tmp_path)
    gone = {os.path.dirname(f) for f in before if f not in after}
    new = {os.path.dirname(f) for f in after if f not in before}
    assert len(gone) == 1 and "listings/part=" in next(iter(gone))
    assert {os.path.relpath(d, tmp_path).split("/")[0] for d in new} == {"listings", "history", "daily"} and len(new) == 3


def test_an_empty_batch_and_retention(spark, tmp_path):
    folder = str(tmp_path)
    for n, rows in enumerate(batches()):
        write(spark, folder, n, rows)
    before = state(spark, folder)
    tables.write_batch(folder, 5, spark.createDataFrame([], NOW), spark.createDataFrame([], NOW), spark.createDataFrame([], HISTORY).schema, OVER, FILL, parts=8)
    assert state(spark, folder) == before
    assert tables.drop_days(spark, f"{folder}/history", "2024-01-03") == ["day=2024-01-01", "day=2024-01-02"]
    assert {r.day for r in spark.read.schema(HISTORY).parquet(f"{folder}/history").collect()} == {dt.date(2024, 1, 3), dt.date(2024, 1, 4)}
    assert tables.drop_days(spark, f"{folder}/nothing", "2024-01-03") == []


def test_search_equals_ilike(spark):
    rng = random.Random(8)
    words = ["Ryzen 7", "RTX 4070", "água", "ÁGUA", "50%", "a_b", "Ti", "x", "", "Super  Ti", "back\\slash"]
    rows = [(i, None if i % 17 == 0 else " ".join(rng.choices(words, k=rng.randrange(4)))) for i in range(200)]
    df = spark.createDataFrame(rows, "product_id long, name string")
    index = search.postings(df).cache()
    for query in ["rtx", "RYZEN 7", "tx 4", "7 rtx", "ti", "x", "", "água", "50\\%", "a\\_b", "r%zen", "rtx%ti", "a_b", "4070%super", "zzz", "%", "_", "back\\\\slash"]:
        want = sorted(r.product_id for r in df.where(F.col("name").ilike(f"%{query}%")).collect())
        assert sorted(r.product_id for r in search.named(df, index, query).collect()) == want, query


def test_runs():
    assert search.runs("Ab%cd_e\\%f") == ["ab", "cd", "e%f"] and search.trigrams("abcd%bcde") == ["abc", "bcd", "cde"] and search.trigrams("ab%c") == []


def test_retained_days(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2023, 1, 1),)], "day date")
    raw, daily = prices.retained(df, df, F.lit(dt.date(2024, 2, 1)))
    assert raw.count() == 1 and daily.count() == 2
