"""A scan of a history in order: each row against the one before it, in one sorted pass over ranges.

The history is dealt out by ranges of (key, order), so it is shuffled once and a key with very many rows lies in many tasks. A task goes
through its range and keeps the rows whose state differs from the row before. Only for the first row of a range is that row elsewhere: it
is the last row of the range before. So each range hands out its first and its last row, and the firsts are judged
among these few, two for each range.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut

#: What a row is handed out as: changed, the first of its range (not judged yet), the last of its range.
CHANGED, FIRST, LAST = 0, 1, 2


def _differing(table: pa.Table, columns: list[str]) -> pa.ChunkedArray:
    """For each place but the first whether any column differs from the place before; nulls are equal."""
    out = None
    for c in columns:
        # Where just one of two is null, the comparison is null and the place of the nulls decides.
        now, before = table.column(c).slice(1), table.column(c).slice(0, table.num_rows - 1)
        one = pc.xor(pc.is_null(now), pc.is_null(before))
        other = pc.fill_null(pc.not_equal(now, before), False)
        either = pc.or_(one, other)
        out = either if out is None else pc.or_(out, either)
    return out


def _scan(batches: Iterator[pa.RecordBatch], state: list[str]) -> Iterator[pa.RecordBatch]:
    last = None

    def handed(rows: pa.Table, kind: int) -> Iterator[pa.RecordBatch]:
        return iter(rows.append_column("__kind", pa.array([kind] * rows.num_rows, pa.int32())).combine_chunks().to_batches())

    for b in batches:
        if not b.num_rows:
            continue
        rows = pa.Table.from_batches([b])
        if last is None:
            yield from handed(rows.slice(0, 1), FIRST)
            chain = rows
        else:
            chain = pa.concat_tables([last, rows])
        if chain.num_rows > 1:
            yield from handed(chain.slice(1).filter(_differing(chain, state)), CHANGED)
        last = rows.slice(rows.num_rows - 1, 1)
    if last is not None:
        yield from handed(last, LAST)


def differing_in_order(rows: DataFrame, key: str, state: list[str], order: list[str]) -> DataFrame:
    """Rows whose ``state`` differs from that of the row before them, by ``order``, of the same key; the first of a key is one.

    Nulls are values like others, in the key and in the state. Rows that are equal in key and order come in the order of their state.
    """
    sort = [key, *order, *[c for c in state if c not in order]]
    ranged = rows.repartitionByRange(*sort).sortWithinPartitions(*sort)
    compared = [key, *state]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    marked = cut(ranged.mapInArrow(lambda b: _scan(b, compared), f"{kinds}, __kind int"))
    # Two rows for each range: their order is that of the ranges.
    ends = marked.where(F.col("__kind") != CHANGED)
    before = F.lag(F.struct(*compared)).over(Window.partitionBy(F.lit(0)).orderBy(*sort, "__kind"))
    first = ends.withColumn("__before", before).where((F.col("__kind") == FIRST) & ~F.col("__before").eqNullSafe(F.struct(*compared))).drop("__before")
    return marked.where(F.col("__kind") == CHANGED).unionByName(first).drop("__kind")
