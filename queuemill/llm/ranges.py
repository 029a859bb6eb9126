"""Groups read in order, without gathering a large one in a task.

Rows are sorted by (key, order) over the whole table and cut into ranges of bounded size. A group that lies inside one range is
whole there. The first and the last group of a range may go on in its neighbours: their rows are handed on with the number of the
range (`piece`) and their place in it (`pos`), and the caller joins the pieces by DataFrame operations. A group that holds a third
of all rows is just many pieces.
"""

from __future__ import annotations

import math
from typing import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGE_BYTES = 16 << 20      # payload of a range


def in_ranges(df: DataFrame, keys: list, size: Column) -> DataFrame:
    """Sorted by `keys`, nulls first, and cut into ranges of about RANGE_BYTES of `size`."""
    total = df.agg(F.sum(size)).first()[0] or 0
    count = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(total / RANGE_BYTES))
    return df.repartitionByRange(count, *keys).sortWithinPartitions(*keys)


def groups(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[tuple[object, pa.Table, bool]]:
    """(key, rows, whether the group is surely whole) for every run of equal keys in the sorted batches of a range."""
    held, held_key, first = [], None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_pylist()
        starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for low, high in zip(starts, starts[1:]):
            if held and held_key != keys[low]:
                yield held_key, pa.Table.from_batches(held), not first
                held, first = [], False
            held_key = keys[low]
            held.append(batch.slice(low, high - low))
    if held:
        yield held_key, pa.Table.from_batches(held), False


def this_piece() -> int:
    """Ranges are numbered in their order."""
    return TaskContext.get().partitionId()


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)
