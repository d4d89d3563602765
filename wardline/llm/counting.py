"""Sums of fixed-size count tables over all partitions of a frame.

A task keeps one dense table, whose size is a parameter, and hands on its
non-zero cells by ranges of the table; ranges are then summed apart from each
other in tables of the range's size.  What is shuffled grows with the number
of tasks and never beyond their tables; the result has a fixed size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wardline.llm.common import Batches, emit, partition_count, sorted_runs

RANGE = 1 << 16

_PART = pa.schema([("part", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())])
_DDL = "part int, cells binary, counts binary"


def table_sums(df: DataFrame, add: Callable[[pa.RecordBatch, np.ndarray], None], size: int) -> np.ndarray:
    """The sum over all rows of what ``add(batch, table)`` adds to a table of ``size`` longs."""
    def count(batches: Batches) -> Batches:
        table = np.zeros(size, np.int64)
        for batch in batches:
            if batch.num_rows:
                add(batch, table)
        for part, first in enumerate(range(0, size, RANGE)):
            cells = np.flatnonzero(table[first : first + RANGE])
            if len(cells):
                yield emit(_PART, part=[part], cells=[cells.astype(np.uint16).tobytes()], counts=[table[first + cells].tobytes()])

    def total(batches: Batches) -> Batches:
        part, table = None, np.zeros(RANGE, np.int64)

        def out():
            cells = np.flatnonzero(table)
            return emit(_PART, part=[part], cells=[cells.astype(np.uint16).tobytes()], counts=[table[cells].tobytes()])

        for run in sorted_runs(batches, ["part"]):
            for at, cells, counts in zip(*(run[c].to_pylist() for c in _PART.names), strict=True):
                if part is not None and at != part:
                    yield out()
                    table[:] = 0
                part = at
                table[np.frombuffer(cells, np.uint16)] += np.frombuffer(counts, np.int64)
        if part is not None:
            yield out()

    parts = df.mapInArrow(count, _DDL).repartition(min(partition_count(df), -(-size // RANGE)), "part")
    result = np.zeros(-(-size // RANGE) * RANGE, np.int64)
    for row in parts.sortWithinPartitions("part").mapInArrow(total, _DDL).toLocalIterator():  # size cells at most
        result[row["part"] * RANGE + np.frombuffer(row["cells"], np.uint16).astype(np.int64)] = np.frombuffer(row["counts"], np.int64)
    return result[:size]
