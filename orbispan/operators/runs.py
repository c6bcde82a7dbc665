"""Many small groups in one task: functions over runs of equal integer keys within sorted partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orbispan.shipping import ship


#: Rows of many groups that travel back together.
BATCH_ROWS = 8192


def key_runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Split sorted batches into (key, rows) runs over the first n_keys integer columns; only one run is held."""
    held: list[pa.RecordBatch] = []
    held_key: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            key = tuple(keys[lo].tolist())
            if held and key != held_key:
                yield held_key, pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield held_key, pa.Table.from_batches(held)


def map_runs(df: DataFrame, keys: list[str], fn: Callable[[tuple, pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply fn to each group of equal integer keys. Thousands of tiny groups share one Python task and its batches."""
    n = len(keys)
    rest = [c for c in df.columns if c not in keys]
    ship(df.sparkSession)

    def run(batches):
        held, count = [], 0
        for key, rows in key_runs(batches, n):
            out = fn(key, rows)
            if out is not None and out.num_rows:
                held.append(out)
                count += out.num_rows
            if count >= BATCH_ROWS:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, count = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return df.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
