"""Dense blocks of a distributed matrix in tasks, and sums of their products."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Numbers of a partial sum that one row holds, and bytes of a block of rows in a task.
CHUNK, BLOCK_BYTES = 4096, 64 << 20


@contextmanager
def rows_a_batch(spark: SparkSession, row_bytes: int):
    """Jobs in here get Arrow batches of about BLOCK_BYTES where rows hold long arrays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(1, min(int(before) if int(before) > 0 else 10_000, BLOCK_BYTES // max(row_bytes, 1)))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def array_block(column: pa.Array) -> np.ndarray:
    """A list column whose lists are of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def summed(rows: DataFrame, make: Callable[[np.ndarray], Callable[[pa.RecordBatch], None]], shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all rows of an array of `shape`.

    `make` runs once a task with a zeroed array and returns the function that adds a batch to it. Tasks send their sums in
    chunks, and a chunk's sums are added up where they meet, so the driver gets one array however many tasks there are.
    """
    size = int(np.prod(shape))
    parts = pa.schema([("chunk", pa.int64()), ("x", pa.list_(pa.float64()))])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(shape), False
        add = make(total)
        for batch in batches:
            if batch.num_rows:
                seen = True
                add(batch)
        flat = total.ravel()
        for at in range(0, size if seen else 0, CHUNK * 64):
            cuts = np.append(np.arange(at, min(at + CHUNK * 64, size), CHUNK), min(at + CHUNK * 64, size))
            lists = pa.ListArray.from_arrays(pa.array(cuts - at, pa.int32()), pa.array(flat[at : cuts[-1]]))
            yield pa.RecordBatch.from_arrays([pa.array(cuts[:-1] // CHUNK), lists], schema=parts)

    def added(table: pa.Table) -> pa.Table:
        x = sum(array_block(c).sum(axis=0) for c in table["x"].chunks if len(c))
        return pa.table({"chunk": table["chunk"].slice(0, 1), "x": pa.array([x], pa.list_(pa.float64()))}, schema=parts)

    schema = "chunk long, x array<double>"
    found = rows.mapInArrow(partial, schema).groupBy("chunk").applyInArrow(added, schema).toArrow()
    out = np.zeros(size)
    for chunk, x in zip(found["chunk"].to_pylist(), found["x"].to_pylist()):
        out[chunk * CHUNK : chunk * CHUNK + len(x)] = x
    return out.reshape(shape)


def keyed_blocks(batches: Iterator[pa.RecordBatch], cells: np.ndarray, means: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(keys, block) from (key, cell, value) batches sorted by key: a row of a block is what a key's values differ from the means
    of their cells, 0 where there is none. Blocks are bounded, a key's rows may come in any number of batches."""
    at_once = max(1, BLOCK_BYTES // (8 * max(len(cells), 1)))
    keys, block, kind = [], np.zeros((at_once, len(cells))), None
    for batch in batches:
        cell, value, kind = batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False), batch.column(0).type
        runs = pc.run_end_encode(batch.column(0))
        start = 0
        for end, key in zip(runs.run_ends.to_pylist(), runs.values.to_pylist()):
            if not keys or key != keys[-1]:
                if len(keys) == at_once:
                    yield pa.array(keys, kind), block
                    keys, block = [], np.zeros_like(block)
                keys.append(key)
            place = np.searchsorted(cells, cell[start:end])
            np.add.at(block[len(keys) - 1], place, np.nan_to_num(value[start:end] - means[place]))
            start = end
    if keys:
        yield pa.array(keys, kind), block[: len(keys)]
