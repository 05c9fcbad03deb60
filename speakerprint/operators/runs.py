"""Streaming over key-sorted partitions: many small groups per Arrow batch, any group size.

A grouped-map call per key costs about a millisecond, too much for millions of small
speakers. Here rows are hash-partitioned by key and sorted inside partitions (both by Spark)
and one call per partition walks the runs of equal keys, holding one accumulator.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Result rows gathered into one output batch.
EMIT_ROWS = 64


def key_runs(batch: pa.RecordBatch, keys: Sequence[str]) -> Iterator[tuple[tuple, int, int]]:
    """(key values, start, stop) of every run of equal keys in a batch."""
    n = batch.num_rows
    if not n:
        return
    change = np.zeros(n - 1, dtype=bool)
    for k in keys:
        column = batch.column(k)
        change |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    starts = [0, *(np.flatnonzero(change) + 1).tolist()]
    for start, stop in zip(starts, [*starts[1:], n]):
        yield tuple(batch.column(k)[start].as_py() for k in keys), start, stop


def fold_runs(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    prepare: Callable[[pa.RecordBatch], object],
    new: Callable[[], object],
    add: Callable[[object, object, int, int], None],
    emit: Callable[[list[tuple], list[object]], list[pa.Array]],
    emit_names: Sequence[str],
    emit_schema: str,
    step: int,
) -> DataFrame:
    """Fold the rows of each key into one row ``keys + emit_names``.

    ``prepare`` decodes a slice of at most ``step`` rows, ``add`` folds rows [start, stop) of
    it into an accumulator made by ``new``, ``emit`` turns finished accumulators into columns.
    Key columns must not be null.
    """
    keys = list(keys)
    names = [*keys, *emit_names]
    head = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    placed = df.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, acc, done_keys, done, types = None, None, [], [], None

        def flush() -> pa.RecordBatch:
            key_arrays = [pa.array([k[i] for k in done_keys], type=types[i]) for i in range(len(keys))]
            out = pa.RecordBatch.from_arrays(key_arrays + emit(done_keys, done), names=names)
            done_keys.clear()
            done.clear()
            return out

        for whole in batches:
            types = [whole.schema.field(k).type for k in keys]
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                data = prepare(batch)
                for key, start, stop in key_runs(batch, keys):
                    if key != current:
                        if acc is not None:
                            done_keys.append(current)
                            done.append(acc)
                            if len(done) >= EMIT_ROWS:
                                yield flush()
                        current, acc = key, new()
                    add(acc, data, start, stop)
        if acc is not None:
            done_keys.append(current)
            done.append(acc)
            yield flush()

    return placed.mapInArrow(walk, f"{head}, {emit_schema}")
