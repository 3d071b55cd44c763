"""Row-wise and group-wise Python operators over Arrow batches, whose bytes Spark bounds (spark.sql.execution.arrow.maxBytesPerBatch)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.operators.phrases import numbers

#: Most rows that are packed as one, and rows and bytes of results that are collected for a batch.
RUN, RESULTS, RESULT_BYTES = 1 << 20, 256, 4 << 20


def map_rows(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = 256) -> DataFrame:
    """Run ``work`` on batches of at most ``rows`` rows, where they lie: no shuffle."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield work(batch.slice(at, rows))

    out = df.mapInArrow(run, schema)
    out._refrain_rows = (df, run)
    return out


def _narrow(x: np.ndarray) -> np.ndarray:
    low, high = int(x.min()), int(x.max())
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _pack(batch: pa.RecordBatch, key: str, columns: list[str]) -> pa.RecordBatch:
    """(key, number of the first row in the first column, packed numbers) of each run of rows with one key."""
    keys = batch.column(batch.schema.get_field_index(key))
    plain = np.array(keys.to_pylist(), object) if keys.null_count else keys.to_numpy(zero_copy_only=False)
    bounds = [0, *(np.flatnonzero(plain[1:] != plain[:-1]) + 1).tolist(), batch.num_rows]
    runs = [(at, min(at + RUN, hi)) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True) for at in range(lo, hi, RUN)]
    given = [numbers(batch, c) for c in columns]
    values = [_narrow(x) for x in given]
    head = bytes(x.itemsize for x in values)
    begin = np.array([lo for lo, _ in runs])
    data = [head + b"".join([x[lo:hi].tobytes() for x in values]) for lo, hi in runs]
    return pa.RecordBatch.from_arrays([keys.take(pa.array(begin)), pa.array(given[0][begin]), pa.array(data, pa.binary())], ["key", "first", "data"])


def _unpack(runs: list[bytes], columns: list[str]) -> dict[str, np.ndarray]:
    """The numbers of a group by column, ordered by the first."""
    parts: list[list[np.ndarray]] = [[] for _ in columns]
    for data in runs:
        at, widths = len(columns), data[: len(columns)]
        n = (len(data) - at) // sum(widths)
        for part, width in zip(parts, widths, strict=True):
            part.append(np.frombuffer(data, f"i{width}", n, at).astype(np.int64))
            at += n * width
    out = [x[0] if len(x) == 1 else np.concatenate(x) for x in parts]
    if (out[0][1:] < out[0][:-1]).any():
        order = np.argsort(out[0], kind="stable")
        out = [x[order] for x in out]
    return dict(zip(columns, out, strict=True))


def map_groups(df: DataFrame, key: str, columns: list[str], work: Callable[[object, dict[str, np.ndarray]], pa.RecordBatch], schema: str) -> DataFrame:
    """Run ``work`` on each key and the rows it has: ``columns`` as numbers, -1 where absent, ordered by the first.

    One shuffle by key, one group in memory at a time. Neighbouring rows with one key are packed into one before the
    shuffle, at once where ``map_rows`` makes them.
    """
    made = None if df.is_cached else getattr(df, "_refrain_rows", None)
    source, rows = made or (df.select(key, *columns), iter)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches):
            if batch.num_rows:
                yield _pack(batch, key, columns)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[bytes]]]:
        held: list[bytes] = []
        last = None
        for batch in batches:
            for own, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and own != last:
                    yield last, held
                    held = []
                last = own
                held.append(data)
        if held:
            yield last, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[pa.RecordBatch] = []
        count = size = 0
        for own, runs in groups(batches):
            done.append(work(own, _unpack(runs, columns)))
            count += done[-1].num_rows
            size += done[-1].nbytes
            if count >= RESULTS or size >= RESULT_BYTES:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                done, count, size = [], 0, 0
        if done:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()

    kind = df.schema[key].dataType.simpleString()
    packed = source.mapInArrow(pack, f"key {kind}, first long, data binary")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number of its own: few packed bytes may be much work, so they must not be coalesced
    return packed.repartition(parts, "key").sortWithinPartitions("key", "first").select(F.col("key"), F.col("data")).mapInArrow(run, schema)
