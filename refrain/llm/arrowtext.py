"""Vectorised text primitives over Arrow string columns, shared by the operators of this subpackage.

Words are maximal runs of bytes other than the six ASCII separators (space, \\t, \\n, \\v, \\f, \\r).
UTF-8 never uses those bytes inside a character, so byte scanning gives whole words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text and rows handled at a time within an Arrow batch, whose own bytes Spark bounds (spark.sql.execution.arrow.maxBytesPerBatch).
SLICE_BYTES, SLICE_ROWS = 1 << 18, 1000
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_U = np.uint64
_STEP, _GRAM = _U(0x9E3779B97F4A7C15 | 1), _U(0xD6E8FEB86659FD93 | 1)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (the splitmix64 rounds) over an array of uint64."""
    x = x + _U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as asked for."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, _U(pow(int(base), -1, 2**64))
        self.up = self.down = np.ones(1, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up = np.cumprod(np.concatenate([np.ones(1, _U), np.full(n - 1, self.base, _U)]))
            self.down = np.cumprod(np.concatenate([np.ones(1, _U), np.full(n - 1, self.inverse, _U)]))
        return self.up, self.down


_BYTES, _WORDS = _Powers(_STEP), _Powers(_GRAM)


def window_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers = _WORDS) -> np.ndarray:
    """A 64-bit hash of values[s:e] for each pair; equal runs have equal hashes wherever they stand."""
    up, down = powers.upto(len(values) + 1)
    total = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U) * _STEP)


class Texts:
    """Some rows of a string column as bytes: row i is data[offsets[i]:offsets[i+1]]; null is empty."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self._found = None

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words in ``data``, and for each row the index of its first word (n + 1 of them)."""
        if self._found is None:
            inside = ~SEPARATOR[self.data]
            edge = np.zeros(len(self.data) + 1, bool)
            edge[1:-1] = inside[1:] != inside[:-1]
            if len(inside):
                edge[0], edge[-1] = inside[0], inside[-1]
            at = np.flatnonzero(edge)
            starts, ends = at[::2], at[1::2]
            cuts = self.offsets[1:-1]
            cuts = cuts[(cuts > 0) & (cuts < len(self.data))]
            cuts = np.unique(cuts[inside[cuts] & inside[cuts - 1]]) if len(cuts) else cuts
            if len(cuts):
                starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
            self._found = starts, ends, np.searchsorted(starts, self.offsets)
        return self._found

    def word_hashes(self, data: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word, of ``data`` (a same-length rewriting of the bytes) if given."""
        starts, ends, _ = self.words()
        return window_hashes((self.data if data is None else data).astype(_U) + _U(1), starts, ends, _BYTES)

    def row_of(self, first: np.ndarray) -> np.ndarray:
        """The row of each of first[-1] items that ``first`` assigns to rows."""
        return np.repeat(np.arange(len(self)), np.diff(first))

    def shingles(self, k: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the k-word runs, the index of each one's first word, and each row's first run (n + 1)."""
        _, _, first = self.words()
        hashes = self.word_hashes() if hashes is None else hashes
        counts = np.maximum(np.diff(first) - (k - 1), 0)
        runs = np.concatenate([[0], np.cumsum(counts)])
        at = np.arange(runs[-1]) + np.repeat(first[:-1] - runs[:-1], counts)
        return window_hashes(hashes, at, at + k), at, runs


def texts_of(column: pa.Array) -> Texts:
    """The whole column, without copying its bytes."""
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n, (valid, offsets, data) = len(column), column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(data[offsets[0] : offsets[-1]], offsets - offsets[0])


def slices(batch: pa.RecordBatch, text: str, size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """The rows of a batch in order, SLICE_ROWS or fewer at a time: together at most ``size`` bytes of text, or one row."""
    column = batch.column(batch.schema.get_field_index(text))
    if not len(column):
        return
    if column.null_count:
        column = column.fill_null("")
    whole = texts_of(column)
    at = 0
    while at < len(whole):
        to = min(max(at + 1, int(np.searchsorted(whole.offsets, whole.offsets[at] + size, "right")) - 1), at + SLICE_ROWS)
        lo, hi = whole.offsets[at], whole.offsets[to]
        yield batch.slice(at, to - at), Texts(whole.data[lo:hi], whole.offsets[at : to + 1] - lo)
        at = to


def map_texts(df: DataFrame, text: str, work: Callable[[pa.RecordBatch, Texts], pa.RecordBatch | None], schema: str, size: int = SLICE_BYTES) -> DataFrame:
    """Run ``work`` over slices of the rows of ``df``: of at most ``size`` bytes of text each, or of one longer row."""

    def run(batches):
        for batch in batches:
            for rows, texts in slices(batch, text, size):
                out = work(rows, texts)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def grouped_stream(df: DataFrame, keys: list[str], order: list[str], work: Callable[[pa.Table], pa.Table | None], schema: str) -> DataFrame:
    """Call ``work`` with the rows of each key, as one Arrow table in ``order``; rows arrive sorted, one group in memory at a time.

    Callers bound their groups (blocks of bounded rows and bytes); a row wider than a block is held whole all the same.
    Cheaper for many tiny groups than one pandas frame each.
    """

    def run(batches):
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
            new = np.zeros(batch.num_rows, bool)
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            head = tuple(c[0] for c in columns)
            if held and head != last:
                yield from finish(held)
                held = []
            bounds = [0, *np.flatnonzero(new), batch.num_rows]
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if lo and held:
                    yield from finish(held)
                    held = []
                held.append(batch.slice(lo, hi - lo))
            last = tuple(c[-1] for c in columns)
        if held:
            yield from finish(held)

    def finish(held):
        out = work(pa.Table.from_batches(held))
        if out is not None and out.num_rows:
            yield from out.to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def as_long(x: np.ndarray) -> pa.Array:
    """uint64 hashes as signed longs with the same bits."""
    return pa.array(x.astype(np.uint64).view(np.int64))
