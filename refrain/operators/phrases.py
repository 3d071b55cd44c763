"""Phrase tables: what every parser returns and every decoder reads.

stream_id, window_id, seq (over the whole stream), kind ('lit', 'ref' a copy from dist bytes back, 'node' a dictionary
entry with the letter after it, 'trie' a dictionary entry alone), pos (from the stream's start), len (bytes covered, the
letter included), dist, node, literal (0 to 255, null where there is none).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SCHEMA = "stream_id long, window_id int, seq long, kind string, pos long, len long, dist long, node long, literal smallint"
_ARROW = pa.schema([("stream_id", pa.int64()), ("window_id", pa.int32()), ("seq", pa.int64()), ("kind", pa.string()), ("pos", pa.int64()), ("len", pa.int64()), ("dist", pa.int64()), ("node", pa.int64()), ("literal", pa.int16())])
KINDS = ("lit", "ref", "node", "trie")
LIT, REF, NODE, TRIE = range(4)


class Phrases:
    """Collects phrases of several streams as columns, one by one or many at a time. Absent numbers are -1 and become null."""

    def __init__(self):
        self.flat: list[int] = []  # nine numbers a phrase
        self.blocks: list[np.ndarray] = []  # finished phrases, a row of numbers for each column
        self.stream = self.window = self.seq = self.pos = 0

    def start(self, stream: int) -> None:
        self.stream, self.window, self.seq, self.pos = stream, 0, 0, 0

    def add(self, kind: int, length: int, dist: int = -1, node: int = -1, literal: int = -1) -> None:
        self.flat += (self.stream, self.window, self.seq, kind, self.pos, length, dist, node, literal)
        self.seq += 1
        self.pos += length

    def add_all(self, kind, length: np.ndarray, dist=-1, node=-1, literal=-1) -> None:
        """Phrases that follow each other; everything but the lengths may be one number for all."""
        n = len(length)
        if not n:
            return
        self._close()
        block = np.empty((9, n), np.int64)
        block[0], block[1], block[2], block[3], block[5], block[6], block[7], block[8] = self.stream, self.window, np.arange(self.seq, self.seq + n), kind, length, dist, node, literal
        block[4, 0], block[4, 1:] = self.pos, self.pos + np.cumsum(length[:-1])
        self.blocks.append(block)
        self.seq += n
        self.pos += int(length.sum())

    def _close(self) -> None:
        if self.flat:
            self.blocks.append(np.array(self.flat, np.int64).reshape(-1, 9).T)
            self.flat = []

    @property
    def columns(self) -> np.ndarray:
        """A row of numbers for each column of the table."""
        self._close()
        return np.concatenate([np.zeros((9, 0), np.int64), *self.blocks], axis=1)

    def batch(self) -> pa.RecordBatch:
        arrays = []
        for f, x in zip(_ARROW, self.columns, strict=True):
            if f.name == "kind":
                arrays.append(pa.DictionaryArray.from_arrays(pa.array(x.astype(np.int8)), pa.array(KINDS)).cast(pa.string()))
            elif f.name in ("dist", "node", "literal"):
                arrays.append(pa.array(x, mask=x < 0).cast(f.type))
            else:
                arrays.append(pa.array(x).cast(f.type))
        return pa.RecordBatch.from_arrays(arrays, schema=_ARROW)


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column as numbers; absent ones are -1, kinds their places in KINDS."""
    column = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_string(column.type):
        column = pc.index_in(column, value_set=pa.array(KINDS))
    return column.fill_null(-1).to_numpy().astype(np.int64)


def copy(out: bytearray, dist: int, length: int) -> None:
    """Append ``length`` bytes from ``dist`` back; source and target may overlap."""
    at = len(out) - dist
    if dist >= length:
        out += out[at : at + length]
    else:
        unit = bytes(out[at:])
        out += (unit * (length // dist + 1))[:length]


def decoded(stream: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([stream], pa.int64()), pa.array([bytes(data)], pa.binary())], ["stream_id", "bytes"])


DECODED = "stream_id long, bytes binary"
