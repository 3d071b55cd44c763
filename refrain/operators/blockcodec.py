"""Blocks of tokens as bytes, and back: the tokens of every block are packed with the block's own parameters.

A block holds, by type, its number of tokens and either their range and fixed-width differences from the minimum, or an
optimal prefix code and the coded values; and the order of types as a run of fixed-width numbers. Layout is our own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.arrowio import map_groups, map_rows
from refrain.functions.scalar import unvarint, varint
from refrain.operators.tokens import LEN, LITERAL, code_lengths

#: Types whose values get a prefix code; others are written in fixed width.
PREFIX_CODED = (LEN, LITERAL)


def pack(values: np.ndarray, width: int) -> bytes:
    """Numbers below 2**width, most significant bit first, the last byte filled up with zeros."""
    if not width or not len(values):
        return b""
    bits = (values.astype(np.uint64)[:, None] >> np.arange(width - 1, -1, -1, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel()).tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    if not width or not n:
        return np.zeros(n, np.int64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width).reshape(n, width).astype(np.int64)
    return bits @ (np.int64(1) << np.arange(width - 1, -1, -1, dtype=np.int64))


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Value -> (code, length), codes given in order of length and value."""
    out, code, before = {}, 0, 0
    for value, n in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= n - before
        out[value], before = (code, n), n
        code += 1
    return out


def encode_block(types: np.ndarray, values: np.ndarray) -> bytes:
    """One block; values are not negative."""
    present = np.unique(types)
    width = int(len(present) - 1).bit_length()
    out = [varint(len(types)), varint(len(present)), bytes(present.astype(np.uint8)), pack(np.searchsorted(present, types), width)]
    for t in present:
        v = values[types == t]
        if t in PREFIX_CODED:
            symbols, counts = np.unique(v, return_counts=True)
            lengths = code_lengths(counts.tolist())
            codes = canonical(dict(zip(symbols.tolist(), lengths, strict=True)))
            bits = "".join(format(c, f"0{n}b") for c, n in map(codes.__getitem__, v.tolist()))
            body = np.packbits(np.frombuffer(bits.encode(), np.uint8) - 48).tobytes()
            table = b"".join(varint(int(s)) + varint(n) for s, n in zip(symbols, lengths, strict=True))
            out += [varint(len(symbols)), varint(len(table)), table, varint(len(body)), body]
        else:
            low, w = int(v.min()), int(v.max() - v.min()).bit_length()
            out += [varint(low), varint(w), pack(v - low, w)]
    return b"".join(out)


def decode_block(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(types, values) of a block."""
    at = 0

    def number() -> int:
        nonlocal at
        end = at
        while data[end] > 127:
            end += 1
        value = unvarint(data[at : end + 1])[0]
        at = end + 1
        return value

    def take(n: int) -> bytes:
        nonlocal at
        at += n
        if at > len(data):
            raise ValueError("a block ends too early")
        return data[at - n : at]

    n, kinds = number(), number()
    present = np.frombuffer(take(kinds), np.uint8)
    width = int(kinds - 1).bit_length()
    types = present[unpack(take(-(-n * width // 8)), width, n)]
    values = np.zeros(n, np.int64)
    for t in present:
        where = np.flatnonzero(types == t)
        if t in PREFIX_CODED:
            symbols, size = number(), number()
            pairs = unvarint(take(size))
            codes = canonical({pairs[2 * i]: pairs[2 * i + 1] for i in range(symbols)})
            back = {(length, code): value for value, (code, length) in codes.items()}
            bits = np.unpackbits(np.frombuffer(take(number()), np.uint8)).tolist()
            found, code, length = [], 0, 0
            for bit in bits:
                code, length = code << 1 | bit, length + 1
                if (length, code) in back:
                    found.append(back[length, code])
                    code = length = 0
                    if len(found) == len(where):
                        break
            values[where] = found
        else:
            low, w = number(), number()
            values[where] = unpack(take(-(-len(where) * w // 8)), w, len(where)) + low
    return types, values


def encode_blocks(rows: DataFrame) -> DataFrame:
    """(stream_id, block_id, data) of a token table; a block is one group."""
    keyed = rows.withColumn("_key", F.concat_ws(":", "stream_id", "block_id"))

    def work(_: str, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
        data = encode_block(columns["type"].astype(np.uint8), columns["value"])
        return pa.RecordBatch.from_arrays([pa.array(columns["stream_id"][:1]), pa.array(columns["block_id"][:1]), pa.array([data], pa.binary())], ["stream_id", "block_id", "data"])

    return map_groups(keyed, "_key", ["ord", "stream_id", "block_id", "type", "value"], work, "stream_id long, block_id long, data binary")


def decode_blocks(blocks: DataFrame, block: int) -> DataFrame:
    """The token table again; ``block`` is the number of tokens of a full block. Decoding is row-local."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns: list[list] = [[], [], [], [], []]
        for stream, number, data in zip(*(batch.column(c).to_pylist() for c in ("stream_id", "block_id", "data")), strict=True):
            types, values = decode_block(data)
            n = len(types)
            for column, x in zip(columns, (np.full(n, stream), number * block + np.arange(n), np.full(n, number), types, values), strict=True):
                column.append(x)
        joined = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int8(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)).cast(k) for x, k in zip(joined, kinds, strict=True)], ["stream_id", "ord", "block_id", "type", "value"])

    return map_rows(blocks, work, "stream_id long, ord long, block_id long, type tinyint, value long")


def header_bits(rows: DataFrame, block: int) -> DataFrame:
    """(stream_id, blocks, bits): the block size once in 32 bits, a flag for each block, and the size of a last short one."""
    per = rows.groupBy("stream_id", "block_id").agg(F.count("*").alias("n"))
    wide = (block - 1).bit_length()
    return per.groupBy("stream_id").agg(F.count("*").alias("blocks"), (F.lit(32) + F.sum(F.when(F.col("n") < block, 1 + wide).otherwise(1))).cast("long").alias("bits"))
