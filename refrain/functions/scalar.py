"""Column functions: substring fingerprints, bit widths, varint sizes, and the varint codec."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the rolling fingerprint: base, and the Mersenne prime 2**61 - 1.
BASE, PRIME = 257, (1 << 61) - 1


def fingerprint_push(h: Column, c: Column) -> Column:
    """(h * 257 + c) mod 2**61 - 1 within 64 bits: 256 h is a rotation of 61 bits."""
    turned = F.shiftleft(h.bitwiseAND(F.lit((1 << 53) - 1)), 8).bitwiseOR(F.shiftright(h, 53))
    return (turned + h + c) % F.lit(PRIME)


def fingerprint(data: Column) -> Column:
    """Rolling fingerprint of a binary column, byte by byte; 0 for empty input, null for null."""
    n = F.octet_length(data)
    byte = lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long")
    fold = F.aggregate(F.sequence(F.lit(1), n), F.lit(0).cast("long"), lambda h, i: fingerprint_push(h, byte(i)))
    return F.when(n > 0, fold).when(n == 0, F.lit(0).cast("long"))


def fingerprint_of(data: bytes) -> int:
    """The same in Python."""
    h = 0
    for c in data:
        h = (h * BASE + c) % PRIME
    return h


def bit_width(x: Column) -> Column:
    """Bits to write x >= 0; 0 needs none."""
    return F.when(x == 0, F.lit(0)).otherwise(F.length(F.bin(x))).cast("int")


def universe_width(low: Column, high: Column) -> Column:
    """Bits to write a number known to lie in [low, high]."""
    return bit_width(high - low)


def ceil_div(a: Column, b: Column | int) -> Column:
    b = b if isinstance(b, Column) else F.lit(b)
    return F.floor((a + b - 1) / b).cast("long")


def varint_size(x: Column) -> Column:
    """Bytes of x >= 0 written seven bits at a time; 0 needs one."""
    return F.ceil(F.length(F.bin(x)) / 7).cast("int")


def varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def unvarint(data: bytes) -> list[int]:
    """All numbers of a run of varints; an unfinished last one is left out."""
    out, value, shift = [], 0, 0
    for b in data:
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            out.append(value)
            value = shift = 0
    return out


def varint_encode(values: Column) -> Column:
    """An array of non-negative numbers as one run of varints."""

    @F.pandas_udf("binary")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda xs: None if xs is None else b"".join(varint(int(x)) for x in xs))

    return run(values)


def varint_decode(data: Column) -> Column:
    @F.pandas_udf("array<long>")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else unvarint(x))

    return run(data)
