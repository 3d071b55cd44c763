"""Token tables of phrase tables, and what coding them in blocks would cost.

tokens: stream_id, ord, block_id, type, value. A block holds ``block`` tokens of a stream, of all types together; each
type in a block has its own parameters. Costs are model bits: what the numbers need, not a file's bytes.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refrain.arrowio import map_groups, map_rows
from refrain.functions.scalar import bit_width
from refrain.operators.phrases import LIT, REF
from refrain.operators.phrases import NODE as WITH_NODE

#: Token types.
LEN, SRC, LITERAL, REMAINDER, NODE = range(5)
#: Fixed value: the longest length that is one token where long lengths are split.
LONG = 255


def tokens(phrases: DataFrame, block: int = 32 << 10, split_long: bool = False, hybrid: bool = False) -> DataFrame:
    """Tokens in coding order: a length (0 for a literal, or with ``hybrid`` 1, and 0 for a dictionary reference), then what it needs.

    With ``split_long`` a length of LONG or more is LONG and a remainder. Dictionary phrases of an LZ78 parse are a node
    and a literal, a last one a node.
    """

    def work(stream: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
        kind, size, dist, node, literal = (columns[c] for c in ("kind", "len", "dist", "node", "literal"))
        lit, ref, both = kind == LIT, kind == REF, kind == WITH_NODE
        entry = ~lit & ~ref
        long = ref & (size >= LONG) if split_long else np.zeros(len(kind), bool)
        head = ~entry | (~both if hybrid else False)  # begins with a length
        types, values = np.full((len(kind), 4), -1, np.int8), np.zeros((len(kind), 4), np.int64)
        types[head, 0], values[:, 0] = LEN, np.where(lit, int(hybrid), np.where(long, LONG, np.where(ref, size, 0)))
        types[long, 1], values[:, 1] = REMAINDER, size - LONG
        types[ref, 2], types[entry, 2], values[:, 2] = SRC, NODE, np.where(ref, dist, node)
        types[lit | both, 3], values[:, 3] = LITERAL, literal
        kept = types >= 0
        value, ord_ = values[kept], np.arange(kept.sum())
        arrays = [pa.array(np.full(len(value), stream)), pa.array(ord_), pa.array(ord_ // block), pa.array(types[kept]), pa.array(value, mask=value < 0)]
        return pa.RecordBatch.from_arrays(arrays, ["stream_id", "ord", "block_id", "type", "value"])

    return map_groups(phrases, "stream_id", ["seq", "kind", "len", "dist", "node", "literal"], work, "stream_id long, ord long, block_id long, type tinyint, value long")


def block_ranges(rows: DataFrame) -> DataFrame:
    """(stream_id, block_id, type, n, min, max, avg, stddev) of each type that a block has."""
    return rows.groupBy("stream_id", "block_id", "type").agg(
        F.count("*").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.round(F.avg("value"), 6).alias("avg"), F.round(F.stddev_samp("value"), 6).alias("stddev")
    )


def binary_costs(rows: DataFrame, largest: DataFrame | None = None) -> DataFrame:
    """(stream_id, block_id, type, n, header_bits, data_bits): numbers in [min, max] of their block, which the header gives.

    The header writes min within [0, top] and max within [min, top], top being the type's maximum in the stream, and is
    empty where top is at most 1; values then take one bit each.
    """
    ranges = block_ranges(rows)
    within = F.max("max").over(Window.partitionBy("stream_id", "type"))
    joined = ranges.withColumn("top", within) if largest is None else ranges.join(largest, ["stream_id", "type"])
    plain = F.col("top") <= 1
    header = F.when(plain, 0).otherwise(bit_width(F.col("top")) + bit_width(F.col("top") - F.col("min")))
    data = F.when(plain, F.col("n")).otherwise(F.col("n") * bit_width(F.col("max") - F.col("min")))
    return joined.select("stream_id", "block_id", "type", "n", header.cast("long").alias("header_bits"), data.cast("long").alias("data_bits"))


def code_lengths(counts: list[int]) -> list[int]:
    """Lengths of an optimal prefix code; a lone symbol takes one bit."""
    if len(counts) < 2:
        return [1] * len(counts)
    heap = [(n, i, (i,)) for i, n in enumerate(counts)]
    heapq.heapify(heap)
    lengths = [0] * len(counts)
    while len(heap) > 1:
        a, i, left = heapq.heappop(heap)
        b, _, right = heapq.heappop(heap)
        for s in left + right:
            lengths[s] += 1
        heapq.heappush(heap, (a + b, i, left + right))
    return lengths


def huffman_costs(rows: DataFrame) -> DataFrame:
    """(stream_id, block_id, type, n, symbols, data_bits): an optimal prefix code for each type of each block.

    Values are counted before anything is grouped, so a group has one row for each different value.
    """
    counts = rows.groupBy("stream_id", "block_id", "type", "value").agg(F.count("*").alias("c"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        c = pdf["c"].tolist()
        head = pdf.iloc[0]
        return pd.DataFrame([[head["stream_id"], head["block_id"], head["type"], sum(c), len(c), sum(n * w for n, w in zip(c, code_lengths(c), strict=True))]], columns=["stream_id", "block_id", "type", "n", "symbols", "data_bits"])

    return counts.groupBy("stream_id", "block_id", "type").applyInPandas(work, "stream_id long, block_id long, type tinyint, n long, symbols long, data_bits long")


def entropy(rows: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """(by..., n, symbols, entropy_bits): the least bits any code of single values needs, rounded to 6 places."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("c"))
    agg = [F.sum("c").alias("n"), F.count("*").alias("symbols"), F.sum(F.col("c") * F.log2("c")).alias("s")]
    out = counts.groupBy(*by).agg(*agg) if by else counts.agg(*agg)
    return out.select(*by, "n", "symbols", F.round(F.col("n") * F.log2("n") - F.col("s"), 6).alias("entropy_bits"))


def byte_counts(streams: DataFrame) -> DataFrame:
    """(byte, n) over all ``bytes``: counted where the rows lie, so that no more than 256 numbers leave a batch."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = np.zeros(256, np.int64)
        for data in batch.column("bytes").to_pylist():
            n += np.bincount(np.frombuffer(data or b"", np.uint8), minlength=256)
        at = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["byte", "n"])

    return map_rows(streams.select("bytes"), work, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n"))


def cost_rollup(costs: DataFrame) -> DataFrame:
    """(type, n, header_bits, data_bits) of each type, and of all with a null type."""
    return costs.rollup("type").agg(F.sum("n").alias("n"), F.sum("header_bits").alias("header_bits"), F.sum("data_bits").alias("data_bits"))


def histogram(rows: DataFrame, value: str = "value") -> DataFrame:
    return rows.groupBy(value).agg(F.count("*").alias("n"))


def lz78_bits(phrases: DataFrame) -> DataFrame:
    """(stream_id, bits): a node reference as wide as the phrases so far need, and eight bits for a letter."""
    letter = F.when(F.col("literal").isNotNull(), 8).otherwise(0)
    return phrases.groupBy("stream_id").agg(F.sum(bit_width(F.col("seq")) + letter).cast("long").alias("bits"))
