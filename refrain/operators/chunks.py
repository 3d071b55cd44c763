"""Content-defined chunks: approximate LZ77 references, chunk duplicates over a corpus, and the gate that decides on a pre-pass.

A cut follows every position where a hash of the last ten bytes is 0 modulo 2**sampling, so equal content is cut alike
wherever it stands. A chunk seen before is a reference to its last occurrence.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refrain.arrowio import map_rows

#: Bytes that decide on a cut.
SPAN = 10
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, SPAN - i, 1 << 64) for i in range(SPAN)], np.uint64)


def cuts(data: bytes, sampling: int) -> list[int]:
    """Chunk ends, ascending; the last is len(data). Empty data has none."""
    if not data:
        return []
    x = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    found: list[int] = []
    if len(x) >= SPAN:
        h = np.zeros(len(x) - SPAN + 1, np.uint64)
        for i in range(SPAN):
            h += x[i : len(x) - SPAN + 1 + i] * _FACTORS[i]
        h ^= h >> np.uint64(29)
        h = (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - sampling)
        found = (np.flatnonzero(h == 0) + SPAN).tolist()
    if not found or found[-1] != len(data):
        found.append(len(data))
    return found


def approximate_references(data: bytes, sampling: int) -> list[tuple[int, int, int]]:
    """(position, distance, length) of chunks that are copies of an earlier chunk; they are valid, but not the longest."""
    seen: dict[bytes, int] = {}
    out, at = [], 0
    for end in cuts(data, sampling):
        chunk = data[at:end]
        if chunk in seen and len(chunk) > 1:
            out.append((at, at - seen[chunk], len(chunk)))
        seen[chunk] = at
        at = end
    return out


def chunks(streams: DataFrame, sampling: int) -> DataFrame:
    """(stream_id, seq, pos, len, digest) of each chunk; only digests leave the rows they are made from."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, seqs, at, lens, digests = [], [], [], [], []
        for stream, data in zip(batch.column("stream_id").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
            begin = 0
            for seq, end in enumerate(cuts(data or b"", sampling)):
                ids.append(stream)
                seqs.append(seq)
                at.append(begin)
                lens.append(end - begin)
                digests.append(hashlib.md5(data[begin:end]).digest())
                begin = end
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(seqs, pa.int64()), pa.array(at, pa.int64()), pa.array(lens, pa.int64()), pa.array(digests, pa.binary())], ["stream_id", "seq", "pos", "len", "digest"])

    return map_rows(streams.select("stream_id", "bytes"), work, "stream_id long, seq long, pos long, len long, digest binary")


def chunk_references(streams: DataFrame, sampling: int) -> DataFrame:
    """Chunks with dist, the distance to the previous occurrence in the same stream (null for a first one)."""
    order = Window.partitionBy("stream_id", "digest").orderBy("pos")
    return chunks(streams, sampling).withColumn("dist", F.col("pos") - F.lag("pos").over(order))


def cardinality_gate(streams: DataFrame, sampling: int, accept: float = 0.3, exact: bool = False) -> DataFrame:
    """One row: parsing (chunks), card (different ones, estimated unless ``exact``), ratio, accepted. No chunks: null ratio, not accepted."""
    card = F.countDistinct("digest") if exact else F.approx_count_distinct("digest", 0.01)
    out = chunks(streams, sampling).agg(F.count("*").alias("parsing"), card.alias("card"))
    out = out.withColumn("ratio", F.col("card") / F.nullif("parsing", F.lit(0)))
    return out.withColumn("accepted", F.coalesce(F.col("ratio") <= accept, F.lit(False)))
