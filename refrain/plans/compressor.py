"""The whole pipeline: plan under a memory limit, decide on a pre-pass, parse, report; and the way back.

A pre-pass replaces chunks seen before in the same stream by varints: (length, distance) for a copy, (0, byte) for
everything else. What it leaves is parsed by the hybrid parser. The phrases carry a ``prepass`` flag.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.arrowio import map_rows
from refrain.functions.scalar import unvarint, varint
from refrain.operators.blockcodec import encode_blocks
from refrain.operators.chunks import approximate_references
from refrain.operators.hybrid import topk_lz77_decode, topk_lz77_parse
from refrain.operators.lz78 import topk_lz78_decode, topk_lz78_parse
from refrain.operators.metrics import hybrid_metrics, lz78_metrics
from refrain.operators.phrases import copy
from refrain.operators.tokens import tokens
from refrain.plans.planner import COUNTER_CAP, TOKEN_BLOCK, Ratios, plan, prepass


def prepass_encode(streams: DataFrame, sampling: int) -> DataFrame:
    """Streams as varint streams of chunk copies and literals."""

    def encoded(data: bytes) -> bytes:
        out, at = bytearray(), 0
        for pos, dist, length in [*approximate_references(data, sampling), (len(data), 0, 0)]:
            for c in data[at:pos]:
                out += b"\0" + varint(c)
            if length:
                out += varint(length) + varint(dist)
            at = pos + length
        return bytes(out)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data = [None if x is None else encoded(x) for x in batch.column("bytes").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("stream_id"), pa.array(data, pa.binary())], ["stream_id", "bytes"])

    return map_rows(streams.select("stream_id", "bytes"), work, "stream_id long, bytes binary")


def prepass_decode(streams: DataFrame) -> DataFrame:
    def decoded(data: bytes) -> bytes:
        numbers, out = unvarint(data), bytearray()
        for length, value in zip(numbers[::2], numbers[1::2], strict=True):
            if length:
                copy(out, value, length)
            else:
                out.append(value)
        return bytes(out)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data = [None if x is None else decoded(x) for x in batch.column("bytes").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("stream_id"), pa.array(data, pa.binary())], ["stream_id", "bytes"])

    return map_rows(streams, work, "stream_id long, bytes binary")


@dataclass(frozen=True)
class TopkLZ77:
    """The hybrid codec with its parameters."""

    k: int | str = 1 << 20  # a name: that column of the streams
    window: int | str = 1 << 20
    max_freq: int = 1 << 10
    sampling: int = 4
    suffixes: int = 1

    def compress(self, streams: DataFrame) -> DataFrame:
        return topk_lz77_parse(streams, self.k, self.window, self.max_freq, self.sampling, self.suffixes)

    def decompress(self, phrases: DataFrame) -> DataFrame:
        return topk_lz77_decode(phrases, self.k, self.max_freq, self.suffixes)

    def metrics(self, phrases: DataFrame) -> DataFrame:
        return hybrid_metrics(phrases, self.suffixes)


@dataclass(frozen=True)
class TopkLZ78:
    """LZ78 with a frequency-bounded dictionary and its parameters."""

    k: int = 1 << 20
    max_freq: int = 1 << 10

    def compress(self, streams: DataFrame) -> DataFrame:
        return topk_lz78_parse(streams, self.k, self.max_freq)

    def decompress(self, phrases: DataFrame) -> DataFrame:
        return topk_lz78_decode(phrases, self.k, self.max_freq)

    def metrics(self, phrases: DataFrame) -> DataFrame:
        return lz78_metrics(phrases, unfinished=False)


@dataclass(frozen=True)
class Compressed:
    phrases: DataFrame  # with prepass, and the planned k of their stream
    plans: DataFrame  # of each stream: stream_id, n, memory limit, k, window
    codec: TopkLZ77
    prepass: dict

    def report(self) -> DataFrame:
        """One row: streams, n (bytes given), z, longest phrase, nout (bytes as coded blocks), percent of n, limit (most memory planned for a stream), prepass, seconds.

        The phrases are made and coded for it; seconds is the wall time that took.
        """
        began = time.perf_counter()
        coded = encode_blocks(tokens(self.phrases, TOKEN_BLOCK, split_long=True, hybrid=True)).agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("nout"))
        parsed = self.phrases.agg(F.countDistinct("stream_id").alias("streams"), F.count("*").alias("z"), F.max("len").alias("longest"))
        given = self.plans.agg(F.coalesce(F.sum("given"), F.lit(0)).alias("n"), F.max("plan_memory").alias("limit"))
        row = parsed.crossJoin(F.broadcast(coded)).crossJoin(F.broadcast(given)).first()  # a row each
        values = {"streams": row["streams"], "n": row["n"], "z": row["z"], "longest": row["longest"], "nout": row["nout"], "percent": round(100 * row["nout"] / row["n"], 2) if row["n"] else None, "limit": row["limit"], "prepass": bool(self.prepass["accepted"]), "seconds": round(time.perf_counter() - began, 3)}
        schema = "streams long, n long, z long, longest long, nout long, percent double, limit long, prepass boolean, seconds double"
        return self.phrases.sparkSession.createDataFrame([tuple(values.values())], schema)

    def decompress(self) -> DataFrame:
        out = self.codec.decompress(self.phrases)
        return prepass_decode(out) if self.prepass["accepted"] else out


def compress(streams: DataFrame, memory: int = 0, ratios: Ratios = Ratios(), fast: bool = False, precompress: bool = True) -> Compressed:
    """Try a pre-pass over all streams, plan each stream by its size and ``memory`` (its size if 0), parse. No bytes: no phrases."""
    total = streams.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]
    decided = prepass(streams, total, memory or total, ratios) if precompress else {"accepted": False, "sampling": 0, "parsing": 0, "card": 0, "retried": False}
    given = prepass_encode(streams, decided["sampling"]) if decided["accepted"] else streams.select("stream_id", "bytes")
    size = F.coalesce(F.octet_length("bytes"), F.lit(0)).cast("long")
    planned = plan(given.select("stream_id", "bytes", size.alias("n"), F.lit(int(memory)).alias("memory")), ratios=ratios, fast=fast)
    codec = TopkLZ77("k", "window", COUNTER_CAP, 4 if fast else 0, 1)
    parsed = codec.compress(planned.select("stream_id", "bytes", "k", "window"))
    phrases = parsed.withColumn("prepass", F.lit(decided["accepted"]))
    phrases._refrain_rows = parsed._refrain_rows  # the decoder does without the flag
    sizes = plan(streams.select("stream_id", size.alias("given"), size.alias("n"), F.lit(int(memory)).alias("memory")), ratios=ratios, fast=fast)
    return Compressed(phrases, sizes, codec, decided)
