"""Statistics of phrase tables, by stream: what the parsers report."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.arrowio import map_groups


def coverage(phrases: DataFrame) -> DataFrame:
    """(stream_id, n, gaps): bytes covered, and phrases that do not begin where the one before ends."""

    def work(stream: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
        pos, size = columns["pos"], columns["len"]
        gaps = np.count_nonzero(pos != np.append(0, (pos + size)[:-1]))
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (stream, int(size.sum()), gaps)], ["stream_id", "n", "gaps"])

    return map_groups(phrases, "stream_id", ["seq", "pos", "len"], work, "stream_id long, n long, gaps long")


def lz77_metrics(phrases: DataFrame) -> DataFrame:
    """(stream_id, n, z, literals, refs, longest_ref): n is the bytes covered."""
    ref = F.col("kind") == "ref"
    return phrases.groupBy("stream_id").agg(
        F.sum("len").alias("n"), F.count("*").alias("z"), F.count_if(~ref).alias("literals"), F.count_if(ref).alias("refs"), F.coalesce(F.max(F.when(ref, F.col("len"))), F.lit(0)).alias("longest_ref")
    )


def lz78_metrics(phrases: DataFrame, unfinished: bool = True) -> DataFrame:
    """(stream_id, z, len_max, len_avg); a last phrase without a letter counts only if ``unfinished``. No phrase: null average."""
    full = F.lit(True) if unfinished else F.col("literal").isNotNull()
    length = F.when(full, F.col("len"))
    return phrases.groupBy("stream_id").agg(F.count_if(full).alias("z"), F.coalesce(F.max(length), F.lit(0)).alias("len_max"), F.round(F.avg(length), 2).alias("len_avg"))


def hybrid_metrics(phrases: DataFrame, suffixes: int = 1) -> DataFrame:
    """(stream_id, z, phrases_ref, phrases_literal, num_relevant, longest, longest_lz, longest_trie, num_lz, num_trie, avg_lz, avg_trie, avg_ref)."""
    lz, trie, length = F.col("kind") == "ref", F.col("kind") == "trie", F.col("len")
    either = lz | trie
    longest = lambda c: F.coalesce(F.max(F.when(c, length)), F.lit(0))
    mean = lambda c: F.round(F.avg(F.when(c, length)), 2)
    return phrases.groupBy("stream_id").agg(
        F.count("*").alias("z"), F.count_if(either).alias("phrases_ref"), F.count_if(~either).alias("phrases_literal"), F.coalesce(F.sum(F.when(lz, F.least(length, F.lit(suffixes)))), F.lit(0)).alias("num_relevant"),
        longest(either).alias("longest"), longest(lz).alias("longest_lz"), longest(trie).alias("longest_trie"), F.count_if(lz).alias("num_lz"), F.count_if(trie).alias("num_trie"), mean(lz).alias("avg_lz"), mean(trie).alias("avg_trie"), mean(either).alias("avg_ref"),
    )


def described(metrics: DataFrame, **labels) -> DataFrame:
    """Metrics with constant columns, such as the algorithm's name and parameters, sorted by name."""
    out = metrics.withColumns({k: F.lit(v) for k, v in labels.items()})
    return out.select("stream_id", *sorted(c for c in out.columns if c != "stream_id"))


def as_records(metrics: DataFrame) -> DataFrame:
    """(stream_id, name, value): one row for each metric."""
    names = [c for c in metrics.columns if c != "stream_id"]
    pairs = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in names))
    return metrics.select("stream_id", F.explode(pairs).alias("m")).select("stream_id", "m.name", "m.value")
