"""Byte streams as tables: corpus(stream_id BIGINT, bytes BINARY), windows over it, and the CSV form of substring tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Unit suffixes of sizes.
UNITS = {"": 1, "K": 10**3, "M": 10**6, "G": 10**9, "Ki": 1 << 10, "Mi": 1 << 20, "Gi": 1 << 30}


def parse_size(text: str | int) -> int:
    """'32Ki' -> 32768, '1M' -> 1000000, '7' -> 7."""
    m = re.fullmatch(r"\s*(\d+)\s*([KMG]i?)?\s*", str(text))
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return int(m[1]) * UNITS[m[2] or ""]


def prefix(data: Column, n: int | None) -> Column:
    """The first min(size, n) bytes; everything without n."""
    return data if n is None else F.substring(data, 1, n)


def corpus(df: DataFrame, key: str, text: str, limit: int | None = None, sentinel: bool = False) -> DataFrame:
    """A text or binary column as byte streams: UTF-8, cut to ``limit`` bytes, with one NUL after it if asked for. Null rows go."""
    data = F.col(text) if df.schema[text].dataType.simpleString() == "binary" else F.encode(F.col(text), "UTF-8")
    data = prefix(data, limit)
    if sentinel:
        data = F.concat(data, F.unhex(F.lit("00")))
    return df.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("stream_id"), data.alias("bytes"))


def read_files(spark: SparkSession, path: str, limit: int | None = None, sentinel: bool = False) -> DataFrame:
    """Whole files as byte streams, numbered by a hash of their path; a file is one row."""
    files = spark.read.format("binaryFile").load(path)
    return corpus(files.withColumn("stream_id", F.xxhash64("path")), "stream_id", "content", limit, sentinel)


def windows(streams: DataFrame, size: int) -> DataFrame:
    """(stream_id, window_id, base, bytes): consecutive ranges of ``size`` bytes, the last maybe shorter; empty streams have none."""
    n = F.octet_length("bytes")
    ids = F.sequence(F.lit(0), (F.ceil(n / F.lit(size)) - 1).cast("int"))
    out = streams.where(n > 0).withColumn("window_id", F.explode(ids)).withColumn("base", F.col("window_id").cast("long") * size)
    return out.select("stream_id", "window_id", "base", F.expr(f"substring(bytes, cast(base as int) + 1, {size})").alias("bytes"))


def letters(data: Column, unit: str = "byte") -> Column:
    """A string of one character for each unit: bytes as code points 0 to 255, or the text's own code points."""
    return F.decode(data, "ISO-8859-1") if unit == "byte" else F.decode(data, "UTF-8")


def write_frequencies(table: DataFrame, path: str) -> None:
    """Substring frequencies as CSV without a header: fp, len, freq."""
    table.select("fp", "len", "freq").write.mode("overwrite").csv(path, header=False)


def read_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """The CSV form read back; lines that have no fingerprint are left out."""
    return spark.read.csv(path, schema="fp long, len int, freq long", header=False).where("fp is not null")


def expect_header(df: DataFrame, column: str, magic: str) -> DataFrame:
    """``df``, which fails when read if a row's ``column`` is not ``magic``."""
    ok = F.when(F.col(column) == magic, F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"expected {magic}, found "), F.coalesce(F.col(column), F.lit("null")))))
    return df.withColumn(column, ok)
