"""Command line over files: python -m refrain COMMAND PATH [options]. Phrase tables are Parquet, substring tables CSV."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.operators import lz77, lz78, metrics, substrings
from refrain.plans.compressor import TopkLZ77, TopkLZ78, compress
from refrain.runtime import workers_see_package
from refrain.sources import corpus as sources


def arguments(argv: list[str] | None) -> argparse.Namespace:
    size = sources.parse_size
    top = argparse.ArgumentParser(prog="refrain")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, help_: str, decodes: bool = True) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=help_)
        p.add_argument("path")
        p.add_argument("-o", "--output", nargs="?", const="", help="without a name: the path with the command's ending")
        p.add_argument("-p", "--prefix", type=size)
        if decodes:
            p.add_argument("-d", "--decode", action="store_true")
        return p

    p = command("compress", "plan, pre-pass and hybrid parse", decodes=False)
    p.add_argument("-m", "--memory", type=size, default=0)
    p.add_argument("--fast", action="store_true")
    p.add_argument("--disable-precompression", action="store_true")
    p = command("topk", "most frequent substrings", decodes=False)
    p.add_argument("-k", type=size, required=True)
    p.add_argument("--fmax", type=size, default=1 << 20)
    p.add_argument("-e", "--exact", action="store_true")
    p = command("lz77", "exact or window-wise LZ77")
    p.add_argument("-w", "--window", type=size)
    command("lz78", "exact LZ78")
    p = command("lz78-age", "LZ78, age-evicted dictionary")
    p.add_argument("-k", type=size, default=1 << 20)
    p = command("topk-lz78", "LZ78, frequency-bounded dictionary")
    p.add_argument("-k", type=size, default=1 << 20)
    p.add_argument("-c", "--cap", type=size, default=1 << 10)
    p = command("topk-lz77", "windows of LZ77 with a sketch")
    for flags, default in ((("-k",), 1 << 20), (("-c", "--cap"), 1 << 10), (("-s", "--sampling"), 4), (("-z", "--suffixes"), 1), (("-w", "--window"), 1 << 20)):
        p.add_argument(*flags, type=size, default=default)
    p = sub.add_parser("compare", help="overlap of two substring tables")
    p.add_argument("exact")
    p.add_argument("approx")
    return top.parse_args(argv)


#: Endings of files that are named after their input.
ENDINGS = {"compress": ".zk", "lz77": ".lz77", "lz78": ".lz78", "lz78-age": ".lz78lru", "topk-lz77": ".topklz77", "topk-lz78": ".topklz78", "topk": ".csv"}


def default_output(path: str, command: str, decode: bool = False, windows: bool = False) -> str:
    """The path with the ending of the command's tables, or with .dec for a decoded one."""
    ending = ".dec" if decode else ".lz77block" if command == "lz77" and windows else ENDINGS[command]
    return path.rstrip("/") + ending


def run(spark: SparkSession, argv: list[str] | None = None) -> DataFrame:
    """Do what the arguments say; the table that was written, or the metrics."""
    a = arguments(argv)
    if getattr(a, "output", None) == "":
        a.output = default_output(a.path, a.command, getattr(a, "decode", False), bool(getattr(a, "window", None)))
    workers_see_package(spark)
    if a.command == "compare":
        return substrings.topk_overlap(sources.read_frequencies(spark, a.exact), sources.read_frequencies(spark, a.approx))
    codecs = {
        "lz77": lambda: (lambda s: lz77.lz77_parse(s, a.window), lz77.lz77_decode, metrics.lz77_metrics),
        "lz78": lambda: (lz78.lz78_parse, lz78.lz78_decode, metrics.lz78_metrics),
        "lz78-age": lambda: (lambda s: lz78.age_lz78_parse(s, a.k), lambda p: lz78.age_lz78_decode(p, a.k), metrics.lz78_metrics),
        "topk-lz78": lambda: ((c := TopkLZ78(a.k, a.cap)).compress, c.decompress, c.metrics),
        "topk-lz77": lambda: ((c := TopkLZ77(a.k, a.window, a.cap, a.sampling, a.suffixes)).compress, c.decompress, c.metrics),
    }
    if a.command in codecs:
        parse, decode, measure = codecs[a.command]()
        if a.decode:
            out = decode(spark.read.parquet(a.path))
            if a.output:
                out.write.mode("overwrite").parquet(a.output)
            return out
        phrases = parse(sources.read_files(spark, a.path, a.prefix))
        if a.output:
            phrases.write.mode("overwrite").parquet(a.output)
            phrases = spark.read.parquet(a.output)
        return measure(phrases)
    streams = sources.read_files(spark, a.path, a.prefix, sentinel=False)
    if a.command == "compress":
        done = compress(streams, a.memory, fast=a.fast, precompress=not a.disable_precompression)
        if a.output:
            done.phrases.write.mode("overwrite").parquet(a.output)
        return done.report()
    if a.exact:
        table = substrings.with_fingerprint(substrings.topk_substrings(streams, a.k))
    else:
        table = substrings.approx_topk_substrings(streams, a.k, a.fmax)
    table = table.select("fp", "len", "freq").orderBy(F.desc("freq"), "len", "fp")
    if a.output:
        sources.write_frequencies(table, a.output)
    return table


if __name__ == "__main__":
    session = SparkSession.builder.appName("refrain").getOrCreate()
    run(session).show(truncate=False)
    session.stop()
