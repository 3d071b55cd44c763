"""Most frequent substrings: exact by level-wise aggregation, approximate by sketches, and how well the two agree."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refrain.arrowio import map_rows
from refrain.functions.scalar import fingerprint, fingerprint_of
from refrain.operators.dictionaries import FrequentPrefixes
from refrain.runtime import cut, discard, join_small


#: Letters are bytes, or code points as four bytes each: fixed widths, so that a substring is found without a scan.
_WIDTH = {"byte": 1, "char": 4}


def _wide(data: Column, unit: str) -> Column:
    """UTF-8 bytes as letters of fixed width."""
    return data if unit == "byte" else F.encode(F.decode(data, "UTF-8"), "UTF-32")


def _text(sub: Column, unit: str) -> Column:
    return F.decode(sub, "ISO-8859-1" if unit == "byte" else "UTF-32")


def _starts(texts: DataFrame, length: int, width: int) -> DataFrame:
    """One row for each substring of so many letters of ``t``; shorter texts have none."""
    n = (F.octet_length("t") / width).cast("int") - length + 1
    rows = texts.where(n > 0).withColumn("_at", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.withColumn("sub", F.col("t").substr(F.col("_at") * width + 1, F.lit(length * width)))


def ngrams(streams: DataFrame, longest: int, shortest: int = 1, unit: str = "byte") -> DataFrame:
    """All substrings of ``bytes`` of shortest to longest letters: the other columns, sub and len. None crosses a row.

    Each length is one explode over the text, so no intermediate list of substrings is built.
    """
    wide = streams.withColumn("t", _wide(F.col("bytes"), unit)).drop("bytes")
    parts = (_starts(wide, n, _WIDTH[unit]).drop("t", "_at").withColumn("len", F.lit(n)) for n in range(shortest, longest + 1))
    return reduce(DataFrame.union, parts).withColumn("sub", _text(F.col("sub"), unit))


def _top(counted: DataFrame, k: int, by: list[str]) -> DataFrame:
    """The k most frequent, shorter and then smaller ones first among equals."""
    order = [F.desc("freq"), F.asc("len"), F.asc("sub")]
    if not by:
        return counted.orderBy(*order).limit(k)
    return counted.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def topk_substrings(streams: DataFrame, k: int, longest: int | None = None, unit: str = "byte", by: tuple[str, ...] = (), occurrence: bool = False) -> DataFrame:
    """(by..., sub, len, freq): the k most frequent substrings, of all rows or of each group, in bytes or characters.

    streams: bytes and the columns of ``by``. Level n counts substrings whose first n - 1 characters are frequent enough:
    a substring is never more frequent than its beginnings. The loop ends when no longer substring can enter the result.
    Only the frequent beginnings are kept between levels; texts are read again and never shuffled, at most k + 1 times,
    because all beginnings of a substring in the result are in it too. In byte units ``sub`` holds one character from 0
    to 255 for each byte. With ``occurrence`` there is also the first place, ``first``: the least (stream_id, pos).
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    keys = list(by)
    places = ["stream_id"] if occurrence else []
    texts = streams.where(F.col("bytes").isNotNull()).select(*keys, *places, _wide(F.col("bytes"), unit).alias("t"))
    counts = [F.count("*").alias("freq")] + ([F.min(F.struct("stream_id", F.col("_at").cast("long").alias("pos"))).alias("first")] if occurrence else [])
    columns = ["sub", "len", "freq", *(["first"] if occurrence else [])]
    width = _WIDTH[unit]
    best, kept, n, used = None, None, 1, []
    while longest is None or n <= longest:
        rows = _starts(texts, n, width)
        if kept is not None:
            rows = join_small(rows.withColumn("head", F.col("sub").substr(F.lit(1), F.lit((n - 1) * width))), kept, [*keys, "head"], "left_semi")
        level = rows.groupBy(*keys, "sub").agg(*counts).withColumn("len", F.lit(n))
        level = cut(level.select(*keys, *columns))
        if level.isEmpty():
            used.append(level)
            break
        new = cut(_top(level if best is None else best.union(level), k, keys))
        used += [t for t in (best, kept) if t is not None]
        best = new
        # A longer substring comes after equally frequent shorter ones, so it must beat the k-th.
        floor = best.groupBy(*keys).agg(F.when(F.count("*") >= k, F.min("freq")).otherwise(F.lit(0)).alias("floor"))
        enough = level.join(F.broadcast(floor), keys) if keys else level.crossJoin(F.broadcast(floor))  # a row for each group, or one
        kept = cut(enough.where(F.col("freq") > F.col("floor")).select(*keys, F.col("sub").alias("head")))
        used.append(level)
        if kept.isEmpty():
            break
        n += 1
    discard(*(t for t in used if t is not best))
    if best is None:
        best = _starts(texts, 1, width).groupBy(*keys, "sub").agg(*counts).withColumn("len", F.lit(1)).select(*keys, *columns).limit(0)
    return best.withColumn("sub", _text(F.col("sub"), unit))


def with_fingerprint(table: DataFrame, unit: str = "byte") -> DataFrame:
    """A substring table with fp, the fingerprint of the substring's bytes."""
    return table.withColumn("fp", fingerprint(F.encode(F.col("sub"), "ISO-8859-1" if unit == "byte" else "UTF-8")))


def by_fingerprint(table: DataFrame) -> DataFrame:
    """The table in order of fingerprint, then length."""
    return table.orderBy("fp", "len")


def length_histogram(table: DataFrame) -> DataFrame:
    return table.groupBy("len").agg(F.count("*").alias("substrings"), F.sum("freq").alias("occurrences"))


def expand_lengths(nodes: DataFrame, parent_depth: str = "parent_depth", depth: str = "depth") -> DataFrame:
    """Rows for the lengths parent_depth + 1 .. depth that a compacted node stands for."""
    return nodes.withColumn("len", F.explode(F.sequence(F.col(parent_depth) + 1, F.col(depth))))


def _sketch_rows(data: list[bytes], k: int, max_freq: int) -> FrequentPrefixes:
    sketch = FrequentPrefixes(k + 1, max_freq)
    for text in data:
        for at in range(len(text)):
            sketch.enter(text, at, len(text))
    return sketch


def approx_topk_substrings(streams: DataFrame, k: int, max_freq: int = 1 << 20, mode: str = "stream") -> DataFrame:
    """Frequent substrings by bounded sketches over every start position.

    mode 'stream': a sketch for each row: (stream_id, node, substr, fp, len, freq, freq_lower); freq is the raw counter,
    freq_lower = raw - threshold never exceeds the true count. mode 'merged': the sketches of all rows merged by adding
    lower bounds, subtracting the (k+1)-th and keeping the k largest: (substr, fp, len, freq_lower). However rows are
    dealt over partitions, the answer is the same.
    """

    def rows(sketch: FrequentPrefixes) -> list[tuple]:
        return [(node, sub, fingerprint_of(sub), len(sub), freq, max(freq - sketch.threshold, 0)) for node, _, _, freq, sub in sketch.rows()]

    names = ["stream_id", "node", "substr", "fp", "len", "freq", "freq_lower"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, data = batch.column("stream_id").to_pylist(), [[x or b""] for x in batch.column("bytes").to_pylist()]
        found = [(i, *r) for i, x in zip(ids, data, strict=True) for r in rows(_sketch_rows(x, k, max_freq))]
        columns = list(zip(*found, strict=True)) if found else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    schema = "stream_id long, node long, substr binary, fp long, len int, freq long, freq_lower long"
    out = map_rows(streams.select("stream_id", "bytes"), work, schema)
    if mode == "stream":
        return out
    total = out.groupBy("substr").agg(F.first("fp").alias("fp"), F.first("len").alias("len"), F.sum("freq_lower").alias("freq_lower"))
    top = total.where("freq_lower > 0").orderBy(F.desc("freq_lower"), "len", "substr").limit(k + 1)
    ranked = top.withColumn("_n", F.row_number().over(Window.orderBy(F.desc("freq_lower"), "len", "substr")))  # k + 1 rows
    least = F.max(F.when(F.col("_n") == k + 1, F.col("freq_lower"))).over(Window.partitionBy())
    left = ranked.withColumn("freq_lower", F.col("freq_lower") - F.coalesce(least, F.lit(0)))
    return left.where((F.col("_n") <= k) & (F.col("freq_lower") > 0)).drop("_n")


def topk_overlap(exact: DataFrame, approx: DataFrame, order: list[Column] | None = None, fp: str = "fp") -> DataFrame:
    """One row: k (different approximate fingerprints), hits among the k first exact ones, score = hits / k.

    Fails if the exact table has fewer than k rows. ``order`` defaults to freq descending, then length and fingerprint.
    """
    found = approx.select(F.col(fp).alias("fp")).distinct()
    k = found.count()
    first = exact.orderBy(*(order or [F.desc("freq"), F.asc("len"), F.asc(fp)])).limit(k).select(F.col(fp).alias("fp"))
    hits = first.withColumn("n", F.lit(1)).join(found.withColumn("hit", F.lit(1)), "fp", "left").agg(F.count("n").alias("n"), F.count("hit").alias("hits"))
    checked = F.when(F.col("n") < k, F.raise_error(F.lit("fewer exact substrings than approximate ones"))).otherwise(F.lit(k)).cast("long")
    return hits.select(checked.alias("k"), "hits", (F.col("hits") / F.nullif(F.lit(k), F.lit(0))).alias("score"))


def longest_prefix_matches(texts: DataFrame, dictionary: DataFrame, key: str = "stream_id", text: str = "t") -> DataFrame:
    """(key, pos, node, depth): the longest dictionary entry (sub, node) that starts at each position, by equi-joins per length.

    Positions where nothing starts are absent. Lengths without entries cost nothing.
    """
    lengths = [r[0] for r in dictionary.select(F.length("sub")).distinct().collect()]  # as many as different lengths
    if not lengths:
        return texts.select(F.col(key), F.lit(1).alias("pos"), F.lit(1).cast("long").alias("node"), F.lit(1).alias("depth")).limit(0)
    wide = texts.select(F.col(key), F.encode(F.col(text), "UTF-32").alias("t"))
    entries = dictionary.select(F.encode("sub", "UTF-32").alias("sub"), "node")
    parts = []
    for n in sorted(lengths):
        many = (F.octet_length("t") / 4).cast("int") - n + 1
        at = wide.where(many > 0).withColumn("pos", F.explode(F.sequence(F.lit(1), many)))
        parts.append(at.select(key, "pos", F.col("t").substr(F.col("pos") * 4 - 3, F.lit(4 * n)).alias("sub"), F.lit(n).alias("depth")))
    hits = reduce(DataFrame.union, parts).join(entries, "sub")
    return hits.groupBy(key, "pos").agg(F.max_by("node", "depth").alias("node"), F.max("depth").alias("depth"))


def sketch_dump(streams: DataFrame, k: int, max_freq: int = 1 << 20) -> DataFrame:
    """The whole state of a sketch of each stream: (stream_id, node, parent, label, depth, children, freq, threshold, renormalised).

    Only nodes in use; a stream whose sketch has none is absent.
    """
    names = ["stream_id", "node", "parent", "label", "depth", "children", "freq", "threshold", "renormalised"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for stream, data in zip(batch.column("stream_id").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
            s = _sketch_rows([data or b""], k, max_freq)
            found += [(stream, v, parent, label, len(sub), s.children[s.number(v)], freq, s.threshold, s.renormalised) for v, parent, label, freq, sub in s.rows()]
        columns = list(zip(*found, strict=True)) if found else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return map_rows(streams.select("stream_id", "bytes"), work, ", ".join(f"{n} long" for n in names))


def lcp_array(texts: DataFrame, key: str = "stream_id") -> DataFrame:
    """(key, rank, pos, lcp): suffix order and common prefixes of neighbours, for small binary texts; a row each is not shuffled."""
    from refrain.operators.lz77 import _common, suffix_array

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns: list[list[int]] = [[], [], [], []]
        for stream, data in zip(batch.column(key).to_pylist(), batch.column("bytes").to_pylist(), strict=True):
            order = suffix_array(data).tolist() if data else []
            for rank, pos in enumerate(order):
                common = _common(data, *sorted((order[rank - 1], pos))) if rank else 0
                for column, value in zip(columns, (stream, rank, pos, common), strict=True):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [key, "rank", "pos", "lcp"])

    return map_rows(texts.select(key, "bytes"), work, f"{key} long, rank long, pos long, lcp long")
