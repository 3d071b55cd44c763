"""Substring deduplication by relative Lempel-Ziv parsing against an index of all documents' blocks.

The reference of a document is every document with a smaller id. A block is a run of ``window`` words, known by a 128-bit
hash; the index names the first place of every block that two documents hold: the least id, and there the least position.
A document is parsed greedily from left to right. A factor begins at a word where a block of a reference begins; it has
that block's place as its source and runs on word by word for as long as the next block continues at the same source.
A factor thus equals one stretch of one reference and has ``window`` words at least. Where it ends, the blocks over its
border are looked up too: one that another reference holds begins the next factor, which then overlaps the first.
The words of factors are duplicates.

Not every block needs an index entry. Anchors (minima of hashed half-windows over a sliding range) are chosen by content,
at least one in every window, so a window shared by two documents holds an anchor that both chose. Only windows round
an anchor that occurs in two documents are hashed in full and indexed. A whole copy of an earlier word sequence is one
factor from its first word to its last; it is left out of the index, where it could add nothing.

Rows are told apart by id and a 64-bit hash of the text, so rows that share an id never share factors. All joins are
shuffled: the tables grow with the documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.llm.arrowtext import Texts, as_long, map_texts, mix, window_hashes
from refrain.runtime import cut, discard


def _anchors(texts: Texts, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word position in its row, hash) of each anchor: half-windows least by mixed hash in some range that fills a window."""
    half = window // 2
    span = window - half + 1  # half-windows in a window
    hashes, at, runs = texts.shingles(half)
    _, _, first = texts.words()
    row = np.repeat(np.arange(len(texts)), np.diff(runs))
    if len(hashes) < span:
        return row[:0], row[:0], hashes[:0]
    rank = mix(hashes, 77)
    ranges = len(rank) - span + 1
    # Sliding minima by doubling: two overlapping ranges of a power of two make up one of span.
    size, m = 1, rank
    while size * 2 <= span:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    m = np.minimum(m[:ranges], m[span - size : span - size + ranges])
    whole = row[:ranges] == row[span - 1 :]
    # A half-window is an anchor if it is the minimum of any range it lies in: equal hashes are all taken.
    chosen = np.zeros(len(rank), bool)
    for k in range(span):
        chosen[k : k + ranges] |= whole & (rank[k : k + ranges] == m)
    pick = np.flatnonzero(chosen)
    return row[pick], at[pick] - first[row[pick]], hashes[pick]


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, d, t): id, hash of the text, text; (k, d) is a row's name in all tables."""
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return rows.select("k", F.xxhash64("t").alias("d"), "t")


def _copies(rows: DataFrame, kind: str, window: int) -> DataFrame:
    """(k, d, n, source, source_d) of rows whose n words, ``window`` at least, are all those of a row with a smaller id."""

    def whole(batch, texts):
        hashes = texts.word_hashes()
        _, _, first = texts.words()
        long = np.flatnonzero(np.diff(first) >= window)
        if not len(long):
            return None
        a, b = (window_hashes(mix(hashes, s), first[long], first[long + 1]) for s in (1, 2))
        own = [batch.column(c).take(pa.array(long)) for c in ("k", "d")]
        return pa.RecordBatch.from_arrays([*own, pa.array(np.diff(first)[long].astype(np.int32)), as_long(a), as_long(b)], ["k", "d", "n", "a", "b"])

    sequences = cut(map_texts(rows, "t", whole, f"k {kind}, d long, n int, a long, b long"))
    # The least row is written first: then both sides of the join start at an exchange, where a hot key can be split.
    least = sequences.groupBy("a", "b").agg(F.min(F.struct("k", "d")).alias("m"), F.max("k").alias("hi")).where("m.k < hi")
    least = cut(least.select("a", "b", F.col("m.k").alias("source"), F.col("m.d").alias("source_d")))
    copies = cut(sequences.join(least, ["a", "b"]).where("k > source").select("k", "d", "n", "source", "source_d").distinct())
    discard(sequences, least)
    return copies


def _index(rows: DataFrame, copies: DataFrame, kind: str, window: int) -> DataFrame:
    """(k, d, s, a, b): the blocks, by start and hash, of every row that is no copy, near anchors that two ids share."""
    half = window // 2

    def anchors(batch, texts):
        row, at, hashes = _anchors(texts, window)
        own = [batch.column(c).take(pa.array(row)) for c in ("k", "d")]
        return pa.RecordBatch.from_arrays([*own, pa.array(at.astype(np.int32)), as_long(hashes)], ["k", "d", "at", "h"])

    found = map_texts(rows, "t", anchors, f"k {kind}, d long, at int, h long")
    found = cut(found.join(copies.select("k", "d"), ["k", "d"], "left_anti"))
    shared = cut(found.groupBy("h").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo < hi").select("h"))
    places = cut(found.join(shared, "h").groupBy("k", "d").agg(F.collect_set("at").alias("at")))
    discard(found, shared)

    def windows(batch, texts):
        hashes = texts.word_hashes()
        _, _, first = texts.words()
        begin, own = [], []
        for i, at in enumerate(batch.column("at")):
            a = np.asarray(at.values)
            n = int(first[i + 1] - first[i])
            lo, hi = np.maximum(a - (window - half), 0), np.minimum(a, n - window)
            cover = np.zeros(n + 2, np.int32)
            np.add.at(cover, lo[hi >= lo], 1)
            np.add.at(cover, hi[hi >= lo] + 1, -1)
            begin.append(np.flatnonzero(np.cumsum(cover) > 0))
            own.append(np.full(len(begin[-1]), i))
        s, row = np.concatenate(begin), np.concatenate(own)
        a, b = (window_hashes(mix(hashes, v), first[row] + s, first[row] + s + window) for v in (1, 2))
        own = [batch.column(c).take(pa.array(row)) for c in ("k", "d")]
        return pa.RecordBatch.from_arrays([*own, pa.array(s.astype(np.int32)), as_long(a), as_long(b)], ["k", "d", "s", "a", "b"])

    index = cut(map_texts(rows.join(places, ["k", "d"]), "t", windows, f"k {kind}, d long, s int, a long, b long"))
    discard(places)
    return index


def parse(row: np.ndarray, start: np.ndarray, source: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy factors from looked-up blocks: the place of each factor's first block in the arrays, and its end.

    Blocks are ordered by row and start: ``start`` in its row and its place (source, at) in the reference, sources as
    numbers. A block that stands a word further than the one before, in the text and in the same source, extends the
    factor by that word; any other block begins a factor, inside the one before if it starts there.
    """
    goes_on = (row[1:] == row[:-1]) & (start[1:] == start[:-1] + 1) & (source[1:] == source[:-1]) & (at[1:] == at[:-1] + 1)
    begins = np.flatnonzero(np.concatenate([[True], ~goes_on])[: len(row)])
    last = np.concatenate([begins[1:], [len(row)]])[: len(begins)] - 1
    return begins, start[last] + window


def factors(docs: DataFrame, window: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, d, factors) of rows with duplicate words; factors is an ascending array of (first, end, source, at).

    Words first to end - 1 of the row equal the source's words from ``at`` on. d is the hash of the row's text. Null ids
    are neither reference nor parsed; rows of equal id are no reference to each other; a null text is empty. The result
    is a table made by ``cut``.
    """
    rows = _rows(docs, key, text).where("k is not null")
    kind = rows.schema["k"].dataType.simpleString()
    copies = _copies(rows, kind, window)
    index = _index(rows, copies, kind, window)
    first = index.groupBy("a", "b").agg(F.min(F.struct("k", "d", "s")).alias("m"), F.max("k").alias("hi")).where("m.k < hi")
    first = cut(first.select("a", "b", F.col("m.k").alias("source"), F.col("m.d").alias("source_d"), F.col("m.s").alias("at")))
    met = index.join(first, ["a", "b"]).where("k > source").groupBy("k", "d")
    met = met.agg(F.collect_list(F.struct("s", "source", "source_d", "at")).alias("met"))  # linear in the row's own words

    def work(batches):
        for batch in batches:
            met = batch.column("met")
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(met.offsets)))
            s, source, source_d, at = met.flatten().flatten()
            number = source.dictionary_encode().indices.to_numpy().astype(np.int64)
            start, d, place = (x.to_numpy().astype(np.int64) for x in (s, source_d, at))
            order = np.lexsort((start, row))
            once = np.ones(len(order), bool)  # a repeated row looks its blocks up twice
            once[1:] = (row[order[1:]] != row[order[:-1]]) | (start[order[1:]] != start[order[:-1]])
            order = order[once]
            _, both = np.unique(np.stack([number, d]), axis=1, return_inverse=True)
            begins, ends = parse(row[order], start[order], both.ravel()[order], place[order], window)
            pick = order[begins]
            fields = [pa.array(start[pick].astype(np.int32)), pa.array(ends.astype(np.int32)), source.take(pa.array(pick)), pa.array(place[pick].astype(np.int32))]
            struct = pa.StructArray.from_arrays(fields, ["first", "end", "source", "at"])
            offsets = np.searchsorted(row[pick], np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("d"), pa.ListArray.from_arrays(pa.array(offsets), struct)], ["k", "d", "factors"])

    parsed = met.mapInArrow(work, f"k {kind}, d long, factors array<struct<first:int,end:int,source:{kind},at:int>>")
    whole = F.array(F.struct(F.lit(0).alias("first"), F.col("n").alias("end"), "source", F.lit(0).alias("at")))
    out = cut(parsed.union(copies.select("k", "d", whole.alias("factors"))))
    discard(copies, index, first)
    return out


def deduplicate(docs: DataFrame, window: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_removed, kept, factors) for every row; ``kept`` is the remaining words joined by one space.

    factors are the removed stretches with their sources, as ``factors`` gives them. Every word in a run of ``window``
    words that also occurs in a document with a smaller id is removed; shorter documents, null texts (no words) and rows
    with a null id lose nothing. A row never loses words for another row's text, whatever ids they share. Empty tables
    give no rows. A text is held in memory whole, with a few numbers for each of its words.
    """
    rows = _rows(docs, key, text)
    kind = rows.schema["k"].dataType.simpleString()
    joined = rows.join(factors(docs, window, key, text), ["k", "d"], "left")

    def work(batch, texts):
        data = texts.data.tobytes()
        counts, kept, removed = [], [], []
        for i, found in enumerate(batch.column("factors")):
            words = data[texts.offsets[i] : texts.offsets[i + 1]].split()  # at the six ASCII separators
            n, last = len(words), len(words)
            if found.is_valid:
                first, end, *_ = found.values.flatten()
                for a, b in zip(reversed(first.to_pylist()), reversed(end.to_pylist()), strict=True):  # factors that overlap are cut from the right
                    del words[a : min(b, last)]
                    last = min(a, last)
            counts.append(n)
            kept.append(b" ".join(words))
            removed.append(n - len(words))
        out = [batch.column("k"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), batch.column("factors")]
        return pa.RecordBatch.from_arrays(out, ["k", "n_words", "n_removed", "kept", "factors"])

    schema = f"k {kind}, n_words long, n_removed long, kept string, factors array<struct<first:int,end:int,source:{kind},at:int>>"
    return map_texts(joined, "t", work, schema).toDF(key, "n_words", "n_removed", "kept", "factors")
