"""LZ77 by windows together with a sketch of frequent prefixes that lives on across windows, and its decoder.

At each position the longest prefix known to the sketch competes with what is left of the current LZ77 reference of the
window: the sketch wins if its prefix is at least as long. References, and ``suffixes`` suffixes of each in all, are
entered into the sketch after use; literals and sketch references are not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from refrain.arrowio import map_groups, map_rows
from refrain.operators.chunks import approximate_references
from refrain.operators.dictionaries import FrequentPrefixes
from refrain.operators.lz77 import references, window_phrases
from refrain.operators.phrases import DECODED, SCHEMA, Phrases, copy, decoded


def _sketch(k: int, max_freq: int) -> FrequentPrefixes:
    return FrequentPrefixes(k - 1, max_freq)


def parse_window(out: Phrases, data: bytes, sketch: FrequentPrefixes, refs: list[tuple[int, int, int]], suffixes: int) -> None:
    """Phrases of one window, which also enter the sketch."""
    at, n, child_of, nodes, found = 0, len(data), sketch.edges.get, sketch.nodes, []
    coming = iter(refs)
    begin, dist, length = next(coming, (n, 0, 0))
    stop = begin + length
    while at < n:
        while stop <= at:
            begin, dist, length = next(coming, (n, 0, 0))
            stop = begin + length
        left = stop - at if at >= begin else 0
        child = child_of(data[at])  # an edge of the root has its letter as key
        if child is not None:
            end = at
            while child is not None:
                node = child
                end += 1
                child = child_of(node << 8 | data[end]) if end < n else None
            if end - at >= left:
                found.append((at, node - nodes, end - at))  # minus its published name
                at = end
                continue
        if left > 1:
            found.append((at, dist, left))
            for x in range(min(left, suffixes)):
                sketch.enter(data, at + x, stop)
            at = stop
        else:
            at += 1
    window_phrases(out, data, found)


def topk_lz77_parse(streams: DataFrame, k: int | str = 1 << 20, window: int | str = 1 << 20, max_freq: int = 1 << 10, sampling: int = 4, suffixes: int = 1, min_ref_len: int = 2) -> DataFrame:
    """Phrases of kinds lit, ref (distance within the window) and trie. ``sampling`` 0 finds exact references.

    The sketch has k - 1 nodes, the root included; k is 3 or more, smaller ones are taken as 3 and windows as 1 at least.
    k and window may name columns of ``streams``, so that every stream has its own; phrases then carry such a k as a
    column of that name. Empty streams have no phrases.
    """
    own = [c for c in dict.fromkeys((k, window)) if isinstance(c, str)]
    carried = [("k", k)] if isinstance(k, str) else []

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, sizes = Phrases(), []
        get = lambda p: batch.column(batch.schema.get_field_index(p)).to_pylist() if isinstance(p, str) else [p] * batch.num_rows
        for stream, data, nodes, size in zip(batch.column("stream_id").to_pylist(), batch.column("bytes").to_pylist(), get(k), get(window), strict=True):
            out.start(stream)
            nodes, size = max(3, nodes or 0), max(1, size or 0)
            sketch = _sketch(nodes, max_freq)
            for base in range(0, len(data or b""), size):
                part = data[base : base + size]
                refs = approximate_references(part, sampling) if sampling else references(part, min_ref_len)
                parse_window(out, part, sketch, refs, suffixes)
                out.window += 1
            sizes += [nodes] * out.seq
        found = out.batch()
        return pa.RecordBatch.from_arrays([*found.columns, pa.array(sizes, pa.int64())], [*found.schema.names, k]) if carried else found

    return map_rows(streams.select("stream_id", "bytes", *own), work, SCHEMA + "".join(f", `{name}` long" for _, name in carried))


def topk_lz77_decode(phrases: DataFrame, k: int | str = 1 << 20, max_freq: int = 1 << 10, suffixes: int = 1) -> DataFrame:
    """(stream_id, bytes), replaying the sketch with the parser's parameters; k may name a column of ``phrases``."""

    def work(stream: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
        out, sketch = bytearray(), _sketch(int(columns[k][0]) if isinstance(k, str) else k, max_freq)
        literal, at, spelled = columns["literal"], 0, {}
        letters = literal[literal >= 0].astype(np.uint8).tobytes()
        other = np.flatnonzero(literal < 0)
        kept = ((other - np.arange(len(other))), *(columns[c][other] for c in ("len", "dist", "node")))
        for before, length, dist, node in zip(*(x.tolist() for x in kept), strict=True):  # so many literals come before
            out += letters[at:before]
            at = before
            if node < 0:
                copy(out, dist, length)
                phrase = bytes(out[-length:])
                for x in range(min(length, suffixes)):
                    sketch.enter(phrase, x, length)
            elif sketch.buckets is None:  # nothing was evicted yet
                text = spelled.get(node)
                if text is None:
                    text = spelled[node] = sketch.spell(sketch.number(node))
                out += text
            else:
                out += sketch.spell(sketch.number(node))
        out += letters[at:]
        return decoded(stream, out)

    return map_groups(phrases, "stream_id", ["seq", "len", "dist", "node", "literal", *([k] if isinstance(k, str) else [])], work, DECODED)
