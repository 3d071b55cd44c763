"""LZ78 parses with an unbounded, a frequency-bounded or an age-bounded dictionary, and their decoders.

A phrase is a dictionary node and the letter after it; the last phrase of a stream may be a node alone. Node numbers are
the dictionary's own. Decoders rebuild the dictionary as they go.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from refrain.arrowio import map_groups, map_rows
from refrain.operators.dictionaries import ROOT, FrequentPrefixes, RecentPrefixes
from refrain.operators.phrases import DECODED, NODE, SCHEMA, TRIE, Phrases, decoded


class _Everything:
    """A dictionary that is never full: node i is the i-th phrase."""

    nodes = 1 << 62

    def __init__(self):
        self.edges: dict[int, int] = {}

    def name(self, node):
        return node

    number = name


def parse_into(out: Phrases, data: bytes, dictionary) -> None:
    """Phrases of ``data``, parsed with and entered into ``dictionary``, which must be new.

    Until a dictionary is full all of them parse alike: each phrase is a known one and a letter. Only then the rest is
    parsed step by step with the dictionary's own rules, which take over what was entered so far.
    """
    edges, limit, walks, letters, node, new = dictionary.edges, dictionary.nodes, [], [], ROOT, 1
    rest = iter(data)
    for c in rest:
        child = edges.get(node << 8 | c)
        if child is not None:
            node = child
            continue
        edges[node << 8 | c] = new
        walks.append(node)
        letters.append(c)
        node = ROOT
        new += 1
        if new >= limit:
            break
    length = [0]
    for v in walks:
        length.append(length[v] + 1)
    out.add_all(NODE, np.array(length[1:], np.int64), node=dictionary.name(np.array(walks, np.int64)) if limit > 1 << 61 else np.array([dictionary.name(v) for v in walks], np.int64), literal=np.array(letters, np.int64))
    if new < limit:
        if node:
            out.add(TRIE, length[node], node=dictionary.name(node))
        return
    dictionary.adopt(walks, letters)
    extend, name, depth = dictionary.extend, dictionary.name, 0
    for c in rest:
        child = extend(node, c)
        if child < 0:
            out.add(NODE, depth + 1, node=name(node), literal=c)
            node, depth = ROOT, 0
        else:
            node, depth = child, depth + 1
    if depth:
        out.add(TRIE, depth, node=name(node))


def decode_all(walks: list[int], letters: list[int], dictionary) -> bytearray:
    """The bytes of the phrases (published node, letter or -1) of one stream; ``dictionary`` must be new."""
    out, begin, size = bytearray(), [], []
    plain = min(len(walks), dictionary.nodes - 1)
    walks = [dictionary.number(v) for v in walks]
    for v, c in zip(walks[:plain], letters[:plain], strict=True):
        begin.append(len(out))
        if v:  # its text stands where phrase v - 1 did
            out += out[begin[v - 1] : begin[v - 1] + size[v - 1]]
        if c >= 0:
            out.append(c)
        size.append(len(out) - begin[-1])
    if plain == len(walks):
        return out
    for i, (v, c) in enumerate(zip(walks[:plain], letters[:plain], strict=True), 1):
        dictionary.edges[v << 8 | c] = i
    dictionary.adopt(walks[:plain], letters[:plain])
    for v, c in zip(walks[plain:], letters[plain:], strict=True):
        spelled = dictionary.spell(v)
        out += spelled
        at = ROOT
        for letter in spelled:
            at = dictionary.extend(at, letter)
        if c >= 0:
            dictionary.extend(at, c)
            out.append(c)
    return out


def _parse(streams: DataFrame, make: Callable[[], object]) -> DataFrame:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = Phrases()
        for stream, data in zip(batch.column("stream_id").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
            out.start(stream)
            parse_into(out, data or b"", make())
        return out.batch()

    return map_rows(streams.select("stream_id", "bytes"), work, SCHEMA)


def _decode(phrases: DataFrame, make: Callable[[], object]) -> DataFrame:
    def work(stream: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
        return decoded(stream, decode_all(columns["node"].tolist(), columns["literal"].tolist(), make()))

    return map_groups(phrases, "stream_id", ["seq", "node", "literal"], work, DECODED)


def lz78_parse(streams: DataFrame) -> DataFrame:
    """Exact LZ78: every phrase but a last unfinished one is new. Empty streams have no phrases."""
    return _parse(streams, _Everything)


def lz78_decode(phrases: DataFrame) -> DataFrame:
    return _decode(phrases, _Everything)


def topk_lz78_parse(streams: DataFrame, k: int = 1 << 20, max_freq: int = 1 << 10) -> DataFrame:
    """LZ78 whose dictionary is a sketch of k frequent prefixes."""
    return _parse(streams, lambda: FrequentPrefixes(k + 1, max_freq))


def topk_lz78_decode(phrases: DataFrame, k: int = 1 << 20, max_freq: int = 1 << 10) -> DataFrame:
    return _decode(phrases, lambda: FrequentPrefixes(k + 1, max_freq))


def age_lz78_parse(streams: DataFrame, k: int = 1 << 20) -> DataFrame:
    """LZ78 whose dictionary has k nodes, the root included, and evicts the leaf inserted longest ago."""
    return _parse(streams, lambda: RecentPrefixes(k))


def age_lz78_decode(phrases: DataFrame, k: int = 1 << 20) -> DataFrame:
    return _decode(phrases, lambda: RecentPrefixes(k))
