"""LZ77 parses: greedy longest previous occurrences, over whole streams or window by window, and their decoder."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refrain.arrowio import map_groups, map_rows
from refrain.operators.phrases import DECODED, LIT, REF, SCHEMA, TRIE, Phrases, copy, decoded


def suffix_array(data: bytes) -> np.ndarray:
    """Suffixes in order, by prefix doubling from seven letters on: O(n log n) a round, rounds logarithmic in the longest repeat."""
    n, k = len(data), 7
    letters = np.zeros(n + k, np.int64)
    letters[:n] = np.frombuffer(data, np.uint8).astype(np.int64) + 1
    key = np.zeros(n, np.int64)
    for i in range(k):
        key = key * 257 + letters[i : i + n]
    while True:
        order = np.argsort(key)
        ordered = key[order]
        new = np.ones(n, np.int64)
        new[1:] = ordered[1:] != ordered[:-1]
        place = np.cumsum(new)
        if place[-1] == n or k >= n:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = place
        key = rank * (n + 1)
        key[: n - k] += rank[k:]
        k *= 2


def _smaller_neighbours(order: np.ndarray) -> tuple[list[int], list[int]]:
    """For each text position, the nearest smaller positions before and after it in suffix order, -1 for none.

    Positions are linked in suffix order and taken out from the last on: those still beside one are smaller.
    """
    n = len(order)
    both = np.full((2, n + 1), -1)  # a spare entry, at -1, for links of the ends
    both[0, order[1:]] = order[:-1]
    both[1, order[:-1]] = order[1:]
    before, after = both.tolist()
    for p in range(n - 1, 0, -1):
        a, b = before[p], after[p]
        after[a] = b
        before[b] = a
    del before[n], after[n]
    return before, after


def _common(data: bytes, a: int, b: int) -> int:
    """Length of the longest common prefix of data[a:] and data[b:], a < b: letters one by one, then doubling and halving steps."""
    n, at, step = len(data) - b, 0, 16
    while at < n and at < step and data[a + at] == data[b + at]:
        at += 1
    if at < step:
        return at
    while at + step <= n and data[a + at : a + at + step] == data[b + at : b + at + step]:
        at += step
        step *= 2
    while step:
        if at + step <= n and data[a + at : a + at + step] == data[b + at : b + at + step]:
            at += step
        else:
            step //= 2
    return at


#: Letters that are compared for all positions at once.
_SHORT = 16


def _eights(data: bytes) -> np.ndarray:
    """The eight letters from each position on as one number; zeros follow the end, where eight more positions stand."""
    n = len(data)
    letters = np.zeros(n + _SHORT, np.uint64)
    letters[:n] = np.frombuffer(data, np.uint8)
    for k in (1, 2, 4):  # letters held by each number so far
        letters = letters[:-k] << np.uint64(8 * k) | letters[k:]
    return letters[: n + 8]


def _equal_letters(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of eight letters are equal before the first that differs."""
    differ = a ^ b
    out = 8 * (differ == 0)
    for k in (4, 2, 1):
        same = differ >> np.uint64(64 - 8 * k) == 0
        out += k * (same & (differ != 0))
        differ = np.where(same, differ << np.uint64(8 * k), differ)
    return out


def _common_start(eights: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Length, _SHORT at most, of the common prefix of the text from i and from source[i] < i, for every i; 0 where there is no source."""
    at = np.flatnonzero(source >= 0)
    from_ = source[at]
    same = _equal_letters(eights[at], eights[from_])
    more = np.flatnonzero(same == 8)
    same[more] += _equal_letters(eights[at[more] + 8], eights[from_[more] + 8])
    out = np.zeros(len(source), np.int64)
    out[at] = np.minimum(same, len(source) - at)
    return out


def references(data: bytes, min_ref_len: int = 2) -> list[tuple[int, int, int]]:
    """(position, distance, length) of the greedy parse's references; positions between them are literals.

    Of equally long earlier occurrences the nearer of the two neighbours in suffix order is taken. Sources may overlap.
    """
    if len(data) < 2:
        return []
    before, after = _smaller_neighbours(suffix_array(data))
    eights, n = _eights(data), len(data)
    one, two = np.fromiter(before, np.int64, n), np.fromiter(after, np.int64, n)
    short, other = _common_start(eights, one), _common_start(eights, two)
    best = np.maximum(short, other)
    nearer = np.where((other > short) | (other == short) & (two > one), two, one).tolist()
    long = np.append(np.where(best >= min(min_ref_len, _SHORT), np.arange(n), n), n)
    following = np.minimum.accumulate(long[::-1])[::-1].tolist()  # from each position on, the first that may begin a reference
    best = best.tolist()
    out, at = [], following[0]
    while at < n:
        length, source = best[at], nearer[at]
        if length == _SHORT:
            length, source = _common(data, before[at], at) if short[at] == _SHORT else 0, before[at]
            rival = _common(data, after[at], at) if other[at] == _SHORT else 0
            if rival > length or rival == length and after[at] > source:
                length, source = rival, after[at]
        if length >= min_ref_len:
            out.append((at, at - source, length))
            at = following[at + length]
        else:
            at = following[at + 1]
    return out


#: Longest texts whose references a worker remembers, and how many: 1000 bytes have some 100 references.
_REMEMBERED, _TEXTS = 1 << 10, 1 << 10


@lru_cache(_TEXTS)
def _again(data: bytes, min_ref_len: int) -> list[tuple[int, int, int]]:
    return references(data, min_ref_len)


def window_phrases(out: Phrases, data: bytes, refs: list[tuple[int, int, int]]) -> None:
    """The phrases of a window: its references, and a literal for each byte between them. A negative distance -v is dictionary entry v."""
    n = len(data)
    pos, dist, length = np.array(refs, np.int64).reshape(-1, 3).T
    inside = np.zeros(n + 1, np.int32)
    inside[pos + 1] += 1
    inside[pos + length] -= 1  # ends differ
    at = np.flatnonzero(np.cumsum(inside[:n]) == 0)  # where phrases begin
    ref = np.searchsorted(at, pos)
    kind, size, back, entry, letter = np.full(len(at), LIT), np.ones(len(at), np.int64), np.full(len(at), -1), np.full(len(at), -1), np.frombuffer(data, np.uint8)[at].astype(np.int64)
    kind[ref], size[ref], back[ref], entry[ref], letter[ref] = np.where(dist < 0, TRIE, REF), length, np.where(dist < 0, -1, dist), np.where(dist < 0, -dist, -1), -1
    out.add_all(kind, size, dist=back, node=entry, literal=letter)


def lz77_parse(streams: DataFrame, window: int | None = None, min_ref_len: int = 2) -> DataFrame:
    """Phrases of each stream; with ``window``, consecutive windows of so many bytes are parsed independently.

    Work and memory are O(n log n) and O(n) in a window, also for runs of one letter. Empty streams have no phrases.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = Phrases()
        for stream, data in zip(batch.column("stream_id").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
            out.start(stream)
            size = window or max(1, len(data or b""))
            for base in range(0, len(data or b""), size):
                part = data[base : base + size]
                window_phrases(out, part, (_again if len(part) <= _REMEMBERED else references)(part, min_ref_len))
                out.window += 1
        return out.batch()

    return map_rows(streams.select("stream_id", "bytes"), work, SCHEMA)


def lz77_decode(phrases: DataFrame) -> DataFrame:
    """(stream_id, bytes) from literals and references; streams without phrases are absent."""

    def work(stream: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
        out, dist, size, literal = bytearray(), *(columns[c] for c in ("dist", "len", "literal"))
        ref = np.flatnonzero(dist >= 0)
        letters = literal[dist < 0].astype(np.uint8).tobytes()
        at = 0
        for k, d, n in zip((ref - np.arange(len(ref))).tolist(), dist[ref].tolist(), size[ref].tolist(), strict=True):  # k literals come before
            out += letters[at:k]
            copy(out, d, n)
            at = k
        out += letters[at:]
        return decoded(stream, out)

    return map_groups(phrases, "stream_id", ["seq", "len", "dist", "literal"], work, DECODED)


def longest_previous(texts: DataFrame, key: str, text: str, longest: int | None = None) -> DataFrame:
    """(key, pos, len): longest previous occurrence at each position of short texts, in DataFrame functions only.

    For each length the previous start of the same substring is its lag in the text: rows are quadratic in a text's
    length, so it is meant for texts of some hundred letters; ``longest`` bounds the lengths looked at.
    """
    n = F.length(text)
    at = texts.select(F.col(key), F.col(text).alias("t"), F.explode(F.sequence(F.lit(1), n)).alias("pos")).where(F.length("t") > 0)
    most = F.length("t") - F.col("pos") + 1
    most = most if longest is None else F.least(F.lit(longest), most)
    subs = at.withColumn("l", F.explode(F.sequence(F.lit(1), most)))
    subs = subs.select(key, "pos", "l", F.expr("substring(t, pos, l)").alias("sub"))
    seen = subs.withColumn("prev", F.lag("pos").over(Window.partitionBy(key, "l", "sub").orderBy("pos")))
    return seen.groupBy(key, "pos").agg(F.coalesce(F.max(F.when(F.col("prev").isNotNull(), F.col("l"))), F.lit(0)).cast("long").alias("len"))
