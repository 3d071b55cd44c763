"""Parsers and dictionaries: golden vectors, round trips and invariants."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from refrain.operators import hybrid, lz77, lz78
from refrain.operators.chunks import approximate_references, cuts
from refrain.operators.dictionaries import FrequentPrefixes, RecentPrefixes
from refrain.operators.lz77 import references, suffix_array
from refrain.operators.lz78 import _Everything, parse_into
from refrain.operators.phrases import Phrases

EDGES = [b"a", b"aaaaaaaa", b"abababab", b"abcdefg", b"mississippi", b"abracadabra", b"a\0", b"\0\0b\0", bytes(range(256)) * 2, b"x" * 300, b"x" * 256, "aéb é".encode() * 9, b"abc" * 7 + b"d"]


def phrases(data: bytes, dictionary) -> list[tuple]:
    out = Phrases()
    parse_into(out, data, dictionary)
    return [tuple(r) for r in out.columns[[7, 8, 5]].T.tolist()]


def substring_sketch(data: bytes, k: int, max_freq: int) -> FrequentPrefixes:
    sketch = FrequentPrefixes(k + 1, max_freq)
    for at in range(len(data)):
        sketch.enter(data, at, len(data))
    return sketch


@pytest.mark.parametrize(
    ("text", "lz78_z", "longest", "one", "two"),
    [(b"abracadabra", 7, 2, (8, 5), (8, 7)), (b"aaaaaaaa", 4, 3, (2, 1), (2, 1)), (b"abababab", 5, 3, (3, 2), (3, 2)), (b"a", 1, 1, (1, 1), (1, 1)), (b"abcdefg", 7, 1, (7, 7), (7, 7)), (b"mississippi", 8, 2, (8, 4), (8, 7))],
)
def test_golden_parse_sizes(text, lz78_z, longest, one, two):
    found = phrases(text, _Everything())
    assert (len(found), max(p[2] for p in found)) == (lz78_z, longest)
    for least, (z, literals) in ((1, one), (2, two)):
        refs = references(text, least)
        plain = len(text) - sum(r[2] for r in refs)
        assert (len(refs) + plain, plain) == (z, literals)


def test_golden_sketches():
    s = substring_sketch(b"aab\0", 3, 16)
    assert [(v, sub, f) for v, _, _, f, sub in s.rows()] == [(1, b"b", 1), (2, b"ab", 1), (3, b"a", 2)]
    assert (s.threshold, s.renormalised) == (1, 0)
    s = substring_sketch(b"aabab\0", 3, 16)
    assert [(v, sub, f) for v, _, _, f, sub in s.rows()] == [(1, b"\0", 3), (2, b"ab", 2), (3, b"a", 3)]
    assert s.threshold == 2


def test_golden_bounded_parses():
    assert phrases(b"abab", FrequentPrefixes(3, 16)) == [(0, 97, 1), (0, 98, 1), (2, 98, 2)]
    assert phrases(b"a", FrequentPrefixes(3, 16)) == [(0, 97, 1)]
    assert phrases(b"abab", RecentPrefixes(3)) == [(0, 97, 1), (0, 98, 1), (1, 98, 2)]


def test_golden_hybrid():
    def parse(window):
        out, sketch = Phrases(), FrequentPrefixes(1000, 1024)
        for base in range(0, 8, window):
            part = b"abababab"[base : base + window]
            hybrid.parse_window(out, part, sketch, references(part), 1)
        return [["lit", "ref", "node", "trie"][k] for k in out.columns[3]], out.columns[5].tolist()

    assert parse(8) == (["lit", "lit", "ref"], [1, 1, 6])
    assert parse(4) == (["lit", "lit", "ref", "trie", "lit", "ref"], [1, 1, 2, 1, 1, 2])


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=120), st.integers(1, 8))
def test_sketch_counts_are_lower_bounds(data, k):
    s = substring_sketch(data, k, 16)
    rows = s.rows()
    assert len(rows) <= k
    by_node = {v: f for v, _, _, f, _ in rows}
    for v, parent, _, f, sub in rows:
        assert max(f - s.threshold, 0) <= sum(data.startswith(sub, i) for i in range(len(data)))
        assert parent == 0 or by_node[parent] >= f or by_node[parent] >= s.threshold


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc", max_size=150))
def test_references_are_greedy_and_valid(text):
    data = text.encode()
    at = 0
    for pos, dist, length in references(data, 1):
        while at < pos:  # literals have not been seen before
            assert data.find(data[at : at + 1], 0, at) < 0
            at += 1
        assert 1 <= dist <= pos
        assert all(data[pos + i] == data[pos - dist + i] for i in range(length))
        assert pos + length == len(data) or data.find(data[pos : pos + length + 1], 0, pos + length) < 0
        at = pos + length


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=200))
def test_suffix_array(data):
    if data:
        assert suffix_array(data).tolist() == sorted(range(len(data)), key=lambda i: data[i:])


def test_long_runs_stay_fast():
    assert references(b"a" * 200_000) == [(1, 1, 199_999)]


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=3000))
def test_chunks_cover_and_copy(data):
    assert not data or cuts(data, 4)[-1] == len(data)
    for pos, dist, length in approximate_references(data * 2, 4):
        twice = data * 2
        assert dist > 0 and twice[pos : pos + length] == twice[pos - dist : pos - dist + length]


def streams(spark):
    rng = random.Random(5)
    noise = [bytes(rng.choice(b"ab") for _ in range(n)) for n in (999, 1000, 1001)]
    rows = list(enumerate([*EDGES, *noise, b"", None, EDGES[4]]))
    return spark.createDataFrame(rows, "stream_id long, bytes binary").repartition(3), {i: d for i, d in rows if d}


CODECS = {
    "lz77": (lz77.lz77_parse, lz77.lz77_decode),
    "lz77 windows": (lambda s: lz77.lz77_parse(s, 100), lz77.lz77_decode),
    "lz78": (lz78.lz78_parse, lz78.lz78_decode),
    "top-k lz78": (lambda s: lz78.topk_lz78_parse(s, 20, 16), lambda p: lz78.topk_lz78_decode(p, 20, 16)),
    "age lz78": (lambda s: lz78.age_lz78_parse(s, 20), lambda p: lz78.age_lz78_decode(p, 20)),
    "hybrid": (lambda s: hybrid.topk_lz77_parse(s, 50, 100, 16, 0, 3), lambda p: hybrid.topk_lz77_decode(p, 50, 16, 3)),
    "hybrid, sampled": (lambda s: hybrid.topk_lz77_parse(s, 50, 512, 16, 4, 1), lambda p: hybrid.topk_lz77_decode(p, 50, 16, 1)),
}


@pytest.mark.parametrize("name", CODECS)
def test_round_trip(spark, name):
    rows, want = streams(spark)
    parse, decode = CODECS[name]
    found = parse(rows).cache()
    assert {r["stream_id"]: bytes(r["bytes"]) for r in decode(found).collect()} == want
    each: dict[int, list] = {}
    for r in sorted(found.collect(), key=lambda r: (r["stream_id"], r["seq"])):
        each.setdefault(r["stream_id"], []).append(r)
    for i, rs in each.items():
        assert [r["pos"] for r in rs] == [sum(x["len"] for x in rs[:n]) for n in range(len(rs))]
        assert sum(r["len"] for r in rs) == len(want[i])


def test_bounded_dictionaries_never_overflow():
    for data in (b"a" * 500, bytes(range(256)) * 4):
        for k in (2, 3, 5):
            assert sum(p[2] for p in phrases(data, RecentPrefixes(k))) == len(data)
            assert sum(p[2] for p in phrases(data, FrequentPrefixes(k, 8))) == len(data)


def test_parameters_are_checked():
    with pytest.raises(ValueError):
        FrequentPrefixes(5, 4)
    with pytest.raises(ValueError):
        RecentPrefixes(1)


def test_stream_equals_batch(spark, tmp_path):
    from refrain.streaming.parse import stream_lz78

    data = b"the cat sat on the mat, the cat sat on the hat; " * 5
    parts = [(7, i, data[i * 30 : i * 30 + 30], i * 30 + 30 >= len(data)) for i in range(-(-len(data) // 30))]
    schema = "stream_id long, chunk long, bytes binary, last boolean"
    for i, part in enumerate(parts):  # a micro-batch each
        spark.createDataFrame([part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    query = stream_lz78(source, 30, 16).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r["seq"], r["node"], r["literal"], r["len"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = lz78.topk_lz78_parse(spark.createDataFrame([(7, data)], "stream_id long, bytes binary"), 30, 16)
    assert got == sorted((r["seq"], r["node"], r["literal"], r["len"]) for r in batch.collect())


class PlainFrequent:
    """The frequency-bounded dictionary from its definition, nothing clever: every choice looks at all entries."""

    def __init__(self, nodes, max_freq):
        self.k, self.cap, self.threshold, self.clock = nodes - 1, max_freq - 1, 0, 0
        self.entries = {}  # string -> [published number, counter, when it was last linked as a leaf]

    def _leaf(self, s):
        return not any(len(t) == len(s) + 1 and t.startswith(s) for t in self.entries)

    def step(self, s, c):
        """Whether s + c was known; it is counted, or entered if there is room."""
        t, self.clock = s + c, self.clock + 1
        if t in self.entries:
            entry = self.entries[t]
            f = max(entry[1], self.threshold)
            if f < self.cap:
                entry[1:] = [f + 1, self.clock]
            return True
        if len(self.entries) < self.k:
            self.entries[t] = [self.k - len(self.entries), self.threshold + 1, self.clock]
            return False
        free = [x for x, (_, f, _) in self.entries.items() if max(f, self.threshold) == self.threshold and self._leaf(x)]
        if free:
            gone = max(free, key=lambda x: self.entries[x][2])
            number, f, _ = self.entries.pop(gone)
            if gone[:-1] in self.entries and self._leaf(gone[:-1]):
                self.entries[gone[:-1]][2] = self.clock
            self.entries[t] = [number, max(f, self.threshold) + 1, self.clock + 0.5]
        else:
            self.threshold += 1
            if self.threshold >= self.cap // 2:
                for entry in self.entries.values():
                    entry[1] = max(entry[1], self.threshold) - self.threshold
                self.threshold = 0
        return False

    def number(self, s):
        return self.entries[s][0] if s else 0

    def longest(self, data, at):
        n = 0
        while at + n < len(data) and data[at : at + n + 1] in self.entries:
            n += 1
        return n

    def enter(self, phrase):
        for i in range(len(phrase)):
            if not self.step(phrase[:i], phrase[i : i + 1]):
                break


class PlainAged(PlainFrequent):
    """The age-bounded one: entries stand in the order of their adding."""

    def step(self, s, c):
        t = s + c
        if t in self.entries:
            return True
        if len(self.entries) < self.k:
            self.entries[t] = [len(self.entries) + 1]
        else:
            gone = next((x for x in self.entries if x != s and self._leaf(x)), None)
            if gone is not None:
                self.entries[t] = self.entries.pop(gone)
        return False


def plain_lz78(data, dictionary):
    out, s, number = [], b"", 0
    for i in range(len(data)):
        c = data[i : i + 1]
        if dictionary.step(s, c):
            s += c
            number = dictionary.number(s)
        else:
            out.append((number, c[0], len(s) + 1))
            s, number = b"", 0
    return out + ([(number, -1, len(s))] if s else [])


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abc", max_size=250), st.integers(1, 12), st.sampled_from([5, 6, 9, 30]))
def test_bounded_parses_against_plain_ones(text, k, cap):
    data = text.encode()
    assert phrases(data, FrequentPrefixes(k + 1, cap)) == plain_lz78(data, PlainFrequent(k + 1, cap))
    assert phrases(data, RecentPrefixes(k + 1)) == plain_lz78(data, PlainAged(k + 1, 5))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab", max_size=250), st.integers(3, 14), st.sampled_from([5, 8, 40]), st.integers(4, 300), st.integers(1, 3))
def test_hybrid_against_a_plain_one(text, k, cap, window, suffixes):
    """At each place the longest entry of the plain dictionary against what is left of the exact reference there."""
    data, out = text.encode(), Phrases()
    sketch, plain, want = hybrid._sketch(k, cap), PlainFrequent(k - 1, cap), []
    for base in range(0, len(data), window):
        part = data[base : base + window]
        refs = references(part)
        hybrid.parse_window(out, part, sketch, refs, suffixes)
        at = 0
        while at < len(part):
            known = plain.longest(part, at)
            left, dist = next(((pos + n - at, d) for pos, d, n in refs if pos <= at < pos + n), (0, 0))
            if known and known >= left:
                want.append((3, known, -1, plain.number(part[at : at + known]), -1))
                at += known
            elif left > 1:
                want.append((1, left, dist, -1, -1))
                for x in range(min(left, suffixes)):
                    plain.enter(part[at + x : at + left])
                at += left
            else:
                want.append((0, 1, -1, -1, part[at]))
                at += 1
    c = out.columns
    assert list(zip(*(c[i].tolist() for i in (3, 5, 6, 7, 8)), strict=True)) == want


def test_dictionaries_take_memory_by_use():
    for one in (FrequentPrefixes(1 << 23, 1024), RecentPrefixes(1 << 23)):
        out = Phrases()
        parse_into(out, b"abracadabra", one)
        assert len(one.parent) < 20 and len(out.columns[0]) == 7
