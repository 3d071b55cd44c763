"""Sources, functions, substring tables, token costs, planning."""

from __future__ import annotations

import heapq
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from refrain.functions import scalar
from refrain.operators import chunks, lz78, metrics, substrings, tokens
from refrain.plans import planner
from refrain.sources import corpus as sources

FINGERPRINTS = {b"": 0, b"\0": 0, b"a": 97, b"b": 98, b"ab": 25027, b"abra": 1653037718, b"abracadabra": 1220480809978667225, "é".encode(): 50284, b"the quick brown fox jumps": 2048642903558697282}


def test_fingerprint(spark):
    rows = spark.createDataFrame([(k,) for k in [*FINGERPRINTS, None]], "b binary")
    got = rows.select("b", scalar.fingerprint(F.col("b")).alias("f")).collect()
    assert {bytes(r["b"]): r["f"] for r in got if r["b"] is not None} == FINGERPRINTS
    assert [r["f"] for r in got if r["b"] is None] == [None]
    assert all(scalar.fingerprint_of(k) == v for k, v in FINGERPRINTS.items())


VARINTS = {0: "00", 127: "7f", 128: "8001", 300: "ac02", 16383: "ff7f", 16384: "808001", 1 << 32: "8080808010"}


def test_varint(spark):
    rows = spark.createDataFrame([(v,) for v in VARINTS], "v long")
    got = rows.select("v", scalar.varint_size(F.col("v")).alias("n"), scalar.varint_encode(F.array("v")).alias("b")).withColumn("back", scalar.varint_decode(F.col("b"))).collect()
    for r in got:
        assert bytes(r["b"]).hex() == VARINTS[r["v"]] and r["n"] == len(r["b"]) and list(r["back"]) == [r["v"]]


def test_bit_width_and_division(spark):
    rows = spark.createDataFrame([(0,), (1,), (2,), (255,), (256,)], "v long")
    assert [r[0] for r in rows.orderBy("v").select(scalar.bit_width(F.col("v"))).collect()] == [0, 1, 2, 8, 9]
    assert [r[0] for r in rows.orderBy("v").select(scalar.ceil_div(F.col("v"), 2)).collect()] == [0, 1, 1, 128, 128]


def test_sizes():
    assert [sources.parse_size(x) for x in ("32Ki", "1M", "7", 5, "2 Gi")] == [32768, 10**6, 7, 5, 2 << 30]
    with pytest.raises(ValueError):
        sources.parse_size("3 Ti")


def test_windows_and_prefix(spark):
    rows = spark.createDataFrame([(1, "abcdefg"), (2, ""), (3, None), (4, "abcd")], "id long, t string")
    got = sources.windows(sources.corpus(rows, "id", "t"), 4).collect()
    assert sorted((r["stream_id"], r["window_id"], r["base"], bytes(r["bytes"])) for r in got) == [(1, 0, 0, b"abcd"), (1, 1, 4, b"efg"), (4, 0, 0, b"abcd")]
    cut = sources.corpus(rows, "id", "t", limit=2, sentinel=True).collect()
    assert {r["stream_id"]: bytes(r["bytes"]) for r in cut} == {1: b"ab\0", 2: b"\0", 4: b"ab\0"}


def test_files(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"\0\xffabc")
    got = sources.read_files(spark, str(tmp_path / "*.bin"), limit=4).collect()
    assert [bytes(r["bytes"]) for r in got] == [b"\0\xffab"]


def test_frequencies_csv(spark, tmp_path):
    table = spark.createDataFrame([(97, 1, 5), (25027, 2, 2)], "fp long, len int, freq long")
    sources.write_frequencies(table, str(tmp_path / "f"))
    assert sorted(map(tuple, sources.read_frequencies(spark, str(tmp_path / "f")).collect())) == [(97, 1, 5), (25027, 2, 2)]


def test_header_check(spark):
    rows = spark.createDataFrame([("lz77",), ("lz78",)], "codec string")
    assert sources.expect_header(rows.limit(1), "codec", "lz77").count() == 1
    with pytest.raises(Exception, match="expected lz77"):
        sources.expect_header(rows, "codec", "lz77").collect()


ABRACADABRA = [("a", 5), ("b", 2), ("r", 2), ("ab", 2), ("br", 2), ("ra", 2), ("abr", 2), ("bra", 2), ("abra", 2), ("c", 1), ("d", 1), ("ac", 1)]


@pytest.mark.parametrize("unit", ["byte", "char"])
def test_topk_golden(spark, unit):
    rows = spark.createDataFrame([(1, b"abracadabra")], "stream_id long, bytes binary")
    got = substrings.topk_substrings(rows, 12, unit=unit).collect()
    assert sorted(((r["sub"], r["freq"]) for r in got), key=lambda x: (-x[1], len(x[0]), x[0])) == ABRACADABRA


def brute(texts, k, longest=None):
    counts = Counter(t[i:j] for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1) if longest is None or j - i <= longest)
    return sorted(counts.items(), key=lambda x: (-x[1], len(x[0]), x[0]))[:k]


def test_topk_against_brute_force(spark):
    texts = ["the cat and the hat", "a cat, the bat", "añb añb ñ", "", "zzzzzz"]
    rows = spark.createDataFrame([(i % 2, t.encode()) for i, t in enumerate(texts)] + [(1, None)], "g int, bytes binary")
    for k, longest in ((1, None), (17, None), (60, 3), (10_000, None)):
        got = [(r["sub"], r["freq"]) for r in substrings.topk_substrings(rows, k, longest, "char").collect()]
        assert sorted(got, key=lambda x: (-x[1], len(x[0]), x[0])) == brute(texts, k, longest)
    got = substrings.topk_substrings(rows, 9, unit="char", by=("g",)).collect()
    for g in (0, 1):
        mine = sorted(((r["sub"], r["freq"]) for r in got if r["g"] == g), key=lambda x: (-x[1], len(x[0]), x[0]))
        assert mine == brute(texts[g::2], 9)
    assert substrings.topk_substrings(rows.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        substrings.topk_substrings(rows, 0)


def test_ngrams_and_expansion(spark):
    rows = spark.createDataFrame([(1, b"abc"), (2, b"")], "id int, bytes binary")
    assert sorted((r["sub"], r["len"]) for r in substrings.ngrams(rows, 2).collect()) == [("a", 1), ("ab", 2), ("b", 1), ("bc", 2), ("c", 1)]
    nodes = spark.createDataFrame([(1, 3, 9)], "parent_depth int, depth int, freq long")
    assert [(r["len"], r["freq"]) for r in substrings.expand_lengths(nodes).collect()] == [(2, 9), (3, 9)]


def test_overlap(spark):
    exact = spark.createDataFrame([(5, 1, 9), (4, 1, 8), (3, 1, 7), (2, 1, 6), (1, 1, 5)], "fp long, len int, freq long")
    approx = spark.createDataFrame([(5,), (3,), (9,), (9,)], "fp long")
    row = substrings.topk_overlap(exact, approx).first()
    assert (row["k"], row["hits"], round(row["score"], 4)) == (3, 2, 0.6667)
    with pytest.raises(Exception, match="fewer exact"):
        substrings.topk_overlap(exact.limit(2), approx).collect()


def test_merged_sketches_are_lower_bounds(spark):
    texts = [b"the cat sat on the mat " * 3, b"the dog sat on the log " * 3, b""]
    rows = spark.createDataFrame(list(enumerate(texts)), "stream_id long, bytes binary").repartition(2)
    got = substrings.approx_topk_substrings(rows, 40, 64, mode="merged").collect()
    assert 0 < len(got) <= 40
    for r in got:
        s = bytes(r["substr"])
        assert r["freq_lower"] <= sum(t.startswith(s, i) for t in texts for i in range(len(t)))


def test_prefix_matches(spark):
    texts = spark.createDataFrame([(1, "abcab"), (2, "")], "stream_id long, t string")
    words = spark.createDataFrame([("a", 1), ("ab", 2), ("bca", 3)], "sub string, node long")
    got = substrings.longest_prefix_matches(texts, words).collect()
    assert sorted((r["pos"], r["node"], r["depth"]) for r in got) == [(1, 2, 2), (2, 3, 3), (4, 2, 2)]
    assert substrings.longest_prefix_matches(texts, words.limit(0)).count() == 0


def test_tokens_and_costs(spark):
    phrases = spark.createDataFrame(
        [(1, 0, 0, "lit", 0, 1, None, None, 97), (1, 0, 1, "ref", 1, 300, 1, None, None), (1, 0, 2, "ref", 301, 4, 7, None, None), (1, 0, 3, "trie", 305, 2, None, 9, None)],
        "stream_id long, window_id int, seq long, kind string, pos long, len long, dist long, node long, literal smallint",
    )
    got = [(r["block_id"], r["type"], r["value"]) for r in tokens.tokens(phrases, 4, split_long=True, hybrid=True).orderBy("ord").collect()]
    assert got == [(0, 0, 1), (0, 2, 97), (0, 0, 255), (0, 3, 45), (1, 1, 1), (1, 0, 4), (1, 1, 7), (1, 0, 0), (2, 4, 9)]
    costs = {(r["block_id"], r["type"]): (r["n"], r["header_bits"], r["data_bits"]) for r in tokens.binary_costs(tokens.tokens(phrases, 100, hybrid=True)).collect()}
    assert costs[0, 0] == (4, 9 + 9, 4 * 9)  # lengths 1, 300, 4, 0
    total = tokens.cost_rollup(tokens.binary_costs(tokens.tokens(phrases, 100, hybrid=True))).where("type is null").first()
    assert total["n"] == 8


def test_code_lengths_are_optimal():
    for counts in ([5], [1, 1], [1, 2, 4, 8], [3, 3, 3, 3, 3], list(range(1, 30))):
        lengths = tokens.code_lengths(counts)
        assert sum(2.0**-n for n in lengths) <= 1 or len(counts) == 1
        heap, total = list(counts), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            a = heapq.heappop(heap) + heapq.heappop(heap)
            total += a
            heapq.heappush(heap, a)
        if len(counts) > 1:
            assert sum(n * c for n, c in zip(lengths, counts, strict=True)) == total


def test_entropy_bounds_huffman(spark):
    rows = spark.createDataFrame([(1, 0, 2, v) for v in b"abracadabra"], "stream_id long, block_id long, type tinyint, value long")
    bits, h = tokens.huffman_costs(rows).first()["data_bits"], tokens.entropy(rows, ["stream_id"]).first()["entropy_bits"]
    assert h <= bits <= h + 11
    assert math.isclose(h, sum(-c * math.log2(c / 11) for c in Counter(b"abracadabra").values()), abs_tol=1e-5)


def test_metrics(spark):
    rows = spark.createDataFrame([(1, b"abab"), (2, b"a")], "stream_id long, bytes binary")
    got = {r["stream_id"]: (r["z"], r["len_max"], r["len_avg"]) for r in metrics.lz78_metrics(lz78.topk_lz78_parse(rows, 2, 16), unfinished=False).collect()}
    assert got == {1: (3, 2, 1.33), 2: (1, 1, 1.0)}
    named = metrics.as_records(metrics.lz78_metrics(lz78.lz78_parse(rows))).where("stream_id = 1 and name = 'z'").first()
    assert named["value"] == 3.0
    assert metrics.described(metrics.lz78_metrics(lz78.lz78_parse(rows)), algo="lz78").columns == ["stream_id", "algo", "len_avg", "len_max", "z"]


def test_plan(spark):
    rows = spark.createDataFrame([(1_000_000, 1_000_000), (10_000_000, 100_000), (1_000_000, 0), (0, 0)], "n long, memory long")
    got = [(r["prepass_block"], r["sampling"], r["prepass"], r["k"], r["window"]) for r in planner.plan(rows).collect()]
    assert got[0] == (50_000, 7, True, 4310, 62_501)
    assert got[1] == (5_000, 13, False, 431, 6_250)
    assert got[2] == got[0] and got[3][4] == 0


def test_prepass(spark):
    same = spark.createDataFrame([(i, b"the same forty bytes or so of text, again" * 50) for i in range(20)], "stream_id long, bytes binary")
    out = planner.prepass(same, 20 * 2050)
    assert out["parsing"] > 0 and out["accepted"]
    assert not planner.prepass(same, 0)["accepted"]
    assert planner.adapt_sampling(7, 0, 1000, 10, 16, 4, 10**9) == planner.MIN_SAMPLING
    assert planner.adapt_sampling(7, 0, 10**6, 10**5, 16, 4, 10**6) > 7


def test_gate(spark):
    rows = spark.createDataFrame([(1, b""), (2, None)], "stream_id long, bytes binary")
    row = chunks.cardinality_gate(rows, 4, exact=True).first()
    assert (row["parsing"], row["ratio"], row["accepted"]) == (0, None, False)


def test_first_occurrences(spark):
    rows = [(7, b"banana"), (3, b"nan"), (9, None), (5, b"")]
    got = substrings.topk_substrings(spark.createDataFrame(rows, "stream_id long, bytes binary"), 8, occurrence=True).collect()
    for r in got:
        places = [(i, d.index(r["sub"].encode())) for i, d in rows if d and r["sub"].encode() in d]
        assert tuple(r["first"]) == min(places)
    assert len(got) == 8


def test_merged_sketch_does_not_depend_on_partitions(spark):
    rows = [(i, f"text {i % 7} and {i % 3} more".encode()) for i in range(60)]
    frame = spark.createDataFrame(rows, "stream_id long, bytes binary")
    one, many = (sorted(map(tuple, substrings.approx_topk_substrings(f, 20, 16, mode="merged").collect())) for f in (frame.coalesce(1), frame.repartition(9)))
    assert one == many and len(one) > 0


def test_byte_counts(spark):
    frame = spark.createDataFrame([(1, b"aab"), (2, None), (3, b"\xff")], "stream_id long, bytes binary")
    assert sorted(map(tuple, tokens.byte_counts(frame).collect())) == [(97, 2), (98, 1), (255, 1)]
