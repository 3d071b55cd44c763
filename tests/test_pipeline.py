"""Block codec, planning compressor and the command line."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from refrain.__main__ import run
from refrain.operators import blockcodec, lz77, lz78, substrings, tokens
from refrain.plans.compressor import TopkLZ78, compress, prepass_decode, prepass_encode


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 1 << 40)), min_size=1, max_size=60))
def test_blocks_round_trip(pairs):
    types, values = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
    back = blockcodec.decode_block(blockcodec.encode_block(types.astype(np.uint8), values))
    assert back[0].tolist() == types.tolist() and back[1].tolist() == values.tolist()


def test_block_that_ends_early():
    data = blockcodec.encode_block(np.zeros(9, np.uint8) + 1, np.arange(9) * 1000)
    with pytest.raises((ValueError, IndexError)):
        blockcodec.decode_block(data[:-4])


def test_token_blocks(spark):
    rows = spark.createDataFrame([(1, b"abracadabra" * 20), (2, b"a"), (3, b"\0\xff" * 64)], "stream_id long, bytes binary")
    for phrases in (lz77.lz77_parse(rows), lz78.lz78_parse(rows)):
        for block in (1, 8, 1 << 15):
            table = tokens.tokens(phrases, block)
            coded = blockcodec.encode_blocks(table).cache()
            assert sorted(map(tuple, blockcodec.decode_blocks(coded, block).collect())) == sorted(map(tuple, table.collect()))
    bits = {r["stream_id"]: (r["blocks"], r["bits"]) for r in blockcodec.header_bits(tokens.tokens(lz78.lz78_parse(rows), 2), 2).collect()}
    assert bits[2] == (1, 33)


def test_prepass_round_trip(spark):
    rows = [(1, b"0123456789abcdefghij" * 30), (2, b""), (3, None), (4, bytes(range(256)) * 3)]
    frame = spark.createDataFrame(rows, "stream_id long, bytes binary")
    for sampling in (2, 5):
        got = {r["stream_id"]: r["bytes"] and bytes(r["bytes"]) for r in prepass_decode(prepass_encode(frame, sampling)).collect()}
        assert got == {i: d or (None if d is None else bytearray(b"")) for i, d in rows}


@pytest.mark.parametrize("precompress", [True, False])
def test_compress(spark, precompress):
    data = {1: b"the same forty bytes or so of text, again" * 80, 2: b"x", 3: b"the same forty bytes or so" * 9}
    frame = spark.createDataFrame(list(data.items()), "stream_id long, bytes binary")
    done = compress(frame, 20_000, precompress=precompress)
    assert {r["stream_id"]: bytes(r["bytes"]) for r in done.decompress().collect()} == data
    row = done.report().first()
    n = sum(map(len, data.values()))
    assert (row["streams"], row["n"], row["limit"]) == (3, n, 20_000) and 0 < row["nout"] < n and row["percent"] == round(100 * row["nout"] / n, 2) and row["seconds"] > 0
    assert precompress or not done.prepass["accepted"]
    assert compress(frame.limit(0)).phrases.count() == 0


def test_every_stream_has_its_own_plan(spark):
    data = {1: b"some text that comes again, " * 300, 2: b"short"}
    frame = spark.createDataFrame(list(data.items()), "stream_id long, bytes binary")
    done = compress(frame, precompress=False)
    plans = {r["stream_id"]: r for r in done.plans.collect()}
    assert plans[1]["k"] > plans[2]["k"] and plans[1]["window"] > plans[2]["window"] and plans[2]["plan_memory"] == 5
    assert {r["stream_id"]: r["k"] for r in done.phrases.select("stream_id", "k").distinct().collect()} == {i: max(3, r["k"]) for i, r in plans.items()}
    assert {r["stream_id"]: bytes(r["bytes"]) for r in done.decompress().collect()} == data


def test_codec_object(spark):
    frame = spark.createDataFrame([(1, b"abab")], "stream_id long, bytes binary")
    codec = TopkLZ78(2, 16)
    phrases = codec.compress(frame)
    assert codec.metrics(phrases).first()["z"] == 3
    assert bytes(codec.decompress(phrases).first()["bytes"]) == b"abab"


def test_sketch_dump_and_suffixes(spark):
    frame = spark.createDataFrame([(1, b"aab\0"), (2, b"")], "stream_id long, bytes binary")
    got = sorted((r["node"], r["parent"], r["label"], r["depth"], r["freq"], r["threshold"]) for r in substrings.sketch_dump(frame, 3, 16).collect())
    assert got == [(1, 0, 98, 1, 1, 1), (2, 3, 98, 2, 1, 1), (3, 0, 97, 1, 2, 1)]
    text = spark.createDataFrame([(1, b"banana")], "stream_id long, bytes binary")
    assert [(r["pos"], r["lcp"]) for r in substrings.lcp_array(text).orderBy("rank").collect()] == [(5, 0), (3, 1), (1, 3), (0, 0), (4, 0), (2, 2)]


def test_command_line(spark, tmp_path):
    data = b"abracadabra " * 30
    (tmp_path / "x.txt").write_bytes(data)
    path = str(tmp_path / "x.txt")
    for command in (["lz77"], ["lz77", "-w", "64"], ["lz78"], ["lz78-age", "-k", "50"], ["topk-lz78", "-k", "50", "-c", "16"], ["topk-lz77", "-k", "50", "-c", "16", "-w", "100"]):
        out = str(tmp_path / "-".join(command))
        assert run(spark, [command[0], path, "-o", out, *command[1:]]).first()["z"] > 0
        assert bytes(run(spark, [command[0], out, "-d", *command[1:]]).first()["bytes"]) == data
    exact, approx = str(tmp_path / "exact"), str(tmp_path / "approx")
    assert run(spark, ["topk", path, "-k", "40", "-e", "-o", exact]).count() == 40
    assert run(spark, ["topk", path, "-k", "30", "-o", approx]).count() > 0
    row = run(spark, ["compare", exact, approx]).first()
    assert 0 < row["score"] <= 1 and row["k"] <= 30
    assert run(spark, ["compress", path, "-m", "1Ki"]).first()["z"] > 0
    run(spark, ["lz77", path, "-w", "64", "-o"])
    assert bytes(run(spark, ["lz77", path + ".lz77block", "-d", "-w", "64", "-o"]).first()["bytes"]) == data
    assert (tmp_path / "x.txt.lz77block.dec").is_dir()
    assert run(spark, ["lz78", path, "-p", "5"]).first()["z"] == 4
