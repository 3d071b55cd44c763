"""Lineage cuts, size-checked joins and event-time windows."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from refrain import runtime
from refrain.streaming.windows import tumbling_counts


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_cut_and_discard(spark):
    table = runtime.cut(spark.range(10).withColumn("x", F.col("id") * 2))
    assert table.count() == 10 and table.columns == ["id", "x"]
    path = table._refrain_path.removeprefix("file:")
    assert os.path.isdir(path) and runtime.table_bytes(table) > 0
    assert runtime.shared_dir(spark).removeprefix("file:") in path
    runtime.discard(table, spark.range(1))
    assert not os.path.exists(path)


def test_cut_of_nothing(spark):
    assert runtime.cut(spark.range(0)).count() == 0


def test_broadcast_is_checked(spark):
    small, big = runtime.cut(spark.range(100)), spark.range(1000)
    joined = runtime.join_small(big, small, "id", "inner")
    assert "BroadcastExchange" in plan(joined) and joined.count() == 100
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = runtime.join_small(big, small, "id", "inner", limit=10)
        assert "BroadcastExchange" not in plan(joined) and joined.count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_late_events(spark, tmp_path):
    rows = [("2024-01-01 00:01:00", "a", 1.0), ("2024-01-01 00:09:00", "a", 2.0), ("2024-01-01 05:00:00", "b", 4.0), (None, "b", 9.0)]
    frame = spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    batch = {(str(r["window_start"]), r["event_type"]): (r["n"], r["total"]) for r in tumbling_counts(frame, "10 minutes").collect()}
    assert batch == {("2024-01-01 00:00:00", "a"): (2, 3.0), ("2024-01-01 05:00:00", "b"): (1, 4.0)}
    frame.write.parquet(str(tmp_path / "in"))
    stream = tumbling_counts(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), "10 minutes", late="1 hour")
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r["total"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [3.0]


def test_tables_of_a_scope_go(spark):
    with runtime.tables() as made:
        gone, stays = runtime.cut(spark.range(3)), runtime.cut(spark.range(4))
        made.remove(stays)
    assert not os.path.exists(gone._refrain_path.removeprefix("file:")) and stays.count() == 4
    runtime.discard(stays)


def test_operators_leave_the_session_alone(spark):
    from refrain.operators.lz78 import lz78_decode, lz78_parse

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    streams = spark.createDataFrame([(1, bytearray(b"abracadabra"))], "stream_id long, bytes binary")
    assert lz78_decode(lz78_parse(streams)).count() == 1
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_phrases_are_packed_before_they_are_shuffled(spark):
    """Decoders get a row for each stream through the shuffle, wherever rows lie, and more partitions than their bytes ask for."""
    import pyarrow as pa

    from refrain.arrowio import _pack, _unpack
    from refrain.operators import lz77

    batch = pa.RecordBatch.from_arrays([pa.array([7, 7, 7, 5, 7]), pa.array([0, 2, 1, 0, 3]), pa.array([300, None, 5, 6, 70000])], ["id", "seq", "x"])
    rows = _pack(batch, "id", ["seq", "x"])
    assert rows.column("key").to_pylist() == [7, 5, 7] and rows.column("first").to_pylist() == [0, 0, 3]
    data = rows.column("data").to_pylist()
    assert {c: x.tolist() for c, x in _unpack([data[0], data[2]], ["seq", "x"]).items()} == {"seq": [0, 1, 2, 3], "x": [300, 5, -1, 70000]}
    streams = spark.createDataFrame([(i, b"abcabcabd" * i) for i in range(1, 40)], "stream_id long, bytes binary")
    phrases = lz77.lz77_parse(streams)
    want = {i: b"abcabcabd" * i for i in range(1, 40)}
    near, far = lz77.lz77_decode(phrases), lz77.lz77_decode(phrases.repartition(3, "seq"))
    assert plan(near).count("MapInArrow") < plan(far).count("MapInArrow")  # parsed and packed at once
    for back in (near, far):
        assert {r["stream_id"]: bytes(r["bytes"]) for r in back.collect()} == want
        assert back.rdd.getNumPartitions() == 4
