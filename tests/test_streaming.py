"""Streams against their batch twins."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.streaming import ticks as st

T0 = datetime(2024, 1, 1, 9, 15)
SCHEMA = "symbol string, ts timestamp, last_price double, volume long"


@pytest.fixture(scope="module")
def tick_files(spark, tmp_path_factory):
    rows = [(s, T0 + timedelta(seconds=37 * i), 100.0 + (i * 7 % 23) - (i % 5) * k, 10 * i + k) for i in range(120) for k, s in enumerate("ab")]
    path = str(tmp_path_factory.mktemp("ticks"))
    for i in range(0, len(rows), 60):
        spark.createDataFrame(rows[i : i + 60], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def drain(stream, name, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def test_bars_close_by_watermark(spark, tick_files, tmp_path):
    stream = st.bars(st.replay(spark, tick_files, SCHEMA), delay="1 minute")
    got = {(r.symbol, r.bar_start): tuple(r) for r in drain(stream, "bars", tmp_path).collect()}
    batch = {(r.symbol, r.bar_start): tuple(r) for r in st.bars(spark.read.parquet(tick_files)).collect()}
    last = max(t for _, t in batch)
    assert got and all(batch[k] == v for k, v in got.items())
    assert {k for k in batch if k[1] < last - timedelta(minutes=5)} <= got.keys()


def test_volume_deltas(spark, tick_files, tmp_path):
    got = drain(st.stream_volume_deltas(st.replay(spark, tick_files, SCHEMA)), "deltas", tmp_path)
    a = sorted((r.symbol, r.ts, r.delta) for r in got.collect())
    assert a == sorted((r.symbol, r.ts, r.delta) for r in st.volume_deltas(spark.read.parquet(tick_files)).collect())
    one = spark.createDataFrame([("a", T0, 1.0, 5), ("a", T0 + timedelta(1), 1.0, 3), ("a", T0 + timedelta(2), 1.0, 9)], SCHEMA)
    assert [r.delta for r in st.volume_deltas(one).orderBy("ts").collect()] == [0, 0, 6]


@pytest.fixture(scope="module")
def bar_files(spark, tick_files, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bars"))
    b = st.bars(spark.read.parquet(tick_files), 1)
    times = [r.bar_start for r in b.select("bar_start").distinct().orderBy("bar_start").collect()]
    for i in range(0, len(times), 20):
        b.where(F.col("bar_start").isin(times[i : i + 20])).coalesce(1).write.mode("append").parquet(path)
    return path


def test_entry_alerts(spark, bar_files, tmp_path):
    stored = spark.read.parquet(bar_files)
    watch = spark.createDataFrame([("a", 118.0), ("b", 110.0), ("z", 1.0)], "symbol string, trigger_price double")
    got = drain(st.entry_alerts(st.replay(spark, bar_files, stored.schema, 100), watch, 600), "alerts", tmp_path)
    a = sorted((r.symbol, r.bar_start, r.entry_price, r.stop) for r in got.collect())
    assert a and a == sorted((r.symbol, r.bar_start, r.entry_price, r.stop) for r in st.entry_alerts_batch(stored, watch, 600).collect())


def test_track_stops(spark, bar_files, tmp_path):
    stored = spark.read.parquet(bar_files)
    held = spark.createDataFrame([("a", 101.0, 90.0), ("b", 100.0, 60.0)], "symbol string, entry_price double, stop double")
    got = drain(st.track_stops(st.replay(spark, bar_files, stored.schema, 100), held), "stops", tmp_path)
    a = sorted((r.symbol, r.exit_time, r.exit_price, r.exit_reason) for r in got.collect())
    assert a and a == sorted((r.symbol, r.exit_time, r.exit_price, r.exit_reason) for r in st.track_stops_batch(stored, held).collect())


def test_idempotent_sink(spark, tmp_path):
    path = str(tmp_path / "sink")
    write = st.idempotent_sink(path)
    b = spark.createDataFrame([("s", "a", T0, 1.0), ("s", "a", T0, 1.0), ("s", "b", T0, 1.0)], "session_id string, symbol string, bar_end timestamp, close double")
    for n, rows in ((0, b), (0, b), (1, b.where("symbol = 'a'").withColumn("close", F.lit(2.0)))):
        write(rows, n)
    assert sorted((r.symbol, r.close) for r in st.read_sink(spark, path, ["session_id", "symbol", "bar_end"]).collect()) == [("a", 2.0), ("b", 1.0)]


def test_risk_flags(spark):
    r = spark.createDataFrame([(T0, -400.0, 9_000.0, 10_000.0, 10_000.0), (datetime(2024, 1, 1, 15, 20), 0.0, 1.0, 1.0, 10_000.0)], "ts timestamp, day_pnl double, equity double, peak double, capital double")
    assert [x.flags for x in st.risk_flags(r).collect()] == [["daily_loss", "drawdown"], ["cutoff"]]
