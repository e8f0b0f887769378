"""Streams whose state ends: positions of both sides, alerts by day, repeated bars."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from barloom.streaming import positions as ps
from barloom.streaming import ticks as st

EVENTS = "symbol string, candle_time timestamp, open double, high double, low double, direction string, entry_price double, stop double, is_bar boolean"
START = datetime.datetime(2024, 1, 1, 9, 15)


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name, None)
    spark.conf.set(name, ps.ROCKSDB)
    yield
    spark.conf.set(name, old) if old else spark.conf.unset(name)


def drain(stream, name, folder, **options):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name).collect(), [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress]


def market(seed: int = 4, symbols: int = 40, days: int = 6):
    """Openings and bars in the order of time."""
    rng, events = random.Random(seed), []
    for s in range(symbols):
        name, price, bars = f"s{s}", 100.0, []
        for d in range(days):
            price *= 1 + rng.gauss(0, 0.03)
            for k in range(6):
                o = price
                price *= 1 + rng.gauss(0.001 * rng.choice((-1, 1)), 0.015)
                bars.append((START + datetime.timedelta(days=d, minutes=5 * k), o, max(o, price) * (1 + rng.random() * 0.01), min(o, price) * (1 - rng.random() * 0.01)))
        direction = rng.choice(("LONG", "SHORT"))
        entry = bars[2][1]
        events.append((name, bars[rng.randrange(3)][0], None, None, None, direction, entry, entry * (0.93 if direction == "LONG" else 1.07), False))
        events += [(name, *b, None, None, None, True) for b in bars]
    return sorted(events, key=lambda e: (e[1], e[8], e[0]))


def stored(spark, events, folder, parts: int, shuffle: int = 0):
    """Files in order, rows of a file in any; with shuffle, rows also move up to so many places."""
    order = sorted(range(len(events)), key=lambda i: i + (random.Random(i).random() * shuffle))
    size = -(-len(events) // parts)
    for p in range(0, len(events), size):
        spark.createDataFrame([events[i] for i in order[p : p + size]], EVENTS).coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder)


def split(df):
    bars = df.where("is_bar").select("symbol", "candle_time", "open", "high", "low")
    return bars, df.where("not is_bar").select("symbol", "direction", F.col("candle_time").alias("entry_time"), "entry_price", "stop")


def told(rows):
    return sorted((r.symbol, r.event, r.event_time, round(r.price, 9), r.reason) for r in rows)


@pytest.mark.parametrize(("partial", "tighten"), [(None, 3), (0.04, 2)])
def test_positions_in_a_stream(spark, tmp_path, partial, tighten):
    """Arrival mixed over files within the delay; a last row of another symbol moves the watermark behind all others."""
    events = market() + [("last", START + datetime.timedelta(days=9), 1.0, 1.0, 1.0, None, None, None, True)]
    path = stored(spark, events, tmp_path / "in", 7, 100)
    rules = ps.Rules(partial_pct=partial, tighten_after=tighten)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path)
    found, state = drain(ps.follow_stream(*split(stream), rules, "1 day"), f"followed{tighten}", tmp_path)
    expected = told(ps.follow_batch(*split(spark.read.parquet(path)), rules).collect())
    assert told(found) == expected and len(expected) > 20
    reasons = {e[4] for e in expected}
    assert {"STOP_TRAIL", "STOP_INITIAL", "GAP_THROUGH_STOP"} <= reasons and ("PARTIAL_EXIT" in reasons) == bool(partial)
    assert state[-1] < max(state)


def test_state_of_positions_ends(spark, tmp_path):
    """A closed position leaves nothing; one without bars is given up; a later opening begins anew."""
    day = lambda n: START + datetime.timedelta(days=n)
    opening = lambda s, n, price=100.0: (s, day(n), None, None, None, "LONG", price, price * 0.95, False)
    bar = lambda s, n, low, high=101.0: (s, day(n) + datetime.timedelta(minutes=5), 100.0, high, low, None, None, None, True)
    events = [opening("a", 0), bar("a", 0, 99.0), opening("b", 0), bar("b", 0, 99.0), bar("a", 1, 90.0), bar("a", 2, 80.0), opening("a", 3), opening("a", 3, 50.0), bar("a", 3, 94.0), ("z", day(30), 1.0, 1.0, 1.0, None, None, None, True), ("z", day(60), 1.0, 1.0, 1.0, None, None, None, True)]
    path = stored(spark, events, tmp_path / "in", 11)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path)
    found, state = drain(ps.follow_stream(*split(stream), ps.Rules(idle_days=20), "1 minute"), "ends", tmp_path)
    assert [(r.symbol, r.event, r.reason, r.stop) for r in sorted(found, key=lambda r: r.event_time)] == [("a", "EXIT", "STOP_INITIAL", 95.0), ("a", "EXIT", "STOP_INITIAL", 95.0), ("b", "UNFOLLOWED", None, 95.0)]
    assert max(state) >= 6 and state[-1] <= 2  # a row that waits, and its timer


def test_alerts_of_past_days_leave_no_state(spark, tmp_path):
    rows = [(s, START + datetime.timedelta(days=d, minutes=5 * k), 100.0, 100.0 + k, 99.0 - k) for d in range(3) for k in range(6) for s in ("a", "b", "c")]
    schema = "symbol string, bar_start timestamp, open double, high double, low double"
    for d in range(3):
        spark.createDataFrame(rows[18 * d : 18 * d + 18], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "bars"))
    spark.createDataFrame([("z", START + datetime.timedelta(days=5), 1.0, 1.0, 1.0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "bars"))
    watch = spark.createDataFrame([("a", 103.0), ("b", 101.0), ("c", 500.0)], "symbol string, trigger_price double")
    stream = st.replay(spark, str(tmp_path / "bars"), schema)
    found, state = drain(st.entry_alerts(stream, watch), "by_day", tmp_path)
    twin = st.entry_alerts_batch(spark.read.parquet(str(tmp_path / "bars")), watch).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, twin)) and len(found) == 6
    assert max(state) <= 6 and state[-1] == 0


def test_repeated_bars_arrive_once(spark, tmp_path):
    schema = "session_id string, symbol string, bar_end timestamp, close double"
    row = lambda s, k, c=1.0: ("x", s, START + datetime.timedelta(minutes=5 * k), c)
    batches = [[row("a", 0), row("a", 0), row("b", 0)], [row("a", 0, 2.0), row("a", 1)], [row("b", 0), row("b", 1), row("a", 1)], [row("a", 400)]]
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    keys = ["session_id", "symbol", "bar_end"]
    stream = st.once(st.replay(spark, str(tmp_path / "in"), schema), keys, "bar_end", "30 minutes")
    q = stream.writeStream.foreachBatch(st.idempotent_sink(out)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    on_disk = sorted((r.symbol, r.bar_end, r.close) for r in spark.read.parquet(out).collect())
    assert on_disk == sorted((s, t, 1.0) for _, s, t, _ in {row("a", 0), row("b", 0), row("a", 1), row("b", 1), row("a", 400)})
    state = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress]
    assert max(state) == 5 and state[-1] == 1


def test_replay_in_the_order_of_time(spark, tmp_path):
    """Rows stored in any order come day after day; a later run begins behind the days that were read."""
    rng = random.Random(8)
    schema = "symbol string, ts timestamp, last_price double"
    rows = [(rng.choice("ab"), START + datetime.timedelta(minutes=rng.randrange(60 * 24 * 6)), rng.random()) for _ in range(400)] + [("a", None, 1.0)]
    path, seen = str(tmp_path / "ticks"), []

    def note(batch, number):
        seen.extend((number, r.ts) for r in batch.collect())

    def run():
        st.replay_ordered(spark, path, schema).writeStream.foreachBatch(note).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    early = START + datetime.timedelta(days=3)
    frame = spark.createDataFrame(rows, schema).repartition(5)
    st.write_replay(frame.where(F.col("ts") < F.lit(early.date())), path, "ts")
    run()
    first = len(seen)
    st.write_replay(frame, path, "ts")
    run()
    assert sorted(t for _, t in seen) == sorted(t for _, t, _ in rows if t) and 0 < first < len(seen)
    days = [(n, t.date()) for n, t in seen]
    assert days == sorted(days) and len({n for n, _ in days}) == len({d for _, d in days})
    assert all(t.date() >= early.date() for _, t in seen[first:])


def test_late_ticks_are_counted(spark, tmp_path):
    schema = "symbol string, ts timestamp, last_price double, volume long"
    tick = lambda m: ("a", START + datetime.timedelta(minutes=m), 1.0, m)
    for batch in ([tick(0), tick(60)], [tick(61)], [tick(2), tick(3), tick(62)], [tick(300)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = st.bars(st.replay(spark, str(tmp_path / "in"), schema), delay="10 minutes").writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    # two ticks of one bar are partly added up before they are found late
    assert st.late_rows(q) == 1 and {r.n_ticks for r in spark.table("late").collect()} == {1, 3}
