"""Positions followed bar by bar, per-file delimiters, safe appends, and tick windows, against plain versions."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import outcomes
from barloom.sources import bars as src
from barloom.streaming import ticks


def walk(position, bars, activation=0.08, trail=0.02, tighten_after=3, partial_pct=None, partial_carry=0.05):
    """The state machine of one position, in plain Python on mirrored prices."""
    sign = -1 if position["direction"] == "SHORT" else 1
    entry, stop = position["entry_price"] * sign, position["stop"] * sign
    partial = partial_price = None
    session, day, worst_of = 0, None, {}
    for t, o, h, l in bars:
        if t <= position["entry_time"]:
            continue
        best, worst, at_open = (h, l, o) if sign > 0 else (-l, -h, -o)
        entry_day = t.date() == position["entry_time"].date()
        first = t.date() != day
        if first and not entry_day:
            session += 1
            if session >= tighten_after and day is not None:
                stop = max(stop, worst_of[day])
        day = t.date()
        worst_of[day] = min(worst, worst_of.get(day, worst))
        if first and not entry_day and at_open <= stop:
            return partial, partial_price, t, at_open * sign, "GAP_THROUGH_STOP", stop * sign
        target = entry + abs(entry) * (partial_pct or 0)
        if entry_day and partial_pct and partial is None and best >= target:
            price = max(at_open, target)
            partial, partial_price, stop = t, price * sign, price - abs(price) * partial_carry
            continue
        if worst <= stop:
            near = abs(stop - entry) <= abs(entry) * 1e-5 + 1e-8
            return partial, partial_price, t, stop * sign, "STOP_BREAKEVEN" if near else "STOP_TRAIL" if stop > entry else "STOP_INITIAL", stop * sign
        if best >= entry + abs(entry) * activation:
            stop = max(stop, best - abs(best) * trail)
    return partial, partial_price, None, None, None, stop * sign


@pytest.mark.parametrize("partial", [None, 0.06])
def test_positions_are_followed_as_by_the_state_machine(spark, partial):
    rng = random.Random(4)
    positions, rows, expected = [], [], {}
    for s in range(120):
        name, price, bars = f"s{s}", 100.0, []
        for d in range(6):
            price *= 1 + rng.gauss(0, 0.03)
            for k in range(8):
                o = price
                price *= 1 + rng.gauss(0.001 * rng.choice((-1, 1)), 0.015)
                h, l = max(o, price) * (1 + rng.random() * 0.01), min(o, price) * (1 - rng.random() * 0.01)
                bars.append((datetime.datetime(2024, 1, 1 + d, 9, 15) + datetime.timedelta(minutes=5 * k), o, h, l))
        direction = rng.choice(("LONG", "SHORT"))
        p = {"symbol": name, "direction": direction, "entry_time": bars[rng.randrange(4)][0], "entry_price": bars[2][1]}
        p["stop"] = p["entry_price"] * (0.93 if direction == "LONG" else 1.07)
        positions.append(tuple(p.values()))
        rows += [(name, *b) for b in bars]
        expected[name] = walk(p, bars, partial_pct=partial)
    frame = spark.createDataFrame(positions, "symbol string, direction string, entry_time timestamp, entry_price double, stop double")
    found = outcomes.follow_positions(frame, spark.createDataFrame(rows, "symbol string, candle_time timestamp, open double, high double, low double").repartition(4), partial_pct=partial).collect()
    assert len(found) == 120
    reasons = set()
    for r in found:
        e = expected[r.symbol]
        assert (r.partial_time, r.exit_time, r.exit_reason) == (e[0], e[2], e[4]), r
        for got, want in ((r.partial_price, e[1]), (r.exit_price, e[3]), (r.final_stop, e[5])):
            assert (got is None) == (want is None) and (got is None or abs(got - want) < 1e-9), r
        reasons.add(r.exit_reason)
    assert {"STOP_TRAIL", "STOP_INITIAL", "GAP_THROUGH_STOP"} <= reasons


def test_every_file_has_its_own_delimiter_and_header(spark, tmp_path):
    (tmp_path / "AAA.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-02,1,2,0.5,1.5,\"1,000\"\n")
    (tmp_path / "BBB.txt").write_text("ticker;time;o;h;l;c;vol\nbbb;2024-01-03 09:15:00;3;4;2;3.5;7\nbbb;2024-01-03 09:20:00;3;4;2;3.6;8\n")
    (tmp_path / "CCC.csv").write_text("volume|close|low|high|open|trading_date\n9|5|4|6|5|03-01-2024\n")
    (tmp_path / "DDD.csv").write_text("Date,Open,High,Low,Close,Volume\nnot a date,1,1,1,1,1\n2024-01-04,x,2,1,1,3\n")
    found = sorted((r.symbol, str(r.date), r.open, r.close, r.volume) for r in src.read_delimited(spark, str(tmp_path)).collect())
    assert found == [("AAA", "2024-01-02", 1.0, 1.5, 1000), ("BBB", "2024-01-03", 3.0, 3.5, 7), ("BBB", "2024-01-03", 3.0, 3.6, 8), ("CCC", "2024-01-03", 5.0, 5.0, 9), ("DDD", "2024-01-04", None, 1.0, 3)]


def test_append_reads_nothing_that_it_overwrites(spark, tmp_path):
    path = str(tmp_path / "store")
    day = lambda y, m: datetime.date(y, m, 1)
    rows = lambda *x: spark.createDataFrame([(s, d, c, c, c, c, 1) for s, d, c in x], "symbol string, date date, open double, high double, low double, close double, volume long")
    src.append_bars(spark, path, rows(("a", day(2023, 1), 1.0), ("a", day(2024, 1), 2.0), ("b", day(2024, 1), 3.0)), ["symbol", "date"])
    src.append_bars(spark, path, rows(("a", day(2024, 1), 9.0), ("a", day(2024, 2), 4.0)), ["symbol", "date"])
    found = sorted((r.symbol, r.date, r.close) for r in src.read_bars(spark, path).collect())
    assert found == [("a", day(2023, 1), 1.0), ("a", day(2024, 1), 9.0), ("a", day(2024, 2), 4.0), ("b", day(2024, 1), 3.0)]
    assert [p.name for p in tmp_path.iterdir()] == ["store"]


def test_tick_counters_run_over_days(spark):
    rng, rows = random.Random(3), []
    for i in range(300):
        rows.append((i, datetime.datetime(2024, 1, 1 + rng.randrange(4), rng.randrange(24), rng.randrange(60)), rng.choice("ab"), float(i)))
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double")
    t = ticks.ticks_from_events(events)
    expected = []
    for s in "ab":
        own = sorted((ts, i) for i, ts, kind, _ in rows if kind == s)
        expected += [(s, ts, n + 1) for n, (ts, _) in enumerate(own)]
    assert sorted((r.symbol, r.ts, r.volume) for r in t.collect()) == sorted(expected)
    deltas = sorted((r.symbol, r.volume, r.delta) for r in ticks.volume_deltas(t).collect())
    assert deltas == sorted((s, n, int(n > 1)) for s, _, n in expected)
    plan = ticks.volume_deltas(t)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(symbol" in plan and F is not None
