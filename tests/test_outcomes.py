"""Exits, entries and economics against plain state machines that walk the rows."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.functions.expressions import Costs
from barloom.operators import outcomes
from barloom.operators.outcomes import ExitRules

D0 = date(2024, 1, 1)


def walk_days(sign, entry, stop, days, rules):
    """The rules of multi-day exits, row by row; sign mirrors a short."""
    even = trail = tight = False
    best = entry

    def reason(exact):
        if trail and stop > entry:
            return "STOP_TRAIL"
        if tight and n >= rules.min_hold_days:
            return "STOP_POST_DAY3"
        if not even:
            return "STOP_INITIAL"
        return "STOP_BREAKEVEN" if (stop == entry if exact else stop <= entry) else "STOP_TRAIL"

    for n, (o, high, low, close) in enumerate(days, 1):
        o, close = o * sign, close * sign
        high, low = (high, low) if sign > 0 else (-low, -high)
        if o >= entry + abs(entry) * rules.abnormal_gap:
            return n, o, "ABNORMAL_GAP_EXIT"
        if o < stop:
            return n, o, "GAP_STOP"
        best = max(best, high)
        if low <= stop:
            return n, stop, reason(True)
        if not even and close > entry:
            stop, even = max(stop, entry), True
        if best >= entry + abs(entry) * rules.trail_activation:
            stop, trail = max(stop, entry, best - abs(best) * rules.trail_stop), True
        if n <= 2 and high >= entry + abs(entry) * rules.abnormal_profit:
            return n, close, "ABNORMAL_PROFIT"
        if n >= rules.min_hold_days:
            tight = tight or low > stop
            stop = max(stop, low)
        if close <= stop:
            return n, stop, reason(False)
    return len(days), days[-1][3] * sign, "TIME_EXIT"


def random_days(rng, start, n):
    out, price = [], start
    for _ in range(n):
        o = round(price * rng.uniform(0.94, 1.07), 2) if rng.random() < 0.9 else round(price * rng.uniform(0.75, 1.3), 2)
        close = round(o * rng.uniform(0.95, 1.06), 2)
        out.append((o, round(max(o, close) * rng.uniform(1, 1.04), 2), round(min(o, close) * rng.uniform(0.96, 1), 2), close))
        price = close
    return out


def test_multi_day_exits_both_sides(spark):
    rng, bars, signals, expected = random.Random(1), [], [], {}
    for i in range(1500):
        side = "SHORT" if i % 2 else "LONG"
        sign = -1 if i % 2 else 1
        n = rng.choice([1, 2, 5, 5, 5, 8])
        days = random_days(rng, 100.0, n)
        stop = round(100 - sign * rng.uniform(1, 9), 2)
        carry = rng.choice([None, 100.0, round(100 - sign * 0.5, 2)])
        bars += [(f"s{i}", D0, 100.0, 100.0, 100.0, 100.0)] + [(f"s{i}", D0 + timedelta(k + 1), *d) for k, d in enumerate(days)]
        signals.append((f"s{i}", D0, side, 100.0, stop, carry))
        first = max(stop * sign, carry * sign if carry is not None else -1e9)
        k, price, why = walk_days(sign, 100.0 * sign, first, days[:5], ExitRules())
        expected[f"s{i}"] = (k, round(price * sign, 9), why)
    s = spark.createDataFrame(signals, "symbol string, date date, direction string, entry_price double, initial_stop double, carry_stop double")
    b = spark.createDataFrame(bars, "symbol string, date date, open double, high double, low double, close double")
    found = {r.symbol: (r.holding_days, round(r.exit_price, 9), r.exit_reason) for r in outcomes.multi_day_exits(s, b).collect()}
    assert found == expected
    assert {w for _, _, w in found.values()} == {"ABNORMAL_GAP_EXIT", "GAP_STOP", "STOP_TRAIL", "STOP_POST_DAY3", "STOP_INITIAL", "STOP_BREAKEVEN", "ABNORMAL_PROFIT", "TIME_EXIT"}


def test_delisting_and_no_later_bar(spark):
    b = spark.createDataFrame([("a", D0 + timedelta(i), 10.0, 10.1, 9.9, 10.0) for i in range(4)] + [("b", D0, 10.0, 10.1, 9.9, 10.0)], "symbol string, date date, open double, high double, low double, close double")
    s = spark.createDataFrame([("a", D0, "LONG", 10.0, 5.0, None), ("b", D0, "LONG", 10.0, 5.0, None)], "symbol string, date date, direction string, entry_price double, initial_stop double, carry_stop double")
    gone = spark.createDataFrame([("a", D0 + timedelta(2))], "symbol string, delisting_date date")
    found = {r.symbol: r for r in outcomes.multi_day_exits(s, b, delistings=gone).collect()}
    assert (found["a"].exit_reason, found["a"].holding_days) == ("DELISTING", 2) and found["b"].exit_reason is None


def walk_bars(sign, entry, stop, rows, ladder, start, partial, profit):
    risk = entry - stop
    for t, o, high, low in rows:
        o = o * sign
        high, low = (high, low) if sign > 0 else (-low, -high)
        if partial and high >= entry + abs(entry) * partial:
            p = max(o, entry + abs(entry) * partial)
            return t, p, "PARTIAL_EXIT"
        if profit and sign < 0 and high >= entry + abs(entry) * profit:
            return t, max(o, entry + abs(entry) * profit), "ABNORMAL_PROFIT"
        if o <= stop:
            return t, o, "GAP_THROUGH_STOP"
        if ladder:
            steps = int((high - entry) // risk)
            if steps >= start:
                stop = max(stop, entry + (steps - start) * risk)
        if low <= stop:
            return t, stop, "STOP_TRAIL" if stop > entry else "STOP_BREAKEVEN" if abs(stop - entry) <= 1e-8 + 1e-5 * abs(entry) else "STOP_INITIAL"
    return None


@pytest.mark.parametrize("options", [{}, {"ladder": True}, {"partial": 0.03}, {"profit": 0.02, "ladder": True}])
def test_same_day_exits(spark, options):
    rng, bars, entries, expected = random.Random(3), [], [], {}
    t0 = datetime(2024, 1, 1, 9, 15)
    for i in range(400):
        sign, price, rows = (-1 if i % 2 else 1), 100.0, []
        for k in range(12):
            o = round(price * rng.uniform(0.99, 1.01), 2)
            close = round(o * rng.uniform(0.985, 1.018), 2)
            rows.append((t0 + timedelta(minutes=5 * k), o, round(max(o, close) * rng.uniform(1, 1.005), 2), round(min(o, close) * rng.uniform(0.995, 1), 2), close))
            price = close
        stop = 100.0 - sign * rng.choice([0.5, 1.0, 2.0])
        entries.append((f"s{i}", D0, "SHORT" if i % 2 else "LONG", t0, 100.0, stop))
        bars += [(f"s{i}", D0, *r) for r in rows]
        got = walk_bars(sign, 100.0 * sign, stop * sign, [r[:4] for r in rows[1:]], options.get("ladder"), 2, options.get("partial"), options.get("profit"))
        expected[f"s{i}"] = (got[0], round(got[1] * sign, 9), got[2]) if got else None
    e = spark.createDataFrame(entries, "symbol string, date date, direction string, entry_time timestamp, entry_price double, initial_stop double")
    b = spark.createDataFrame(bars, "symbol string, date date, candle_time timestamp, open double, high double, low double, close double")
    out = outcomes.same_day_exits(e, b, ladder=options.get("ladder", False), partial_pct=options.get("partial"), short_take_profit=options.get("profit")).collect()
    found = {r.symbol: (r.exit_time, round(r.exit_price, 9), r.exit_reason) if r.exit_reason else None for r in out}
    assert found == expected and len({x[2] for x in expected.values() if x}) >= 2


def test_entries(spark):
    t = lambda m: datetime(2024, 1, 1, 9, 15) + timedelta(minutes=m)
    bars = spark.createDataFrame(
        [("a", D0, t(0), 100.0, 106.0, 99.0, 101.0), ("a", D0, t(5), 101.0, 103.0, 100.5, 102.0), ("a", D0, t(10), 106.0, 107.0, 105.0, 106.0), ("b", D0, t(5), 97.0, 98.0, 94.0, 95.0), ("c", D0, t(70), 110.0, 111.0, 109.0, 110.0)],
        "symbol string, date date, candle_time timestamp, open double, high double, low double, close double",
    )
    s = spark.createDataFrame([("a", D0, "LONG", 104.0, 2.0), ("b", D0, "SHORT", 96.0, 1.0), ("c", D0, "LONG", 104.0, 1.0)], "symbol string, date date, direction string, trigger_price double, atr_20 double")
    found = {r.symbol: (r.entry_time, r.entry_price, r.initial_stop) for r in outcomes.resolve_entries(s, bars).collect()}
    assert found == {"a": (t(10), 106.0, 99.0), "b": (t(5), 96.0, 98.0)}
    assert {r.symbol: r.initial_stop for r in outcomes.resolve_entries(s, bars, atr_cap=0.5).collect()}["b"] == 96.5
    opening = {r.symbol: r.entry_price for r in outcomes.resolve_entries(s, bars, start_minutes=0, opening_range_minutes=10).collect()}
    assert opening["a"] == 106.0


def test_carry_rule(spark):
    rows = [("LONG", 100.0, 101.0, 95.0, False, None), ("LONG", 100.0, 99.0, 95.0, False, None), ("LONG", 100.0, 99.0, 95.0, True, None), ("SHORT", 100.0, 101.0, 104.0, False, None), ("SHORT", 100.0, 98.0, 104.0, False, None), ("LONG", 100.0, 99.0, 95.0, False, "STOP_INITIAL")]
    p = spark.createDataFrame(rows, "direction string, entry_price double, close_price double, carry_stop double, hold_quality boolean, exit_reason string").withColumn("exit_price", F.lit(None).cast("double"))
    found = [(r.carry_action, r.next_carry_stop, r.exit_reason) for r in outcomes.carry_rule(p).collect()]
    assert found == [("breakeven_carry", 100.0, None), ("weak_close_exit", 95.0, "WEAK_CLOSE_EXIT"), ("normal", 100.0, None), ("weak_close_exit", 104.0, "WEAK_CLOSE_EXIT"), ("breakeven_carry", 100.0, None), ("normal", 95.0, "STOP_INITIAL")]


def test_gate_and_economics(spark):
    t = datetime(2024, 1, 1, 10)
    e = spark.createDataFrame([("a", D0, "LONG", t, 100.0, 95.0), ("b", D0, "LONG", t, 100.0, 80.0), ("c", D0, "LONG", None, None, None), ("a", D0, "LONG", t + timedelta(minutes=5), 101.0, 95.0)], "symbol string, date date, direction string, entry_time timestamp, entry_price double, initial_stop double")
    assert sorted((r.symbol, r.status) for r in outcomes.gate(e).collect()) == [("a", "duplicate"), ("a", "executed"), ("b", "stop_too_far"), ("c", "no_entry")]
    trades = spark.createDataFrame([("a", D0, "LONG", 100.0, 95.0, 110.0, "TIME_EXIT"), ("b", D0, "SHORT", 100.0, 105.0, 110.0, "STOP"), ("c", D0, "LONG", 100.0, 95.0, 300.0, "X")], "symbol string, date date, direction string, entry_price double, initial_stop double, exit_price double, exit_reason string")
    found = {r.symbol: r for r in outcomes.economics(trades).collect()}
    assert (found["a"].qty, found["a"].gross_pnl, found["a"].pnl_r) == (1000, 10_000.0, 2.0)
    assert (found["b"].gross_pnl, found["b"].pnl_r) == (-10_000.0, -2.0)
    assert (found["c"].net_pnl, found["c"].exit_reason) == (0.0, "DATA_INVALIDATION")
    value = lambda p, sell: round(20 + p * (0.0000345 + 0.000001) + (20 + p * 0.0000345) * 0.18 + p * (0.00025 if sell else 0.00003), 2)
    assert found["a"].cost == pytest.approx(value(100_000, False) + value(110_000, True), abs=0.011)
    assert Costs().order(F.lit(0.0), F.lit(1), F.lit(True)) is not None


def test_union_calendar(spark):
    b = spark.createDataFrame([("a", D0, 1.0, 1.0, 1.0, 1.0), ("b", D0 + timedelta(1), 2.0, 2.0, 2.0, 2.0)], "symbol string, date date, open double, high double, low double, close double")
    assert sorted((r.symbol, r.date, r.close) for r in outcomes.union_calendar(b).collect()) == [("a", D0, 1.0), ("a", D0 + timedelta(1), 1.0), ("b", D0, 2.0), ("b", D0 + timedelta(1), 2.0)]
