"""Outcomes of signals: entries inside the day, same-day exits, multi-day exits, carry rule, trade economics.

Stops only ever move one way, and what moves them depends on the rows and on
running extremes alone.  So the stop after a row is a running maximum (minimum
for shorts) of candidates, and the exit is the first row, by row and by the
order of checks, on which a check holds: windows and one min_by, no row loop.
Prices of shorts are mirrored, so that one set of rules serves both sides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import Costs, invalidated, minutes_from_open
from .candidates import AHEAD


def bars_of_day():
    return Window.partitionBy("symbol", "date").orderBy("candle_time")


def so_far():
    return bars_of_day().rowsBetween(Window.unboundedPreceding, 0)


def resolve_entries(signals: DataFrame, bars: DataFrame, start_minutes: int = 5, cutoff_minutes: int = 60, open_minute: int = 555, opening_range_minutes: int = 0, atr_cap: float | None = None) -> DataFrame:
    """The first bar of each signal (symbol, date, direction, trigger_price, atr_20) that crosses its trigger.

    Bars count from the session's open to the cut-off; those before
    start_minutes only build the session's low and high.  A long enters at the
    larger of open and trigger with the session's low as its stop (or, where
    that is no stop, two ranges or 4 % below); a short mirrors that, and its
    stop may be capped by a multiple of the range.  With opening_range_minutes
    a long's trigger is the high of that opening range.
    """
    s = signals.select("symbol", "date", "direction", "trigger_price", F.coalesce("atr_20", F.lit(0.0)).alias("atr"))
    b = bars.join(s, ["symbol", "date"]).withColumn("minute", minutes_from_open(F.col("candle_time"), open_minute)).where(F.col("minute").between(0, cutoff_minutes))
    c = F.col
    short = c("direction") == "SHORT"
    b = b.withColumns({"session_low": F.min("low").over(so_far()), "session_high": F.max("high").over(so_far())})
    trigger, ready = c("trigger_price"), c("minute") >= start_minutes
    if opening_range_minutes > 0:
        high = F.max(F.when(ready & (c("minute") < opening_range_minutes), c("high"))).over(so_far())
        trigger = F.when(short, trigger).otherwise(high)
        ready &= short | ((c("minute") >= opening_range_minutes) & high.isNotNull())
    b = b.withColumns({"trigger": trigger, "ready": ready})
    hit = F.when(short, c("low") <= c("trigger")).otherwise(c("high") >= c("trigger"))
    b = b.where(c("ready") & hit)
    entry = F.when(short, F.least("open", "trigger")).otherwise(F.greatest("open", "trigger"))
    b = b.withColumn("entry_price", entry)
    fallback = F.when(c("atr") > 0, c("entry_price") - c("atr") * 2.0).otherwise(c("entry_price") * 0.96)
    long_stop = F.when(c("session_low") < c("entry_price"), c("session_low")).otherwise(fallback)
    short_stop = F.when(c("session_high") > c("entry_price"), c("session_high")).otherwise(c("entry_price") * 1.04)
    if atr_cap:
        short_stop = F.when(c("atr") > 0, F.least(short_stop, c("entry_price") + c("atr") * atr_cap)).otherwise(short_stop)
    b = b.withColumn("initial_stop", F.when(short, short_stop).otherwise(long_stop))
    first = F.min_by(F.struct("candle_time", "minute", "entry_price", "initial_stop"), "candle_time").alias("e")
    return b.groupBy("symbol", "date", "direction").agg(first).select("symbol", "date", "direction", c("e.candle_time").alias("entry_time"), c("e.minute").alias("entry_minute"), "e.entry_price", "e.initial_stop")


def same_day_exits(entries: DataFrame, bars: DataFrame, ladder: bool = False, ladder_start: int = 2, partial_pct: float | None = None, partial_carry: float = 0.05, short_take_profit: float | None = None) -> DataFrame:
    """The first exit after each entry on its day, or none with the stop to carry.

    Checks of a bar in order: partial exit at a target, a short's take-profit,
    open through the stop, then, after the ladder of R multiples has moved the
    stop, the stop itself.
    """
    c = F.col
    e = entries.select("symbol", "date", "direction", "entry_time", "entry_price", "initial_stop")
    b = bars.join(e, ["symbol", "date"]).where(c("candle_time") > c("entry_time"))
    sign = F.when(c("direction") == "SHORT", -1.0).otherwise(1.0)
    # mirrored: best and worst are the bar's ends for and against the position
    b = b.withColumns({"sign": sign, "best": F.when(sign < 0, -c("low")).otherwise(c("high")), "worst": F.when(sign < 0, -c("high")).otherwise(c("low")), "at_open": c("open") * sign, "entry": c("entry_price") * sign, "stop0": c("initial_stop") * sign})
    b = b.withColumn("risk", c("entry") - c("stop0")).where(c("risk") > 0)
    b = b.withColumn("ladder", F.lit(None).cast("double"))
    if ladder:
        steps = F.floor((c("best") - c("entry")) / c("risk"))
        b = b.withColumn("ladder", F.when(steps >= ladder_start, c("entry") + (steps - ladder_start) * c("risk")))
    b = b.withColumn("after", F.greatest("stop0", F.max("ladder").over(so_far())))
    b = b.withColumn("before", F.coalesce(F.lag("after").over(bars_of_day()), c("stop0")))
    checks = []
    if partial_pct:
        target = c("entry") + F.abs("entry") * partial_pct
        price = F.greatest("at_open", target)
        checks.append((c("best") >= target, price, "PARTIAL_EXIT", price - F.abs(price) * partial_carry, 0.80))
    if short_take_profit:
        target = c("entry") + F.abs("entry") * short_take_profit
        checks.append(((c("sign") < 0) & (c("best") >= target), F.greatest("at_open", target), "ABNORMAL_PROFIT", c("before"), None))
    checks.append((c("at_open") <= c("before"), c("at_open"), "GAP_THROUGH_STOP", c("before"), None))
    near = F.abs(c("after") - c("entry")) <= F.abs("entry") * 1e-5 + 1e-8
    reason = F.when(c("after") > c("entry"), "STOP_TRAIL").when(near, "STOP_BREAKEVEN").otherwise("STOP_INITIAL")
    checks.append((c("worst") <= c("after"), c("after"), reason, c("after"), None))
    out = None
    for test, price, why, carry, part in checks:
        made = F.struct(price.alias("price"), (F.lit(why) if isinstance(why, str) else why).alias("reason"), carry.alias("carry"), F.lit(part).cast("double").alias("part"))
        out = F.when(test, made) if out is None else out.when(test, made)
    hits = b.withColumn("x", out).groupBy("symbol", "date", "direction", "entry_time").agg(F.min_by(F.struct("candle_time", "x"), F.when(c("x").isNotNull(), c("candle_time"))).alias("h"), F.max_by("after", "candle_time").alias("last_stop"))
    hits = hits.select("symbol", "date", "direction", "entry_time", c("h.candle_time").alias("exit_time"), c("h.x").alias("x"), "last_stop")
    sign = F.when(c("direction") == "SHORT", -1.0).otherwise(1.0)
    return entries.join(hits, ["symbol", "date", "direction", "entry_time"], "left").select(
        *entries.columns, "exit_time", (c("x.price") * sign).alias("exit_price"), c("x.reason").alias("exit_reason"),
        F.coalesce(c("x.carry") * sign, c("last_stop") * sign, c("initial_stop")).alias("carry_stop"), c("x.part").alias("partial_fraction"),
    )


@dataclass(frozen=True)
class ExitRules:
    trail_activation: float = 0.08
    trail_stop: float = 0.02
    min_hold_days: int = 3
    time_stop_days: int = 5
    abnormal_profit: float = 0.10
    abnormal_gap: float = 0.20


def kept_rows(signals: DataFrame) -> DataFrame:
    """holding_rows of signals with bars_ahead, each followed as far as that reaches; one row without a bar for a signal that nothing follows."""
    rows = signals.select("*", F.posexplode(AHEAD).alias("day", "_bar")).where(F.col("_bar").isNotNull() | (F.col("day") == 0))
    return rows.select(*(c for c in signals.columns if c != AHEAD), (F.col("day") + 1).alias("day"), "_bar.*")


def holding_rows(signals: DataFrame, bars: DataFrame, days: int) -> DataFrame:
    """Each signal with the `days` bars after its own: an equi join on the bar's number, at most `days` rows a signal."""
    order = Window.partitionBy("symbol").orderBy("date")
    numbered = bars.select("symbol", "date", "open", "high", "low", "close", F.row_number().over(order).alias("bar_no"))
    at = signals.join(numbered.select("symbol", "date", "bar_no"), ["symbol", "date"]).withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(days)))).withColumn("bar_no", F.col("bar_no") + F.col("day"))
    return at.join(numbered.withColumnRenamed("date", "bar_date"), ["symbol", "bar_no"]).drop("bar_no")


def multi_day_exits(signals: DataFrame, bars: DataFrame | None, rules: ExitRules = ExitRules(), delistings: DataFrame | None = None, variant: tuple[str, ...] = ()) -> DataFrame:
    """The exit of each signal (symbol, date, direction, entry_price, initial_stop, carry_stop).

    Signals of one symbol, date and direction are told apart by the columns of
    `variant`, so that all levels of a parameter go through one plan.

    Checks of a day in order: delisting, open far in favour, open through the
    stop, the stop, a large profit on the first two days, and the close through
    the stop after it has moved.  A stop moves to break-even after a close in
    favour, trails the best price once that is far enough, and from the day
    min_hold_days on follows the day's worst price.  Without an exit the last
    day's close is taken.  A signal without later bars has no exit.

    Without bars, signals have bars_ahead, of time_stop_days bars (candidates.Params.ahead).
    """
    c = F.col
    # options ride on the bars, so signals may carry columns of any name
    keys = ["symbol", "date", "direction", *variant]
    columns = [x for x in signals.columns if x not in ("exit_date", "exit_price", "exit_reason", "holding_days", AHEAD)]
    s = signals.select(*keys, "entry_price", "initial_stop", "carry_stop", *([] if bars is not None else [AHEAD, F.struct(*columns).alias("_signal")]))
    r = kept_rows(s) if bars is None else holding_rows(s, bars, rules.time_stop_days)
    if delistings is not None:
        r = r.join(delistings.select("symbol", "delisting_date"), "symbol", "left")
    else:
        r = r.withColumn("delisting_date", F.lit(None).cast("date"))
    short = c("direction") == "SHORT"
    sign = F.when(short, -1.0).otherwise(1.0)
    r = r.withColumns({"sign": sign, "best": F.when(short, -c("low")).otherwise(c("high")), "worst": F.when(short, -c("high")).otherwise(c("low")), "o": c("open") * sign, "x": c("close") * sign, "entry": c("entry_price") * sign})
    r = r.withColumn("stop0", F.greatest(c("initial_stop") * sign, c("carry_stop") * sign))
    order = Window.partitionBy(*keys).orderBy("day")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    far = lambda share: c("entry") + F.abs("entry") * share
    r = r.withColumn("top", F.greatest("entry", F.max("best").over(run)))
    trail_on = c("top") >= far(rules.trail_activation)
    trail = F.when(trail_on, F.greatest("entry", c("top") - F.abs("top") * rules.trail_stop))
    even = F.when(c("x") > c("entry"), c("entry"))
    # moved: the stop after break-even and trail of the day; tight: the day's worst price, from min_hold_days on
    r = r.withColumns({"push": F.greatest(even, trail), "even": c("x") > c("entry"), "trail_on": trail_on, "tight": F.when(c("day") >= rules.min_hold_days, c("worst"))})
    r = r.withColumn("after", F.greatest("stop0", F.max(F.greatest("push", "tight")).over(run)))
    r = r.withColumn("before", F.coalesce(F.lag("after").over(order), c("stop0"))).withColumn("moved", F.greatest("before", "push"))
    r = r.withColumns({"tightened": c("tight") > c("moved"), "even_now": F.max("even").over(run), "trail_now": F.max("trail_on").over(run)})
    r = r.withColumn("tight_now", F.max(F.coalesce("tightened", F.lit(False))).over(run))
    before = lambda f: F.coalesce(F.lag(f).over(order), F.lit(False))
    r = r.withColumns({"even_was": before("even_now"), "trail_was": before("trail_now"), "tight_was": before("tight_now")})

    def reason(stop: str, trailing: str, tightened: str, broken_even: str, exact: bool) -> Column:
        held = c("day") >= rules.min_hold_days
        out = F.when(c(trailing) & (c(stop) > c("entry")), "STOP_TRAIL").when(c(tightened) & held, "STOP_POST_DAY3").when(~c(broken_even), "STOP_INITIAL")
        last = c(stop) == c("entry") if exact else ~(c(stop) > c("entry"))
        return out.when(last, "STOP_BREAKEVEN").otherwise("STOP_TRAIL")

    made = lambda price, why: F.struct(price.alias("price"), why.alias("reason"))
    gone = c("bar_date") >= c("delisting_date")
    found = (
        F.when(gone, made(F.coalesce("x", "entry"), F.lit("DELISTING")))
        .when(c("best").isNull() | c("worst").isNull() | c("x").isNull(), F.lit(None))
        .when(c("o") >= far(rules.abnormal_gap), made(c("o"), F.lit("ABNORMAL_GAP_EXIT")))
        .when(c("o") < c("before"), made(c("o"), F.lit("GAP_STOP")))
        .when(c("worst") <= c("before"), made(c("before"), reason("before", "trail_was", "tight_was", "even_was", True)))
        .when((c("day") <= 2) & (c("best") >= far(rules.abnormal_profit)), made(c("x"), F.lit("ABNORMAL_PROFIT")))
        .when(c("x") <= c("after"), made(c("after"), reason("after", "trail_now", "tight_now", "even_now", False)))
    )
    r = r.withColumn("found", found)
    hit = F.min_by(F.struct("day", "bar_date", "found"), F.when(c("found").isNotNull(), c("day")))
    last = F.max_by(F.struct("day", "bar_date", made(c("x"), F.lit("TIME_EXIT")).alias("found")), F.when(c("bar_date").isNotNull(), c("day")))
    out = r.groupBy(*keys).agg(F.coalesce(hit, last).alias("e"), F.first("sign").alias("sign"), *([F.first("_signal").alias("_signal")] if bars is None else []))
    # a signal that has its bars with it comes through the groups whole; joined to them, all that led to it would run twice
    head = keys if bars is not None else [c(f"_signal.{x}").alias(x) for x in columns]
    out = out.select(*head, c("e.day").alias("holding_days"), c("e.bar_date").alias("exit_date"), (c("e.found.price") * c("sign")).alias("exit_price"), c("e.found.reason").alias("exit_reason"))
    return out if bars is None else signals.select(*columns).join(out, keys, "left")


def union_calendar(bars: DataFrame) -> DataFrame:
    """Bars of every symbol on every date of the table, prices carried forward, and back before the first one."""
    days = bars.select("date").distinct()
    spans = bars.select("symbol").distinct()
    grid = spans.join(days)
    back = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("symbol").orderBy("date").rowsBetween(0, Window.unboundedFollowing)
    full = grid.join(bars, ["symbol", "date"], "left")
    return full.withColumns({k: F.coalesce(F.last(k, ignorenulls=True).over(back), F.first(k, ignorenulls=True).over(ahead)) for k in ("open", "high", "low", "close")})


def carry_rule(positions: DataFrame) -> DataFrame:
    """What becomes of open positions (direction, entry_price, close_price, carry_stop, hold_quality, exit_reason) at the day's end.

    A day that already exited is left alone.  With hold quality, or with a
    profit, the stop goes to break-even at least; without both the close is
    the exit.
    """
    c = F.col
    short = c("direction") == "SHORT"
    done = c("exit_reason").isNotNull() | c("entry_price").isNull() | c("close_price").isNull()
    failed = F.when(short, c("close_price") >= c("entry_price")).otherwise(c("close_price") <= c("entry_price"))
    base = F.coalesce("carry_stop", "entry_price")
    tightened = F.when(short, F.least(base, c("entry_price"))).otherwise(F.greatest(base, c("entry_price")))
    action = F.when(done | c("hold_quality"), "normal").when(failed, "weak_close_exit").otherwise("breakeven_carry")
    p = positions.withColumn("carry_action", action)
    weak = c("carry_action") == "weak_close_exit"
    return p.withColumns(
        {
            "next_carry_stop": F.when(done | weak, c("carry_stop")).otherwise(tightened),
            "exit_price": F.when(weak, c("close_price")).otherwise(c("exit_price")),
            "exit_reason": F.when(weak, "WEAK_CLOSE_EXIT").otherwise(c("exit_reason")),
        }
    )


def end_of_day(positions: DataFrame, features: DataFrame, time_stop_days: int = 5, h_threshold: float = 0.70) -> DataFrame:
    """Carry rule over open positions joined to the day's features; the time exit comes first."""
    c = F.col
    f = features.select("symbol", "date", c("close").alias("close_price"), "close_pos_in_range")
    p = positions.join(f, ["symbol", "date"], "left")
    quality = F.when(c("direction") == "SHORT", c("close_pos_in_range") <= round(1 - h_threshold, 6)).otherwise(c("close_pos_in_range") >= h_threshold)
    p = p.withColumns({"hold_quality": F.coalesce(quality, F.lit(False)), "_timed": (c("days_held") >= time_stop_days) & c("exit_reason").isNull()})
    p = p.withColumns({"exit_reason": F.when(c("_timed"), "TIME_EXIT").otherwise(c("exit_reason")), "exit_price": F.when(c("_timed"), c("close_price")).otherwise(c("exit_price"))})
    return carry_rule(p.drop("_timed"))


def gate(entries: DataFrame, max_stop_distance: float = 0.08) -> DataFrame:
    """Every candidate with a status: no entry, no price, stop too far, duplicate of an earlier one, or executed."""
    c = F.col
    far = F.abs(c("entry_price") - c("initial_stop")) > c("entry_price") * max_stop_distance
    twice = F.row_number().over(Window.partitionBy("symbol", "date").orderBy(F.asc_nulls_last("entry_time"), "direction")) > 1
    status = F.when(c("entry_time").isNull(), "no_entry").when(c("entry_price").isNull() | (c("entry_price") <= 0), "no_price").when(far, "stop_too_far").when(twice, "duplicate").otherwise("executed")
    return entries.withColumn("status", status)


def economics(trades: DataFrame, notional: float = 100_000.0, costs: Costs = Costs()) -> DataFrame:
    """Quantity, gross and net result, cost, percent and R of trades of a fixed notional; impossible prices count as no result."""
    c = F.col
    short = c("direction") == "SHORT"
    sign = F.when(short, -1.0).otherwise(1.0)
    t = trades.withColumns({"qty": F.floor(F.lit(notional) / c("entry_price")), "_bad": invalidated(c("entry_price"), c("exit_price"))})
    gross = (c("exit_price") - c("entry_price")) * sign * c("qty")
    t = t.withColumns({"gross_pnl": F.when(c("_bad"), 0.0).otherwise(gross), "cost": F.when(c("_bad"), 0.0).otherwise(costs.round_trip(c("entry_price"), c("exit_price"), c("qty"), c("direction")))})
    t = t.withColumns(
        {
            "net_pnl": c("gross_pnl") - c("cost"),
            "pnl_pct": F.when(c("_bad"), 0.0).otherwise((c("exit_price") - c("entry_price")) * sign / c("entry_price") * 100),
            "pnl_r": F.when(c("_bad"), 0.0).otherwise((c("exit_price") - c("entry_price")) * sign / F.nullif(F.abs(c("entry_price") - c("initial_stop")), F.lit(0))),
            "exit_reason": F.when(c("_bad"), "DATA_INVALIDATION").otherwise(c("exit_reason")),
            "year": F.year("date"),
        }
    )
    return t.drop("_bad")


def follow_positions(positions: DataFrame, bars: DataFrame, activation: float = 0.08, trail: float = 0.02, tighten_after: int = 3, partial_pct: float | None = None, partial_carry: float = 0.05) -> DataFrame:
    """Positions (symbol, direction, entry_time, entry_price, stop), at most one a symbol, followed over the bars after their entry.

    Checks of a bar in order: on the first bar of a session from the
    tighten_after-th on the stop moves to the worst price of the session
    before; on a carried session's first bar an open through the stop exits
    there; on the entry day a far enough move takes a part off, once, and
    sets the stop below its price; a price through the stop exits at it;
    otherwise the stop trails the bar's best price once that is far enough.

    Per position: partial_time and partial_price, exit_time, exit_price and
    exit_reason, and the stop at the end.  All are running maxima over
    mirrored prices, one run before the partial exit and one after it.
    """
    c = F.col
    p = positions.select("symbol", "direction", "entry_time", "entry_price", F.col("stop").alias("initial_stop"))
    b = bars.join(p, "symbol").where(c("candle_time") > c("entry_time"))
    short = c("direction") == "SHORT"
    sign = F.when(short, -1.0).otherwise(1.0)
    b = b.withColumns({"best": F.when(short, -c("low")).otherwise(c("high")), "worst": F.when(short, -c("high")).otherwise(c("low")), "at_open": c("open") * sign, "entry": c("entry_price") * sign, "stop0": c("initial_stop") * sign, "day": F.to_date("candle_time")})
    order = Window.partitionBy("symbol").orderBy("candle_time")
    whole = Window.partitionBy("symbol")
    b = b.withColumns({"first_bar": ~F.lag("day").over(order).eqNullSafe(c("day")), "entry_day": c("day") == F.to_date("entry_time")})
    b = b.withColumn("session", F.sum((c("first_bar") & ~c("entry_day")).cast("int")).over(order))
    of_day = Window.partitionBy("symbol", "day")
    b = b.withColumn("day_worst", F.min("worst").over(of_day)).withColumn("prior_worst", F.when(c("first_bar"), F.lag("day_worst").over(order)))
    far = lambda share: c("entry") + F.abs("entry") * share
    reached = (c("entry_day") & (c("best") >= far(partial_pct))) if partial_pct else F.lit(False)
    taken_price = F.greatest("at_open", far(partial_pct or 0.0))
    b = b.withColumns({"taken": F.min(F.when(reached, c("candle_time"))).over(whole), "taken_price": taken_price})
    b = b.withColumn("taken_at", F.max(F.when(c("candle_time") == c("taken"), c("taken_price"))).over(whole))
    # 0 before the partial exit, 1 on its bar, 2 after it
    b = b.withColumn("phase", F.when(c("taken").isNull() | (c("candle_time") < c("taken")), 0).when(c("candle_time") == c("taken"), 1).otherwise(2))
    base = F.when(c("phase") == 2, c("taken_at") - F.abs("taken_at") * partial_carry).otherwise(c("stop0"))
    run = Window.partitionBy("symbol", "phase").orderBy("candle_time")
    trailed = F.when((c("best") >= far(activation)) & (c("phase") != 1), c("best") - F.abs("best") * trail)
    tightened = F.when(c("session") >= tighten_after, c("prior_worst"))
    so_far_, earlier = run.rowsBetween(Window.unboundedPreceding, 0), run.rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumns({"base": base, "trailed": trailed, "tightened": tightened})
    b = b.withColumn("stop", F.greatest("base", F.max("trailed").over(earlier), F.max("tightened").over(so_far_)))
    b = b.withColumn("stop_after", F.greatest("stop", "trailed", F.when(c("phase") == 1, c("taken_at") - F.abs("taken_at") * partial_carry)))
    gap = c("first_bar") & ~c("entry_day") & (c("at_open") <= c("stop"))
    near = F.abs(c("stop") - c("entry")) <= F.abs("entry") * 1e-5 + 1e-8
    why = F.when(gap, "GAP_THROUGH_STOP").when(near, "STOP_BREAKEVEN").when(c("stop") > c("entry"), "STOP_TRAIL").otherwise("STOP_INITIAL")
    out_now = F.when((c("phase") != 1) & (gap | (c("worst") <= c("stop"))), c("candle_time"))
    row = F.struct(c("candle_time").alias("exit_time"), (F.when(gap, c("at_open")).otherwise(c("stop")) * sign).alias("exit_price"), why.alias("exit_reason"), (c("stop") * sign).alias("stop"))
    found = b.groupBy("symbol").agg(F.min_by(row, out_now).alias("x"), F.first("taken").alias("taken"), (F.first("taken_at") * F.first(sign)).alias("taken_at"), F.max_by(F.when(c("phase") == 1, c("taken_at") - F.abs("taken_at") * partial_carry).otherwise(c("stop_after")) * sign, "candle_time").alias("last_stop"))
    took = c("taken").isNotNull() & (c("x").isNull() | (c("taken") < c("x.exit_time")))
    return positions.join(found, "symbol", "left").select(
        *positions.columns, F.when(took, c("taken")).alias("partial_time"), F.when(took, c("taken_at")).alias("partial_price"), c("x.exit_time").alias("exit_time"), c("x.exit_price").alias("exit_price"), c("x.exit_reason").alias("exit_reason"),
        F.coalesce(c("x.stop"), c("last_stop"), c("stop")).alias("final_stop"),
    )
