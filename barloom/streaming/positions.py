"""Open positions followed bar by bar in a stream, longs and shorts, with a batch twin.

Openings and bars arrive in one stream.  A symbol's rows wait in state until the
watermark passes them and are then taken in event order, so the result is that
of the batch twin (operators.outcomes.follow_positions) whatever the order of
arrival within the delay.  State is a position's: it begins with an opening and
ends with the exit, or when no bar has come for too long.

transformWithState wants RocksDB as the session's state store
(spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.outcomes import follow_positions

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WAITING = "ms long, day int, opens boolean, direction string, entry_price double, stop double, open double, high double, low double"
OUT = "symbol string, event string, ms long, price double, reason string, stop double"


@dataclass(frozen=True)
class Rules:
    activation: float = 0.08
    trail: float = 0.02
    tighten_after: int = 3
    partial_pct: float | None = None
    partial_carry: float = 0.05
    idle_days: float = 30.0


class Follower(StatefulProcessor):
    """One symbol: rows that wait, the position, its stop, and the session."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.position = handle.getValueState("position", "sign int, ms long, day int, price double")
        self.stop = handle.getValueState("stop", "stop double, partial boolean")
        self.session = handle.getValueState("session", "day int, number int, worst double")
        self.timers = handle.getValueState("timers", "due long, idle long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in WAITING.split(", ")]
        due, idle = self._timers()
        for frame in rows:
            new = list(frame[names].astype(object).where(frame[names].notna(), None).itertuples(index=False, name=None))
            self.waiting.appendList(new)
            due = min([due or new[0][0], *(r[0] for r in new)])
        self._set_timers(due, idle)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark, fired = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        due, idle = self._timers()
        out = []
        if fired == due:
            waiting = sorted(self.waiting.get(), key=lambda r: (r[0], not r[2]))
            ready = [r for r in waiting if r[0] <= watermark]
            later = waiting[len(ready) :]
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
            due = later[0][0] if later else None
            for row in ready:
                out += self._taken(row)
                idle = row[0] + int(self.rules.idle_days * 86_400_000)
            if not self.position.exists():
                idle = None
        elif fired == idle and self.position.exists():
            sign, *_ = self.position.get()
            out.append(("UNFOLLOWED", fired, None, None, self.stop.get()[0] * sign))
            self._close()
            idle = None
        self._set_timers(due, idle)
        if out:
            yield pd.DataFrame([(key[0], *row) for row in out], columns=[x.split()[0] for x in OUT.split(", ")])

    def close(self) -> None:
        pass

    def _timers(self) -> tuple[int | None, int | None]:
        return tuple(self.timers.get()) if self.timers.exists() else (None, None)

    def _set_timers(self, due: int | None, idle: int | None) -> None:
        old, new = {t for t in self._timers() if t is not None}, {t for t in (due, idle) if t is not None}
        for t in old - new:
            self.handle.deleteTimer(t)
        for t in new - old:
            self.handle.registerTimer(t)
        if new:
            self.timers.update((due, idle))
        else:
            self.timers.clear()

    def _close(self) -> None:
        for state in (self.position, self.stop, self.session):
            state.clear()

    def _taken(self, row: tuple) -> list[tuple]:
        """The row's events, as (event, ms, price, reason, stop); prices of shorts are mirrored inside."""
        ms, day, opens, direction, entry_price, stop, *prices = row
        if opens:
            if not self.position.exists():
                sign = -1 if direction == "SHORT" else 1
                self.position.update((sign, ms, day, entry_price))
                self.stop.update((stop * sign, False))
            return []
        if not self.position.exists():
            return []
        sign, entered, entry_day, price = self.position.get()
        if ms <= entered:
            return []
        rules, entry = self.rules, price * sign
        stop, taken = self.stop.get()
        before, number, worst_before = self.session.get() if self.session.exists() else (None, 0, None)
        at_open, high, low = prices
        best, worst, at_open = (high, low, at_open) if sign > 0 else (-low, -high, -at_open)
        first, first_day = day != before, day == entry_day
        if first and not first_day:
            number += 1
            if number >= rules.tighten_after and before is not None:
                stop = max(stop, worst_before)
        self.session.update((day, number, worst if first else min(worst, worst_before)))
        if first and not first_day and at_open <= stop:
            self._close()
            return [("EXIT", ms, at_open * sign, "GAP_THROUGH_STOP", stop * sign)]
        target = entry + abs(entry) * (rules.partial_pct or 0)
        if first_day and rules.partial_pct and not taken and best >= target:
            paid = max(at_open, target)
            stop = paid - abs(paid) * rules.partial_carry
            self.stop.update((stop, True))
            return [("PARTIAL_EXIT", ms, paid * sign, "PARTIAL_EXIT", stop * sign)]
        if worst <= stop:
            near = abs(stop - entry) <= abs(entry) * 1e-5 + 1e-8
            self._close()
            return [("EXIT", ms, stop * sign, "STOP_BREAKEVEN" if near else "STOP_TRAIL" if stop > entry else "STOP_INITIAL", stop * sign)]
        if best >= entry + abs(entry) * rules.activation:
            stop = max(stop, best - abs(best) * rules.trail)
        self.stop.update((stop, taken))
        return []


def follow_stream(bars: DataFrame, openings: DataFrame, rules: Rules = Rules(), delay: str = "10 minutes") -> DataFrame:
    """Events of positions: symbol, event, event_time, price, reason and the stop then.

    bars (symbol, candle_time, open, high, low) and openings (symbol, direction,
    entry_time, entry_price, stop) are streams.  A bar counts for a position if it
    is after the entry; an opening while one is open is ignored.  EXIT ends a
    position, PARTIAL_EXIT takes a part off on the entry day; UNFOLLOWED gives up
    one that had no bar for idle_days.  Rows later than the delay are dropped.
    Rows without a symbol, a time or a price are no events.
    """
    none = lambda t: F.lit(None).cast(t)
    at = lambda c: (F.col(c).alias("at"), F.unix_millis(F.col(c).cast("timestamp")).alias("ms"), F.datediff(F.to_date(c), F.lit("1970-01-01")).alias("day"))
    b = bars.select("symbol", *at("candle_time"), F.lit(False).alias("opens"), none("string").alias("direction"), none("double").alias("entry_price"), none("double").alias("stop"), *(F.col(c).cast("double") for c in ("open", "high", "low")))
    o = openings.select("symbol", *at("entry_time"), F.lit(True).alias("opens"), "direction", *(F.col(c).cast("double") for c in ("entry_price", "stop")), *(none("double").alias(c) for c in ("open", "high", "low")))
    known = F.when(F.col("opens"), F.col("entry_price").isNotNull() & F.col("stop").isNotNull()).otherwise(F.col("open").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull())
    events = b.unionByName(o).where(F.col("symbol").isNotNull() & F.col("at").isNotNull() & known).withWatermark("at", delay)
    out = events.groupBy("symbol").transformWithStateInPandas(Follower(rules), OUT, "append", "eventTime")
    return out.select("symbol", "event", F.timestamp_millis("ms").alias("event_time"), "price", "reason", "stop")


def follow_batch(bars: DataFrame, openings: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The same rows, but for UNFOLLOWED, of stored bars and at most one opening a symbol."""
    f = follow_positions(openings, bars, rules.activation, rules.trail, rules.tighten_after, rules.partial_pct, rules.partial_carry)
    part = F.when(F.col("partial_time").isNotNull(), F.struct(F.lit("PARTIAL_EXIT").alias("event"), F.col("partial_time").alias("event_time"), F.col("partial_price").alias("price"), F.lit("PARTIAL_EXIT").alias("reason")))
    out = F.when(F.col("exit_time").isNotNull(), F.struct(F.lit("EXIT").alias("event"), F.col("exit_time").alias("event_time"), F.col("exit_price").alias("price"), F.col("exit_reason").alias("reason")))
    return f.select("symbol", F.explode(F.array_compact(F.array(part, out))).alias("x")).select("symbol", "x.*")
