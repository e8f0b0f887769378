"""Tick streams: bars, volumes from counters, alerts, stops, sinks.

Every streaming operator has a batch twin over the same columns (symbol, ts,
last_price, volume as a running counter), and the tests hold one against the
other.  A bar closes when the watermark passes its end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.bars import last_wins


def ticks_from_events(events: DataFrame) -> DataFrame:
    """Ticks of the events table; the counter is the running number of events of a symbol.

    Events are numbered within a symbol's day, and the days before are added
    as one number: a symbol's whole history is never sorted in one task.
    """
    e = events.select(F.col("event_type").alias("symbol"), "ts", "event_id", F.col("value").alias("last_price"), F.to_date("ts").alias("_day"))
    before = e.groupBy("symbol", "_day").agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("symbol").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1))
    before = before.select("symbol", "_day", F.coalesce(earlier, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("symbol", "_day").orderBy("ts", "event_id"))
    return e.withColumn("_place", place).join(before, ["symbol", "_day"]).select("symbol", "ts", "last_price", (F.col("_before") + F.col("_place")).alias("volume"))


def bars(ticks: DataFrame, minutes: int = 5, delay: str | None = "10 minutes") -> DataFrame:
    """Bars of ticks by tumbling windows, in a stream or a batch; ticks later than the delay are dropped in a stream.

    Volume is the counter's rise inside the bar; volume_deltas gives the rise
    across bars as well.
    """
    t = ticks.withWatermark("ts", delay) if delay and ticks.isStreaming else ticks
    w = F.window("ts", f"{minutes} minutes")
    b = t.groupBy(w, "symbol").agg(
        F.min_by("last_price", "ts").alias("open"), F.max("last_price").alias("high"), F.min("last_price").alias("low"), F.max_by("last_price", "ts").alias("close"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min("volume").alias("first_volume"), F.max("volume").alias("last_volume"), F.count("*").alias("n_ticks"),
    )
    return b.select("symbol", F.col("window.start").alias("bar_start"), F.col("window.end").alias("bar_end"), "open", "high", "low", "close", F.greatest(F.col("last_volume") - F.col("first_volume"), F.lit(0)).alias("volume"), "first_ts", "last_ts", "n_ticks")


def volume_deltas(ticks: DataFrame) -> DataFrame:
    """Batch: what each tick adds to its symbol's counter; never less than 0, and 0 for the first tick.

    Ticks are compared within a symbol's day, and the first of a day with the
    last counter of the day before.
    """
    t = ticks.withColumn("_day", F.to_date("ts"))
    last = t.groupBy("symbol", "_day").agg(F.max_by("volume", F.struct("ts", "volume")).alias("_last"))
    last = last.select("symbol", "_day", F.lag("_last").over(Window.partitionBy("symbol").orderBy("_day")).alias("_yesterday"))
    before = F.lag("volume").over(Window.partitionBy("symbol", "_day").orderBy("ts", "volume"))
    rise = F.col("volume") - F.coalesce(F.col("_before"), F.col("_yesterday"))
    out = t.withColumn("_before", before).join(last, ["symbol", "_day"])
    return out.select(*ticks.columns, F.greatest(F.coalesce(rise, F.lit(0)), F.lit(0)).alias("delta"))


def stream_volume_deltas(ticks: DataFrame) -> DataFrame:
    """Stream: the same with the last counter of each symbol as keyed state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts", "volume"])
        before = rows["volume"].shift(1)
        if len(rows):
            before.iloc[0] = last if last is not None else rows["volume"].iloc[0]
        rows["delta"] = (rows["volume"] - before).clip(lower=0).astype("int64")
        state.update((int(rows["volume"].iloc[-1]),))
        yield rows[["symbol", "ts", "last_price", "volume", "delta"]]

    return ticks.groupBy("symbol").applyInPandasWithState(step, "symbol string, ts timestamp, last_price double, volume long, delta long", "last long", "append", GroupStateTimeout.NoTimeout)


def replay(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Stored rows as a stream, file by file."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write_replay(rows: DataFrame, path: str, time: str) -> None:
    """Recorded rows as files whose order of writing is that of their days: what replay_ordered() reads as a stream.

    The rows are parted by day in one job and the days written one after the
    other, as a file stream goes by the times of files, not by their names.  A
    lost job may be repeated: days that are there already stay.  Rows without a time are left out.
    """
    spark = rows.sparkSession
    parted = f"{path.rstrip('/')}-days"
    known = rows.where(F.col(time).isNotNull()).withColumn("_day", F.to_date(time))
    known.repartition("_day").write.mode("overwrite").partitionBy("_day").parquet(parted)
    days = [r[0] for r in spark.read.parquet(parted).select("_day").distinct().orderBy("_day").collect()]
    for day in days:
        spark.read.schema(rows.schema).parquet(f"{parted}/_day={day}").sortWithinPartitions(time).write.mode("ignore").parquet(f"{path.rstrip('/')}/day={day}")


def replay_ordered(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """The rows of write_replay() as a stream, day after day; a run with the same checkpoint goes on behind the last day it had."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path.rstrip('/')}/day=*")


def entry_alerts(bars_: DataFrame, watch: DataFrame, start_minute: int = 0, cutoff_minute: int = 24 * 60, delay: str | None = "10 minutes") -> DataFrame:
    """Stream: the first bar of each watched symbol and day that reaches its trigger, with the session's low as the stop.

    watch (symbol, trigger_price) is a static table; the session's extreme and
    the alert already given are keyed state by symbol and day.  The state of a
    day ends when the watermark, `delay` behind the bars (None: bars_ has one),
    passes the day: no bar of it can come any more.
    """
    minute = F.hour("bar_start") * 60 + F.minute("bar_start")
    b = bars_.withWatermark("bar_start", delay) if delay and bars_.isStreaming else bars_
    b = b.join(watch.select("symbol", "trigger_price"), "symbol").withColumns({"day": F.to_date("bar_start"), "minute": minute})
    b = b.withColumn("ends", F.unix_millis(F.date_add("day", 1).cast("timestamp")))
    b = b.where(F.col("minute") <= cutoff_minute).select("symbol", "day", "bar_start", "minute", "open", "high", "low", "trigger_price", "ends")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        low, given = state.get if state.exists else (float("inf"), False)
        rows = pd.concat(list(frames)).sort_values("bar_start")
        rows["stop"] = rows["low"].cummin().clip(upper=low)
        hit = rows[(rows["minute"] >= start_minute) & (rows["high"] >= rows["trigger_price"])][: 0 if given else 1]
        state.update((float(rows["stop"].iloc[-1]), bool(given or len(hit))))
        state.setTimeoutTimestamp(max(int(rows["ends"].iloc[0]), state.getCurrentWatermarkMs() + 1))
        yield hit.assign(entry_price=hit[["open", "trigger_price"]].max(axis=1))[["symbol", "day", "bar_start", "entry_price", "stop"]]

    return b.groupBy("symbol", "day").applyInPandasWithState(step, "symbol string, day date, bar_start timestamp, entry_price double, stop double", "low double, given boolean", "append", GroupStateTimeout.EventTimeTimeout)


def entry_alerts_batch(bars_: DataFrame, watch: DataFrame, start_minute: int = 0, cutoff_minute: int = 24 * 60) -> DataFrame:
    """Batch twin of entry_alerts."""
    minute = F.hour("bar_start") * 60 + F.minute("bar_start")
    b = bars_.join(watch.select("symbol", "trigger_price"), "symbol").withColumns({"day": F.to_date("bar_start"), "minute": minute}).where(F.col("minute") <= cutoff_minute)
    b = b.withColumn("stop", F.min("low").over(Window.partitionBy("symbol", "day").orderBy("bar_start").rowsBetween(Window.unboundedPreceding, 0)))
    b = b.where((F.col("minute") >= start_minute) & (F.col("high") >= F.col("trigger_price")))
    first = F.min_by(F.struct("bar_start", F.greatest("open", "trigger_price").alias("entry_price"), "stop"), "bar_start").alias("a")
    return b.groupBy("symbol", "day").agg(first).select("symbol", "day", "a.*")


def track_stops(bars_: DataFrame, positions: DataFrame, activation: float = 0.08, trail: float = 0.02) -> DataFrame:
    """Stream: long positions (symbol, entry_price, stop) followed bar by bar until the stop is reached.

    A bar that opens at or below the stop exits at its open; one that reaches
    it exits at the stop; otherwise the stop trails the best price once that
    is far enough above the entry, and holds for the next bar.
    """
    b = bars_.join(positions.select("symbol", "entry_price", "stop"), "symbol").select("symbol", "bar_start", "open", "high", "low", "entry_price", "stop")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stop, best, done = state.get if state.exists else (float("-inf"), float("-inf"), False)
        rows = pd.concat(list(frames)).sort_values("bar_start")
        # the stop only rises, so what it is before each bar is a running maximum
        value = {c: rows[c].to_numpy() for c in ("open", "high", "low", "entry_price", "stop")}
        tops = np.maximum(np.maximum.accumulate(value["high"]), best)
        moved = np.where(tops >= value["entry_price"] * (1 + activation), np.maximum(value["entry_price"], tops * (1 - trail)), -np.inf)
        after = np.maximum.accumulate(np.maximum(np.maximum(value["stop"], moved), stop))
        held = np.maximum(np.concatenate(([stop], after[:-1])), value["stop"])
        gap = value["open"] <= held
        hit = np.flatnonzero(gap | (value["low"] <= held))[: 0 if done else 1]
        state.update((float(after[-1]), float(tops[-1]), bool(done or len(hit))))
        out = rows.iloc[hit]
        yield pd.DataFrame({"symbol": out["symbol"], "exit_time": out["bar_start"], "exit_price": np.where(gap[hit], out["open"], held[hit]), "exit_reason": np.where(gap[hit], "GAP_STOP", "STOP")})

    return b.groupBy("symbol").applyInPandasWithState(step, "symbol string, exit_time timestamp, exit_price double, exit_reason string", "stop double, best double, done boolean", "append", GroupStateTimeout.NoTimeout)


def track_stops_batch(bars_: DataFrame, positions: DataFrame, activation: float = 0.08, trail: float = 0.02) -> DataFrame:
    """Batch twin of track_stops: the stop is a running maximum."""
    order = Window.partitionBy("symbol").orderBy("bar_start")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    b = bars_.join(positions.select("symbol", "entry_price", F.col("stop").alias("stop0")), "symbol").withColumn("best", F.max("high").over(run))
    moved = F.when(F.col("best") >= F.col("entry_price") * (1 + activation), F.greatest("entry_price", F.col("best") * (1 - trail)))
    b = b.withColumn("after", F.greatest("stop0", F.max(moved).over(run))).withColumn("stop", F.coalesce(F.lag("after").over(order), F.col("stop0")))
    hit = b.where((F.col("open") <= F.col("stop")) | (F.col("low") <= F.col("stop")))
    row = F.struct(F.col("bar_start").alias("exit_time"), F.least("open", "stop").alias("exit_price"), F.when(F.col("open") <= F.col("stop"), "GAP_STOP").otherwise("STOP").alias("exit_reason"))
    return hit.groupBy("symbol").agg(F.min_by(row, "bar_start").alias("x")).select("symbol", "x.*")


def late_rows(query) -> int:
    """Rows that a stream's stateful steps have dropped so far for being behind the watermark."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for progress in query.recentProgress for op in progress["stateOperators"])


def once(stream: DataFrame, keys: list[str], time: str, delay: str = "10 minutes") -> DataFrame:
    """Rows of a key that come again within the delay, in one batch or in later ones, are left out; state ends with the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def idempotent_sink(path: str, keys: list[str] = ["session_id", "symbol", "bar_end"]) -> Callable[[DataFrame, int], None]:  # noqa: B006
    """A foreachBatch function: rows of known keys are replaced, so a batch may come twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        new = batch.dropDuplicates(keys).withColumn("batch_id", F.lit(batch_id))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    return write


def read_sink(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """One row per key of such a sink: that of the latest batch."""
    return last_wins(spark.read.parquet(path), keys, "batch_id")


def risk_flags(results: DataFrame, max_loss: float = 0.03, max_drawdown: float = 0.10, cutoff: str = "15:15") -> DataFrame:
    """Per row of session results (ts, day_pnl, equity, peak, capital): which limits are passed."""
    tests = [
        F.when(F.date_format("ts", "HH:mm") >= cutoff, "cutoff"),
        F.when(F.col("day_pnl") <= F.col("capital") * -max_loss, "daily_loss"),
        F.when((F.col("peak") - F.col("equity")) >= F.col("peak") * max_drawdown, "drawdown"),
    ]
    return results.withColumn("flags", F.array_compact(F.array(*tests))).withColumn("halt", F.size("flags") > 0)
