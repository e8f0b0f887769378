"""Registered queries over files: bars written in the forms that sources have, read back and cleaned, and result and lake layouts.

The files are derived from the given tables and go to the folder that driver
and executors share.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import features, quality, reports
from ..sources import bars as src
from ..sources.shared import shared_path
from ..streaming import ticks
from . import incremental
from .oracle import BARS, DAILY, W, sql
from .registry import daily, intraday, query


@query(sql(DAILY, select="select symbol, date, open, high, low, close, case when year(date) >= 1998 then volume end volume, cast(null as double) vwap from daily"))
def s1_s19_older_schemas(spark, sf):
    """A store whose older files lack the volume, read with a schema that also names a column that no file has."""
    path = shared_path(spark, "bars")
    b = daily(spark, sf)
    b.where(F.year("date") < 1998).drop("volume").write.parquet(f"{path}/part=1")
    b.where(F.year("date") >= 1998).write.parquet(f"{path}/part=2")
    return src.read_bars(spark, path, T.StructType([*b.schema, T.StructField("vwap", T.DoubleType())]))


def as_text(b: DataFrame, date: str = "yyyy-MM-dd") -> list:
    return [F.date_format("date", date), *(F.format_number(c, 2) for c in src.PRICES), F.col("volume").cast("string")]


@query(sql(DAILY, select="select symbol, date, round(open, 2) open, round(high, 2) high, round(low, 2) low, round(close, 2) as close, volume from daily"))
def s4_delimited_files(spark, sf):
    """Files with delimiters, headers and date formats of their own; numbers have thousands separators."""
    path = shared_path(spark, "delimited")
    b, odd = daily(spark, sf), F.col("symbol").cast("int") % 2 == 1
    b.where(odd).select("symbol", *(c.alias(n) for c, n in zip(as_text(b), ("Date", "Open", "High", "Low", "Close", "Volume"), strict=True))).write.options(header=True, sep=";").csv(f"{path}/a")
    b.where(~odd).select(*(c.alias(n) for c, n in zip(as_text(b, "dd/MM/yyyy"), ("trading_date", "o", "h", "l", "c", "vol"), strict=True)), F.col("symbol").alias("ticker")).write.options(header=True, sep="\t").csv(f"{path}/b")
    return src.read_delimited(spark, f"{path}/*/*.csv").select("symbol", "date", *src.PRICES, "volume")


@query(sql(DAILY, select="select symbol, date, open, high, low, close + case when day(date) % 2 = 0 then 1 else 0 end as close, volume from daily where day(date) <> 31"))
def s5_raw_daily(spark, sf):
    """Raw lines as text: on even days a corrected line came later; of the last day of a month the open is no number."""
    b = daily(spark, sf).withColumn("date", F.concat(F.col("date").cast("string"), F.lit(" 00:00:00+05:30")))
    day = F.substring("date", 9, 2).cast("int")
    raw = b.withColumns({c: F.col(c).cast("string") for c in (*src.PRICES, "volume")}).withColumn("open", F.when(day == 31, "n/a").otherwise(F.col("open"))).withColumn("load_seq", F.lit(0))
    later = raw.where(day % 2 == 0).withColumns({"close": (F.col("close").cast("double") + 1).cast("string"), "load_seq": F.lit(1)})
    return src.normalize_daily(raw.unionByName(later).withColumnsRenamed({"date": "Date", "open": "OPEN", "symbol": "Ticker"})).select("symbol", "date", *src.PRICES, "volume")


@query(sql(BARS, select="select symbol, candle_time + interval 330 minutes candle_time, cast(candle_time + interval 330 minutes as date) date, open, high, low, close, volume, high - low true_range from bars"))
def s6_raw_intraday(spark, sf):
    raw = intraday(spark, sf).select(F.col("symbol").alias("ticker"), F.col("candle_time").alias("datetime"), *(F.col(c).cast("string").alias(c[0]) for c in src.PRICES), F.col("volume").cast("string").alias("vol"))
    return src.normalize_intraday(raw).select("symbol", "candle_time", "date", *src.PRICES, "volume", "true_range")


@query(sql(BARS, select="select symbol, cast(candle_time + interval 330 minutes as date) date, candle_time + interval 330 minutes candle_time, open, high, low, close + case when hour(candle_time) = 12 then 1 else 0 end as close, volume from bars"))
def s7_vendor_candles(spark, sf):
    """A chunk of candles a symbol and day, and a later chunk with other closes for one hour."""
    b = intraday(spark, sf)
    item = lambda close: F.array(F.col("candle_time").cast("string"), *(F.col(c).cast("string") for c in ("open", "high", "low")), close.cast("string"), F.col("volume").cast("string"))
    chunks = b.groupBy("symbol", "date").agg(F.collect_list(item(F.col("close"))).alias("candles")).withColumn("chunk_seq", F.lit(0))
    noon = b.where(F.hour("candle_time") == 12).groupBy("symbol", "date").agg(F.collect_list(item(F.col("close") + 1)).alias("candles")).withColumn("chunk_seq", F.lit(1))
    return src.vendor_candles(chunks.unionByName(noon))


@query(sql(DAILY, select="select symbol, date, open, high, low, close, volume, cast(null as double) vwap from daily"))
def s8_silver_columns(spark, sf):
    raw = daily(spark, sf).withColumns({c: F.col(c).cast("string") for c in ("date", *src.PRICES)}).withColumnsRenamed({"symbol": "Ticker", "date": "TRADING DATE", "volume": " Vol "})
    return src.project_existing(src.normal_names(raw), T.StructType([*daily(spark, sf).schema, T.StructField("vwap", T.DoubleType())]))


@query(sql(BARS, select="select symbol, candle_time, date, close from bars"))
def s14_repaired_times(spark, sf):
    """Bars of two symbols stored in another zone are moved back by their issues."""
    b = intraday(spark, sf).withColumn("year", F.year("candle_time"))
    moved = F.col("symbol").isin("click", "view")
    shifted = b.withColumn("candle_time", F.when(moved, F.col("candle_time") - F.expr("INTERVAL '5:30' HOUR TO MINUTE")).otherwise(F.col("candle_time"))).withColumn("date", F.to_date("candle_time"))
    issues = b.where(moved).select("symbol", "year").distinct().withColumn("issue", F.lit("legacy_utc_naive"))
    return src.repair_alignment(shifted, issues).select("symbol", "candle_time", "date", "close")


@query(sql(DAILY, select="select 'y' || year(date) exp_id, count(*) n_rows, cast(sum(volume) as bigint) volume, 'csv' form from daily where year(date) <> 1996 group by 1 union all select 'y' || year(date), count(*) + case when year(date) = 1996 then 1 else 0 end, cast(sum(volume) as bigint) + case when year(date) = 1996 then 5 else 0 end, 'parquet' from daily group by year(date)"))
def s17_results(spark, sf):
    """Result tables by experiment as Parquet and as text; an experiment written again replaces itself alone."""
    rows = daily(spark, sf).select(F.concat(F.lit("y"), F.year("date")).alias("exp_id"), "symbol", "volume")
    more = rows.where("exp_id = 'y1996'").unionByName(spark.range(1).select(F.lit("y1996").alias("exp_id"), F.lit("again").alias("symbol"), F.lit(5).cast("long").alias("volume")))
    out = None
    for form in ("parquet", "csv"):
        path = shared_path(spark, "results")
        src.write_results(rows if form == "parquet" else rows.where("exp_id <> 'y1996'"), path, form=form)
        if form == "parquet":
            src.write_results(more, path, form=form)
        back = spark.read.schema("symbol string, volume long, exp_id string").option("header", True).format(form).load(path)
        part = back.groupBy("exp_id").agg(F.count("*").alias("n_rows"), F.sum("volume").alias("volume")).withColumn("form", F.lit(form))
        out = part if out is None else out.unionByName(part)
    return out


@query("select distinct upper(trim(s_name)) symbol from supplier where s_nationkey % 2 = 0")
def s20_reference_symbols(spark, sf):
    s = src.table(spark, sf, "supplier")
    raw = s.select(F.concat(F.lit("  "), F.lower("s_name")).alias("tradingsymbol"), F.when(F.col("s_nationkey") % 2 == 0, "NSE").otherwise("BSE").alias("segment"), F.lit("EQ").alias("instrument_type"))
    return src.reference_symbols(raw, "NSE", "EQ", least=1)


@query(sql(DAILY, select="select year(date) as year, strftime(date, '%m') as month, count(*) n_rows, min(date) first_date, max(date) last_date from daily where year(date) between 1996 and 1998 group by 1, 2"))
def s21_lake(spark, sf):
    path = shared_path(spark, "lake")
    src.write_lake(daily(spark, sf), path)
    back = spark.read.schema("symbol string, date date, close double, year int, month string").parquet(path)
    return back.where(F.col("year").between(1996, 1998)).groupBy("year", "month").agg(F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("""select cast(o_custkey as varchar) session_id, round(sum(o_totalprice - 20 - case when o_orderkey % 3 = 0 then o_orderkey % 7 else 0 end), 2) net_pnl, count(*) positions from orders group by 1""")
def a21_session_result(spark, sf):
    """Orders as positions: every third has a partial exit in its metadata, with fees of its own."""
    o, key = src.table(spark, sf, "orders"), F.col("o_orderkey")
    meta = F.when(key % 3 == 0, F.to_json(F.struct(F.lit(True).alias("partial_exit"), (key % 7).cast("double").alias("partial_fees")))).when(key % 3 == 1, F.lit("{}"))
    p = o.select(F.col("o_custkey").cast("string").alias("session_id"), F.col("o_totalprice").cast("double").alias("realized"), F.lit(20.0).alias("fees"), meta.alias("metadata"))
    return reports.session_result(p).select("session_id", F.round("net_pnl", 2).alias("net_pnl"), "positions")


@query(sql(DAILY, "a as (select symbol, date, close, case when date <= date '1995-06-30' and cast(symbol as int) % 3 = 0 then 0.5 else 1.0 end f from daily)", f"b as (select *, close * f ac, lag(f) over {W} pf, lag(close * f) over {W} pc from a)",
  select="select symbol, date, round(abs(ac / nullif(pc, 0) - 1), 6) jump from b where pf <> f and abs(ac / nullif(pc, 0) - 1) > 0.001"))
def w27_continuity(spark, sf):
    """Bars that were never split, adjusted for splits: the adjusted closes jump where the factor changes."""
    b = daily(spark, sf)
    actions = b.where(F.col("symbol").cast("int") % 3 == 0).select("symbol").distinct().select("symbol", F.lit("1995-06-30").cast("date").alias("ex_date"), F.lit("SPLIT").alias("action_type"), F.lit(2.0).alias("ratio_num"), F.lit(1.0).alias("ratio_den"))
    return features.continuity_breaks(features.adjustment_series(b, actions)).select("symbol", "date", F.round("jump", 6).alias("jump"))


@query(sql(BARS, "m as (select *, case when minute(candle_time) = 5 then null else open end o, case when minute(candle_time) = 10 then null else close end c from bars)", select="select symbol, date, count(*) n from m where o is null or high is null or low is null or c is null group by 1, 2"))
def q2_null_prices(spark, sf):
    minute = F.minute("candle_time")
    b = intraday(spark, sf).withColumns({"open": F.when(minute != 5, F.col("open")), "close": F.when(minute != 10, F.col("close"))})
    return quality.flagged(b, quality.intraday_rules()).where("issue_code = 'NULL_PRICE'").groupBy("symbol", "date").agg(F.count("*").alias("n"))


@query(sql(DAILY, select="select 'y' || year(date) exp_id, count(*) n_rows, (select count(*) from daily where year(date) = 1996) removed from daily where year(date) <> 1996 group by year(date)"))
def m7_drop_run(spark, sf):
    rows = daily(spark, sf).select(F.concat(F.lit("y"), F.year("date")).alias("exp_id"), "symbol")
    kept, removed = incremental.drop_run(rows, "y1996")
    return kept.groupBy("exp_id").agg(F.count("*").alias("n_rows")).join(F.broadcast(removed))


TICK_WINDOWS = """tb as (select event_type symbol, time_bucket(interval 5 minutes, ts) bar_start, arg_min(value, ts) open, max(value) high, min(value) low, arg_max(value, ts) as close, count(*) n_ticks from events group by 1, 2)"""


@query(sql(TICK_WINDOWS, select="select symbol, bar_start, open, high, low, close, n_ticks from tb"))
def r3_r5_streamed_bars(spark, sf):
    """Events replayed as a stream in the order of their days, bars closed by the watermark, the last flushed by a tick behind all others, and each bar once on disk."""
    path = shared_path(spark, "stream")
    t = src.table(spark, sf, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("last_price"), F.col("event_id").alias("volume"))
    last = t.agg(F.lit("flush").alias("symbol"), F.expr("max(ts) + interval 2 days").alias("ts"), F.lit(0.0).alias("last_price"), F.lit(0).cast("long").alias("volume"))
    t = t.unionByName(last.select(*(F.col(f.name).cast(f.dataType) for f in t.schema)))
    ticks.write_replay(t, f"{path}/ticks", "ts")
    bars = ticks.bars(ticks.replay_ordered(spark, f"{path}/ticks", t.schema, 10), delay="1 hour")
    run = bars.writeStream.foreachBatch(ticks.idempotent_sink(f"{path}/bars", ["symbol", "bar_end"])).option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    # the extra tick is left out here: a condition on the stream would go below the watermark, which it is to move
    return ticks.read_sink(spark, f"{path}/bars", ["symbol", "bar_end"]).where("symbol <> 'flush'").select("symbol", F.col("bar_start").cast("timestamp_ntz").alias("bar_start"), "open", "high", "low", "close", "n_ticks")
