"""Further registered queries: single expressions, joins, reports, sets, gates and lineage."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..operators import candidates, features, outcomes, quality, reports
from ..operators.candidates import Params
from ..sources import bars as src
from . import incremental, oracle, research
from .oracle import BARS, BARS_DAILY, BREAKOUT_RANK, DAILY, DERIVED, INTRADAY, W, sql
from .registry import FEATURES, LIMITS, TRADE_SQL, daily, feats, intraday, query, rounded, trades

PRIOR = INTRADAY.split("),\ni0")[0] + ")"


@query(sql(DAILY, FEATURES, DERIVED, select="select symbol, date, " + " + ".join(f"cast(coalesce(filter_{x}, false) as int)" for x in "hnycl2") + " score, filters_passed from derived"))
def p6_filter_score_modes(spark, sf):
    f = rounded(feats(spark, sf))
    strict = features.derived_features(f, null_mode="propagate").select("symbol", "date", "filters_passed", *candidates.FLAGS)
    return strict.select("symbol", "date", ex.filter_score([F.col(x) for x in candidates.FLAGS], "false").alias("score"), "filters_passed")


@query(sql(DAILY, FEATURES, select="select symbol, date, case when cast(symbol as int) % 2 = 0 then coalesce(close_pos_in_range >= 0.7, false) else coalesce(close_pos_in_range <= 0.3, false) end h from feat"))
def p7_directed_filter(spark, sf):
    side = F.when(F.col("symbol").cast("int") % 2 == 0, "LONG").otherwise("SHORT")
    return feats(spark, sf).select("symbol", "date", ex.directed_h(side, F.col("close_pos_in_range")).alias("h"))


@query(sql(DAILY, FEATURES, "share as (select date, cast(count(*) filter (close >= 10 and close < ma_20) as double) / nullif(count(*) filter (close >= 10 and ma_20 is not null), 0) s from feat group by 1)", oracle.lagged(), oracle.threshold_candidates(True), select="select c.symbol, c.date from cand0 c left join share on share.date = c.watch_date where coalesce(s, 0) > 0.5"))
def j8_breadth_gate(spark, sf):
    p = Params("breakdown", breadth_threshold=0.5, **LIMITS)
    return candidates.breakdown(None, rounded(feats(spark, sf)), p).select("symbol", "date")


@query(sql(BARS, select="select symbol, candle_time, hour(candle_time) * 60 + minute(candle_time) - 555 as from_open from bars"))
def p10_minutes_from_open(spark, sf):
    return intraday(spark, sf).select("symbol", "candle_time", ex.minutes_from_open(F.col("candle_time")).alias("from_open"))


@query(sql(DAILY, select="select symbol, date, close, volume from daily where close >= 1000 and close * volume >= 40000 and volume >= 30"))
def p14_admission(spark, sf):
    p = Params(min_price=1000, min_value=40_000, min_volume=30)
    return daily(spark, sf).where(candidates.admitted(p, "close", F.col("close") * F.col("volume"), "volume")).select("symbol", "date", "close", "volume")


@query(sql(DAILY, FEATURES, select="select case when gap_open_vs_prev_close < -0.2 then 'down' when gap_open_vs_prev_close < 0.2 then 'flat' else 'up' end gap, isodow(date) weekday, month(date) as month, count(*) n from feat where gap_open_vs_prev_close is not null group by all"))
def p21_buckets(spark, sf):
    f = feats(spark, sf).withColumn("gap", ex.bucket(F.col("gap_open_vs_prev_close"), [-0.2, 0.2], ["down", "flat", "up"])).where("gap is not null")
    return f.groupBy("gap", ex.weekday(F.col("date")).alias("weekday"), F.month("date").alias("month")).agg(F.count("*").alias("n"))


@query(sql(DAILY, select=f"select symbol, date, symbol || ' moved ' || cast(cast(floor(abs(r) * 100) as int) as varchar) || '% on ' || strftime(date, '%Y-%m-%d') detail from (select *, close / nullif(lag(close) over {W}, 0) - 1 r from daily) where abs(r) > 0.5"))
def p23_detail_text(spark, sf):
    m = feats(spark, sf).where(F.abs("ret_1d") > 0.5)
    return m.select("symbol", "date", F.concat("symbol", F.lit(" moved "), F.floor(F.abs("ret_1d") * 100).cast("int").cast("string"), F.lit("% on "), F.date_format("date", "yyyy-MM-dd")).alias("detail"))


@query(sql(BARS, BARS_DAILY, select="select b.symbol, b.date, b.candle_time, b.close, d.high day_high from bars b join (select * from bdaily where high > low * 50) d using (symbol, date)"))
def j3_bars_of_signal_days(spark, sf):
    b = intraday(spark, sf)
    days = src.intraday_to_daily(b).where("high > low * 50").select("symbol", "date", F.col("high").alias("day_high"))
    return b.join(days, ["symbol", "date"]).select("symbol", "date", "candle_time", "close", "day_high")


@query(sql(DAILY, select="select symbol, date, close from daily where symbol in (select cast(s_suppkey as varchar) from supplier where s_acctbal < 0)"))
def j4_semi_join(spark, sf):
    s = src.table(spark, sf, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").cast("string").alias("symbol"))
    return src.scoped(daily(spark, sf), symbols=s, columns=["symbol", "date", "close"])


FOLDS = "folds as (select row_number() over (order by s) - 1 fold, s train_start, s + 503 train_end, s + 504 test_start, least(s + 629, date '1998-12-01') test_end from (select cast(unnest(generate_series(date '1993-01-01', date '1998-12-01', interval 126 day)) as date) s) where s + 504 <= date '1998-12-01')"


@query(sql(DAILY, "days as (select date, row_number() over (order by date) - 1 n from (select distinct date from daily))", select="select a.n // 63 fold, a.date train_start, b.date train_end, c.date test_start, d.date test_end from days a join days b on b.n = a.n + 251 join days c on c.n = a.n + 252 join days d on d.n = least(a.n + 314, (select max(n) from days)) where a.n % 63 = 0"))
def o12_session_windows(spark, sf):
    return research.session_windows(daily(spark, sf)).withColumn("fold", F.col("fold").cast("long"))


@query(sql(DAILY, select=f"select symbol, n_days, round(m / s * sqrt(252), 4) sortino from (select symbol, count(r) n_days, avg(r - 0.02 / 252) m, stddev_pop(r - 0.02 / 252) filter (r < 0.02 / 252) s from (select symbol, close / nullif(lag(close) over {W}, 0) - 1 r from daily) group by 1)"))
def a13_sortino(spark, sf):
    r = feats(spark, sf).select("symbol", "ret_1d")
    return reports.risk_ratios(r, "ret_1d", 0.02, "symbol").select("symbol", "n_days", F.round("sortino", 4).alias("sortino"))


@query(sql(BARS, BARS_DAILY, PRIOR, "trig as (select s.symbol, s.date, p.prior_day_close * 1.002 t from (select distinct symbol, date from bars) s join prior p using (symbol, date))",
  "m as (select b.*, t, min(low) over (partition by symbol, date order by candle_time) sl from bars b join trig using (symbol, date) where hour(candle_time) * 60 + minute(candle_time) <= 600)",
  "e as (select symbol, date, arg_min(greatest(open, t), candle_time) p, arg_min(case when sl < greatest(open, t) then sl else greatest(open, t) * 0.96 end, candle_time) s from m where high >= t and hour(candle_time) * 60 + minute(candle_time) >= 5 group by 1, 2)",
  select="select case when abs(p - s) > p * 0.08 then 'stop_too_far' else 'executed' end status, count(*) n from e group by 1"))
def a14_execution_funnel(spark, sf):
    from .registry import opening_entries

    return reports.funnel(outcomes.gate(opening_entries(spark, sf)[1]))


@query(sql(DAILY, FEATURES, select="select 'vol_20' param, round(abs(corr(vol_20, ret_1d)) * (max(ret_1d) - min(ret_1d)) / abs(avg(ret_1d)), 4) score from feat where ret_1d <> 0"))
def a23_sensitivity(spark, sf):
    runs = feats(spark, sf).select(F.lit("vol_20").alias("param"), F.col("vol_20").alias("value"), F.col("ret_1d").alias("metric"))
    return reports.sensitivity(runs).select("param", F.round("score", 4).alias("score"))


@query(sql(*TRADE_SQL, select="select round(stddev_pop(s) / avg(s), 4) calmar_cv, count(*) filter (n < 10) thin_folds, count(*) folds from (select year, sum(pnl_pct) s, count(*) n from trades group by 1)"))
def a24_fold_consistency(spark, sf):
    t = trades(spark, sf).groupBy("exp_id", "year").agg(F.sum("pnl_pct").alias("calmar"), F.count("*").alias("trades"))
    return reports.fold_consistency(t).select(F.round("calmar_cv", 4).alias("calmar_cv"), "thin_folds", "folds")


@query(sql(DAILY, FEATURES, oracle.lagged(), oracle.threshold_candidates(False), BREAKOUT_RANK, select="select symbol, date, slot from (select symbol, date, row_number() over (partition by date order by selection_score desc, symbol) slot from c3) where slot <= 3"))
def t4_t7_slots(spark, sf):
    rows = candidates.breakout_score(candidates.generate(None, rounded(feats(spark, sf)), Params(min_filters=3, **LIMITS)))
    return candidates.take_slots(rows, 3, "date").select("symbol", "date", "slot")


@query("select distinct cast(l_suppkey as varchar) symbol, cast(l_shipdate as date) date from lineitem")
def u2_distinct_symbol_dates(spark, sf):
    return daily(spark, sf).select("symbol", "date").distinct()


@query(sql(DAILY, "a as (select distinct symbol from daily where date < date '1993-01-01')", "b as (select distinct symbol from daily where date > date '1998-11-01')", select="select coalesce(a.symbol, b.symbol) symbol, case when b.symbol is null then 'gone' when a.symbol is null then 'new' else 'both' end side from a full join b on a.symbol = b.symbol"))
def u3_symbol_sets(spark, sf):
    d = daily(spark, sf)
    a = d.where("date < date'1993-01-01'").select("symbol").distinct().withColumn("a", F.lit(True))
    b = d.where("date > date'1998-11-01'").select("symbol").distinct().withColumn("b", F.lit(True))
    return a.join(b, "symbol", "full").select("symbol", F.when(F.col("b").isNull(), "gone").when(F.col("a").isNull(), "new").otherwise("both").alias("side"))


@query("select l_suppkey, l_partkey, l_orderkey from (select *, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey) k from lineitem) where k = 1")
def u4_keep_first(spark, sf):
    rows = src.table(spark, sf, "lineitem").withColumn("place", F.struct("l_orderkey", "l_linenumber", "l_partkey"))
    return src.last_wins(rows, ["l_suppkey"], "place", keep="first").select("l_suppkey", "l_partkey", "l_orderkey")


@query(sql(DAILY, select="select symbol, date, case when date >= date '1998-06-01' then 0.0 else close end as close from daily"))
def u7_upsert(spark, sf):
    d = daily(spark, sf).select("symbol", "date", "close")
    return incremental.upsert(d, d.where("date >= date'1998-06-01'").withColumn("close", F.lit(0.0)), ["symbol", "date"])


@query(sql(DAILY, FEATURES, select="""select symbol, date, case when hold then 'normal' when close <= entry then 'weak_close_exit' else 'breakeven_carry' end carry_action, case when not hold and close <= entry then carry else greatest(carry, entry) end next_carry_stop
  from (select symbol, date, close, open entry, low carry, coalesce(close_pos_in_range >= 0.7, false) hold from feat)"""))
def o5_carry_rule(spark, sf):
    f = feats(spark, sf)
    none = lambda t: F.lit(None).cast(t)
    held = daily(spark, sf).select("symbol", "date", F.lit("LONG").alias("direction"), F.col("open").alias("entry_price"), F.col("low").alias("carry_stop"), none("string").alias("exit_reason"), none("double").alias("exit_price"), F.lit(1).alias("days_held"))
    return outcomes.end_of_day(held, f).select("symbol", "date", "carry_action", "next_carry_stop")


@query(sql(DAILY, select="select count(*) filter (volume is not null) valid, count(*) filter (volume is null) quarantined from (select symbol, date, case when volume < 5 then null else volume end volume from daily)"))
def q16_quarantine(spark, sf):
    d = daily(spark, sf).withColumn("volume", F.when(F.col("volume") < 5, None).otherwise(F.col("volume")))
    good, bad = quality.quarantine(d, ("symbol", "date", "volume"))
    return good.agg(F.count("*").alias("valid")).join(F.broadcast(bad.agg(F.count("*").alias("quarantined"))))


@query(sql(BARS, BARS_DAILY, "spine as (select distinct date from bdaily)", "grid as (select s.symbol, d.date from (select distinct symbol from bdaily) s, spine d)", select="select g.symbol, g.date, coalesce(last_value(b.close ignore nulls) over (partition by g.symbol order by g.date), first_value(b.close ignore nulls) over (partition by g.symbol order by g.date rows between current row and unbounded following)) as close from grid g left join bdaily b using (symbol, date)"))
def o4_union_calendar(spark, sf):
    return outcomes.union_calendar(src.intraday_to_daily(intraday(spark, sf))).select("symbol", "date", "close")


@query(sql(BARS, BARS_DAILY, PRIOR, "w as (select symbol, max(prior_day_high) t from prior group by 1)", select="select symbol, cast(candle_time as date) as day, min(candle_time) bar_start from bars join w using (symbol) where high >= t * 0.9 group by 1, 2"))
def r6_alert_times(spark, sf):
    from ..streaming import ticks

    b = intraday(spark, sf)
    d = src.intraday_to_daily(b)
    top = d.withColumn("next", F.lead("date").over(features.by_date())).groupBy("symbol").agg((F.max("high") * 0.9).alias("trigger_price"))
    return ticks.entry_alerts_batch(b.withColumnRenamed("candle_time", "bar_start"), top).select("symbol", "day", "bar_start")


