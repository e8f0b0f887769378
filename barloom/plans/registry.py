"""Registered queries over the benchmark tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import places
from ..operators import candidates, features, outcomes, quality, reconcile, reports
from ..operators.candidates import Params
from ..sources import bars as src
from . import incremental, oracle, research
from .oracle import BARS, BARS_DAILY, BREAKDOWN_RANK, BREAKOUT_RANK, DAILY, DERIVED, FEATURE_COLUMNS, INTRADAY, INTRADAY_COLUMNS, TRADES, W, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FEATURES = oracle.features()
#: Admission limits that suit the prices and quantities of the benchmark tables.
LIMITS = {"min_price": 10.0, "min_value": 30_000.0, "min_volume": 20}
AS_OF = "1998-12-01"


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            ORACLE[f.__name__] = text
        return f

    return add


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return src.daily_from_lineitem(spark, sf)


def intraday(spark: SparkSession, sf: str) -> DataFrame:
    return src.intraday_from_events(spark, sf)


def feats(spark: SparkSession, sf: str) -> DataFrame:
    return features.daily_features(daily(spark, sf))


def rounded(df: DataFrame) -> DataFrame:
    """What sums of fractions in another order would tell apart in the last bits."""
    return df.withColumns({c: F.round(c, 6) for c in ("r2_65", "atr_compress_ratio") if c in df.columns})


@query(sql(DAILY, select="select * from daily"))
def s15_daily_bars(spark, sf):
    return daily(spark, sf)


@query(sql(BARS, select="select symbol, date, candle_time, open, high, low, close, volume from bars"))
def r1_intraday_bars(spark, sf):
    return intraday(spark, sf)


@query(sql(BARS, BARS_DAILY, select="select * from bdaily"))
def s15_intraday_to_daily(spark, sf):
    return src.intraday_to_daily(intraday(spark, sf))


@query(sql(DAILY, select="select symbol, date, close from daily where date between date '1995-01-01' and date '1995-12-31' and symbol in ('1', '2', '3')"))
def s3_scoped_range(spark, sf):
    return src.scoped(daily(spark, sf), "1995-01-01", "1995-12-31", ["1", "2", "3"], ["symbol", "date", "close"])


@query(sql(BARS, select="select symbol, date, candle_time, close from bars where hour(candle_time) * 60 + minute(candle_time) between 555 and 930"))
def s11_session_filter(spark, sf):
    return src.in_session(intraday(spark, sf)).select("symbol", "date", "candle_time", "close")


@query(sql(BARS, select="select symbol, candle_time + interval '330 minutes' local_time, close from bars"))
def s12_local_time(spark, sf):
    return intraday(spark, sf).select("symbol", src.local_time(F.col("candle_time"), "UTC", "Asia/Kolkata").alias("local_time"), "close")


@query(sql(BARS, select="""select symbol, year(date) as year, min(candle_time) first_candle,
  case when hour(min(candle_time)) * 60 + minute(min(candle_time)) = 225 then 'legacy_utc_naive' when hour(min(candle_time)) * 60 + minute(min(candle_time)) <> 555 then 'first_candle_not_at_open' end issue
  from bars group by 1, 2 having issue is not null"""))
def s13_alignment_issues(spark, sf):
    return src.alignment_issues(intraday(spark, sf).withColumn("year", F.year("date")))


@query(sql(DAILY, select="""select symbol, date, close, volume from (select *, row_number() over (partition by symbol, date order by load desc) k from (
  select *, 0 load from daily union all select symbol, date, open, high, low, close + 1, volume * 2, 1 from daily where date >= date '1997-01-01')) where k = 1"""))
def s9_merge_last_wins(spark, sf):
    old = daily(spark, sf)
    new = old.where("date >= date'1997-01-01'").withColumns({"close": F.col("close") + 1, "volume": F.col("volume") * 2})
    return src.merge(old, new, ["symbol", "date"]).select("symbol", "date", "close", "volume")


@query(sql(DAILY, select="""select symbol, case when first <= date '1994-01-01' and last >= date '1994-01-01' and not (last >= date '1998-11-20') then last + 1 else date '1994-01-01' end fetch_start,
  case when first > date '1994-01-01' and first <= date '1998-11-20' and last >= date '1998-11-20' then first - 1 else date '1998-11-20' end fetch_end, first <= date '1994-01-01' and last >= date '1998-11-20' skip
  from (select symbol, min(date) first, max(date) last from daily group by 1)"""))
def s10_fetch_windows(spark, sf):
    c = src.coverage(daily(spark, sf))
    wanted = c.select("symbol", F.lit("1994-01-01").cast("date").alias("start_date"), F.lit("1998-11-20").cast("date").alias("end_date"))
    return src.fetch_windows(wanted, c)


@query(sql(DAILY, FEATURES, select=f"select symbol, date, {', '.join(FEATURE_COLUMNS)} from feat"))
def w1_w8_daily_features(spark, sf):
    return rounded(feats(spark, sf)).select("symbol", "date", *FEATURE_COLUMNS)


@query(sql(DAILY, FEATURES, DERIVED, select="select symbol, date, prev_close, prev_open, prev_range, ret_1d_lag1, ret_1d_lag2, filter_h, filter_n, filter_y, filter_c, filter_l, filter_2, filters_passed from derived"))
def p5_w25_derived_features(spark, sf):
    return features.derived_features(feats(spark, sf)).select("symbol", "date", "prev_close", "prev_open", "prev_range", "ret_1d_lag1", "ret_1d_lag2", *(f"filter_{x}" for x in "hnycl2"), "filters_passed")


@query(sql(BARS, BARS_DAILY, INTRADAY, select=f"select symbol, date, candle_time, {', '.join(INTRADAY_COLUMNS)}, (high - or_15min_high) / nullif(or_15min_high, 0) range_expansion_vs_15min, (low - or_15min_low) / nullif(or_15min_low, 0) range_contraction_vs_15min from intraday"))
def w8_w14_intraday_features(spark, sf):
    b = intraday(spark, sf)
    return features.intraday_features(b, src.intraday_to_daily(b)).select("symbol", "date", "candle_time", *INTRADAY_COLUMNS, "range_expansion_vs_15min", "range_contraction_vs_15min")


BREADTH = "date universe_size up_4pct_count down_4pct_count up_4pct_pct down_4pct_pct above_ma20_pct below_ma20_pct above_ma40_pct below_ma40_pct up_25q_count down_25q_count up_25m_count down_25m_count up_50m_count down_50m_count up_13_34_count down_13_34_count ratio_5d ratio_10d primary_regime tactical_regime aggression_score posture_label alert_flags".split()


@query(sql(DAILY, FEATURES, oracle.breadth(10, 30_000), select=f"select {', '.join(BREADTH)} from breadth"))
def a1_w16_w17_breadth(spark, sf):
    return features.breadth(feats(spark, sf), 10, 30_000).withColumn("alert_flags", F.array_join("alert_flags", ",")).select(*BREADTH)


@query(sql(DAILY, FEATURES, select="select date, cast(count(*) filter (close >= 10 and close < ma_20) as double) / nullif(count(*) filter (close >= 10 and ma_20 is not null), 0) below_ma20_share from feat group by 1"))
def a2_breadth_ratio(spark, sf):
    return features.breadth_ratio(feats(spark, sf))


@query(sql(DAILY, select=f"""select symbol, date, case when n >= 20 then avg20 end ma_20, case when n >= 65 then avg65 end ma_65, case when n >= 65 then round(r2, 6) end r2_65, prior_breakouts_90d from (
  select *, avg(close) over {oracle.back(20)} avg20, avg(close) over {oracle.back(65)} avg65, regr_r2(close, n) over {oracle.back(65)} r2, cast(coalesce(sum(case when close / nullif(c1, 0) - 1 >= 0.04 then 1 else 0 end) over {oracle.back(91, 1)}, 0) as bigint) prior_breakouts_90d
  from (select *, lag(close) over {W} c1, row_number() over {W} n from daily))"""))
def w3_strict_features(spark, sf):
    return rounded(features.strict_features(daily(spark, sf))).select("symbol", "date", "ma_20", "ma_65", "r2_65", "prior_breakouts_90d")


@query(sql(DAILY, select=f"""select symbol, date, new_high, cast(coalesce(sum(cast(new_high as int)) over (partition by symbol order by date rows between 90 preceding and 1 preceding), 0) as bigint) prior_new_highs from (
  select *, coalesce(close > max(high) over (partition by symbol order by date rows between 20 preceding and 1 preceding), false) new_high from daily)"""))
def w28_new_highs(spark, sf):
    return features.new_high_counts(daily(spark, sf)).select("symbol", "date", "new_high", "prior_new_highs")




CANDIDATE = "symbol date watch_date prev_close gap_pct value_traded filter_h filter_n filter_y filter_c filter_l filter_2 filters_passed".split()


@query(sql(DAILY, FEATURES, oracle.lagged(), oracle.threshold_candidates(False), select=f"select {', '.join(CANDIDATE)} from cand where filters_passed >= 3"))
def o1_breakout_candidates(spark, sf):
    return candidates.generate(None, rounded(feats(spark, sf)), Params(min_filters=3, **LIMITS)).select(*CANDIDATE)


@query(sql(DAILY, FEATURES, oracle.lagged(), oracle.threshold_candidates(True), select=f"select {', '.join(CANDIDATE)} from cand where filters_passed >= 3"))
def o1_breakdown_candidates(spark, sf):
    return candidates.generate(None, rounded(feats(spark, sf)), Params("breakdown", min_filters=3, **LIMITS)).select(*CANDIDATE)


@query(sql(DAILY, FEATURES, oracle.lagged(), select="""select l.symbol, l.date, l.gap_pct, l.close * l.volume value_traded, case when l.gap_pct > 0 then 'LONG' else 'SHORT' end direction, l.close > f.ma_20 above_ma20, f.ret_5d > 0 positive_momentum
  from lagged l left join compat f using (symbol, date) where l.rn > 2 and abs(l.gap_pct) >= 0.05 and l.prev_close is not null and l.close >= 10 and l.close * l.volume >= 30000 and l.volume >= 20 and f.close_pos_in_range is not null"""))
def o1_episodic_candidates(spark, sf):
    return candidates.generate(None, feats(spark, sf), Params("episodic", **LIMITS)).select("symbol", "date", "gap_pct", "value_traded", "direction", "above_ma20", "positive_momentum")


@query(sql(DAILY, FEATURES, oracle.lagged(), select="""select symbol, date, gap_pct, filters_passed from (select l.symbol, l.date, l.gap_pct, cast(coalesce(f.close_pos_in_range >= 0.7, false) as int) + cast(coalesce((l.prev_high - l.prev_low) < f.atr_20 * 0.5 or l.prev_close < l.prev_open, false) as int)
  + cast(coalesce(f.prior_breakouts_30d, 0) <= 2 as int) + cast(coalesce(f.vol_dryup_ratio < 1.3, false) as int) + cast(coalesce(cast(l.close > f.ma_20 as int) + cast(f.ret_5d > 0 as int) + cast(coalesce(nullif(f.r2_65, 0), 0) >= 0.7 as int) >= 2, false) as int) + cast(coalesce(w1 <= 0 or w2 <= 0, false) as int) filters_passed
  from lagged l left join compat f using (symbol, date) where l.gap_pct >= 0.04 and l.close >= 10 and l.close * l.volume >= 30000 and l.volume >= 20 and f.close_pos_in_range is not null) where filters_passed >= 3"""))
def o1_legacy_candidates(spark, sf):
    return candidates.generate(None, rounded(feats(spark, sf)), Params("legacy", min_filters=3, **LIMITS)).select("symbol", "date", "gap_pct", "filters_passed")


@query(sql(DAILY, FEATURES, oracle.lagged(), oracle.threshold_candidates(False), BREAKOUT_RANK, select="select symbol, date, selection_score, selection_rank, selection_rank <= 30 selected from ranked"))
def w19_breakout_ranking(spark, sf):
    p = Params(min_filters=3, **LIMITS)
    return candidates.select_candidates(candidates.generate(None, rounded(feats(spark, sf)), p), p).select("symbol", "date", "selection_score", "selection_rank", "selected")


@query(sql(DAILY, FEATURES, oracle.lagged(), oracle.threshold_candidates(True), BREAKDOWN_RANK, select="select symbol, date, round(selection_score, 4) selection_score, selection_rank <= 5 selected from ranked"))
def w20_breakdown_ranking(spark, sf):
    p = Params("breakdown", min_filters=3, budget=5, **LIMITS)
    out = candidates.select_candidates(candidates.generate(None, rounded(feats(spark, sf)), p), p)
    return out.select("symbol", "date", F.round("selection_score", 4).alias("selection_score"), "selected")


def trades(spark, sf) -> DataFrame:
    p = Params(min_filters=3, **LIMITS)
    return research.backtest(None, rounded(feats(spark, sf)), p).withColumn("exp_id", F.lit("breakout"))


def trade_rows(t: DataFrame) -> DataFrame:
    money = (places(F.col(c), n).alias(c) for c, n in (("gross_pnl", 4), ("cost", 2), ("net_pnl", 4), ("pnl_pct", 6), ("pnl_r", 6)))
    return t.select("symbol", "date", "entry_price", "initial_stop", "exit_date", "exit_price", "exit_reason", F.col("holding_days").cast("long").alias("holding_days"), F.col("qty").cast("double").alias("qty"), *money)


TRADE_ROWS = "select symbol, date, entry_price, initial_stop, exit_date, exit_price, final_reason exit_reason, holding_days, qty, round(gross_pnl, 4) gross_pnl, round(cost, 2) as cost, round(net_pnl, 4) net_pnl, round(pnl_pct, 6) pnl_pct, round(pnl_r, 6) pnl_r from trades"
TRADE_SQL = (DAILY, FEATURES, oracle.lagged(), oracle.threshold_candidates(False), BREAKOUT_RANK, TRADES)


@query(sql(*TRADE_SQL, select="select symbol, date, entry_price, initial_stop, exit_date, exit_price, final_reason exit_reason, holding_days, qty, round(gross_pnl, 4) gross_pnl, round(cost, 2) as cost, round(net_pnl, 4) net_pnl, round(pnl_pct, 6) pnl_pct, round(pnl_r, 6) pnl_r from trades"))
def o4_o7_backtest_trades(spark, sf):
    return trade_rows(trades(spark, sf))


@query(sql(*TRADE_SQL, select="select round(quantile_cont(pnl_r, 0.1), 6) p10, round(quantile_cont(pnl_r, 0.25), 6) p25, round(median(pnl_r), 6) p50, round(quantile_cont(pnl_r, 0.75), 6) p75, round(quantile_cont(pnl_r, 0.9), 6) p90, round(max(pnl_r), 6) max_r, round(min(pnl_r), 6) min_r from trades"))
def a12_r_distribution(spark, sf):
    names = ("p10", "p25", "p50", "p75", "p90", "max_r", "min_r")
    return reports.r_distribution(trades(spark, sf)).select(*(F.round(n, 6).alias(n) for n in names))


@query(sql(DAILY, FEATURES, oracle.lagged(), oracle.threshold_candidates(False), select="select " + " || ".join(f"case when coalesce(filter_{x}, false) then '{x.upper()}' else '-' end" for x in "hnycl2") + " combination, count(*) n from cand group by 1 order by n desc, combination limit 20"))
def a17_filter_combinations(spark, sf):
    rows = candidates.breakout(None, rounded(feats(spark, sf)), Params(**LIMITS))
    return reports.filter_combinations(rows, candidates.FLAGS)


OPENING = """trig as (select s.symbol, s.date, p.prior_day_close * 1.002 trigger_price from (select distinct symbol, date from bars) s join prior p using (symbol, date)),
m0 as (select b.*, t.trigger_price, hour(candle_time) * 60 + minute(candle_time) as minute from bars b join trig t using (symbol, date)),
m1 as (select *, min(low) over (partition by symbol, date order by candle_time) session_low from m0 where minute between 0 and 600),
m2 as (select *, greatest(open, trigger_price) entry_price from m1 where minute >= 5 and high >= trigger_price),
ent as (select symbol, date, min(candle_time) entry_time, arg_min(entry_price, candle_time) entry_price, arg_min(case when session_low < entry_price then session_low else entry_price * 0.96 end, candle_time) initial_stop from m2 group by 1, 2)"""


def opening_entries(spark, sf):
    b = intraday(spark, sf)
    before = features.previous_session(b.select("symbol", "date").distinct(), src.intraday_to_daily(b)).where("prior_day_close is not null")
    s = before.select("symbol", "date", F.lit("LONG").alias("direction"), (F.col("prior_day_close") * 1.002).alias("trigger_price"), F.lit(None).cast("double").alias("atr_20"))
    return b, outcomes.resolve_entries(s, b, 5, 600, open_minute=0)


@query(sql(BARS, BARS_DAILY, INTRADAY.split("),\ni0")[0] + ")", OPENING, select="select symbol, date, entry_time, entry_price, initial_stop from ent"))
def o2_intraday_entries(spark, sf):
    return opening_entries(spark, sf)[1].select("symbol", "date", "entry_time", "entry_price", "initial_stop")


@query(sql(DAILY, select="select symbol, avg(close * volume) avg_value from daily where date between date '1995-01-01' and date '1996-12-31' group by 1 order by avg_value desc, symbol limit 50"))
def a3_liquid_universe(spark, sf):
    return reports.liquid_universe(daily(spark, sf), 50, "1995-01-01", "1996-12-31")


@query(sql(DAILY, select="select symbol, avg(close * volume) avg_value, count(*) n_rows from (select *, row_number() over (partition by symbol order by date desc) k from daily) where k <= 20 group by 1"))
def a4_tail_dollar_volume(spark, sf):
    return reports.tail_dollar_volume(daily(spark, sf))


@query(sql(DAILY, select="select count(*) n_rows, count(distinct symbol) n_symbols, min(date) first_date, max(date) last_date from daily"))
def a5_snapshot(spark, sf):
    return reports.snapshot(daily(spark, sf))


@query(sql(DAILY, select="select year(date) as year, count(distinct symbol) n_symbols, count(distinct date) n_dates, count(*) n_rows from daily group by 1"))
def a6_universe_by_year(spark, sf):
    return reports.universe_by_year(daily(spark, sf))


FRESH = f"case when date '{AS_OF}' - max(date) <= 7 then 'fresh' when date '{AS_OF}' - max(date) <= 30 then 'recent' when date '{AS_OF}' - max(date) <= 90 then 'stale' else 'dead' end"


@query(sql(DAILY, select=f"""select *, least(100.0, sessions * 100.0 / e) coverage, cast(greatest(e - sessions, 0) as bigint) missing from (
  select symbol, count(distinct date) sessions, min(date) first_date, max(date) last_date, {FRESH} freshness, greatest(floor((max(date) - min(date) + 1) * 5 / 7 * 0.96), 1) e from daily group by 1)""").replace("select *, least", "select symbol, sessions, first_date, last_date, freshness, least"))
def p12_p13_symbol_coverage(spark, sf):
    return reports.symbol_coverage(daily(spark, sf), AS_OF).withColumn("missing", F.col("missing").cast("long"))


@query(sql(DAILY, select=f"select freshness, count(*) n_symbols, array_to_string(list_sort(list(symbol order by symbol)[1:50]), ',') examples from (select symbol, {FRESH} freshness from daily group by 1) group by 1"))
def a7_freshness_counts(spark, sf):
    return reports.freshness_counts(daily(spark, sf), AS_OF).withColumn("examples", F.array_join("examples", ","))


@query(sql(DAILY, select="select strftime(d, '%Y-%m') as month, count(*) n_symbols from (select symbol, max(date) d from daily group by 1) group by 1 order by 1 desc limit 12"))
def a7_last_date_months(spark, sf):
    return reports.last_date_months(daily(spark, sf))


@query(sql(DAILY, FEATURES, DERIVED, select="select date, count(*) n_rows, count(*) filter (filters_passed >= 5) n_passed, count(*) filter (filters_passed >= 5) * 100.0 / count(*) pass_rate, avg(filters_passed) avg_passed from derived where date > (select max(date) from daily) - 30 group by 1"))
def a8_scan_history(spark, sf):
    return reports.scan_history(features.derived_features(rounded(feats(spark, sf))))


@query(sql(DAILY, FEATURES, select="select symbol, date, close, ret_1d from feat where date = (select max(date) from daily) and ret_1d is not null order by abs(ret_1d) desc, symbol limit 20"))
def a8_movers(spark, sf):
    return reports.movers(feats(spark, sf))


@query(sql(DAILY, select="select symbol, count(*) sessions, min(low) lowest, max(high) highest, avg(close) avg_close, cast(sum(volume) as bigint) volume, arg_min(open, date) first_open, arg_max(close, date) last_close from daily group by 1"))
def a19_market_stats(spark, sf):
    return reports.market_stats(daily(spark, sf))


@query("select l_orderkey, l_linenumber, count(*) n from lineitem group by 1, 2 having count(*) > 1")
def a18_duplicate_groups(spark, sf):
    return reports.duplicates(src.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(sql(DAILY, select=f"select symbol, date, previous, date - previous gap_days from (select symbol, date, lag(date) over {W} previous from daily) where date - previous > 30"))
def w22_gaps(spark, sf):
    return reports.gaps(daily(spark, sf), 30).withColumn("gap_days", F.col("gap_days").cast("long"))


@query(sql(DAILY, select=f"""select symbol, date, kind, ret_1d from (select *, close / nullif(lag(close) over {W}, 0) - 1 ret_1d from daily), (values ('ohlc'), ('zero_volume'), ('large_move')) k(kind)
  where (kind = 'ohlc' and (high < greatest(open, close, low) or low > least(open, close, high))) or (kind = 'zero_volume' and volume = 0) or (kind = 'large_move' and abs(ret_1d) > 0.3)"""))
def u1_w23_anomalies(spark, sf):
    return reports.anomalies(daily(spark, sf)).select("symbol", "date", "kind", "ret_1d")


@query(sql(DAILY, select="select min(date) as start from (select distinct date from daily where date < date '1998-01-01' order by date desc limit 130)"))
def t3_lookback_date(spark, sf):
    return reports.lookback_date(daily(spark, sf), "1998-01-01")


@query(sql(DAILY, select=f"select symbol, date, ret_1d from (select symbol, date, close / nullif(lag(close) over {W}, 0) - 1 ret_1d from daily) where abs(ret_1d) > 0.2 order by abs(ret_1d) desc, symbol, date limit 500"))
def t2_largest_moves(spark, sf):
    return reports.moves(daily(spark, sf))


@query(sql(DAILY, BARS, select="""select issue_code, count(*) n from (
  select symbol, date, case when k = 1 and ((high < low) or close > high or close < low or open > high or open < low) then 'OHLC_VIOLATION' when k = 2 and not (hour(candle_time) * 60 + minute(candle_time) between 555 and 930) then 'TIMESTAMP_INVALID'
    when k = 3 and (high - low) / nullif(open, 0) > 0.5 then 'EXTREME_CANDLE' when k = 4 and (open <= 0 or high <= 0 or low <= 0 or close <= 0) then 'ZERO_PRICE' end issue_code from bars, (values (1), (2), (3), (4)) v(k)) where issue_code is not null group by 1"""))
def q1_q5_row_rules(spark, sf):
    return quality.flagged(intraday(spark, sf), quality.intraday_rules()).groupBy("issue_code").agg(F.count("*").alias("n"))


@query(sql(DAILY, select=f"""select issue_code, symbol, count(*) n_rows, min(date) first_date, max(date) last_date from (
  select symbol, date, 'DATE_GAP' issue_code from (select symbol, date, lag(date) over {W} p from daily) where date - p > 7
  union all select symbol, date, 'EXTREME_MOVE' from (select symbol, date, close / nullif(lag(close) over {W}, 0) - 1 r from daily) where abs(r) > 0.3
  union all select symbol, max(date), 'SHORT_HISTORY' from daily group by 1 having count(distinct date) < 252) group by 1, 2"""))
def q7_q9_q11_series_rules(spark, sf):
    d = daily(spark, sf)
    return quality.by_symbol(quality.date_gaps(d).union(quality.extreme_moves(d)).union(quality.short_history(d)))


@query(sql(BARS, BARS_DAILY, select="select symbol, date from bdaily where not exists (select 1 from bars b where b.symbol = bdaily.symbol and b.date = bdaily.date and hour(candle_time) < 1)"))
def q10_missing_coverage(spark, sf):
    b = intraday(spark, sf)
    return quality.missing_intraday(src.intraday_to_daily(b), b.where(F.hour("candle_time") < 1)).select("symbol", "date")


@query(sql(DAILY, select="""select count(*) n_rows, count(distinct symbol) n_symbols, count(distinct date) n_days, min(date) first_date, max(date) last_date, count(*) filter (high < low or close > high or close < low or open > high or open < low) bad_ranges,
  cast(count(distinct date) as double) / len(list_filter(generate_series(min(date), max(date), interval 1 day), lambda d: isodow(d) < 6)) coverage from daily"""))
def q15_dataset_report(spark, sf):
    return quality.dataset_report(daily(spark, sf)).select("n_rows", "n_symbols", "n_days", "first_date", "last_date", "bad_ranges", "coverage")


@query(sql(DAILY, select="select cast(s_suppkey as varchar) symbol from supplier where cast(s_suppkey as varchar) not in (select symbol from daily where date < date '1992-06-01')"))
def j5_missing_symbols(spark, sf):
    universe = src.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol"))
    return reconcile.missing_symbols(universe, daily(spark, sf).where("date < date'1992-06-01'"))


@query(sql(BARS, BARS_DAILY, INTRADAY.split("),\ni0")[0] + ")", select="select b.symbol, b.candle_time, p.prior_day_high, p.prior_day_low, p.prior_day_close from bars b left join prior p using (symbol, date)"))
def j2_previous_session(spark, sf):
    b = intraday(spark, sf)
    return features.previous_session(b, src.intraday_to_daily(b)).select("symbol", "candle_time", "prior_day_high", "prior_day_low", "prior_day_close")


@query(sql(DAILY, select="select symbol, max(date) date, arg_max(close, date) as close from daily where date < date '1996-01-01' group by 1"))
def j15_latest_before(spark, sf):
    return reconcile.latest_before(daily(spark, sf), "1996-01-01")






@query(sql(DAILY, select="select symbol, min(date) first, max(date) last from daily group by 1"))
def s10_coverage(spark, sf):
    return src.coverage(daily(spark, sf))


@query(sql(DAILY, select="select symbol, date, close from daily where symbol not in (select symbol from daily where date < date '1992-02-01') union all select symbol, date, close * 2 from daily where symbol in (select symbol from daily where date < date '1992-02-01')"))
def u5_replace_symbols(spark, sf):
    d = daily(spark, sf).select("symbol", "date", "close")
    early = d.where("date < date'1992-02-01'").select("symbol").distinct()
    return incremental.replace_symbols(d, d.join(early, "symbol", "left_semi").withColumn("close", F.col("close") * 2))


