"""The DuckDB side of the registered queries: bars, features and candidates as common table expressions."""

from __future__ import annotations

import re

DAILY = """daily as (
  select cast(l_suppkey as varchar) symbol, cast(l_shipdate as date) date, arg_min(px, o) open, max(px) high, min(px) low, arg_max(px, o) as close, cast(sum(l_quantity) as bigint) volume
  from (select *, floor(l_extendedprice / l_quantity) * 1.0 px, row(l_orderkey, l_linenumber, l_partkey) o from lineitem) group by 1, 2)"""

BARS = """bars as (
  select event_type symbol, cast(time_bucket(interval 5 minutes, ts) as date) date, time_bucket(interval 5 minutes, ts) candle_time, arg_min(value, event_id) open, max(value) high, min(value) low, arg_max(value, event_id) as close, cast(count(*) as bigint) volume
  from events group by 1, 2, 3)"""

BARS_DAILY = """bdaily as (
  select symbol, date, arg_min(open, candle_time) open, max(high) high, min(low) low, arg_max(close, candle_time) as close, cast(sum(volume) as bigint) volume from bars group by 1, 2)"""


def back(n: int, skip: int = 0) -> str:
    return f"(partition by symbol order by date rows between {n - 1} preceding and {f'{skip} preceding' if skip else 'current row'})"


W = "(partition by symbol order by date)"


def features(source: str = "daily") -> str:
    lags = ", ".join(f"lag(close, {n}) over {W} c{n}" for n in (1, 2, 5, 10, 20, 50, 63, 65, 200, 252))
    rets = ", ".join(f"close / nullif(c{n}, 0) - 1 ret_{n}d" for n in (1, 2, 5, 10, 20, 63, 252))
    return f"""f0 as (select *, {lags} from {source}),
f1 as (
  select *, {rets}, high - low true_range, (high - low) / nullif(close, 0) range_pct, (close - low) / nullif(high - low, 0) close_pos_in_range,
    (open - c1) / nullif(c1, 0) gap_open_vs_prev_close, (high - c1) / nullif(c1, 0) gap_high_vs_prev_close, (low - c1) / nullif(c1, 0) gap_low_vs_prev_close,
    case when high > low then abs(close - open) / (high - low) end body_ratio, case when high > low then (high - greatest(open, close)) / (high - low) end upper_wick_ratio,
    case when high > low then (least(open, close) - low) / (high - low) end lower_wick_ratio, greatest(high - low, abs(high - c1), abs(low - c1)) true_range3,
    c20 ma_20, c50 ma_50, c65 ma_65, c200 ma_200, close * volume dollar_vol, row_number() over {W} rn
  from f0),
f2 as (
  select *, avg(true_range) over {back(14)} atr_14, avg(true_range) over {back(20)} atr_20, avg(close) over {back(7)} ma_7, avg(close) over {back(65)} ma_65_sma,
    avg(volume) over {back(20)} vol_20, avg(dollar_vol) over {back(20)} dollar_vol_20, ret_252d rs_252,
    (close - min(close) over {back(63)}) / nullif(max(close) over {back(63)} - min(close) over {back(63)}, 0) range_percentile_63,
    (close - min(close) over {back(252)}) / nullif(max(close) over {back(252)} - min(close) over {back(252)}, 0) range_percentile_252,
    cast(sum(case when ret_1d >= 0.04 then 1 else 0 end) over {back(30, 1)} as bigint) breakout_4pct_up_30d, cast(sum(case when ret_1d >= 0.04 then 1 else 0 end) over {back(90, 1)} as bigint) breakout_4pct_up_90d,
    cast(sum(case when ret_1d <= -0.04 then 1 else 0 end) over {back(90, 1)} as bigint) breakdown_4pct_down_90d, round(regr_r2(close, rn) over {back(65)}, 6) r2_65
  from f1),
feat as (select *, round(atr_20 / nullif(avg(atr_20) over {back(50, 1)}, 0), 6) atr_compress_ratio, volume / nullif(vol_20, 0) vol_dryup_ratio from f2)"""


FEATURE_COLUMNS = [
    "ret_1d", "ret_2d", "ret_5d", "ret_10d", "ret_20d", "ret_63d", "ret_252d", "atr_14", "atr_20", "range_pct", "close_pos_in_range", "gap_open_vs_prev_close", "gap_high_vs_prev_close",
    "gap_low_vs_prev_close", "body_ratio", "upper_wick_ratio", "lower_wick_ratio", "ma_7", "ma_20", "ma_50", "ma_65", "ma_65_sma", "ma_200", "rs_252", "vol_20", "dollar_vol_20", "range_percentile_63",
    "range_percentile_252", "breakout_4pct_up_30d", "breakout_4pct_up_90d", "breakdown_4pct_down_90d", "r2_65", "atr_compress_ratio", "vol_dryup_ratio", "true_range3",
]

DERIVED = f"""d0 as (
  select *, range_percentile_252 range_percentile, breakout_4pct_up_30d prior_breakouts_30d, breakout_4pct_up_90d prior_breakouts_90d, breakdown_4pct_down_90d prior_breakdowns_90d,
    lag(close) over {W} prev_close, lag(open) over {W} prev_open, lag(high - low) over {W} prev_range,
    (lag(close, 1) over {W} - lag(close, 2) over {W}) / nullif(lag(close, 2) over {W}, 0) ret_1d_lag1, (lag(close, 2) over {W} - lag(close, 3) over {W}) / nullif(lag(close, 3) over {W}, 0) ret_1d_lag2
  from feat),
d1 as (
  select *, close_pos_in_range >= 0.7 filter_h, prev_range < atr_20 * 0.5 or prev_close < prev_open filter_n, coalesce(prior_breakouts_30d, 0) <= 2 filter_y, vol_dryup_ratio < 1.3 filter_c,
    cast(close > ma_20 as int) + cast(ret_5d > 0 as int) + cast(coalesce(nullif(r2_65, 0), 0) >= 0.7 as int) >= 2 filter_l, ret_1d_lag1 <= 0 or ret_1d_lag2 <= 0 filter_2
  from d0),
derived as (select *, cast(filter_h as int) + cast(filter_n as int) + cast(filter_y as int) + cast(filter_c as int) + cast(filter_l as int) + cast(filter_2 as int) filters_passed from d1)"""

DAY = "partition by symbol, date"
RUN = f"({DAY} order by candle_time rows between unbounded preceding and current row)"
INTRADAY = f"""prior as (select symbol, lead(date) over {W} date, high prior_day_high, low prior_day_low, close prior_day_close from bdaily),
i0 as (
  select b.*, p.prior_day_high, p.prior_day_low, p.prior_day_close, row_number() over ({DAY} order by candle_time) rn_5min, count(*) over ({DAY}) candles_per_day
  from bars b left join prior p using (symbol, date)),
intraday as (
  select *, {", ".join(f"max(case when rn_5min <= {n} then high end) over {RUN} or_{m}min_high, min(case when rn_5min <= {n} then low end) over {RUN} or_{m}min_low" for m, n in ((15, 3), (30, 6), (60, 12)))},
    max(case when rn_5min <= 12 then high end) over ({DAY}) first_hour_high, min(case when rn_5min <= 12 then low end) over ({DAY}) first_hour_low, avg(case when rn_5min <= 12 then volume end) over ({DAY}) first_hour_avg_vol,
    case when high > prior_day_high then min(case when high > prior_day_high then candle_time end) over {RUN} end first_breakout_time,
    case when low < prior_day_low then min(case when low < prior_day_low then candle_time end) over {RUN} end first_breakdown_time,
    (open - prior_day_close) / nullif(prior_day_close, 0) gap_open_pct, cast(sum(volume) over {RUN} as double) / nullif(cast(sum(volume) over ({DAY}) as double), 0) volume_percentile,
    case when rn_5min <= 6 then 'first_30min' when rn_5min <= 12 then 'first_60min' when rn_5min <= 18 then 'first_90min' else 'after_90min' end entry_window
  from i0)"""
INTRADAY_COLUMNS = [
    "rn_5min", "candles_per_day", "or_15min_high", "or_15min_low", "or_30min_high", "or_30min_low", "or_60min_high", "or_60min_low", "first_hour_high", "first_hour_low", "first_hour_avg_vol",
    "first_breakout_time", "first_breakdown_time", "gap_open_pct", "volume_percentile", "entry_window",
]


def breadth(min_price: float, min_value: float) -> str:
    counts = {
        "up_4pct_count": "ret_1d >= 0.04", "down_4pct_count": "ret_1d <= -0.04", "above_ma20_count": "close > ma_20", "below_ma20_count": "close <= ma_20", "above_ma40_count": "close > ma_40", "below_ma40_count": "close <= ma_40",
        "up_25q_count": "close >= 1.25 * low_65", "down_25q_count": "close <= 0.75 * high_65", "up_25m_count": "close >= 1.25 * low_20", "down_25m_count": "close <= 0.75 * high_20", "up_50m_count": "close >= 1.5 * low_20",
        "down_50m_count": "close <= 0.5 * high_20", "up_13_34_count": "close >= 1.13 * low_34", "down_13_34_count": "close <= 0.87 * high_34",
    }
    ends = ", ".join(f"min(close) over {back(n)} low_{n}, max(close) over {back(n)} high_{n}" for n in (20, 34, 65))
    return f"""e0 as (select *, avg(close) over {back(40)} ma_40, count(close) over {back(40)} n_40, {ends} from feat),
e1 as (select * from e0 where close >= {min_price} and dollar_vol_20 >= {min_value} and n_40 = 40 and ma_20 is not null and atr_20 is not null),
b0 as (select e0.date, count(e1.symbol) universe_size, {", ".join(f"count(*) filter (e1.symbol is not null and {c.replace('close', 'e1.close').replace('ret_1d', 'e1.ret_1d').replace('ma_', 'e1.ma_').replace('low_', 'e1.low_').replace('high_', 'e1.high_')}) {n}" for n, c in counts.items())}
  from e0 left join e1 using (symbol, date) group by 1),
b1 as (select *, {", ".join(f"cast(sum(up_4pct_count) over (order by date rows {n - 1} preceding) as double) / nullif(sum(down_4pct_count) over (order by date rows {n - 1} preceding), 0) ratio_{n}d" for n in (5, 10))},
  {", ".join(f"{n} * 100.0 / nullif(universe_size, 0) {n.replace('_count', '_pct')}" for n in counts if not any(x in n for x in ('25m', '50m', '13_34')))} from b0),
b2 as (select *, up_25q_count > down_25q_count * 1.1 bull, down_25q_count > up_25q_count * 1.1 bear from b1),
b3 as (select *, bull and ratio_10d >= 2 strong, bear and ratio_10d <= 0.5 weak, bull and ratio_10d < 2 correcting, bear and ratio_10d > 0.5 rebounding from b2),
breadth as (select *, case when bull then 'bullish' when bear then 'bearish' else 'transition' end primary_regime,
  case when strong then 'long_favored' when weak then 'short_favored' when rebounding then 'rebound_watch' when correcting then 'correction_watch' else 'mixed' end tactical_regime,
  case when strong then 2.0 when weak then -2.0 when bull then 1.0 when bear then -1.0 else 0.0 end aggression_score, case when strong or weak then 'aggressive' when bull or bear then 'standard' else 'defensive' end posture_label,
  case when strong then 'bullish_thrust,long_favored' when weak then 'bearish_thrust,short_favored' when correcting then 'bullish_regime,correction_watch' when rebounding then 'bearish_regime,rebound_watch' else 'mixed' end alert_flags
  from b3)"""


def lagged(source: str = "daily") -> str:
    prev = ", ".join(f"lag({c}) over {W} prev_{c}" for c in ("open", "high", "low", "close", "volume"))
    return f"""l0 as (select *, lag(date) over {W} watch_date, {prev}, row_number() over {W} rn,
    (lag(close, 2) over {W} - lag(close, 3) over {W}) / nullif(lag(close, 3) over {W}, 0) w1, (lag(close, 3) over {W} - lag(close, 4) over {W}) / nullif(lag(close, 4) over {W}, 0) w2 from {source}),
lagged as (select *, (open - prev_close) / nullif(prev_close, 0) gap_pct, prev_close * prev_volume watch_value from l0),
compat as (select *, range_percentile_252 range_percentile, breakout_4pct_up_30d prior_breakouts_30d, breakout_4pct_up_90d prior_breakouts_90d, breakdown_4pct_down_90d prior_breakdowns_90d from feat)"""


def threshold_candidates(short: bool, t: float = 0.04, price: float = 10, value: float = 30_000, volume: int = 20, strict: bool = False, narrow: bool = False, prior: int = -1) -> str:
    crossed = f"l.low <= l.prev_close * (1 - {t})" if short else f"l.high >= l.prev_close * (1 + {t})"
    h = "<= 0.3" if short else ">= 0.7"
    trend = "cast(l.close < f.ma_20 as int) + cast(f.ret_5d < 0 as int)" if short else "cast(l.close > f.ma_20 as int) + cast(f.ret_5d > 0 as int)"
    trend += " + cast(coalesce(nullif(f.r2_65, 0), 0) >= 0.7 as int)" + (" + cast(l.close < f.ma_65_sma as int) >= 3" if strict else " >= 2")
    quiet = "(l.prev_high - l.prev_low) < f.atr_20 * 0.5" + ("" if narrow else f" or l.prev_close {'>' if short else '<'} l.prev_open")
    two = "w1 >= 0 or w2 >= 0" if short else "w1 <= 0"
    fresh = "coalesce(f.prior_breakouts_30d, 0) <= 2" + (" and coalesce(f.rs_252 <= 0, false)" if short else "") + (f" and coalesce(f.prior_breakdowns_90d, 0) <= {prior}" if prior >= 0 else "")
    # the watch day is the session before, so its features are those of the next session's row
    return f"""watch as (select * replace (lead(date) over {W} as date) from compat),
cand0 as (
  select symbol, date, l.watch_date, l.open, l.high, l.low, l.close, l.volume, l.prev_open, l.prev_high, l.prev_low, l.prev_close, l.gap_pct, l.watch_value value_traded, f.close_pos_in_range, f.atr_20, f.vol_dryup_ratio, f.atr_compress_ratio,
    f.range_percentile, f.prior_breakouts_30d, f.prior_breakdowns_90d, f.r2_65, f.rs_252, '{"SHORT" if short else "LONG"}' direction, s.close_pos_in_range {h} filter_h, {quiet} filter_n,
    {fresh} filter_y, f.vol_dryup_ratio < 1.3 filter_c, {trend} filter_l, {two} filter_2
  from lagged l left join watch f using (symbol, date) left join compat s using (symbol, date)
  where {crossed} and l.watch_date is not null and l.prev_close >= {price} and l.watch_value >= {value} and l.prev_volume >= {volume} and w1 is not null and f.close_pos_in_range is not null),
cand as (select *, {" + ".join(f"cast(coalesce(filter_{x}, false) as int)" for x in "hnycl2")} filters_passed from cand0)"""


BREAKOUT_RANK = """c2 as (select *, cast(coalesce(vol_dryup_ratio, 99) <= 1.0 as int) + cast(coalesce(atr_compress_ratio, 99) <= 1.10 as int) + cast(coalesce(range_percentile, 99) <= 0.60 as int) q,
    case when coalesce(prior_breakouts_30d, 0) <= 0 then 3 when prior_breakouts_30d = 1 then 2 when prior_breakouts_30d = 2 then 1 else 0 end y,
    case when prev_close < prev_open then 2 when (prev_high - prev_low) < atr_20 * 0.5 then 1 else 0 end n, floor(least(greatest(coalesce(r2_65, 0), 0), 1) * 100 + 0.5) r from cand where filters_passed >= 3),
c3 as (select *, cast(q * 10000 + y * 1000 + r * 5 + n as double) selection_score from c2),
ranked as (select *, row_number() over (partition by date order by selection_score desc, value_traded desc, symbol) selection_rank from c3)"""
BREAKDOWN_RANK = """c3 as (select *, least(greatest(coalesce(r2_65, 0), 0), 1) * 5000 + (0.30 - least(greatest(coalesce(close_pos_in_range, 0.30), 0), 0.30)) / 0.30 * 2000 + (1.3 - least(greatest(coalesce(vol_dryup_ratio, 1.3), 0), 1.3)) / 1.3 * 1000
    + case coalesce(prior_breakdowns_90d, 0) when 0 then 300 when 1 then 200 when 2 then 100 else 0 end + abs(least(greatest(coalesce(rs_252, 0), -0.40), 0)) / 0.40 * 200 selection_score from cand where filters_passed >= 3),
ranked as (select *, row_number() over (partition by date order by selection_score desc, value_traded desc, symbol) selection_rank from c3)"""

#: Entries from daily bars, exits over five days, and economics of the ranked candidates.
def order_cost(price: str, selling: str) -> str:
    """Charges of an order by the fee schedule of expressions.Costs."""
    v = f"({price} * qty)"
    return cents(f"20 + {v} * (0.0000345 + 0.000001) + (20 + {v} * 0.0000345) * 0.18 + case when {selling} then {v} * 0.00025 else {v} * 0.00003 end")


def cents(x: str) -> str:
    """Half to even by the decimal digits that a number is written with, which both engines do not do for doubles."""
    return f"cast(round_even(cast(cast({x} as varchar) as decimal(38, 18)), 2) as double)"


def trade_tables(short: bool = False, t: float = 0.04, budget: int = 30) -> str:
    """Mirrored prices serve the short side, as in outcomes."""
    sign, most = ("-1.0", "low") if short else ("1.0", "high")
    least = "high" if short else "low"
    trigger = f"prev_close * {1 - t if short else 1 + t}"
    entry = f"least(open, {trigger})" if short else f"greatest(open, {trigger})"
    stop = "case when high > entry_price then high else entry_price * 1.04 end" if short else "case when low < entry_price then low else entry_price * 0.96 end"
    kept = f"where selection_rank <= {budget}" if budget else ""
    return f"""entry0 as (select *, {trigger} trigger_price, {entry} entry_price from ranked {kept}),
entries as (select *, {stop} initial_stop from entry0),
num as (select symbol, date, open, high, low, close, row_number() over {W} bar_no from daily),
h0 as (
  select e.symbol, e.date, e.entry_price * {sign} entry, e.initial_stop * {sign} stop0, b.bar_no - a.bar_no as day, b.date bar_date, b.open * {sign} as open, b.{most} * {sign} high, b.{least} * {sign} low, b.close * {sign} as close
  from entries e join num a using (symbol, date) join num b on b.symbol = a.symbol and b.bar_no between a.bar_no + 1 and a.bar_no + 5),
h1 as (select *, greatest(entry, max(high) over (partition by symbol, date order by day)) top from h0),
h2 as (select *, top >= entry + abs(entry) * 0.08 trail_on, close > entry even, case when day >= 3 then low end tight,
    greatest(case when close > entry then entry end, case when top >= entry + abs(entry) * 0.08 then greatest(entry, top - abs(top) * 0.02) end) push from h1),
h3 as (select *, greatest(stop0, max(greatest(push, tight)) over (partition by symbol, date order by day)) stop_after from h2),
h4 as (select *, coalesce(lag(stop_after) over (partition by symbol, date order by day), stop0) stop_before from h3),
h5 as (select *, bool_or(even) over (partition by symbol, date order by day) even_now, bool_or(trail_on) over (partition by symbol, date order by day) trail_now,
    bool_or(coalesce(tight > greatest(stop_before, push), false)) over (partition by symbol, date order by day) tight_now from h4),
h6 as (select *, coalesce(lag(even_now) over (partition by symbol, date order by day), false) even_was, coalesce(lag(trail_now) over (partition by symbol, date order by day), false) trail_was,
    coalesce(lag(tight_now) over (partition by symbol, date order by day), false) tight_was, max(day) over (partition by symbol, date) last_day from h5),
h7 as (select *, case when open >= entry + abs(entry) * 0.2 then 'ABNORMAL_GAP_EXIT' when open < stop_before then 'GAP_STOP'
    when low <= stop_before then case when trail_was and stop_before > entry then 'STOP_TRAIL' when tight_was and day >= 3 then 'STOP_POST_DAY3' when not even_was then 'STOP_INITIAL' when stop_before = entry then 'STOP_BREAKEVEN' else 'STOP_TRAIL' end
    when day <= 2 and high >= entry + abs(entry) * 0.1 then 'ABNORMAL_PROFIT'
    when close <= stop_after then case when trail_now and stop_after > entry then 'STOP_TRAIL' when tight_now and day >= 3 then 'STOP_POST_DAY3' when not even_now then 'STOP_INITIAL' when stop_after > entry then 'STOP_TRAIL' else 'STOP_BREAKEVEN' end
    when day = last_day then 'TIME_EXIT' end reason,
    case when open >= entry + abs(entry) * 0.2 or open < stop_before then open when low <= stop_before then stop_before when day <= 2 and high >= entry + abs(entry) * 0.1 then close when close <= stop_after then stop_after else close end price from h6),
exits as (select symbol, date, arg_min(bar_date, day) exit_date, arg_min(price, day) exit_price, arg_min(reason, day) exit_reason, min(day) holding_days from h7 where reason is not null group by 1, 2),
t0 as (select e.*, x.exit_date, x.exit_price * {sign} exit_price, x.exit_reason, x.holding_days, floor(100000.0 / entry_price) qty, x.exit_price * {sign} / entry_price > 2.5 or x.exit_price * {sign} / entry_price < 0.625 bad from entries e join exits x using (symbol, date)),
t1 as (select *, case when bad then 0 else (exit_price - entry_price) * {sign} * qty end gross_pnl, case when bad then 0 else {cents(order_cost('entry_price', 'true' if short else 'false') + ' + ' + order_cost('exit_price', 'false' if short else 'true'))} end as cost,
    case when bad then 0 else (exit_price - entry_price) * {sign} / entry_price * 100 end pnl_pct, case when bad then 0 else (exit_price - entry_price) * {sign} / nullif(abs(entry_price - initial_stop), 0) end pnl_r, case when bad then 'DATA_INVALIDATION' else exit_reason end final_reason, year(date) as year from t0),
trades as (select *, gross_pnl - cost net_pnl from t1)"""


TRADES = trade_tables()


def sql(*parts: str, select: str) -> str:
    """A query over common table expressions, each computed once."""
    return re.sub(r"\bas \((\s*select\b)", r"as materialized (\1", "with " + ",\n".join(parts)) + "\n" + select
