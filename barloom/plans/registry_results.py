"""Registered queries over trades, scans, gates, refreshes and ticks: each calls its operator and has its DuckDB SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..operators import candidates, features, outcomes, quality, reconcile, reports
from ..operators.candidates import FLAGS, Params
from ..sources import bars as src
from ..streaming import ticks
from . import incremental, oracle, research
from .oracle import BARS, BARS_DAILY, BREAKDOWN_RANK, BREAKOUT_RANK, DAILY, INTRADAY, W, sql, trade_tables
from .registry import BREADTH, FEATURES, LIMITS, OPENING, TRADE_ROWS, TRADE_SQL, daily, feats, intraday, opening_entries, query, rounded, trade_rows, trades

PRIOR = INTRADAY.split("),\ni0")[0] + ")"
CANDIDATES = (DAILY, FEATURES, oracle.lagged())


def number(columns: dict[str, int]) -> list:
    """Columns rounded to so many places: sums in another order differ in the last bits."""
    return [ex.places(F.col(c), n).alias(c) for c, n in columns.items()]


# Trades and their reports

SHORT_SQL = (*CANDIDATES, oracle.threshold_candidates(True), BREAKDOWN_RANK, trade_tables(True, budget=5))


@query(sql(*SHORT_SQL, select=TRADE_ROWS))
def o4_o7_short_trades(spark, sf):
    p = Params("breakdown", min_filters=3, budget=5, **LIMITS)
    return trade_rows(research.backtest(None, rounded(feats(spark, sf)), p))


REPORT = {"win_rate": 6, "net_pnl": 2, "avg_pct": 4, "avg_r": 4, "avg_days": 6, "cost": 2, "profit_factor": 6}
REPORT_SQL = """count(*) trades, count(*) filter (net_pnl > 0) wins, count(*) filter (not net_pnl > 0) losses, round(count(*) filter (net_pnl > 0) * 100.0 / count(*), 6) win_rate, round(sum(net_pnl), 2) net_pnl, round(avg(pnl_pct), 4) avg_pct, round(avg(pnl_r), 4) avg_r,
  round(avg(holding_days), 6) avg_days, round(sum(cost), 2) as cost, round(sum(case when net_pnl > 0 then net_pnl else 0 end) / nullif(abs(sum(case when net_pnl < 0 then net_pnl else 0 end)), 0), 6) profit_factor"""


def report_sql(keys: str, tables: tuple = TRADE_SQL) -> str:
    return sql(*tables, select=f"select {keys}, {REPORT_SQL} from trades group by all")


def report(df: DataFrame, *keys: str) -> DataFrame:
    return reports.trade_report(df, *keys).select(*keys, "trades", "wins", "losses", *number(REPORT))


@query(report_sql("final_reason exit_reason"))
def a9_exit_reasons(spark, sf):
    return report(trades(spark, sf), "exit_reason")


@query(report_sql("symbol"))
def a9_by_symbol(spark, sf):
    return report(trades(spark, sf), "symbol")


@query(report_sql("year, strftime(date, '%Y-%m') as month"))
def a9_by_month(spark, sf):
    return report(trades(spark, sf).withColumn("month", F.date_format("date", "yyyy-MM")), "year", "month")


@query(report_sql("final_reason exit_reason, holding_days"))
def a16_rollup_by_reason_and_days(spark, sf):
    return report(trades(spark, sf).withColumn("holding_days", F.col("holding_days").cast("long")), "exit_reason", "holding_days")


@query(report_sql("year"))
def a22_profit_factor(spark, sf):
    return report(trades(spark, sf), "year")


@query(sql(*TRADE_SQL, select=f"""select * from (select year, {REPORT_SQL} from trades group by 1) join
  (select year, string_agg(final_reason || ':' || n, ',' order by final_reason) exit_reasons from (select year, final_reason, count(*) n from trades group by all) group by 1) using (year)"""))
def a10_yearly_metrics(spark, sf):
    named = F.array_join(F.transform(F.map_entries("exit_reasons"), lambda x: F.concat_ws(":", x["key"], x["value"])), ",")
    return reports.yearly_metrics(trades(spark, sf)).select("year", "trades", "wins", "losses", *number(REPORT), named.alias("exit_reasons"))


SUMMARY = {"total_pct": 4, "win_rate": 6, "profit_factor": 6, "avg_r": 4, "median_r": 6, "max_drawdown": 4, "worst_year": 4, "annual_pct": 4, "calmar": 4, "calmar_inf": 4, "cagr": 4}


def summary_tables(key: str = "'breakout'") -> str:
    return f"""keyed as (select {key} exp_id, * from trades),
s0 as (select exp_id, count(*) trades, sum(pnl_pct) total_pct, count(*) filter (net_pnl > 0) * 100.0 / count(*) win_rate, sum(case when net_pnl > 0 then net_pnl else 0 end) / nullif(abs(sum(case when net_pnl < 0 then net_pnl else 0 end)), 0) profit_factor,
    avg(pnl_r) avg_r, median(pnl_r) median_r, count(distinct symbol) n_symbols, greatest((max(date) - min(date)) / 365.25, 1 / 365.25) span from keyed group by 1),
c0 as (select exp_id, date, sum(pnl_pct) p from keyed group by 1, 2),
c1 as (select *, sum(p) over (partition by exp_id order by date) s from c0),
c2d as (select *, greatest(0.0, max(s) over (partition by exp_id order by date)) - s d from c1),
s1 as (select s0.*, max_drawdown, worst_year, total_pct / span annual_pct from s0 join (select exp_id, max(d) max_drawdown from c2d group by 1) using (exp_id)
  join (select exp_id, min(p) worst_year from (select exp_id, year, sum(pnl_pct) p from keyed group by 1, 2) group by 1) using (exp_id)),
summary as (select * exclude (span), coalesce(case when max_drawdown > 0 then annual_pct / max_drawdown end, 0) calmar, coalesce(case when max_drawdown > 0 then annual_pct / max_drawdown end, 'infinity'::double) calmar_inf,
    (pow(greatest(1 + total_pct / 100, 0), 1 / span) - 1) * 100 cagr from s1)"""


SUMMARY_ROWS = "select exp_id, trades, n_symbols, " + ", ".join(f"round({c}, {n}) {c}" for c, n in SUMMARY.items()) + " from summary"


@query(sql(*TRADE_SQL, summary_tables(), select=SUMMARY_ROWS))
def a11_experiment_summary(spark, sf):
    return reports.experiment_summary(trades(spark, sf)).select("exp_id", "trades", "n_symbols", *number(SUMMARY))


def by_year(spark, sf) -> DataFrame:
    return reports.experiment_summary(trades(spark, sf).withColumn("exp_id", F.concat(F.lit("year-"), F.col("year"))))


@query(sql(*TRADE_SQL, summary_tables("'year-' || year"), select=SUMMARY_ROWS + " order by summary.calmar desc nulls last, exp_id limit 5"))
def t6_rank_experiments(spark, sf):
    return reports.rank_experiments(by_year(spark, sf), "calmar", 5).select("exp_id", "trades", "n_symbols", *number(SUMMARY))


@query(sql(*TRADE_SQL, "d as (select exit_date, sum(net_pnl) net_pnl, count(*) trades from trades group by 1)", "e as (select *, 1000000.0 + sum(net_pnl) over (order by exit_date) equity from d)", "k as (select *, greatest(1000000.0, max(equity) over (order by exit_date)) peak from e)",
  select="select 'breakout' exp_id, exit_date, trades, round(net_pnl, 2) net_pnl, round(equity, 2) equity, round(peak, 2) peak, round((peak - equity) / peak, 6) drawdown from k"))
def w21_equity_curve(spark, sf):
    return reports.equity_curve(trades(spark, sf), keys=("exp_id",)).select("exp_id", "exit_date", "trades", *number({"net_pnl": 2, "equity": 2, "peak": 2, "drawdown": 6}))


@query(sql(*TRADE_SQL, select="select strftime(date, '%Y-%m') as month, " + ", ".join(f'nullif(count(*) filter (isodow(date) = {d}), 0) "{d}"' for d in range(1, 8)) + " from trades group by 1"))
def a9_month_by_weekday(spark, sf):
    return reports.month_by_day(trades(spark, sf))


@query(sql(*TRADE_SQL, select="select flag, count(*) filter (holds) n_pass, count(*) filter (not holds) n_fail, round(avg(pnl_r) filter (holds), 4) r_pass, round(avg(pnl_r) filter (not holds), 4) r_fail from ("
  + " union all ".join(f"select '{f}' flag, coalesce({f}, false) holds, pnl_r from trades" for f in FLAGS) + ") group by 1"))
def a17_filter_effects(spark, sf):
    return reports.filter_effects(trades(spark, sf), FLAGS).select("flag", "n_pass", "n_fail", *number({"r_pass": 4, "r_fail": 4}))


@query(sql(*TRADE_SQL, select="select kind parity, count(*) n from (select case when year >= 1998 then 'left_only' when cast(symbol as int) % 2 = 0 then 'error' else 'equal' end kind from trades) group by 1"))
def j10_parity(spark, sf):
    t = trades(spark, sf)
    other = t.where("year < 1998").withColumn("entry_price", F.when(F.col("symbol").cast("int") % 2 == 0, F.col("entry_price") * 1.02).otherwise(F.col("entry_price")))
    return reconcile.parity(t, other, ["symbol", "date"]).groupBy("parity").agg(F.count("*").alias("n"))


THRESHOLDS = [("breakout", "trades", 100.0, 10.0, True), ("breakout", "max_drawdown", 20.0, 50.0, False), ("breakout", "win_rate", 40.0, 20.0, True)]


@query(sql(*TRADE_SQL, summary_tables(), "rules(metric, warn, fail, up) as (values " + ", ".join(f"('{m}', {w}, {f}, {str(u).lower()})" for _, m, w, f, u in THRESHOLDS) + ")",
  "long as (select 'trades' metric, cast(trades as double) v from summary union all select 'max_drawdown', max_drawdown from summary union all select 'win_rate', win_rate from summary)",
  select="select metric, round(v, 4) as value, case when case when up then v < fail else v > fail end then 'ERROR' when case when up then v < warn else v > warn end then 'WARNING' else 'OK' end severity from long join rules using (metric)"))
def q18_result_gates(spark, sf):
    s = reports.experiment_summary(trades(spark, sf)).withColumn("strategy", F.lit("breakout"))
    rules = spark.createDataFrame(THRESHOLDS, "strategy string, metric string, warn double, fail double, higher_is_better boolean")
    return quality.result_gates(s, rules).select("metric", F.round("value", 4).alias("value"), "severity")


@query(sql(*TRADE_SQL, "b as (select final_reason metric, avg(pnl_r) base from trades where year < 1996 group by 1)", "n as (select final_reason metric, avg(pnl_r) now from trades where year >= 1996 group by 1)",
  select="select metric, round(base, 4) base, round(now, 4) as now, case when base is null or now is null or (now - base) / nullif(abs(base), 0) <= -0.25 then 'ERROR' when (now - base) / nullif(abs(base), 0) <= -0.10 then 'WARNING' else 'OK' end severity from b full join n using (metric)"))
def q19_regressions(spark, sf):
    t = trades(spark, sf)
    side = lambda rows: rows.groupBy(F.lit("breakout").alias("strategy"), F.col("exit_reason").alias("metric")).agg(F.avg("pnl_r").alias("value"))
    return quality.regressions(side(t.where("year < 1996")), side(t.where("year >= 1996"))).select("metric", F.round("base", 4).alias("base"), F.round("now", 4).alias("now"), "severity")


# Sweeps and folds

AXES = {"threshold": [0.04, 0.06], "min_filters": [3, 4], "budget": [0, 10]}


def sweep_sql() -> str:
    """Trades of every set of AXES, each threshold's from a query of its own."""
    every = BREAKOUT_RANK.replace("row_number() over (partition by date order by selection_score desc, value_traded desc, symbol) selection_rank", "1 selection_rank")
    parts = []
    for t in AXES["threshold"]:
        inner = sql(*CANDIDATES, oracle.threshold_candidates(False, t=0.04), every.replace("from c3)", f"from c3 where high >= prev_close * (1 + {t}))"), trade_tables(t=t, budget=0), select=f"select *, {t} threshold from trades")
        parts.append(f"select symbol, date, year, selection_score, value_traded, filters_passed, holding_days, pnl_pct, pnl_r, net_pnl, cost, threshold from ({inner})")
    sets = ", ".join(f"({i}, {t}, {m}.0, {b}.0)" for i, (t, m, b) in enumerate((t, m, b) for t in AXES["threshold"] for m in AXES["min_filters"] for b in AXES["budget"]))
    return f"""with every as materialized ({" union all ".join(parts)}), sets(param_id, threshold, min_filters, budget) as (values {sets}),
ranked as (select *, row_number() over (partition by param_id, date order by selection_score desc, value_traded desc, symbol) k from every join sets using (threshold) where filters_passed >= min_filters),
trades as materialized (select * from ranked where budget = 0 or k <= budget)
"""


@query(sweep_sql() + f"select *, row_number() over (order by total_pct desc, param_id) rank from (select cast(param_id as bigint) param_id, cast(threshold as double) threshold, cast(min_filters as double) min_filters, cast(budget as double) budget, {REPORT_SQL}, round(sum(pnl_pct), 4) total_pct from trades group by 1, 2, 3, 4)")
def o13_parameter_sweep(spark, sf):
    s = research.sweep(None, rounded(feats(spark, sf)), AXES, Params(**LIMITS))
    return s.select("param_id", "threshold", "min_filters", "budget", "trades", "wins", "losses", *number(REPORT | {"total_pct": 4}), F.col("rank").cast("long").alias("rank"))


WINDOWS = "(select cast(row_number() over (order by s) - 1 as bigint) fold, {start} train_start, s + 503 train_end, s + 504 test_start, least(s + 629, e) test_end from (select cast(unnest(generate_series(min(date), max(date), interval 126 day)) as date) s, min(date) first, max(date) e from daily) where s + 504 <= e)"
FOLDS = "folds as (select * from " + WINDOWS.format(start="s") + ")"


@query(sql(DAILY, FOLDS, select="select * from folds"))
def o12_rolling_windows(spark, sf):
    return research.windows_of(daily(spark, sf), 504, 126, 126).withColumn("fold", F.col("fold").cast("long"))


@query(sql(DAILY, select="select * from " + WINDOWS.format(start="first")))
def o12_anchored_windows(spark, sf):
    return research.windows_of(daily(spark, sf), 504, 126, 126, anchored=True).withColumn("fold", F.col("fold").cast("long"))


@query(sql(DAILY, FOLDS, select="select fold, case when date between test_start and test_end then 'test' else 'train' end part, count(*) n from daily join folds on date between train_start and test_end group by all"))
def j12_fold_assignment(spark, sf):
    d = daily(spark, sf)
    return reconcile.assign_folds(d, research.windows_of(d, 504, 126, 126)).groupBy("fold", "part").agg(F.count("*").alias("n")).withColumn("fold", F.col("fold").cast("long"))


@query(sweep_sql() + "," + DAILY + "," + FOLDS + """, m as (select fold, cast(param_id as bigint) param_id, round(sum(pnl_pct) filter (not date between test_start and test_end), 4) train_pct, round(sum(pnl_pct) filter (date between test_start and test_end), 4) test_pct
  from trades join folds on date between train_start and test_end group by 1, 2)
select fold, param_id, train_pct, test_pct from (select *, row_number() over (partition by fold order by train_pct desc nulls last, param_id) k from m) where k = 1""")
def o12_o14_best_by_fold(spark, sf):
    d = daily(spark, sf)
    t = research.sweep_trades(None, rounded(feats(spark, sf)), AXES, Params(**LIMITS))
    best = research.best_by_fold(t, research.windows_of(d, 504, 126, 126))
    return best.select(F.col("fold").cast("long").alias("fold"), "param_id", *number({"train_pct": 4, "test_pct": 4}))


# Candidates and scans

@query(sql(*CANDIDATES, oracle.threshold_candidates(True), "r as (select *, avg(atr_20) over (partition by symbol order by date rows between 19 preceding and current row) a from cand0 where gap_pct > -0.04)", select="select symbol, date from r where atr_20 > a"))
def p8_w18_short_options(spark, sf):
    p = Params("breakdown", skip_gap_down=True, require_atr_expansion=True, **LIMITS)
    return candidates.breakdown(None, rounded(feats(spark, sf)), p).select("symbol", "date")


FLAG_COLUMNS = ", ".join(FLAGS)


@query(sql(*CANDIDATES, oracle.threshold_candidates(True, strict=True, narrow=True, prior=2), select=f"select symbol, date, {FLAG_COLUMNS} from cand0"))
def p8_short_variants(spark, sf):
    p = Params("breakdown", strict_trend=True, narrow_only=True, max_prior_breakdowns=2, **LIMITS)
    return candidates.breakdown(None, rounded(feats(spark, sf)), p).select("symbol", "date", *FLAGS)


CHECKS = {
    "4P": "l.gap_pct >= 0.04", "VOL": "l.volume >= 20", "LIQ": "l.close * l.volume >= 30000", "SURV": "l.rn >= 65", "H": "f.close_pos_in_range >= 0.7", "N": "(l.prev_high - l.prev_low) < f.atr_20 * 0.5 or l.prev_close < l.prev_open",
    "2": "w1 <= 0 or w2 <= 0", "Y": "coalesce(f.prior_breakouts_30d, 0) <= 2", "L": "cast(l.close > f.ma_20 as int) + cast(f.ret_5d > 0 as int) + cast(coalesce(nullif(f.r2_65, 0), 0) >= 0.7 as int) >= 2", "C": "f.vol_dryup_ratio < 1.3",
}
SCAN = "scan as (select l.symbol, l.date, l.gap_pct, unnest([" + ", ".join(f"{{'letter': '{k}', 'passed': coalesce({v}, false)}}" for k, v in CHECKS.items()) + "]) x from lagged l left join compat f using (symbol, date) where l.gap_pct >= 0.04)"


def scan(spark, sf) -> DataFrame:
    return candidates.gap_scan(None, rounded(feats(spark, sf)), candidates.ScanConfig(min_volume=20, min_value=30_000.0))


@query(sql(*CANDIDATES, SCAN, select="select symbol, date, gap_pct, count(*) filter (x.passed) n_passed, count(*) filter (x.passed) / 10 score, string_agg(x.letter, ',' order by x.letter) filter (x.passed) letters from scan group by 1, 2, 3"))
def o8_gap_scan(spark, sf):
    passed = F.sort_array(F.transform(F.filter("checks", lambda x: x["passed"]), lambda x: x["letter"]))
    return scan(spark, sf).select("symbol", "date", "gap_pct", F.col("n_passed").cast("long").alias("n_passed"), "score", F.array_join(passed, ",").alias("letters"))


@query(sql(*CANDIDATES, SCAN, select="select x.letter letter, x.passed passed, count(*) n from scan group by 1, 2"))
def a15_scan_check_counts(spark, sf):
    return reports.check_counts(scan(spark, sf))


SIGNALS = {
    "filter_h": CHECKS["H"], "filter_n": CHECKS["N"] + " or (l.prev_high - l.prev_low) / nullif(l.prev_close, 0) < 0.02", "filter_y": CHECKS["Y"], "filter_c": CHECKS["C"], "filter_l": CHECKS["L"], "filter_2": CHECKS["2"],
    "filter_ti65": "f.ma_7 >= f.ma_65_sma * 1.05",
}


@query(sql(*CANDIDATES, "g as (select l.symbol, l.date, l.gap_pct, " + ", ".join(f"coalesce({v}, false) {k}" for k, v in SIGNALS.items()) + " from lagged l left join compat f using (symbol, date) where l.gap_pct >= 0.04 and f.close_pos_in_range is not null)",
  select="select symbol, date, gap_pct, filter_ti65, " + " + ".join(f"cast({k} as int)" for k in SIGNALS) + " filters_passed from g where " + " + ".join(f"cast({k} as int)" for k in SIGNALS) + " >= 5"))
def o9_gap_signals(spark, sf):
    return candidates.gap_signals(daily(spark, sf), rounded(feats(spark, sf))).select("symbol", "date", "gap_pct", F.coalesce("filter_ti65", F.lit(False)).alias("filter_ti65"), "filters_passed")


@query(sql(*CANDIDATES, "day as (select max(date) date from daily where date < date '1998-06-01')",
  "cand as (select f.*, f.close * f.volume value_traded, f.close prev_close, f.open prev_open, f.high prev_high, f.low prev_low, f.close * 1.04 trigger_price, 3 filters_passed from compat f join day using (date) where f.close_pos_in_range is not null)", BREAKOUT_RANK,
  select="select symbol, date, trigger_price, selection_score, selection_rank from ranked"))
def o10_watch_list(spark, sf):
    found = candidates.watch_list(daily(spark, sf), rounded(feats(spark, sf)), "1998-06-01", Params(min_price=0, min_value=0, min_volume=0))
    return found.select("symbol", "date", "trigger_price", "selection_score", F.col("selection_rank").cast("long").alias("selection_rank"))


@query(sql(DAILY, select=f"select symbol, date, watch_date, watch_ret_5d, ret_5d from (select symbol, date, lag(date) over {W} watch_date, lag(ret_5d) over {W} watch_ret_5d, ret_5d, (open - c) / nullif(c, 0) gap_pct from (select *, lag(close) over {W} c, close / nullif(lag(close, 5) over {W}, 0) - 1 ret_5d from daily)) where gap_pct > 0.3"))
def j1_feature_joins(spark, sf):
    f = feats(spark, sf)
    rows = candidates.with_lags(daily(spark, sf), Params()).where("gap_pct > 0.3").select("symbol", "date", "watch_date")
    watched = candidates.join_features(rows, f, "watch_date").select("symbol", "date", "watch_date", F.col("ret_5d").alias("watch_ret_5d"))
    return candidates.join_features(watched, f, "date").select("symbol", "date", "watch_date", "watch_ret_5d", "ret_5d")


@query(sql(DAILY, "k as (select * from (values (1), (2), (3)) v(day))", f"ahead as (select symbol, date, volume, [lead(date, 1) over {W}, lead(date, 2) over {W}, lead(date, 3) over {W}] dates, [lead(close, 1) over {W}, lead(close, 2) over {W}, lead(close, 3) over {W}] closes from daily)",
  select="select symbol, date, cast(day as int) as day, dates[day] bar_date, closes[day] as close from ahead, k where volume > 45 and dates[day] is not null"))
def j11_holding_rows(spark, sf):
    d = daily(spark, sf)
    return outcomes.holding_rows(d.where("volume > 45").select("symbol", "date"), d, 3).select("symbol", "date", "day", "bar_date", "close")


@query(sql(DAILY, select="select symbol, max(date) date, arg_max(close, date) as close from daily where date < date '1997-01-01' and symbol in (select symbol from daily where date >= date '1997-01-01') group by 1"))
def j7_latest_prior_session(spark, sf):
    d = daily(spark, sf)
    return reconcile.latest_before(d.join(d.where("date >= date'1997-01-01'").select("symbol").distinct(), "symbol", "left_semi"), "1997-01-01")


@query(sql(DAILY, select="select symbol from daily where date = date '1997-06-02' and symbol not in (select symbol from daily where low < 905 and volume < 3) group by 1"))
def o11_tradeable(spark, sf):
    d = daily(spark, sf)
    issues = quality.flagged(d, {"OHLC_VIOLATION": (F.col("low") < 905) & (F.col("volume") < 3)}).withColumn("is_active", F.lit(True))
    return candidates.tradeable(d, issues, "1997-06-02")


@query(sql(DAILY, select="select symbol, date, close from daily order by date desc, symbol limit 100"))
def t1_t5_latest_rows(spark, sf):
    return daily(spark, sf).orderBy(F.desc("date"), "symbol").select("symbol", "date", "close").limit(100)


# Entries and exits inside the day

ENTRIES = (BARS, BARS_DAILY, PRIOR, OPENING)
RUN = "(partition by symbol, date order by candle_time)"


@query(sql(*ENTRIES, "x0 as (select m.*, e.entry_time, e.entry_price entry, e.initial_stop stop0, floor((m.high - e.entry_price) / (e.entry_price - e.initial_stop)) steps from bars m join ent e using (symbol, date) where m.candle_time > e.entry_time and e.entry_price > e.initial_stop)",
  f"x1 as (select *, greatest(stop0, max(case when steps >= 2 then entry + (steps - 2) * (entry - stop0) end) over {RUN}) after from x0)", f"x2 as (select *, coalesce(lag(after) over {RUN}, stop0) before from x1)",
  "x3 as (select *, case when open <= before then 'GAP_THROUGH_STOP' when low <= after then case when after > entry then 'STOP_TRAIL' when abs(after - entry) <= abs(entry) * 1e-5 + 1e-8 then 'STOP_BREAKEVEN' else 'STOP_INITIAL' end end reason from x2)",
  "x4 as (select symbol, date, min(candle_time) filter (reason is not null) exit_time, arg_min(case when open <= before then open else after end, candle_time) filter (reason is not null) exit_price, arg_min(reason, candle_time) filter (reason is not null) exit_reason, arg_min(case when open <= before then before else after end, candle_time) filter (reason is not null) carry, arg_max(after, candle_time) last_stop from x3 group by 1, 2)",
  select="select symbol, date, e.entry_time, exit_time, exit_price, exit_reason, coalesce(carry, last_stop, e.initial_stop) carry_stop from ent e left join x4 using (symbol, date)"))
def o3_same_day_exits(spark, sf):
    b, e = opening_entries(spark, sf)
    return outcomes.same_day_exits(e, b, ladder=True).select("symbol", "date", "entry_time", "exit_time", "exit_price", "exit_reason", "carry_stop")


SHORT_OPENING = """trig as (select s.symbol, s.date, p.prior_day_close * 0.998 trigger_price from (select distinct symbol, date from bars) s join prior p using (symbol, date)),
m1 as (select b.*, t.trigger_price, hour(candle_time) * 60 + minute(candle_time) as minute, max(high) over (partition by symbol, date order by candle_time) session_high from bars b join trig t using (symbol, date) where hour(candle_time) * 60 + minute(candle_time) between 0 and 600),
m2 as (select *, least(open, trigger_price) entry_price from m1 where minute >= 5 and low <= trigger_price),
ent as (select symbol, date, min(candle_time) entry_time, arg_min(entry_price, candle_time) entry_price, arg_min(case when session_high > entry_price then session_high else entry_price * 1.04 end, candle_time) initial_stop from m2 group by 1, 2)"""


@query(sql(BARS, BARS_DAILY, PRIOR, SHORT_OPENING, select="select symbol, date, entry_time, entry_price, initial_stop from ent"))
def o2_short_entries(spark, sf):
    b = intraday(spark, sf)
    before = features.previous_session(b.select("symbol", "date").distinct(), src.intraday_to_daily(b)).where("prior_day_close is not null")
    s = before.select("symbol", "date", F.lit("SHORT").alias("direction"), (F.col("prior_day_close") * 0.998).alias("trigger_price"), F.lit(None).cast("double").alias("atr_20"))
    return outcomes.resolve_entries(s, b, 5, 600, open_minute=0).select("symbol", "date", "entry_time", "entry_price", "initial_stop")


@query(sql(*ENTRIES, select="select symbol, date, case when abs(entry_price - initial_stop) > entry_price * 0.08 then 'stop_too_far' else 'executed' end status from ent"))
def o6_entry_gate(spark, sf):
    return outcomes.gate(opening_entries(spark, sf)[1]).select("symbol", "date", "status")


def shares(bound: str) -> str:
    return f"floor({bound} / close)"


@query(sql(DAILY, "v as (select symbol, date, close, high, low, 100 qty, close entry_price, high exit_price, close * volume traded, case when close > low then floor(10000.0 / (close - low)) end s0 from daily)",
  f"s1 as (select *, case when s0 * close > 500000 then {shares('500000.0')} else s0 end a from v)", f"s2 as (select *, case when a * close < 10000 then {shares('10000.0')} else a end b from s1)",
  select=f"""select symbol, date, case when traded >= 100000000 then 5.0 when traded >= 20000000 then 10.0 else 20.0 end bps, cast(coalesce(case when b * close > 100000 then {shares('100000.0')} else b end, 0) as bigint) shares,
  {oracle.cents(oracle.order_cost('entry_price', 'false') + ' + ' + oracle.order_cost('exit_price', 'true'))} as cost from s2"""))  # fmt: skip
def p15_p16_p17_costs_and_sizes(spark, sf):
    c = F.col
    cost = ex.Costs().round_trip(c("close"), c("high"), F.lit(100), F.lit("LONG"))
    return daily(spark, sf).select("symbol", "date", ex.slippage_bps(c("close") * c("volume")).alias("bps"), ex.position_shares(c("close"), c("low"), F.lit(1_000_000.0)).alias("shares"), cost.alias("cost"))


# Corporate actions, names, reconciliation

ACTIONS = """actions as (select cast(s_suppkey as varchar) symbol, ex_date, action_type, a ratio_num, b ratio_den from supplier,
  (values (date '1994-06-01', 'SPLIT', 2.0, 1.0), (date '1995-02-01', 'RIGHTS', 1.0, 4.0), (date '1996-03-01', 'BONUS', 1.0, 1.0), (date '1997-01-15', 'DIVIDEND', 1.0, 1.0)) v(ex_date, action_type, a, b) where s_acctbal > 0)"""


@query(sql(DAILY, ACTIONS, select="""select d.symbol, d.date, d.close, round(coalesce(f, 1.0), 9) adj_factor, round(d.close * coalesce(f, 1.0), 6) adj_close from daily d left join (
  select d.symbol, d.date, product(case action_type when 'SPLIT' then ratio_den / ratio_num when 'DIVIDEND' then 1 else ratio_den / (ratio_num + ratio_den) end) f
  from daily d join actions a on a.symbol = d.symbol and a.ex_date >= d.date group by 1, 2) x using (symbol, date)"""))
def p19_w26_adjusted_series(spark, sf):
    days = [("1994-06-01", "SPLIT", 2.0, 1.0), ("1995-02-01", "RIGHTS", 1.0, 4.0), ("1996-03-01", "BONUS", 1.0, 1.0), ("1997-01-15", "DIVIDEND", 1.0, 1.0)]
    listed = F.array(*(F.struct(F.lit(x).cast("date").alias("ex_date"), F.lit(k).alias("action_type"), F.lit(a).alias("ratio_num"), F.lit(b).alias("ratio_den")) for x, k, a, b in days))
    actions = src.table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("symbol"), F.explode(listed).alias("a")).select("symbol", "a.*")
    return features.adjustment_series(daily(spark, sf), actions).select("symbol", "date", "close", *number({"adj_factor": 9, "adj_close": 6}))


@query(sql(DAILY, select="select d.symbol, d.date, d.close, s.s_name, n.n_name from daily d left join supplier s on cast(s.s_suppkey as varchar) = d.symbol left join nation n on n.n_nationkey = s.s_nationkey"))
def j13_names(spark, sf):
    s = src.table(spark, sf, "supplier").withColumn("symbol", F.col("s_suppkey").cast("string"))
    rows = reconcile.with_names(daily(spark, sf), s, "symbol", "s_name")
    rows = reconcile.with_names(rows, s.withColumnRenamed("s_nationkey", "n_nationkey"), "symbol", "n_nationkey")
    return reconcile.with_names(rows, src.table(spark, sf, "nation"), "n_nationkey", "n_name").select("symbol", "date", "close", "s_name", "n_name")


@query(sql(DAILY, select="select case when s_nationkey < 12 and date >= date '1995-01-01' then 'was-' || symbol else symbol end symbol, date, close from daily left join supplier on cast(s_suppkey as varchar) = symbol"))
def j13_aliases(spark, sf):
    s = src.table(spark, sf, "supplier").where("s_nationkey < 12").select(F.col("s_suppkey").cast("string").alias("alias"))
    aliases = s.select("alias", F.concat(F.lit("was-"), "alias").alias("symbol"), F.lit("1995-01-01").cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    return reconcile.by_alias(daily(spark, sf).select("symbol", "date", "close"), aliases)


SHIFTED = """live as (select symbol, date, strftime(candle_time, '%H:%M') bar, open, high, low, close, volume from bars),
stored as (select symbol, date, bar, open, high, low, case when volume > 1 then close + 1 else close end as close, volume * 2 volume from live where bar >= '01:00')"""


@query(sql(BARS, SHIFTED, select="""select symbol, date, bar, kind, field from (select symbol, date, bar, 'extra' kind, cast(null as varchar) field from live where bar < '01:00'
  union all select l.symbol, l.date, l.bar, case when k = 'volume' then 'volume_diff' else 'price_diff' end, k from live l join stored s using (symbol, date, bar), (values ('close'), ('volume')) v(k)
  where (k = 'close' and abs(l.close - s.close) > 0.01) or (k = 'volume' and abs(l.volume - s.volume) > s.volume * 0.4))"""))
def j9_reconcile_bars(spark, sf):
    live = intraday(spark, sf)
    stored = live.where(F.hour("candle_time") >= 1).withColumns({"close": F.when(F.col("volume") > 1, F.col("close") + 1).otherwise(F.col("close")), "volume": F.col("volume") * 2})
    return reconcile.reconcile_bars(live, stored, 0.01, 0.4).select("symbol", "date", "bar", "kind", "field")


# Quality

FOUND = f"""found as (
  select distinct symbol, date, issue_code from (
    select symbol, date, unnest([case when high < low or close > high or close < low or open > high or open < low then 'OHLC_VIOLATION' end, case when least(open, high, low, close) <= 0 then 'ZERO_PRICE' end,
      case when not hour(candle_time) * 60 + minute(candle_time) between 555 and 930 then 'TIMESTAMP_INVALID' end, case when (high - low) / nullif(open, 0) > 0.5 then 'EXTREME_CANDLE' end]) issue_code from bars
    union all select symbol, date, 'ZERO_VOLUME_DAY' from bdaily where volume = 0
    union all select symbol, date, 'DATE_GAP' from (select symbol, date, lag(date) over {W} p from bdaily) where date - p > 7
    union all select symbol, date, 'EXTREME_MOVE' from (select symbol, date, close / nullif(lag(close) over {W}, 0) - 1 r from bdaily) where abs(r) > 0.3
    union all select symbol, max(date), 'SHORT_HISTORY' from bdaily group by 1 having count(distinct date) < 252) where issue_code is not null)"""
SEVERITY = "case when issue_code in (" + ", ".join(f"'{k}'" for k, v in quality.SEVERITIES.items() if v == "CRITICAL") + ") then 'CRITICAL' when issue_code in (" + ", ".join(f"'{k}'" for k, v in quality.SEVERITIES.items() if v == "INFO") + ") then 'INFO' else 'WARNING' end"


@query(sql(BARS, BARS_DAILY, FOUND, select=f"select symbol, date, issue_code, {SEVERITY} severity from found"))
def q12_full_scan(spark, sf):
    b = intraday(spark, sf)
    return quality.scan(src.intraday_to_daily(b), b).withColumn("severity", quality.severity(F.col("issue_code")))


@query(sql(BARS, BARS_DAILY, FOUND, select=f"select count(*) = 0 ready, count(*) n_issues, coalesce(string_agg(distinct issue_code, ',' order by issue_code), '') codes from found where {SEVERITY} = 'CRITICAL' and date = (select min(date) from bars)"))
def q12_date_gate(spark, sf):
    b = intraday(spark, sf)
    first = b.agg(F.min("date")).first()[0]
    return quality.date_gate(quality.scan(src.intraday_to_daily(b), b), first).withColumn("codes", F.array_join("codes", ","))


VALID = {
    "price_low": "least(open, high, low, close) < 0.01", "price_high": "greatest(open, high, low, close) > 100000", "ohlc_order": "high < low or close > high or close < low or open > high or open < low", "date_gap": "date - d > 5",
    "extreme_return": "abs(close / nullif(c, 0) - 1) > 0.5", "volume_spike": "m > 0 and volume > m * 20",
}


@query(sql(DAILY, f"v as (select *, lag(close) over {W} c, lag(date) over {W} d, median(volume) over (partition by symbol) m from daily)", "n as (select symbol, count(*) n_rows, " + ", ".join(f"count(*) filter ({v}) {k}" for k, v in VALID.items()) + " from v group by 1)",
  select="select *, price_low + price_high + ohlc_order n_errors, date_gap + extreme_return + volume_spike n_warnings, price_low + price_high + ohlc_order = 0 passed, round(greatest(0.0, 1.0 - ((price_low + price_high + ohlc_order) + (date_gap + extreme_return + volume_spike) * 0.25) / n_rows), 6) score from n"))
def q13_validate_rows(spark, sf):
    found = quality.validate_rows(daily(spark, sf))
    return found.select("symbol", "n_rows", *VALID, "n_errors", "n_warnings", "passed", F.round("score", 6).alias("score"))


LEVELS = {k: "error" if k in quality.ROW_ERRORS else "warning" for k in VALID}
SCORE = "greatest(0.0, 1.0 - ((price_low + price_high + ohlc_order) + (date_gap + extreme_return + volume_spike) * 0.25) / n_rows)"


@query(sql(DAILY, f"v as (select *, lag(close) over {W} c, lag(date) over {W} d, median(volume) over (partition by symbol) m from daily)", "n as (select symbol, count(*) n_rows, " + ", ".join(f"count(*) filter ({v}) {k}" for k, v in VALID.items()) + " from v group by 1)",
  f"s as (select *, price_low + price_high + ohlc_order e, date_gap + extreme_return + volume_spike w, {SCORE} score from n)",
  select="select count(*) total_symbols, count(*) filter (e = 0) passed, count(*) filter (e > 0) failed, avg(cast(e = 0 as int)) pass_rate, round(avg(score), 6) avg_score, round(median(score), 6) median_score, cast(sum(e + w) as bigint) total_issues, cast(sum(e) as bigint) errors, cast(sum(w) as bigint) warnings, array_to_string(list_filter([" + ", ".join(f"case when sum({k}) > 0 then '{k}:{level}=' || cast(sum({k}) as bigint) end" for k, level in LEVELS.items()) + "], lambda x: x is not null), ',') issues from s"))
def a20_quality_summary(spark, sf):
    found = quality.quality_summary(quality.validate_rows(daily(spark, sf)))
    listed = F.array_join(F.transform("issue_breakdown", lambda x: F.concat_ws("=", x["issue"], x["n"])), ",")
    return found.select("total_symbols", "passed", "failed", "pass_rate", *number({"avg_score": 6, "median_score": 6}), "total_issues", "errors", "warnings", listed.alias("issues"))


@query(sql(DAILY, f"r as (select *, lag(close) over {W} c, avg(volume) over (partition by symbol order by date rows between 60 preceding and 1 preceding) u from daily where date between date '1997-06-02' - 120 and date '1997-06-02')", "k as (select count(distinct symbol) known_symbols from r)",
  "d as (select count(*) n_rows, count(distinct symbol) n_symbols, count(*) filter (high < low or close > high or close < low or open > high or open < low) bad_ranges, count(*) filter (abs(close / nullif(c, 0) - 1) > 0.2) large_moves, count(*) filter (volume > u * 10) volume_spikes from r where date = date '1997-06-02')",
  select="select *, n_symbols / nullif(known_symbols, 0) symbol_coverage, case when n_rows = 0 then 'NO_DATA' when n_symbols < 500 then 'THIN' else 'OK' end status from d, k"))
def q14_monitor(spark, sf):
    return quality.monitor(daily(spark, sf), "1997-06-02").drop("null_prices")


@query(sql(DAILY, select="select symbol, count(*) n_rows, min(date) first_date, max(date) last_date from daily where symbol not in (select cast(s_suppkey as varchar) from supplier where s_acctbal > 0) group by 1"))
def q17_dead_symbols(spark, sf):
    listed = src.table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("symbol"))
    return quality.dead_symbols(daily(spark, sf), listed)


@query(sql(BARS, "v as (select symbol, date, candle_time from bars union all select symbol, date, candle_time from bars where volume > 1)", select="select symbol, date, 'DUPLICATE_CANDLE' issue_code from v group by symbol, date, candle_time having count(*) > 1"))
def q6_duplicate_keys(spark, sf):
    b = intraday(spark, sf)
    return quality.duplicate_bars(b.union(b.where("volume > 1")))


@query(sql(BARS, BARS_DAILY, "quiet as (select symbol, date, open, high, low, close, greatest(volume - 50, 0) volume from bdaily)", select="select symbol, date, 'ZERO_VOLUME_DAY' issue_code from quiet where volume = 0"))
def q8_low_volume_days(spark, sf):
    b = intraday(spark, sf)
    quiet = src.intraday_to_daily(b).withColumn("volume", F.greatest(F.col("volume") - 50, F.lit(0)))
    return quality.scan(quiet, b, fast=True).where("issue_code = 'ZERO_VOLUME_DAY'")


@query(sql(DAILY, select="select symbol, max(date) date, 'SHORT_HISTORY' issue_code from daily group by 1 having count(distinct date) < 530"))
def q11_history_lengths(spark, sf):
    return quality.short_history(daily(spark, sf), 530)


RULE_COUNTS = """n as (select symbol, issue_code, count(*) n from (select symbol, unnest([case when least(open, high, low, close) <= 0 then 'ZERO_PRICE' end, case when not hour(candle_time) * 60 + minute(candle_time) between 555 and 930 then 'TIMESTAMP_INVALID' end, case when (high - low) / nullif(open, 0) > 0.5 then 'EXTREME_CANDLE' end]) issue_code from bars) where issue_code is not null group by 1, 2)"""


@query(sql(BARS, RULE_COUNTS, select=f"select symbol, issue_code, {SEVERITY} severity, issue_code <> 'EXTREME_CANDLE' is_active, false acknowledged, date '2024-01-01' first_seen, case when issue_code = 'EXTREME_CANDLE' then date '2024-01-01' else date '2024-01-02' end last_seen, case when issue_code = 'EXTREME_CANDLE' then 0 else n end n_rows from n"))
def u6_issue_registry(spark, sf):
    found = quality.flagged(intraday(spark, sf), quality.intraday_rules())
    none = spark.createDataFrame([], "symbol string, issue_code string, is_active boolean, acknowledged boolean, first_seen date, last_seen date")
    return quality.upsert_issues(quality.upsert_issues(none, found, "2024-01-01"), found.where("issue_code <> 'EXTREME_CANDLE'"), "2024-01-02")


# Refreshes and lineage

@query(sql(DAILY, select="select year(date) as year, count(*) row_count, min(date) first_date, max(date) last_date, 'READY' state from daily group by 1"))
def s16_partition_registry(spark, sf):
    return src.partition_registry(daily(spark, sf).withColumn("year", F.year("date")), ["year"]).drop("content_hash", "symbols")


@query(sql(DAILY, FEATURES, select="select symbol, date, ret_252d, round(atr_20, 6) atr_20, range_percentile_252, ma_200, breakout_4pct_up_90d, r2_65, atr_compress_ratio from feat where date >= date '1998-01-01'"))
def m3_incremental_daily(spark, sf):
    new = incremental.daily_since(daily(spark, sf), date(1998, 1, 1), rows=incremental.ROW_CONTEXT)
    return rounded(new).select("symbol", "date", "ret_252d", F.round("atr_20", 6).alias("atr_20"), "range_percentile_252", "ma_200", "breakout_4pct_up_90d", "r2_65", "atr_compress_ratio")


@query(sql(BARS, BARS_DAILY, INTRADAY, select="select symbol, candle_time, rn_5min, or_30min_high, gap_open_pct, first_breakout_time from intraday where date >= (select max(date) from bars) - 3"))
def m4_incremental_intraday(spark, sf):
    b = intraday(spark, sf)
    since = b.agg(F.date_sub(F.max("date"), 3)).first()[0]
    return incremental.intraday_since(b, src.intraday_to_daily(b), since).select("symbol", "candle_time", "rn_5min", "or_30min_high", "gap_open_pct", "first_breakout_time")


@query(sql(DAILY, FEATURES, oracle.breadth(10, 30_000), select=f"select {', '.join(BREADTH)} from breadth where date >= date '1998-01-01'"))
def m5_incremental_breadth(spark, sf):
    new = incremental.breadth_since(feats(spark, sf), date(1998, 1, 1), rows=incremental.BREADTH_ROWS, min_price=10, min_value=30_000)
    return new.withColumn("alert_flags", F.array_join("alert_flags", ",")).select(*BREADTH)


@query(sql(DAILY, select="select count(*) n_rows, count(distinct symbol) n_symbols, min(date) first_date, max(date) last_date from daily"))
def m2_dataset_state(spark, sf):
    return incremental.dataset_state(daily(spark, sf)).drop("dataset_hash")


@query("""select cast(s_suppkey as varchar) symbol, array_to_string(list_filter([case when n_nationkey is null then 'strategy_unknown' end, case when s_nationkey % 7 <> n_regionkey then 'strategy_changed' end, case when s_suppkey % 2 <> n_nationkey % 2 then 'dataset_changed' end,
  case when s_acctbal <= 0 and n_nationkey is not null then 'code_changed' end, case when s_suppkey % 3 = 0 and n_nationkey is not null then 'range_extended' end], lambda x: x is not null), ',') reasons from supplier left join (select * from nation where n_regionkey <> 4) on n_nationkey = s_nationkey""")
def m6_stale_runs(spark, sf):
    text = lambda c: F.expr(c).cast("string")
    day = lambda c: F.expr(c).cast("date")
    runs = src.table(spark, sf, "supplier").select(text("s_suppkey").alias("symbol"), text("s_nationkey").alias("strategy"), text("s_nationkey % 7").alias("strategy_hash"), text("s_suppkey % 2").alias("dataset_hash"), text("s_acctbal > 0").alias("code_hash"), day("'2020-01-01'").alias("start_date"), day("if(s_suppkey % 3 = 0, '2023-12-31', '2024-12-31')").alias("end_date"))
    now = src.table(spark, sf, "nation").where("n_regionkey <> 4").select(text("n_nationkey").alias("strategy"), text("n_regionkey").alias("strategy_hash"), text("n_nationkey % 2").alias("dataset_hash"), text("true").alias("code_hash"), day("'2020-01-01'").alias("start_date"), day("'2024-12-31'").alias("end_date"))
    return incremental.stale_runs(runs, now).select("symbol", F.array_join("reasons", ",").alias("reasons"))


@query(sql(DAILY, select="""select symbol, date, substr(sha256('{"symbol":"' || symbol || '","date":"' || strftime(date, '%Y-%m-%d') || '","close":' || cast(close as varchar) || '}'), 1, 16) fingerprint from daily"""))
def p20_fingerprints(spark, sf):
    return daily(spark, sf).select("symbol", "date", ex.fingerprint("symbol", "date", "close").alias("fingerprint"))


# Ticks

TICKS = "ticks as (select event_type symbol, ts, value last_price, row_number() over (partition by event_type order by ts, event_id) volume from events)"
TICK_BARS = """tb as (select symbol, time_bucket(interval 5 minutes, ts) bar_start, arg_min(last_price, ts) open, max(last_price) high, min(last_price) low, arg_max(last_price, ts) as close, max(volume) - min(volume) volume, min(ts) first_ts, max(ts) last_ts, count(*) n_ticks from ticks group by 1, 2)"""


def tick_bars(spark, sf) -> DataFrame:
    return ticks.bars(ticks.ticks_from_events(src.table(spark, sf, "events")))


@query(sql(TICKS, f"d as (select symbol, ts, volume, greatest(coalesce(volume - lag(volume) over (partition by symbol order by ts, volume), 0), 0) delta from ticks)", select="select symbol, ts, volume, delta from d"))
def r2_volume_deltas(spark, sf):
    return ticks.volume_deltas(ticks.ticks_from_events(src.table(spark, sf, "events"))).select("symbol", "ts", "volume", "delta")


@query(sql(TICKS, TICK_BARS, select="select symbol, bar_start, bar_start + interval 5 minutes bar_end, open, high, low, close, volume, first_ts, last_ts, n_ticks from tb"))
def r1_tick_bars(spark, sf):
    return tick_bars(spark, sf)


@query(sql(TICKS, TICK_BARS, "w as (select symbol, max(high) * 0.9 trigger_price from tb group by 1)", "r as (select tb.*, trigger_price, min(low) over (partition by symbol, cast(bar_start as date) order by bar_start) stop from tb join w using (symbol))",
  select="select symbol, cast(bar_start as date) as day, min(bar_start) bar_start, arg_min(greatest(open, trigger_price), bar_start) entry_price, arg_min(stop, bar_start) stop from r where high >= trigger_price group by 1, 2"))
def r6_entry_alerts(spark, sf):
    b = tick_bars(spark, sf)
    return ticks.entry_alerts_batch(b, b.groupBy("symbol").agg((F.max("high") * 0.9).alias("trigger_price")))


@query(sql(TICKS, TICK_BARS, "p as (select symbol, arg_min(open, bar_start) entry_price, arg_min(open, bar_start) * 0.5 stop0 from tb group by 1)", "r0 as (select tb.*, entry_price, stop0, max(high) over (partition by symbol order by bar_start) best from tb join p using (symbol))",
  "r1 as (select *, greatest(stop0, max(case when best >= entry_price * 1.08 then greatest(entry_price, best * 0.98) end) over (partition by symbol order by bar_start)) after from r0)", "r2 as (select *, coalesce(lag(after) over (partition by symbol order by bar_start), stop0) stop from r1)",
  select="select symbol, min(bar_start) exit_time, arg_min(least(open, stop), bar_start) exit_price, arg_min(case when open <= stop then 'GAP_STOP' else 'STOP' end, bar_start) exit_reason from r2 where open <= stop or low <= stop group by 1"))
def r7_track_stops(spark, sf):
    b = tick_bars(spark, sf)
    p = b.groupBy("symbol").agg(F.min_by("open", "bar_start").alias("entry_price")).withColumn("stop", F.col("entry_price") * 0.5)
    return ticks.track_stops_batch(b, p)


@query(sql(BARS, "r as (select symbol, candle_time, close - open day_pnl, sum(close - open) over (partition by symbol order by candle_time) equity from bars)", "p as (select *, greatest(100.0, max(equity) over (partition by symbol order by candle_time)) peak from r)",
  select="select symbol, candle_time, array_to_string(list_filter([case when strftime(candle_time, '%H:%M') >= '15:15' then 'cutoff' end, case when day_pnl <= -30.0 then 'daily_loss' end, case when round(peak - equity, 6) >= round(peak * 0.1, 6) then 'drawdown' end], lambda x: x is not null), ',') flags from p"))
def r9_risk_flags(spark, sf):
    from pyspark.sql import Window

    order = Window.partitionBy("symbol").orderBy("candle_time").rowsBetween(Window.unboundedPreceding, 0)
    b = intraday(spark, sf).withColumns({"ts": F.col("candle_time"), "day_pnl": F.col("close") - F.col("open"), "equity": F.sum(F.col("close") - F.col("open")).over(order), "capital": F.lit(1000.0)})
    b = b.withColumn("peak", F.greatest(F.lit(100.0), F.max("equity").over(order)))
    return ticks.risk_flags(b).select("symbol", "candle_time", F.array_join("flags", ",").alias("flags"))
