"""Reports over bars and trades: coverage, universes, trade tables, curves, distributions, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import coverage_percent, freshness, growth, ratio
from .features import by_date


def liquid_universe(bars: DataFrame, n: int, start=None, end=None) -> DataFrame:
    """The n symbols with the largest average traded value, ties by symbol."""
    b = bars
    if start is not None:
        b = b.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        b = b.where(F.col("date") <= F.lit(end).cast("date"))
    return b.groupBy("symbol").agg(F.avg(F.col("close") * F.col("volume")).alias("avg_value")).orderBy(F.desc("avg_value"), "symbol").limit(n)


def tail_dollar_volume(bars: DataFrame, rows: int = 20) -> DataFrame:
    """Average traded value of each symbol's last rows."""
    late = bars.withColumn("_n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).where(F.col("_n") <= rows)
    return late.groupBy("symbol").agg(F.avg(F.col("close") * F.col("volume")).alias("avg_value"), F.count("*").alias("n_rows"))


def snapshot(bars: DataFrame) -> DataFrame:
    return bars.agg(F.count("*").alias("n_rows"), F.countDistinct("symbol").alias("n_symbols"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def universe_by_year(bars: DataFrame) -> DataFrame:
    return bars.groupBy(F.year("date").alias("year")).agg(F.countDistinct("symbol").alias("n_symbols"), F.countDistinct("date").alias("n_dates"), F.count("*").alias("n_rows"))


def symbol_coverage(bars: DataFrame, as_of) -> DataFrame:
    """Per symbol: sessions, dates, share of the sessions its span should hold, estimated gaps, freshness."""
    s = bars.groupBy("symbol").agg(F.countDistinct("date").alias("sessions"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    from ..functions.expressions import expected_sessions

    return s.withColumns(
        {
            "coverage": coverage_percent(F.col("sessions"), F.col("first_date"), F.col("last_date")),
            "missing": F.greatest(expected_sessions(F.col("first_date"), F.col("last_date")) - F.col("sessions"), F.lit(0)),
            "freshness": freshness(F.col("last_date"), as_of),
        }
    )


def freshness_counts(bars: DataFrame, as_of, sample: int = 50) -> DataFrame:
    """Symbols by freshness: how many, and the first few by name (a heap of `sample` names, not a list of all)."""
    last = bars.groupBy("symbol").agg(F.max("date").alias("last_date")).withColumn("freshness", freshness(F.col("last_date"), as_of))
    ranked = last.withColumn("_n", F.row_number().over(Window.partitionBy("freshness").orderBy("symbol")))
    return ranked.groupBy("freshness").agg(F.count("*").alias("n_symbols"), F.sort_array(F.collect_list(F.when(F.col("_n") <= sample, F.col("symbol")))).alias("examples"))


def last_date_months(bars: DataFrame, n: int = 12) -> DataFrame:
    last = bars.groupBy("symbol").agg(F.max("date").alias("last_date"))
    return last.groupBy(F.date_format("last_date", "yyyy-MM").alias("month")).agg(F.count("*").alias("n_symbols")).orderBy(F.desc("month")).limit(n)


def scan_history(derived: DataFrame, days: int = 30, least: int = 5) -> DataFrame:
    """Per date of the last days of the table: rows, those with enough flags, their share and the average count."""
    newest = derived.agg(F.max("date").alias("newest"))
    d = derived.join(F.broadcast(newest)).where(F.col("date") > F.date_sub("newest", days))
    good = F.coalesce(F.col("filters_passed") >= least, F.lit(False))
    return d.groupBy("date").agg(F.count("*").alias("n_rows"), F.count_if(good).alias("n_passed"), (F.count_if(good) * 100.0 / F.count("*")).alias("pass_rate"), F.avg("filters_passed").alias("avg_passed"))


def movers(features: DataFrame, n: int = 20) -> DataFrame:
    """The largest one-day moves of the table's last date, either way."""
    newest = features.agg(F.max("date").alias("date"))
    return features.join(F.broadcast(newest), "date").where(F.col("ret_1d").isNotNull()).orderBy(F.desc(F.abs("ret_1d")), "symbol").select("symbol", "date", "close", "ret_1d").limit(n)


def trade_report(trades: DataFrame, *keys) -> DataFrame:
    """Counts, wins, results, percent, R and holding by any keys: exit reason, symbol, month, entry time, and so on."""
    won = F.col("net_pnl") > 0
    return trades.groupBy(*keys).agg(
        F.count("*").alias("trades"),
        F.count_if(won).alias("wins"),
        F.count_if(~won).alias("losses"),
        (F.count_if(won) * 100.0 / F.count("*")).alias("win_rate"),
        F.sum("net_pnl").alias("net_pnl"),
        F.avg("pnl_pct").alias("avg_pct"),
        F.avg("pnl_r").alias("avg_r"),
        F.avg("holding_days").alias("avg_days"),
        F.sum("cost").alias("cost"),
        profit_factor(F.col("net_pnl")).alias("profit_factor"),
    )


def profit_factor(net: Column) -> Column:
    return F.sum(F.when(net > 0, net).otherwise(0.0)) / F.nullif(F.abs(F.sum(F.when(net < 0, net).otherwise(0.0))), F.lit(0.0))


def month_by_day(trades: DataFrame) -> DataFrame:
    """Trades per month (rows) and weekday (columns, Monday is 1)."""
    from ..functions.expressions import weekday

    return trades.withColumns({"month": F.date_format("date", "yyyy-MM"), "weekday": weekday(F.col("date"))}).groupBy("month").pivot("weekday", [1, 2, 3, 4, 5, 6, 7]).count()


def yearly_metrics(trades: DataFrame) -> DataFrame:
    """Yearly trade report with the number of trades by exit reason."""
    reasons = trades.groupBy("year", "exit_reason").count().groupBy("year").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("exit_reason", "count")))).alias("exit_reasons"))
    return trade_report(trades, "year").join(reasons, "year")


def equity_curve(trades: DataFrame, capital: float = 1_000_000.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Running result, peak and drawdown over trades in order of exit, one curve per keys.

    Without keys it is one curve, so it is first summed by date.
    """
    daily = trades.groupBy(*keys, "exit_date").agg(F.sum("net_pnl").alias("net_pnl"), F.count("*").alias("trades"))
    order = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("exit_date").rowsBetween(Window.unboundedPreceding, 0)
    e = daily.withColumn("equity", F.lit(capital) + F.sum("net_pnl").over(order)).withColumn("peak", F.greatest(F.lit(capital), F.max("equity").over(order)))
    return e.withColumn("drawdown", (F.col("peak") - F.col("equity")) / F.col("peak"))


def experiment_summary(trades: DataFrame, years: float | None = None, key: str = "exp_id") -> DataFrame:
    """Per experiment: total and annualised percent, drawdown of the percent curve, profit factor, Calmar, R, CAGR, worst year."""
    t = trades.groupBy(key).agg(
        F.count("*").alias("trades"),
        F.sum("pnl_pct").alias("total_pct"),
        (F.count_if(F.col("net_pnl") > 0) * 100.0 / F.count("*")).alias("win_rate"),
        profit_factor(F.col("net_pnl")).alias("profit_factor"),
        F.avg("pnl_r").alias("avg_r"),
        F.median("pnl_r").alias("median_r"),
        F.countDistinct("symbol").alias("n_symbols"),
        (F.datediff(F.max("date"), F.min("date")) / 365.25).alias("_years"),
    )
    by_day = trades.groupBy(key, "date").agg(F.sum("pnl_pct").alias("p"))
    order = Window.partitionBy(key).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    curve = by_day.withColumn("sum", F.sum("p").over(order)).withColumn("drop", F.greatest(F.lit(0.0), F.max("sum").over(order)) - F.col("sum"))
    worst = trades.groupBy(key, "year").agg(F.sum("pnl_pct").alias("p")).groupBy(key).agg(F.min("p").alias("worst_year"))
    # one row a key on each side: put together by the key without a join, which would be a product where the key is a constant
    s = t.unionByName(curve.groupBy(key).agg(F.max("drop").alias("max_drawdown")), allowMissingColumns=True).unionByName(worst, allowMissingColumns=True)
    s = s.groupBy(key).agg(*(F.max(c).alias(c) for c in s.columns if c != key))
    span = F.lit(years) if years else F.greatest(F.col("_years"), F.lit(1 / 365.25))
    s = s.withColumn("annual_pct", F.col("total_pct") / span)
    calmar = F.when(F.col("max_drawdown") > 0, F.col("annual_pct") / F.col("max_drawdown"))
    grown = F.greatest(F.lit(1) + F.col("total_pct") / 100, F.lit(0.0))
    return s.withColumns({"calmar": F.coalesce(calmar, F.lit(0.0)), "calmar_inf": F.coalesce(calmar, F.lit(float("inf"))), "cagr": (F.pow(grown, F.lit(1) / span) - 1) * 100}).drop("_years")


def rank_experiments(summary: DataFrame, metric: str = "calmar", top: int = 5, ascending: bool = False, key: str = "exp_id") -> DataFrame:
    by = F.asc_nulls_last(metric) if ascending else F.desc_nulls_last(metric)
    return summary.orderBy(by, key).limit(top)


def r_distribution(trades: DataFrame, *keys) -> DataFrame:
    r = F.col("pnl_r")
    q = F.percentile(r, F.array(*(F.lit(x) for x in (0.1, 0.25, 0.5, 0.75, 0.9))))
    d = trades.groupBy(*keys).agg(q.alias("q"), (F.count_if(r > 0) * 100.0 / F.count(r)).alias("win_rate"), F.avg(F.when(r > 0, r)).alias("avg_winner"), F.avg(F.when(r <= 0, r)).alias("avg_loser"), F.max(r).alias("max_r"), F.min(r).alias("min_r"))
    return d.select(*keys, *(F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("p10", "p25", "p50", "p75", "p90"))), "win_rate", "avg_winner", "avg_loser", "max_r", "min_r")


def risk_ratios(returns: DataFrame, column: str = "ret", risk_free: float = 0.02, *keys) -> DataFrame:
    """Sortino ratio of daily returns, annualised over 252 days; 0 without a losing day."""
    excess = F.col(column) - risk_free / 252
    down = F.stddev_pop(F.when(excess < 0, excess))
    return returns.groupBy(*keys).agg((F.coalesce(F.avg(excess) / F.nullif(down, F.lit(0.0)), F.lit(0.0)) * (252**0.5)).alias("sortino"), F.count(column).alias("n_days"))


def funnel(diagnostics: DataFrame, *keys) -> DataFrame:
    return diagnostics.groupBy(*keys, "status").agg(F.count("*").alias("n"))


def check_counts(scans: DataFrame) -> DataFrame:
    """Passes and failures of each check of a scan."""
    return scans.select(F.explode("checks").alias("x")).groupBy("x.letter", "x.passed").agg(F.count("*").alias("n"))


def filter_effects(trades: DataFrame, flags: list[str]) -> DataFrame:
    """Per flag: how often it holds, and average R with and without it; one pass, one row a flag and trade inside it."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("flag"), F.coalesce(F.col(f), F.lit(False)).alias("holds")) for f in flags)))
    t = trades.select("pnl_r", pairs.alias("p")).select("pnl_r", "p.*")
    return t.groupBy("flag").agg(F.count_if(F.col("holds")).alias("n_pass"), F.count_if(~F.col("holds")).alias("n_fail"), F.avg(F.when(F.col("holds"), F.col("pnl_r"))).alias("r_pass"), F.avg(F.when(~F.col("holds"), F.col("pnl_r"))).alias("r_fail"))


def filter_combinations(rows: DataFrame, flags: list[str], top: int = 20) -> DataFrame:
    name = F.concat_ws("", *(F.when(F.coalesce(F.col(f), F.lit(False)), f.removeprefix("filter_").upper()).otherwise("-") for f in flags))
    return rows.groupBy(name.alias("combination")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "combination").limit(top)


def duplicates(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Keys (or whole rows) that occur more than once."""
    return df.groupBy(*(keys or df.columns)).agg(F.count("*").alias("n")).where("n > 1")


def market_stats(bars: DataFrame, start=None, end=None) -> DataFrame:
    b = bars
    if start is not None:
        b = b.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return b.groupBy("symbol").agg(
        F.count("*").alias("sessions"), F.min("low").alias("lowest"), F.max("high").alias("highest"), F.avg("close").alias("avg_close"), F.sum("volume").alias("volume"),
        F.min_by("open", "date").alias("first_open"), F.max_by("close", "date").alias("last_close"),
    )


def session_result(positions: DataFrame) -> DataFrame:
    """Net result per session; a partial exit, marked in the metadata JSON, pays its fees once."""
    m = F.from_json("metadata", "partial_exit boolean, partial_fees double")
    fees = F.when(F.coalesce(m["partial_exit"], F.lit(False)), F.coalesce(m["partial_fees"], F.lit(0.0))).otherwise(F.lit(0.0))
    return positions.groupBy("session_id").agg(F.sum(F.col("realized") - F.col("fees") - fees).alias("net_pnl"), F.count("*").alias("positions"))


def sensitivity(runs: DataFrame) -> DataFrame:
    """Per parameter of long-form runs (param, value, metric): |correlation| times range over mean size, and the best value; zero metrics are left out."""
    r = runs.where(F.col("metric") != 0)
    return r.groupBy("param").agg(
        (F.coalesce(F.abs(F.corr("value", "metric")), F.lit(0.0)) * (F.max("metric") - F.min("metric")) / F.nullif(F.abs(F.avg("metric")), F.lit(0.0))).alias("score"),
        F.max_by("value", F.struct("metric", -F.col("value"))).alias("best_value"), F.max("metric").alias("best_metric"), F.min("metric").alias("worst_metric"),
    )


def fold_consistency(folds: DataFrame, least_trades: int = 10) -> DataFrame:
    return folds.groupBy("exp_id").agg((F.stddev_pop("calmar") / F.nullif(F.avg("calmar"), F.lit(0.0))).alias("calmar_cv"), F.count_if(F.col("trades") < least_trades).alias("thin_folds"), F.count("*").alias("folds"))


def gaps(bars: DataFrame, least_days: int = 7) -> DataFrame:
    """Runs without a bar longer than least_days, inside a symbol's span."""
    g = bars.select("symbol", "date").distinct().withColumn("previous", F.lag("date").over(by_date()))
    return g.withColumn("gap_days", F.datediff("date", "previous")).where(F.col("gap_days") > least_days)


def anomalies(bars: DataFrame, move: float = 0.30) -> DataFrame:
    """One row per bar and rule that it breaks: bad range, zero volume, missing or zero price, large move; one scan."""
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    b = bars.withColumn("_before", F.lag("close").over(by_date()))
    rules = {
        "ohlc": (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high")),
        "null_price": F.array_contains(F.array(*(p.isNull() for p in prices)), True),
        "zero_price": F.array_contains(F.array(*(F.coalesce(p <= 0, F.lit(False)) for p in prices)), True),
        "zero_volume": F.col("volume") == 0,
        "large_move": F.abs(growth(F.col("close"), F.col("_before"))) > move,
    }
    found = F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in rules.items())))
    return b.select("symbol", "date", "close", growth(F.col("close"), F.col("_before")).alias("ret_1d"), F.explode(found).alias("kind"))


def lookback_date(bars: DataFrame, before, sessions: int = 130) -> DataFrame:
    """The date so many sessions before a date."""
    days = bars.where(F.col("date") < F.lit(before).cast("date")).select("date").distinct().orderBy(F.desc("date")).limit(sessions)
    return days.agg(F.min("date").alias("start"))


def moves(bars: DataFrame, least: float = 0.2, top: int = 500) -> DataFrame:
    b = bars.withColumn("ret_1d", ratio(F.col("close"), F.lag("close").over(by_date())) - 1)
    return b.where(F.abs("ret_1d") > least).orderBy(F.desc(F.abs("ret_1d")), "symbol", "date").select("symbol", "date", "ret_1d").limit(top)
