"""Research plans: walk-forward windows, backtests as one chain, and sweeps as one job over all parameter sets."""

from __future__ import annotations

from dataclasses import replace
from datetime import date
from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import Costs, places
from ..operators import candidates, outcomes, reports
from ..operators.candidates import Params


def rolling_windows(spark: SparkSession, start: date, end: date, train_days: int = 252, test_days: int = 63, step_days: int = 63, anchored: bool = False) -> DataFrame:
    """Folds of calendar days: a train window and the test window right after it, moved on by step_days; anchored ones keep their start."""
    return windows_over(spark.range(1).select(F.lit(start).alias("s"), F.lit(end).alias("e")), train_days, test_days, step_days, anchored)


def windows_of(bars: DataFrame, train_days: int = 252, test_days: int = 63, step_days: int = 63, anchored: bool = False) -> DataFrame:
    """The same over the span of the bars."""
    return windows_over(bars.agg(F.min("date").alias("s"), F.max("date").alias("e")), train_days, test_days, step_days, anchored)


def windows_over(span: DataFrame, train_days: int, test_days: int, step_days: int, anchored: bool) -> DataFrame:
    """Folds of the spans (s, e), one row each; none of a span without dates."""
    span = span.where(F.col("s").isNotNull())
    folds = span.select("s", "e", F.posexplode(F.sequence("s", "e", F.expr(f"interval {step_days} days"))).alias("fold", "train_start"))
    folds = folds.withColumn("train_end", F.date_add("train_start", train_days - 1))
    folds = folds.withColumns({"test_start": F.date_add("train_end", 1), "test_end": F.least(F.date_add("train_end", test_days), F.col("e"))})
    kept = folds.where(F.col("test_start") <= F.col("e"))
    return kept.select("fold", F.col("s" if anchored else "train_start").alias("train_start"), "train_end", "test_start", "test_end")


def session_windows(bars: DataFrame, train: int = 252, test: int = 63, step: int = 63) -> DataFrame:
    """Folds counted in sessions of the bars; the list of distinct dates is short and numbered once."""
    days = bars.select("date").distinct().withColumn("n", F.row_number().over(Window.orderBy("date")) - 1)
    total = days.agg(F.max("n").alias("last"))
    folds = total.select("last", F.explode(F.sequence(F.lit(0), F.greatest(F.col("last") - train, F.lit(0)).cast("int"), F.lit(step))).alias("at")).where(F.col("at") + train <= F.col("last"))
    edges = {"train_start": F.col("at"), "train_end": F.col("at") + train - 1, "test_start": F.col("at") + train, "test_end": F.least(F.col("at") + train + test - 1, F.col("last"))}
    folds = folds.select((F.col("at") / step).cast("int").alias("fold"), *(v.alias(f"_{k}") for k, v in edges.items()))
    for k in edges:
        folds = folds.join(days.select(F.col("n").alias(f"_{k}"), F.col("date").alias(k)), f"_{k}")
    return folds.select("fold", *edges)


def grid(spark: SparkSession, axes: dict[str, list[float]]) -> DataFrame:
    """All combinations of parameter values, numbered; the list is what the user states, not data."""
    rows = [(i, *map(float, values)) for i, values in enumerate(product(*axes.values()))]
    return spark.createDataFrame(rows, "param_id long, " + ", ".join(f"{a} double" for a in axes))


def random_grid(spark: SparkSession, axes: dict[str, list[float]], n: int, seed: int = 42, cap: int = 100) -> DataFrame:
    return grid(spark, axes).orderBy(F.rand(seed)).limit(min(n, cap))


def one_at_a_time(spark: SparkSession, axes: dict[str, list[float]], base: dict[str, float]) -> DataFrame:
    rows = [(i, a, *(float(v if a == b else base[b]) for b in axes)) for i, (a, v) in enumerate((a, v) for a, values in axes.items() for v in values)]
    return spark.createDataFrame(rows, "param_id long, axis string, " + ", ".join(f"{a} double" for a in axes))


def signals(rows: DataFrame, threshold: float) -> DataFrame:
    """Trigger prices of selected candidates."""
    side = F.when(F.col("direction") == "SHORT", 1 - threshold).otherwise(1 + threshold)
    return rows.withColumn("trigger_price", F.col("prev_close") * side)


def daily_entries(rows: DataFrame) -> DataFrame:
    """Entries without intraday bars: at the trigger, or the open beyond it, with the day's far end as the stop."""
    short = F.col("direction") == "SHORT"
    entry = F.when(short, F.least("open", "trigger_price")).otherwise(F.greatest("open", "trigger_price"))
    e = rows.withColumn("entry_price", entry)
    stop = F.when(short, F.greatest("high", F.col("entry_price"))).otherwise(F.least("low", F.col("entry_price")))
    stop = F.when(stop == F.col("entry_price"), F.when(short, F.col("entry_price") * 1.04).otherwise(F.col("entry_price") * 0.96)).otherwise(stop)
    return e.withColumns({"initial_stop": stop, "carry_stop": F.lit(None).cast("double")})


def backtest(daily: DataFrame | None, features: DataFrame, p: Params, bars: DataFrame | None = None, rules: outcomes.ExitRules = outcomes.ExitRules(), costs: Costs = Costs(), start=None, end=None, open_minute: int = 555) -> DataFrame:
    """Candidates, daily budget, entries, exits over several days and trade economics, as one plan over all years.

    daily None: the features' table has the bars (candidates), and each row takes
    the bars that follow it along, so bars are neither joined nor shuffled again.
    """
    if daily is None:
        p = replace(p, ahead=rules.time_stop_days)
    rows = candidates.select_candidates(candidates.generate(daily, features, p, start, end), p).where("selected")
    rows = signals(rows, p.threshold)
    if bars is None:
        entries = daily_entries(rows)
    else:
        found = outcomes.resolve_entries(rows, bars, open_minute=open_minute)
        same_day = outcomes.same_day_exits(found, bars).withColumnsRenamed({"exit_price": "day_exit_price", "exit_reason": "day_exit_reason", "exit_time": "day_exit_time"})
        entries = rows.join(same_day, ["symbol", "date", "direction"])
    exits = outcomes.multi_day_exits(entries, daily, rules)
    if bars is not None:
        done = F.col("day_exit_reason").isNotNull()
        exits = exits.withColumns({"exit_price": F.when(done, F.col("day_exit_price")).otherwise(F.col("exit_price")), "exit_reason": F.when(done, F.col("day_exit_reason")).otherwise(F.col("exit_reason")), "exit_date": F.when(done, F.col("date")).otherwise(F.col("exit_date")), "holding_days": F.when(done, 0).otherwise(F.col("holding_days"))})
    return outcomes.economics(exits.where(F.col("exit_price").isNotNull()), costs=costs)


def sweep_trades(daily: DataFrame | None, features: DataFrame, axes: dict[str, list[float]], p: Params = Params()) -> DataFrame:
    """Trades of every parameter set (threshold, min_filters, budget), with its param_id, from one pass over the candidates.

    Candidates of the loosest threshold and minimum are generated once; every
    parameter set keeps its own of them by conditions, ranks them by its own
    budget, and takes its trades from exits that one plan gives for all
    thresholds.  daily None as in backtest.
    """
    spark = features.sparkSession
    if daily is None:
        p = replace(p, ahead=outcomes.ExitRules().time_stop_days)
    values = {"threshold": axes.get("threshold", [p.threshold]), "min_filters": axes.get("min_filters", [p.min_filters]), "budget": axes.get("budget", [p.budget])}
    loose = Params(**{**p.__dict__, "threshold": min(values["threshold"]), "min_filters": int(min(values["min_filters"])), "budget": 0})
    rows = candidates.generate(daily, features, loose)
    scored = candidates.breakdown_score(rows) if p.strategy == "breakdown" else candidates.breakout_score(rows)
    # one row per threshold that a candidate reaches: a stated list, exploded
    short = F.col("direction") == "SHORT"
    level = scored.withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in sorted(set(values["threshold"]))))))
    level = level.withColumn("trigger_price", F.col("prev_close") * F.when(short, 1 - F.col("threshold")).otherwise(1 + F.col("threshold")))
    level = level.where(F.when(short, F.col("low") <= F.col("trigger_price")).otherwise(F.col("high") >= F.col("trigger_price")))
    trades = outcomes.multi_day_exits(daily_entries(level), daily, variant=("threshold",))
    trades = outcomes.economics(trades.where(F.col("exit_price").isNotNull()))
    # the list that the user states, not data
    sets = grid(spark, {"threshold": values["threshold"], "min_filters": values["min_filters"], "budget": values["budget"]})
    j = trades.join(F.broadcast(sets), "threshold").where(F.col("filters_passed") >= F.col("min_filters"))
    order = Window.partitionBy("param_id", "date").orderBy(F.desc_nulls_last("selection_score"), F.desc_nulls_last("value_traded"), "symbol")
    return j.withColumn("selection_rank", F.row_number().over(order)).where((F.col("budget") <= 0) | (F.col("selection_rank") <= F.col("budget")))


def sweep(daily: DataFrame | None, features: DataFrame, axes: dict[str, list[float]], p: Params = Params()) -> DataFrame:
    """Metrics of every parameter set, ranked by total percent; see sweep_trades."""
    j = sweep_trades(daily, features, axes, p)
    report = reports.trade_report(j, "param_id", "threshold", "min_filters", "budget")
    totals = j.groupBy("param_id").agg(F.sum("pnl_pct").alias("total_pct"))
    return by_total(report.join(totals, "param_id"))


def by_total(sets: DataFrame) -> DataFrame:
    """Parameter sets with their rank by total percent.

    Totals are compared to four places: sets that take the same trades are
    equal and go by their number, in whatever order their trades were added up.
    """
    return sets.withColumn("rank", F.row_number().over(Window.orderBy(places(F.col("total_pct"), 4).desc(), "param_id")))


def best_by_fold(trades: DataFrame, folds: DataFrame, key: str = "param_id") -> DataFrame:
    """Per fold the parameter set with the best train result, to four places, and its test result."""
    from ..operators.reconcile import assign_folds

    m = assign_folds(trades, folds).groupBy("fold", key).agg(F.sum(F.when(F.col("part") == "train", F.col("pnl_pct"))).alias("train_pct"), F.sum(F.when(F.col("part") == "test", F.col("pnl_pct"))).alias("test_pct"))
    order = Window.partitionBy("fold").orderBy(places(F.col("train_pct"), 4).desc_nulls_last(), key)
    return m.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
