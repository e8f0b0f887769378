"""Feature tables: daily, intraday, derived, strict rolling, breadth, and adjustment series.

All windows of a table share one partitioning and ordering, so each table
costs one exchange by symbol (or symbol and date).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import action_factor, as_int, candle_shape, entry_window, filter_score, gap, growth, ratio, setup_flags, true_range3


def by_date():
    return Window.partitionBy("symbol").orderBy("date")


def last_rows(n: int, skip: int = 0, order=None):
    """The frame of the last n rows, without the latest `skip`."""
    return (by_date() if order is None else order).rowsBetween(-n + 1, -skip)


def position_in_range(n: int) -> Column:
    """From the columns _low_n and _high_n: a window inside nullif would be evaluated for each place it is written."""
    return ratio(F.col("close") - F.col(f"_low_{n}"), F.col(f"_high_{n}") - F.col(f"_low_{n}"))


def known(column: str, df: DataFrame) -> Column:
    """The column with NaN as NULL: a price or volume that is not a number is not known."""
    c = F.col(column)
    return F.when(~F.isnan(c), c).alias(column) if dict(df.dtypes)[column] in ("double", "float") else c


def earlier(column: str, rows, name: str | None = None) -> dict[str, Column]:
    """name_k (column_k): the column that many rows before; columns that go as many rows back share a frame."""
    stem = name or (column if column.startswith("_") else f"_{column}")
    return {f"{stem}_{k}": F.lag(column, k).over(by_date()) for k in rows}


def added(columns: list[Column]) -> tuple[Column, Column]:
    """Sum of the columns that are known, and how many are; both 0 if none is."""
    return sum((F.coalesce(c, F.lit(0.0)) for c in columns[1:]), F.coalesce(columns[0], F.lit(0.0))), sum((as_int(c.isNotNull()) for c in columns[1:]), as_int(columns[0].isNotNull()))


def parts(column: str, n: int) -> dict[str, Column]:
    """column_sum_n and column_known_n of the last n rows, from the column and what earlier() gives."""
    total, count = added([F.col(column), *(F.col(f"{column}_{k}") for k in range(1, n))])
    return {f"{column}_sum_{n}": total, f"{column}_known_{n}": count}


def mean_of(groups: list[tuple[Column, Column]]) -> Column:
    """Mean over groups of rows (sum, how many are known); groups before a symbol's first row are NULL and have none."""
    total, count = (sum((F.coalesce(g[i], F.lit(0)) for g in groups[1:]), F.coalesce(groups[0][i], F.lit(0))) for i in (0, 1))
    return ratio(total, count)


def eight_rows(last: list[Column]) -> dict[str, Column]:
    """Extremes of the last eight values, of fewer on the first rows, and their mean, NULL there."""
    return {"_low_8": F.least(*last), "_high_8": F.greatest(*last), "_mean_8": sum(last[1:], last[0]) / 8}


def eight_moments(last: list[Column]) -> dict[str, Column]:
    """Variance of the last eight values and their covariance with the row number, about _mean_8."""
    away = [c - F.col("_mean_8") for c in last]
    return {"_var_8": sum((a * a for a in away[1:]), away[0] * away[0]) / 8, "_cov_8": sum((a * (3.5 - k) for k, a in enumerate(away[1:], 1)), away[0] * 3.5) / 8}


def daily_features(bars: DataFrame) -> DataFrame:
    """Returns, ranges, shapes, trailing means, positions, counters and trend of each daily bar.

    Trailing means begin on short frames and are over the values known in their
    frame: NULL and NaN are unknown, and a row without a close is no bar.  A
    frame is added up for itself, so a bad bar (infinite, or out of all
    proportion) has no effect on frames without it.  ma_20, ma_50, ma_65 and
    ma_200 are closes that many rows back, and close_lag_n names them as such;
    ma_7 and ma_65_sma are averages.
    """
    base = bars.select("symbol", "date", *(known(c, bars) for c in ("open", "high", "low", "close", "volume"))).where(F.col("close").isNotNull())
    o, h, l, x = (F.col(k) for k in ("open", "high", "low", "close"))
    lag = lambda n: F.col(f"close_lag_{n}")
    value = x * F.col("volume")
    base = base.withColumns({"_range": h - l, "_volume": F.col("volume").cast("double"), "_value": value.cast("double")})
    # windows, each over what the one before gives; rows are narrow there, as each window copies them.
    # Short frames are lags put together by expressions: a frame calls its aggregates for each of its rows again
    summed = ("_range", "_volume", "_value")
    base = base.withColumns(
        {f"close_lag_{n}": F.lag("close", n).over(by_date()) for n in (1, 2, 5, 10, 20, 50, 63, 65, 200, 252)}
        | earlier("close", (k for k in range(1, 8) if k not in (1, 2, 5)))
        | {k: v for c in summed for k, v in earlier(c, range(1, 4)).items()}
        | {"rn": F.row_number().over(by_date())}
    )
    closes = [x, *(lag(k) if k in (1, 2, 5) else F.col(f"_close_{k}") for k in range(1, 8))]
    base = base.withColumns({"ma_7": mean_of([added(closes[:7])]), **eight_rows(closes)})
    base = base.withColumns(eight_moments(closes) | {k: v for c in summed for k, v in parts(c, 4).items()} | parts("_range", 2))
    base = base.drop(*(f"_close_{k}" for k in (3, 4, 6, 7)), *(f"{c}_{k}" for c in summed for k in range(1, 4)), *summed)
    ret_1d = growth(x, lag(1))
    up, down = F.when(ret_1d >= 0.04, 1).otherwise(0), F.when(ret_1d <= -0.04, 1).otherwise(0)
    fours = lambda c, to: {k: v for n in range(4, to + 1, 4) for k, v in (earlier(f"{c}_sum_4", (n,)) | earlier(f"{c}_known_4", (n,))).items()}
    base = base.withColumns(
        widened(8, 63)
        | widened(8, TREND)
        | eights()
        | {k: v for c in summed for k, v in fours(c, 16).items()}
        | earlier("_range_sum_2", (12,))
        | earlier("_range_known_2", (12,))
        | {"_r2_so_far": F.regr_r2("close", "rn").over(so_far()), "_mean_so_far": F.avg("close").over(so_far()), "_ups": F.sum(up).over(so_far()), "_downs": F.sum(down).over(so_far())}
    ).drop("_low_8", "_high_8")
    group = lambda c, n, k: (F.col(f"{c}_sum_{n}_{k}" if k else f"{c}_sum_{n}"), F.col(f"{c}_known_{n}_{k}" if k else f"{c}_known_{n}"))
    twenty = lambda c: mean_of([group(c, 4, k) for k in range(0, 20, 4)])
    base = base.withColumns(
        {"atr_20": twenty("_range"), "vol_20": twenty("_volume"), "dollar_vol_20": twenty("_value"), "atr_14": mean_of([*(group("_range", 4, k) for k in (0, 4, 8)), group("_range", 2, 12)])}
    ).drop(*(f"{c}_{what}_{n}{k}" for c in summed for what in ("sum", "known") for n in (2, 4) for k in ("", "_4", "_8", "_12", "_16")))
    # the trend's terms between two windows: with all other columns in one step, the code of it would be too long to be compiled
    base = straightened(base, "_mean_65").drop("_mean_8", "_var_8", "_cov_8")
    base = base.withColumn("ma_65_sma", F.when(F.col("rn") >= TREND, F.col("_mean_65")).otherwise(F.col("_mean_so_far"))).drop("_mean_65", "_mean_so_far")
    base = base.withColumns(
        widened(63, 252) | {"breakout_4pct_up_30d": counted("_ups", 30), "breakout_4pct_up_90d": counted("_ups", 90), "breakdown_4pct_down_90d": counted("_downs", 90)} | earlier("atr_20", range(1, 8), "_atr")
    ).drop("_ups", "_downs")
    # the 49 rows before, in groups of seven
    atr, known_atrs = added([F.col(f"_atr_{k}") for k in range(1, 8)])
    base = base.withColumns({"_atr_sum": atr, "_atr_known": known_atrs}).drop(*(f"_atr_{k}" for k in range(1, 8)))
    base = base.withColumns(earlier("_atr_sum", range(7, 49, 7)) | earlier("_atr_known", range(7, 49, 7)))
    base = base.withColumn("_atr_before", mean_of([(F.col("_atr_sum"), F.col("_atr_known")), *((F.col(f"_atr_sum_{k}"), F.col(f"_atr_known_{k}")) for k in range(7, 49, 7))]))
    base = base.drop(*(f"_atr_{what}{k}" for what in ("sum", "known") for k in ("", *(f"_{n}" for n in range(7, 49, 7)))))
    return base.withColumns(
        {f"ret_{n}d": growth(x, lag(n)) for n in (1, 2, 5, 10, 20, 63, 252)}
        | {
            "true_range": h - l,
            "range_pct": ratio(h - l, x),
            "close_pos_in_range": ratio(x - l, h - l),
            "gap_open_vs_prev_close": gap(o, lag(1)),
            "gap_high_vs_prev_close": gap(h, lag(1)),
            "gap_low_vs_prev_close": gap(l, lag(1)),
            **candle_shape(o, h, l, x),
            "true_range3": true_range3(h, l, lag(1)),
            "dollar_vol": value,
            "rs_252": growth(x, lag(252)),
            "range_percentile_63": position_in_range(63),
            "range_percentile_252": position_in_range(252),
            "atr_compress_ratio": ratio(F.col("atr_20"), F.col("_atr_before")),
            "vol_dryup_ratio": ratio(F.col("volume"), F.col("vol_20")),
        }
        | {f"ma_{n}": lag(n) for n in (20, 50, 65, 200)}
    ).drop("_low_63", "_high_63", "_low_252", "_high_252", "_atr_before")


#: Rows of the trend: eight groups of eight and one more.
TREND = 65


def eights() -> dict[str, Column]:
    """Mean, variance and covariance with the row number of each eight rows of the last TREND, k rows back, and the close of the one row more."""
    back = lambda c, k: F.lag(c, k).over(by_date()) if k else F.col(c)
    return {f"{c}_{k}": back(c, k) for c in ("_mean_8", "_var_8", "_cov_8") for k in range(0, TREND - 1, 8)} | {"_first": F.lag("close", TREND - 1).over(by_date())}


def straightened(df: DataFrame, mean_as: str | None = None) -> DataFrame:
    """df with r2_65: R squared of the closes of the last 65 rows against their row numbers; 1 if they are all equal, NULL for one row.

    Variances of groups of eight rows are put together with those of their
    means, so nothing large is subtracted from something large, and a frame is
    not gone over row by row.  The first rows have the running _r2_so_far.
    mean_as names a column for the mean of the 65 rows; NULL before there are so many.
    """
    groups = range(0, TREND - 1, 8)
    g = lambda c, k: F.col(f"_{c}_8_{k}")
    # row numbers from the middle of the frame
    centre = lambda k: TREND // 2 - k - 3.5
    mean, first = F.col("_mean"), F.col("_first")
    df = df.withColumn("_mean", (sum(g("mean", k) for k in groups) * 8 + first) / TREND)
    away = lambda k: g("mean", k) - mean
    yy = sum((g("var", k) + away(k) * away(k) for k in groups), F.lit(0.0)) * 8 + (first - mean) * (first - mean)
    xy = sum((g("cov", k) + away(k) * centre(k) for k in groups), F.lit(0.0)) * 8 - (first - mean) * (TREND // 2)
    df = df.withColumns({"_yy": yy, "_xy": xy})
    full = F.when(F.col("_low_65") == F.col("_high_65"), 1.0).otherwise(F.col("_xy") * F.col("_xy") / (F.col("_yy") * (TREND * (TREND * TREND - 1) / 12)))
    out = df.withColumn("r2_65", F.when(F.col("rn") >= TREND, full).otherwise(F.col("_r2_so_far")))
    if mean_as:
        out = out.withColumn(mean_as, mean)
    return out.drop("_low_65", "_high_65", "_mean", "_yy", "_xy", "_first", "_r2_so_far", *(f"_{c}_8_{k}" for c in ("mean", "var", "cov") for k in groups))


def so_far():
    return by_date().rowsBetween(Window.unboundedPreceding, 0)


def counted(name: str, n: int) -> Column:
    """How many of the last n rows but the latest were counted in the running count; NULL on the first row.  Counts are whole, so their difference is exact."""
    return F.lag(name, 1).over(by_date()) - F.lag(name, n, 0).over(by_date())


def widened(m: int, n: int) -> dict[str, Column]:
    """_low_n and _high_n, the extremes of the last n rows, from those of the last m: of frames m rows apart, the last one overlapping, so that no row is gone over n times."""
    back = [*range(0, n - m, m), n - m]
    ends = {"low": F.least, "high": F.greatest}
    return {f"_{end}_{n}": f(*(F.lag(f"_{end}_{m}", k).over(by_date()) if k else F.col(f"_{end}_{m}") for k in back)) for end, f in ends.items()}


#: Names of the compatibility view and the feature columns behind them.
COMPATIBLE = {"range_percentile": "range_percentile_252", "prior_breakouts_30d": "breakout_4pct_up_30d", "prior_breakouts_90d": "breakout_4pct_up_90d", "prior_breakdowns_90d": "breakdown_4pct_down_90d"}


def compatibility_view(features: DataFrame) -> DataFrame:
    return features.withColumnsRenamed({old: new for new, old in COMPATIBLE.items()})


def derived_features(features: DataFrame, short: bool = False, null_mode: str = "propagate") -> DataFrame:
    """The compatibility view with lagged returns, the six setup flags and how many hold."""
    f = compatibility_view(features)
    lag = lambda n: F.lag("close", n).over(by_date())
    f = f.withColumns(
        {
            "prev_close": lag(1),
            "prev_open": F.lag("open", 1).over(by_date()),
            "prev_range": F.lag(F.col("high") - F.col("low"), 1).over(by_date()),
            "ret_1d_lag1": gap(lag(1), lag(2)),
            "ret_1d_lag2": gap(lag(2), lag(3)),
        }
    )
    flags = setup_flags(short)
    return f.withColumns(flags | {"filters_passed": filter_score(list(flags.values()), null_mode)})


def strict_features(bars: DataFrame) -> DataFrame:
    """Rolling features that are NULL until their window is full."""
    rows = lambda n: F.col("_known") - F.lag("_known", n, 0).over(by_date())
    full = lambda n, v: F.when(rows(n) >= n, v)
    x = F.col("close")
    b = bars.withColumns({"_lag": F.lag("close", 1).over(by_date()), "_n": F.row_number().over(by_date()), "_value": x * F.col("volume")})
    b = b.withColumn("true_range", F.coalesce(true_range3(F.col("high"), F.col("low"), F.col("_lag")), F.col("high") - F.col("low")))
    b = b.withColumn("ret_1d", growth(x, F.col("_lag")))
    # counts are whole, so the difference of running ones is exact, and no frame of theirs is gone over
    b = b.withColumns({"_known": F.count("close").over(so_far()), "_ups": F.sum(F.when(F.col("ret_1d") >= 0.04, 1).otherwise(0)).over(so_far())})
    b = b.withColumn("atr_20", full(20, F.avg("true_range").over(last_rows(20))))
    # mean and trend of 65 rows from groups of eight, as in daily_features
    eight = last_rows(8)
    b = b.withColumns({"rn": F.col("_n"), "_low_8": F.min("close").over(eight), "_high_8": F.max("close").over(eight), "_mean_8": F.avg("close").over(eight), "_var_8": F.var_pop("close").over(eight), "_cov_8": F.covar_pop("close", "_n").over(eight)})
    b = b.withColumns(widened(8, TREND) | {"_r2_so_far": F.lit(None).cast("double")}).drop("_low_8", "_high_8")
    b = straightened(b.withColumns(eights()), "_mean_65").drop("_mean_8", "_var_8", "_cov_8", "rn")
    low, high = F.min("low").over(last_rows(252)), F.max("high").over(last_rows(252))
    return b.withColumns(
        {
            "ret_5d": growth(x, F.lag("close", 5).over(by_date())),
            "ma_20": full(20, F.avg("close").over(last_rows(20))),
            "ma_65": full(65, F.col("_mean_65")),
            "rs_252": full(252, ratio(x, F.avg("close").over(last_rows(252))) - 1),
            "r2_65": full(65, F.col("r2_65")),
            "slope_65": full(65, F.regr_slope("close", "_n").over(last_rows(65))),
            "atr_compress_ratio": F.when(rows(70) >= 70, ratio(F.col("atr_20"), F.avg("atr_20").over(last_rows(50)))),
            "range_percentile": full(252, F.when(high == low, 0.5).otherwise((x - low) / F.nullif(high - low, F.lit(0)))),
            "vol_dryup_ratio": full(20, ratio(F.col("volume"), F.avg("volume").over(last_rows(20)))),
            "dollar_vol_20": full(20, F.avg("_value").over(last_rows(20))),
            "prior_breakouts_90d": F.coalesce(counted("_ups", 91), F.lit(0)),
        }
    ).drop("_lag", "_n", "_value", "_known", "_ups", "_mean_65")


def new_high_counts(bars: DataFrame, look_back: int = 20, count_over: int = 90) -> DataFrame:
    """Closes above all highs of the look_back rows before, and how many of them the count_over rows before hold."""
    flag = F.col("close") > F.max("high").over(by_date().rowsBetween(-look_back, -1))
    b = bars.withColumn("new_high", F.coalesce(flag, F.lit(False)))
    return b.withColumn("prior_new_highs", F.coalesce(F.sum(F.col("new_high").cast("int")).over(by_date().rowsBetween(-count_over, -1)), F.lit(0)))


def previous_session(bars: DataFrame, daily: DataFrame) -> DataFrame:
    """Intraday bars with the high, low and close of the session before theirs; an equi join on the next session's date."""
    before = daily.select("symbol", F.lead("date").over(by_date()).alias("date"), *(F.col(c).alias(f"prior_day_{c}") for c in ("high", "low", "close")))
    return bars.join(before.where(F.col("date").isNotNull()), ["symbol", "date"], "left")


def intraday_features(bars: DataFrame, daily: DataFrame) -> DataFrame:
    """Opening ranges, first hour, breakouts of the session before, volume share and entry window of each bar."""
    day = Window.partitionBy("symbol", "date")
    running = day.orderBy("candle_time").rowsBetween(Window.unboundedPreceding, 0)
    b = previous_session(bars.where(F.col("volume").isNotNull()), daily)
    b = b.withColumns({"rn_5min": F.row_number().over(day.orderBy("candle_time")), "candles_per_day": F.count("*").over(day), "dollar_vol": F.col("close") * F.col("volume")})
    first = lambda n, column: F.when(F.col("rn_5min") <= n, F.col(column))
    out = {}
    for minutes, n in ((15, 3), (30, 6), (60, 12)):
        out[f"or_{minutes}min_high"] = F.max(first(n, "high")).over(running)
        out[f"or_{minutes}min_low"] = F.min(first(n, "low")).over(running)
    above, below = F.col("high") > F.col("prior_day_high"), F.col("low") < F.col("prior_day_low")
    b = b.withColumns(
        out
        | {
            "first_hour_high": F.max(first(12, "high")).over(day),
            "first_hour_low": F.min(first(12, "low")).over(day),
            "first_hour_avg_vol": F.avg(first(12, "volume")).over(day),
            "first_breakout_time": F.when(above, F.min(F.when(above, F.col("candle_time"))).over(running)),
            "first_breakdown_time": F.when(below, F.min(F.when(below, F.col("candle_time"))).over(running)),
            "gap_open_pct": gap(F.col("open"), F.col("prior_day_close")),
            "_so_far": F.sum("volume").over(running),
            "_total": F.sum("volume").over(day),
            "entry_window": entry_window(F.col("rn_5min")),
        }
    )
    b = b.withColumn("volume_percentile", ratio(F.col("_so_far"), F.col("_total"))).drop("_so_far", "_total")
    return b.withColumns({"range_expansion_vs_15min": gap(F.col("high"), F.col("or_15min_high")), "range_contraction_vs_15min": gap(F.col("low"), F.col("or_15min_low"))}).where(F.col("close").isNotNull())


def eligible(features: DataFrame, min_price: float = 10.0, min_value: float = 3_000_000.0) -> DataFrame:
    """Features with 40-row averages, trailing extremes, and whether the row counts for breadth."""
    # from groups of eight rows, and those from lags: frames of up to 65 rows would be gone over for each row
    f = features.withColumns(earlier("close", range(1, 8)))
    last = [F.col("close"), *(F.col(f"_close_{k}") for k in range(1, 8))]
    total, count = added(last)
    f = f.withColumns({"_sum_8": total, "_known_8": count, "_low_8": F.least(*last), "_high_8": F.greatest(*last)}).drop(*(f"_close_{k}" for k in range(1, 8)))
    back = range(8, 40, 8)
    f = f.withColumns(earlier("_sum_8", back) | earlier("_known_8", back) | {k[1:]: v for n in (20, 34, 65) for k, v in widened(8, n).items()})
    groups = [(F.col(f"_sum_8{k}"), F.col(f"_known_8{k}")) for k in ("", *(f"_{k}" for k in back))]
    f = f.withColumns({"ma_40": mean_of(groups), "ma_40_count": sum((F.coalesce(n, F.lit(0)) for _, n in groups), F.lit(0)).cast("long")})
    f = f.drop("_low_8", "_high_8", *(f"_{what}_8{k}" for what in ("sum", "known") for k in ("", *(f"_{k}" for k in back))))
    good = (F.col("close") >= min_price) & (F.col("dollar_vol_20") >= min_value) & (F.col("ma_40_count") == 40) & F.col("ma_20").isNotNull() & F.col("atr_20").isNotNull()
    return f.withColumn("is_eligible", F.coalesce(good, F.lit(False)))


def breadth(features: DataFrame, min_price: float = 10.0, min_value: float = 3_000_000.0) -> DataFrame:
    """One row per date: counts and shares over eligible symbols, up/down ratios, regime, posture and alert flags."""
    e = eligible(features, min_price, min_value)
    x = F.col("close")
    tests = {
        "universe_size": F.lit(True),
        "up_4pct_count": F.col("ret_1d") >= 0.04,
        "down_4pct_count": F.col("ret_1d") <= -0.04,
        "above_ma20_count": x > F.col("ma_20"),
        "below_ma20_count": x <= F.col("ma_20"),
        "above_ma40_count": x > F.col("ma_40"),
        "below_ma40_count": x <= F.col("ma_40"),
        "up_25q_count": x >= F.col("low_65") * 1.25,
        "down_25q_count": x <= F.col("high_65") * 0.75,
        "up_25m_count": x >= F.col("low_20") * 1.25,
        "down_25m_count": x <= F.col("high_20") * 0.75,
        "up_50m_count": x >= F.col("low_20") * 1.50,
        "down_50m_count": x <= F.col("high_20") * 0.50,
        "up_13_34_count": x >= F.col("low_34") * 1.13,
        "down_13_34_count": x <= F.col("high_34") * 0.87,
    }
    d = e.groupBy("date").agg(*(F.count_if(F.col("is_eligible") & t).alias(n) for n, t in tests.items()))
    # one row per date is small; its windows need no partition
    order = Window.orderBy("date")
    share = lambda n: F.col(n) * 100.0 / F.nullif(F.col("universe_size"), F.lit(0))
    sums = {n: (F.sum("up_4pct_count").over(last_rows(n, 0, order)), F.sum("down_4pct_count").over(last_rows(n, 0, order))) for n in (5, 10)}
    d = d.withColumns({f"ratio_{n}d": up.cast("double") / F.nullif(down, F.lit(0)) for n, (up, down) in sums.items()})
    d = d.withColumns({n.replace("_count", "_pct"): share(n) for n in tests if n.endswith("_count") and "25m" not in n and "50m" not in n and "13_34" not in n})
    bull, bear = F.col("up_25q_count") > F.col("down_25q_count") * 1.1, F.col("down_25q_count") > F.col("up_25q_count") * 1.1
    strong, weak = bull & (F.col("ratio_10d") >= 2.0), bear & (F.col("ratio_10d") <= 0.5)
    correcting, rebounding = bull & (F.col("ratio_10d") < 2.0), bear & (F.col("ratio_10d") > 0.5)
    flags = F.when(strong, F.array(F.lit("bullish_thrust"), F.lit("long_favored"))).when(weak, F.array(F.lit("bearish_thrust"), F.lit("short_favored")))
    flags = flags.when(correcting, F.array(F.lit("bullish_regime"), F.lit("correction_watch"))).when(rebounding, F.array(F.lit("bearish_regime"), F.lit("rebound_watch"))).otherwise(F.array(F.lit("mixed")))
    return d.withColumns(
        {
            "primary_regime": F.when(bull, "bullish").when(bear, "bearish").otherwise("transition"),
            "tactical_regime": F.when(strong, "long_favored").when(weak, "short_favored").when(rebounding, "rebound_watch").when(correcting, "correction_watch").otherwise("mixed"),
            "aggression_score": F.when(strong, 2.0).when(weak, -2.0).when(bull, 1.0).when(bear, -1.0).otherwise(0.0),
            "posture_label": F.when(strong | weak, "aggressive").when(bull | bear, "standard").otherwise("defensive"),
            "alert_flags": flags,
        }
    )


def breadth_ratio(features: DataFrame, min_price: float = 10.0) -> DataFrame:
    """Share of symbols at or above min_price whose close is below ma_20, per date."""
    known = (F.col("close") >= min_price) & F.col("ma_20").isNotNull()
    below = F.sum(F.when(known & (F.col("close") < F.col("ma_20")), 1).otherwise(0))
    return features.groupBy("date").agg((below / F.nullif(F.sum(F.when(known, 1).otherwise(0)), F.lit(0))).alias("below_ma20_share"))


def adjustment_series(bars: DataFrame, actions: DataFrame, ex_date_inclusive: bool = True) -> DataFrame:
    """Bars with adj_factor and adjusted prices.

    A bar's factor is the product of the factors of all actions after it, and
    with ex_date_inclusive of those on its own date.  Products are taken on
    the small table of actions; each bar then takes the next action's.
    """
    f = actions.groupBy("symbol", "ex_date").agg(F.collect_list(action_factor(F.col("action_type"), F.col("ratio_num"), F.col("ratio_den"))).alias("_fs"))
    product = lambda c: F.aggregate(c, F.lit(1.0), lambda a, b: a * b)
    later = Window.partitionBy("symbol").orderBy("ex_date").rowsBetween(0, Window.unboundedFollowing)
    f = f.select("symbol", "ex_date", product(F.col("_fs")).alias("_f")).withColumn("_all", product(F.collect_list("_f").over(later)))
    marks = f.select("symbol", F.col("ex_date").alias("date"), F.lit(0 if ex_date_inclusive else -1).alias("_kind"), F.col("_all"))
    rows = bars.withColumns({"_kind": F.lit(1 if not ex_date_inclusive else -1), "_all": F.lit(None).cast("double")})
    both = rows.unionByName(marks, allowMissingColumns=True).withColumn("_bar", F.col("_kind") == (1 if not ex_date_inclusive else -1))
    # from the last row back, as a frame that grows is added to; one that shrinks would be gone over whole for each row
    later_rows = Window.partitionBy("symbol").orderBy(F.desc("date"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, -1)
    out = both.withColumn("adj_factor", F.coalesce(F.last("_all", ignorenulls=True).over(later_rows), F.lit(1.0))).where("_bar")
    return out.withColumns({f"adj_{c}": F.col(c) * F.col("adj_factor") for c in ("open", "high", "low", "close")}).drop("_kind", "_all", "_bar")


def continuity_breaks(adjusted: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Rows where the factor changes but the adjusted close moves by more than the raw move explains."""
    a = adjusted.withColumns({"_f": F.lag("adj_factor").over(by_date()), "_c": F.lag("adj_close").over(by_date())})
    jump = F.abs(ratio(F.col("adj_close"), F.col("_c")) - 1)
    return a.where((F.col("_f") != F.col("adj_factor")) & (jump > tolerance)).withColumn("jump", jump).drop("_f", "_c")
