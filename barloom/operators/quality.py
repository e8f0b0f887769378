"""Data quality: row rules, coverage rules, registry of issues, reports, and gates on results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import growth, ratio
from ..sources.bars import PRICES, minute_of_day
from .features import by_date

#: Issue codes and their severities.
SEVERITIES = {
    "OHLC_VIOLATION": "CRITICAL", "NULL_PRICE": "CRITICAL", "ZERO_PRICE": "CRITICAL", "TIMESTAMP_INVALID": "CRITICAL", "DUPLICATE_CANDLE": "CRITICAL",
    "EXTREME_CANDLE": "WARNING", "DATE_GAP": "WARNING", "ZERO_VOLUME_DAY": "INFO", "EXTREME_MOVE": "WARNING", "MISSING_5MIN_COVERAGE": "WARNING", "SHORT_HISTORY": "INFO",
}


def bad_range() -> Column:
    return (F.col("high") < F.col("low")) | (F.col("close") > F.col("high")) | (F.col("close") < F.col("low")) | (F.col("open") > F.col("high")) | (F.col("open") < F.col("low"))


def any_price(test) -> Column:
    out = F.lit(False)
    for c in PRICES:
        out |= F.coalesce(test(F.col(c)), F.lit(False))
    return out


def intraday_rules(session: tuple[int, int] = (555, 930), extreme: float = 0.50) -> dict[str, Column]:
    return {
        "OHLC_VIOLATION": bad_range(),
        "NULL_PRICE": any_price(lambda p: p.isNull()),
        "ZERO_PRICE": any_price(lambda p: p <= 0),
        "TIMESTAMP_INVALID": ~minute_of_day(F.col("candle_time")).between(*session),
        "EXTREME_CANDLE": ratio(F.col("high") - F.col("low"), F.col("open")) > extreme,
    }


def flagged(bars: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(symbol, date, issue_code) of each rule that a row breaks; all rules in one scan."""
    found = F.array_compact(F.array(*(F.when(t, F.lit(c)) for c, t in rules.items())))
    return bars.select("symbol", "date", F.explode(found).alias("issue_code"))


def observed(bars: DataFrame, rules: dict[str, Column], name: str) -> tuple[DataFrame, Observation]:
    """bars as they are, and counts of all rows and of those that break each rule, known once something has read bars: no scan of their own.

    The counts are of rows that pass here; a task that runs twice is counted once.
    """
    counts = Observation(name)
    return bars.observe(counts, F.count("*").alias("n_rows"), *(F.count_if(F.coalesce(t, F.lit(False))).alias(c) for c, t in rules.items())), counts


def by_symbol(found: DataFrame) -> DataFrame:
    """One row per symbol and code: rows, first and last date."""
    return found.groupBy("symbol", "issue_code").agg(F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def in_window(df: DataFrame, start=None, end=None) -> DataFrame:
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(end).cast("date"))
    return df


def duplicate_bars(bars: DataFrame) -> DataFrame:
    d = bars.groupBy("symbol", "date", "candle_time").count().where("count > 1")
    return d.select("symbol", "date", F.lit("DUPLICATE_CANDLE").alias("issue_code"))


def date_gaps(daily: DataFrame, days: int = 7, start=None, end=None) -> DataFrame:
    """The bar after each gap of more than `days` days; the window applies to the gaps."""
    g = daily.select("symbol", "date").distinct().withColumn("_before", F.lag("date").over(by_date()))
    return in_window(g.where(F.datediff("date", "_before") > days), start, end).select("symbol", "date", F.lit("DATE_GAP").alias("issue_code"))


def extreme_moves(daily: DataFrame, move: float = 0.30) -> DataFrame:
    m = daily.withColumn("_r", growth(F.col("close"), F.lag("close").over(by_date())))
    return m.where(F.abs("_r") > move).select("symbol", "date", F.lit("EXTREME_MOVE").alias("issue_code"))


def missing_intraday(daily: DataFrame, bars: DataFrame) -> DataFrame:
    """Days of a daily bar without any intraday one."""
    days = daily.select("symbol", "date").distinct().join(bars.select("symbol", "date").distinct(), ["symbol", "date"], "left_anti")
    return days.withColumn("issue_code", F.lit("MISSING_5MIN_COVERAGE"))


def short_history(daily: DataFrame, least: int = 252) -> DataFrame:
    s = daily.groupBy("symbol").agg(F.countDistinct("date").alias("n"), F.max("date").alias("date")).where(F.col("n") < least)
    return s.select("symbol", "date", F.lit("SHORT_HISTORY").alias("issue_code"))


def scan(daily: DataFrame, bars: DataFrame, start=None, end=None, fast: bool = False, session: tuple[int, int] = (555, 930)) -> DataFrame:
    """All issues (symbol, date, issue_code), each once; fast leaves out the rules that look across rows.  The window binds every rule."""
    out = flagged(in_window(bars, start, end), intraday_rules(session))
    out = out.union(flagged(in_window(daily, start, end), {"ZERO_VOLUME_DAY": F.col("volume") == 0}))
    if not fast:
        out = out.union(duplicate_bars(in_window(bars, start, end)))
        out = out.union(date_gaps(daily, 7, start, end)).union(in_window(extreme_moves(daily), start, end))
        out = out.union(in_window(missing_intraday(daily, bars), start, end)).union(short_history(daily))
    return out.distinct()


def severity(code: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in SEVERITIES.items() for x in pair)), code)


def date_gate(found: DataFrame, date) -> DataFrame:
    """Whether a date is free of blocking issues, and what blocks it."""
    bad = found.where((F.col("date") == F.lit(date).cast("date")) & (severity(F.col("issue_code")) == "CRITICAL"))
    return bad.agg((F.count("*") == 0).alias("ready"), F.count("*").alias("n_issues"), F.sort_array(F.collect_set("issue_code")).alias("codes"))


def upsert_issues(registry: DataFrame, found: DataFrame, seen_on) -> DataFrame:
    """A new registry: found issues inserted or active again with first and last seen; others inactive, acknowledged ones stay so."""
    new = found.groupBy("symbol", "issue_code").agg(F.count("*").alias("_n"))
    old = registry.select("symbol", "issue_code", F.col("is_active").alias("_active"), F.col("acknowledged").alias("_ack"), F.col("first_seen").alias("_first"), F.col("last_seen").alias("_last"))
    m = new.join(old, ["symbol", "issue_code"], "full")
    today = F.lit(seen_on).cast("date")
    return m.select(
        "symbol", "issue_code", severity(F.col("issue_code")).alias("severity"), F.col("_n").isNotNull().alias("is_active"), F.coalesce("_ack", F.lit(False)).alias("acknowledged"),
        F.coalesce("_first", today).alias("first_seen"), F.when(F.col("_n").isNotNull(), today).otherwise(F.col("_last")).alias("last_seen"), F.coalesce("_n", F.lit(0)).alias("n_rows"),
    )


def acknowledge(registry: DataFrame, symbols: DataFrame, code: str) -> DataFrame:
    hit = symbols.select("symbol", F.lit(True).alias("_hit")).distinct()
    return registry.join(hit, "symbol", "left").withColumn("acknowledged", F.col("acknowledged") | (F.coalesce("_hit", F.lit(False)) & (F.col("issue_code") == code))).drop("_hit")


def validate_rows(rows: DataFrame, min_price: float = 0.01, max_price: float = 100_000.0, max_volume: float = 1e10, max_gap: int = 5, max_move: float = 0.50, spike: float = 20.0) -> DataFrame:
    """Per symbol: issues by type, whether it passes (no errors), and a score of 1 less weighted issues per row."""
    c = F.col
    w = Window.partitionBy("symbol")
    b = rows.withColumns({"_before": F.lag("close").over(by_date()), "_day": F.lag("date").over(by_date()), "_median": F.median("volume").over(w), "_twice": F.count("*").over(Window.partitionBy("symbol", "date"))})
    errors = {
        "missing_ohlc": any_price(lambda p: p.isNull()),
        "price_low": any_price(lambda p: p < min_price),
        "price_high": any_price(lambda p: p > max_price),
        "ohlc_order": bad_range(),
        "negative_volume": c("volume") < 0,
        "duplicate": c("_twice") > 1,
    }
    warnings = {
        "zero_volume": c("volume") == 0,
        "huge_volume": c("volume") > max_volume,
        "date_gap": F.datediff("date", "_day") > max_gap,
        "extreme_return": F.abs(growth(c("close"), c("_before"))) > max_move,
        "volume_spike": (c("_median") > 0) & (c("volume") > c("_median") * spike),
    }
    counts = [F.count_if(t).alias(n) for n, t in (errors | warnings).items()]
    out = b.groupBy("symbol").agg(F.count("*").alias("n_rows"), *counts)
    total = lambda names: sum((c(n) for n in names), F.lit(0))
    out = out.withColumns({"n_errors": total(errors), "n_warnings": total(warnings)})
    return out.withColumns({"passed": c("n_errors") == 0, "score": F.greatest(F.lit(0.0), F.lit(1.0) - (c("n_errors") * 1.0 + c("n_warnings") * 0.25) / c("n_rows"))})


#: Issues of validate_rows that are errors; the others are warnings.
ROW_ERRORS = ("missing_ohlc", "price_low", "price_high", "ohlc_order", "negative_volume", "duplicate")
ROW_WARNINGS = ("zero_volume", "huge_volume", "date_gap", "extreme_return", "volume_spike")


def quality_summary(validated: DataFrame) -> DataFrame:
    """One row over the symbols of validate_rows: passed and failed, pass rate, mean and median score, issues by severity and by type."""
    one = validated.agg(
        F.count("*").alias("total_symbols"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.avg(F.col("passed").cast("int")).alias("pass_rate"),
        F.avg("score").alias("avg_score"), F.median("score").alias("median_score"), F.coalesce(F.sum(F.col("n_errors") + F.col("n_warnings")), F.lit(0)).alias("total_issues"),
        F.coalesce(F.sum("n_errors"), F.lit(0)).alias("errors"), F.coalesce(F.sum("n_warnings"), F.lit(0)).alias("warnings"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*ROW_ERRORS, *ROW_WARNINGS)),
    )
    breakdown = [F.struct(F.lit(f"{c}:{level}").alias("issue"), F.col(c).alias("n")) for names, level in ((ROW_ERRORS, "error"), (ROW_WARNINGS, "warning")) for c in names]
    return one.withColumn("issue_breakdown", F.filter(F.array(*breakdown), lambda x: x["n"] > 0)).drop(*ROW_ERRORS, *ROW_WARNINGS)


def monitor(daily: DataFrame, date, universe: int = 500, move: float = 0.20, volume_times: float = 10.0) -> DataFrame:
    """Checks of one date against the days before: rows, missing prices, bad ranges, large moves, volume spikes, coverage of symbols."""
    day = F.lit(date).cast("date")
    recent = daily.where(F.col("date").between(F.date_sub(day, 120), day))
    b = recent.withColumns({"_before": F.lag("close").over(by_date()), "_usual": F.avg("volume").over(by_date().rowsBetween(-60, -1))})
    known = recent.select("symbol").distinct().agg(F.count("*").alias("known_symbols"))
    d = b.where(F.col("date") == day).agg(
        F.count("*").alias("n_rows"), F.countDistinct("symbol").alias("n_symbols"), F.count_if(any_price(lambda p: p.isNull())).alias("null_prices"), F.count_if(bad_range()).alias("bad_ranges"),
        F.count_if(F.abs(growth(F.col("close"), F.col("_before"))) > move).alias("large_moves"), F.count_if(F.col("volume") > F.col("_usual") * volume_times).alias("volume_spikes"),
    )
    d = d.join(F.broadcast(known))
    return d.withColumns({"symbol_coverage": F.col("n_symbols") / F.nullif(F.col("known_symbols"), F.lit(0)), "status": F.when(F.col("n_rows") == 0, "NO_DATA").when(F.col("n_symbols") < universe, "THIN").otherwise("OK")})


def business_days(first: Column, last: Column) -> Column:
    return F.size(F.filter(F.sequence(first, last), lambda d: F.dayofweek(d).between(2, 6)))


def dataset_report(daily: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Rows, days, missing and invalid values, duplicates, missing symbols, coverage of business days, and a verdict."""
    twice = daily.groupBy("symbol", "date").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))
    r = daily.agg(
        F.count("*").alias("n_rows"), F.countDistinct("symbol").alias("n_symbols"), F.countDistinct("date").alias("n_days"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.count_if(any_price(lambda p: p.isNull())).alias("null_prices"), F.count_if(bad_range()).alias("bad_ranges"), F.count_if(any_price(lambda p: p <= 0)).alias("nonpositive"), F.count_if(F.col("volume") < 0).alias("negative_volume"),
    ).join(F.broadcast(twice))
    absent = F.lit(0).cast("long")
    if symbols is not None:
        gone = symbols.select("symbol").distinct().join(daily.select("symbol").distinct(), "symbol", "left_anti").agg(F.count("*").alias("missing_symbols"))
        r = r.join(F.broadcast(gone))
    else:
        r = r.withColumn("missing_symbols", absent)
    c = F.col
    bad = c("null_prices") + c("bad_ranges") + c("nonpositive") + c("negative_volume") + c("duplicates")
    return r.withColumns({"coverage": c("n_days") / F.nullif(business_days(c("first_date"), c("last_date")), F.lit(0)), "verdict": F.when((c("n_rows") == 0) | (bad > 0), "FAIL").when(c("missing_symbols") > 0, "WARN").otherwise("PASS")})


def quarantine(raw: DataFrame, required: tuple[str, ...] = ("symbol", "date", *PRICES)) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others with a reason; columns that are missing altogether are an error."""
    if lacking := [c for c in required if c not in raw.columns]:
        raise ValueError(f"missing columns: {lacking}")
    empty = F.lit(False)
    for c in required:
        empty |= F.col(c).isNull()
    why = F.when(empty, "null_value").when(F.col("high") < F.col("low"), "high_below_low")
    marked = raw.withColumn("reason", why)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def read_checked(spark: SparkSession, path: str, schema: T.StructType, required: tuple[str, ...] = ("symbol", "date", *PRICES), **options: str) -> DataFrame:
    """Delimited files as rows of the schema with reason, NULL for a valid row, and line, the text of a malformed one.

    A line with too few or too many fields, or with a field that is not of its
    type, is malformed; then come values that are missing, a high below the low,
    prices outside of both, and a negative volume.  Valid and bad rows come from
    one scan: write_checked() keeps them apart in one job.
    """
    if lacking := [c for c in required if c not in schema.names]:
        raise ValueError(f"missing columns: {lacking}")
    whole = T.StructType([*schema.fields, T.StructField("line", T.StringType())])
    raw = spark.read.schema(whole).options(**({"header": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "line"} | options)).csv(path)
    empty = F.lit(False)
    for c in required:
        empty |= F.col(c).isNull()
    c = F.col
    outside = (F.least("open", "close") < c("low")) | (F.greatest("open", "close") > c("high"))
    why = F.when(c("line").isNotNull(), "malformed_line").when(empty, "null_value").when(c("high") < c("low"), "high_below_low").when(outside, "price_outside_range")
    if "volume" in schema.names:
        why = why.when(c("volume") < 0, "negative_volume")
    return raw.withColumn("reason", why)


def write_checked(rows: DataFrame, path: str) -> None:
    """Rows of read_checked() below kept=true and kept=false, in one job."""
    rows.withColumn("kept", F.col("reason").isNull()).write.mode("overwrite").partitionBy("kept").parquet(path)


def dead_symbols(daily: DataFrame, listed: DataFrame) -> DataFrame:
    """Stored symbols that are no longer listed, with their rows and dates."""
    return daily.join(listed.select("symbol").distinct(), "symbol", "left_anti").groupBy("symbol").agg(F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def result_gates(summary: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Each metric of each experiment against thresholds (strategy, metric, warn, fail, higher_is_better): OK, WARNING or ERROR.

    Thresholds are a small table of rules; experiments are unpivoted once.
    """
    names = [c for c, t in summary.dtypes if t in ("double", "bigint", "int") and c not in ("exp_id", "strategy")]
    long = summary.select("exp_id", "strategy", F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names))).alias("m")).select("exp_id", "strategy", "m.*")
    j = long.join(thresholds, ["strategy", "metric"])
    past = lambda limit: F.when(F.col("higher_is_better"), F.col("value") < F.col(limit)).otherwise(F.col("value") > F.col(limit))
    return j.withColumn("severity", F.when(past("fail"), "ERROR").when(past("warn"), "WARNING").otherwise("OK"))


def regressions(baseline: DataFrame, current: DataFrame, warn: float = 0.10, error: float = 0.25) -> DataFrame:
    """Relative change of each metric (strategy, metric, value) against the baseline; a missing side is an error."""
    j = baseline.withColumnRenamed("value", "base").join(current.withColumnRenamed("value", "now"), ["strategy", "metric"], "full")
    change = ratio(F.col("now") - F.col("base"), F.abs("base"))
    return j.withColumn("change", change).withColumn("severity", F.when(F.col("base").isNull() | F.col("now").isNull(), "ERROR").when(F.col("change") <= -error, "ERROR").when(F.col("change") <= -warn, "WARNING").otherwise("OK"))
