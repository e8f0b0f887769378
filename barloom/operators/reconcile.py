"""Comparing two sources of the same rows: full outer joins, classified field by field."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reconcile_bars(live: DataFrame, stored: DataFrame, price_tolerance: float = 0.01, volume_tolerance: float = 0.5, relative: bool = False) -> DataFrame:
    """One row per difference of bars, by symbol, date and HH:MM: missing, extra, price or volume.

    Prices differ by more than price_tolerance, absolute or (relative=True) as
    a share of the stored one; volumes by a share of the stored one.
    """
    fields = ("open", "high", "low", "close", "volume")
    key = ["symbol", "date", "bar"]
    shape = lambda df, p: df.select("symbol", F.to_date("candle_time").alias("date"), F.date_format("candle_time", "HH:mm").alias("bar"), *(F.col(f).cast("double").alias(f"{p}{f}") for f in fields), F.lit(True).alias(f"{p}is"))
    j = shape(live, "l_").join(shape(stored, "s_"), key, "full")
    parts = []
    for f in fields:
        off = F.abs(F.col(f"l_{f}") - F.col(f"s_{f}"))
        if f == "volume" or relative:
            share = volume_tolerance if f == "volume" else price_tolerance
            differs = off > F.abs(f"s_{f}") * share
        else:
            differs = off > price_tolerance
        parts.append(F.when(differs, F.struct(F.lit("volume_diff" if f == "volume" else "price_diff").alias("kind"), F.lit(f).alias("field"), F.col(f"l_{f}").alias("live"), F.col(f"s_{f}").alias("stored"))))
    side = lambda kind: F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("double").alias("live"), F.lit(None).cast("double").alias("stored"))
    found = F.when(F.col("l_is").isNull(), F.array(side("missing"))).when(F.col("s_is").isNull(), F.array(side("extra"))).otherwise(F.array_compact(F.array(*parts)))
    return j.select(*key, F.explode(found).alias("d")).select(*key, "d.*")


def parity(left: DataFrame, right: DataFrame, keys: list[str], warn: float = 0.001, error: float = 0.01) -> DataFrame:
    """Per key: on one side only, direction or reason differs, entry price off by a share, or equal."""
    fields = ["direction", "entry_price", "exit_reason"]
    l = left.select(*keys, *(F.col(f).alias(f"l_{f}") for f in fields), F.lit(True).alias("l_is"))
    r = right.select(*keys, *(F.col(f).alias(f"r_{f}") for f in fields), F.lit(True).alias("r_is"))
    off = F.abs(F.col("l_entry_price") - F.col("r_entry_price")) / F.nullif(F.abs("r_entry_price"), F.lit(0.0))
    kind = (
        F.when(F.col("r_is").isNull(), "left_only")
        .when(F.col("l_is").isNull(), "right_only")
        .when(F.col("l_direction") != F.col("r_direction"), "direction")
        .when(off > error, "error")
        .when(off > warn, "warn")
        .when(~F.col("l_exit_reason").eqNullSafe(F.col("r_exit_reason")), "reason")
        .otherwise("equal")
    )
    return l.join(r, keys, "full").select(*keys, kind.alias("parity"), off.alias("price_off"))


def with_names(rows: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """A name from a lookup table; unknown keys get NULL."""
    return rows.join(names.select(key, name), key, "left")


def by_alias(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Symbols replaced by what they were an alias of on the row's date; of several the one valid last.

    The aliases meet the distinct symbols and dates, so repeated rows stay what
    they are.  A row without a date, or whose date no validity holds, keeps its symbol.
    """
    a = aliases.select(F.col("alias").alias("symbol"), F.col("symbol").alias("_to"), F.coalesce("valid_from", F.lit("0001-01-01").cast("date")).alias("_from"), F.coalesce("valid_to", F.lit("9999-12-31").cast("date")).alias("_until"))
    days = rows.select("symbol", "date").distinct().join(a, "symbol").where(F.col("date").between(F.col("_from"), F.col("_until")))
    named = days.groupBy("symbol", "date").agg(F.max_by("_to", F.struct("_from", "_to")).alias("_to"))
    return rows.join(named, ["symbol", "date"], "left").withColumn("symbol", F.coalesce("_to", "symbol")).select(rows.columns)


def missing_symbols(universe: DataFrame, table: DataFrame) -> DataFrame:
    return universe.select("symbol").distinct().join(table.select("symbol").distinct(), "symbol", "left_anti")


def latest_before(bars: DataFrame, date) -> DataFrame:
    """Each symbol's last bar before a date."""
    return bars.where(F.col("date") < F.lit(date).cast("date")).groupBy("symbol").agg(F.max("date").alias("date"), F.max_by("close", "date").alias("close"))


def assign_folds(rows: DataFrame, folds: DataFrame, date: str = "date") -> DataFrame:
    """Rows of each fold's train and test windows.

    Folds meet the distinct dates of the rows, which are few; the rows then
    join those by equal date, so no range join runs over rows.
    """
    f = folds.select("fold", "train_start", "train_end", "test_start", "test_end")
    d = F.col(date)
    test = d.between(F.col("test_start"), F.col("test_end"))
    days = rows.select(date).distinct().join(f, d.between(F.col("train_start"), F.col("train_end")) | test)
    return rows.join(days.withColumn("part", F.when(test, "test").otherwise("train")), date)
