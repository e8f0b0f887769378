"""Rounded numbers and ranks that do not hang on the last bits of a sum."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from barloom.functions.expressions import places
from barloom.plans import research


def test_places_round_the_scaled_number(spark):
    # 0.00005450 ends in a five in decimal digits, or not, by the last bit of the double
    values = [2.4999999999999998e-06, 5.4499999999999997e-05, 0.0002445, -0.0002445, 1.25, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    want = [None if v is None else (1 if v > 0 else -1) * int(abs(v) * 1e6 + 0.5) / 1e6 for v in values]
    assert [r.x for r in df.select(places(F.col("v"), 6).alias("x")).collect()] == want


def test_equal_totals_rank_by_number(spark):
    sets = spark.createDataFrame([(0, 0.3), (1, 0.1 + 0.2), (2, 7.0)], "param_id long, total_pct double")
    assert {r.param_id: r["rank"] for r in research.by_total(sets).collect()} == {2: 1, 0: 2, 1: 3}


def test_equal_train_results_go_to_the_first_set(spark):
    day = date(2024, 1, 2)
    trades = spark.createDataFrame([(0, day, 0.3), (1, day, 0.1), (1, day, 0.2)], "param_id long, date date, pnl_pct double")
    folds = spark.createDataFrame([(0, date(2024, 1, 1), date(2024, 1, 31), date(2024, 2, 1), date(2024, 2, 9))], "fold int, train_start date, train_end date, test_start date, test_end date")
    assert [r.param_id for r in research.best_by_fold(trades, folds).collect()] == [0]
