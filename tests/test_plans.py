"""The physical plans that the design relies on."""

from __future__ import annotations

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from barloom.operators import candidates, features, outcomes, quality
from barloom.operators.candidates import Params
from barloom.plans import incremental
from barloom.sources import bars as src


@pytest.fixture(scope="module")
def store(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "daily")
    src.append_bars(spark, path, src.daily_from_lineitem(spark, sf), ["symbol", "date"], "overwrite")
    return src.read_bars(spark, path)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_are_pruned_and_filters_pushed(store):
    p = plan(src.scoped(store, "1995-01-01", "1995-12-31", ["1"], ["symbol", "date", "close"]))
    assert "GreaterThanOrEqual(date" in p and "ReadSchema: struct<symbol:string,date:date,close:double>" in p


def test_daily_features_take_one_exchange(store):
    p = plan(features.derived_features(features.daily_features(store)))
    assert p.count("Exchange hashpartitioning") == 1 and "SinglePartition" not in p and "Python" not in p


def test_breadth_sorts_only_dates_in_one_partition(store):
    p = plan(features.breadth(features.daily_features(store)))
    assert p.count("SinglePartition") == 1 and p.count("Exchange hashpartitioning") == 2


def test_no_python_and_no_nested_loops_on_the_trade_path(store):
    f = features.daily_features(store)
    rows = candidates.select_candidates(candidates.generate(store, f, Params(min_filters=3)), Params()).where("selected")
    s = rows.select("symbol", "date", "direction", F.col("open").alias("entry_price"), F.col("low").alias("initial_stop"), F.lit(None).cast("double").alias("carry_stop"))
    p = plan(outcomes.multi_day_exits(s, store))
    assert "Python" not in p and "NestedLoop" not in p and "Cartesian" not in p


def test_row_rules_are_one_scan(spark, sf):
    b = src.intraday_from_events(spark, sf)
    p = plan(quality.flagged(b, quality.intraday_rules()))
    assert p.count("FileScan") == 1 and p.count("Exchange") == 1


def test_years_are_pruned(store):
    p = plan(store.where((F.col("year") == 1995) & (F.col("date") >= F.lit(date(1995, 6, 1)))))
    assert "PartitionFilters: [isnotnull(year" in p


def test_a_refresh_sorts_rows_one_way(store):
    """Rows before a date are counted in the order of all other windows; breadth goes over no frame row by row."""
    p = plan(incremental.daily_since(store, date(1998, 1, 1), rows=incremental.ROW_CONTEXT))
    assert p.count("Exchange hashpartitioning") == 1 and "DESC" not in p
    p = plan(features.eligible(features.daily_features(store)))
    assert not re.search(r"RowFrame, -\d+, currentrow", p)
