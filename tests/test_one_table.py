"""Candidates and trades from the features' table alone: the rows of the joined way, and one exchange by symbol."""

from __future__ import annotations

import pytest

from barloom.operators import candidates, features
from barloom.operators.candidates import Params
from barloom.plans import research
from barloom.sources import bars as src

LIMITS = {"min_price": 10.0, "min_value": 30_000.0, "min_volume": 20}


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(map(repr, df.select(*columns).collect()))


@pytest.mark.parametrize("strategy", ["breakdown", "legacy"])
def test_candidates_without_a_join(spark, sf, strategy):
    d = src.daily_from_lineitem(spark, sf)
    p = Params(strategy, min_filters=2, **LIMITS)
    wanted = ["symbol", "date", "prev_close", "gap_pct", "atr_20", "r2_65", "filters_passed"]
    f = features.daily_features(d)
    alone = candidates.generate(None, f, p).select(*wanted)
    assert rows(alone) == rows(candidates.generate(d, f, p).select(*wanted)) and rows(alone)[1]
    plan = alone._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_trades_without_a_join(spark, sf):
    d = src.daily_from_lineitem(spark, sf)
    f = features.daily_features(d)
    p = Params(min_filters=2, **LIMITS)
    alone, joined = research.backtest(None, f, p), research.backtest(d, f, p)
    wanted = ["symbol", "date", "entry_price", "initial_stop", "exit_date", "exit_price", "exit_reason", "holding_days", "pnl_r"]
    assert rows(alone.select(*wanted)) == rows(joined.select(*wanted)) and rows(alone)[1]
