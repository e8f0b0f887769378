"""What queries over trades deal out: each line once, as a flat row, and next to nothing after that."""

from __future__ import annotations

import pytest

import __spark_entry__
from barloom.sources import bars as src


def dealt(spark, run) -> int:
    """Rows that the stages of run() write for shuffles."""
    sc = spark.sparkContext
    sc.setJobGroup("dealt", "dealt")
    seen = set(sc.statusTracker().getJobIdsForGroup("dealt"))
    run()
    sc.setJobGroup("other", "other")
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    jobs = set(sc.statusTracker().getJobIdsForGroup("dealt")) - seen
    stages = {s for j in jobs for s in sc.statusTracker().getJobInfo(j).stageIds}
    assert stages
    store = sc._jsc.sc().statusStore()
    return sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)


@pytest.mark.parametrize("name", ["a24_fold_consistency", "q18_result_gates", "t6_rank_experiments", "w21_equity_curve"])
def test_trades_deal_each_line_once(spark, sf, name):
    lines = src.table(spark, sf, "lineitem").count()
    rows = dealt(spark, lambda: __spark_entry__.queries()[name](spark, sf).collect())
    assert lines <= rows < 1.5 * lines


def test_lines_are_dealt_flat(spark, sf):
    daily = src.daily_from_lineitem(spark, sf)
    below = daily._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning", 1)[1]
    assert "struct(" not in below and daily.count()
