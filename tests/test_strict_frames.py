"""Strict features without a frame of 65 rows gone over row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import features
from barloom.sources import bars as src


def test_trend_from_groups_of_eight(spark, sf):
    d = src.daily_from_lineitem(spark, sf)
    s = features.strict_features(d).select("symbol", "date", "close", "ma_65", "r2_65", "prior_breakouts_90d")
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "-64, currentrow" not in plan and "-90, -1" not in plan
    frame = features.last_rows(65)
    n = F.row_number().over(features.by_date())
    both = s.withColumn("n", n).withColumns({"m": F.avg("close").over(frame), "r": F.regr_r2("close", "n").over(frame)}).where("n >= 65")
    off = both.where("abs(ma_65 - m) > 1e-9 or abs(r2_65 - r) > 1e-9 or ma_65 is null or r2_65 is null")
    assert both.count() > 0 and off.count() == 0
