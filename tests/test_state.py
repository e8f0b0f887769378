"""States that add up, stores read in part, cascades, sliding order statistics, directed checks, checked lines."""

from __future__ import annotations

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions import expressions as ex
from barloom.operators import features, frames, quality, reconcile
from barloom.plans import incremental
from barloom.sources import bars as src

DAY = datetime.date(2019, 1, 1)
BAR = "symbol string, date date, open double, high double, low double, close double, volume long"


def some_bars(spark, symbols=6, days=900, seed=1, step=1):
    rng, rows = random.Random(seed), []
    for s in range(symbols):
        x = 100.0
        for d in range(0, days, step * (1 + s % 3)):
            x = max(1.0, x * (1 + rng.gauss(0, 0.02)))
            rows.append((f"s{s}", DAY + datetime.timedelta(days=d), x, x * 1.01, x * 0.99, x, rng.randint(1, 10**6)))
    return spark.createDataFrame(rows, BAR)


def test_aliases_keep_repeated_rows(spark):
    d = datetime.date(2020, 1, 1)
    rows = spark.createDataFrame([("old", d, 1.0), ("old", d, 1.0), ("old", d, None), ("old", None, 1.0), ("other", d, 1.0), (None, d, 2.0)], "symbol string, date date, close double")
    aliases = spark.createDataFrame([("old", "first", None, None), ("old", "new", datetime.date(2019, 1, 1), None), ("old", "later", datetime.date(2021, 1, 1), None)], "alias string, symbol string, valid_from date, valid_to date")
    found = [(r.symbol, r.date, r.close) for r in reconcile.by_alias(rows, aliases).collect()]
    assert sorted(found, key=repr) == sorted([("new", d, 1.0), ("new", d, 1.0), ("new", d, None), ("old", None, 1.0), ("other", d, 1.0), (None, d, 2.0)], key=repr)


def test_hashes_tell_nulls_and_repeats(spark):
    schema = "symbol string, date date, a double, b double"
    state = lambda rows: incremental.dataset_state(spark.createDataFrame(rows, schema)).first().dataset_hash
    sets = [[("x", DAY, None, 1.0)], [("x", DAY, 1.0, None)], [("x", DAY, None, None)], [("x", DAY, 1.0, 1.0)], [("x", DAY, 1.0, 1.0)] * 2, [(None, DAY, 1.0, 1.0)], [("x", None, 1.0, 1.0)], [("-", DAY, 1.0, 1.0)], []]
    assert len({state(s) for s in sets}) == len(sets)
    assert state([("x", DAY, 1.0, 2.0), ("y", DAY, 3.0, None)]) == state([("y", DAY, 3.0, None), ("x", DAY, 1.0, 2.0)])
    old = spark.createDataFrame([("x", DAY, None, 1.0)], schema)
    known = src.partition_registry(old, ["symbol"])
    again = {r.state for r in src.partition_registry(spark.createDataFrame([("x", DAY, 1.0, None)], schema), ["symbol"], known).collect()}
    assert again == {"SUPERSEDED"} and {r.state for r in src.partition_registry(old, ["symbol"], known).collect()} == {"READY"}


def test_partition_states_add_up(spark):
    bars = some_bars(spark, 40, 400).withColumn("year", F.year("date")).withColumn("part", F.col("volume") % 5)
    full = incremental.dataset_state(bars.drop("year", "part")).first()
    for keys in (["year"], ["year", "part"]):  # a key is no part of the rows' content
        states = src.partition_states(bars.drop(*{"year", "part"} - set(keys)), keys)
        merged = incremental.with_hash(src.merged_state(states)).first()
        assert (merged.n_rows, merged.first_date, merged.last_date, merged.dataset_hash) == (full.n_rows, full.first_date, full.last_date, full.dataset_hash)
        assert abs(merged.n_symbols - full.n_symbols) <= 2
    assert incremental.with_hash(src.merged_state(src.partition_states(bars.limit(0), ["year"]))).first().n_rows == 0


def test_only_the_years_that_are_needed_are_read(spark, tmp_path):
    """Ten years of bars; two symbols trade daily, one every 12 days, one stopped long ago."""
    rng, rows = random.Random(2), []
    for s, step, days in (("a", 1, 3650), ("b", 1, 3650), ("rare", 12, 3650), ("gone", 1, 800)):
        for d in range(0, days, step):
            x = 50 + rng.random() * 10
            rows.append((s, datetime.date(2010, 1, 1) + datetime.timedelta(days=d), x, x + 1, x - 1, x, 100))
    bars = spark.createDataFrame(rows, BAR)
    incremental.write_slice(bars, str(tmp_path / "store"))
    store = src.read_bars(spark, str(tmp_path / "store"), T.StructType([*bars.schema, T.StructField("year", T.IntegerType())]))
    states = src.partition_states(store, ["symbol", "year"])
    since = datetime.date(2019, 6, 1)
    need = {(r.symbol, r.year) for r in incremental.years_needed(states, since, 260).collect()}
    assert {y for s, y in need if s == "a"} == {2018, 2019} and min(y for s, y in need if s == "rare") == 2010 and not any(s == "gone" for s, _ in need)
    few = incremental.years_needed(states.where("symbol <> 'rare'"), since, 260)
    assert {r.year for r in few.collect()} == {2018, 2019}
    found = incremental.daily_from_store(store, states, since)
    expected = features.daily_features(bars).where(F.col("date") >= F.lit(since)).select(found.columns)
    keep = ["symbol", "date", "ret_252d", "ma_65_sma", "r2_65", "range_percentile_252", "atr_compress_ratio", "breakout_4pct_up_90d"]
    assert sorted(map(tuple, found.select(keep).collect())) == sorted(map(tuple, expected.select(keep).collect()))
    pruned = incremental.daily_from_store(store.where("symbol <> 'rare'"), states.where("symbol <> 'rare'"), since)
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan or "PartitionFilters: [year" in plan
    read = store.where(F.col("year").isin([2018, 2019])).count()
    assert read < store.count() / 4


def test_cascade_ends_on_cycles(spark):
    edges = [("b", "a"), ("c", "b"), ("a", "c"), ("d", "c"), ("e", "x"), ("b", "a"), (None, "a"), ("f", None), ("d", "d")]
    deps = spark.createDataFrame(edges, "name string, depends_on string")
    found = incremental.stale_cascade(spark.createDataFrame([("a",), ("a",), (None,)], "name string"), deps)
    assert sorted(map(tuple, found.collect())) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert incremental.stale_cascade(spark.createDataFrame([], "name string"), deps).count() == 0


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_sliding_quantiles(spark, block):
    rng, rows = random.Random(3), []
    for s, n in (("a", 200), ("b", 7), ("c", 1), ("d", 8)):
        rows += [(s, k, rng.choice([None, math.nan, math.inf, 1.0, 2.0]) if rng.random() < 0.3 else rng.random()) for k in range(n)]
    df = spark.createDataFrame(rows, "symbol string, date int, x double").repartition(3)
    wanted = {"m": ("x", 7, 1, 0.5), "p": ("x", 4, 0, 0.2), "one": ("x", 1, 1, 0.9)}
    got = {(r.symbol, r.date): r for r in frames.sliding_quantiles(df, wanted, block=block).collect()}
    assert len(got) == len(rows)
    by = {}
    for s, k, x in rows:
        by.setdefault(s, []).append(x)
    for s, xs in by.items():
        for k in range(len(xs)):
            for name, (_, first, last, q) in wanted.items():
                known = [x for x in xs[max(0, k - first) : max(0, k - last + 1)] if x is not None and math.isfinite(x)]
                want = float(np.percentile(known, q * 100)) if known else None
                have = got[s, k][name]
                assert (have is None) == (want is None) and (want is None or abs(have - want) < 1e-9), (s, k, name)
    assert frames.sliding_quantiles(df.limit(0), wanted).count() == 0
    with pytest.raises(ValueError):
        frames.sliding_quantiles(df, {"m": ("x", 5000, 1, 0.5)})


def test_quantiles_over_batches_of_many_symbols(spark):
    """Frames go on over the ends of batches, and no Python call is made for each symbol."""
    rng = random.Random(4)
    rows = [(None if s == 0 else f"s{s}", k, rng.random()) for s in range(40) for k in range(rng.choice([1, 3, 9, 30]))]
    df = spark.createDataFrame(rows, "symbol string, date int, x double").repartition(3)
    wanted = {"m": ("x", 9, 2, 0.5), "p": ("x", 5, 0, 0.2)}
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        found = frames.sliding_quantiles(df, wanted)
        got = {(r.symbol, r.date): r for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    by = {}
    for s, _, x in rows:
        by.setdefault(s, []).append(x)
    assert len(got) == len(rows)
    for s, xs in by.items():
        for k in range(len(xs)):
            for name, (_, first, last, q) in wanted.items():
                known = xs[max(0, k - first) : max(0, k - last + 1)]
                have = got[s, k][name]
                assert have is None if not known else abs(have - float(np.percentile(known, q * 100))) < 1e-9, (s, k, name)


def test_checks_by_direction(spark):
    """What is unknown fails; h and n are mirrored, the others are not."""
    names = "direction close_pos_in_range prev_range prev_close prev_open atr_20 ret_1d_lag1 ret_1d_lag2 prior_breakouts_30d vol_dryup_ratio close ma_20 ret_5d r2_65".split()
    rows = [
        ("LONG", 0.9, 1.0, 9.0, 10.0, 1.0, 0.1, -0.1, 1, 1.0, 10.0, 9.0, 0.1, 0.0), ("SHORT", 0.9, 1.0, 9.0, 10.0, 1.0, 0.1, -0.1, 1, 1.0, 10.0, 9.0, 0.1, 0.0), ("SHORT", 0.3, 1.0, 11.0, 10.0, 1.0, 0.1, None, 3, 1.3, 8.0, 9.0, 0.1, 0.9),
        ("LONG", None, 0.4, 11.0, None, 1.0, None, None, None, None, None, None, None, None), ("LONG", 0.7, 0.4, 11.0, 10.0, 1.0, 0.0, 0.1, 2, 1.29, None, 9.0, 0.1, 0.7),
    ]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'string' if n == 'direction' else 'long' if n.startswith('prior') else 'double'}" for n in names))
    checks = ex.directed_checks(F.col("direction"))
    found = [tuple(r) for r in df.select(*(c.alias(n) for n, c in checks.items()), ex.passes(checks, 5).alias("passed")).collect()]
    assert found == [(True, True, True, True, True, True, True), (False, False, True, True, True, True, False), (True, True, False, False, False, True, False), (False,) * 7, (True, True, True, True, True, True, True)]


def test_checked_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = ["symbol,date,open,high,low,close,volume", "a,2024-01-02,1,2,0.5,1.5,7", "a,2024-01-03,1,2", "a,2024-01-04,1,2,0.5,1.5,7,8", "a,2024-01-05,x,2,0.5,1.5,7", "a,2024-01-08,,2,0.5,1.5,7", "a,2024-01-09,1,0.4,0.5,1.5,7", "a,2024-01-10,1,2,0.5,2.5,7", "a,2024-01-11,1,2,0.5,1.5,-7", "a,2024-13-01,1,2,0.5,1.5,7"]
    (tmp_path / "in" / "f.csv").write_text("\n".join(lines) + "\n")
    schema = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("date", T.DateType()), *(T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close")), T.StructField("volume", T.LongType())])
    found = quality.read_checked(spark, str(tmp_path / "in"), schema)
    quality.write_checked(found, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    good, bad = back.where("kept = 'true'").collect(), back.where("kept = 'false'").collect()
    assert [(r.symbol, r.close, r.reason, r.line) for r in good] == [("a", 1.5, None, None)]
    reasons = {}
    for r in bad:
        reasons.setdefault(r.reason, []).append(r.line)
    assert {k: len(v) for k, v in reasons.items()} == {"malformed_line": 4, "null_value": 1, "high_below_low": 1, "price_outside_range": 1, "negative_volume": 1}
    assert sorted(reasons["malformed_line"]) == sorted([lines[2], lines[3], lines[4], lines[9]])
    with pytest.raises(ValueError):
        quality.read_checked(spark, str(tmp_path / "in"), T.StructType(schema.fields[1:]))


def test_rules_are_counted_within_the_scan(spark, tmp_path):
    bars = some_bars(spark).withColumn("high", F.when(F.col("volume") % 7 == 0, F.col("low") - 1).otherwise(F.col("high"))).withColumn("open", F.when(F.col("volume") % 11 != 0, F.col("open"))).cache()
    rules = {"bad_range": quality.bad_range(), "null_price": quality.any_price(lambda p: p.isNull())}
    seen, counts = quality.observed(bars, rules, "rules")
    seen.write.parquet(str(tmp_path / "out"))
    expected = {r.issue_code: r["count"] for r in quality.flagged(bars, rules).groupBy("issue_code").count().collect()}
    assert counts.get == {"n_rows": bars.count()} | expected and all(expected.values())
    assert seen._jdf.queryExecution().executedPlan().toString().count("InMemoryTableScan") == 1
