"""Ingest, merging, repair, quality rules and registries on hand-made rows."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.functions import expressions as ex
from barloom.operators import features, quality, reconcile, reports
from barloom.plans import incremental, research
from barloom.sources import bars as src

D0 = date(2024, 1, 1)
DAILY = "symbol string, date date, open double, high double, low double, close double, volume long"


def test_delimited_files(spark, tmp_path):
    (tmp_path / "ABC.csv").write_text('Date,Open,High,Low,Close,Volume\n2024-01-01,1,2,0.5,1.5,"1,000"\n02-01-2024,1,x,0.5,1.5,10\nnonsense,1,2,3,4,5\n')
    found = {r.date: r for r in src.read_delimited(spark, str(tmp_path / "ABC.csv")).collect()}
    assert set(found) == {D0, D0 + timedelta(1)} and found[D0].symbol == "ABC" and found[D0].volume == 1000 and found[D0 + timedelta(1)].high is None
    (tmp_path / "m.tsv").write_text("Symbol\tTimestamp\tOpen\tHigh\tLow\tClose\tVolume\nxyz\t2024-01-01T09:15:00+0530\t1\t2\t0.5\t1.5\t10\n")
    row = src.read_delimited(spark, str(tmp_path / "m.tsv")).first()
    assert (row.symbol, row.candle_time, row.date) == ("XYZ", datetime(2024, 1, 1, 9, 15), D0)


def test_normalising(spark):
    raw = spark.createDataFrame([("a", "2024-01-01 00:00:00", "1", "2", "0.5", "1", "10.0", 1), ("a", "2024-01-01", "1", "2", "0.5", "3", "11", 2), ("a", "bad", "1", "2", "0.5", "3", "11", 3)], "Ticker string, Date string, Open string, High string, Low string, Close string, Volume string, load_seq int")
    assert [(r.symbol, r.close, r.volume) for r in src.normalize_daily(raw).collect()] == [("a", 3.0, 11)]
    raw = spark.createDataFrame([("a", datetime(2024, 1, 1, 3, 45), 1.0, 2.0, 0.5, 1.0, 10)], "symbol string, timestamp timestamp_ntz, open double, high double, low double, close double, volume long")
    row = src.normalize_intraday(raw).first()
    assert row.candle_time == datetime(2024, 1, 1, 9, 15) and row.true_range == 1.5


def test_append_touches_only_its_years(spark, tmp_path):
    path = str(tmp_path / "store")
    row = lambda d, c: ("a", d, 1.0, 1.0, 1.0, c, 1)
    src.append_bars(spark, path, spark.createDataFrame([row(date(2023, 5, 1), 1.0), row(D0, 1.0)], DAILY), ["symbol", "date"], "overwrite")
    before = sorted((tmp_path / "store" / "year=2023").iterdir())
    src.append_bars(spark, path, spark.createDataFrame([row(D0, 2.0), row(D0 + timedelta(1), 3.0)], DAILY), ["symbol", "date"])
    assert sorted((tmp_path / "store" / "year=2023").iterdir()) == before
    assert sorted((r.date, r.close) for r in src.read_bars(spark, path).collect()) == [(date(2023, 5, 1), 1.0), (D0, 2.0), (D0 + timedelta(1), 3.0)]
    assert src.read_bars(spark, str(tmp_path / "nothing")).count() == 0


def test_fetch_windows(spark):
    d = lambda n: D0 + timedelta(n)
    r = spark.createDataFrame([(s, d(10), d(20)) for s in "abcde"], "symbol string, start_date date, end_date date")
    c = spark.createDataFrame([("a", d(0), d(30)), ("b", d(0), d(15)), ("c", d(15), d(30)), ("d", d(40), d(50))], "symbol string, first date, last date")
    found = {x.symbol: (x.fetch_start, x.fetch_end, x.skip) for x in src.fetch_windows(r, c).collect()}
    assert found == {"a": (d(10), d(20), True), "b": (d(16), d(20), False), "c": (d(10), d(14), False), "d": (d(10), d(20), False), "e": (d(10), d(20), False)}


def test_alignment_repair(spark):
    t = lambda h, m: datetime(2024, 1, 2, h, m)
    b = spark.createDataFrame([("bad", date(2024, 1, 2), t(3, 45), 2024), ("bad", date(2024, 1, 2), t(3, 50), 2024), ("good", date(2024, 1, 2), t(9, 15), 2024), ("off", date(2024, 1, 2), t(9, 15), 2023)], "symbol string, date date, candle_time timestamp_ntz, year int")
    issues = src.alignment_issues(b)
    assert {(r.symbol, r.issue) for r in issues.collect()} == {("bad", "legacy_utc_naive"), ("off", "year_mismatch")}
    fixed = {(r.symbol, r.candle_time) for r in src.repair_alignment(b, issues).collect()}
    assert fixed == {("bad", t(9, 15)), ("bad", t(9, 20)), ("good", t(9, 15)), ("off", t(9, 15))}


def test_registry_states(spark):
    b = spark.createDataFrame([("a", D0, 1.0), ("b", D0, 2.0)], "symbol string, date date, close double")
    first = src.partition_registry(b, ["symbol"])
    changed = b.where("symbol = 'a'").withColumn("close", F.lit(9.0))
    again = {r.symbol: r.state for r in src.partition_registry(changed, ["symbol"], first).collect()}
    assert again == {"a": "SUPERSEDED", "b": "STALE"}


def bad_bars(spark):
    t = lambda h, m=15: datetime(2024, 1, 1, h, m)
    rows = [("AAA", D0, t(9), 10.0, 11.0, 9.0, 10.5, 5), ("AAA", D0, t(9, 20), 10.0, 9.0, 11.0, 10.0, 5), ("AAA", D0, t(9, 25), None, 11.0, 9.0, 10.0, 5), ("AAA", D0, t(9, 30), 0.0, 11.0, 0.0, 10.0, 5), ("AAA", D0, t(8), 10.0, 11.0, 9.0, 10.0, 5), ("AAA", D0, t(10), 10.0, 18.0, 9.0, 10.0, 5), ("AAA", D0, t(10), 10.0, 11.0, 9.0, 10.0, 5)]
    return spark.createDataFrame(rows, "symbol string, date date, candle_time timestamp, open double, high double, low double, close double, volume long")


def test_scan_and_registry(spark):
    d = spark.createDataFrame([("AAA", D0, 10.0, 11.0, 9.0, 10.0, 0), ("AAA", D0 + timedelta(20), 10.0, 20.0, 9.0, 19.0, 5)], DAILY)
    found = quality.scan(d, bad_bars(spark))
    codes = {r.issue_code for r in found.collect()}
    assert codes == set(quality.SEVERITIES)
    assert {r.issue_code for r in quality.scan(d, bad_bars(spark), D0 + timedelta(10), None).collect()} == {"DATE_GAP", "EXTREME_MOVE", "MISSING_5MIN_COVERAGE", "SHORT_HISTORY"}
    assert quality.scan(d.limit(0), bad_bars(spark).limit(0)).count() == 0
    gate = quality.date_gate(found, D0).first()
    assert not gate.ready and "OHLC_VIOLATION" in gate.codes
    none = spark.createDataFrame([], "symbol string, issue_code string, is_active boolean, acknowledged boolean, first_seen date, last_seen date")
    one = quality.upsert_issues(none, found.where("issue_code = 'DATE_GAP'"), D0)
    one = quality.acknowledge(one, spark.createDataFrame([("AAA",)], "symbol string"), "DATE_GAP")
    two = quality.upsert_issues(one, found.where("issue_code = 'EXTREME_MOVE'"), D0 + timedelta(1))
    state = {r.issue_code: (r.is_active, r.acknowledged, r.first_seen, r.last_seen) for r in two.collect()}
    assert state == {"DATE_GAP": (False, True, D0, D0), "EXTREME_MOVE": (True, False, D0 + timedelta(1), D0 + timedelta(1))}
    three = {r.issue_code: r for r in quality.upsert_issues(two, found.where("issue_code = 'DATE_GAP'"), D0 + timedelta(2)).collect()}
    assert three["DATE_GAP"].is_active and three["DATE_GAP"].first_seen == D0


def test_validator_and_report(spark):
    rows = [("a", D0 + timedelta(i), 10.0, 11.0, 9.0, 10.0, 100) for i in range(5)] + [("a", D0 + timedelta(15), 10.0, 11.0, 9.0, 25.0, 10_000), ("a", D0 + timedelta(15), -1.0, 11.0, 9.0, 10.0, 100)]
    d = spark.createDataFrame(rows, DAILY)
    v = quality.validate_rows(d).first()
    assert (v.duplicate, v.date_gap, v.volume_spike, v.passed) == (2, 1, 1, False) and v.price_low == 1 and 0 <= v.score < 1
    r = quality.dataset_report(d, spark.createDataFrame([("a",), ("z",)], "symbol string")).first()
    assert (r.duplicates, r.missing_symbols, r.nonpositive, r.verdict) == (1, 1, 1, "FAIL")
    good, bad = quality.quarantine(d.withColumn("close", F.when(F.col("volume") == 10_000, None).otherwise(F.col("close"))))
    assert (good.count(), bad.count()) == (6, 1)
    with pytest.raises(ValueError):
        quality.quarantine(d.drop("open"))
    m = quality.monitor(d, D0 + timedelta(15), universe=1).first()
    assert (m.n_rows, m.status) == (2, "OK") and quality.monitor(d, date(2030, 1, 1)).first().status == "NO_DATA"


def test_gates_and_regressions(spark):
    s = spark.createDataFrame([("e", "x", 5.0, 40.0)], "exp_id string, strategy string, calmar double, win_rate double")
    t = spark.createDataFrame([("x", "calmar", 6.0, 4.0, True), ("x", "win_rate", 30.0, 50.0, False)], "strategy string, metric string, warn double, fail double, higher_is_better boolean")
    assert {r.metric: r.severity for r in quality.result_gates(s, t).collect()} == {"calmar": "WARNING", "win_rate": "WARNING"}
    a = spark.createDataFrame([("x", "m", 10.0), ("x", "n", 10.0)], "strategy string, metric string, value double")
    b = spark.createDataFrame([("x", "m", 7.0)], "strategy string, metric string, value double")
    assert {r.metric: r.severity for r in quality.regressions(a, b).collect()} == {"m": "ERROR", "n": "ERROR"}


def test_adjustment(spark):
    d = spark.createDataFrame([("a", D0 + timedelta(i), 100.0, 100.0, 100.0, 100.0, 1) for i in range(5)], DAILY)
    acts = spark.createDataFrame([("a", D0 + timedelta(2), "SPLIT", 2.0, 1.0), ("a", D0 + timedelta(2), "BONUS", 1.0, 1.0), ("a", D0 + timedelta(4), "DIVIDEND", None, None)], "symbol string, ex_date date, action_type string, ratio_num double, ratio_den double")
    f = lambda inclusive: [r.adj_factor for r in features.adjustment_series(d, acts, inclusive).orderBy("date").collect()]
    assert f(True) == [0.25, 0.25, 0.25, 1.0, 1.0] and f(False) == [0.25, 0.25, 1.0, 1.0, 1.0]
    assert [r.date for r in features.continuity_breaks(features.adjustment_series(d, acts)).collect()] == [D0 + timedelta(3)]
    with pytest.raises(Exception, match="unusable corporate action"):
        features.adjustment_series(d, acts.withColumn("action_type", F.lit("MERGER"))).collect()


def test_adjustment_goes_over_a_history_once(spark):
    """Factors of a long history with many actions, against products taken one by one; no frame shrinks with its row."""
    d = spark.createDataFrame([("a", D0 + timedelta(i // 2), 100.0, 100.0, 100.0, 100.0, 1) for i in range(600)] + [("b", D0, 1.0, 1.0, 1.0, 1.0, 1)], DAILY)
    days = [(D0 + timedelta(k), "SPLIT" if k % 2 else "RIGHTS", 2.0, 1.0) for k in range(5, 320, 45)]
    acts = spark.createDataFrame([("a", *x) for x in days], "symbol string, ex_date date, action_type string, ratio_num double, ratio_den double")
    for inclusive in (True, False):
        out = features.adjustment_series(d, acts, inclusive)
        found = out.select("symbol", "date", "adj_factor").collect()
        assert "1, unboundedfollowing" not in out._jdf.queryExecution().executedPlan().toString()
        assert len(found) == 601
        for r in found:
            want = 1.0
            for day, kind, _, _ in days:
                if r.symbol == "a" and (day > r.date or (inclusive and day == r.date)):
                    want *= 0.5 if kind == "SPLIT" else 1 / 3
            assert abs(r.adj_factor - want) <= 1e-12, r


def test_expressions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(ex.ratio(F.lit(1.0), F.lit(0.0))) is None
    assert [value(ex.slippage_bps(F.lit(v).cast("double"))) for v in (None, 2e8, 5e7, 1.0)] == [10.0, 5.0, 10.0, 20.0]
    assert value(ex.position_shares(F.lit(100.0), F.lit(95.0), F.lit(1_000_000.0))) == 1000 and value(ex.position_shares(F.lit(100.0), F.lit(100.0), F.lit(1e6))) == 0
    assert value(ex.filter_score([F.lit(True), F.lit(None).cast("boolean")], "false")) == 1 and value(ex.filter_score([F.lit(True), F.lit(None).cast("boolean")])) is None
    assert value(ex.weekday(F.lit(D0))) == 1 and value(ex.bucket(F.lit(0.03), [0.02, 0.05], ["a", "b", "c"])) == "b"
    assert value(ex.fingerprint(F.lit("a"))) == value(ex.fingerprint(F.lit("a"))) and len(value(ex.fingerprint(F.lit("a")))) == 16
    assert value(ex.directed_h(F.lit("SHORT"), F.lit(0.3))) and not value(ex.directed_h(F.lit("LONG"), F.lit(None).cast("double")))


def test_reconcile_and_aliases(spark):
    rows = [("a", datetime(2024, 1, 1, 9, 15), 1.0, 1.0, 1.0, 1.0, 10)]
    schema = "symbol string, candle_time timestamp, open double, high double, low double, close double, volume long"
    left = spark.createDataFrame([*rows, ("b", datetime(2024, 1, 1, 9, 15), 1.0, 1.0, 1.0, 1.0, 10)], schema)
    right = spark.createDataFrame([("a", datetime(2024, 1, 1, 9, 15), 1.0, 1.5, 1.0, 1.0, 30), ("c", datetime(2024, 1, 1, 9, 15), 1.0, 1.0, 1.0, 1.0, 10)], schema)
    found = {(r.symbol, r.kind, r.field) for r in reconcile.reconcile_bars(left, right).collect()}
    assert found == {("a", "price_diff", "high"), ("a", "volume_diff", "volume"), ("b", "extra", None), ("c", "missing", None)}
    al = spark.createDataFrame([("old", "new", None, D0), ("old", "newer", D0 + timedelta(1), None)], "alias string, symbol string, valid_from date, valid_to date")
    r = spark.createDataFrame([("old", D0), ("old", D0 + timedelta(5)), ("x", D0)], "symbol string, date date")
    assert sorted(x.symbol for x in reconcile.by_alias(r, al).collect()) == ["new", "newer", "x"]


def test_incremental_equals_full(spark, sf):
    d = src.daily_from_lineitem(spark, sf)
    full = features.daily_features(d)
    since = date(1998, 6, 1)
    cols = ["symbol", "date", "ret_1d", "ret_20d", "atr_14", "vol_20"]
    a = sorted(map(tuple, full.where(F.col("date") >= F.lit(since)).select(cols).collect()))
    assert a == sorted(map(tuple, incremental.daily_since(d, since).select(cols).collect())) and a
    b = features.intraday_features
    bars = src.intraday_from_events(spark, sf)
    days = src.intraday_to_daily(bars)
    start = bars.agg(F.max("date")).first()[0] - timedelta(3)
    cols = ["symbol", "candle_time", "or_15min_high", "gap_open_pct", "volume_percentile"]
    x = sorted(map(str, b(bars, days).where(F.col("date") >= F.lit(start)).select(cols).collect()))
    assert x == sorted(map(str, incremental.intraday_since(bars, days, start).select(cols).collect()))


def test_refresh_plans():
    d = lambda n: D0 + timedelta(n)
    assert incremental.refresh_plan("NONE", d(5), d(0), d(9))["read_from"] is None
    assert incremental.refresh_plan("APPEND", d(5), d(0), d(9)) == {"read_from": d(6), "write_from": d(6), "write_to": d(9)}
    assert incremental.refresh_plan("ROLLING_WINDOW", d(5), d(0), d(9), 10)["read_from"] == d(-4)
    assert incremental.refresh_plan("DEPENDENCY_CASCADE", d(5), d(2), d(9))["write_from"] == d(2)
    assert incremental.refresh_plan("APPEND", d(9), d(0), d(9)) is None
    assert incremental.experiment_id({"b": 1, "a": 2}, "h", "c") == incremental.experiment_id({"a": 2, "b": 1}, "h", "c")


def test_stale_runs(spark):
    runs = spark.createDataFrame([("e1", "x", "s", "d", "c", D0, D0), ("e2", "x", "s2", "d2", "c", D0, D0), ("e3", "y", "s", "d", "c", D0, D0)], "exp_id string, strategy string, strategy_hash string, dataset_hash string, code_hash string, start_date date, end_date date")
    now = spark.createDataFrame([("x", "s", "d", "c", D0, D0 + timedelta(1))], "strategy string, strategy_hash string, dataset_hash string, code_hash string, start_date date, end_date date")
    found = {r.exp_id: r.reasons for r in incremental.stale_runs(runs, now).collect()}
    assert found == {"e1": ["range_extended"], "e2": ["strategy_changed", "dataset_changed", "range_extended"], "e3": ["strategy_unknown"]}


def test_windows_do_not_overlap(spark):
    folds = research.rolling_windows(spark, D0, D0 + timedelta(400), 100, 50, 50).orderBy("fold").collect()
    assert all(f.train_end < f.test_start <= f.test_end for f in folds) and all(a.test_end < b.test_start for a, b in zip(folds, folds[1:]))
    bars = spark.createDataFrame([("a", D0 + timedelta(2 * i)) for i in range(50)], "symbol string, date date")
    folds = research.session_windows(bars, 20, 10, 10).orderBy("fold").collect()
    assert [(f.train_start, f.test_start) for f in folds] == [(D0 + timedelta(20 * k), D0 + timedelta(20 * k + 40)) for k in range(3)]


def test_grids_and_sensitivity(spark):
    assert research.grid(spark, {"a": [1, 2], "b": [3, 4, 5]}).count() == 6
    assert research.random_grid(spark, {"a": [1, 2], "b": [3, 4, 5]}, 4).count() == 4
    assert research.one_at_a_time(spark, {"a": [1, 2], "b": [3]}, {"a": 0, "b": 0}).count() == 3
    runs = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 2.0), ("a", 3.0, 0.0)], "param string, value double, metric double")
    r = reports.sensitivity(runs).first()
    assert r.best_value == 2.0 and abs(r.score - 1 / 1.5) < 1e-9


def test_vendor_candles(spark):
    rows = [("a", 1, [["2024-01-01 03:45:00", "1", "2", "0.5", "1", "10"], ["bad", "1", "2", "0.5", "1", "10"]]), ("a", 2, [["2024-01-01 03:45:00", "1", "2", "0.5", "1.5", "12"]])]
    found = src.vendor_candles(spark.createDataFrame(rows, "symbol string, chunk_seq int, candles array<array<string>>")).collect()
    assert [(r.candle_time, r.close, r.volume) for r in found] == [(datetime(2024, 1, 1, 9, 15), 1.5, 12)]
