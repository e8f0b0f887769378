"""Trailing daily features against frames added up one by one, over bars with NaN, infinity, nulls and outliers."""

from __future__ import annotations

import datetime
import math
import random
import re

import pytest

from barloom.operators import features
from barloom.sources import bars as src

SCHEMA = "symbol string, date date, open double, high double, low double, close double, volume double"
DAY = datetime.date(2020, 1, 1)


def path(seed: int, n: int, faults: float) -> list[list]:
    chance, x, out = random.Random(seed), 100.0, []
    for k in range(n):
        x = max(1.0, x * (1 + chance.gauss(0, 0.03)))
        bar = [x * 0.99, x * 1.02, x * 0.97, x, float(chance.randint(50_000, 150_000))]
        if chance.random() < faults:
            bar[chance.randrange(5)] = chance.choice([None, math.nan, math.inf, 1e6, 0.0])
        out.append([DAY + datetime.timedelta(days=k), *bar])
    return out


def known(x):
    return None if x is None or math.isnan(x) else x


def mean(values):
    values = [v for v in values if v is not None]
    return sum(values) / len(values) if values else None


def minus(a, b):
    return None if a is None or b is None else a - b


def over(a, b):
    return None if a is None or b is None or b == 0 else a / b


def r_squared(ys):
    n = len(ys)
    if n < 2:
        return None
    if len(set(ys)) == 1:
        return 1.0
    if any(math.isinf(y) for y in ys):
        return math.nan
    my, mx = math.fsum(ys) / n, (n - 1) / 2
    sxy = math.fsum((k - mx) * (y - my) for k, y in enumerate(ys))
    return sxy * sxy / (math.fsum((k - mx) ** 2 for k in range(n)) * math.fsum((y - my) ** 2 for y in ys))


def expected(bars):
    rows = [[d, *(known(v) for v in bar)] for d, *bar in bars]
    rows = [r for r in rows if r[4] is not None]
    x, ranges, volume = [r[4] for r in rows], [minus(r[2], r[3]) for r in rows], [r[5] for r in rows]
    value = [None if v is None else c * v for c, v in zip(x, volume, strict=True)]
    back = lambda k, n: x[k - n] if k >= n else None
    ret = [over(x[k], back(k, 1)) for k in range(len(rows))]
    atr, out = [], []
    for k, row in enumerate(rows):
        last = lambda v, n, skip=0: v[max(0, k - n + 1) : max(0, k + 1 - skip)]  # noqa: B023,E731
        atr.append(mean(last(ranges, 20)))
        place = lambda n: over(x[k] - min(last(x, n)), max(last(x, n)) - min(last(x, n)))  # noqa: B023,E731
        count = lambda n, f: sum(f(r) for r in last(ret, n, 1)) if k else None  # noqa: B023,E731
        up, down = (lambda r: r is not None and not r - 1 < 0.04), (lambda r: r is not None and r - 1 <= -0.04)
        out.append(
            {
                "date": row[0], "atr_14": mean(last(ranges, 14)), "atr_20": atr[k], "ma_7": mean(last(x, 7)), "ma_65_sma": mean(last(x, 65)), "vol_20": mean(last(volume, 20)), "dollar_vol_20": mean(last(value, 20)),
                "r2_65": r_squared(last(x, 65)), "range_percentile_63": place(63), "range_percentile_252": place(252), "atr_compress_ratio": over(atr[k], mean(last(atr, 50, 1))), "vol_dryup_ratio": over(volume[k], mean(last(volume, 20))),
                "breakout_4pct_up_30d": count(30, up), "breakout_4pct_up_90d": count(90, up), "breakdown_4pct_down_90d": count(90, down),
            }
        )
    return out


def close_to(a, b):
    if a is None or b is None:
        return a is b
    if math.isnan(a) or math.isnan(b):
        return math.isnan(a) and math.isnan(b)
    return a == b or abs(a - b) <= 1e-6 * max(1.0, abs(a), abs(b))


@pytest.fixture(scope="module")
def paths():
    return {f"s{k}": path(k, n, faults) for k, (n, faults) in enumerate([(1, 0), (2, 0), (9, 0.2), (70, 0), (70, 0.1), (320, 0), (320, 0.01), (320, 0.01), (320, 0.05), (400, 0.2)])} | {
        "flat": [[DAY + datetime.timedelta(days=k), 5.0, 5.0, 5.0, 5.0, 100.0] for k in range(80)],
        "far": [[DAY + datetime.timedelta(days=k), c, c, c, c, 1.0] for k, c in enumerate([1e12] + [10.0 + k % 7 for k in range(150)])],
    }


def test_every_frame(spark, paths):
    df = spark.createDataFrame([(s, *bar) for s, bars in paths.items() for bar in bars], SCHEMA)
    found = {}
    for r in features.daily_features(df).collect():
        found[r.symbol, r.date] = r
    for s, bars in paths.items():
        rows = expected(bars)
        assert len(rows) == sum(k[0] == s for k in found)
        for row in rows:
            got = found[s, row["date"]]
            for name, want in row.items():
                if name == "date":
                    continue
                assert close_to(got[name], want), (s, row["date"], name, got[name], want)


def test_a_bad_bar_is_forgotten(spark):
    """400 bars with one fault in row 30: rows more than a frame later are as if it had not been."""
    clean = path(1, 400, 0)
    faults = {"nan": (4, math.nan), "inf": (4, math.inf), "volume": (5, 4e18), "high": (2, None)}
    rows = [("clean", *b) for b in clean]
    for name, (column, value) in faults.items():
        bars = [list(b) for b in clean]
        bars[30][column] = value
        rows += [(name, *b) for b in bars]
    found = {(r.symbol, r.date): r for r in features.daily_features(spark.createDataFrame(rows, SCHEMA)).collect()}
    names = ["ma_7", "ma_65_sma", "dollar_vol_20", "vol_20", "r2_65", "atr_20", "atr_14", "atr_compress_ratio", "range_percentile_252"]
    for name in faults:
        for k in (300, 399):
            a, b = found["clean", clean[k][0]], found[name, clean[k][0]]
            assert [a[c] for c in names] == [b[c] for c in names], name


def test_whole_numbers(spark):
    """Bars with integer volumes near the largest number."""
    big = 4 * 10**18
    rows = [("a", DAY + datetime.timedelta(days=k), 2.0, 3.0, 1.0, 2.0, big) for k in range(30)]
    df = spark.createDataFrame(rows, SCHEMA.replace("volume double", "volume long"))
    last = max(features.daily_features(df).collect(), key=lambda r: r.date)
    assert last.vol_20 == big and last.dollar_vol_20 == 2.0 * big


def test_no_frame_is_gone_over_row_by_row(spark, sf):
    """Short frames are lags and sums of groups; what runs on from a symbol's first row is added to."""
    plan = features.daily_features(src.daily_from_lineitem(spark, sf))._jdf.queryExecution().executedPlan().toString()
    frames = set(re.findall(r"RowFrame, ([^,()$]+)[()$]*, ([^,()$]+)", plan))
    assert frames and all(first == "unboundedpreceding" or first == last for first, last in frames), frames
    assert plan.count("Exchange hashpartitioning") == 1
