"""Column expressions: returns, candle shapes, setup flags, costs, sizes, buckets, fingerprints."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN_MINUTE = 555


def ratio(a: Column, b: Column) -> Column:
    """a / b, or NULL for a zero b."""
    return a / F.nullif(b, F.lit(0))


def growth(now: Column, before: Column) -> Column:
    return ratio(now, before) - 1


def gap(now: Column, before: Column) -> Column:
    return ratio(now - before, before)


def places(x: Column, n: int) -> Column:
    """x to n places: the nearest whole number of 10^-n, halves away from zero.

    It is the scaled number that is rounded, as engines do that round doubles;
    F.round goes by the digits that a double is written with, and parts from
    them where those end in a five.
    """
    return F.round(x * float(10**n)) / float(10**n)


def range_share(part: Column, high: Column, low: Column) -> Column:
    """part / (high - low), or NULL where the bar has no range."""
    return F.when(high - low > 0, part / (high - low))


def candle_shape(o: Column, h: Column, l: Column, c: Column) -> dict[str, Column]:
    return {
        "body_ratio": range_share(F.abs(c - o), h, l),
        "upper_wick_ratio": range_share(h - F.greatest(o, c), h, l),
        "lower_wick_ratio": range_share(F.least(o, c) - l, h, l),
    }


def true_range3(high: Column, low: Column, previous_close: Column) -> Column:
    """Largest of the bar's range and the distances of its ends from the previous close."""
    return F.greatest(high - low, F.abs(high - previous_close), F.abs(low - previous_close))


def as_int(flag: Column) -> Column:
    return flag.cast("int")


def trend_count(close: Column, average: Column, ret_5d: Column, r2: Column, short: bool = False) -> Column:
    """How many of three signs of a trend hold: beyond the average, a five-day move its way, a straight line."""
    sides = (close < average, ret_5d < 0) if short else (close > average, ret_5d > 0)
    return sum((as_int(s) for s in sides), as_int(F.coalesce(F.nullif(r2, F.lit(0)), F.lit(0)) >= 0.70))


def setup_flags(short: bool = False, h_threshold: float = 0.70, least_trend: int = 2) -> dict[str, Column]:
    """The six setup flags from derived columns, three-valued; short mirrors h, n, l and 2."""
    c = F.col
    pause = c("prev_range") < c("atr_20") * 0.5
    if short:
        h = c("close_pos_in_range") <= round(1 - h_threshold, 6)
        n, two = pause | (c("prev_close") > c("prev_open")), (c("ret_1d_lag1") >= 0) | (c("ret_1d_lag2") >= 0)
    else:
        h = c("close_pos_in_range") >= h_threshold
        n, two = pause | (c("prev_close") < c("prev_open")), (c("ret_1d_lag1") <= 0) | (c("ret_1d_lag2") <= 0)
    return {
        "filter_h": h,
        "filter_n": n,
        "filter_y": F.coalesce(c("prior_breakouts_30d"), F.lit(0)) <= 2,
        "filter_c": c("vol_dryup_ratio") < 1.3,
        "filter_l": trend_count(c("close"), c("ma_20"), c("ret_5d"), c("r2_65"), short) >= least_trend,
        "filter_2": two,
    }


def filter_score(flags: list[Column], null_mode: str = "propagate") -> Column:
    """How many flags hold; an unknown flag makes the sum unknown, or with null_mode='false' counts as not holding."""
    if null_mode not in ("propagate", "false"):
        raise ValueError("null_mode is 'propagate' or 'false'")
    each = [as_int(f if null_mode == "propagate" else F.coalesce(f, F.lit(False))) for f in flags]
    return sum(each[1:], each[0])


def directed_h(direction: Column, close_pos: Column, threshold: float = 0.70) -> Column:
    """The close lies in the part of the range that its direction wants; unknown fails."""
    good = F.when(direction == "SHORT", close_pos <= round(1 - threshold, 6)).otherwise(close_pos >= threshold)
    return F.coalesce(good, F.lit(False))


def directed_checks(direction: Column, h_threshold: float = 0.70, narrow: float = 0.5, most_breakouts: int = 2, dry_up: float = 1.3, least_trend: int = 2) -> dict[str, Column]:
    """The six setup checks of each row for its own direction, from derived columns; what is unknown fails.

    h and n are mirrored for shorts: a close near the low, and a narrow or a
    green day before.  2, y, c and l are the same for both sides.
    """
    c = F.col
    holds = lambda test: F.coalesce(test, F.lit(False))
    day_before = c("prev_range").isNotNull() & c("prev_close").isNotNull() & c("prev_open").isNotNull() & c("atr_20").isNotNull()
    tired = F.when(direction == "SHORT", c("prev_close") > c("prev_open")).otherwise(c("prev_close") < c("prev_open"))
    trend = sum((as_int(holds(t)) for t in (c("close") > c("ma_20"), c("ret_5d") > 0)), as_int(holds((c("r2_65") != 0) & (c("r2_65") >= 0.70))))
    return {
        "h": directed_h(direction, c("close_pos_in_range"), h_threshold),
        "n": holds(day_before & ((c("prev_range") < c("atr_20") * narrow) | tired)),
        "2": holds(c("ret_1d_lag1") <= 0) | holds(c("ret_1d_lag2") <= 0),
        "y": holds(c("prior_breakouts_30d") <= most_breakouts),
        "c": holds(c("vol_dryup_ratio") < dry_up),
        "l": trend >= least_trend,
    }


def passes(checks: dict[str, Column], least: int = 5) -> Column:
    """Whether at least so many of the checks hold."""
    return sum((as_int(x) for x in checks.values()), F.lit(0)) >= least


def entry_window(bar_number: Column) -> Column:
    return F.when(bar_number <= 6, "first_30min").when(bar_number <= 12, "first_60min").when(bar_number <= 18, "first_90min").otherwise("after_90min")


def minutes_from_open(time: Column, open_minute: int = OPEN_MINUTE) -> Column:
    return F.hour(time) * 60 + F.minute(time) - open_minute


def freshness(last: Column, as_of) -> Column:
    age = F.datediff(F.lit(as_of).cast("date"), last)
    return F.when(age <= 7, "fresh").when(age <= 30, "recent").when(age <= 90, "stale").otherwise("dead")


def expected_sessions(first: Column, last: Column) -> Column:
    """Trading days that a span should hold: five in seven, less four in a hundred holidays."""
    return F.greatest(F.floor((F.datediff(last, first) + 1) * 5 / 7 * 0.96), F.lit(1))


def coverage_percent(sessions: Column, first: Column, last: Column) -> Column:
    return F.least(F.lit(100.0), sessions * 100.0 / expected_sessions(first, last))


def slippage_bps(value_traded: Column) -> Column:
    return F.when(value_traded.isNull(), 10.0).when(value_traded >= 100_000_000, 5.0).when(value_traded >= 20_000_000, 10.0).otherwise(20.0)


@dataclass(frozen=True)
class Costs:
    """Charges of an order; fixed values of a published fee schedule, as shares of its value."""

    brokerage: float = 20.0
    sell_tax: float = 0.00025
    exchange: float = 0.0000345
    regulator: float = 0.000001
    gst: float = 0.18
    stamp: float = 0.00003
    slippage_bps: float = 0.0

    def order(self, price: Column, quantity: Column, selling: Column) -> Column:
        value = price * quantity
        side = F.when(selling, value * self.sell_tax).otherwise(value * self.stamp)
        fees = self.brokerage + value * (self.exchange + self.regulator) + (self.brokerage + value * self.exchange) * self.gst
        good = (quantity > 0) & (price > 0)
        return F.when(good, F.bround(fees + side + value * (self.slippage_bps / 10_000), 2)).otherwise(0.0)

    def round_trip(self, entry: Column, exit_: Column, quantity: Column, direction: Column) -> Column:
        """Cost of opening and closing; 0 if a price or the quantity is not positive."""
        short = F.upper(F.trim(direction)) == "SHORT"
        good = (quantity > 0) & (entry > 0) & (exit_ > 0)
        return F.when(good, F.bround(self.order(entry, quantity, short) + self.order(exit_, quantity, ~short), 2)).otherwise(0.0)


NO_COSTS = Costs(0.0, 0.0, 0.0, 0.0, 0.0, 0.0)


def position_shares(entry: Column, stop: Column, value: Column, risk: float = 0.01, most: float = 0.10, least_value: float = 10_000.0, most_value: float = 500_000.0) -> Column:
    """Shares whose loss at the stop is the risked part of a portfolio, within three bounds applied in turn."""
    shares = F.floor(value * risk / (entry - stop))
    shares = F.when(shares * entry > most_value, F.floor(most_value / entry)).otherwise(shares)
    shares = F.when(shares * entry < least_value, F.floor(least_value / entry)).otherwise(shares)
    shares = F.when(shares * entry > value * most, F.floor(value * most / entry)).otherwise(shares)
    return F.when(entry - stop > 0, shares).otherwise(F.lit(0)).cast("long")


def action_factor(kind: Column, numerator: Column, denominator: Column) -> Column:
    """Price factor of a corporate action; an unknown kind or a missing ratio is an error."""
    unusable = F.raise_error(F.concat(F.lit("unusable corporate action: "), F.coalesce(kind, F.lit("?")))).cast("double")
    known = numerator.isNotNull() & denominator.isNotNull() & (numerator > 0)
    return (
        F.when(kind == "DIVIDEND", F.lit(1.0))
        .when((kind == "SPLIT") & known, denominator / numerator)
        .when(kind.isin("BONUS", "RIGHTS") & known, denominator / (numerator + denominator))
        .otherwise(unusable)
    )


def fingerprint(*columns: Column, length: int = 16) -> Column:
    """Start of the SHA-256 of the columns as JSON, in the order of their names' sort when given as one struct."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, length)


def bucket(x: Column, cuts: list[float], names: list[str]) -> Column:
    """The name of the first cut that x lies under, or the last name; NULL stays NULL."""
    out = None
    for cut, name in zip(cuts, names, strict=False):
        out = F.when(x < cut, name) if out is None else out.when(x < cut, name)
    return F.when(x.isNotNull(), out.otherwise(names[len(cuts)]))


def weekday(date: Column) -> Column:
    """Monday is 1."""
    return (F.dayofweek(date) + 5) % 7 + 1


def invalidated(entry: Column, exit_: Column) -> Column:
    """Prices so far apart that the data must be wrong."""
    return F.coalesce((exit_ / entry > 2.5) | (exit_ / entry < 0.625), F.lit(False))
