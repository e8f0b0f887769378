"""Registered queries on state: followed positions, sliding order statistics, cascades, stores that are read in part, partition states, checked files.

Some write derived files and read them back; those go to the folder that driver
and executors share.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expressions as ex
from ..operators import features, frames, quality
from ..sources import bars as src
from ..sources.shared import shared_path
from ..streaming import positions
from . import incremental
from .oracle import BARS, DAILY, DERIVED, W, sql
from .registry import FEATURES, daily, feats, intraday, query, rounded


# Positions

FOLLOWED = """pos as (
  select symbol || '@' || cast(date as varchar) symbol, case when day(date) % 2 = 0 then 1 else -1 end sign, min(candle_time) entry_time, arg_min(close, candle_time) entry_price, date d0
  from bars where hour(candle_time) >= 2 group by symbol, date),
at_bars as (
  select p.symbol, row_number() over (partition by p.symbol order by b.candle_time) n, b.candle_time, b.date d, b.open * sign o, case when sign > 0 then b.high else -b.low end best, case when sign > 0 then b.low else -b.high end worst
  from pos p join bars b on p.symbol = b.symbol || '@' || cast(p.d0 as varchar) and b.date between p.d0 and p.d0 + 4 and b.candle_time > p.entry_time),
walk as (
  select symbol, sign, d0, entry_price * sign e, cast(0 as bigint) n, entry_price * (sign - 0.10) stop, 0 session, cast(null as date) d, cast(null as double) day_worst, cast(null as timestamp) pt, cast(null as double) pp, cast(null as timestamp) xt, cast(null as double) xp, cast(null as varchar) xr from pos
  union all
  select symbol, sign, d0, e, n, case when part then paid - abs(paid) * 0.05 when gap or hit then stop when best >= e + abs(e) * 0.12 then greatest(stop, best - abs(best) * 0.02) else stop end, session, bd, day_worst,
    case when part then candle_time else pt end, case when part then paid else pp end, case when gap or hit then candle_time end, case when gap then o when hit then stop end,
    case when gap then 'GAP_THROUGH_STOP' when hit then case when abs(stop - e) <= abs(e) * 1e-5 + 1e-8 then 'STOP_BREAKEVEN' when stop > e then 'STOP_TRAIL' else 'STOP_INITIAL' end end
  from (select *, not gap and not part and worst <= stop hit from (
    select *, not gap and bd = d0 and pt is null and best >= e + abs(e) * 0.3 part, greatest(o, e + abs(e) * 0.3) paid from (
      select *, fresh and bd <> d0 and o <= stop gap from (
        select symbol, sign, d0, e, bn n, session2 session, bd, fresh, pt, pp, candle_time, o, best, worst, case when fresh then worst else least(worst, day_worst) end day_worst,
          case when fresh and bd <> d0 and session2 >= 2 and d is not null then greatest(stop, day_worst) else stop end stop
        from (select w.symbol, w.sign, w.d0, w.e, w.stop, w.d, w.day_worst, w.pt, w.pp, b.n bn, b.d bd, b.candle_time, b.o, b.best, b.worst, w.d is distinct from b.d fresh, w.session + case when w.d is distinct from b.d and b.d <> w.d0 then 1 else 0 end session2
              from walk w join at_bars b on b.symbol = w.symbol and b.n = w.n + 1 where w.xt is null))))))"""


@query(
    "with recursive "
    + BARS
    + ",\n"
    + FOLLOWED.replace("at_bars as (", "at_bars as materialized (").replace("pos as (", "pos as materialized (", 1)
    + """
select symbol, 'PARTIAL_EXIT' event, pt event_time, round(pp * sign, 6) price, 'PARTIAL_EXIT' reason from (select symbol, sign, max(pt) pt, arg_max(pp, n) pp from walk group by symbol, sign) where pt is not null
union all select symbol, 'EXIT', xt, round(xp * sign, 6), xr from walk where xt is not null"""
)
def r7_follow_positions(spark, sf):
    """A position a symbol and day, long on even days, followed for five days."""
    b = intraday(spark, sf).select("symbol", "date", "candle_time", "open", "high", "low", "close")
    key = lambda d: F.concat_ws("@", "symbol", F.col(d).cast("string"))
    first = b.where(F.hour("candle_time") >= 2).groupBy("symbol", "date").agg(F.min("candle_time").alias("entry_time"), F.min_by("close", "candle_time").alias("entry_price"))
    side = F.when(F.dayofmonth("date") % 2 == 0, "LONG").otherwise("SHORT")
    opened = first.select(key("date").alias("symbol"), side.alias("direction"), "entry_time", "entry_price", (F.col("entry_price") * F.when(side == "LONG", 0.9).otherwise(1.1)).alias("stop"))
    days = b.withColumn("start", F.explode(F.sequence(F.date_sub("date", 4), F.col("date")))).withColumn("symbol", key("start"))
    rules = positions.Rules(activation=0.12, tighten_after=2, partial_pct=0.3)
    return positions.follow_batch(days.select("symbol", "candle_time", "open", "high", "low"), opened, rules).select("symbol", "event", "event_time", F.round("price", 6).alias("price"), "reason")


# Order statistics and checks by direction


@query(
    sql(DAILY, FEATURES, f"""x as (select *, case when close > 0 then (high - low) / close end share, lag(atr_20) over {W} last_atr from feat),
q as (select symbol, date, last_atr, quantile_cont(atr_20, 0.2) over (partition by symbol order by date rows between 20 preceding and 1 preceding) aq, count(atr_20) over (partition by symbol order by date rows between 20 preceding and 1 preceding) na,
  quantile_cont(share, 0.5) over (partition by symbol order by date rows between 15 preceding and 1 preceding) rm, count(share) over (partition by symbol order by date rows between 15 preceding and 1 preceding) nr,
  quantile_cont(share, 0.2) over (partition by symbol order by date rows between 60 preceding and 1 preceding) rq from x)""",
    select="select symbol, date, round(aq, 6) atr_quantile, round(rm, 9) range_median, round(rq, 9) range_quantile, coalesce(na >= 5 and last_atr <= aq + 1e-9, false) narrow, coalesce(nr >= 3 and rm <= rq + 1e-12, false) consolidated from q")
)
def w28_range_quantiles(spark, sf):
    q = frames.quiet_ranges(feats(spark, sf))
    return q.select("symbol", "date", F.round("atr_quantile", 6).alias("atr_quantile"), F.round("range_median", 9).alias("range_median"), F.round("range_quantile", 9).alias("range_quantile"), "narrow", "consolidated")


@query(
    sql(DAILY, FEATURES, DERIVED, """c as (select *, cast(symbol as int) % 2 = 1 short from derived),
k as (select symbol, date, coalesce(case when short then close_pos_in_range <= 0.3 else close_pos_in_range >= 0.7 end, false) h,
  prev_range is not null and prev_close is not null and prev_open is not null and atr_20 is not null and (prev_range < atr_20 * 0.5 or case when short then prev_close > prev_open else prev_close < prev_open end) n,
  coalesce(ret_1d_lag1 <= 0, false) or coalesce(ret_1d_lag2 <= 0, false) two, coalesce(prior_breakouts_30d <= 2, false) y, coalesce(vol_dryup_ratio < 1.3, false) c,
  cast(coalesce(close > ma_20, false) as int) + cast(coalesce(ret_5d > 0, false) as int) + cast(coalesce(r2_65 >= 0.7, false) as int) >= 2 l from c)""",
    select="select symbol, date, h, n, two, y, c, l, cast(h as int) + cast(n as int) + cast(two as int) + cast(y as int) + cast(c as int) + cast(l as int) >= 5 passed from k")
)
def p7_directed_checks(spark, sf):
    f = features.derived_features(rounded(feats(spark, sf)))
    checks = ex.directed_checks(F.when(F.col("symbol").cast("int") % 2 == 1, "SHORT").otherwise("LONG"))
    f = f.select("symbol", "date", *(x.alias("two" if n == "2" else n) for n, x in checks.items()))
    return f.withColumn("passed", ex.passes({n: F.col(n) for n in ("h", "n", "two", "y", "c", "l")}))


# Stores and their states


def year_store(spark: SparkSession, sf: str):
    """Daily bars stored by year."""
    path = shared_path(spark, "bars")
    incremental.write_slice(daily(spark, sf), path)
    return src.read_bars(spark, path, T.StructType([*daily(spark, sf).schema, T.StructField("year", T.IntegerType())]))


RECENT = "select symbol, date, ret_252d, round(atr_20, 6) atr_20, range_percentile_252, ma_200, breakout_4pct_up_90d, r2_65, atr_compress_ratio from feat where date >= date '1998-01-01'"


@query(sql(DAILY, FEATURES, select=RECENT))
def m3_daily_from_store(spark, sf):
    store = year_store(spark, sf)
    new = incremental.daily_from_store(store, src.partition_states(store, ["symbol", "year"]), date(1998, 1, 1))
    return rounded(new).select("symbol", "date", "ret_252d", F.round("atr_20", 6).alias("atr_20"), "range_percentile_252", "ma_200", "breakout_4pct_up_90d", "r2_65", "atr_compress_ratio")


HASHED = """h as (select *, cast('0x' || substr(sha256(concat(%s)), 1, 15) as bigint) x from %s)"""


def hashed(source: str, columns: list[str]) -> str:
    return HASHED % (", ".join(f"coalesce(octet_length(encode(cast({c} as varchar))) || ':' || cast({c} as varchar), '-')" for c in sorted(columns)), source)


BAR = ["symbol", "date", "open", "high", "low", "close", "volume"]


@query(sql(DAILY, hashed("daily", BAR), select="select year(date) as year, count(*) row_count, min(date) first_date, max(date) last_date, cast(sum(x) as varchar) content_hash, 'READY' state from h group by 1"))
def s16_registry_hashes(spark, sf):
    return src.partition_registry(daily(spark, sf).withColumn("year", F.year("date")), ["year"]).drop("symbols")


@query(
    sql(DAILY, hashed("daily", BAR), select="select count(*) n_rows, min(date) first_date, max(date) last_date, substr(sha256(cast(sum(x) as varchar) || ':' || min(date) || ':' || max(date) || ':' || count(*)), 1, 16) dataset_hash, true symbols_within from h")
)
def m2_merged_states(spark, sf):
    """The dataset's state out of those of its years, held against the full one."""
    bars = daily(spark, sf)
    merged = incremental.with_hash(src.merged_state(src.partition_states(bars.withColumn("year", F.year("date")), ["year"])))
    exact = bars.agg(F.countDistinct("symbol").alias("exact"))
    within = F.abs(F.col("n_symbols") - F.col("exact")) <= F.greatest(F.col("exact") * 0.05, F.lit(1))
    return merged.join(F.broadcast(exact)).select("n_rows", "first_date", "last_date", "dataset_hash", within.alias("symbols_within"))


@query(sql(DAILY, hashed("daily", BAR), select="select count(*) n_rows, count(distinct symbol) n_symbols, min(date) first_date, max(date) last_date, substr(sha256(cast(sum(x) as varchar) || ':' || min(date) || ':' || max(date) || ':' || count(*)), 1, 16) dataset_hash from h"))
def m2_dataset_hash(spark, sf):
    return incremental.dataset_state(daily(spark, sf))


PART_EDGES = "edges as (select p_partkey name, p_partkey // 3 depends_on from part where p_partkey % 7 <> 0 union all select p_partkey, p_partkey + 5 from part where p_partkey % 11 = 0)"


@query(f"""with recursive {PART_EDGES},
seen(name) as (select p_partkey from part where p_partkey % 50 = 1 union select e.name from seen s join edges e on e.depends_on = s.name)
select name from seen""")
def m6_stale_cascade(spark, sf):
    p = src.table(spark, sf, "part").select(F.col("p_partkey").alias("name"))
    n = F.col("name")
    edges = p.where(n % 7 != 0).select("name", F.floor(n / 3).cast("long").alias("depends_on")).unionByName(p.where(n % 11 == 0).select("name", (n + 5).alias("depends_on")))
    return incremental.stale_cascade(p.where(n % 50 == 1), edges).select("name")


# Files with broken lines


@query(
    sql(DAILY, """k as (select *, cast(symbol as int) * 31 + day(date) m from daily),
r as (select case when m % 17 in (0, 1, 2) then 'malformed_line' when m % 17 = 3 then 'null_value' when m % 17 = 4 and low < high then 'high_below_low' when m % 17 = 4 then cast(null as varchar) when m % 17 = 5 then 'negative_volume' end reason, m % 17 in (0, 1, 2) broken, close from k)""",
    select="select reason, count(*) n_rows, count(*) filter (broken) n_lines, sum(case when reason is null then close end) closes from r group by reason")
)
def q16_checked_lines(spark, sf):
    """Bars written as lines, some broken, read back with the reason of each bad one."""
    b = daily(spark, sf).withColumn("m", F.col("symbol").cast("int") * 31 + F.dayofmonth("date"))
    k, text = F.col("m") % 17, lambda c: F.col(c).cast("string")
    low, high = F.when(k == 4, F.col("high")).otherwise(F.col("low")), F.when(k == 4, F.col("low")).otherwise(F.col("high"))
    fields = ["symbol", text("date"), text("open"), high.cast("string"), low.cast("string"), F.when(k == 3, "").otherwise(text("close")), F.when(k == 5, F.lit(-1)).otherwise(F.col("volume")).cast("string")]
    whole = F.concat_ws(",", *fields)
    # a field too few, a field too many, a field that is no number
    line = F.when(k == 0, F.concat_ws(",", *fields[:5])).when(k == 1, F.concat(whole, F.lit(",more"))).when(k == 2, F.concat_ws(",", *fields[:2], F.lit("x"), *fields[3:])).otherwise(whole)
    path = shared_path(spark, "lines")
    b.select(line.alias("value")).write.text(path)
    schema = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("date", T.DateType()), *(T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close")), T.StructField("volume", T.LongType())])
    found = quality.read_checked(spark, path, schema, header="false")
    return found.groupBy("reason").agg(F.count("*").alias("n_rows"), F.count("line").alias("n_lines"), F.sum(F.when(F.col("reason").isNull(), F.col("close"))).alias("closes"))
