"""Incremental refresh: affected ranges, slices replaced, staleness, idempotent runs.

Functions that plan are pure; those that write replace whole partitions of a
Parquet table, so a lost or repeated job leaves either the old or the new rows.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import features as feats
from ..sources.bars import last_wins, row_hash
from ..sources.shared import stored

#: Calendar days that give the longest window its rows, and sessions for breadth.
DAILY_CONTEXT, BREADTH_CONTEXT = 372, 130
#: Rows of a symbol that the windows of daily features and of breadth look back on, and dates of the breadth ratios.
ROW_CONTEXT, BREADTH_ROWS, RATIO_DAYS = 260, 70, 10


def refresh_plan(policy: str, last_end: date | None, new_start: date, new_end: date, window_days: int = 0) -> dict | None:
    """Which dates to read and to write for a feature table, or None if nothing has to be done.

    NONE rebuilds all; APPEND writes what is new; ROLLING_WINDOW reads a
    window before it as well; DEPENDENCY_CASCADE rewrites from the first
    changed date on.
    """
    if policy not in ("NONE", "APPEND", "ROLLING_WINDOW", "DEPENDENCY_CASCADE"):
        raise ValueError(f"unknown policy {policy}")
    if policy == "NONE" or last_end is None:
        return {"read_from": None, "write_from": None, "write_to": new_end}
    start = new_start if policy == "DEPENDENCY_CASCADE" else max(new_start, last_end + timedelta(days=1))
    if start > new_end:
        return None
    return {"read_from": start - timedelta(days=window_days), "write_from": start, "write_to": new_end}


def dataset_state(bars: DataFrame) -> DataFrame:
    """Rows, symbols, range and a hash of all rows that does not depend on their order, and tells nulls and repeated rows."""
    content = F.coalesce(F.sum(row_hash(bars.columns)), F.lit(0)).cast("decimal(38,0)").cast("string")
    return with_hash(bars.agg(F.count("*").alias("n_rows"), F.countDistinct("symbol").alias("n_symbols"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), content.alias("content")))


def with_hash(state: DataFrame) -> DataFrame:
    """States with dataset_hash in place of content: of the rows, their range and their hashes, not of what may be an estimate."""
    whole = F.concat_ws(":", "content", F.coalesce(F.col("first_date").cast("string"), F.lit("-")), F.coalesce(F.col("last_date").cast("string"), F.lit("-")), F.col("n_rows").cast("string"))
    return state.withColumn("dataset_hash", F.substring(F.sha2(whole, 256), 1, 16)).drop("content")


def unchanged(state: DataFrame, feature: str, version: str, dataset_hash: str) -> bool:
    """Whether a table of feature states (feature, version, dataset_hash) already has this build."""
    return not state.where((F.col("feature") == feature) & (F.col("version") == version) & (F.col("dataset_hash") == dataset_hash)).isEmpty()


def with_rows_before(df: DataFrame, since: Column, rows: int) -> DataFrame:
    """Rows from `since` on and each symbol's last `rows` rows before it."""
    before = F.col("date") < since
    # counted on from the first row in the order of all other windows: a window that ran back from the last would sort the rows twice more
    whole, up_to = (F.count_if(before).over(w) for w in (Window.partitionBy("symbol"), feats.by_date().rowsBetween(Window.unboundedPreceding, -1)))
    df = df.withColumns({"_whole": whole, "_up_to": up_to})
    return df.where(~before | (F.col("_whole") - F.col("_up_to") <= rows)).drop("_whole", "_up_to")


def daily_since(bars: DataFrame, since: date, rows: int | None = None) -> DataFrame:
    """Daily features from a date on, equal to those of a full build as long as the context holds the longest window.

    The context is DAILY_CONTEXT calendar days, which prunes the scan; with
    `rows` (ROW_CONTEXT is enough) it is as many rows of each symbol, for bars
    with gaps.
    """
    first = F.lit(since)
    context = with_rows_before(bars, first, rows) if rows else bars.where(F.col("date") >= F.lit(since - timedelta(days=DAILY_CONTEXT)))
    return feats.daily_features(context).where(F.col("date") >= first)


def years_needed(states: DataFrame, since: date, rows: int) -> DataFrame:
    """(symbol, year) of the stored partitions that hold, of each symbol with rows in or after the year of `since`, all rows from that year on and the last `rows` before it.

    states (symbol, year, row_count) are those of the store's partitions, so no bar is read.
    """
    later = F.sum(F.when(F.col("year") < since.year, F.col("row_count")).otherwise(0)).over(Window.partitionBy("symbol").orderBy(F.desc("year")).rowsBetween(Window.unboundedPreceding, -1))
    alive = F.max("year").over(Window.partitionBy("symbol")) >= since.year
    marked = states.select("symbol", "year", (F.coalesce(later, F.lit(0)) < rows).alias("_short"), alive.alias("_alive"))
    return marked.where("_short and _alive").select("symbol", "year")


def daily_from_store(store: DataFrame, states: DataFrame, since: date, rows: int = ROW_CONTEXT) -> DataFrame:
    """Daily features from a date on out of a store partitioned by year, reading only the partitions that years_needed() names.

    The years are a handful and prune the scan's folders; within them only the
    symbols that need a year are kept.  Equal to a full build filtered by date.
    """
    need = years_needed(states, since, rows)
    years = [r.year for r in need.select("year").distinct().collect()]
    context = store.where(F.col("year").isin(years)).join(need, ["symbol", "year"], "left_semi").drop("year")
    return feats.daily_features(context).where(F.col("date") >= F.lit(since))


def intraday_since(bars: DataFrame, daily: DataFrame, since: date) -> DataFrame:
    """Intraday features from a date on; of the daily bars only each symbol's last session before it is needed besides."""
    return feats.intraday_features(bars.where(F.col("date") >= F.lit(since)), daily)


def breadth_since(features: DataFrame, since: date, rows: int | None = None, **limits: float) -> DataFrame:
    """Breadth from a date on, with the sessions before that its windows look at.

    With `rows` each symbol has as many rows before those of the ratios' dates,
    whatever the number of sessions that it missed.
    """
    days = features.where(F.col("date") < F.lit(since)).select("date").distinct().orderBy(F.desc("date")).limit(RATIO_DAYS if rows else BREADTH_CONTEXT)
    start = F.broadcast(days.agg(F.coalesce(F.min("date"), F.lit(since)).alias("_start")))
    joined = features.join(start)
    context = with_rows_before(joined, F.col("_start"), rows) if rows else joined.where(F.col("date") >= F.col("_start"))
    return feats.breadth(context.drop("_start"), **limits).where(F.col("date") >= F.lit(since))


def replace_dates(old: DataFrame, new: DataFrame, since: date) -> DataFrame:
    """old before a date, new from it on."""
    return old.where(F.col("date") < F.lit(since)).unionByName(new.where(F.col("date") >= F.lit(since)), allowMissingColumns=True)


def replace_symbols(old: DataFrame, new: DataFrame) -> DataFrame:
    """old without the symbols of new, and new."""
    return old.join(new.select("symbol").distinct(), "symbol", "left_anti").unionByName(new, allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    both = old.withColumn("_load", F.lit(0)).unionByName(new.withColumn("_load", F.lit(1)), allowMissingColumns=True)
    return last_wins(both, keys, "_load").drop("_load")


def write_slice(df: DataFrame, path: str) -> None:
    """Replace the year partitions that df holds; the others stay."""
    out = df.withColumn("year", F.year("date")).repartition("year").sortWithinPartitions("symbol", "date")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("year").parquet(path)


def stale_runs(runs: DataFrame, versions: DataFrame) -> DataFrame:
    """Runs (exp_id, strategy, strategy_hash, dataset_hash, code_hash, start_date, end_date) against current versions of their strategy: reasons, and whether there are any."""
    v = versions.select("strategy", *(F.col(c).alias(f"_{c}") for c in ("strategy_hash", "dataset_hash", "code_hash", "start_date", "end_date")))
    j = runs.join(v, "strategy", "left")
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    reasons = [
        F.when(F.col("_strategy_hash").isNull(), "strategy_unknown"),
        F.when(differs("strategy_hash") & F.col("_strategy_hash").isNotNull(), "strategy_changed"),
        F.when(differs("dataset_hash") & F.col("_dataset_hash").isNotNull(), "dataset_changed"),
        F.when(differs("code_hash") & F.col("_code_hash").isNotNull(), "code_changed"),
        F.when((F.col("end_date") < F.col("_end_date")) | (F.col("start_date") > F.col("_start_date")), "range_extended"),
    ]
    return j.withColumn("reasons", F.array_compact(F.array(*reasons))).withColumn("stale", F.size("reasons") > 0).select(*runs.columns, "reasons", "stale")


def stale_cascade(changed: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Everything to rebuild: the changed names (name), and what depends on them directly or over others, with the steps to the nearest changed one.

    dependencies are pairs (name, depends_on).  The frontier of new names is
    joined with them until it is empty, so cycles end and each name comes once;
    every round is stored, so the next one's plan is as short.  Null names are none.
    """
    edges = dependencies.select("name", "depends_on").where("name is not null and depends_on is not null").distinct()
    edges = stored(edges, "edges")
    found = stored(changed.select("name").where("name is not null").distinct().withColumn("steps", F.lit(0)), "found")
    frontier, steps = found, 0
    while not frontier.isEmpty():
        steps += 1
        reached = edges.join(frontier.select(F.col("name").alias("depends_on")), "depends_on", "left_semi").select("name").distinct()
        frontier = stored(reached.join(found, "name", "left_anti").withColumn("steps", F.lit(steps)), "found")
        found = found.unionByName(frontier)
    return found


def experiment_id(params: dict, dataset_hash: str, code_hash: str) -> str:
    """The same id for the same parameters, data and code."""
    import hashlib
    import json

    return hashlib.sha256(":".join([json.dumps(params, sort_keys=True, default=str), dataset_hash, code_hash]).encode()).hexdigest()[:16]


def drop_run(table: DataFrame, exp_id: str) -> tuple[DataFrame, DataFrame]:
    """A result table without a run, and how many rows went."""
    return table.where(F.col("exp_id") != exp_id), table.where(F.col("exp_id") == exp_id).agg(F.count("*").alias("removed"))

