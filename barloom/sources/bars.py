"""Reading, cleaning and writing bars.

Daily bars: symbol, date, open, high, low, close, volume.  Intraday bars add
candle_time.  The store is Parquet partitioned by year; every function is a
plan over DataFrames, and nothing here loops over symbols or files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAILY_SCHEMA = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("date", T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close")]
    + [T.StructField("volume", T.LongType())]
)
INTRADAY_SCHEMA = T.StructType(DAILY_SCHEMA.fields[:2] + [T.StructField("candle_time", T.TimestampNTZType())] + DAILY_SCHEMA.fields[2:])
PRICES = ("open", "high", "low", "close")
#: What orders the trades of a day.
PLACE = ("l_orderkey", "l_linenumber", "l_partkey")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the benchmark tables: suppliers are symbols, unit prices are trades.

    There is about one trade a bar, so trades are dealt by symbol at once: bars and
    all windows over them need no second exchange, and no sort but that of the bars.
    """
    trades = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("symbol"),
        F.col("l_shipdate").cast("date").alias("date"),
        (F.floor(F.col("l_extendedprice") / F.col("l_quantity")) * F.lit(1.0)).alias("price"),
        F.col("l_quantity").alias("quantity"),
        *PLACE,
    )
    # the place is put together behind the exchange: a struct within a row takes 16 bytes more to deal and to sort
    return roll_up(trades.repartition("symbol"), ["symbol", "date"], F.struct(*PLACE), "price", "price", "price", "price", "quantity")


def intraday_from_events(spark: SparkSession, sf_dir: str, minutes: int = 5) -> DataFrame:
    """Intraday bars of the events table: event types are symbols, values are prices."""
    ticks = table(spark, sf_dir, "events").withColumn("w", F.window("ts", f"{minutes} minutes"))
    ticks = ticks.select(F.col("event_type").alias("symbol"), F.col("w.start").alias("candle_time"), "event_id", "value", F.lit(1).alias("one"))
    bars = roll_up(ticks, ["symbol", "candle_time"], "event_id", "value", "value", "value", "value", "one")
    return bars.select("symbol", F.to_date("candle_time").alias("date"), "candle_time", *PRICES, "volume")


def roll_up(df: DataFrame, keys: list[str], order: str | Column, open: str, high: str, low: str, close: str, volume: str) -> DataFrame:
    """First open, highest high, lowest low, last close and total volume of each key; input order does not matter."""
    return df.groupBy(*keys).agg(
        F.min_by(open, order).alias("open"),
        F.max(high).alias("high"),
        F.min(low).alias("low"),
        F.max_by(close, order).alias("close"),
        F.sum(volume).cast("long").alias("volume"),
    )


def intraday_to_daily(bars: DataFrame) -> DataFrame:
    """Daily bars from intraday ones."""
    return roll_up(bars, ["symbol", "date"], "candle_time", *PRICES, "volume")


def read_bars(spark: SparkSession, path: str, schema: T.StructType = DAILY_SCHEMA) -> DataFrame:
    """Bars under a path, files of older schemas included; an empty typed frame if there are none."""
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.option("mergeSchema", True).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return spark.createDataFrame([], schema)
        raise
    return project_existing(found, schema)


def project_existing(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of schema, cast; NULL where df lacks one or a value does not fit."""
    return df.select([F.expr(f"try_cast(`{f.name}` as {f.dataType.simpleString()})").alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def scoped(bars: DataFrame, start=None, end=None, symbols: DataFrame | list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Bars of a date range and of some symbols; unknown columns are refused before anything runs.

    The conditions reach the Parquet scan.  A frame of symbols is a semi join.
    """
    if start is not None:
        bars = bars.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        bars = bars.where(F.col("date") <= F.lit(end).cast("date"))
    if isinstance(symbols, DataFrame):
        bars = bars.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
    elif symbols is not None:
        bars = bars.where(F.col("symbol").isin(symbols))
    if columns is not None:
        if unknown := set(columns) - set(bars.columns):
            raise ValueError(f"unknown columns: {sorted(unknown)}")
        bars = bars.select(columns)
    return bars


#: Other names of bar columns, in lower case.
ALIASES = {"ticker": "symbol", "scrip": "symbol", "trading_date": "date", "datetime": "timestamp", "time": "timestamp", "date_time": "timestamp", "vol": "volume", "qty": "volume", "o": "open", "h": "high", "l": "low", "c": "close"}
#: Date and time formats of bar files, tried in this order.
DATE_FORMATS = ("yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "yyyyMMdd", "dd-MMM-yyyy")
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "dd-MM-yyyy HH:mm", "dd/MM/yyyy HH:mm:ss", "yyyy-MM-dd HH:mm")


def normal_names(df: DataFrame) -> DataFrame:
    """Columns trimmed, in lower case, with blanks as underscores and other names replaced."""
    names = [c.strip().lower().replace(" ", "_") for c in df.columns]
    return df.toDF(*[ALIASES.get(c, c) for c in names])


def first_time(text: Column, formats: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats))


def number(text: Column) -> Column:
    """A number with thousands separators, or NULL."""
    return F.regexp_replace(F.trim(text), ",", "").try_cast("double")


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """Daily or minute bars from delimited files with a header line each.

    Unless one is given, a file's delimiter is the commonest of , tab ; | in
    its first line.  Files may have headers of their own: those with the same
    first line are read together.  Symbols come from a column or else from the
    file name.  Offsets at the end of a time are dropped: bar times are those
    of the exchange.  Values that are no numbers or dates become NULL; rows
    without a date go.
    """
    # one short row a file; Spark's listing holds the files on the driver as well
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    heads = lines.where("at = 0").groupBy("file").agg(F.min_by("value", "n").alias("head")).collect()
    kinds: dict[str, list[str]] = {}
    for row in sorted(heads):
        kinds.setdefault(row.head, []).append(row.file)
    parts = [_delimited(spark, files, delimiter or max(",\t;|", key=head.count)) for head, files in sorted(kinds.items())]
    if not parts:
        fields = "symbol string, date date, candle_time timestamp_ntz, " + ", ".join(f"{c} double" for c in PRICES) + ", volume long"
        return spark.createDataFrame([], fields)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _delimited(spark: SparkSession, files: list[str], delimiter: str) -> DataFrame:
    raw = normal_names(spark.read.options(header=True, sep=delimiter).csv(files))
    symbol = F.col("symbol") if "symbol" in raw.columns else F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1)
    stamp = F.col("timestamp") if "timestamp" in raw.columns else F.col("date")
    text = F.regexp_replace(F.trim(stamp), r"([ T]?\d{2}:\d{2}(?::\d{2})?)(?:[+-]\d{2}:?\d{2}|Z)$", "$1")
    time = first_time(text, TIME_FORMATS)
    out = raw.select(
        F.upper(F.trim(symbol)).alias("symbol"),
        F.to_date(F.coalesce(time, first_time(text, DATE_FORMATS))).alias("date"),
        time.cast("timestamp_ntz").alias("candle_time"),
        *(number(F.col(c)).alias(c) for c in PRICES),
        F.floor(number(F.col("volume"))).cast("long").alias("volume"),
    )
    return out.where(F.col("date").isNotNull())


def normalize_daily(raw: DataFrame) -> DataFrame:
    """Typed daily bars: the first ten characters of the date, failed casts to NULL, rows without prices out, last row of a key wins."""
    raw = normal_names(raw)
    order = "load_seq" if "load_seq" in raw.columns else None
    out = raw.select(
        F.col("symbol").cast("string").alias("symbol"),
        F.substring(F.col("date").cast("string"), 1, 10).try_cast("date").alias("date"),
        *(F.col(c).cast("string").try_cast("double").alias(c) for c in PRICES),
        F.floor(F.col("volume").cast("string").try_cast("double")).cast("long").alias("volume"),
        (F.col(order) if order else F.monotonically_increasing_id()).alias("load_seq"),
    ).dropna(subset=["date", *PRICES])
    return last_wins(out, ["symbol", "date"], "load_seq").drop("load_seq")


def normalize_intraday(raw: DataFrame, from_zone: str = "UTC", to_zone: str = "Asia/Kolkata") -> DataFrame:
    """Typed intraday bars in naive exchange-local time, with true_range, last row of a bar wins."""
    raw = normal_names(raw)
    time = local_time(F.col("timestamp"), from_zone, to_zone)
    out = raw.select(F.col("symbol").cast("string").alias("symbol"), time.alias("candle_time"), *(F.col(c).try_cast("double").alias(c) for c in PRICES), F.col("volume").try_cast("long").alias("volume"), F.monotonically_increasing_id().alias("load_seq"))
    out = last_wins(out.dropna(subset=["candle_time", *PRICES]), ["symbol", "candle_time"], "load_seq").drop("load_seq")
    return out.withColumn("date", F.to_date("candle_time")).withColumn("true_range", F.col("high") - F.col("low"))


def vendor_candles(raw: DataFrame, from_zone: str = "UTC", to_zone: str = "Asia/Kolkata") -> DataFrame:
    """Bars from rows (symbol, chunk_seq, candles), candles being arrays of [time, open, high, low, close, volume] as text.

    Chunks may overlap; of one bar the later chunk's stays.
    """
    c = raw.select("symbol", "chunk_seq", F.explode("candles").alias("c"))
    at = lambda i, t: F.get("c", F.lit(i)).try_cast(t)
    out = c.select("symbol", "chunk_seq", local_time(at(0, "timestamp"), from_zone, to_zone).alias("candle_time"), *(at(i + 1, "double").alias(p) for i, p in enumerate(PRICES)), F.floor(at(5, "double")).cast("long").alias("volume"))
    out = last_wins(out.dropna(subset=["candle_time", *PRICES]), ["symbol", "candle_time"], "chunk_seq").drop("chunk_seq")
    return out.withColumn("date", F.to_date("candle_time")).select("symbol", "date", "candle_time", *PRICES, "volume")


def local_time(time: Column, from_zone: str, to_zone: str) -> Column:
    return F.convert_timezone(F.lit(from_zone), F.lit(to_zone), time.cast("timestamp_ntz"))


def last_wins(df: DataFrame, keys: list[str], order: str, keep: str = "last") -> DataFrame:
    """One row of each key: that of the largest (or, keep='first', the smallest) order."""
    by = F.col(order).desc_nulls_last() if keep == "last" else F.col(order).asc_nulls_last()
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(by))).where("_place = 1").drop("_place")


def merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows and new rows; of one key the new one stays, whatever it holds."""
    both = old.withColumn("_load", F.lit(0)).unionByName(new.withColumn("_load", F.lit(1)), allowMissingColumns=True)
    return last_wins(both, keys, "_load").drop("_load")


def append_bars(spark: SparkSession, path: str, new: DataFrame, keys: list[str], mode: str = "append") -> None:
    """Merge bars into a store partitioned by year; only the years that new touches are rewritten.

    The merged years are written beside the store first and moved in from
    there, so nothing is overwritten that is still to be read: a job lost on
    the way leaves the store, or the merged years, whole.
    """
    new = new.withColumn("year", F.year("date"))
    beside = f"{path.rstrip('/')}-merging-{uuid.uuid4().hex}"
    if mode == "append":
        stored = read_bars(spark, path, T.StructType([*[f for f in new.schema if f.name != "year"], T.StructField("year", T.IntegerType())]))
        touched = stored.join(new.select("year").distinct(), "year", "left_semi")
        merge(touched, new, keys).write.parquet(beside)
        new = spark.read.schema(new.schema).parquet(beside)
    new.repartition("year").sortWithinPartitions(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("year").parquet(path)
    if mode == "append":
        folder = spark._jvm.org.apache.hadoop.fs.Path(beside)
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def fetch_windows(requests: DataFrame, coverage: DataFrame) -> DataFrame:
    """What is left to fetch of requests (symbol, start_date, end_date), given stored coverage (symbol, first, last).

    Nothing stored: all.  Fully covered: skip.  Covered up to a day inside:
    from the next day on.  Stored data begins inside: up to the day before, if
    it reaches the end, else all.  Apart: all.
    """
    r = requests.join(coverage, "symbol", "left")
    start, end, first, last = (F.col(c) for c in ("start_date", "end_date", "first", "last"))
    covered = (first <= start) & (last >= end)
    return r.select(
        "symbol",
        F.when((first <= start) & (last >= start) & ~covered, F.date_add(last, 1)).otherwise(start).alias("fetch_start"),
        F.when((first > start) & (first <= end) & (last >= end), F.date_sub(first, 1)).otherwise(end).alias("fetch_end"),
        F.coalesce(covered, F.lit(False)).alias("skip"),
    )


def coverage(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.min("date").alias("first"), F.max("date").alias("last"))


def minute_of_day(time: Column) -> Column:
    return F.hour(time) * 60 + F.minute(time)


def in_session(bars: DataFrame, start: int = 555, end: int = 930) -> DataFrame:
    """Bars that begin from minute start to minute end of the day; by default 09:15 to 15:30."""
    return bars.where(minute_of_day(F.col("candle_time")).between(start, end))


def alignment_issues(bars: DataFrame, open_minute: int = 555, legacy_minute: int = 225) -> DataFrame:
    """Per symbol and stored year, what is wrong with the time of the first bar."""
    first = bars.groupBy("symbol", "year").agg(F.min("candle_time").alias("first_candle"))
    minute = minute_of_day(F.col("first_candle"))
    issue = (
        F.when(F.year("first_candle") != F.col("year"), "year_mismatch")
        .when(minute == legacy_minute, "legacy_utc_naive")
        .when(minute != open_minute, "first_candle_not_at_open")
    )
    return first.withColumn("issue", issue).where(F.col("issue").isNotNull())


def repair_alignment(bars: DataFrame, issues: DataFrame, shift: str = "INTERVAL '5:30' HOUR TO MINUTE") -> DataFrame:
    """Bars of symbol-years flagged legacy_utc_naive moved by shift, with their dates; all others unchanged."""
    bad = issues.where("issue = 'legacy_utc_naive'").select("symbol", "year", F.lit(True).alias("_bad"))
    time = F.when(F.col("_bad"), F.col("candle_time") + F.expr(shift)).otherwise(F.col("candle_time"))
    out = bars.join(bad, ["symbol", "year"], "left").withColumn("candle_time", time)
    return out.withColumn("date", F.when(F.col("_bad"), F.to_date("candle_time")).otherwise(F.col("date"))).drop("_bad").select(bars.columns)


def row_hash(columns: list[str]) -> Column:
    """A number of 60 bits for a row, the start of the SHA-256 of its values as text: `-` for null, else the length in bytes, a colon and the text.

    Two rows that differ in where a null is differ here too, and any engine with
    SHA-256 can check it.
    """
    texts = [F.col(f"`{c}`").cast("string") for c in sorted(columns)]
    whole = F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))
    return F.conv(F.substring(F.sha2(whole, 256), 1, 15), 16, 10).cast("decimal(20,0)")


def partition_states(bars: DataFrame, keys: list[str], distinct: str = "symbol") -> DataFrame:
    """Per partition: rows, date range, the sum of the row hashes and a sketch of the distinct symbols; states of disjoint rows add up (merged_state)."""
    rest = [c for c in bars.columns if c not in keys]
    return bars.groupBy(*keys).agg(
        F.count("*").alias("row_count"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.sum(row_hash(rest)).cast("decimal(38,0)").alias("content"), F.hll_sketch_agg(distinct).alias("symbols")
    )


def merged_state(states: DataFrame, *keys: str) -> DataFrame:
    """The state of all rows, or of those of each key, from partition states alone.

    Rows, dates and content are exact: the sum of hashes does not depend on the
    order of rows or on how they were parted, and counts repeated rows.  The
    number of symbols is an estimate, within about 2 % (12 bits a sketch).
    """
    return states.groupBy(*keys).agg(
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("n_rows"), F.hll_sketch_estimate(F.hll_union_agg("symbols")).alias("n_symbols"), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"),
        F.coalesce(F.sum("content"), F.lit(0)).cast("decimal(38,0)").cast("string").alias("content"),
    )


def partition_registry(bars: DataFrame, keys: list[str], known: DataFrame | None = None) -> DataFrame:
    """Per partition: rows, date range, content hash and state; against an earlier registry STALE or SUPERSEDED marks changes."""
    now = partition_states(bars, keys).withColumn("content_hash", F.col("content").cast("string")).drop("content")
    now = now.withColumn("state", F.when(F.col("row_count") > 0, "READY").otherwise("FAILED"))
    if known is None:
        return now
    old = known.where("state = 'READY'").select(*keys, F.col("content_hash").alias("_old"), F.lit(True).alias("_was"))
    merged = now.join(old, keys, "full")
    state = F.when(F.col("row_count").isNull(), "STALE").when(F.col("_was") & (F.col("_old") != F.col("content_hash")), "SUPERSEDED").otherwise(F.col("state"))
    return merged.withColumn("state", state).drop("_old", "_was")


def reference_symbols(raw: DataFrame, segment: str, kind: str, least: int = 1) -> DataFrame:
    """Distinct symbols of one segment and type of an instrument list; an error if there are fewer than least."""
    out = raw.where((F.col("segment") == segment) & (F.col("instrument_type") == kind)).select(F.upper(F.trim("tradingsymbol")).alias("symbol")).where("symbol <> ''").distinct()
    if out.limit(least).count() < least:
        raise ValueError(f"fewer than {least} symbols")
    return out


def write_results(df: DataFrame, path: str, partition: str = "exp_id", form: str = "parquet") -> None:
    """Append a result table partitioned by experiment; writing an experiment again replaces it."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).format(form).option("header", True).save(path)


def write_lake(bars: DataFrame, path: str) -> None:
    """Year and month folders in one write."""
    out = bars.withColumn("year", F.year("date")).withColumn("month", F.date_format("date", "MM"))
    out.repartition("year", "month").sortWithinPartitions("symbol", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("year", "month").parquet(path)
