"""Order statistics over sliding frames of rows.

Spark's frames have sums and extremes; a percentile of each frame would sort the
frame again for every row.  Here the rows of a symbol come in order, in batches of
many symbols, and a skip list follows the frames, which costs the logarithm of their
length a row.  A task holds a batch and the rows that its first frames look back on,
however long a symbol's history is and however many symbols there are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pandas.api.indexers import BaseIndexer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .features import by_date

BLOCK = 4096


def sliding_quantiles(df: DataFrame, wanted: dict[str, tuple[str, int, int, float]], carry: tuple[str, ...] = (), by: str = "symbol", order: str = "date", block: int = BLOCK) -> DataFrame:
    """by, order, the carried columns and each wanted name: (column, first, last, q) is the quantile q, interpolated, of a column over the rows from `first` to `last` before.

    NULL, NaN and infinite values are unknown and left out; a frame without a
    known value gives NULL.  Rows with equal by and order follow in any order.
    No frame looks back on more than `block` rows.
    """
    reach = max(first for _, first, _, _ in wanted.values())
    if reach > block or any(not 0 <= last <= first for _, first, last, _ in wanted.values()):
        raise ValueError("frames end at or before their row and are no longer than a block")
    used = sorted({c for c, *_ in wanted.values()})
    rows = df.select(by, order, *carry, *(F.col(c).cast("double").alias(f"_{c}") for c in used))
    # the window deals rows by symbol and gives them out in order, which the numbers prove
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order)))
    kept = [by, order, *carry]

    def follow(batches):
        class Frames(BaseIndexer):
            def get_window_bounds(self, num_values=0, min_periods=None, center=None, closed=None, step=None):
                return self.starts, self.ends

        before, seen = {c: np.empty(0) for c in used}, 0
        for batch in batches:
            n = np.asarray(batch.column("_n"), dtype=np.int64)
            if not len(n):
                continue
            previous = np.concatenate([[seen], n[:-1]])
            if not np.all((n == 1) | (n == previous + 1)):
                raise ValueError("rows of a symbol are not together and in order")
            old = len(before[used[0]])
            at = np.arange(old, old + len(n), dtype=np.int64)
            values = {c: np.concatenate([before[c], np.asarray(batch.column(f"_{c}").to_numpy(zero_copy_only=False), dtype=float)]) for c in used}
            columns = [batch.column(c) for c in kept]
            for column, first, last, q in wanted.values():
                # rows kept from the batch before have empty frames; starts and ends only grow
                frames = Frames()
                ends = np.maximum(at - last + 1, at - n + 1)
                frames.starts = np.concatenate([np.zeros(old, np.int64), np.maximum(np.maximum(at - first, at - n + 1), 0)])
                frames.ends = np.concatenate([np.zeros(old, np.int64), np.maximum(ends, frames.starts[old:])])
                found = pd.Series(values[column]).rolling(frames, min_periods=1).quantile(q).to_numpy()[old:]
                columns.append(pa.array(found, pa.float64(), mask=np.isnan(found)))
            yield pa.RecordBatch.from_arrays(columns, [*kept, *wanted])
            before, seen = {c: v[max(len(v) - reach, 0) :].copy() for c, v in values.items()}, n[-1]

    fields = {f.name: f for f in rows.schema.fields}
    schema = T.StructType([*(fields[c] for c in kept), *(T.StructField(c, T.DoubleType()) for c in wanted)])
    return rows.mapInArrow(follow, schema)


def quiet_ranges(features: DataFrame, atr_rows: int = 20, rows: int = 15, reference: int = 60, share: float = 0.20, block: int = BLOCK) -> DataFrame:
    """Per symbol and date: how the ranges of the days before compare with those of the weeks before.

    atr_quantile: the `share` quantile of atr_20 over the atr_rows rows before;
    narrow: the last of them is not above it, five or more being known.
    range_median: median of (high - low) / close over the rows before;
    range_quantile: their `share` quantile over the reference rows before;
    consolidated: the median is not above it, three or more being known.
    """
    before = lambda n: by_date().rowsBetween(-n, -1)
    f = features.withColumn("range_share", F.when(F.col("close") > 0, (F.col("high") - F.col("low")) / F.col("close")))
    f = f.withColumns({"_last": F.lag("atr_20").over(by_date()), "_atrs": F.count("atr_20").over(before(atr_rows)), "_ranges": F.count("range_share").over(before(rows))})
    wanted = {"atr_quantile": ("atr_20", atr_rows, 1, share), "range_median": ("range_share", rows, 1, 0.5), "range_quantile": ("range_share", reference, 1, share)}
    q = sliding_quantiles(f, wanted, ("_last", "_atrs", "_ranges"), block=block)
    flag = lambda test: F.coalesce(test, F.lit(False))
    return q.select(
        "symbol", "date", *wanted, flag((F.col("_atrs") >= 5) & (F.col("_last") <= F.col("atr_quantile"))).alias("narrow"), flag((F.col("_ranges") >= 3) & (F.col("range_median") <= F.col("range_quantile"))).alias("consolidated")
    )
