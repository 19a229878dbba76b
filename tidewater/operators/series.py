"""Grids, as-of and lagged joins, gap filling and rolling sums over bucketed series.

Windows are always partitioned (by market, source or venue): one global window would move
a whole series into one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def grid(spark: SparkSession, start_ms: int, end_ms: int, step_ms: int, name: str = "sample_ms") -> DataFrame:
    """Every bucket start of [start, end)."""
    n = max(0, -(-(end_ms - start_ms) // step_ms))
    return spark.range(n).select((F.lit(start_ms) + F.col("id") * step_ms).alias(name))


def spanned_grid(df: DataFrame, keys: Sequence[str], time: str, step: int) -> DataFrame:
    """Every bucket between a key's first and last one; nothing after the newest data."""
    ends = df.groupBy(*keys).agg(F.min(time).alias("_from"), F.max(time).alias("_to"))
    return ends.select(*keys, F.explode(F.sequence("_from", "_to", F.lit(step).cast("long"))).alias(time))


def gap_filled(bars: DataFrame, keys: Sequence[str], time: str, step: int, zero: Sequence[str]) -> DataFrame:
    """``bars`` with a row for every silent bucket, ``zero`` columns 0 there and others null."""
    full = spanned_grid(bars, keys, time, step).join(bars, [*keys, time], "left")
    return full.withColumns({c: F.coalesce(c, F.lit(0).cast(bars.schema[c].dataType)) for c in zero})


def asof(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    time: str,
    values: Sequence[str],
    tolerance: int | None = None,
    order: Sequence[str] = (),
    exact: bool = False,
) -> DataFrame:
    """Backward as-of join by one sort: the last right row of a key at or before each left row.

    Both sides are unioned and ordered by time, so no pairs of rows are made. ``tolerance``
    bounds the age, inclusive. ``order`` breaks ties among right rows of one time; ``exact``
    takes rows of the very same time only. ``asof_<time>`` is the time of the row taken.
    """
    ranks = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]
    none = [F.lit(None).cast(right.schema[c].dataType).alias(f"_o{i}") for i, c in enumerate(order)]
    picked = F.struct(F.col(time).alias("_t"), *values)
    kept = [c for c in left.columns if c not in (*by, time)]
    r = right.select(*by, time, F.lit(0).alias("_side"), *ranks, picked.alias("_v"), *(F.lit(None).cast(left.schema[c].dataType).alias(c) for c in kept))
    l = left.select(*by, time, F.lit(1).alias("_side"), *none, F.lit(None).cast(r.schema["_v"].dataType).alias("_v"), *kept)  # noqa: E741
    w = Window.partitionBy(*by).orderBy(time, "_side", *(f"_o{i}" for i in range(len(order))))
    both = r.unionByName(l).withColumn("_last", F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    age = F.col(time) - F.col("_last._t")
    good = age == 0 if exact else F.lit(True) if tolerance is None else age <= tolerance
    hit = F.when(good, F.col("_last"))
    return both.filter("_side = 1").select(
        *by, time, *kept, hit["_t"].alias(f"asof_{time}"), *(hit[v].alias(v) for v in values)
    )


def lagged(df: DataFrame, by: Sequence[str], time: str, value: str, lags: Mapping[str, int]) -> DataFrame:
    """``value`` minus its value exactly ``lag`` earlier, a column for each lag; null where that row is missing."""
    out = df
    for name, lag in lags.items():
        then = df.select(*by, (F.col(time) + lag).alias(time), F.col(value).alias(f"_{name}"))
        out = out.join(then, [*by, time], "left")
    return out.withColumns({n: F.col(value) - F.col(f"_{n}") for n in lags}).drop(*(f"_{n}" for n in lags))


def rolling(col: str, by: Sequence[str], time: str, width: int, step: int) -> Column:
    """Sum over the last ``width`` buckets by time range, the current one included."""
    w = Window.partitionBy(*by).orderBy(time).rangeBetween(-(width - 1) * step, 0)
    return F.sum(col).over(w)


def running(col: str, by: Sequence[str], time: str) -> Column:
    w = Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(col).over(w)


def with_gaps(df: DataFrame, by: Sequence[str], time: str, order: Sequence[str], gap: str = "gap_ms", high: str | None = None, width: int = 3_600_000) -> DataFrame:
    """``df`` with the time since the row before of its key, and with ``high`` the greatest such gap so far.

    ``order`` begins with ``time``. A key may have very many rows, so they are ordered within
    buckets of ``width`` only; one row for each bucket carries its last time and greatest gap
    on to the next ones.
    """
    keys = [*by, "_bucket"]
    inside = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("_bucket", F.floor(F.col(time) / width)).withColumn("_gap", F.col(time) - F.lag(time).over(inside))
    if high:
        rows = rows.withColumn("_high", F.max("_gap").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.groupBy(*keys).agg(F.min(time).alias("_first"), F.max(time).alias("_last"), F.max("_gap").alias("_most"))
    across = Window.partitionBy(*by).orderBy("_bucket")
    ends = ends.withColumn("_step", F.col("_first") - F.lag("_last").over(across))
    peak = F.greatest("_most", "_step")
    ends = ends.withColumn("_peak", F.max(peak).over(across.rowsBetween(Window.unboundedPreceding, -1)))
    met = rows.join(ends.select(*keys, "_step", "_peak"), keys)
    own = F.coalesce("_gap", F.when(F.row_number().over(inside) == 1, F.col("_step")))
    out = met.withColumn(gap, own)
    if high:
        out = out.withColumn(high, F.greatest("_peak", "_step", "_high"))
    return out.select(*df.columns, gap, *([high] if high else []))


def in_period(df: DataFrame, periods: DataFrame, time: str, start: str = "start_ms", end: str = "end_ms", width: int = 86_400_000) -> DataFrame:
    """Range join start <= time < end by equal buckets of ``width``, then the exact bounds.

    A period is given to every bucket it touches, so rows meet by an equi-join that
    shuffles or broadcasts as sizes ask for, never by a nested loop over all pairs.
    """
    low, high = F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)
    spread = periods.filter(F.col(start) < F.col(end)).withColumn("_bucket", F.explode(F.sequence(low, high)))
    rows = df.withColumn("_bucket", F.floor(F.col(time) / width))
    return rows.join(spread, "_bucket").filter((F.col(time) >= F.col(start)) & (F.col(time) < F.col(end))).drop("_bucket")
