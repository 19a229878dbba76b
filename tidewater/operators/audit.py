"""Coverage, gap, duplicate and reconciliation reports over bucketed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.scan import Running, scanned
from tidewater.operators.series import in_period, with_gaps


def coverage(df: DataFrame, by: Sequence[str], time: str, step: int, expected: Column) -> DataFrame:
    """rows, coverage_pct, max_gap (in steps) and gaps by key, time counted in distinct buckets."""
    w = Window.partitionBy(*by).orderBy(time)
    buckets = df.select(*by, time).distinct().withColumn("_gap", F.call_function("div", F.col(time) - F.lag(time).over(w), F.lit(step)))
    return buckets.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.round(F.lit(100.0) * F.count("*") / expected, 2).alias("coverage_pct"),
        F.max("_gap").alias("max_gap"),
        F.count_if(F.col("_gap") > 1).alias("gaps"),
    )


def period_coverage(df: DataFrame, periods: DataFrame, datasets: DataFrame, dataset: str, time: str, step: int) -> DataFrame:
    """rows and max_gap for every (period, dataset), silent pairs included.

    ``periods`` (period, start_ms, end_ms) and ``datasets`` are reports' parameters: a few
    rows each, and the only cross join is between these two.
    """
    inside = in_period(df, periods, time)
    found = with_gaps(inside.select("period", dataset, time), ["period", dataset], time, [time], "_gap").groupBy("period", dataset).agg(
        F.count("*").alias("rows"), F.max("_gap").alias("max_gap_ms"), F.count_if(F.col("_gap") > step).alias("gaps")
    )
    every = periods.select("period").crossJoin(F.broadcast(datasets))
    zero = F.lit(0).cast("long")
    return every.join(found, ["period", dataset], "left").withColumns({"rows": F.coalesce("rows", zero), "gaps": F.coalesce("gaps", zero)})


def missing(df: DataFrame, buckets: DataFrame, time: str) -> DataFrame:
    """One row: missing (how many), and their times as sorted text; for a grid of known, short length (else ``missing_runs``)."""
    absent = buckets.join(df.select(time).distinct(), time, "left_anti")
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(time)), lambda x: x.cast("string")), ",")
    return absent.agg(F.count("*").alias("missing"), F.min(time).alias("first_missing"), F.max(time).alias("last_missing"), listed.alias("missing_list"))


def missing_runs(df: DataFrame, by: Sequence[str], time: str, step: int) -> DataFrame:
    """A row for each run of empty buckets between two that have rows: start, end (inclusive) and how many.

    Buckets that have rows are compared with the one before, so the grid itself isn't made.
    """
    there = df.select(*by, time).distinct()
    rows = scanned(there, by, [time], {"_before": Running("last", F.col(time), False)}, step << 16)
    start, end = F.col("_before") + step, F.col(time) - step
    runs = rows.filter(end >= start).select(*by, start.alias(f"first_{time}"), end.alias(f"last_{time}"))
    return runs.withColumn("missing", F.expr(f"(last_{time} - first_{time}) div {step} + 1"))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with ``n``."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def bucket_cap(df: DataFrame, by: Sequence[str], bucket: Column, cap: int) -> DataFrame:
    """One row: the most rows in a bucket, and how many buckets hold more than ``cap``."""
    counts = df.groupBy(*by, bucket.alias("_bucket")).agg(F.count("*").alias("n"))
    return counts.agg(F.max("n").alias("max_rows"), F.count_if(F.col("n") > cap).alias("over_cap"), F.count("*").alias("buckets"))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, *conditions: Column) -> DataFrame:
    """One row: distinct child keys, and those without a parent (that meets the conditions too)."""
    keys = child.select(child_key).distinct()
    on = F.col(child_key) == F.col(parent_key)
    for c in conditions:
        on &= c
    joined = keys.join(parent, on, "left")
    return joined.agg(F.count_distinct(child_key).alias("keys"), F.count_if(F.col(parent_key).isNull()).alias("orphans"))


def regressions(df: DataFrame, by: Sequence[str], order: str, clock: str) -> DataFrame:
    """rows, sequence gaps, missing numbers and clock regressions of each key, in sequence order."""
    last = Running("last", F.struct(F.col(order).alias("order"), F.col(clock).alias("clock")), False)
    rows = scanned(df.select(*by, *dict.fromkeys([order, clock])), by, [order], {"_last": last})
    rows = rows.withColumns({"_step": F.col(order) - F.col("_last.order"), "_back": F.col(clock) - F.col("_last.clock")})
    return rows.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("_step") > 1).alias("sequence_gaps"),
        F.coalesce(F.sum(F.when(F.col("_step") > 1, F.col("_step") - 1)), F.lit(0)).alias("missing_numbers"),
        F.count_if(F.col("_step") == 0).alias("repeats"),
        F.count_if(F.col("_back") < 0).alias("clock_regressions"),
    )


def interarrival(df: DataFrame, by: Sequence[str], order: Sequence[str], time: str, shares: dict[str, float]) -> DataFrame:
    """Exact interpolated percentiles of the time between neighbouring rows of a key, from counts of distinct gaps."""
    gaps = with_gaps(df.select(*by, *dict.fromkeys([time, *order])), by, time, order, "_gap").groupBy(*by, "_gap").agg(F.count("*").alias("_n"))
    stats = [F.round(F.percentile("_gap", p, F.col("_n")), 3).alias(name) for name, p in shares.items()]
    n = F.coalesce(F.sum(F.when(F.col("_gap").isNotNull(), F.col("_n"))), F.lit(0)).alias("n")
    return gaps.groupBy(*by).agg(n, F.min("_gap").alias("min_ms"), F.max("_gap").alias("max_ms"), *stats)


def raw_vs_served(raw: DataFrame, served: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """One row: keys of the raw side, those served, and those whose served value differs."""
    newest = raw.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("_raw"))
    both = newest.join(served.select(*keys, F.col(value).alias("_served"), F.lit(True).alias("_there")), list(keys), "left")
    return both.agg(
        F.count("*").alias("keys"),
        F.count("_there").alias("served"),
        F.count_if(F.col("_there").isNotNull() & ~F.col("_raw").eqNullSafe(F.col("_served"))).alias("mismatched"),
        F.count_if(F.col("_there").isNull()).alias("not_served"),
    )


def availability(df: DataFrame, by: Sequence[str], expected: int, healthy: Column) -> DataFrame:
    """rows, healthy, and missing = expected - rows (at least zero) by key."""
    return df.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.count_if(healthy).alias("healthy"),
        F.greatest(F.lit(0).cast("long"), F.lit(expected) - F.count("*")).alias("missing"),
    )


def table_counts(tables: dict[str, DataFrame], latest: dict[str, str] | None = None) -> DataFrame:
    """(dataset, rows, newest) for each table, newest being the greatest value of its clock as text."""
    out = None
    for name, df in tables.items():
        clock = (latest or {}).get(name)
        newest = F.max(clock).cast("string") if clock else F.lit(None).cast("string")
        one = df.agg(F.count("*").alias("rows"), newest.alias("newest")).select(F.lit(name).alias("dataset"), "rows", "newest")
        out = one if out is None else out.unionByName(one)
    return out
