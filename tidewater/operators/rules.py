"""Validation rules that split rows, retention plans and keyset pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checked(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """``df`` with ``reject_reason``, the first rule a row breaks; a null outcome breaks a rule."""
    reason = F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()))
    return df.withColumn("reject_reason", reason)


def split(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected rows with their reason."""
    marked = checked(df, rules)
    return marked.filter("reject_reason is null").drop("reject_reason"), marked.filter("reject_reason is not null")


def rejected_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, rejected): how many rows break each rule, in one pass."""
    counts = df.agg(*(F.count_if(~F.coalesce(ok, F.lit(False))).alias(f"r{i}") for i, ok in enumerate(rules.values())))
    pairs = [F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("rejected")) for i, name in enumerate(rules)]
    return counts.select(F.inline(F.array(*pairs)))


#: SQL conditions by rule name; ``conditions`` makes columns of them.
OHLC_RULES = {
    "high_is_highest": "high >= greatest(open, low, close)",
    "low_is_lowest": "low <= least(open, high, close)",
    "has_events": "event_count > 0",
}

RESOLUTION_RULES = {
    "pending_is_bare": "resolution_status <> 'pending' or (winner is null and up_payout is null and down_payout is null)",
    "winner_is_paid": "coalesce(resolution_type <> 'winner', true) or (up_payout + down_payout = 1 and up_payout in (0, 1))",
    "split_is_even": "coalesce(resolution_type <> 'split', true) or (up_payout = 0.5 and down_payout = 0.5 and winner is null)",
}

SAMPLE_RULES = {
    "aligned": "pmod(sample_second_ms, 1000) = 0",
    "inside_market": "sample_second_ms >= market_id * 300000 and sample_second_ms < (market_id + 1) * 300000",
}


def conditions(rules: Mapping[str, str]) -> dict[str, Column]:
    return {name: F.expr(sql) for name, sql in rules.items()}


def retention_plan(partitions: DataFrame, now_ms: int, retention_ms: int, budget: int, current_start_ms: int) -> DataFrame:
    """``partitions`` (start_ms, end_ms, bytes) with ``drop`` and its ``reason``.

    What ended before the retention goes. Of the others the oldest finished ones go until
    the rest fits the budget: a partition goes if what is newer, with itself, is over it.
    The list of partitions is small (a few per day), so one ordered window holds it.
    """
    expired = F.col("end_ms") <= now_ms - retention_ms
    left = F.when(~expired, F.col("bytes")).otherwise(0)
    newer = F.sum(left).over(Window.orderBy(F.col("start_ms").desc()).rowsBetween(Window.unboundedPreceding, 0))
    over = ~expired & (F.col("end_ms") <= current_start_ms) & (newer > budget)
    reason = F.when(expired, "expired").when(over, "over_budget")
    return partitions.withColumn("reason", reason).withColumn("drop", F.col("reason").isNotNull())


def page(df: DataFrame, key: str, limit: int, before: int | None = None) -> DataFrame:
    """Newest ``limit`` rows below the cursor and ``next_cursor``, null on the last page."""
    rows = df if before is None else df.filter(F.col(key) < before)
    w = Window.orderBy(F.col(key).desc())
    top = rows.orderBy(F.col(key).desc()).limit(limit + 1).withColumn("_n", F.row_number().over(w))
    more = F.max("_n").over(Window.partitionBy(F.lit(1))) > limit
    last = F.max(F.when(F.col("_n") == limit, F.col(key))).over(Window.partitionBy(F.lit(1)))
    out = top.withColumn("next_cursor", F.when(more, last))
    return out.filter(F.col("_n") <= limit).drop("_n")
