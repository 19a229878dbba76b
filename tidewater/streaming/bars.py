"""Windowed bars over streams.

Windows close on the watermark: half a second behind the newest source time seen, which is
how late the batch rule lets a trade of a closed second be. Rows behind it are dropped by
Spark. Bars are given out once, in append mode; corrective rewrites need an update-mode
query and a merging sink instead (``sinks.upserting``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LATENESS = "500 milliseconds"
SUM = "decimal(38,8)"


def _timed(df: DataFrame, ms: str, lateness: str) -> DataFrame:
    return df.withColumn("_ts", F.timestamp_millis(F.col(ms))).withWatermark("_ts", lateness)


def _start() -> Column:
    return F.unix_millis(F.col("window.start"))


def flow_stream(trades: DataFrame, by: Sequence[str] = ("venue", "symbol"), width: str = "1 second", lateness: str = LATENESS) -> DataFrame:
    """Flow bars of closed seconds of trade time; silent seconds have none (``stateful.gap_filled``)."""
    quote = (F.col("price").cast("decimal(18,8)") * F.col("quantity").cast("decimal(18,8)")).cast(SUM)
    sold = F.col("buyer_is_maker")
    total = lambda value, when: F.coalesce(F.sum(F.when(when, value)), F.lit(0)).cast(SUM)
    bars = _timed(trades, "trade_ms", lateness).groupBy(F.window("_ts", width), *by).agg(
        total(quote, ~sold).alias("buy_quote"), total(quote, sold).alias("sell_quote"), F.count("*").alias("agg_trade_count"),
        F.sum(F.col("last_id") - F.col("first_id") + 1).alias("trade_count"), F.max(quote).alias("max_trade_quote"),
        F.min("first_id").alias("first_trade_id"), F.max("last_id").alias("last_trade_id"), F.max("received_ms").alias("received_ms"),
    )
    return bars.select(*by, _start().alias("sample_second_ms"), *bars.columns[1 + len(by) :])


def book_stream(books: DataFrame, by: Sequence[str] = ("venue", "symbol"), width: str = "1 second", lateness: str = LATENESS) -> DataFrame:
    """Last top of book of each closed second, by event, transaction or receive time, then arrival."""
    rows = books.filter("ask >= bid").withColumn("_at", F.coalesce("event_ms", "transaction_ms", "received_ms"))
    last = F.max_by(F.struct("bid", "bid_size", "ask", "ask_size", "received_ms"), F.struct("_at", "arrival")).alias("b")
    bars = _timed(rows, "_at", lateness).groupBy(F.window("_ts", width), *by).agg(last)
    return bars.select(*by, _start().alias("sample_second_ms"), "b.*")


def trace_stream(ticks: DataFrame, by: Sequence[str] = ("connection_id",), width: str = "100 milliseconds", lateness: str = "0 seconds") -> DataFrame:
    """OHLC traces by receive time, open and close by arrival."""
    at = F.struct("monotonic_ns", "sequence")
    bars = _timed(ticks, "received_ms", lateness).groupBy(F.window("_ts", width), *by).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.count("*").alias("event_count"), F.min_by("trade_id", at).alias("first_trade_id"), F.max_by("trade_id", at).alias("last_trade_id"),
    )
    return bars.select(*by, _start().alias("bucket_start_ms"), *bars.columns[1 + len(by) :])


def newest_stream(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Latest row per key, for update mode: each micro-batch gives the keys that changed."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*by, "r.*")
