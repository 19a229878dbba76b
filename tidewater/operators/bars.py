"""One-second and finer bars: trade flow, top of book, traces, trade and liquidation totals.

All are grouped aggregates with an explicit total order for first and last values, so they
combine on the map side and don't depend on the order in which rows arrive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.clock import SECOND_MS, floor_to
from tidewater.functions.numeric import ratio
from tidewater.operators.series import gap_filled, rolling, running

SUM = "decimal(38,8)"


def ohlc(df: DataFrame, by: Sequence[str | Column], price: str, order: Sequence[str]) -> DataFrame:
    """open, high, low, close and n of ``price`` by group, first and last by ``order``."""
    at = F.struct(*order)
    return df.groupBy(*by).agg(
        F.min_by(price, at).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, at).alias("close"),
        F.count("*").alias("n"),
    )


def flow_bars(trades: DataFrame, by: Sequence[str] = ("venue", "symbol"), width: int = SECOND_MS) -> DataFrame:
    """Taker flow by bucket of the source's trade time.

    ``trades``: by, trade_ms, price, quantity, buyer_is_maker, first_id, last_id,
    event_ms, received_ms. A trade whose buyer is maker was sold by the taker.
    """
    quote = (F.col("price").cast("decimal(18,8)") * F.col("quantity").cast("decimal(18,8)")).cast(SUM)
    sold = F.col("buyer_is_maker")
    total = lambda value, when: F.coalesce(F.sum(F.when(when, value)), F.lit(0)).cast(SUM)
    return trades.groupBy(*by, floor_to("trade_ms", width).alias("sample_second_ms")).agg(
        total(F.col("quantity"), ~sold).alias("buy_base"),
        total(F.col("quantity"), sold).alias("sell_base"),
        total(quote, ~sold).alias("buy_quote"),
        total(quote, sold).alias("sell_quote"),
        F.count("*").alias("agg_trade_count"),
        F.sum(F.col("last_id") - F.col("first_id") + 1).alias("trade_count"),
        F.max(quote).alias("max_trade_quote"),
        F.min("first_id").alias("first_trade_id"),
        F.max("last_id").alias("last_trade_id"),
        F.max("trade_ms").alias("last_trade_ms"),
        F.max("event_ms").alias("last_event_ms"),
        F.max("received_ms").alias("received_ms"),
    )


FLOW_ZERO = ("buy_base", "sell_base", "buy_quote", "sell_quote", "agg_trade_count", "trade_count")


def flow_features(
    bars: DataFrame, by: Sequence[str] = ("venue", "symbol"), run: Sequence[str] = (), width: int = SECOND_MS
) -> DataFrame:
    """Gap-filled flow bars with delta, imbalances, 10 and 30 bar sums and cumulative delta.

    ``run`` names columns that restart the cumulative sum (a process run, a day).
    """
    full = gap_filled(bars, by, "sample_second_ms", width, FLOW_ZERO)
    full = full.withColumn("delta_quote", (F.col("buy_quote") - F.col("sell_quote")).cast(SUM))
    full = full.withColumn("total_quote", (F.col("buy_quote") + F.col("sell_quote")).cast(SUM))
    out = full.withColumn("taker_imbalance", _share(F.col("delta_quote"), F.col("total_quote")))
    out = out.withColumn("cvd_quote", running("delta_quote", [*by, *run], "sample_second_ms").cast(SUM))
    for n in (10, 30):
        delta = rolling("delta_quote", by, "sample_second_ms", n, width).cast(SUM)
        total = rolling("total_quote", by, "sample_second_ms", n, width).cast(SUM)
        out = out.withColumn(f"cvd_{n}s_quote", delta).withColumn(f"taker_imbalance_{n}s", _share(delta, total))
    return out


def _share(a: Column, b: Column) -> Column:
    return ratio(a.cast("decimal(24,8)"), b.cast("decimal(24,8)")).cast("decimal(20,8)")


def late(trades: DataFrame, bars: DataFrame, by: Sequence[str] = ("venue", "symbol"), width: int = SECOND_MS) -> DataFrame:
    """Trades of a second at or before the last one already given out for their key."""
    last = bars.groupBy(*by).agg(F.max("sample_second_ms").alias("_flushed"))
    return trades.join(last, list(by)).filter(floor_to("trade_ms", width) <= F.col("_flushed")).drop("_flushed")


def book_bars(books: DataFrame, by: Sequence[str] = ("venue", "symbol"), width: int = SECOND_MS) -> DataFrame:
    """The last top of book of each bucket; silent buckets have no row.

    ``books``: by, event_ms, transaction_ms, received_ms, arrival, bid, bid_size, ask,
    ask_size. A bucket's last row is by event, transaction or receive time, then arrival.
    """
    at = F.coalesce("event_ms", "transaction_ms", "received_ms")
    kept = ["bid", "bid_size", "ask", "ask_size", "event_ms", "transaction_ms", "received_ms"]
    rows = books.filter("ask >= bid").withColumn("_at", at)
    last = F.max_by(F.struct(*kept), F.struct("_at", "arrival")).alias("b")
    bars = rows.groupBy(*by, floor_to("_at", width).alias("sample_second_ms")).agg(last)
    return bars.select(*by, "sample_second_ms", "b.*")


def book_measures(bars: DataFrame) -> DataFrame:
    """mid, spread, spread in bps, imbalance and microprice of top-of-book rows."""
    bid, ask = (F.col(c).cast("decimal(18,8)") for c in ("bid", "ask"))
    bq, aq = (F.col(c).cast("decimal(18,8)") for c in ("bid_size", "ask_size"))
    mid = ((bid + ask) / 2).cast("decimal(18,8)")
    total = (bq + aq).cast("decimal(18,8)")
    priced = (ask * bq + bid * aq).cast("decimal(30,10)")
    return bars.withColumns(
        {
            "mid": mid,
            "spread": (ask - bid).cast("decimal(18,8)"),
            "spread_bps": ratio(((ask - bid) * 10_000).cast("decimal(28,8)"), mid).cast("decimal(20,8)"),
            "imbalance": ratio((bq - aq).cast("decimal(18,8)"), total).cast("decimal(20,8)"),
            "microprice": ratio(priced, total).cast("decimal(18,8)"),
        }
    )


def trace_bars(ticks: DataFrame, by: Sequence[str] = ("connection_id",), width: int = 100) -> DataFrame:
    """OHLC traces by bucket of receive time; open and close by arrival, not by source time.

    ``ticks``: by, received_ms, monotonic_ns, sequence, trade_ms, event_ms, price, trade_id.
    """
    at = F.struct("monotonic_ns", "sequence")
    both = lambda c: [F.min_by(c, at).alias(f"first_{c}"), F.max_by(c, at).alias(f"last_{c}")]
    bars = ohlc(
        ticks.withColumn("bucket_start_ms", floor_to("received_ms", width)), [*by, "bucket_start_ms"], "price", ["monotonic_ns", "sequence"]
    )
    ends = ticks.groupBy(*by, floor_to("received_ms", width).alias("bucket_start_ms")).agg(
        *(x for c in ("monotonic_ns", "trade_ms", "event_ms", "trade_id") for x in both(c))
    )
    return bars.withColumnRenamed("n", "event_count").join(ends, [*by, "bucket_start_ms"])


def out_of_sequence(ticks: DataFrame, by: Sequence[str] = ("connection_id",), width: int = 100) -> DataFrame:
    """Ticks that a trace must drop: their clock or bucket runs behind an earlier arrival's."""
    from pyspark.sql import Window

    before = Window.partitionBy(*by).orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    bucket = floor_to("received_ms", width)
    rows = ticks.withColumn("_clock", F.max("monotonic_ns").over(before)).withColumn("_bucket", F.max(bucket).over(before))
    return rows.filter((F.col("monotonic_ns") < F.col("_clock")) | (bucket < F.col("_bucket"))).drop("_clock", "_bucket")


def trade_totals(trades: DataFrame, by: Sequence[str | Column], order: Sequence[str]) -> DataFrame:
    """Side notionals, rpi split, vwap, high, low, last, largest notional and lags by group.

    ``trades``: price, quantity, normal_quantity (null if unknown), buyer_is_maker,
    first_id, last_id, trade_ms, received_ms. The rpi volumes are null if any trade of the
    group lacks its normal quantity.
    """
    p, q = F.col("price").cast("decimal(18,8)"), F.col("quantity").cast("decimal(18,8)")
    rpi = (q - F.col("normal_quantity").cast("decimal(18,8)")).cast("decimal(18,8)")
    quote, rpi_quote, sold = (p * q).cast(SUM), (p * rpi).cast(SUM), F.col("buyer_is_maker")
    total = lambda value, when: F.coalesce(F.sum(F.when(when, value)), F.lit(0)).cast(SUM)
    complete = F.count("normal_quantity") == F.count("*")
    lag = F.col("received_ms") - F.col("trade_ms")
    return trades.groupBy(*by).agg(
        total(quote, ~sold).alias("buy_quote"),
        total(quote, sold).alias("sell_quote"),
        F.when(complete, total(rpi_quote, ~sold)).alias("rpi_buy_quote"),
        F.when(complete, total(rpi_quote, sold)).alias("rpi_sell_quote"),
        F.sum(F.col("last_id") - F.col("first_id") + 1).alias("trade_id_span"),
        F.count("*").alias("agg_trade_count"),
        F.max(quote).alias("max_trade_quote"),
        ratio(F.sum(quote).cast("decimal(28,8)"), F.sum(q).cast("decimal(18,8)")).cast("decimal(18,8)").alias("vwap"),
        F.max("price").alias("trade_high"),
        F.min("price").alias("trade_low"),
        F.max_by("price", F.struct(*order)).alias("last_trade"),
        F.max("received_ms").alias("last_trade_received_ms"),
        F.avg(lag).alias("trade_lag_mean_ms"),
        F.max(lag).alias("trade_lag_max_ms"),
    )


def liquidation_totals(orders: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    """Forced orders by group: a SELL closes a long, a BUY a short.

    ``orders``: side, average_price, order_price, filled_quantity, trade_ms, received_ms.
    The average price counts unless it is missing or zero.
    """
    price = F.when(F.col("average_price") != 0, F.col("average_price")).otherwise(F.col("order_price"))
    quote = (price.cast("decimal(18,8)") * F.col("filled_quantity").cast("decimal(18,8)")).cast(SUM)
    total = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, quote)), F.lit(0)).cast(SUM)
    return orders.groupBy(*by).agg(
        total("SELL").alias("long_liq_usdt"),
        total("BUY").alias("short_liq_usdt"),
        F.count("*").alias("liq_snapshot_count"),
        F.avg(F.col("received_ms") - F.col("trade_ms")).alias("liq_lag_mean_ms"),
    )
