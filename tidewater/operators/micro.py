"""One-second microstructure bars over spot and futures feeds, with a health verdict.

Feeds are reduced to one row per (symbol, second of receive time) first; only these rows
are joined, gap-filled and forward-filled by windows partitioned by symbol. A bar labelled
s covers receive times [s, s + 1000).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.clock import SECOND_MS, floor_to, whole
from tidewater.functions.numeric import countdown_seconds, ratio
from tidewater.operators.bars import liquidation_totals, trade_totals
from tidewater.operators.books import depth_quote, level_imbalance, order_flow

SCHEMA_VERSION = 1
CONNECTIONS = ("spot", "futures_trade", "futures_depth", "futures_liquidation")

# Bounds of the health tests, in milliseconds.
AGE_LIMITS = {
    "spot_book_age_ms": 3_000,
    "fut_book_age_ms": 2_000,
    "spot_trade_age_ms": 3_000,
    "fut_trade_age_ms": 3_000,
    "mark_age_ms": 4_000,
    "oi_age_ms": 15_000,
    "oi_exchange_age_ms": 15_000,
}
LAG_LOW, LAG_HIGH = -1_000, 2_000
SPAN_LOW, SPAN_HIGH, SKEW_LIMIT, JITTER_LIMIT, COOL_DOWN = 800, 1_200, 1_500, 500, 5_000

SECOND = "sample_second_ms"


def _second(df: DataFrame) -> DataFrame:
    return df.withColumn(SECOND, floor_to("received_ms", SECOND_MS))


def book_flow(books: DataFrame, by: Sequence[str]) -> DataFrame:
    """Snapshots with both sides and the order flow of each against the one before it of the same ``by``."""
    top = books.filter((F.size("bids") > 0) & (F.size("asks") > 0)).withColumns(
        {
            "bid": F.col("bids")[0]["price"],
            "bid_size": F.col("bids")[0]["quantity"],
            "ask": F.col("asks")[0]["price"],
            "ask_size": F.col("asks")[0]["quantity"],
        }
    )
    return order_flow(top, by, ["received_ms", "sequence"])


def book_totals(flow: DataFrame, prefix: str) -> DataFrame:
    last = F.max_by(F.struct("bids", "asks", "received_ms", "event_ms"), F.struct("received_ms", "sequence"))
    return flow.groupBy("symbol", SECOND).agg(
        last.alias(f"{prefix}_book"), F.count("*").alias(f"{prefix}_book_snapshot_count"), F.sum("ofi").alias(f"{prefix}_ofi")
    )


def book_seconds(books: DataFrame, prefix: str) -> DataFrame:
    """Last snapshot, count and summed order flow of each second.

    ``books``: symbol, epoch, received_ms, sequence, event_ms, bids, asks (sorted levels).
    """
    return book_totals(_second(book_flow(books, ["symbol", "epoch"])), prefix)


def trade_seconds(trades: DataFrame, prefix: str) -> DataFrame:
    totals = trade_totals(_second(trades), ["symbol", SECOND], ["received_ms", "sequence"])
    names = {
        "buy_quote": "buy_usdt", "sell_quote": "sell_usdt", "rpi_buy_quote": "rpi_buy_usdt", "rpi_sell_quote": "rpi_sell_usdt",
        "agg_trade_count": "aggtrade_count", "max_trade_quote": "max_aggtrade_usdt",
    }
    return totals.select("symbol", SECOND, *(F.col(c).alias(f"{prefix}_{names.get(c, c)}") for c in totals.columns[2:]))


def pair_of(get: Callable[[str], Column]) -> Column:
    return F.struct(get("mark_price").alias("mark_price"), get("index_price").alias("index_price"), get("received_ms").alias("received_ms"), get("premium_index_time_ms").alias("event_ms"))


def interest_of(get: Callable[[str], Column]) -> Column:
    return F.struct(get("open_interest").alias("open_interest"), get("received_ms").alias("received_ms"), get("open_interest_time_ms").alias("event_ms"), get("request_started_ms").alias("request_started_ms"))


def funding_of(get: Callable[[str], Column]) -> Column:
    return F.struct(*(get(c).alias(c) for c in ("last_funding_rate", "next_funding_time_ms")))


def context_seconds(context: DataFrame) -> DataFrame:
    """Last complete mark/index pair, open interest and funding of each second.

    ``context``: symbol, received_ms, request_started_ms, mark_price, index_price,
    premium_index_time_ms, last_funding_rate, next_funding_time_ms, open_interest,
    open_interest_time_ms.
    """
    at = "received_ms"
    both = F.col("mark_price").isNotNull() & F.col("index_price").isNotNull()
    held = F.col("open_interest").isNotNull()
    return _second(context).groupBy("symbol", SECOND).agg(
        F.max_by(pair_of(F.col), F.when(both, F.col(at))).alias("pair"),
        F.max_by(interest_of(F.col), F.when(held, F.col(at))).alias("interest"),
        F.max_by(funding_of(F.col), at).alias("funding"),
    )


def marker_seconds(markers: DataFrame) -> DataFrame:
    """State of the connections at the end of each second with an open or close marker.

    ``markers``: symbol, received_ms, sequence, connection, event (open, close).
    """
    order = F.struct("received_ms", "sequence")
    each = [
        F.max_by(F.col("event") == "open", F.when(F.col("connection") == c, order)).alias(f"open_{c}") for c in CONNECTIONS
    ]
    return _second(markers).groupBy("symbol", SECOND).agg(
        F.max(F.col("received_ms") + COOL_DOWN).alias("until"), F.count_if(F.col("event") == "close").alias("closes"), *each
    )


def micro_bars(
    spot_books: DataFrame,
    fut_books: DataFrame,
    spot_trades: DataFrame,
    fut_trades: DataFrame,
    liquidations: DataFrame,
    context: DataFrame,
    markers: DataFrame,
    jitter_ms: int = 0,
) -> DataFrame:
    """A bar for every second between a symbol's first and last event, all feeds side by side."""
    parts = [
        book_seconds(spot_books, "spot"), book_seconds(fut_books, "fut"), trade_seconds(spot_trades, "spot"), trade_seconds(fut_trades, "fut"),
        liquidation_totals(_second(liquidations), ["symbol", SECOND]), context_seconds(context), marker_seconds(markers),
    ]
    keys = None
    for part in parts:
        own = part.select("symbol", SECOND)
        keys = own if keys is None else keys.unionByName(own)
    ends = keys.groupBy("symbol").agg(F.min(SECOND).alias("a"), F.max(SECOND).alias("b"))
    bars = ends.select("symbol", F.explode(F.sequence("a", "b", F.lit(SECOND_MS).cast("long"))).alias(SECOND))
    for part in parts:
        bars = bars.join(part, ["symbol", SECOND], "left")

    upto = Window.partitionBy("symbol").orderBy(SECOND).rowsBetween(Window.unboundedPreceding, 0)
    held = ["spot_book", "fut_book", "pair", "interest", "funding", *(f"open_{c}" for c in CONNECTIONS)]
    held += ["spot_last_trade_received_ms", "fut_last_trade_received_ms"]
    bars = bars.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in held})
    bars = bars.withColumns(
        {
            "unhealthy_until_ms": F.coalesce(F.max("until").over(upto), F.lit(0)),
            "connection_errors": F.coalesce(F.sum("closes").over(upto), F.lit(0)),
            "sample_span_ms": F.col(SECOND) - F.lag(SECOND).over(Window.partitionBy("symbol").orderBy(SECOND)),
        }
    )
    return finished(bars, jitter_ms)


def finished(bars: DataFrame, jitter_ms: int) -> DataFrame:
    """All columns of bars, from the sums of their second and what they hold."""
    now = F.col(SECOND) + SECOND_MS
    bars = bars.withColumns({"now_ms": now, "schema_version": F.lit(SCHEMA_VERSION), "sample_jitter_ms": F.lit(jitter_ms)})
    for prefix in ("spot", "fut"):
        bars = _book_columns(bars, prefix)
        bars = _trade_columns(bars, prefix)
    zero = F.lit(0).cast("decimal(38,8)")
    bars = bars.withColumns(
        {
            "long_liq_usdt": F.coalesce("long_liq_usdt", zero),
            "short_liq_usdt": F.coalesce("short_liq_usdt", zero),
            "liq_snapshot_count": F.coalesce("liq_snapshot_count", F.lit(0)),
        }
    )
    return health(_context_columns(bars))


def _book_columns(bars: DataFrame, p: str) -> DataFrame:
    bids, asks = F.col(f"{p}_book.bids"), F.col(f"{p}_book.asks")
    bid, ask = bids[0]["price"], asks[0]["price"]
    bq, aq = bids[0]["quantity"], asks[0]["quantity"]
    mid = ((bid + ask) / 2).cast("decimal(18,8)")
    size = (bq + aq).cast("decimal(18,8)")
    weighted = F.coalesce(ratio((ask * bq + bid * aq).cast("decimal(30,10)"), size), mid)
    bps = lambda x: ratio((x * 10_000).cast("decimal(28,10)"), mid).cast("decimal(20,8)")
    count = F.coalesce(f"{p}_book_snapshot_count", F.lit(0))
    flow = F.coalesce(f"{p}_ofi", F.lit(0)).cast("decimal(20,8)")
    return bars.withColumns(
        {
            f"{p}_mid": mid,
            f"{p}_bid": bid,
            f"{p}_ask": ask,
            f"{p}_spread_bps": bps(ask - bid),
            f"{p}_weighted_mid_offset_bps": bps((weighted - mid).cast("decimal(20,10)")),
            **{f"{p}_imbalance_{k}": level_imbalance(bids, asks, k) for k in (1, 5, 10)},
            f"{p}_bid_depth_usdt_10": depth_quote(bids, asks, bids),
            f"{p}_ask_depth_usdt_10": depth_quote(bids, asks, asks),
            f"{p}_book_age_ms": F.col("now_ms") - F.col(f"{p}_book.received_ms"),
            f"{p}_book_lag_ms": F.col(f"{p}_book.received_ms") - F.col(f"{p}_book.event_ms"),
            f"{p}_snapshot_bbo_ofi_usdt": (flow * mid).cast("decimal(38,8)"),
            f"{p}_book_snapshot_count": count,
        }
    )


def _trade_columns(bars: DataFrame, p: str) -> DataFrame:
    """Sums of a silent second are zero, its averages and extremes null, its age goes on."""
    silent = F.col(f"{p}_aggtrade_count").isNull()
    zero = F.lit(0).cast("decimal(38,8)")
    sums = [f"{p}_{c}" for c in ("buy_usdt", "sell_usdt", "rpi_buy_usdt", "rpi_sell_usdt")]
    out = {c: F.when(silent, zero).otherwise(F.col(c)) for c in sums}
    out |= {c: F.coalesce(c, F.lit(0)) for c in (f"{p}_trade_id_span", f"{p}_aggtrade_count")}
    out[f"{p}_trade_age_ms"] = F.col("now_ms") - F.col(f"{p}_last_trade_received_ms")
    return bars.withColumns(out)


def _context_columns(bars: DataFrame) -> DataFrame:
    mark, index = F.col("pair.mark_price"), F.col("pair.index_price")
    share = lambda a, b: F.when(b > 0, (a.cast("double") / b.cast("double") - 1) * 10_000).cast("decimal(20,8)")
    return bars.withColumns(
        {
            "perp_spot_basis_bps": share(F.col("fut_mid"), F.col("spot_mid")),
            "spot_fut_book_skew_ms": F.abs(F.col("spot_book.received_ms") - F.col("fut_book.received_ms")),
            "mark_price": mark,
            "index_price": index,
            "mark_index_basis_bps": share(mark, index),
            "funding_rate": F.col("funding.last_funding_rate"),
            "seconds_to_funding": countdown_seconds(F.col("funding.next_funding_time_ms"), F.col("now_ms")),
            "mark_age_ms": F.col("now_ms") - F.col("pair.received_ms"),
            "mark_lag_ms": F.col("pair.received_ms") - F.col("pair.event_ms"),
            "open_interest_btc": F.col("interest.open_interest"),
            "open_interest_usdt": (F.col("interest.open_interest").cast("decimal(18,8)") * F.col("fut_mid")).cast("decimal(38,8)"),
            "oi_age_ms": F.col("now_ms") - F.col("interest.received_ms"),
            "oi_exchange_age_ms": F.col("now_ms") - F.col("interest.event_ms"),
            "oi_http_lag_ms": F.col("interest.received_ms") - F.col("interest.request_started_ms"),
        }
    )


def _all(tests: Sequence[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out &= F.coalesce(t, F.lit(False))
    return out


def health_tests() -> dict[str, Column]:
    """The ten tests, each a boolean that is never null."""
    lag = lambda c: F.col(c).between(LAG_LOW, LAG_HIGH)
    optional = lambda c: F.col(c).isNull() | lag(c)
    known = lambda *cs: _all([F.col(c).isNotNull() for c in cs])
    return {
        "age_ok": _all([F.col(c).between(0, most) for c, most in AGE_LIMITS.items()]),
        "lag_ok": _all(
            [lag("fut_book_lag_ms"), lag("mark_lag_ms"), optional("spot_trade_lag_max_ms"), optional("fut_trade_lag_max_ms")]
            + [(F.col("liq_snapshot_count") == 0) | lag("liq_lag_mean_ms")]
        ),
        "span_ok": _all([F.col("sample_span_ms").between(SPAN_LOW, SPAN_HIGH)]),
        "skew_ok": _all([F.col("spot_fut_book_skew_ms") <= SKEW_LIMIT]),
        "jitter_ok": _all([F.col("sample_jitter_ms").between(0, JITTER_LIMIT)]),
        "gap_ok": _all([F.col("now_ms") > F.col("unhealthy_until_ms")]),
        "connections_ok": _all([F.col(f"open_{c}") for c in CONNECTIONS]),
        "context_ok": known("mark_price", "index_price", "mark_index_basis_bps", "funding_rate", "seconds_to_funding"),
        "rpi_ok": known("fut_rpi_buy_usdt", "fut_rpi_sell_usdt"),
        "depth_ok": known(*(f"{p}_{c}" for p in ("spot", "fut") for c in ("imbalance_10", "bid_depth_usdt_10", "ask_depth_usdt_10"))),
    }


def health(bars: DataFrame) -> DataFrame:
    return bars.withColumn("collector_healthy", _all(list(health_tests().values())))


# The bars' value columns in the order in which they are served.
VALUE_COLUMNS = """
schema_version sample_span_ms sample_jitter_ms collector_healthy
spot_mid spot_bid spot_ask spot_spread_bps spot_weighted_mid_offset_bps spot_imbalance_1 spot_imbalance_5
spot_imbalance_10 spot_bid_depth_usdt_10 spot_ask_depth_usdt_10 spot_book_age_ms spot_book_lag_ms
spot_snapshot_bbo_ofi_usdt spot_book_snapshot_count
spot_buy_usdt spot_sell_usdt spot_trade_id_span spot_aggtrade_count spot_max_aggtrade_usdt spot_vwap
spot_trade_high spot_trade_low spot_last_trade spot_trade_age_ms spot_trade_lag_mean_ms spot_trade_lag_max_ms
fut_mid fut_bid fut_ask fut_spread_bps fut_weighted_mid_offset_bps fut_imbalance_1 fut_imbalance_5
fut_imbalance_10 fut_bid_depth_usdt_10 fut_ask_depth_usdt_10 fut_book_age_ms fut_book_lag_ms
fut_snapshot_bbo_ofi_usdt fut_book_snapshot_count
fut_buy_usdt fut_sell_usdt fut_rpi_buy_usdt fut_rpi_sell_usdt fut_trade_id_span fut_aggtrade_count
fut_max_aggtrade_usdt fut_vwap fut_trade_high fut_trade_low fut_last_trade fut_trade_age_ms
fut_trade_lag_mean_ms fut_trade_lag_max_ms
perp_spot_basis_bps spot_fut_book_skew_ms mark_price index_price mark_index_basis_bps funding_rate
seconds_to_funding mark_age_ms mark_lag_ms open_interest_btc open_interest_usdt oi_age_ms oi_exchange_age_ms
oi_http_lag_ms long_liq_usdt short_liq_usdt liq_snapshot_count liq_lag_mean_ms connection_errors
""".split()


def served(bars: DataFrame) -> DataFrame:
    """Bars with their key, market and the value columns in order."""
    return bars.select("symbol", SECOND, whole(F.col(SECOND), 300_000).alias("market_id"), *VALUE_COLUMNS)
