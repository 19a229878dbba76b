"""Stateful stream behaviour in batch form: dedup flags, held values, top of book, cool-downs.

State never crosses keys, which are connections, markets or venues. A key may have very many
rows, so running values are worked out by segments of their order (``scan``); the order's
first column has to be a number or a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.scan import WIDTH, Running, scanned


def sequence_flags(trades: DataFrame, by: Sequence[str], order: Sequence[str], id: str, time: str) -> DataFrame:
    """duplicate, regression, gap and missing of each arrival against the last accepted one.

    An id equal to the highest so far is a duplicate, a lower id or an earlier time than an
    accepted one is a regression; either leaves the state as it was. Ids skipped by an
    accepted row are a gap of that many missing ids.
    """
    rows = scanned(trades, by, order, {"_id": Running("max", F.col(id), False), "_time": Running("max", F.col(time), False)})
    duplicate = F.coalesce(F.col(id) == F.col("_id"), F.lit(False))
    regression = ~duplicate & F.coalesce((F.col(id) < F.col("_id")) | (F.col(time) < F.col("_time")), F.lit(False))
    jump = F.when(~duplicate & ~regression, F.col(id) - F.col("_id") - 1)
    missing = F.coalesce(F.greatest(jump, F.lit(0)), F.lit(0))
    return rows.select(
        *trades.columns, duplicate.alias("duplicate"), regression.alias("regression"), (missing > 0).alias("gap"), missing.alias("missing")
    )


def latest(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in a total order, by aggregation rather than a sort."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*by, "r.*")


def settled(df: DataFrame, by: Sequence[str], second: str, order: Sequence[str], received: str, now_ms: int, settle_ms: int = 1_000) -> DataFrame:
    """Newest version of each provider second, those that are ready.

    A second is ready if a newer one is pending for its key, or once ``settle_ms`` have
    passed since its newest version was received.
    """
    newest = latest(df, [*by, second], order)
    top = F.max(second).over(Window.partitionBy(*by))
    ready = (F.col(second) < top) | (F.lit(now_ms) - F.col(received) >= settle_ms)
    return newest.withColumn("_ready", ready).filter("_ready").drop("_ready")


def carried(df: DataFrame, by: Sequence[str], order: Sequence[str], values: dict[str, Column], width: int = WIDTH) -> DataFrame:
    """Last known value up to each row; give a struct to carry fields as a complete set."""
    return scanned(df, by, order, {name: Running("last", value) for name, value in values.items()}, width)


def top_state(messages: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Best bid and ask after each message.

    ``messages``: kind (book, best_bid_ask, price_change, ...), bid, ask. The first two
    kinds set both sides, missing ones to null; a price change patches the sides it has.
    """
    whole = F.col("kind").isin("book", "best_bid_ask")
    patch = F.col("kind") == "price_change"
    side = lambda c: F.when(whole | (patch & F.col(c).isNotNull()), F.struct(F.col(c).alias("v")))
    held = carried(messages, by, order, {"_bid": side("bid"), "_ask": side("ask")})
    return held.select(*messages.columns, F.col("_bid.v").alias("best_bid"), F.col("_ask.v").alias("best_ask"))


def two_sided_gate(rows: DataFrame, now: Column, end: Column, resolved: Column, received: Column, stale_ms: int = 15_000) -> DataFrame:
    """Probability samples that may be given out: open market, fresh, both asks known."""
    fresh = now - received <= stale_ms
    return rows.filter((now < end) & ~resolved & fresh & F.col("up_ask").isNotNull() & F.col("down_ask").isNotNull())


def stale(now: Column, received: Column, limit_ms: int = 10_000) -> Column:
    """Strictly older than the limit."""
    return now - received > limit_ms


def fresh_for(connection: Column, current: Column, now_ns: Column, seen_ns: Column, limit_ns: int) -> Column:
    """A value of the current connection whose monotonic age is in [0, limit]."""
    age = now_ns - seen_ns
    return (connection == current) & (age >= 0) & (age <= limit_ns)


def cool_down(markers: DataFrame, by: Sequence[str], order: Sequence[str], time: str, cool_ms: int = 5_000) -> DataFrame:
    """unhealthy_until and errors after each row; an open or close marker starts a cool-down.

    ``markers``: event (open, close or anything else). Every close adds one error.
    """
    mark = F.col("event").isin("open", "close")
    running = {"unhealthy_until_ms": Running("max", F.when(mark, F.col(time) + cool_ms)), "connection_errors": Running("sum", (F.col("event") == "close").cast("long"))}
    return scanned(markers, by, order, running).withColumn("unhealthy_until_ms", F.coalesce("unhealthy_until_ms", F.lit(0)))


def paused(sizes: DataFrame, by: Sequence[str], order: Sequence[str], size: str, warn: int, most: int) -> DataFrame:
    """Write gate with hysteresis: paused from ``most`` on, open again only below ``warn``."""
    mark = F.when(F.col(size) >= most, True).when(F.col(size) < warn, False)
    return carried(sizes, by, order, {"paused": mark}).withColumn("paused", F.coalesce("paused", F.lit(False)))


def newest(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The newest ``n`` rows of each key: what a bounded drop-oldest buffer would hold."""
    w = Window.partitionBy(*by).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")
