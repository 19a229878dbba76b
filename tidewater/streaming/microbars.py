"""Live microstructure bars: causal seconds over all feeds, then the columns of the batch form.

``second_stream`` closes seconds in keyed state (``live.causal_bars``); context and marker
rows are named so that the last row under each name is what a bar holds. ``bars_of_seconds``
works closed seconds out, each from its own row: rows of the second, last rows so far and the
rows before. It needs no other second, so it suits a micro-batch as well as a whole table,
and shares its arithmetic with ``operators.micro``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.clock import SECOND_MS
from tidewater.operators import micro
from tidewater.operators.bars import liquidation_totals
from tidewater.operators.micro import CONNECTIONS, COOL_DOWN, SECOND
from tidewater.streaming.live import DELAY_MS, causal_bars

#: Names under which a bar holds rows, by feed.
FEEDS = ("spot_book", "fut_book", "spot_trade", "fut_trade", "liquidation", "context", "marker")
NAMES = {"context": ("pair", "interest", "funding"), "marker": (*(f"open_{c}" for c in CONNECTIONS), "closes")}


def schemas(feeds: Mapping[str, DataFrame]) -> dict[str, T.StructType]:
    """Types of the rows that a closed second carries as JSON."""
    return {name: df.drop("symbol").schema for name, df in _prepared(feeds).items()}


def _prepared(feeds: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The feeds in the order of ``FEEDS``, each with a ``sequence``; books with both sides only."""
    out = {}
    for name in FEEDS:
        df = feeds[name]
        df = df if "sequence" in df.columns else df.withColumn("sequence", F.lit(0).cast("long"))
        out[name] = df.filter((F.size("bids") > 0) & (F.size("asks") > 0)) if name.endswith("_book") else df
    return out


def _names() -> dict[str, Column]:
    """For each row of a feed with several names, those it goes under."""
    context = {
        "pair": F.col("mark_price").isNotNull() & F.col("index_price").isNotNull(),
        "interest": F.col("open_interest").isNotNull(),
        "funding": F.lit(True),
    }
    marker = {f"open_{c}": F.col("connection") == c for c in CONNECTIONS} | {"closes": F.col("event") == "close"}
    each = {"context": context, "marker": marker}
    return {feed: F.array_compact(F.array(*(F.when(w, n) for n, w in tests.items()))) for feed, tests in each.items()}


def second_stream(feeds: Mapping[str, DataFrame], delay_ms: int = DELAY_MS, grace_ms: int = 60_000) -> DataFrame:
    """Closed seconds of each symbol over the feeds of ``FEEDS`` (the arguments of ``micro.micro_bars``).

    A connection marker that comes late still tells the connection's state; any other late row is left out.
    """
    names = {**{f: (f,) for f in FEEDS}, **NAMES}
    return causal_bars(_prepared(feeds), "symbol", "received_ms", delay_ms, grace_ms, names=[n for f in FEEDS for n in names[f]], named=_names(), lasting=NAMES["marker"])


def bars_of_seconds(seconds: DataFrame, types: Mapping[str, T.StructType], jitter_ms: int = 0) -> DataFrame:
    """The bars of ``micro.micro_bars`` for closed seconds; ``types`` are those of ``schemas``.

    A snapshot's order flow is against the last one received before it, if that is of the
    same epoch. Late rows start a cool-down at the end of the second that tells of them.
    ``seconds`` is read several times: persist a micro-batch first.
    """
    of = {n: types[f] for f in FEEDS for n in NAMES.get(f, (f,))}
    last = lambda n: F.from_json(f"{n}_last", of[n])
    base = seconds.withColumnRenamed("key", "symbol")

    def rows(name: str, bodies: Column) -> DataFrame:
        one = base.select("symbol", SECOND, F.explode(bodies).alias("_body"))
        return one.select("symbol", SECOND, F.from_json("_body", of[name]).alias("_row")).select("symbol", SECOND, "_row.*")

    held = {"symbol": F.col("symbol"), SECOND: F.col(SECOND)}
    for p in ("spot", "fut"):
        book = last(f"{p}_book")
        held[f"{p}_book"] = F.when(book.isNotNull(), F.struct(*(book[c].alias(c) for c in ("bids", "asks", "received_ms", "event_ms"))))
        held[f"_{p}_trade_ms"] = last(f"{p}_trade")["received_ms"]
    for n, make in (("pair", micro.pair_of), ("interest", micro.interest_of), ("funding", micro.funding_of)):
        held[n] = F.when(F.col(f"{n}_last").isNotNull(), make(lambda c, r=last(n): r[c]))
    for c in CONNECTIONS:
        held[f"open_{c}"] = last(f"open_{c}")["event"] == "open"
    markers = [last(n)["received_ms"] + COOL_DOWN for n in NAMES["marker"]]
    held["unhealthy_until_ms"] = F.coalesce(F.greatest(*markers, F.col("gap_ms") + COOL_DOWN), F.lit(0))
    held["connection_errors"] = F.col("closes_total")
    earlier = sum((F.col(f"{n}_total") - F.size(f"{n}_rows") for n in of), F.lit(0))
    held["sample_span_ms"] = F.when(earlier > 0, F.lit(SECOND_MS).cast("long"))
    bars = base.select(*(c.alias(n) for n, c in held.items()))

    keys = ["symbol", SECOND]
    for p in ("spot", "fut"):
        name = f"{p}_book"
        bodies = F.concat(F.array_compact(F.array(f"{name}_before")), f"{name}_rows")
        snapshots = rows(name, F.when(F.size(f"{name}_rows") > 0, bodies))
        flow = micro.book_flow(snapshots, [*keys, "epoch"]).filter(F.col("received_ms") >= F.col(SECOND))
        bars = bars.join(micro.book_totals(flow, p).drop(f"{p}_book"), keys, "left")
        trades = micro.trade_seconds(rows(f"{p}_trade", F.col(f"{p}_trade_rows")), p)
        bars = bars.join(trades.drop(f"{p}_last_trade_received_ms"), keys, "left").withColumnRenamed(f"_{p}_trade_ms", f"{p}_last_trade_received_ms")
    bars = bars.join(liquidation_totals(rows("liquidation", F.col("liquidation_rows")), keys), keys, "left")
    return micro.finished(bars, jitter_ms)


def micro_batches(types: Mapping[str, T.StructType], sink: Callable[[DataFrame, int], None], jitter_ms: int = 0) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` over ``second_stream``: gives each micro-batch's served bars to ``sink``."""

    def run(seconds: DataFrame, batch: int) -> None:
        seconds = seconds.persist()
        try:
            sink(micro.served(bars_of_seconds(seconds, types, jitter_ms)), batch)
        finally:
            seconds.unpersist()

    return run
