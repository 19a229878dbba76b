"""The served queries over tables in the market schema.

``tables`` maps names to DataFrames: providers, instruments, windows, price_samples,
probabilities, snapshots, flow, book, micro, interest_5m, markets, resolutions. Every query
filters by market or key first, so scans prune; optional layers that aren't asked for are
not joined. Clocks are passed in, never read.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.clock import MARKET_MS, PARTITION_MS, iso_text, whole
from tidewater.functions.numeric import clamped_age, compact_text, fixed_text
from tidewater.operators.bars import ohlc
from tidewater.operators.rules import page
from tidewater.operators.series import asof, grid, lagged
from tidewater.operators.state import latest
from tidewater.sources.tables import PART

Tables = Mapping[str, DataFrame]
SECOND = "sample_second_ms"
LAGS = {"delta_30s": 30_000, "delta_60s": 60_000, "delta_300s": 300_000}


def _starts(df: DataFrame) -> list[int]:
    """Starts of the six-hour partitions that a table has files in, from the files' names."""
    return sorted({int(m[1]) for m in (re.search(rf"/{PART}=([0-9]+)/", f) for f in df.inputFiles()) if m})


def newest_part(df: DataFrame, wanted: Column | None = None) -> DataFrame:
    """``df`` from the newest six-hour partitions that have a wanted row; all of a table that isn't partitioned.

    The newest partition is asked first, then the newest 4, 16, ... of them, so a value that
    is fresh costs one partition however long the history is.
    """
    rows = df if wanted is None else df.filter(wanted)
    starts, n = _starts(df) if PART in df.columns else [], 1
    while n < len(starts):
        some = rows.filter(F.col(PART) >= starts[-n])
        if some.limit(1).count():
            return some
        n *= 4
    return rows


def health_probe(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(1).alias("ok"))


def named_samples(t: Tables) -> DataFrame:
    """Price samples with provider, symbol and quote asset; the dimensions hold a few rows."""
    dims = t["instruments"].join(F.broadcast(t["providers"]), "provider_id").select("instrument_id", "provider", "symbol", "quote_asset")
    return t["price_samples"].join(F.broadcast(dims), "instrument_id")


def instrument_id(t: Tables, provider: str, symbol: str) -> DataFrame:
    """One row with the id, or an error if there is none."""
    found = t["instruments"].join(t["providers"], "provider_id").filter((F.col("provider") == provider) & (F.col("symbol") == symbol))
    one = found.agg(F.max("instrument_id").alias("instrument_id"))
    missing = F.raise_error(F.lit(f"no instrument {provider}/{symbol}"))
    return one.select(F.coalesce("instrument_id", missing.cast("long")).alias("instrument_id"))


def _of_source(t: Tables, provider: str, symbol: str) -> DataFrame:
    """Samples of one source, of the newest partitions that have some; the dimensions hold a few rows."""
    ids = t["instruments"].join(t["providers"], "provider_id").filter((F.col("provider") == provider) & (F.col("symbol") == symbol))
    known = [r[0] for r in ids.select("instrument_id").collect()]
    return named_samples({**t, "price_samples": newest_part(t["price_samples"], F.col("instrument_id").isin(known))})


def latest_price(t: Tables, provider: str, symbol: str) -> DataFrame:
    top = _of_source(t, provider, symbol).orderBy(F.col(SECOND).desc(), F.col("received_ms").desc()).limit(1)
    return top.select("provider", "symbol", SECOND, F.col("price").cast("string").alias("price"), "provider_event_ms", "received_ms")


def latest_market(t: Tables) -> DataFrame:
    """Markets and partitions are both by time, so the newest partition has the newest market."""
    return newest_part(t["price_samples"]).agg(F.max("market_id").alias("market_id"))


#: Datasets of the market index, and which of their rows count as observed.
OBSERVED = {
    "price_samples": "true",
    "snapshots": "coalesce(last_price, mark_price, index_price, open_interest) is not null",
    "flow": "true",
    "book": "true",
    "probabilities": "up_ask is not null and down_ask is not null",
}


def _observed(t: Tables, first_ms: int | None, last_ms: int) -> DataFrame:
    """(market_id, dataset) of every observation of the markets that start in [first_ms, last_ms].

    ``first_ms`` is the start of a six-hour partition, or None for all history. A market's
    rows lie in the partition that holds its five minutes.
    """
    out = None
    for name, ok in OBSERVED.items():
        if name in t:
            rows = t[name].filter(ok).filter(F.col("market_id") <= last_ms // MARKET_MS)
            if PART in rows.columns:
                rows = rows.filter(F.col(PART) <= last_ms)
            if first_ms is not None:
                rows = rows.filter(F.col("market_id") >= first_ms // MARKET_MS)
                rows = rows.filter(F.col(PART) >= first_ms) if PART in rows.columns else rows
            one = rows.select("market_id", F.lit(name).alias("dataset"))
            out = one if out is None else out.unionByName(one)
    return out


def market_index(t: Tables, now_ms: int, limit: int = 3, before: int | None = None, include_current: bool = False) -> DataFrame:
    """A page of the newest observed markets with row counts by dataset.

    The page is cut first (a semi-join and a top-k); only its markets are counted. The newest
    partition before the page's end is asked first, then the newest 4, 16, ... of them, until
    the page and the market after it are found, so a page costs the same however long the
    history is.
    """
    limit = max(1, limit)
    windows = t["windows"].filter(F.col("window_start_ms") <= now_ms)
    if not include_current:
        windows = windows.filter(F.col("window_end_ms") <= now_ms)
    if before is not None:
        windows = windows.filter(F.col("market_id") < before)
    last = now_ms if before is None else min(now_ms, before * MARKET_MS - 1)
    parted = [t[name] for name in OBSERVED if name in t and PART in t[name].columns]
    starts = sorted({s for df in parted for s in _starts(df) if s <= last})
    n = 1
    while True:
        first = starts[-n] if n < len(starts) else None
        seen = _observed(t, first, last)
        candidates = windows.join(seen.select("market_id").distinct(), "market_id", "left_semi")
        if first is None or candidates.limit(limit + 1).count() > limit:
            break
        n *= 4
    chosen = page(candidates.select("market_id", "window_start_ms", "window_end_ms"), "market_id", limit, before)
    counts = seen.join(chosen.select("market_id"), "market_id", "left_semi").groupBy("market_id").agg(
        *(F.count_if(F.col("dataset") == d).alias(f"{d}_rows") for d in OBSERVED)
    )
    return chosen.join(counts, "market_id").orderBy(F.desc("market_id"))


def of_market(df: DataFrame, market_id: int) -> DataFrame:
    """Rows of one market; of a table in six-hour partitions only the one that holds its five minutes."""
    rows = df.filter(F.col("market_id") == market_id)
    if PART in df.columns:
        start = market_id * MARKET_MS
        rows = rows.filter(F.col(PART) == start - start % PARTITION_MS)
    return rows


def market_samples(t: Tables, market_id: int) -> DataFrame:
    return of_market(named_samples(t), market_id)


def market_summary(t: Tables, market_id: int, provider: str, symbol: str) -> DataFrame:
    """OHLC of one source in a market."""
    rows = market_samples(t, market_id).filter((F.col("provider") == provider) & (F.col("symbol") == symbol))
    return ohlc(rows, ["market_id"], "price", [SECOND, "received_ms"])


def market_sources(t: Tables, market_id: int, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """OHLC by source in the order of ``pairs``, with the clocks of each newest sample."""
    wanted = F.lit(False)
    rank = F.lit(len(pairs))
    for i, (provider, symbol) in reversed(list(enumerate(pairs))):
        here = (F.col("provider") == provider) & (F.col("symbol") == symbol)
        wanted, rank = wanted | here, F.when(here, i).otherwise(rank)
    rows = market_samples(t, market_id).filter(wanted)
    keys = ["provider", "symbol", "quote_asset"]
    bars = ohlc(rows, keys, "price", [SECOND, "received_ms"])
    clocks = rows.groupBy(*keys).agg(F.max_by(F.struct(SECOND, "provider_event_ms", "received_ms"), F.struct(SECOND, "received_ms")).alias("newest"))
    return bars.join(clocks, keys).withColumn("rank", rank).orderBy("rank", "provider", "symbol")


def market_series(
    t: Tables,
    market_id: int,
    spot: tuple[str, str] = ("binance", "BTCUSDT"),
    oracle: tuple[str, str] = ("chainlink", "BTCUSD"),
    layers: Sequence[str] = ("flow", "book", "probabilities", "futures"),
    carry_ms: int | None = None,
) -> DataFrame:
    """A row for each of a market's 300 seconds with prices, freshness and the wanted layers.

    The oracle's price is carried forward for up to ``carry_ms`` (inclusive) within the
    market, or taken of the exact second only. Open-interest deltas are against the rows
    exactly 30, 60 and 300 seconds before.
    """
    start = market_id * MARKET_MS
    spark = t["price_samples"].sparkSession
    out = grid(spark, start, start + MARKET_MS, 1_000, SECOND).withColumn("market_id", F.lit(market_id).cast("long"))
    rows = market_samples(t, market_id)

    def source(pair: tuple[str, str], prefix: str) -> DataFrame:
        own = rows.filter((F.col("provider") == pair[0]) & (F.col("symbol") == pair[1]))
        return own.select("market_id", SECOND, *(F.col(c).alias(f"{prefix}_{c}") for c in ("price", "provider_event_ms", "received_ms")))

    out = out.join(source(spot, "spot"), ["market_id", SECOND], "left")
    ticks = source(oracle, "oracle")
    kept = ["oracle_price", "oracle_provider_event_ms", "oracle_received_ms"]
    out = asof(out, ticks, ["market_id"], SECOND, kept, tolerance=carry_ms, order=["oracle_received_ms"], exact=carry_ms is None)
    carried = F.col(f"asof_{SECOND}") != F.col(SECOND)
    end = F.col(SECOND) + 1_000
    out = out.withColumns(
        {
            "oracle_carried_forward": carried,
            "spot_age_ms": clamped_age(end, F.col("spot_received_ms")),
            "oracle_age_ms": clamped_age(end, F.col("oracle_received_ms")),
            "oracle_source_age_ms": clamped_age(end, F.col("oracle_provider_event_ms")),
            "oracle_lag_ms": clamped_age(F.col("oracle_received_ms"), F.col("oracle_provider_event_ms")),
        }
    )
    for name, columns in {"flow": ("delta_quote", "cvd_quote", "taker_imbalance"), "book": ("bid", "ask", "mid", "spread_bps"), "probabilities": ("up_ask", "down_ask")}.items():
        if name in layers:
            own = of_market(t[name], market_id).select(SECOND, *(F.col(c).alias(f"{name}_{c}") for c in columns))
            out = out.join(own, SECOND, "left")
    if "futures" in layers:
        out = out.join(_futures(t, start), SECOND, "left")
    return out.withColumn("t", whole(F.col(SECOND) - start, 1_000)).orderBy(SECOND)


def _futures(t: Tables, start: int) -> DataFrame:
    """Snapshots of the market with open-interest deltas; only 300 seconds before it are read."""
    near = t["snapshots"].filter(F.col(SECOND).between(start - 300_000, start + MARKET_MS - 1))
    if PART in near.columns:
        first = start - 300_000
        near = near.filter(F.col(PART).between(first - first % PARTITION_MS, start - start % PARTITION_MS))
    rows = lagged(near, ["symbol"], SECOND, "open_interest", LAGS).filter(F.col(SECOND) >= start)
    return rows.select(SECOND, "last_price", "mark_price", "index_price", "premium_bps", "open_interest", "open_interest_notional", *LAGS)


def series_items(series: DataFrame) -> DataFrame:
    """Nested items of a series: clocks, rendered prices and freshness, and the layers it has."""
    price = lambda c, places=2: fixed_text(F.col(c), places)
    groups: list[Column] = [
        F.struct(price("spot_price").alias("spot"), price("oracle_price").alias("oracle")).alias("prices"),
        F.struct("spot_age_ms", "oracle_age_ms", "oracle_source_age_ms", "oracle_lag_ms", "oracle_carried_forward").alias("freshness"),
    ]
    have = set(series.columns)
    if "flow_delta_quote" in have:
        groups.append(F.struct(*(compact_text(F.col(f"flow_{c}")).alias(c) for c in ("delta_quote", "cvd_quote", "taker_imbalance"))).alias("flow"))
    if "book_bid" in have:
        groups.append(F.struct(*(compact_text(F.col(f"book_{c}")).alias(c) for c in ("bid", "ask", "mid", "spread_bps"))).alias("book"))
    if "probabilities_up_ask" in have:
        groups.append(F.struct(price("probabilities_up_ask").alias("up_ask"), price("probabilities_down_ask").alias("down_ask")).alias("probabilities"))
    if "open_interest" in have:
        groups.append(F.struct(*(price(c).alias(c) for c in ("last_price", "mark_price", "index_price", "premium_bps"))).alias("futures"))
        interest = [price("open_interest", 3).alias("contracts"), price("open_interest_notional").alias("notional_usdt"), *(price(c, 3).alias(c) for c in LAGS)]
        groups.append(F.struct(*interest).alias("open_interest"))
    return series.select("t", F.col(SECOND).alias("timestamp_ms"), iso_text(SECOND).alias("timestamp_at"), *groups)


def with_microstructure(series: DataFrame, t: Tables, market_id: int, columns: Sequence[str]) -> DataFrame:
    own = of_market(t["micro"], market_id).select(SECOND, F.struct(*columns).alias("microstructure"))
    return series.join(own, SECOND, "left")


def microstructure_availability(t: Tables, market_id: int, expected: int = 300) -> DataFrame:
    rows = of_market(t["micro"], market_id)
    return rows.agg(
        F.count("*").alias("rows"), F.count_if(F.col("collector_healthy")).alias("healthy"), F.greatest(F.lit(0).cast("long"), F.lit(expected) - F.count("*")).alias("missing")
    )


def live_prices(t: Tables, sources: Sequence[str], now_ms: int) -> DataFrame:
    """Newest live value of each source with its age; a source without a value has nulls."""
    spark = t["live"].sparkSession
    wanted = spark.createDataFrame([(s,) for s in sources], "source string")
    newest = latest(t["live"].filter(F.col("source").isin(*sources)), ["source"], ["received_ms"])
    return wanted.join(newest, "source", "left").withColumn("age_ms", clamped_age(F.lit(now_ms), F.col("received_ms")))


def live_microstructure(t: Tables, now_ms: int, symbols: Sequence[str] | None = None) -> DataFrame:
    """The newest bar of each symbol; its market is that of the bar, not of the clock.

    Given ``symbols``, each is looked for in the newest partitions first. Without them one
    pass over the symbol column tells which partition holds each symbol's newest bar; the
    other columns are read of these partitions only.
    """
    micro = t["micro"]
    if symbols is not None:
        rows = micro.limit(0)
        for symbol in dict.fromkeys(symbols):
            rows = rows.unionByName(newest_part(micro, F.col("symbol") == symbol))
    elif PART in micro.columns:
        tops = micro.groupBy("symbol").agg(F.max(PART).alias("top")).select("top").distinct()
        rows = micro.filter(F.col(PART).isin([r[0] for r in tops.collect()]))  # at most one number a symbol
    else:
        rows = micro
    newest = latest(rows, ["symbol"], [SECOND])
    return newest.withColumns({"market_id": whole(F.col(SECOND), MARKET_MS), "age_ms": clamped_age(F.lit(now_ms), F.col(SECOND) + 1_000)})


def current_snapshot(t: Tables, now_ms: int, spot: tuple[str, str], oracle: tuple[str, str]) -> DataFrame:
    """One row: newest spot and oracle price, futures snapshot and probabilities, null where missing."""
    one = t["price_samples"].sparkSession.range(1).select(F.lit(1).alias("one"), F.lit(now_ms).alias("now_ms"))

    def add(out: DataFrame, df: DataFrame, name: str, clock: Column) -> DataFrame:
        top = df.orderBy(clock.desc()).limit(1).select(F.lit(1).alias("one"), F.struct(*df.columns).alias(name))
        return out.join(top, "one", "left")

    for name, (provider, symbol) in (("spot", spot), ("oracle", oracle)):
        one = add(one, _of_source(t, provider, symbol), name, F.coalesce("provider_event_ms", "received_ms"))
    known = F.coalesce("last_price", "mark_price", "index_price").isNotNull()
    one = add(one, newest_part(t["snapshots"], known), "futures", F.col(SECOND))
    return add(one, newest_part(t["probabilities"]), "probability", F.col(SECOND)).drop("one")


def latest_resolutions(t: Tables, limit: int = 10) -> DataFrame:
    return t["resolutions"].orderBy(F.desc("market_id")).limit(max(1, limit))
