"""Windows, bars, as-of and lagged series over ``events``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions.clock import DAY_MS, HOUR_MS, MARKET_MS, MINUTE_MS, bucket_id, floor_to, market_columns
from tidewater.functions.numeric import ratio_double
from tidewater.operators.bars import book_bars, flow_bars, flow_features, ohlc, trace_bars
from tidewater.operators.series import asof, grid, lagged, spanned_grid, with_gaps
from tidewater.operators.state import latest
from tidewater.plans.registry import EV, query, ticks

#: The day that the one-day grids cover (2024-01-10 UTC).
DAY = 1_704_844_800_000
TOLERANCE = 10 * MINUTE_MS


@query(f"WITH {EV} SELECT event_id, ms // 300000 AS market_id, ms - ms % 300000 AS window_start_ms, ms - ms % 300000 + 300000 AS window_end_ms FROM ev")
def market_window_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).select("event_id", *market_columns("ms"))


@query(f"""WITH {EV} SELECT ms // 300000 AS market_id, event_type, first(price ORDER BY ms, event_id) AS open, max(price) AS high,
min(price) AS low, last(price ORDER BY ms, event_id) AS close, count(*) AS n FROM ev GROUP BY ALL""", money="open high low close")
def source_ohlc_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir).withColumn("market_id", bucket_id("ms"))
    return ohlc(rows, ["market_id", "event_type"], "price", ["ms", "event_id"])


@query(f"""WITH {EV} SELECT event_type, event_id, ms, price FROM ev
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ms DESC, event_id DESC) = 1""", money="price")
def latest_price_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(ticks(spark, sf_dir).select("event_type", "event_id", "ms", "price"), ["event_type"], ["ms", "event_id"])


@query(f"WITH {EV} SELECT max(ms // 300000) AS market_id FROM ev")
def latest_market_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).agg(F.max(bucket_id("ms")).alias("market_id"))


def _of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir, DAY, DAY + DAY_MS)


def _minute_last(rows: DataFrame) -> DataFrame:
    return rows.groupBy(floor_to("ms", MINUTE_MS).alias("sample_ms")).agg(
        F.max_by("price", F.struct("ms", "event_id")).alias("price"), F.count("*").alias("n")
    )


@query(f"""WITH {EV}, g AS (SELECT unnest(generate_series({DAY}, {DAY} + 86340000, 60000)) AS sample_ms),
m AS (SELECT ms - ms % 60000 AS sample_ms, last(price ORDER BY ms, event_id) AS price, count(*) AS n FROM ev GROUP BY 1)
SELECT g.sample_ms, price, n, (g.sample_ms - {DAY}) // 60000 AS t FROM g LEFT JOIN m USING (sample_ms)""", money="price")
def dense_grid_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = grid(spark, DAY, DAY + DAY_MS, MINUTE_MS)
    t = F.call_function("div", F.col("sample_ms") - DAY, F.lit(MINUTE_MS)).alias("t")
    return minutes.join(_minute_last(_of_day(spark, sf_dir)), "sample_ms", "left").select("*", t)


def _typed_grid(spark: SparkSession) -> DataFrame:
    kinds = F.explode(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view")))).alias("event_type")
    return grid(spark, DAY, DAY + DAY_MS, MINUTE_MS, "ms").select("ms", kinds, floor_to("ms", HOUR_MS).alias("hour_ms"))


def _carried(minutes: DataFrame, rows: DataFrame) -> DataFrame:
    events = rows.withColumn("hour_ms", floor_to("ms", HOUR_MS))
    found = asof(minutes, events, ["event_type", "hour_ms"], "ms", ["price"], TOLERANCE, ["event_id"])
    age = F.col("ms") - F.col("asof_ms")
    return found.withColumns({"age_ms": age, "carried": age != 0})


def _exact(minutes: DataFrame, rows: DataFrame) -> DataFrame:
    events = rows.withColumn("at", F.col("ms")).withColumn("ms", floor_to("ms", MINUTE_MS))
    events = events.withColumn("hour_ms", floor_to("ms", HOUR_MS))
    return asof(minutes, events, ["event_type", "hour_ms"], "ms", ["price"], order=["at", "event_id"], exact=True)


_GRID_SQL = f"""g AS (SELECT ms, event_type, ms - ms % 3600000 AS hour_ms
FROM (SELECT unnest(generate_series({DAY}, {DAY} + 86340000, 60000)) AS ms),
(SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS event_type))"""


@query(f"""WITH {EV}, {_GRID_SQL}, e AS (SELECT event_type, ms, ms - ms % 3600000 AS hour_ms, last(price ORDER BY event_id) AS price FROM ev GROUP BY ALL),
j AS (SELECT g.event_type, g.hour_ms, g.ms, e.ms AS seen, e.price FROM g ASOF LEFT JOIN e
  ON g.event_type = e.event_type AND g.hour_ms = e.hour_ms AND g.ms >= e.ms)
SELECT event_type, hour_ms, ms, CASE WHEN ms - seen <= {TOLERANCE} THEN seen END AS asof_ms, CASE WHEN ms - seen <= {TOLERANCE} THEN price END AS price,
CASE WHEN ms - seen <= {TOLERANCE} THEN ms - seen END AS age_ms, CASE WHEN ms - seen <= {TOLERANCE} THEN seen <> ms END AS carried FROM j""", money="price")
def asof_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _carried(_typed_grid(spark), _of_day(spark, sf_dir))


@query(f"""WITH {EV}, {_GRID_SQL}, e AS (SELECT event_type, ms - ms % 60000 AS ms, last(price ORDER BY ev.ms, event_id) AS price FROM ev GROUP BY ALL)
SELECT g.event_type, g.hour_ms, g.ms, CASE WHEN e.ms IS NOT NULL THEN g.ms END AS asof_ms, e.price FROM g LEFT JOIN e ON g.event_type = e.event_type AND g.ms = e.ms""", money="price")
def exact_second_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact(_typed_grid(spark), _of_day(spark, sf_dir))


def _whole_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every minute from a type's first event to its last."""
    minutes = ticks(spark, sf_dir).select("event_type", floor_to("ms", MINUTE_MS).alias("ms"))
    return spanned_grid(minutes, ["event_type"], "ms", MINUTE_MS).select("ms", "event_type", floor_to("ms", HOUR_MS).alias("hour_ms"))


_WHOLE_SQL = """g AS (SELECT ms, event_type, ms - ms % 3600000 AS hour_ms
FROM (SELECT event_type, unnest(generate_series(min(ms) - min(ms) % 60000, max(ms) - max(ms) % 60000, 60000)) AS ms FROM ev GROUP BY event_type))"""


@query(f"""WITH {EV}, m AS (SELECT ms - ms % 60000 AS sample_ms, last(price ORDER BY ms, event_id) AS price, count(*) AS n FROM ev GROUP BY 1),
g AS (SELECT a, unnest(generate_series(a, b, 60000)) AS sample_ms FROM (SELECT min(sample_ms) AS a, max(sample_ms) AS b FROM m))
SELECT g.sample_ms, price, n, (g.sample_ms - a) // 60000 AS t FROM g LEFT JOIN m USING (sample_ms)""", money="price")
def dense_grid_series_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir)
    ends = rows.agg(floor_to(F.min("ms"), MINUTE_MS).alias("a"), floor_to(F.max("ms"), MINUTE_MS).alias("b"))
    minutes = ends.select("a", F.explode(F.sequence("a", "b", F.lit(MINUTE_MS).cast("long"))).alias("sample_ms"))
    t = F.call_function("div", F.col("sample_ms") - F.col("a"), F.lit(MINUTE_MS)).alias("t")
    return minutes.join(_minute_last(rows), "sample_ms", "left").select("sample_ms", "price", "n", t)


@query(f"""WITH {EV}, {_WHOLE_SQL}, e AS (SELECT event_type, ms, ms - ms % 3600000 AS hour_ms, last(price ORDER BY event_id) AS price FROM ev GROUP BY ALL),
j AS (SELECT g.event_type, g.hour_ms, g.ms, e.ms AS seen, e.price FROM g ASOF LEFT JOIN e
  ON g.event_type = e.event_type AND g.hour_ms = e.hour_ms AND g.ms >= e.ms)
SELECT event_type, hour_ms, ms, CASE WHEN ms - seen <= {TOLERANCE} THEN seen END AS asof_ms, CASE WHEN ms - seen <= {TOLERANCE} THEN price END AS price,
CASE WHEN ms - seen <= {TOLERANCE} THEN ms - seen END AS age_ms, CASE WHEN ms - seen <= {TOLERANCE} THEN seen <> ms END AS carried FROM j""", money="price")
def asof_carry_forward_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _carried(_whole_grid(spark, sf_dir), ticks(spark, sf_dir))


@query(f"""WITH {EV}, {_WHOLE_SQL}, e AS (SELECT event_type, ms - ms % 60000 AS ms, last(price ORDER BY ev.ms, event_id) AS price FROM ev GROUP BY ALL)
SELECT g.event_type, g.hour_ms, g.ms, CASE WHEN e.ms IS NOT NULL THEN g.ms END AS asof_ms, e.price FROM g LEFT JOIN e ON g.event_type = e.event_type AND g.ms = e.ms""", money="price")
def exact_second_fallback_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact(_whole_grid(spark, sf_dir), ticks(spark, sf_dir))


@query(f"""WITH {EV}, h AS (SELECT event_type, ms - ms % 3600000 AS hour_ms, count(*) AS n FROM ev GROUP BY ALL)
SELECT h.event_type, h.hour_ms, h.n, h.n - a.n AS delta_1h, h.n - b.n AS delta_24h FROM h
LEFT JOIN h a ON a.event_type = h.event_type AND a.hour_ms = h.hour_ms - 3600000
LEFT JOIN h b ON b.event_type = h.event_type AND b.hour_ms = h.hour_ms - 86400000""")
def lag_self_join_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = ticks(spark, sf_dir).groupBy("event_type", floor_to("ms", HOUR_MS).alias("hour_ms")).agg(F.count("*").alias("n"))
    return lagged(hours, ["event_type"], "hour_ms", "n", {"delta_1h": HOUR_MS, "delta_24h": DAY_MS})


def _as_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as taker trades: purchases and sign-ups are bought, all others sold."""
    return ticks(spark, sf_dir).select(
        F.lit("all").alias("symbol"), F.col("ms").alias("trade_ms"), "price", F.lit(1).cast("decimal(18,2)").alias("quantity"),
        (~F.col("event_type").isin("purchase", "signup")).alias("buyer_is_maker"),
        F.col("event_id").alias("first_id"), F.col("event_id").alias("last_id"), F.col("ms").alias("event_ms"), F.col("ms").alias("received_ms"),
    )


_BARS = """bars AS (SELECT ms - ms % 3600000 AS hour_ms, CAST(coalesce(sum(price) FILTER (event_type IN ('purchase', 'signup')), 0) AS DECIMAL(18,2)) AS buy,
CAST(coalesce(sum(price) FILTER (event_type NOT IN ('purchase', 'signup')), 0) AS DECIMAL(18,2)) AS sell, count(*) AS trades,
max(price) AS max_trade, min(event_id) AS first_id, max(event_id) AS last_id FROM ev GROUP BY 1)"""
_FULL = """filled AS (SELECT h.hour_ms, coalesce(buy, 0)::DECIMAL(18,2) AS buy, coalesce(sell, 0)::DECIMAL(18,2) AS sell, coalesce(trades, 0) AS trades, max_trade, first_id, last_id,
CAST(coalesce(buy, 0) - coalesce(sell, 0) AS DECIMAL(18,2)) AS delta, CAST(coalesce(buy, 0) + coalesce(sell, 0) AS DECIMAL(18,2)) AS total
FROM (SELECT unnest(generate_series(min(hour_ms), max(hour_ms), 3600000)) AS hour_ms FROM bars) h LEFT JOIN bars USING (hour_ms))"""


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_bars(_as_trades(spark, sf_dir), ["symbol"], HOUR_MS)


def _money(name: str, alias: str) -> Column:
    return F.col(name).cast("decimal(18,2)").alias(alias)


@query(f"""WITH {EV}, {_BARS} SELECT hour_ms, buy, sell, trades, max_trade, first_id, last_id, CAST(buy - sell AS DECIMAL(18,2)) AS delta,
CASE WHEN buy + sell > 0 THEN round(CAST(buy - sell AS DOUBLE) / CAST(buy + sell AS DOUBLE), 6) END AS imbalance FROM bars""", money="buy sell max_trade delta", name="flow_bars")
def flow_bars_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    delta, total = F.col("buy_quote") - F.col("sell_quote"), F.col("buy_quote") + F.col("sell_quote")
    return _hourly(spark, sf_dir).select(
        F.col("sample_second_ms").alias("hour_ms"), _money("buy_quote", "buy"), _money("sell_quote", "sell"), F.col("agg_trade_count").alias("trades"),
        _money("max_trade_quote", "max_trade"), F.col("first_trade_id").alias("first_id"), F.col("last_trade_id").alias("last_id"),
        delta.cast("decimal(18,2)").alias("delta"), ratio_double(delta, total).alias("imbalance"),
    )


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_features(_hourly(spark, sf_dir), ["symbol"], width=HOUR_MS).withColumnRenamed("sample_second_ms", "hour_ms")


@query(f"WITH {EV}, {_BARS}, {_FULL} SELECT hour_ms, buy, sell, trades, max_trade, first_id, last_id FROM filled", money="buy sell max_trade")
def flow_bars_gap_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).select(
        "hour_ms", _money("buy_quote", "buy"), _money("sell_quote", "sell"), F.col("agg_trade_count").alias("trades"),
        _money("max_trade_quote", "max_trade"), F.col("first_trade_id").alias("first_id"), F.col("last_trade_id").alias("last_id"),
    )


@query(f"""WITH {EV}, {_BARS}, {_FULL}, s AS (SELECT hour_ms,
CAST(sum(delta) OVER (ORDER BY hour_ms RANGE BETWEEN 32400000 PRECEDING AND CURRENT ROW) AS DECIMAL(18,2)) AS delta_10,
CAST(sum(total) OVER (ORDER BY hour_ms RANGE BETWEEN 32400000 PRECEDING AND CURRENT ROW) AS DECIMAL(18,2)) AS total_10,
CAST(sum(delta) OVER (ORDER BY hour_ms RANGE BETWEEN 104400000 PRECEDING AND CURRENT ROW) AS DECIMAL(18,2)) AS delta_30 FROM filled)
SELECT hour_ms, delta_10, delta_30, CASE WHEN total_10 > 0 THEN round(CAST(delta_10 AS DOUBLE) / CAST(total_10 AS DOUBLE), 6) END AS imbalance_10 FROM s""", money="delta_10 delta_30")
def rolling_range_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.operators.series import rolling

    rows = _features(spark, sf_dir).withColumn("total_10", rolling("total_quote", ["symbol"], "hour_ms", 10, HOUR_MS))
    share = ratio_double(F.col("cvd_10s_quote"), F.col("total_10")).alias("imbalance_10")
    return rows.select("hour_ms", _money("cvd_10s_quote", "delta_10"), _money("cvd_30s_quote", "delta_30"), share)


@query(f"""WITH {EV}, {_BARS}, {_FULL} SELECT hour_ms, delta, CAST(sum(delta) OVER (ORDER BY hour_ms ROWS UNBOUNDED PRECEDING) AS DECIMAL(18,2)) AS cvd FROM filled""", money="delta cvd")
def cumulative_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).select("hour_ms", _money("delta_quote", "delta"), _money("cvd_quote", "cvd"))


@query(f"""WITH {EV} SELECT event_type, ms - ms % 3600000 AS hour_ms, price AS bid, CAST(price + 1 AS DECIMAL(18,2)) AS ask, event_id AS arrival FROM ev
QUALIFY row_number() OVER (PARTITION BY event_type, ms - ms % 3600000 ORDER BY ms DESC, event_id DESC) = 1""", money="bid ask")
def book_last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = ticks(spark, sf_dir).select(
        "event_type", F.col("ms").alias("event_ms"), F.lit(None).cast("long").alias("transaction_ms"), F.col("event_id").alias("received_ms"),
        F.col("event_id").alias("arrival"), F.col("price").alias("bid"), F.col("k").alias("bid_size"),
        (F.col("price") + 1).cast("decimal(18,2)").alias("ask"), F.col("k").alias("ask_size"),
    )
    bars = book_bars(books, ["event_type"], HOUR_MS)
    return bars.select("event_type", F.col("sample_second_ms").alias("hour_ms"), "bid", "ask", F.col("received_ms").alias("arrival"))


@query(f"""WITH {EV} SELECT user_id, ms - ms % 3600000 AS bucket_start_ms, first(price ORDER BY event_id) AS open, max(price) AS high, min(price) AS low,
last(price ORDER BY event_id) AS close, count(*) AS event_count, min(event_id) AS first_id, max(event_id) AS last_id,
first(ms ORDER BY event_id) AS first_ms, last(ms ORDER BY event_id) AS last_ms FROM ev GROUP BY ALL""", money="open high low close")
def trace_ohlc_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir).select(
        "user_id", F.col("ms").alias("received_ms"), F.col("event_id").alias("monotonic_ns"), F.col("event_id").alias("sequence"),
        F.col("ms").alias("trade_ms"), F.col("ms").alias("event_ms"), "price", F.col("event_id").alias("trade_id"),
    )
    bars = trace_bars(rows, ["user_id"], HOUR_MS)
    return bars.select(
        "user_id", "bucket_start_ms", "open", "high", "low", "close", "event_count",
        F.col("first_trade_id").alias("first_id"), F.col("last_trade_id").alias("last_id"), F.col("first_trade_ms").alias("first_ms"), F.col("last_trade_ms").alias("last_ms"),
    )


@query(f"""WITH {EV}, g AS (SELECT event_type, unnest(generate_series(min(ms) - min(ms) % 3600000 + 3600000, max(ms) - max(ms) % 3600000, 3600000)) AS ms FROM ev GROUP BY event_type),
e AS (SELECT event_type, ms, last(price ORDER BY event_id) AS price FROM ev GROUP BY ALL),
j AS (SELECT g.event_type, g.ms, e.ms AS seen, e.price FROM g ASOF LEFT JOIN e ON g.event_type = e.event_type AND g.ms >= e.ms)
SELECT event_type, ms, price, ms - seen AS age_ms FROM j WHERE ms - seen <= 1800000""", money="price")
def sample_and_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value held at each full hour, left out where it is staler than half an hour."""
    from tidewater.operators.state import stale

    rows = ticks(spark, sf_dir)
    # only the last value of the hour before can be fresh enough, so nothing is carried further
    hour = -floor_to(-F.col("ms"), HOUR_MS)
    held = rows.groupBy("event_type", hour.alias("at")).agg(F.max_by(F.struct("ms", "price"), F.struct("ms", "event_id")).alias("v"))
    ends = rows.groupBy("event_type").agg((floor_to(F.min("ms"), HOUR_MS) + HOUR_MS).alias("a"), floor_to(F.max("ms"), HOUR_MS).alias("b"))
    held = held.join(F.broadcast(ends), "event_type").filter("at between a and b").filter(~stale(F.col("at"), F.col("v.ms"), 1_800_000))
    return held.select("event_type", F.col("at").alias("ms"), "v.price", (F.col("at") - F.col("v.ms")).alias("age_ms"))


@query(f"""WITH {EV}, d AS (SELECT event_type, event_id, ms, ms - lag(ms) OVER (PARTITION BY event_type ORDER BY ms, event_id) AS gap FROM ev)
SELECT event_type, event_id, gap AS gap_ms, max(gap) OVER (PARTITION BY event_type ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS high_water_ms FROM d""")
def running_high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir).select("event_type", "event_id", "ms")
    found = with_gaps(rows, ["event_type"], "ms", ["ms", "event_id"], "gap_ms", "high_water_ms")
    return found.select("event_type", "event_id", "gap_ms", "high_water_ms")


@query(f"""WITH {EV}, b AS (SELECT DISTINCT event_type, ms - ms % 60000 AS bar_ms FROM ev)
SELECT event_type, bar_ms, bar_ms - lag(bar_ms) OVER (PARTITION BY event_type ORDER BY bar_ms) AS span_ms, (bar_ms % 300000) // 1000 AS t FROM b""")
def bar_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = ticks(spark, sf_dir).select("event_type", floor_to("ms", MINUTE_MS).alias("bar_ms")).distinct()
    w = Window.partitionBy("event_type").orderBy("bar_ms")
    t = F.call_function("div", F.pmod("bar_ms", F.lit(MARKET_MS)), F.lit(1000)).alias("t")
    return bars.select("event_type", "bar_ms", (F.col("bar_ms") - F.lag("bar_ms").over(w)).alias("span_ms"), t)
