"""Trade, book and health measures over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import numeric as n
from tidewater.functions.clock import HOUR_MS, MINUTE_MS, epoch_ms, floor_to
from tidewater.operators.bars import liquidation_totals, trade_totals
from tidewater.operators.books import epochs, order_flow
from tidewater.operators.micro import _all
from tidewater.operators.state import carried, cool_down, top_state, two_sided_gate
from tidewater.plans.merges import _LINES, ORDER, lines
from tidewater.plans.registry import EV, load, query, ticks

_TRADES = """t AS (SELECT l_returnflag AS flag, epoch_us(l_shipdate) // 1000 - (epoch_us(l_shipdate) // 1000) % 86400000 AS day_ms, epoch_us(l_shipdate) // 1000 AS ms,
CAST(l_extendedprice AS DECIMAL(18,2)) AS price, CAST(l_quantity AS DECIMAL(18,2)) AS quantity, CAST(l_discount AS DECIMAL(18,2)) AS discount, l_linestatus = 'F' AS sold,
l_linenumber, l_orderkey, l_partkey, l_suppkey FROM lineitem)"""


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as trades: F lines were sold, the discount is the part outside the normal quantity."""
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("flag"), epoch_ms("l_shipdate").alias("ms"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
        F.col("l_quantity").cast("decimal(18,2)").alias("quantity"), F.col("l_discount").cast("decimal(18,2)").alias("discount"),
        (F.col("l_linestatus") == "F").alias("buyer_is_maker"), "l_linenumber", "l_orderkey", "l_partkey", "l_suppkey",
    )


@query(f"""WITH {_TRADES} SELECT flag, day_ms, CAST(coalesce(sum(price * quantity) FILTER (NOT sold), 0) AS DOUBLE) AS buy, CAST(coalesce(sum(price * quantity) FILTER (sold), 0) AS DOUBLE) AS sell,
CASE WHEN count(*) FILTER (discount = 0) = 0 THEN CAST(coalesce(sum(price * discount) FILTER (NOT sold), 0) AS DOUBLE) END AS rpi_buy,
CAST(sum(l_linenumber) AS BIGINT) AS span, count(*) AS trades, CAST(max(price * quantity) AS DOUBLE) AS largest, CAST((200 * CAST(sum(price * quantity) * 10000 AS HUGEINT) + CAST(sum(quantity) * 100 AS HUGEINT)) // (2 * CAST(sum(quantity) * 100 AS HUGEINT)) AS DOUBLE) / 10000 AS vwap,
CAST(max(price) AS DOUBLE) AS high, CAST(min(price) AS DOUBLE) AS low, CAST(last(price ORDER BY ms, l_orderkey, l_linenumber, l_partkey, l_suppkey, price) AS DOUBLE) AS last, max(l_linenumber - 1) AS lag_max FROM t GROUP BY ALL""",
    money="buy sell rpi_buy largest high low last")
def trade_vwap_accumulator(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _trades(spark, sf_dir).withColumns(
        {
            "normal_quantity": F.when(F.col("discount") != 0, (F.col("quantity") - F.col("discount")).cast("decimal(18,2)")),
            "first_id": F.lit(1), "last_id": F.col("l_linenumber"), "trade_ms": F.col("ms"), "received_ms": F.col("ms") + F.col("l_linenumber") - 1,
            "day_ms": floor_to("ms", 86_400_000),
        }
    )
    totals = trade_totals(rows, ["flag", "day_ms"], ["ms", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price"])
    vwap = F.round(totals["vwap"], 4).cast("double")
    return totals.select(
        "flag", "day_ms", F.col("buy_quote").alias("buy"), F.col("sell_quote").alias("sell"), F.col("rpi_buy_quote").alias("rpi_buy"), F.col("trade_id_span").alias("span"),
        F.col("agg_trade_count").alias("trades"), F.col("max_trade_quote").alias("largest"), vwap.alias("vwap"), F.col("trade_high").alias("high"), F.col("trade_low").alias("low"),
        F.col("last_trade").alias("last"), F.col("trade_lag_max_ms").cast("int").alias("lag_max"),
    )


@query(f"""WITH {_TRADES} SELECT flag, CAST(coalesce(sum(p * quantity) FILTER (sold), 0) AS DOUBLE) AS long_liq, CAST(coalesce(sum(p * quantity) FILTER (NOT sold), 0) AS DOUBLE) AS short_liq,
count(*) AS n, round(avg(l_linenumber - 1), 6) AS lag_mean FROM (SELECT *, CASE WHEN discount <> 0 THEN discount ELSE price END AS p FROM t) GROUP BY flag""", money="long_liq short_liq")
def liquidation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _trades(spark, sf_dir).select(
        "flag", F.when(F.col("buyer_is_maker"), "SELL").otherwise("BUY").alias("side"), F.col("discount").alias("average_price"), F.col("price").alias("order_price"),
        F.col("quantity").alias("filled_quantity"), F.col("ms").alias("trade_ms"), (F.col("ms") + F.col("l_linenumber") - 1).alias("received_ms"),
    )
    totals = liquidation_totals(rows, ["flag"])
    return totals.select(
        "flag", F.col("long_liq_usdt").alias("long_liq"), F.col("short_liq_usdt").alias("short_liq"), F.col("liq_snapshot_count").alias("n"), F.round("liq_lag_mean_ms", 6).alias("lag_mean")
    )


@query("""WITH e AS (SELECT vec_id, [CAST(round(abs(x) * 1000) AS BIGINT) for x in embedding] AS v FROM embeddings), s AS (SELECT vec_id, v, v[1:5] AS b5, v[6:10] AS a5 FROM e)
SELECT vec_id, len(v) AS size, CAST(list_sum(b5) AS BIGINT) AS bid_5, CAST(list_sum(a5) AS BIGINT) AS ask_5, v[1] AS bid_1, list_max(b5) AS best_bid, list_min(a5) AS best_ask,
CASE WHEN list_sum(b5) + list_sum(a5) > 0 THEN round(CAST(list_sum(b5) - list_sum(a5) AS DOUBLE) / CAST(list_sum(b5) + list_sum(a5) AS DOUBLE), 6) END AS imbalance_5 FROM s""")
def nearest_level_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over the first levels of two sides, taken from the parts of a vector."""
    rows = load(spark, sf_dir, "embeddings")
    # in the vector's own type: of single-precision parts the product is rounded to single precision, as in the SQL
    part = dict(rows.dtypes)["embedding"].removeprefix("array<").removesuffix(">")
    v = F.transform("embedding", lambda x: F.round((F.abs(x) * F.lit(1000).cast(part)).cast("double")).cast("long"))
    rows = rows.select("vec_id", v.alias("v")).select("vec_id", "v", F.slice("v", 1, 5).alias("b"), F.slice("v", 6, 5).alias("a"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    share = n.ratio_double(total("b") - total("a"), total("b") + total("a"))
    return rows.select(
        "vec_id", F.size("v").cast("long").alias("size"), total("b").alias("bid_5"), total("a").alias("ask_5"), F.col("v")[0].alias("bid_1"),
        F.array_max("b").alias("best_bid"), F.array_min("a").alias("best_ask"), share.alias("imbalance_5"),
    )


_BOOK_SQL = """b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice AS DOUBLE) AS bid, CAST(l_extendedprice AS DOUBLE) + CAST(l_tax AS DOUBLE) * 100 AS ask,
CAST(l_quantity AS DOUBLE) AS bq, CAST(l_linenumber AS DOUBLE) AS aq FROM lineitem)"""


@query(f"""WITH {_BOOK_SQL}, m AS (SELECT *, (bid + ask) / 2 AS mid, (ask * bq + bid * aq) / (bq + aq) AS micro FROM b)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(mid, 4) AS mid, round(ask - bid, 4) AS spread, round((ask - bid) * 10000 / mid, 4) AS spread_bps, round((bq - aq) / (bq + aq), 6) AS imbalance,
micro, round((micro - mid) * 10000 / mid, 4) + 0.0 AS offset_bps, round(CASE WHEN l_linenumber > 3 THEN mid ELSE bid END, 4) AS side_mid, round(bq / (bq + aq), 6) AS share FROM m""")
def book_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    bid = F.col("l_extendedprice").cast("double")
    rows = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", bid.alias("bid"), (bid + F.col("l_tax").cast("double") * 100).alias("ask"),
        F.col("l_quantity").cast("double").alias("bq"), F.col("l_linenumber").cast("double").alias("aq"),
    )
    b, a, bq, aq = map(F.col, ("bid", "ask", "bq", "aq"))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(n.mid(b, a), 4).alias("mid"), F.round(a - b, 4).alias("spread"),
        F.round(n.spread_bps(b, a), 4).alias("spread_bps"), F.round(n.imbalance(bq, aq), 6).alias("imbalance"), n.microprice(b, bq, a, aq).alias("micro"),
        F.round(n.weighted_mid_offset_bps(b, bq, a, aq), 4).alias("offset_bps"), F.round(n.side_midpoint(b, F.when(F.col("l_linenumber") > 3, a)), 4).alias("side_mid"),
        F.round(n.normalised_share(bq, aq), 6).alias("share"),
    )


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN p_retailprice > 0 THEN round((l_extendedprice / l_quantity / p_retailprice - 1) * 10000, 4) END AS basis_bps,
round(l_quantity * p_retailprice, 2) AS notional, abs(p_size - l_linenumber) AS skew FROM lineitem JOIN part ON l_partkey = p_partkey""")
def basis_and_notional(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")
    rows = load(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    basis = n.basis_bps(F.col("l_extendedprice") / F.col("l_quantity"), F.col("p_retailprice"))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(basis, 4).alias("basis_bps"), F.round(F.col("l_quantity") * F.col("p_retailprice"), 2).alias("notional"),
        F.abs(F.col("p_size") - F.col("l_linenumber")).alias("skew"),
    )


@query(f"""WITH {EV}, a AS (SELECT event_id, ms, CASE WHEN event_type <> 'error' THEN ms + (k - 50) * 1000 END AS then_ms, ms - ms % 60000 + 30000 AS now_ms FROM ev)
SELECT event_id, CASE WHEN then_ms IS NOT NULL THEN greatest(now_ms - then_ms, 0) END AS age_ms, now_ms - then_ms AS signed_age_ms,
CASE WHEN then_ms IS NOT NULL THEN greatest(0, CAST(floor((then_ms - now_ms) / 1000.0) AS BIGINT)) END AS countdown_s FROM a""")
def freshness_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    then = F.when(F.col("event_type") != "error", F.col("ms") + (F.col("k") - 50) * 1000)
    now = floor_to("ms", MINUTE_MS) + 30_000
    return ticks(spark, sf_dir).select(
        "event_id", n.clamped_age(now, then).alias("age_ms"), (now - then).alias("signed_age_ms"), n.countdown_seconds(then, now).cast("long").alias("countdown_s")
    )


_OFI = """q AS (SELECT user_id, event_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS epoch,
event_type, price AS bid, k AS bq, price + 1 AS ask, k + 1 AS aq FROM ev),
w AS (SELECT *, lag(bid) OVER o AS b0, lag(bq) OVER o AS bq0, lag(ask) OVER o AS a0, lag(aq) OVER o AS aq0 FROM q WINDOW o AS (PARTITION BY user_id, epoch ORDER BY event_id))"""


@query(f"""WITH {EV}, {_OFI} SELECT user_id, event_id, CAST(epoch AS BIGINT) AS epoch, CAST(CASE WHEN b0 IS NULL THEN 0 ELSE (CASE WHEN bid >= b0 THEN bq ELSE 0 END) - (CASE WHEN bid <= b0 THEN bq0 ELSE 0 END)
- (CASE WHEN ask <= a0 THEN aq ELSE 0 END) + (CASE WHEN ask >= a0 THEN aq0 ELSE 0 END) END AS DOUBLE) AS ofi FROM w""", money="ofi")
def bbo_order_flow_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order flow between a user's successive quotes; an error starts a new epoch."""
    rows = ticks(spark, sf_dir).select(
        "user_id", "event_id", "event_type", F.col("price").alias("bid"), F.col("k").cast("decimal(18,2)").alias("bid_size"),
        (F.col("price") + 1).cast("decimal(18,2)").alias("ask"), (F.col("k") + 1).cast("decimal(18,2)").alias("ask_size"),
    )
    marked = epochs(rows, ["user_id"], ["event_id"], F.col("event_type") == "error")
    return order_flow(marked, ["user_id", "epoch"], ["event_id"]).select("user_id", "event_id", "epoch", "ofi")


@query(f"""WITH {EV}, p AS (SELECT user_id, event_id, CASE WHEN event_type <> 'view' THEN price END AS mark, CASE WHEN k > 30 THEN k END AS idx FROM ev),
g AS (SELECT *, count(CASE WHEN mark IS NOT NULL AND idx IS NOT NULL THEN 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS grp FROM p)
SELECT user_id, event_id, CASE WHEN grp > 0 THEN first(mark) OVER w END AS held_mark, CASE WHEN grp > 0 THEN first(idx) OVER w END AS held_index
FROM g WINDOW w AS (PARTITION BY user_id, grp ORDER BY event_id ROWS UNBOUNDED PRECEDING)""", money="held_mark")
def context_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last complete (mark, index) pair; half a pair never replaces it."""
    mark, idx = F.when(F.col("event_type") != "view", F.col("price")), F.when(F.col("k") > 30, F.col("k"))
    rows = ticks(spark, sf_dir).select("user_id", "event_id", mark.alias("mark"), idx.alias("idx"))
    pair = F.when(F.col("mark").isNotNull() & F.col("idx").isNotNull(), F.struct("mark", "idx"))
    held = carried(rows, ["user_id"], ["event_id"], {"held": pair})
    return held.select("user_id", "event_id", F.col("held.mark").alias("held_mark"), F.col("held.idx").alias("held_index"))


@query(f"""WITH {EV}, b AS (SELECT event_type, ms - ms % 3600000 AS hour_ms, count(*) AS n, avg(k) AS lag, max(ms) AS last_ms FROM ev GROUP BY ALL),
s AS (SELECT *, hour_ms + 3600000 - last_ms AS age, hour_ms - lag(hour_ms) OVER (PARTITION BY event_type ORDER BY hour_ms) AS span FROM b)
SELECT event_type, hour_ms, coalesce(age BETWEEN 0 AND 1200000, false) AS age_ok, coalesce(lag BETWEEN 30 AND 70, false) AS lag_ok, coalesce(span BETWEEN 2880000 AND 4320000, false) AS span_ok,
coalesce(age BETWEEN 0 AND 1200000, false) AND coalesce(lag BETWEEN 30 AND 70, false) AND coalesce(span BETWEEN 2880000 AND 4320000, false) AND n >= 2 AS healthy FROM s""")
def health_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    bars = ticks(spark, sf_dir).groupBy("event_type", floor_to("ms", HOUR_MS).alias("hour_ms")).agg(F.count("*").alias("n"), F.avg("k").alias("lag"), F.max("ms").alias("last_ms"))
    w = Window.partitionBy("event_type").orderBy("hour_ms")
    age, span = F.col("hour_ms") + HOUR_MS - F.col("last_ms"), F.col("hour_ms") - F.lag("hour_ms").over(w)
    bars = bars.withColumns({"age": age, "span": span})
    tests = {"age_ok": F.col("age").between(0, 1_200_000), "lag_ok": F.col("lag").between(30, 70), "span_ok": F.col("span").between(2_880_000, 4_320_000)}
    healthy = _all([*tests.values(), F.col("n") >= 2])
    return bars.select("event_type", "hour_ms", *(_all([t]).alias(name) for name, t in tests.items()), healthy.alias("healthy"))


_SIDES = """m AS (SELECT user_id, event_id, ms, CASE event_type WHEN 'signup' THEN 'book' WHEN 'error' THEN 'best_bid_ask' WHEN 'click' THEN 'price_change' ELSE 'other' END AS kind,
CASE WHEN k % 3 > 0 THEN price END AS bid, CASE WHEN k % 4 > 0 THEN price + 1 END AS ask FROM ev),
s AS (SELECT *, max(CASE WHEN kind IN ('book', 'best_bid_ask') OR (kind = 'price_change' AND bid IS NOT NULL) THEN event_id END) OVER o AS bi,
max(CASE WHEN kind IN ('book', 'best_bid_ask') OR (kind = 'price_change' AND ask IS NOT NULL) THEN event_id END) OVER o AS ai FROM m WINDOW o AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))"""


@query(f"""WITH {EV}, {_SIDES}, f AS (SELECT s.user_id, s.event_id, s.ms, b.bid AS best_bid, a.ask AS best_ask, a.ms AS seen FROM s LEFT JOIN m b ON b.event_id = s.bi AND b.user_id = s.user_id LEFT JOIN m a ON a.event_id = s.ai AND a.user_id = s.user_id)
SELECT user_id, event_id, CAST(best_bid AS DOUBLE) AS best_bid, CAST(best_ask AS DOUBLE) AS best_ask FROM f WHERE ms < 1705276800000 AND ms - seen <= 86400000 AND best_ask IS NOT NULL""", money="best_bid best_ask")
def two_sided_top_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best sides after each message, where the gate lets a sample through."""
    kind = F.when(F.col("event_type") == "signup", "book").when(F.col("event_type") == "error", "best_bid_ask").when(F.col("event_type") == "click", "price_change").otherwise("other")
    rows = ticks(spark, sf_dir).select(
        "user_id", "event_id", "ms", kind.alias("kind"), F.when(F.pmod("k", F.lit(3)) > 0, F.col("price")).alias("bid"), F.when(F.pmod("k", F.lit(4)) > 0, F.col("price") + 1).alias("ask")
    )
    top = top_state(rows, ["user_id"], ["event_id"])
    sets_ask = F.col("kind").isin("book", "best_bid_ask") | ((F.col("kind") == "price_change") & F.col("ask").isNotNull())
    top = carried(top, ["user_id"], ["event_id"], {"seen": F.when(sets_ask, F.col("ms"))})
    top = top.withColumns({"up_ask": F.col("best_ask"), "down_ask": F.col("best_ask")})
    gated = two_sided_gate(top, F.col("ms"), F.lit(1_705_276_800_000), F.lit(False), F.col("seen"), 86_400_000)
    return gated.select("user_id", "event_id", "best_bid", "best_ask")


@query(f"""WITH {EV}, c AS (SELECT user_id, event_id, ms, CASE event_type WHEN 'signup' THEN 'open' WHEN 'error' THEN 'close' ELSE 'data' END AS event FROM ev),
u AS (SELECT *, coalesce(max(CASE WHEN event <> 'data' THEN ms + 3600000 END) OVER o, 0) AS until_ms, CAST(sum(CASE WHEN event = 'close' THEN 1 ELSE 0 END) OVER o AS BIGINT) AS errors FROM c
WINDOW o AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_id, until_ms, errors, ms > until_ms AS gap_ok FROM u""")
def connection_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.when(F.col("event_type") == "signup", "open").when(F.col("event_type") == "error", "close").otherwise("data")
    rows = cool_down(ticks(spark, sf_dir).withColumn("event", event), ["user_id"], ["event_id"], "ms", HOUR_MS)
    return rows.select(
        "user_id", "event_id", F.col("unhealthy_until_ms").alias("until_ms"), F.col("connection_errors").alias("errors"), (F.col("ms") > F.col("unhealthy_until_ms")).alias("gap_ok")
    )
