"""Merges, newest versions and due work over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.clock import epoch_ms, floor_to
from tidewater.functions.numeric import retry_delay_seconds
from tidewater.operators import merge as m
from tidewater.operators.state import latest, settled
from tidewater.plans.registry import load, query

_LINES = """l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS DECIMAL(18,2)) AS quantity,
CAST(l_extendedprice AS DECIMAL(18,2)) AS price, epoch_us(l_shipdate) // 1000 AS ms FROM lineitem)"""
_ORDERS = """o AS (SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS total, epoch_us(o_orderdate) // 1000 AS ms FROM orders)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("decimal(18,2)").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("price"), epoch_ms("l_shipdate").alias("ms"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("total"), epoch_ms("o_orderdate").alias("ms")
    )


#: A total order over lineitem, whose keys repeat.
ORDER = ["ms", "l_partkey", "l_suppkey", "quantity", "price"]
_DESC = ", ".join(f"{c} DESC" for c in ORDER)


@query(f"""WITH {_LINES} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, quantity, price, ms FROM l
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_DESC}) = 1""", money="quantity price")
def dedup_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(lines(spark, sf_dir), ["l_orderkey", "l_linenumber"], ORDER)


@query(f"""WITH {_LINES}, {_ORDERS}, n AS (SELECT l_orderkey, ms, price FROM l QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {_DESC}, l_linenumber DESC) = 1)
SELECT coalesce(o_orderkey, l_orderkey) AS order_key, CASE WHEN l_orderkey IS NULL OR o.ms > n.ms THEN o.ms ELSE n.ms END AS received_ms,
CASE WHEN l_orderkey IS NULL OR o.ms > n.ms THEN total ELSE price END AS value FROM o FULL JOIN n ON o_orderkey = l_orderkey""", money="value")
def receipt_guarded_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stored rows, their newest line as the new row, kept only if not older."""
    target = orders(spark, sf_dir).select(F.col("o_orderkey").alias("order_key"), F.col("ms").alias("received_ms"), F.col("total").alias("value"))
    source = latest(lines(spark, sf_dir), ["l_orderkey"], [*ORDER, "l_linenumber"])
    source = source.select(F.col("l_orderkey").alias("order_key"), F.col("ms").alias("received_ms"), F.col("price").alias("value"))
    return m.merge(target, source, ["order_key"], {}, m.guarded("received_ms"))


def _resolutions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Old and new resolution rows made of orders: odd keys' rows count as the check before."""
    o = orders(spark, sf_dir).withColumn("day", F.call_function("div", "ms", F.lit(86_400_000)))
    status = F.when(F.col("o_orderstatus") == "F", "resolved").otherwise("pending")
    row = lambda shift, open_mod, close_mod: [
        (F.col("o_orderkey") - F.pmod("o_orderkey", F.lit(2))).alias("market_id"), status.alias("resolution_status"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).alias("winner"), F.when(F.pmod("o_custkey", F.lit(open_mod)) > 0, F.col("total")).alias("open_price"),
        F.when(F.pmod("o_custkey", F.lit(close_mod)) > 0, F.col("total")).alias("close_price"), (F.col("day") + shift).alias("last_checked_ms"),
        F.when(F.pmod("o_custkey", F.lit(5)) > 0, F.col("day") + shift + 10).alias("next_check_ms"), F.pmod("o_custkey", F.lit(7)).alias("resolution_attempts"),
    ]
    old = o.filter(F.pmod("o_orderkey", F.lit(2)) == 0).select(*row(0, 3, 4))
    new = o.filter(F.pmod("o_orderkey", F.lit(2)) == 1).select(*row(3, 2, 3))
    return old, new


def _resolution_sql(shift: int, om: int, cm: int, odd: int) -> str:
    return f"""SELECT o_orderkey - o_orderkey % 2 AS market_id, CASE WHEN o_orderstatus = 'F' THEN 'resolved' ELSE 'pending' END AS st,
CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS winner, CASE WHEN o_custkey % {om} > 0 THEN total END AS op, CASE WHEN o_custkey % {cm} > 0 THEN total END AS cp,
ms // 86400000 + {shift} AS chk, CASE WHEN o_custkey % 5 > 0 THEN ms // 86400000 + {shift} + 10 END AS nxt, o_custkey % 7 AS att FROM o WHERE o_orderkey % 2 = {odd}"""


@query(f"""WITH {_ORDERS}, a AS ({_resolution_sql(0, 3, 4, 0)}), b AS ({_resolution_sql(3, 2, 3, 1)})
SELECT coalesce(a.market_id, b.market_id) AS market_id,
CASE WHEN b.market_id IS NULL OR a.st = 'resolved' THEN a.st ELSE b.st END AS resolution_status,
CASE WHEN b.market_id IS NULL OR a.st = 'resolved' THEN a.winner ELSE b.winner END AS winner,
coalesce(b.op, a.op) AS open_price, coalesce(b.cp, a.cp) AS close_price, greatest(a.chk, b.chk) AS last_checked_ms,
CASE WHEN a.market_id IS NULL THEN b.nxt WHEN b.market_id IS NULL THEN a.nxt
WHEN (a.st = 'resolved' OR b.st = 'resolved') AND coalesce(b.op, a.op) IS NOT NULL AND coalesce(b.cp, a.cp) IS NOT NULL THEN NULL
WHEN b.chk < a.chk THEN a.nxt WHEN b.nxt IS NULL THEN NULL ELSE greatest(b.nxt, a.chk, b.chk) END AS next_check_ms,
greatest(a.att, b.att) AS resolution_attempts FROM a FULL JOIN b ON a.market_id = b.market_id""", money="open_price close_price")
def sticky_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _resolutions(spark, sf_dir)
    return m.merge(old, new, ["market_id"], m.RESOLUTION_RULES)


@query("""SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT DISTINCT o_custkey, 'order ' || o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)""")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = load(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    fresh = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.concat(F.lit("order "), F.col("o_custkey")).alias("name"))
    return m.insert_absent(held, fresh, ["id"])


@query(f"""WITH {_ORDERS}, c AS (SELECT o_custkey AS id, min(ms) AS first_seen, max(ms) AS last_seen, count(*) AS received, count(*) FILTER (o_orderstatus = 'F') AS accepted,
o_orderkey % 2 AS half FROM o GROUP BY o_custkey, half)
SELECT coalesce(a.id, b.id) AS id, coalesce(a.first_seen, b.first_seen) AS first_seen_ms, coalesce(b.last_seen, a.last_seen) AS last_seen_ms,
coalesce(a.first_seen, b.first_seen) AS connected_ms, greatest(a.received, b.received) AS received, greatest(a.accepted, b.accepted) AS accepted
FROM (SELECT * FROM c WHERE half = 0) a FULL JOIN (SELECT * FROM c WHERE half = 1) b ON a.id = b.id""")
def lifecycle_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir)
    side = lambda half: o.filter(F.pmod("o_orderkey", F.lit(2)) == half).groupBy(F.col("o_custkey").alias("id")).agg(
        F.min("ms").alias("first_seen_ms"), F.max("ms").alias("last_seen_ms"), F.min("ms").alias("connected_ms"),
        F.count("*").alias("received"), F.count_if(F.col("o_orderstatus") == "F").alias("accepted"),
    )
    return m.merge(side(0), side(1), ["id"], m.MARKET_RULES | m.SESSION_RULES)


_NOW = 852_076_800_000  # 1997-01-01


@query(f"""WITH {_LINES}, v AS (SELECT l_suppkey, ms - ms % 86400000 AS day_ms, l_orderkey, l_linenumber, price, ms FROM l WHERE ms <= {_NOW}
QUALIFY row_number() OVER (PARTITION BY l_suppkey, ms - ms % 86400000 ORDER BY {_DESC}, l_orderkey DESC, l_linenumber DESC) = 1)
SELECT l_suppkey, day_ms, l_orderkey, price FROM v QUALIFY day_ms < max(day_ms) OVER (PARTITION BY l_suppkey) OR {_NOW} - ms >= 864000000""", money="price")
def coalesce_per_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest line per supplier and day; a supplier's last day only once it has settled for ten days."""
    rows = lines(spark, sf_dir).filter(F.col("ms") <= _NOW).withColumn("day_ms", floor_to("ms", 86_400_000))
    order = [*ORDER, "l_orderkey", "l_linenumber"]
    found = settled(rows, ["l_suppkey"], "day_ms", order, "ms", _NOW, 864_000_000)
    return found.select("l_suppkey", "day_ms", "l_orderkey", "price")


@query(f"""WITH {_ORDERS}, a AS ({_resolution_sql(0, 3, 4, 0)}), k AS (SELECT o_orderkey AS market_id, ms AS window_end_ms FROM o)
SELECT k.market_id, window_end_ms, coalesce(nxt, 0) AS next_check FROM k LEFT JOIN a USING (market_id)
WHERE window_end_ms <= {_NOW} AND NOT coalesce(st = 'resolved' AND op IS NOT NULL AND cp IS NOT NULL, false) AND coalesce(nxt, 0) <= {_NOW}
ORDER BY coalesce(nxt, 0), window_end_ms DESC, k.market_id LIMIT 25""")
def due_work_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 next markets to check. Window ends repeat here, so the cut is by id as well."""
    old, _ = _resolutions(spark, sf_dir)
    markets = orders(spark, sf_dir).select(F.col("o_orderkey").alias("market_id"), F.col("ms").alias("window_end_ms"))
    rows = m.due(markets, old, _NOW, 2**31 - 1)
    check = F.coalesce("next_check_ms", F.lit(0)).alias("next_check")
    rows = rows.select("market_id", "window_end_ms", check)
    return rows.orderBy("next_check", F.desc("window_end_ms"), "market_id").limit(25)


@query(f"""WITH {_ORDERS}, t AS (SELECT o_orderkey, ms, CAST(o_custkey % 12 AS BIGINT) AS attempt FROM o), d AS (SELECT *, CAST(least(3600, 30 * pow(2, greatest(least(attempt - 1, 16), 0))) AS BIGINT) AS delay_s FROM t)
SELECT o_orderkey, attempt, delay_s, ms + delay_s * 1000 AS next_check_ms FROM d""")
def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempt = F.pmod("o_custkey", F.lit(12)).cast("long")
    rows = orders(spark, sf_dir).select("o_orderkey", "ms", attempt.alias("attempt"), retry_delay_seconds(attempt).cast("long").alias("delay_s"))
    return rows.select("o_orderkey", "attempt", "delay_s", (F.col("ms") + F.col("delay_s") * 1000).alias("next_check_ms"))
