"""Index, paging, latest-row and dimension queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.clock import bucket_id, epoch_ms, iso_text
from tidewater.functions.numeric import compact_text, fixed_text
from tidewater.functions.text import stream_name
from tidewater.operators.rules import page
from tidewater.plans.merges import _ORDERS, orders
from tidewater.plans.registry import EV, load, query, ticks


@query(f"""WITH {EV}, c AS (SELECT DISTINCT ms // 300000 AS market_id FROM ev WHERE event_type IN ('purchase', 'signup'))
SELECT market_id, count(*) AS samples, count(*) FILTER (event_type = 'purchase') AS purchases, count(*) FILTER (event_type = 'signup') AS signups,
count(*) FILTER (price > 100) AS large FROM (SELECT *, ms // 300000 AS market_id FROM ev) SEMI JOIN c USING (market_id) GROUP BY market_id ORDER BY market_id DESC LIMIT 50""")
def market_index_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 newest markets with a purchase or a sign-up, and their counts.

    The page's ids are found first; only their rows are grouped.
    """
    rows = ticks(spark, sf_dir).withColumn("market_id", bucket_id("ms"))
    newest = rows.filter(F.col("event_type").isin("purchase", "signup")).select("market_id").distinct().orderBy(F.desc("market_id")).limit(50)
    return rows.join(newest, "market_id", "left_semi").groupBy("market_id").agg(
        F.count("*").alias("samples"), F.count_if(F.col("event_type") == "purchase").alias("purchases"),
        F.count_if(F.col("event_type") == "signup").alias("signups"), F.count_if(F.col("price") > 100).alias("large"),
    )


@query("""WITH p AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey < 1000 ORDER BY o_orderkey DESC LIMIT 21)
SELECT o_orderkey, o_orderstatus, CASE WHEN (SELECT count(*) FROM p) > 20 THEN (SELECT min(o_orderkey) FROM (SELECT o_orderkey FROM p ORDER BY 1 DESC LIMIT 20)) END AS next_cursor
FROM p ORDER BY o_orderkey DESC LIMIT 20""")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 20, before=1000)


@query(f"WITH {EV} SELECT max(event_id) FILTER (event_type = 'click') AS click_id, max(event_id) FILTER (event_type = 'view') AS view_id, max(event_id) FILTER (event_type = 'refund') AS refund_id FROM ev")
def pivot_conditional_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ("click", "view", "refund")
    return ticks(spark, sf_dir).agg(*(F.max(F.when(F.col("event_type") == k, F.col("event_id"))).alias(f"{k}_id") for k in kinds))


def _latest_sql(kind: str) -> str:
    return f"SELECT event_id, ms, price FROM ev WHERE event_type = '{kind}' ORDER BY ms DESC, event_id DESC LIMIT 1"


@query(f"""WITH {EV} SELECT c.event_id AS click_id, c.price AS click_price, r.event_id AS refund_id, r.price AS refund_price, v.ms AS view_ms
FROM (SELECT 1) LEFT JOIN ({_latest_sql("click")}) c ON true LEFT JOIN ({_latest_sql("refund")}) r ON true LEFT JOIN ({_latest_sql("view")}) v ON true""", money="click_price refund_price")
def one_row_null_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of three sources in one row; a source without rows gives nulls.

    Every joined side is limited to one row before the join.
    """
    rows = ticks(spark, sf_dir)
    out = spark.range(1).select(F.lit(1).alias("one"))
    for kind in ("click", "refund", "view"):
        top = rows.filter(F.col("event_type") == kind).orderBy(F.coalesce("ms", F.lit(0)).desc(), F.desc("event_id")).limit(1)
        top = top.select(F.lit(1).alias("one"), *(F.col(c).alias(f"{kind}_{n}") for c, n in (("event_id", "id"), ("price", "price"), ("ms", "ms"))))
        out = out.join(top, "one", "left")
    return out.select("click_id", "click_price", "refund_id", "refund_price", "view_ms")


@query("""SELECT r_name, n_name, row_number() OVER (ORDER BY CASE r_name WHEN 'ASIA' THEN 0 WHEN 'EUROPE' THEN 1 ELSE 2 END, r_name, n_name DESC) AS rank
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def case_rank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations in a fixed order of regions. The dimension has 25 rows, so one window is enough."""
    from pyspark.sql import Window

    rank = F.when(F.col("r_name") == "ASIA", 0).when(F.col("r_name") == "EUROPE", 1).otherwise(2)
    rows = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    w = Window.orderBy(rank, "r_name", F.desc("n_name"))
    return rows.select("r_name", "n_name", F.row_number().over(w).cast("long").alias("rank"))


@query("""SELECT r_name, n_name, c_mktsegment, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE o_orderstatus = 'F' GROUP BY ALL""", money="total")
def dimension_star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by region, nation and segment. Nation and region are fixed small dimensions."""
    places = load(spark, sf_dir, "nation").join(F.broadcast(load(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    places = places.select("n_nationkey", "n_name", "r_name")
    people = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    done = load(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("total"))
    rows = done.join(people, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("r_name", "n_name", "c_mktsegment").agg(F.count("*").alias("orders"), F.sum("total").cast("decimal(18,2)").alias("total"))


@query("""SELECT o_orderkey, c_mktsegment, o_orderpriority, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey
WHERE ((c_mktsegment = 'BUILDING' AND o_orderstatus = 'F') OR (c_mktsegment = 'MACHINERY' AND o_orderstatus = 'O'))
AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' AND o_custkey IS NOT NULL AND o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def region_pair_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.col("o_orderdate")
    wanted = load(spark, sf_dir, "orders").filter(
        (date >= F.expr("TIMESTAMP_NTZ'1995-01-01'")) & (date < F.expr("TIMESTAMP_NTZ'1996-01-01'"))
        & F.col("o_custkey").isNotNull() & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & F.col("o_orderstatus").isin("F", "O")
    )
    people = load(spark, sf_dir, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_mktsegment")
    pair = F.expr("(c_mktsegment = 'BUILDING' and o_orderstatus = 'F') or (c_mktsegment = 'MACHINERY' and o_orderstatus = 'O')")
    joined = wanted.join(people, F.col("o_custkey") == F.col("c_custkey")).filter(pair)
    return joined.select("o_orderkey", "c_mktsegment", "o_orderpriority", "o_totalprice").orderBy("o_orderkey")


def orders_where(df: DataFrame, status: str | None = None, before: int | None = None, least: float | None = None, most_rows: int = 300) -> DataFrame:
    """Optional predicates: one that isn't given isn't part of the plan."""
    if status is not None:
        df = df.filter(F.col("o_orderstatus") == status)
    if before is not None:
        df = df.filter(F.col("o_orderkey") < before)
    if least is not None:
        df = df.filter(F.col("o_totalprice") >= least)
    return df.orderBy("o_orderkey").limit(most_rows)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O' AND o_orderkey < 5000 ORDER BY o_orderkey LIMIT 300")
def optional_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_where(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "O", 5000).drop("o_totalprice")


@query("""SELECT p_partkey, CAST(regexp_extract(p_brand, '#([0-9]+)$', 1) AS INTEGER) AS brand_no, upper(trim(p_name)) AS name, split_part(p_type, ' ', 1) AS kind,
lower(p_brand) || '@aggTrade' AS stream, regexp_matches(p_name, '[0-9]+$') AS numbered FROM part WHERE regexp_matches(p_brand, '#[0-9]+$')""")
def name_pattern_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "part").filter(F.col("p_brand").rlike("#[0-9]+$"))
    return rows.select(
        "p_partkey", F.regexp_extract("p_brand", "#([0-9]+)$", 1).cast("int").alias("brand_no"), F.upper(F.trim("p_name")).alias("name"),
        F.split_part("p_type", F.lit(" "), F.lit(1)).alias("kind"), stream_name(F.col("p_brand"), "aggTrade").alias("stream"), F.col("p_name").rlike("[0-9]+$").alias("numbered"),
    )


@query(f"""WITH {_ORDERS} SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN total > 200000 THEN 'large' ELSE 'open' END AS state,
coalesce(CASE WHEN o_orderstatus = 'F' THEN o_custkey END, o_orderkey) AS owner, greatest(total, CASE WHEN o_custkey % 2 = 0 THEN 150000.00 END) AS at_least FROM o""", money="at_least")
def case_coalesce_greatest(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.col("o_orderstatus") == "F"
    floor = F.when(F.pmod("o_custkey", F.lit(2)) == 0, F.lit(150_000).cast("decimal(18,2)"))
    return orders(spark, sf_dir).select(
        "o_orderkey", F.when(done, "done").when(F.col("total") > 200_000, "large").otherwise("open").alias("state"),
        F.coalesce(F.when(done, F.col("o_custkey")), F.col("o_orderkey")).alias("owner"), F.greatest("total", floor).alias("at_least"),
    )


def series_item(rows: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """Nested item of a series, with the groups that are asked for."""
    made = {
        "prices": F.struct(fixed_text(F.col("price"), 2).alias("last"), compact_text(F.col("price")).alias("compact")).alias("prices"),
        "clocks": F.struct("ms", iso_text("ms").alias("at")).alias("clocks"),
        "sizes": F.struct("k", (F.col("k") * 2).alias("twice")).alias("sizes"),
    }
    unknown = set(groups) - set(made)
    if unknown or not groups:
        raise ValueError(f"groups must be some of {sorted(made)}")
    return rows.select("event_id", F.struct(*(made[g] for g in made if g in groups)).alias("item"))


@query(f"""WITH {EV} SELECT event_id, CAST(price AS VARCHAR) AS last, regexp_replace(CAST(price AS VARCHAR), '\\.?0+$', '') AS compact, ms, k FROM ev""")
def nested_series_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = series_item(ticks(spark, sf_dir), ("sizes", "prices", "clocks"))
    return items.select("event_id", "item.prices.last", "item.prices.compact", "item.clocks.ms", "item.sizes.k")


@query(f"""WITH {EV} SELECT event_id, event_type, CAST(CAST(price AS DECIMAL(18,1)) AS VARCHAR) AS price, CAST(k AS VARCHAR) AS futures_last FROM ev WHERE k IS NOT NULL""")
def export_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items trimmed for export: a field dropped, one moved into another struct, prices rounded."""
    rows = ticks(spark, sf_dir).filter("k is not null")
    full = rows.select("event_id", F.struct("price", "ms").alias("prices"), F.struct(F.col("k").alias("last"), "user_id").alias("futures"), "event_type")
    moved = full.withColumn("prices", F.col("prices").withField("futures_last", F.col("futures.last")).dropFields("ms")).drop("futures")
    price = fixed_text(F.col("prices.price"), 1).alias("price")
    return moved.select("event_id", "event_type", price, F.col("prices.futures_last").cast("string").alias("futures_last"))
