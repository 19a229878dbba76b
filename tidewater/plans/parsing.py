"""Parsing, rendering and validation over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import text as t
from tidewater.functions.clock import MARKET_MS, PARTITION_MS, closed_by, epoch_or_iso_ms, floor_to, iso_text, source_window_start, timestamp_of
from tidewater.functions.numeric import compact_text, fixed_text, size_text
from tidewater.operators.rules import checked, rejected_counts
from tidewater.plans.merges import _ORDERS, orders
from tidewater.plans.registry import EV, load, query, ticks


@query(f"""WITH {EV} SELECT event_id, k, coalesce(json_extract_string(props, '$.key'), json_extract_string(props, '$.k')) AS first_value,
json_extract_string('{{"data":' || props || '}}', '$.data.k') AS unwrapped FROM ev""")
def json_path_first_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    enveloped = t.unwrapped(F.concat(F.lit('{"stream":"x","data":'), F.col("props"), F.lit("}")))
    return ticks(spark, sf_dir).select("event_id", "k", t.first_path(F.col("props"), "$.key", "$.k").alias("first_value"), F.get_json_object(enveloped, "$.k").alias("unwrapped"))


@query(f"""WITH {EV} SELECT event_id, CASE event_id % 4 WHEN 0 THEN ms WHEN 1 THEN ms // 1000 * 1000 WHEN 2 THEN ms // 1000 * 1000 - 3600000 END AS parsed_ms FROM ev""")
def epoch_or_iso_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clocks written in four ways: milliseconds, seconds, ISO text an hour ahead, and junk."""
    ms, way = F.col("ms"), F.pmod("event_id", F.lit(4))
    second = floor_to("ms", 1000)
    iso = F.concat(F.substring(iso_text(second), 1, 19), F.lit("+01:00"))
    text = F.when(way == 0, ms.cast("string")).when(way == 1, F.call_function("div", second, F.lit(1000)).cast("string")).when(way == 2, iso).otherwise("n/a")
    return ticks(spark, sf_dir).select("event_id", epoch_or_iso_ms(text).alias("parsed_ms"))


@query(f"""WITH {EV} SELECT event_id, 'market-5m-' || ((ms - ms % 300000) // 1000) AS slug, 'raw_p' || (ms - ms % 21600000) AS partition_name FROM ev""")
def slug_and_partition_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = t.slug("market-5m", floor_to("ms", MARKET_MS)).alias("slug"), t.partition_name("raw", floor_to("ms", PARTITION_MS)).alias("partition_name")
    return ticks(spark, sf_dir).select("event_id", *names)


@query(f"""WITH {_ORDERS} SELECT o_orderkey, CAST(CAST(total AS DECIMAL(18,1)) AS VARCHAR) AS one_place, CAST(total AS VARCHAR) AS plain, regexp_replace(CAST(total AS VARCHAR), '\\.?0+$', '') AS compact FROM o""")
def round_half_up_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.col("total")
    return orders(spark, sf_dir).select("o_orderkey", fixed_text(total, 1).alias("one_place"), total.cast("string").alias("plain"), compact_text(total).alias("compact"))


_LINE_RULES = {
    "discount_in_range": "l_discount between 0 and 0.05",
    "quantity_positive": "l_quantity > 0",
    "flag_known": "l_returnflag in ('A', 'N')",
    "price_covers_tax": "l_extendedprice * l_tax < 4000",
}


@query("SELECT rule, count(*) FILTER (NOT ok) AS rejected FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS rule, {v} AS ok FROM lineitem" for k, v in _LINE_RULES.items()) + ") GROUP BY rule")
def validation_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected_counts(load(spark, sf_dir, "lineitem"), {k: F.expr(v) for k, v in _LINE_RULES.items()})


@query(f"""WITH {EV}, z AS (SELECT event_id, k, unnest([0, 1]) AS pos FROM ev WHERE k % 5 <> 0)
SELECT event_id, CASE pos WHEN 0 THEN 'Up' ELSE 'Down' END AS label, CASE pos WHEN 0 THEN 'tok' || k ELSE 'tok' || (k + 1) END AS token, CASE WHEN k % 2 = 0 THEN true ELSE false END AS active FROM z""")
def outcome_token_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome labels paired with tokens by position; unequal lists give no pair."""
    labels = t.listed(F.lit('["Up", "Down"]'))
    tokens = F.concat(F.lit("tok"), F.col("k"), F.when(F.pmod("k", F.lit(5)) != 0, F.concat(F.lit(", tok"), F.col("k") + 1)).otherwise(""))
    active = t.bool_of(F.when(F.pmod("k", F.lit(2)) == 0, " TRUE ").otherwise("False"))
    rows = ticks(spark, sf_dir).select("event_id", active.alias("active"), labels.alias("label"), t.listed(tokens).alias("token"))
    pairs = rows.select("event_id", "active", F.explode(t.zipped(F.col("label"), F.col("token"))).alias("p"))
    return pairs.select("event_id", "p.label", "p.token", "active")


@query("""WITH l AS (SELECT l_orderkey, CASE WHEN count(*) FILTER (l_linestatus = 'F') = count(*) THEN 'F' WHEN count(*) FILTER (l_linestatus = 'O') = count(*) THEN 'O' ELSE 'P' END AS s FROM lineitem GROUP BY 1)
SELECT coalesce(o_orderstatus, '-') AS said, coalesce(s, '-') AS derived, count(*) AS n, count(*) FILTER (o_orderstatus = s) AS agree, count(*) FILTER (o_orderstatus <> s) AS conflict
FROM orders LEFT JOIN l ON o_orderkey = l_orderkey GROUP BY ALL""")
def two_source_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order status as stated and as its lines have it."""
    f, o = F.count_if(F.col("l_linestatus") == "F"), F.count_if(F.col("l_linestatus") == "O")
    derived = F.when(f == F.count("*"), "F").when(o == F.count("*"), "O").otherwise("P")
    lines = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(derived.alias("s"))
    both = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(lines, "o_orderkey", "left")
    return both.groupBy(F.coalesce("o_orderstatus", F.lit("-")).alias("said"), F.coalesce("s", F.lit("-")).alias("derived")).agg(
        F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == F.col("s")).alias("agree"), F.count_if(F.col("o_orderstatus") != F.col("s")).alias("conflict")
    )


@query(f"""WITH {EV} SELECT event_id, strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN ms % 1000 = 0 THEN '' ELSE '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') || '000' END || 'Z' AS iso,
ms AS round_trip_ms, CASE WHEN event_id * 1000 < 10240 THEN (event_id * 1000) || ' bytes' WHEN event_id * 1000 < 10485760 THEN CAST(round(event_id * 1000 / 1024.0) AS BIGINT) || ' kB'
ELSE CAST(round(event_id * 1000 / 1048576.0) AS BIGINT) || ' MB' END AS size FROM ev""")
def iso_and_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = F.unix_millis(timestamp_of("ms")).alias("round_trip_ms")
    return ticks(spark, sf_dir).select("event_id", iso_text("ms").alias("iso"), back, size_text(F.col("event_id") * 1000).alias("size"))


@query(f"""WITH {EV}, s AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ms - ms % 300000 ELSE ms END AS stamp FROM ev), w AS (SELECT event_id, CASE WHEN stamp % 300000 = 0 THEN stamp - 300000 ELSE stamp - stamp % 300000 END AS source_start_ms FROM s)
SELECT event_id, source_start_ms, source_start_ms + 300000 AS effective_start_ms FROM w WHERE source_start_ms + 300000 <= 1705276800000""")
def closed_window_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.when(F.pmod("event_id", F.lit(3)) == 0, floor_to("ms", MARKET_MS)).otherwise(F.col("ms"))
    rows = ticks(spark, sf_dir).select("event_id", source_window_start(stamp).alias("source_start_ms"))
    rows = rows.withColumn("effective_start_ms", F.col("source_start_ms") + MARKET_MS)
    return rows.filter(closed_by(F.col("effective_start_ms"), F.lit(1_705_276_800_000 + 12_345)))


@query(f"""WITH {EV} SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{{"a":"x","k":"' || k || '"}}' ELSE '{{"a":"x","k":"old","z":"' || event_type || '"}}' END AS merged FROM ev""")
def json_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.when(F.pmod("event_id", F.lit(2)) == 0, F.lit('{"k":"old","a":"x"}')).otherwise(F.concat(F.lit('{"z":"'), F.col("event_type"), F.lit('","k":"old"}')))
    new = F.when(F.pmod("event_id", F.lit(2)) == 0, F.col("props")).otherwise(F.lit('{"a":"x"}'))
    return ticks(spark, sf_dir).select("event_id", t.json_merge(old, new).alias("merged"))


@query(f"""WITH {EV}, c AS (SELECT event_id, [k % 7, k % 5, k % 3] AS xs FROM ev)
SELECT event_id, CASE WHEN xs[1] = 2 THEN 1 WHEN xs[2] = 2 THEN 2 WHEN xs[3] = 2 THEN 3 ELSE 1 END AS pos, CASE WHEN xs[1] = 2 OR xs[2] = 2 OR xs[3] = 2 THEN 2 ELSE xs[1] END AS found, list_reverse_sort(xs)[1] AS top FROM c""")
def first_match_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First candidate in document order that matches, else the first one."""
    xs = F.array(*(F.pmod("k", F.lit(d)) for d in (7, 5, 3)))
    rows = ticks(spark, sf_dir).select("event_id", xs.alias("xs"))
    pos = F.array_position("xs", 2).cast("int")
    pos = F.when(pos > 0, pos).otherwise(1)
    return rows.select("event_id", pos.alias("pos"), F.element_at("xs", pos).alias("found"), F.sort_array("xs", asc=False)[0].alias("top"))


_TEXTS = ("concat('0', k, '.50')", "concat('-', k)", "'1e5'", "concat(k, '.1234567890123456789')", "concat(k, '.10')")


@query(f"""WITH {EV}, x AS (SELECT event_id, k, event_id % 5 AS way FROM ev) SELECT event_id, CASE way WHEN 0 THEN CAST(k AS DOUBLE) + 0.5 WHEN 4 THEN CAST(k AS DOUBLE) + 0.1 END AS price,
CASE WHEN way IN (2, 3) THEN 'not_a_storable_number' WHEN way = 1 THEN CASE WHEN k = 0 THEN 'not_positive' ELSE 'not_positive' END WHEN way = 0 AND k % 4 = 0 THEN 'wrong_type' END AS reject_reason FROM x""", money="price")
def strict_text_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in five forms, two of which are prices that can be stored."""
    way = F.pmod("event_id", F.lit(5))
    text = F.coalesce(*(F.when(way == i, F.expr(x)) for i, x in enumerate(_TEXTS)))
    rows = ticks(spark, sf_dir).select("event_id", way.alias("way"), "k", text.alias("text"))
    rules = {
        "not_a_storable_number": t.strict_decimal(F.col("text")).isNotNull(),
        "not_positive": t.strict_decimal(F.col("text"), sign="positive").isNotNull(),
        "wrong_type": ~((F.col("way") == 0) & (F.pmod("k", F.lit(4)) == 0)),
    }
    price = t.strict_decimal(F.col("text"), sign="positive").cast("decimal(18,2)")
    return checked(rows, rules).select("event_id", price.alias("price"), "reject_reason")


_BOOK_RULES = {
    "not_crossed": "l_extendedprice + l_tax >= l_extendedprice",
    "enough_levels": "l_linenumber <= 6",
    "ids_in_order": "l_partkey >= l_suppkey",
    "inside_window": "l_orderkey % 300 < 290",
    "winner_or_split": "l_returnflag <> 'A' or l_linestatus = 'F'",
}


@query("SELECT rule, count(*) FILTER (NOT ok) AS rejected FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS rule, {v} AS ok FROM lineitem" for k, v in _BOOK_RULES.items()) + ") GROUP BY rule")
def book_shape_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected_counts(load(spark, sf_dir, "lineitem"), {k: F.expr(v) for k, v in _BOOK_RULES.items()})
