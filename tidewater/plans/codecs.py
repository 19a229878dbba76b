"""Strict codecs, telemetry folds, and the hand-over and catch-up of a running feed, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions import codec
from tidewater.functions.clock import HOUR_MS, PARTITION_MS, floor_to
from tidewater.operators import telemetry
from tidewater.operators.rules import checked
from tidewater.plans.merges import _NOW, _ORDERS, orders
from tidewater.plans.registry import EV, load, query, ticks
from tidewater.sources.tables import listed

SNAPSHOT = {
    "schema_version": "integer",
    "sample_second_ms": "integer",
    "bid": "decimal",
    "ask": "decimal?",
    "healthy": "boolean",
    "received_ms": "integer",
}
LIVE_PRICE = {"value": "decimal", "source_timestamp_ms": "integer?", "received_ms": "integer"}


@query(f"""WITH {EV}, w AS (SELECT event_id, ms, CAST(price AS VARCHAR) AS bid, event_id % 9 AS way FROM ev)
SELECT event_id, CASE WHEN way = 0 THEN bid END AS bid, CASE WHEN way = 0 THEN ms END AS received_ms,
CASE way WHEN 1 THEN 'repeated_field' WHEN 2 THEN 'unknown_field' WHEN 3 THEN 'missing_field' WHEN 4 THEN 'wrong_bid' WHEN 5 THEN 'unaligned_second'
WHEN 6 THEN 'unsupported_version' WHEN 7 THEN 'wrong_healthy' WHEN 8 THEN 'not_a_flat_object' END AS reject_reason FROM w""")
def snapshot_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots written by the codec, most of them then spoilt in one of eight ways, and read back."""
    second, way = floor_to("ms", 1000), F.pmod("event_id", F.lit(9))
    fields = {
        "schema_version": F.when(way == 6, 2).otherwise(1), "sample_second_ms": second + F.when(way == 5, 1).otherwise(0), "bid": F.col("price"),
        "ask": F.lit(None), "healthy": F.lit(True), "received_ms": F.col("ms"),
    }
    good = codec.encoded(fields, SNAPSHOT)
    text = (
        F.when(way == 1, F.regexp_replace(good, r"\}$", ',"bid":"1"}'))
        .when(way == 2, F.regexp_replace(good, r"\}$", ',"extra":1}'))
        .when(way == 3, F.regexp_replace(good, r',"received_ms":[0-9]+', ""))
        .when(way == 4, F.regexp_replace(good, r'"bid":"([^"]*)"', '"bid":$1'))
        .when(way == 7, F.regexp_replace(good, "true", '"true"'))
        .when(way == 8, F.substring(good, F.lit(1), F.length(good) - 3))
        .otherwise(good)
    )
    rows, columns, rules = codec.decoded_rows(ticks(spark, sf_dir).select("event_id", text.alias("text")), "text", SNAPSHOT)
    rules |= {"unsupported_version": columns["schema_version"] == 1, "unaligned_second": F.pmod(columns["sample_second_ms"], F.lit(1000)) == 0}
    out = checked(rows, rules)
    valid = F.col("reject_reason").isNull()
    return out.select("event_id", *(F.when(valid, columns[c]).alias(c) for c in ("bid", "received_ms")), "reject_reason")


@query(f"""WITH {EV}, w AS (SELECT event_id, ms, CAST(price AS VARCHAR) AS price, event_id % 6 AS way FROM ev)
SELECT event_id, CASE WHEN way IN (0, 4, 5) THEN price END AS value, CASE WHEN way IN (0, 4) THEN ms - 5 END AS source_timestamp_ms, CASE WHEN way IN (0, 4, 5) THEN ms END AS received_ms,
CASE WHEN way IN (1, 2) THEN 'wrong_value' WHEN way = 3 THEN 'wrong_received_ms' END AS reject_reason FROM w""")
def live_price_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live prices; fields beside the known ones are let through here."""
    way = F.pmod("event_id", F.lit(6))
    fields = {"value": F.col("price"), "source_timestamp_ms": F.when(way != 5, F.col("ms") - 5), "received_ms": F.when(way != 3, F.col("ms"))}
    good = codec.encoded(fields, LIVE_PRICE)
    text = (
        F.when(way == 1, F.regexp_replace(good, r'"value":"([^"]*)"', '"value":$1'))
        .when(way == 2, F.regexp_replace(good, r'"value":"([^"]*)"', '"value":"NaN"'))
        .when(way == 4, F.regexp_replace(good, r"\}$", ', "venue" : "x\\\\"y" }'))
        .otherwise(good)
    )
    rows, columns, rules = codec.decoded_rows(ticks(spark, sf_dir).select("event_id", text.alias("text")), "text", LIVE_PRICE, exact=False)
    out = checked(rows, rules)
    valid = F.col("reject_reason").isNull()
    return out.select("event_id", *(F.when(valid, columns[c]).alias(c) for c in LIVE_PRICE), "reject_reason")


@query(f"""WITH {EV} SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(price AS VARCHAR) WHEN 1 THEN CAST(price AS VARCHAR) WHEN 2 THEN k || '00' WHEN 3 THEN NULL ELSE k || '.50' END AS plain,
CAST(price AS VARCHAR) AS stored FROM ev WHERE k > 0""")
def financial_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts as plain text, whether they come as text, with an exponent, or as decimals."""
    way, k = F.pmod("event_id", F.lit(5)), F.col("k").cast("string")
    price = F.col("price").cast("string")
    text = F.when(way == 0, price).when(way == 1, F.concat(F.lit("+"), price)).when(way == 2, F.concat(k, F.lit("E+2"))).when(way == 3, "Infinity").otherwise(F.concat(k, F.lit(".50")))
    rows = ticks(spark, sf_dir).filter("k > 0").select("event_id", "price", text.alias("text"))
    stored = codec.financial_text(F.col("price"), rows.schema["price"].dataType)
    return rows.select("event_id", codec.financial_text(F.col("text"), T.StringType()).alias("plain"), stored.alias("stored"))


@query(f"""WITH {EV} SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'source,t' ELSE 'source' END AS missing, CASE WHEN event_id % 3 = 0 THEN 'a,b' ELSE '' END AS unknown FROM ev""")
def field_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that a document lacks and names that it has beyond the expected ones."""
    more = F.concat(F.when(F.pmod("event_id", F.lit(2)) == 1, ',"t":1').otherwise(""), F.when(F.pmod("event_id", F.lit(3)) == 0, ',"b":null,"a":"x,y"').otherwise(""))
    text = F.concat(F.regexp_replace("props", r"\s*\}\s*$", ""), more, F.lit("}"))
    names = F.transform(codec.members(text), lambda m: m["name"])
    missing, unknown = codec.field_difference(names, ["k", "source", "t"])
    return ticks(spark, sf_dir).select("event_id", F.array_join(missing, ",").alias("missing"), F.array_join(unknown, ",").alias("unknown"))


@query(f"""WITH {EV}, l AS (SELECT event_type, ms, event_id, k AS queue_depth, CASE WHEN event_id % 5 <> 0 THEN k * 3 END AS duration_ms, event_id % 2 = 0 AS suspended FROM ev WHERE event_id % 3 <> 0)
SELECT event_type, count(*) AS summaries, max(queue_depth) AS max_queue_depth, max(duration_ms) AS max_duration_ms, min(duration_ms) AS min_duration_ms, round(avg(duration_ms), 3) AS mean_duration_ms,
last(queue_depth ORDER BY ms, event_id) AS final_queue_depth, last(duration_ms ORDER BY ms, event_id) AS final_duration_ms, last(suspended ORDER BY ms, event_id) AS final_suspended FROM l GROUP BY event_type""")
def telemetry_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary lines of a log, picked out of others and folded by source."""
    kind = F.when(F.pmod("event_id", F.lit(3)) != 0, "raw_capture_summary").otherwise("other")
    duration = F.when(F.pmod("event_id", F.lit(5)) != 0, F.col("k") * 3)
    line = F.to_json(F.struct(kind.alias("event"), "event_type", "ms", "event_id", F.col("k").alias("queue_depth"), duration.alias("duration_ms"), (F.pmod("event_id", F.lit(2)) == 0).alias("suspended")))
    lines = ticks(spark, sf_dir).select(line.alias("value")).filter(F.get_json_object("value", "$.event") == "raw_capture_summary")
    schema = "event_type string, ms long, event_id long, queue_depth int, duration_ms int, suspended boolean"
    rows = lines.select(F.from_json("value", schema).alias("r")).select("r.*")
    return telemetry.fold(
        rows, ["event_type"], ["ms", "event_id"], most=["queue_depth", "duration_ms"], least=["duration_ms"], mean=["duration_ms"],
        last=["queue_depth", "duration_ms", "suspended"],
    )


@query(f"""WITH {EV}, s AS (SELECT count(*) AS rows, (max(ms) - min(ms) + 100) / 3600000.0::DOUBLE AS hours, CAST(sum(length(props)) AS BIGINT) AS bytes FROM ev)
SELECT rows, round(hours, 3) AS observed_hours, bytes, CASE WHEN bytes < 10240 THEN bytes || ' bytes' WHEN bytes < 10485760 THEN CAST(round(bytes / 1024.0::DOUBLE) AS BIGINT) || ' kB'
ELSE CAST(round(bytes / 1048576.0::DOUBLE) AS BIGINT) || ' MB' END AS size, CAST(round(bytes / greatest(hours, 0.001)) AS BIGINT) AS bytes_per_hour FROM s""")
def bytes_per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir)
    parts = rows.groupBy(floor_to("ms", PARTITION_MS).alias("part")).agg(F.sum(F.octet_length("props")).alias("bytes"))
    return telemetry.bytes_per_hour(rows, parts, "ms", 100)


@query(f"""WITH {EV} SELECT event_id, CASE WHEN k < 100 THEN CAST('0.' || lpad(CAST(k AS VARCHAR), 2, '0') AS DOUBLE) END AS up_ask, CASE WHEN k = 0 THEN 1.0::DOUBLE END AS down_ask FROM ev""", money="up_ask down_ask")
def best_ask_prime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asks of a market's two tokens out of a price answer; prices above one don't count."""
    k = F.col("k").cast("string")
    other = F.concat(F.lit("tok"), (F.col("k") + 1).cast("string"))
    low = F.when(F.col("k") < 100, F.concat(F.lit('"0.'), F.lpad(k, 2, "0"), F.lit('"'))).otherwise("null")
    answer = F.concat(F.lit('{"tok'), k, F.lit('":{"SELL":'), low, F.lit('},"'), other, F.lit('":{"BUY":"0.1","SELL":1.'), k, F.lit("}}"))
    asks = telemetry.best_asks(answer, {"up_ask": F.concat(F.lit("tok"), k), "down_ask": other})
    return ticks(spark, sf_dir).select("event_id", *asks)


_KEYS = (1, 2, 3, 7, 7, 32, 1_000_000_000)


@query(f"SELECT p AS o_orderkey, o_custkey FROM (SELECT unnest({list(_KEYS)}) AS p) JOIN orders ON o_orderkey = p")
def parameter_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = listed(spark, _KEYS, "o_orderkey", "bigint")
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(F.broadcast(keys), "o_orderkey")


@query(f"""WITH {EV}, r AS (SELECT user_id, event_id, ms, event_type, k % 4 <> 0 AS ok,
count(*) FILTER (k % 4 <> 0) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM ev),
lost AS (SELECT user_id, run, first(ms ORDER BY event_id) AS ms FROM r WHERE NOT ok GROUP BY ALL)
SELECT user_id, event_id * 2 + 1 AS position, event_type AS kind, ms FROM r WHERE ok
UNION ALL SELECT r.user_id, event_id * 2, 'error', lost.ms FROM r JOIN lost USING (user_id, run) WHERE ok""")
def overflow_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir).withColumn("accepted", F.pmod("k", F.lit(4)) != 0)
    return telemetry.with_loss_markers(rows, ["user_id"], "event_id", "accepted", "ms", "event_type")


@query(f"""WITH {EV}, m AS (SELECT event_id, ms, unnest(generate_series((ms - 30000) // 300000, (ms + 45000) // 300000)) AS market_id FROM ev)
SELECT event_id, market_id, CASE WHEN ms < market_id * 300000 THEN 'early' WHEN ms < market_id * 300000 + 300000 THEN 'live' ELSE 'late' END AS phase FROM m""")
def market_rollover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.open_markets(ticks(spark, sf_dir).select("event_id", "ms"), "ms").select("event_id", "market_id", "phase")


@query(f"""WITH {EV}, w AS (SELECT event_type, ms, (ms - 250) - (ms - 250) % 3600000 AS done,
max((ms - 250) - (ms - 250) % 3600000) OVER (PARTITION BY event_type ORDER BY ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ev)
SELECT event_type, b AS boundary_ms, ms AS finalised_ms, ms - b - 250 AS jitter_ms, b < done AS caught_up
FROM (SELECT *, unnest(generate_series(before + 3600000, done, 3600000)) AS b FROM w WHERE done > before)""")
def finalisation_catch_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.finalised(ticks(spark, sf_dir), ["event_type"], "ms", HOUR_MS)


_DAY = 86_400_000


@query(f"""WITH {_ORDERS}, res AS (SELECT o_orderkey AS market_id, CASE WHEN o_orderstatus = 'F' THEN 'resolved' ELSE 'pending' END AS st, total AS op, CASE WHEN o_orderkey % 2 = 0 THEN total END AS cp,
ms AS checked, CAST(o_custkey % 5 AS BIGINT) AS att, ms + {_DAY} AS nxt FROM o WHERE o_orderkey % 3 <> 0),
due AS (SELECT o_orderkey AS market_id, coalesce(att, 0) + 1 AS att FROM o LEFT JOIN res ON o_orderkey = market_id
WHERE ms <= {_NOW} AND NOT coalesce(st = 'resolved' AND op IS NOT NULL AND cp IS NOT NULL, false) AND coalesce(nxt, 0) <= {_NOW}),
news AS (SELECT due.market_id, CASE WHEN o.o_orderkey IS NULL THEN 'pending' ELSE 'resolved' END AS st, o.total AS op, o.total AS cp, {_NOW} AS checked, att,
{_NOW} + 1000 * CAST(least(3600, 30 * pow(2, greatest(least(att - 1, 16), 0))) AS BIGINT) AS nxt FROM due LEFT JOIN o ON o_orderkey = due.market_id AND o_orderkey % 5 = 0)
SELECT coalesce(a.market_id, b.market_id) AS market_id,
CASE WHEN b.market_id IS NULL OR a.st = 'resolved' THEN a.st ELSE b.st END AS resolution_status, coalesce(b.op, a.op) AS open_price, coalesce(b.cp, a.cp) AS close_price,
greatest(a.checked, b.checked) AS last_checked_ms, greatest(a.att, b.att) AS resolution_attempts,
CASE WHEN b.market_id IS NULL THEN a.nxt WHEN a.market_id IS NULL THEN b.nxt
WHEN (a.st = 'resolved' OR b.st = 'resolved') AND coalesce(b.op, a.op) IS NOT NULL AND coalesce(b.cp, a.cp) IS NOT NULL THEN NULL
WHEN b.checked < a.checked THEN a.nxt ELSE greatest(b.nxt, a.checked, b.checked) END AS next_check_ms FROM res a FULL JOIN news b ON a.market_id = b.market_id""", money="open_price close_price")
def resolution_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round of resolution work: due markets are looked up, merged, or put off for longer."""
    o = orders(spark, sf_dir)
    markets = o.select(F.col("o_orderkey").alias("market_id"), F.col("ms").alias("window_end_ms"))
    status = F.when(F.col("o_orderstatus") == "F", "resolved").otherwise("pending")
    known = o.filter(F.pmod("o_orderkey", F.lit(3)) != 0).select(
        F.col("o_orderkey").alias("market_id"), status.alias("resolution_status"), F.col("total").alias("open_price"),
        F.when(F.pmod("o_orderkey", F.lit(2)) == 0, F.col("total")).alias("close_price"), F.col("ms").alias("last_checked_ms"),
        F.pmod("o_custkey", F.lit(5)).cast("long").alias("resolution_attempts"), (F.col("ms") + _DAY).alias("next_check_ms"),
    )
    fetched = o.filter(F.pmod("o_orderkey", F.lit(5)) == 0).select(
        F.col("o_orderkey").alias("market_id"), F.lit("resolved").alias("resolution_status"), F.col("total").alias("open_price"), F.col("total").alias("close_price")
    )
    return telemetry.reconciled(markets, known, fetched, _NOW, 2**31 - 1)
