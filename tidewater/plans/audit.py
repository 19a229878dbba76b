"""Audit reports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.clock import DAY_MS, HOUR_MS, MINUTE_MS, PARTITION_MS, floor_to
from tidewater.operators import audit
from tidewater.operators.rules import retention_plan as plan_retention
from tidewater.operators.series import grid, spanned_grid
from tidewater.plans.registry import EV, load, query, ticks
from tidewater.plans.series import DAY

#: Start and length of the whole event range, in hours.
RANGE_START, RANGE_HOURS = 1_704_067_200_000, 720


@query(f"""WITH {EV}, b AS (SELECT DISTINCT event_type, ms - ms % 3600000 AS hour_ms FROM ev),
g AS (SELECT event_type, (hour_ms - lag(hour_ms) OVER (PARTITION BY event_type ORDER BY hour_ms)) // 3600000 AS gap FROM b)
SELECT event_type, count(*) AS rows, round(100.0::DOUBLE * count(*) / {RANGE_HOURS}, 2) AS coverage_pct, max(gap) AS max_gap, count(*) FILTER (gap > 1) AS gaps FROM g GROUP BY event_type""")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir).withColumn("hour_ms", floor_to("ms", HOUR_MS))
    return audit.coverage(rows, ["event_type"], "hour_ms", HOUR_MS, F.lit(RANGE_HOURS))


_PERIODS = [("week1", DAY - 9 * DAY_MS, DAY - 2 * DAY_MS), ("overlap", DAY - 4 * DAY_MS, DAY + DAY_MS), ("late", DAY + 15 * DAY_MS, DAY + 25 * DAY_MS), ("empty", 0, DAY_MS)]


@query(f"""WITH {EV}, p(period, a, b) AS (VALUES {", ".join(str(p) for p in _PERIODS)}), d AS (SELECT unnest(['click', 'view', 'refund']) AS event_type),
i AS (SELECT period, event_type, ms - lag(ms) OVER (PARTITION BY period, event_type ORDER BY ms) AS gap FROM ev JOIN p ON ms >= a AND ms < b),
s AS (SELECT period, event_type, count(*) AS rows, max(gap) AS max_gap_ms, count(*) FILTER (gap > 3600000) AS gaps FROM i GROUP BY ALL)
SELECT period, event_type, coalesce(rows, 0) AS rows, max_gap_ms, coalesce(gaps, 0) AS gaps FROM p CROSS JOIN d LEFT JOIN s USING (period, event_type)""")
def period_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    periods = spark.createDataFrame(_PERIODS, "period string, start_ms long, end_ms long")
    kinds = spark.createDataFrame([("click",), ("view",), ("refund",)], "event_type string")
    return audit.period_coverage(ticks(spark, sf_dir), periods, kinds, "event_type", "ms", HOUR_MS)


@query(f"""WITH {EV}, g AS (SELECT unnest(generate_series({DAY}, {DAY} + 86340000, 60000)) AS minute_ms),
m AS (SELECT minute_ms FROM g ANTI JOIN (SELECT DISTINCT ms - ms % 60000 AS minute_ms FROM ev) USING (minute_ms))
SELECT count(*) AS missing, min(minute_ms) AS first_missing, max(minute_ms) AS last_missing, coalesce(string_agg(CAST(minute_ms AS VARCHAR), ',' ORDER BY minute_ms), '') AS missing_list FROM m""")
def missing_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir, DAY, DAY + DAY_MS)
    minutes = grid(spark, DAY, DAY + DAY_MS, MINUTE_MS, "minute_ms")
    return audit.missing(rows.select(floor_to("ms", MINUTE_MS).alias("minute_ms")), minutes, "minute_ms")


@query(f"""WITH {EV}, b AS (SELECT DISTINCT ms - ms % 60000 AS minute_ms FROM ev),
g AS (SELECT unnest(generate_series(min(minute_ms), max(minute_ms), 60000)) AS minute_ms FROM b),
m AS (SELECT minute_ms FROM g ANTI JOIN b USING (minute_ms))
SELECT count(*) AS missing, min(minute_ms) AS first_missing, max(minute_ms) AS last_missing, coalesce(string_agg(CAST(minute_ms AS VARCHAR), ',' ORDER BY minute_ms), '') AS missing_list FROM m""")
def missing_buckets_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty minutes between the table's first event and its last."""
    rows = ticks(spark, sf_dir).select(floor_to("ms", MINUTE_MS).alias("minute_ms"))
    return audit.missing(rows, spanned_grid(rows, [], "minute_ms", MINUTE_MS), "minute_ms")


@query(f"""WITH {EV}, b AS (SELECT DISTINCT event_type, ms - ms % 60000 AS minute_ms FROM ev),
r AS (SELECT event_type, lag(minute_ms) OVER (PARTITION BY event_type ORDER BY minute_ms) + 60000 AS a, minute_ms - 60000 AS z FROM b)
SELECT event_type, a AS first_minute_ms, z AS last_minute_ms, (z - a) // 60000 + 1 AS missing FROM r WHERE z >= a""")
def missing_minute_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of minutes without an event of a source, a row each."""
    rows = ticks(spark, sf_dir).select("event_type", floor_to("ms", MINUTE_MS).alias("minute_ms"))
    return audit.missing_runs(rows, ["event_type"], "minute_ms", MINUTE_MS)


@query("""SELECT count(*) AS groups, coalesce(max(n), 0) AS largest, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = audit.duplicates(load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])
    zero = F.lit(0).cast("long")
    return groups.agg(F.count("*").alias("groups"), F.coalesce(F.max("n"), zero).alias("largest"), F.coalesce(F.sum("n"), zero).alias("rows"))


@query(f"""WITH {EV} SELECT max(n) AS max_rows, count(*) FILTER (n > 5) AS over_cap, count(*) AS buckets
FROM (SELECT count(*) AS n FROM ev GROUP BY event_type, ms - ms % 3600000)""")
def per_bucket_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.bucket_cap(ticks(spark, sf_dir), ["event_type"], floor_to("ms", HOUR_MS), 5)


@query("""SELECT count(*) AS keys, count(*) FILTER (c_custkey IS NULL) AS orphans FROM (SELECT DISTINCT o_custkey FROM orders)
LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0""")
def orphan_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return audit.orphans(load(spark, sf_dir, "orders"), parents, "o_custkey", "c_custkey", F.col("c_acctbal") > 0)


@query("SELECT c_custkey, c_name FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
def anti_join_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, sf_dir, "customer").select("c_custkey", "c_name").join(orders, "c_custkey", "left_anti")


@query("""WITH l AS (SELECT l_orderkey AS k, count(*) AS n, max(l_linenumber) AS last FROM lineitem GROUP BY 1)
SELECT count(*) AS orders, count(n) AS with_lines, count(*) FILTER (n IS NOT NULL AND n <> last) AS mismatched, count(*) FILTER (n IS NULL) AS without_lines
FROM orders LEFT JOIN l ON o_orderkey = k""")
def count_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose number of lines differs from their last line number."""
    lines = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.max("l_linenumber").alias("last"))
    both = load(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left")
    return both.agg(
        F.count("*").alias("orders"), F.count("n").alias("with_lines"), F.count_if(F.col("n") != F.col("last")).alias("mismatched"),
        F.count_if(F.col("n").isNull()).alias("without_lines"),
    )


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00:00') AS hour, count(*) AS rows, count(DISTINCT user_id) AS users FROM events GROUP BY 1""")
def hourly_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:00:00").alias("hour")
    return load(spark, sf_dir, "events").groupBy(hour).agg(F.count("*").alias("rows"), F.count_distinct("user_id").alias("users"))


@query(f"""WITH {EV}, w AS (SELECT user_id, event_id - lag(event_id) OVER o AS step, ms - lag(ms) OVER o AS back FROM ev WINDOW o AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, count(*) AS rows, count(*) FILTER (step > 1) AS sequence_gaps, CAST(coalesce(sum(step - 1) FILTER (step > 1), 0) AS BIGINT) AS missing_numbers,
count(*) FILTER (step = 0) AS repeats, count(*) FILTER (back < 0) AS clock_regressions FROM w GROUP BY user_id""")
def sequence_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.regressions(ticks(spark, sf_dir), ["user_id"], "event_id", "ms")


@query(f"""WITH {EV} SELECT ms // 60000 AS minute, count(*) AS n, count(DISTINCT event_type) AS kinds FROM ev GROUP BY 1 HAVING count(*) > 1""")
def same_bucket_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    minute = F.call_function("div", F.col("ms"), F.lit(MINUTE_MS)).alias("minute")
    groups = ticks(spark, sf_dir).groupBy(minute).agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"))
    return groups.filter("n > 1")


@query(f"""WITH {EV}, g AS (SELECT event_type, ms - lag(ms) OVER (PARTITION BY event_type ORDER BY ms, event_id) AS gap FROM ev)
SELECT event_type, count(gap) AS n, min(gap) AS min_ms, max(gap) AS max_ms, round(quantile_cont(gap, 0.5), 3) AS p50_ms,
round(quantile_cont(gap, 0.95), 3) AS p95_ms, round(quantile_cont(gap, 0.99), 3) AS p99_ms FROM g GROUP BY event_type""")
def interarrival_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}
    return audit.interarrival(ticks(spark, sf_dir), ["event_type"], ["ms", "event_id"], "ms", shares)


@query(f"""WITH {EV}, raw AS (SELECT event_type, ms - ms % 300000 AS bucket, last(price ORDER BY ms, event_id) AS v FROM ev GROUP BY ALL),
served AS (SELECT event_type, ms - ms % 300000 AS bucket, first(price ORDER BY ms, event_id) AS v FROM ev WHERE event_type <> 'error' GROUP BY ALL)
SELECT count(*) AS keys, count(s.bucket) AS served, count(*) FILTER (s.bucket IS NOT NULL AND raw.v IS DISTINCT FROM s.v) AS mismatched,
count(*) FILTER (s.bucket IS NULL) AS not_served FROM raw LEFT JOIN served s USING (event_type, bucket)""")
def raw_vs_served(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir).withColumn("bucket", floor_to("ms", 300_000))
    served = rows.filter("event_type <> 'error'").groupBy("event_type", "bucket").agg(F.min_by("price", F.struct("ms", "event_id")).alias("price"))
    return audit.raw_vs_served(rows, served, ["event_type", "bucket"], "price", ["ms", "event_id"])


@query(f"""WITH {EV} SELECT user_id, min(ms) AS connected_ms, max(ms) AS disconnected_ms, count(*) AS received, count(*) FILTER (event_type <> 'error') AS accepted,
count(*) FILTER (event_type = 'error') AS errors, CAST(coalesce(sum(k) FILTER (event_type = 'error'), 0) AS BIGINT) AS error_weight, last(event_type ORDER BY event_id) AS close_reason FROM ev GROUP BY user_id""")
def session_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.col("event_type") == "error"
    return ticks(spark, sf_dir).groupBy("user_id").agg(
        F.min("ms").alias("connected_ms"), F.max("ms").alias("disconnected_ms"), F.count("*").alias("received"), F.count_if(~error).alias("accepted"),
        F.count_if(error).alias("errors"), F.coalesce(F.sum(F.when(error, F.col("k"))), F.lit(0).cast("long")).alias("error_weight"),
        F.max_by("event_type", "event_id").alias("close_reason"),
    )


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(" UNION ALL ".join(f"SELECT '{t}' AS dataset, count(*) AS rows, {'CAST(max(event_id) AS VARCHAR)' if t == 'events' else 'CAST(NULL AS VARCHAR)'} AS newest FROM {t}" for t in _TABLES))
def union_dataset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.table_counts({t: load(spark, sf_dir, t) for t in _TABLES}, {"events": "event_id"})


_NOW = RANGE_START + 20 * DAY_MS
_RETENTION, _BUDGET = 15 * DAY_MS, 400


@query(f"""WITH {EV}, p AS (SELECT ms - ms % {PARTITION_MS} AS start_ms, ms - ms % {PARTITION_MS} + {PARTITION_MS} AS end_ms, count(*) AS bytes FROM ev WHERE ms < {_NOW} GROUP BY ALL),
r AS (SELECT *, end_ms <= {_NOW} - {_RETENTION} AS expired FROM p),
s AS (SELECT *, sum(CASE WHEN expired THEN 0 ELSE bytes END) OVER (ORDER BY start_ms DESC ROWS UNBOUNDED PRECEDING) AS newer FROM r)
SELECT start_ms, bytes, CASE WHEN expired THEN 'expired' WHEN end_ms <= {_NOW} - {_NOW} % {PARTITION_MS} AND newer > {_BUDGET} THEN 'over_budget' END AS reason,
expired OR (end_ms <= {_NOW} - {_NOW} % {PARTITION_MS} AND newer > {_BUDGET}) AS drop FROM s""")
def retention_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = floor_to("ms", PARTITION_MS)
    rows = ticks(spark, sf_dir).filter(F.col("ms") < _NOW).groupBy(start.alias("start_ms")).agg(F.count("*").alias("bytes"))
    parts = rows.withColumn("end_ms", F.col("start_ms") + PARTITION_MS)
    planned = plan_retention(parts, _NOW, _RETENTION, _BUDGET, _NOW - _NOW % PARTITION_MS)
    return planned.select("start_ms", "bytes", "reason", "drop")


@query(f"""WITH {EV}, b AS (SELECT event_type, ms - ms % 86400000 AS day_ms, ms - ms % 3600000 AS hour_ms, count(*) AS n FROM ev GROUP BY ALL)
SELECT event_type, day_ms, count(*) AS rows, count(*) FILTER (n >= 3) AS healthy, greatest(0, 24 - count(*)) AS missing FROM b GROUP BY ALL""")
def series_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, hour = floor_to("ms", DAY_MS).alias("day_ms"), floor_to("ms", HOUR_MS).alias("hour_ms")
    bars = ticks(spark, sf_dir).groupBy("event_type", day, hour).agg(F.count("*").alias("n"))
    return audit.availability(bars, ["event_type", "day_ms"], 24, F.col("n") >= 3)


@query(f"""WITH {EV} SELECT event_type, min(price) AS low, max(price) AS high, round(100 * avg(CASE WHEN price > 50 THEN 1 ELSE 0 END), 2) AS over_50_pct,
min(ms) AS first_ms, max(ms) AS last_ms FROM ev GROUP BY 1""", money="low high")
def range_of_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = F.round(100 * F.avg((F.col("price") > 50).cast("int")), 2)
    return ticks(spark, sf_dir).groupBy("event_type").agg(
        F.min("price").alias("low"), F.max("price").alias("high"), over.alias("over_50_pct"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms")
    )


@query("""SELECT (SELECT count(*) FROM orders) AS orders, (SELECT max(event_id) FROM events) AS last_event, (SELECT count(DISTINCT c_nationkey) FROM customer) AS nations,
(SELECT count(*) FROM supplier WHERE s_acctbal < 0) AS in_debt""")
def scalar_subquery_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-row aggregates side by side: each side of the cross joins has exactly one row."""
    parts = [
        load(spark, sf_dir, "orders").agg(F.count("*").alias("orders")),
        load(spark, sf_dir, "events").agg(F.max("event_id").alias("last_event")),
        load(spark, sf_dir, "customer").agg(F.count_distinct("c_nationkey").alias("nations")),
        load(spark, sf_dir, "supplier").agg(F.count_if(F.col("s_acctbal") < 0).alias("in_debt")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(F.broadcast(part))
    return out
