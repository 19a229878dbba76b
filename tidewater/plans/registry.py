"""Where plan modules put their queries: name, function of (spark, sf_dir), checking SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.clock import epoch_ms

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Events in their market roles, for the checking SQL.
EV = """ev AS (
  SELECT event_id, epoch_us(ts) // 1000 AS ms, user_id, event_type, CAST(value AS DECIMAL(18,2)) AS price,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, props FROM events
)"""


def query(sql: str | None = None, money: str = "", name: str | None = None):
    """Register the decorated function under its name, with its checking SQL.

    ``money`` names decimal columns that are given out as doubles, as engines differ in the
    precision that their decimals end up with.
    """
    names = money.split()

    def put(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in names})

        key = name or f.__name__
        QUERIES[key] = run
        if sql is not None:
            casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in names)
            ORACLES[key] = f"SELECT * REPLACE ({casts}) FROM ({sql})" if names else sql
        return f

    return put


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """``events`` in market roles: source event_type, time ms, price, quantity k, connection user_id.

    With bounds only the events of [start, end): the stored clock itself is compared, so
    that the scan skips what lies outside.
    """
    rows = load(spark, sf_dir, "events")
    for bound, sign in ((start_ms, ">="), (end_ms, "<")):
        if bound is not None:
            stamp = datetime.fromtimestamp(bound / 1000, timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")
            rows = rows.filter(f"ts {sign} TIMESTAMP_NTZ'{stamp}'")
    return rows.select(
        "event_id",
        epoch_ms("ts").alias("ms"),
        "user_id",
        "event_type",
        F.col("value").cast("decimal(18,2)").alias("price"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        "props",
    )
