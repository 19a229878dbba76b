"""Parquet tables in six-hour partitions, merged versions, exports and file listings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.clock import PARTITION_MS, floor_to
from tidewater.operators.merge import Rule, merge
from tidewater.operators.state import latest

PART = "part_start_ms"


def append(df: DataFrame, path: str, time: str, sort: Sequence[str] = (), mode: str = "append", spread: int = 8) -> None:
    """Append rows under their six-hour partition, sorted within files for row-group skipping.

    A partition is written by ``spread`` tasks, so that the newest one isn't a single task's work.
    """
    salt = F.pmod(F.xxhash64(*sort, time), F.lit(spread))
    rows = df.withColumn(PART, floor_to(time, PARTITION_MS)).repartition(PART, salt)
    rows.sortWithinPartitions(PART, *sort, time).write.mode(mode).partitionBy(PART).parquet(path)


def read_range(spark: SparkSession, path: str, time: str, start_ms: int, end_ms: int) -> DataFrame:
    """Rows of [start, end): the partition filter prunes directories, the time filter row groups."""
    low, high = start_ms - start_ms % PARTITION_MS, end_ms - end_ms % PARTITION_MS
    rows = spark.read.parquet(path).filter(F.col(PART).between(low, high))
    return rows.filter((F.col(time) >= start_ms) & (F.col(time) < end_ms))


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, part_start_ms) of a table's data files; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    part = F.regexp_extract("path", rf"/{PART}=([0-9]+)/", 1).try_cast("bigint")
    return found.select("path", F.col("length").alias("bytes"), part.alias(PART))


def partitions(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(start_ms, end_ms, bytes) of the partitions of several tables, bytes added up by start."""
    every = None
    for path in paths:
        one = files(spark, path)
        every = one if every is None else every.unionByName(one)
    sums = every.filter(F.col(PART).isNotNull()).groupBy(F.col(PART).alias("start_ms")).agg(F.sum("bytes").alias("bytes"))
    return sums.select("start_ms", (F.col("start_ms") + PARTITION_MS).alias("end_ms"), "bytes")


def keep_from(spark: SparkSession, path: str, out: str, cutoff_ms: int, time: str) -> None:
    """The table without rows older than the cutoff, written beside it."""
    low = cutoff_ms - cutoff_ms % PARTITION_MS
    rows = spark.read.parquet(path).filter((F.col(PART) >= low) & (F.col(time) >= cutoff_ms))
    rows.write.mode("overwrite").partitionBy(PART).parquet(out)


def write_version(df: DataFrame, path: str, version: int) -> None:
    """One whole version of a merged table. Writing it again, as after a failure, replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/version={version}")


def read_version(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version}")


def merged_version(
    spark: SparkSession, path: str, version: int, rows: DataFrame, keys: Sequence[str], order: Sequence[str], rules: Mapping[str, Rule] | None = None
) -> None:
    """Version ``version``: the one before it with the newest of ``rows`` per key merged in."""
    newest = latest(rows, keys, order)
    target = read_version(spark, path, version - 1) if version else newest.limit(0)
    write_version(merge(target, newest.select(*target.columns), keys, rules or {}), path, version)


def merge_partitions(rows: DataFrame, path: str, time: str, keys: Sequence[str], order: Sequence[str], rules: Mapping[str, Rule] | None = None, spread: int = 8) -> None:
    """Merge the newest of ``rows`` per key into a table in six-hour partitions of ``time``, a column of the key.

    Only partitions that ``rows`` touch are read and written again, by Spark's own dynamic
    overwrite; as each holds six hours, what a batch costs follows from its rows' times and
    not from the table. A partition is written by ``spread`` tasks. The merged partitions are
    written beside the table first, since what is read can't be overwritten. A batch that
    fails and runs again merges the same rows once more, which changes nothing for rules
    that keep the newest.
    """
    if time not in keys:
        raise ValueError(f"{time} has to be part of the key")
    spark = rows.sparkSession
    newest = latest(rows, keys, order)
    part = floor_to(time, PARTITION_MS)
    touched = [r[0] for r in newest.select(part.alias(PART)).distinct().collect()]  # one number for every six hours of a batch
    try:
        target = spark.read.parquet(path).filter(F.col(PART).isin(touched)).drop(PART)
    except AnalysisException:  # nothing written yet
        target = newest.limit(0)
    merged = merge(target, newest.select(*target.columns), keys, rules or {}).withColumn(PART, part)
    beside = f"{path.rstrip('/')}.merging"
    salt = F.pmod(F.xxhash64(*keys), F.lit(spread))
    merged.repartition(PART, salt).write.mode("overwrite").partitionBy(PART).parquet(beside)
    done = spark.read.schema(merged.schema).parquet(beside)
    done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)


def latest_values(df: DataFrame, key: str, keys: Sequence[str] | None = None, order: Sequence[str] = ("received_ms",)) -> DataFrame:
    """Newest row per key, for the given keys; a live value table."""
    rows = df if keys is None else df.filter(F.col(key).isin(*keys))
    return latest(rows, [key], order)


def export_name(market_id: int, symbol: str, layers: Sequence[str], suffix: str = "json.gz") -> str:
    return "-".join([symbol.lower(), str(market_id), *sorted(layers)]) + f".{suffix}"


def export_json(df: DataFrame, path: str) -> None:
    """One JSON object per line, gzip-compressed, decimals as plain text."""
    texts = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    texts.write.mode("overwrite").option("compression", "gzip").text(path)


def listed(spark: SparkSession, values: Sequence, name: str, kind: str = "string") -> DataFrame:
    """A parameter list as a relation of one column, in no order; repeated values stay."""
    one = spark.range(1).select(F.array(*(F.lit(v).cast(kind) for v in values)).cast(f"array<{kind}>").alias("_values"))
    return one.select(F.explode("_values").alias(name))


def log_rows(spark: SparkSession, path: str, event: str, schema: str) -> DataFrame:
    """Structured log lines of one event kind; other lines are passed over."""
    lines = spark.read.text(path).filter(F.get_json_object("value", "$.event") == event)
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")
