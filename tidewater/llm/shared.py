"""Helpers that the corpus operators share: staged tables and byte views of Arrow text."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ``bytes.translate`` table that lower-cases A-Z and leaves every other byte alone.
ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

#: Bytes of text that one numpy step works on; bounds the scratch arrays of a task, which stay in a core's cache.
CHUNK_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only in local mode where the session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidewater-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage: a later stage that loses an executor rereads the files instead of
    recomputing what led to them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _STAGED.append((path, ""))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(docs: DataFrame) -> Column:
    """A hash over all columns of a row; columns with maps by their JSON text."""
    plain = []
    for f in docs.schema:
        if not isinstance(f.dataType, T.NullType):
            plain.append(F.to_json(F.struct(f"`{f.name}`")) if "map" in f.dataType.simpleString() else F.col(f"`{f.name}`"))
    return F.xxhash64(*plain)


#: Ids that one broadcast may hold (about 30 MB in a task's memory).
BROADCAST_IDS = 500_000
#: What the session has staged: folders, and tables over them.
_STAGED: list[tuple[str, str]] = []


def release(spark: SparkSession) -> None:
    """Remove what the operators have staged so far; for when their results are used up."""
    while _STAGED:
        path, name = _STAGED.pop()
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def rows_with(docs: DataFrame, rows: DataFrame, most: int = BROADCAST_IDS, without: bool = False) -> DataFrame:
    """Rows of ``docs`` that are among ``rows`` (doc_id, row_key); null ids match null.

    With ``without`` the others. ``rows`` should be staged, as they are counted: up to
    ``most`` are broadcast, so that no text moves; more meet ``docs`` by a shuffle.
    """
    wanted = rows.select("doc_id", "row_key").toDF("_wanted_id", "_wanted_key")
    if wanted.limit(most + 1).count() <= most:
        wanted = F.broadcast(wanted)
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_all"), row_key(docs).alias("_key"))
    same = (F.col("_key") == F.col("_wanted_key")) & F.col("_all.doc_id").cast("long").eqNullSafe(F.col("_wanted_id"))
    return named.join(wanted, same, "left_anti" if without else "left_semi").select("_all.*")


#: Text bytes of one bucket of texts that are written bucketed.
BUCKET_BYTES = 64 << 20


def bucket_count(docs: DataFrame) -> int:
    """Buckets for the texts of ``docs``: by their bytes, at least the shuffle partitions."""
    n_bytes = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // BUCKET_BYTES))


def bucketed(df: DataFrame, name: str, key: str, buckets: int, sort: str | None = None) -> DataFrame:
    """``df``, dealt out by ``key`` already, written to the shared folder as a table bucketed by it.

    Joins and groupings by ``key`` then read it without moving it. Rows that aren't dealt
    out by ``key`` would give a file for each task and bucket.
    """
    spark = df.sparkSession
    name = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    _STAGED.append((path, name))
    writer = df.write.format("parquet").option("compression", "zstd").bucketBy(buckets, key)
    (writer.sortBy(sort) if sort else writer).option("path", path).saveAsTable(name)
    return spark.table(name)


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def co_located(spark: SparkSession) -> AbstractContextManager[None]:
    """While a plan is made and run in here, a join by several columns may use a bucketing by one of them."""
    return _setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false")


#: Rows with whole texts that go to a Python worker at once: Spark holds a batch several times over, in its own memory and in the worker's.
TEXT_ROWS = 1_000


def small_batches(spark: SparkSession) -> AbstractContextManager[None]:
    """While a plan is run in here, Python workers get ``TEXT_ROWS`` rows at once."""
    return _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))


def utf8_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column, null counted as empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def text_chunks(
    batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut record batches into pieces of about ``limit`` text bytes; one row is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, ends = utf8_view(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


#: Tasks whose blocks one task adds up.
GROUP = 256
BLOCK_SCHEMA = "block int, task int, total binary"


def block_batch(blocks: list[np.ndarray], task: int) -> pa.RecordBatch:
    """One task's arrays as rows for ``sum_blocks``; blocks of zeros are left out."""
    some = [k for k, x in enumerate(blocks) if x.any()]
    columns = [
        pa.array(some, pa.int32()),
        pa.array([task] * len(some), pa.int32()),
        pa.array([pa.compress(blocks[k].astype("<f8").tobytes(), "zstd", asbytes=True) for k in some], pa.binary()),
    ]
    return pa.record_batch(columns, names=["block", "task", "total"])


def sum_blocks(parts: DataFrame, size: int) -> dict[int, np.ndarray]:
    """Sums by block of the arrays of ``size`` numbers that tasks gave out (``BLOCK_SCHEMA``).

    Tasks are added up in groups of ``GROUP`` first, so that none reads a block of every
    task, and in the order of their numbers, so that sums repeat. The number and size of
    the blocks must not depend on the data: the sums are collected.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, np.zeros(0)

        def given() -> pa.RecordBatch:
            total = pa.compress(held.tobytes(), "zstd", asbytes=True)
            return pa.record_batch([pa.array([x], t) for x, t in zip((*key, total), (pa.int32(), pa.int32(), pa.binary()))], names=["block", "task", "total"])

        for batch in batches:
            for block, group, total in zip(*(batch.column(c).to_pylist() for c in ("block", "group", "total"))):
                if (block, group) != key:
                    if key:
                        yield given()
                    key, held = (block, group), np.zeros(size)
                held = held + np.frombuffer(pa.decompress(total, size * 8, "zstd"), "<f8")
        if key:
            yield given()

    for group in (F.floor(F.col("task") / GROUP).cast("int"), F.lit(0)):
        dealt = parts.withColumn("group", group).repartition("block", "group").sortWithinPartitions("block", "group", "task")
        parts = dealt.mapInArrow(add, BLOCK_SCHEMA)
    return {r["block"]: np.frombuffer(pa.decompress(r["total"], size * 8, "zstd"), "<f8") for r in parts.collect()}
