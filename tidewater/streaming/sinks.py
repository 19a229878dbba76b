"""Sinks for micro-batches: merged tables, live values before history, partitioned appends."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame

from tidewater.operators.merge import Rule
from tidewater.sources import tables

Sink = Callable[[DataFrame, int], None]


def upserting(path: str, keys: Sequence[str], order: Sequence[str], rules: Mapping[str, Rule] | None = None) -> Sink:
    """Merge each batch into a new version of the table; a batch that runs again replaces its version."""

    def write(batch: DataFrame, epoch: int) -> None:
        tables.merged_version(batch.sparkSession, path, epoch, batch, keys, order, rules)

    return write


def merging(path: str, time: str, keys: Sequence[str], order: Sequence[str], rules: Mapping[str, Rule] | None = None) -> Sink:
    """Merge each batch into a table in six-hour partitions; only partitions with rows in the batch are written again."""

    def write(batch: DataFrame, epoch: int) -> None:
        tables.merge_partitions(batch, path, time, keys, order, rules)

    return write


def appending(path: str, time: str, sort: Sequence[str] = ()) -> Sink:
    """Append each batch as a folder of its own; a batch that runs again replaces its folder."""

    def write(batch: DataFrame, epoch: int) -> None:
        tables.append(batch, f"{path}/epoch={epoch}", time, sort, mode="overwrite")

    return write


def in_turn(*sinks: Sink, staging: str | None = None) -> Sink:
    """Several sinks for one batch, each done before the next begins: live values, then history.

    With ``staging`` the batch is written there first and each sink reads it from there;
    without it each sink evaluates the batch for itself (one of a stateful query can't be
    cached). Staged batches are left for the caller to remove.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        if staging:
            path = f"{staging}/epoch={epoch}"
            batch.write.mode("overwrite").parquet(path)
            batch = batch.sparkSession.read.schema(batch.schema).parquet(path)
        for sink in sinks:
            sink(batch, epoch)

    return write
