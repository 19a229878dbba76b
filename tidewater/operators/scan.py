"""Running values of very long keys, in two passes over segments of their order.

A window over a key holds all its rows in one task. Here a key's rows are cut into segments
by the value of their first order column. The running value of a row is that of its segment
so far, combined with that of all segments before: one row sums up each segment, and only
these rows are ordered within their key. So no task holds more of a key than a segment's
rows or the segments' summaries, and both can be dealt out by key and segment.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Values of the first order column (a sequence number, milliseconds) that one segment spans.
WIDTH = 1 << 16


class Running(NamedTuple):
    """A running ``kind`` (last non-null value, max or sum) of ``value``, with the row itself or only what is before it."""

    kind: str
    value: Column
    itself: bool = True


def segment_of(df: DataFrame, order: Sequence[str], width: int = WIDTH) -> Column:
    """The segment of a row: its first order column by ``width`` for numbers, by hour for timestamps."""
    kind, first = df.schema[order[0]].dataType, F.col(order[0])
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.floor(F.unix_micros(first.cast("timestamp")) / 3_600_000_000)
    if not isinstance(kind, T.NumericType):
        raise TypeError(f"rows can't be cut into segments by {kind.simpleString()}; put a number or a time first")
    return F.floor(first / width)


def scanned(df: DataFrame, by: Sequence[str], order: Sequence[str], values: Mapping[str, Running], width: int = WIDTH) -> DataFrame:
    """``df`` with the running values; a sum or maximum over nothing is null, and null keys are keys.

    ``order`` has to be total within a key, as its rows would otherwise come in any order.
    Rows whose first order column is null come first, in a segment of their own.
    """
    plain = {c: F.col(c) for c in df.columns}
    rows = df.withColumns({"_segment": segment_of(df, order, width), **{f"_v{i}": r.value for i, r in enumerate(values.values())}})
    keys = [*by, "_segment"]
    at = F.struct(*order)
    whole, inside, across = [], {}, {}
    upto = Window.partitionBy(*keys).orderBy(*order)
    before = Window.partitionBy(*by).orderBy(F.asc_nulls_first("_segment")).rowsBetween(Window.unboundedPreceding, -1)
    for i, r in enumerate(values.values()):
        v = F.col(f"_v{i}")
        w = upto.rowsBetween(Window.unboundedPreceding, 0 if r.itself else -1)
        inside[f"_v{i}"] = {"last": F.last(v, ignorenulls=True), "max": F.max(v), "sum": F.sum(v)}[r.kind].over(w)
        whole.append({"last": F.max_by(v, F.when(v.isNotNull(), at)), "max": F.max(v), "sum": F.sum(v)}[r.kind].alias(f"_w{i}"))
        w = F.col(f"_w{i}")
        across[f"_w{i}"] = {"last": F.last(w, ignorenulls=True), "max": F.max(w), "sum": F.sum(w)}[r.kind].over(before)
    ends = rows.groupBy(*keys).agg(*whole).withColumns(across)
    ends = ends.select(*(F.col(c).alias(f"_k{n}") for n, c in enumerate(keys)), *across)
    same = F.lit(True)
    for n, c in enumerate(keys):
        same &= F.col(c).eqNullSafe(F.col(f"_k{n}"))
    met = rows.withColumns(inside).join(ends, same)
    out = {}
    for i, (name, r) in enumerate(values.items()):
        own, far = F.col(f"_v{i}"), F.col(f"_w{i}")
        if r.kind == "last":
            out[name] = F.coalesce(own, far)
        elif r.kind == "max":
            out[name] = F.greatest(own, far)
        else:
            out[name] = F.when(own.isNotNull() | far.isNotNull(), F.coalesce(own, F.lit(0)) + F.coalesce(far, F.lit(0)))
    return met.withColumns(out).select(*(c for c in plain if c not in out), *out)
