"""Keyed merges: a target table, newer rows, and one rule per column.

Plain Parquet tables take no MERGE. ``merge`` is a full outer join on the keys; every rule
is evaluated against the old row in one projection. Callers write the result beside the
target and swap, or use it inside ``foreachBatch``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.state import latest

#: A rule gives a column's merged value from the old and the new row (structs).
Rule = Callable[[Column, Column, str], Column]


def replace(old: Column, new: Column, c: str) -> Column:
    return new[c]


def keep_first(old: Column, new: Column, c: str) -> Column:
    return old[c]


def prefer_new(old: Column, new: Column, c: str) -> Column:
    return F.coalesce(new[c], old[c])


def prefer_old(old: Column, new: Column, c: str) -> Column:
    return F.coalesce(old[c], new[c])


def greatest(old: Column, new: Column, c: str) -> Column:
    return F.greatest(old[c], new[c])


def sticky(status: str, final: str) -> Rule:
    """The old value once ``status`` is ``final`` in the old row."""
    return lambda old, new, c: F.when(old[status] == final, old[c]).otherwise(new[c])


def guarded(clock: str) -> Rule:
    """The new value unless the old row's clock is later."""
    return lambda old, new, c: F.when(old[clock] > new[clock], old[c]).otherwise(new[c])


def next_check(status: str = "resolution_status", opened: str = "open_price", closed: str = "close_price", checked: str = "last_checked_ms") -> Rule:
    """When a resolution is looked at next: never once complete, unmoved by older checks."""

    def rule(old: Column, new: Column, c: str) -> Column:
        done = (F.coalesce(old[status] == "resolved", F.lit(False)) | F.coalesce(new[status] == "resolved", F.lit(False)))
        done &= F.coalesce(new[opened], old[opened]).isNotNull() & F.coalesce(new[closed], old[closed]).isNotNull()
        later = F.when(new[c].isNotNull(), F.greatest(new[c], old[checked], new[checked]))
        return F.when(done, None).when(new[checked] < old[checked], old[c]).otherwise(later)

    return rule


def merge(target: DataFrame, source: DataFrame, keys: Sequence[str], rules: Mapping[str, Rule], default: Rule = replace) -> DataFrame:
    """Target with ``source`` (one row per key) merged in; columns without a rule use ``default``."""
    t = target.select(*keys, F.struct(*target.columns).alias("_old"))
    s = source.select(*keys, F.struct(*target.columns).alias("_new"))
    both = t.join(s, list(keys), "full")
    old, new = F.col("_old"), F.col("_new")
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.col(c))
            continue
        merged = rules.get(c, default)(old, new, c)
        out.append(F.when(new.isNull(), old[c]).when(old.isNull(), new[c]).otherwise(merged).alias(c))
    return both.select(*out)


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last write wins; among source rows of one key the last in ``order`` counts."""
    return merge(target, latest(source, keys, order), keys, {})


def insert_absent(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target and the source rows whose key it lacks (one of each)."""
    fresh = source.dropDuplicates(list(keys)).join(target, list(keys), "left_anti")
    return target.unionByName(fresh.select(*target.columns))


RESOLUTION_RULES: dict[str, Rule] = {
    **{c: sticky("resolution_status", "resolved") for c in (
        "resolution_status", "resolution_type", "winner", "winning_token_id", "up_payout", "down_payout",
        "resolved_at_ms", "resolution_source",
    )},
    **{c: prefer_new for c in ("open_price", "close_price", "price_source")},
    **{c: greatest for c in ("last_checked_ms", "resolution_attempts")},
    "next_check_ms": next_check(),
}

SESSION_RULES: dict[str, Rule] = {
    **{c: prefer_old for c in ("connected_ms", "ready_ms", "disconnected_ms", "close_reason")},
    **{c: greatest for c in ("received", "accepted", "errors", "last_sequence", "dropped")},
}

MARKET_RULES: dict[str, Rule] = {"first_seen_ms": keep_first}


def closed_by_resolution(markets: DataFrame, resolutions: DataFrame, key: str = "market_id") -> DataFrame:
    """Markets with ``closed`` set where their resolution is final."""
    done = resolutions.filter("resolution_status = 'resolved'").select(key, F.lit(True).alias("_done")).distinct()
    joined = markets.join(done, key, "left")
    return joined.withColumn("closed", F.coalesce("_done", "closed")).drop("_done").select(*markets.columns)


def due(markets: DataFrame, resolutions: DataFrame, now_ms: int, limit: int) -> DataFrame:
    """Ended markets whose resolution is incomplete and due, oldest check first."""
    known = resolutions.select("market_id", "resolution_status", "open_price", "close_price", "next_check_ms")
    rows = markets.filter(F.col("window_end_ms") <= now_ms).join(known, "market_id", "left")
    complete = F.expr("resolution_status = 'resolved' and open_price is not null and close_price is not null")
    rows = rows.filter(~F.coalesce(complete, F.lit(False)) & (F.coalesce("next_check_ms", F.lit(0)) <= now_ms))
    return rows.orderBy(F.coalesce("next_check_ms", F.lit(0)).asc(), F.col("window_end_ms").desc()).limit(limit)
