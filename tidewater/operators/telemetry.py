"""Folds of summary lines, growth of stored bytes, loss markers, market hand-over and catch-up."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.clock import HOUR_MS, MARKET_MS, floor_to, whole
from tidewater.functions.numeric import retry_delay_seconds, size_text
from tidewater.operators.merge import RESOLUTION_RULES, due, merge
from tidewater.operators.scan import Running, scanned


def fold(rows: DataFrame, by: Sequence[str], order: Sequence[str], most: Sequence[str] = (), least: Sequence[str] = (), mean: Sequence[str] = (), last: Sequence[str] = ()) -> DataFrame:
    """One row per key: how many summaries, and the greatest, least, mean and final values of fields.

    Missing values count in no fold but the final one, which is that of the last row.
    """
    final = F.max_by(F.struct(*last), F.struct(*order)) if last else F.lit(None)
    out = rows.groupBy(*by).agg(
        F.count("*").alias("summaries"),
        *(F.max(c).alias(f"max_{c}") for c in most),
        *(F.min(c).alias(f"min_{c}") for c in least),
        *(F.round(F.avg(c), 3).alias(f"mean_{c}") for c in mean),
        final.alias("_final"),
    )
    return out.select("*", *(F.col("_final")[c].alias(f"final_{c}") for c in last)).drop("_final")


def bytes_per_hour(rows: DataFrame, sizes: DataFrame, time: str, step_ms: int, n_bytes: str = "bytes") -> DataFrame:
    """One row: rows, observed_hours, bytes, their size as text, and bytes an hour (null without rows).

    ``sizes`` has a size in ``n_bytes`` for each partition or file; both sides of the join
    are one row.
    """
    span = rows.agg(F.count("*").alias("rows"), F.min(time).alias("_first"), F.max(time).alias("_last"))
    held = sizes.agg(F.coalesce(F.sum(n_bytes), F.lit(0)).cast("long").alias("bytes"))
    hours = (F.col("_last") - F.col("_first") + step_ms) / HOUR_MS
    rate = F.when(F.col("rows") > 0, F.round(F.col("bytes") / F.greatest(hours, F.lit(0.001))).cast("long"))
    both = span.crossJoin(F.broadcast(held))
    return both.select("rows", F.round(hours, 3).alias("observed_hours"), "bytes", size_text(F.col("bytes")).alias("size"), rate.alias("bytes_per_hour"))


def with_loss_markers(offers: DataFrame, by: Sequence[str], order: str, accepted: str, time: str, kind: str) -> DataFrame:
    """Accepted events, and one ``error`` row before the first accepted one after each loss.

    A marker carries the time of the first event lost in its run. A run of losses that no
    accepted event follows has no marker yet. ``position`` orders a key's rows.
    """
    rows = scanned(offers, by, [order], {"_run": Running("sum", F.col(accepted).cast("long"), False)}).na.fill(0, ["_run"])
    lost = rows.filter(~F.col(accepted)).groupBy(*by, "_run").agg(F.min_by(time, order).alias("_lost"))
    kept = rows.filter(accepted).join(lost, [*by, "_run"], "left")
    own = F.struct((F.col(order) * 2 + 1).alias("position"), F.col(kind).alias("kind"), F.col(time).alias(time))
    mark = F.when(F.col("_lost").isNotNull(), F.struct((F.col(order) * 2).alias("position"), F.lit("error").alias("kind"), F.col("_lost").alias(time)))
    return kept.select(*by, F.inline(F.filter(F.array(mark, own), lambda x: x.isNotNull())))


def open_markets(df: DataFrame, time: str, lead_ms: int = 45_000, linger_ms: int = 30_000) -> DataFrame:
    """``df`` with a row for each market that is open at its time: from ``lead_ms`` before its start to ``linger_ms`` after its end.

    Windows follow a rule, so the interval join needs no table of windows. ``phase`` is
    early, live or late.
    """
    first = whole(floor_to(F.col(time) - linger_ms, MARKET_MS), MARKET_MS)
    last = whole(floor_to(F.col(time) + lead_ms, MARKET_MS), MARKET_MS)
    rows = df.withColumn("market_id", F.explode(F.sequence(first, last)))
    start = F.col("market_id") * MARKET_MS
    phase = F.when(F.col(time) < start, "early").when(F.col(time) < start + MARKET_MS, "live").otherwise("late")
    return rows.withColumn("phase", phase)


def finalised(wakes: DataFrame, by: Sequence[str], time: str, step_ms: int = 1_000, delay_ms: int = 250) -> DataFrame:
    """A row for every boundary that a key's wake-up finalises, those missed since the last one too.

    A boundary b is due at b + ``delay_ms``; ``jitter_ms`` is how much later it was done.
    The first wake-up of a key only sets its clock. Only the first wake-up after a boundary
    finalises it, so wake-ups are reduced to one a boundary before they are ordered.
    """
    done = floor_to(F.col(time) - delay_ms, step_ms).alias("_done")
    first = wakes.groupBy(*by, done).agg(F.min(time).alias("finalised_ms"))
    w = Window.partitionBy(*by).orderBy("_done")
    rows = first.withColumn("_before", F.lag("_done").over(w)).filter("_before is not null")
    each = F.explode(F.sequence(F.col("_before") + step_ms, F.col("_done"), F.lit(step_ms).cast("long"))).alias("boundary_ms")
    jitter = F.col("finalised_ms") - F.col("boundary_ms") - delay_ms
    return rows.select(*by, "finalised_ms", "_done", each).select(
        *by, "boundary_ms", "finalised_ms", jitter.alias("jitter_ms"), (F.col("boundary_ms") < F.col("_done")).alias("caught_up")
    )


def reconciled(markets: DataFrame, resolutions: DataFrame, fetched: DataFrame, now_ms: int, limit: int) -> DataFrame:
    """``resolutions`` after one round of work: due markets are merged with what was fetched, or put off.

    ``fetched`` has rows (of the columns of ``resolutions``) for the markets that answered.
    One that is due and did not answer, or not in full, is tried again after a delay that
    doubles with its attempts.
    """
    work = due(markets, resolutions, now_ms, limit).select("market_id")
    tried = work.join(resolutions.select("market_id", "resolution_attempts"), "market_id", "left")
    tried = tried.withColumn("_attempt", (F.coalesce("resolution_attempts", F.lit(0)) + 1).cast("long"))
    answers = tried.select("market_id", "_attempt").join(fetched.drop("resolution_attempts", "last_checked_ms", "next_check_ms"), "market_id", "left")
    delay = retry_delay_seconds(F.col("_attempt")).cast("long") * 1000
    news = answers.withColumns(
        {
            "resolution_status": F.coalesce("resolution_status", F.lit("pending")),
            "resolution_attempts": F.col("_attempt"),
            "last_checked_ms": F.lit(now_ms).cast("long"),
            "next_check_ms": F.lit(now_ms).cast("long") + delay,
        }
    )
    return merge(resolutions, news.select(*resolutions.columns), ["market_id"], {c: r for c, r in RESOLUTION_RULES.items() if c in resolutions.columns})


def best_asks(prices: Column, tokens: Mapping[str, Column]) -> list[Column]:
    """Best ask of each token from a price answer {token: {"SELL": price}}; null unless it lies in [0, 1]."""
    found = F.from_json(prices, "map<string,map<string,string>>")
    out = []
    for name, token in tokens.items():
        price = F.try_element_at(F.try_element_at(found, token), F.lit("SELL"))
        number = F.when(price.rlike(r"^[0-9]*\.?[0-9]+$"), price.try_cast("decimal(38,18)"))
        out.append(F.when(number.between(0, 1), number).alias(name))
    return out
