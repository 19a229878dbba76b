"""Clock columns. Integer epoch milliseconds are the source of truth everywhere.

Nothing here depends on the session's time zone: timestamps without zone are read as UTC.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND_MS, MINUTE_MS, MARKET_MS, HOUR_MS, DAY_MS = 1_000, 60_000, 300_000, 3_600_000, 86_400_000
PARTITION_MS = 6 * HOUR_MS


def epoch_us(ts: str) -> Column:
    """Microseconds since the epoch of a timestamp column without time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def epoch_ms(ts: str) -> Column:
    us = epoch_us(ts)
    return whole(us - F.pmod(us, F.lit(1000)), 1000)


def whole(a: Column, b: Column | int) -> Column:
    """Integer quotient of longs (towards zero); floor ``a`` first where it may be negative."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def floor_to(ms: Column | str, width: int) -> Column:
    """Start of the ``width`` bucket that holds ``ms``; floors, also below zero."""
    ms = F.col(ms) if isinstance(ms, str) else ms
    return ms - F.pmod(ms, F.lit(width))


def bucket_id(ms: Column | str, width: int = MARKET_MS) -> Column:
    return whole(floor_to(ms, width), width)


def market_columns(ms: Column | str) -> list[Column]:
    """market_id and the half-open five-minute window [start, end) that holds ``ms``."""
    start = floor_to(ms, MARKET_MS)
    return [
        bucket_id(ms).alias("market_id"),
        start.alias("window_start_ms"),
        (start + MARKET_MS).alias("window_end_ms"),
    ]


def aligned(ms: Column | str, width: int = SECOND_MS) -> Column:
    return F.pmod(F.col(ms) if isinstance(ms, str) else ms, F.lit(width)) == 0


def require_aligned(ms: Column | str, width: int = SECOND_MS) -> Column:
    """``ms``, or an error that stops the query where it isn't a whole bucket start."""
    ms = F.col(ms) if isinstance(ms, str) else ms
    return F.when(aligned(ms, width), ms).otherwise(F.raise_error(F.concat(ms.cast("string"), F.lit(" is not aligned"))))


def timestamp_of(ms: Column | str) -> Column:
    return F.timestamp_millis(F.col(ms) if isinstance(ms, str) else ms)


def iso_text(ms: Column | str) -> Column:
    """ISO text in UTC ending in Z; a fraction only where it isn't zero (as six digits)."""
    ms = F.col(ms) if isinstance(ms, str) else ms
    second = floor_to(ms, SECOND_MS)
    days = whole(floor_to(ms, DAY_MS), DAY_MS).cast("int")
    inside = whole(F.pmod(ms, F.lit(DAY_MS)), 1000)
    part = lambda unit, of: F.lpad((whole(inside, unit) % of).cast("string"), 2, "0")
    date = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM-dd")
    clock = F.concat_ws(":", part(3600, 24), part(60, 60), part(1, 60))
    fraction = F.when(ms == second, "").otherwise(F.concat(F.lit("."), F.lpad((ms - second).cast("string"), 3, "0"), F.lit("000")))
    return F.concat(date, F.lit("T"), clock, fraction, F.lit("Z"))


def epoch_or_iso_ms(text: Column | str) -> Column:
    """Milliseconds from whole-number text (seconds below 10^11) or ISO text; null otherwise.

    ISO text may end in Z or a +00 style offset; text without a zone is UTC.
    """
    text = F.trim(F.col(text) if isinstance(text, str) else text)
    number = F.when(text.rlike("^[0-9]{1,18}$"), F.try_to_number(text, F.lit("9" * 18)).cast("long"))
    from_number = F.when(number < 100_000_000_000, number * 1000).otherwise(number)
    full = F.regexp_replace(F.regexp_replace(text, r"[zZ]$", "+00:00"), r"([+-]\d{2})(\d{2})?$", r"$1:00")
    full = F.when(text.rlike(r"[+-]\d{2}:\d{2}$"), text).otherwise(full)
    full = F.when(full.rlike(r"\d[+-]\d{2}:\d{2}$") & full.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), full).otherwise(F.concat(text, F.lit("+00:00")))
    valid = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?([zZ]|[+-]\d{2}(:?\d{2})?)?$")
    iso = F.when(valid, F.unix_millis(F.try_to_timestamp(full)))
    return F.coalesce(from_number, iso)


def source_window_start(ms: Column | str) -> Column:
    """Start of the window that a summary stamped ``ms`` covers: an aligned stamp closes the one before."""
    ms = F.col(ms) if isinstance(ms, str) else ms
    return F.when(F.pmod(ms, F.lit(MARKET_MS)) == 0, ms - MARKET_MS).otherwise(floor_to(ms, MARKET_MS))


def closed_by(window_end: Column, now_ms: Column) -> Column:
    """True for windows that ended by the last full window before ``now_ms``."""
    return window_end <= floor_to(now_ms, MARKET_MS)
