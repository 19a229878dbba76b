"""Number columns: guarded ratios, book measures, rounding and rendering.

Money stays decimal. Operands are narrowed before a product or a quotient, since Spark
gives up scale of wide decimals: ``PRICE`` times ``PRICE`` is exact.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRICE = "decimal(18,8)"
STORED_PRICE = "decimal(38,18)"
RATIO = "decimal(20,8)"


def ratio(a: Column, b: Column) -> Column:
    """a / b, null unless b is above zero."""
    return F.when(b > 0, a / b)


def ratio_double(a: Column, b: Column, places: int = 6) -> Column:
    """As ``ratio`` in doubles, rounded: comparable with engines that divide in doubles.

    They round the scaled double, while ``round`` to places goes by its shortest decimal text.
    """
    scale = 10.0**places
    return F.when(b > 0, F.round(a.cast("double") / b.cast("double") * scale) / scale)


def mid(bid: Column, ask: Column) -> Column:
    return (bid + ask) / 2


def spread_bps(bid: Column, ask: Column) -> Column:
    return ratio((ask - bid) * 10_000, mid(bid, ask))


def imbalance(bid_size: Column, ask_size: Column) -> Column:
    return ratio(bid_size - ask_size, bid_size + ask_size)


def microprice(bid: Column, bid_size: Column, ask: Column, ask_size: Column) -> Column:
    return ratio(ask * bid_size + bid * ask_size, bid_size + ask_size)


def weighted_mid_offset_bps(bid: Column, bid_size: Column, ask: Column, ask_size: Column) -> Column:
    """Offset of the size-weighted mid from the mid; zero where there is no size."""
    centre = mid(bid, ask)
    weighted = F.coalesce(microprice(bid, bid_size, ask, ask_size), centre)
    return ratio((weighted - centre) * 10_000, centre)


def basis_bps(a: Column, b: Column) -> Column:
    """(a / b - 1) in hundredths of a percent; null if either is missing or b isn't above zero."""
    return F.when(b > 0, (a / b - 1) * 10_000)


def side_midpoint(bid: Column, ask: Column) -> Column:
    """Middle of two sides, the one there is if the other is missing."""
    return F.when(bid.isNotNull() & ask.isNotNull(), (bid + ask) / 2).otherwise(F.coalesce(bid, ask))


def normalised_share(a: Column, b: Column) -> Column:
    """a / (a + b), null if a part is missing or the sum isn't above zero."""
    return F.when(a.isNotNull() & b.isNotNull() & (a + b > 0), a / (a + b))


def half_up(x: Column, places: int, kind: str = "decimal(38,18)") -> Column:
    """Rounded away from zero at ties, as decimal."""
    return F.round(x.cast(kind), places)


def fixed_text(x: Column, places: int) -> Column:
    """Plain text with exactly ``places`` decimals."""
    return half_up(x, places).cast(f"decimal(38,{places})").cast("string")


def plain_text(x: Column) -> Column:
    """Decimal text without an exponent."""
    return x.cast("string")


def compact_text(x: Column) -> Column:
    """Plain text without trailing zeros of the fraction, and without a bare point."""
    text = x.cast("string")
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def clamped_age(now: Column, then: Column) -> Column:
    """now - then, at least zero; null if either is missing."""
    return F.when(now.isNotNull() & then.isNotNull(), F.greatest(now - then, F.lit(0)))


def countdown_seconds(target: Column, now: Column) -> Column:
    """Whole seconds until ``target``, zero once it has passed; null if either is missing."""
    left = F.floor((target - now) / 1000).cast("long")
    return F.when(target.isNotNull() & now.isNotNull(), F.greatest(left, F.lit(0)))


def retry_delay_seconds(attempt: Column, base: int = 30, most: int = 3600) -> Column:
    """Exponential back-off: base * 2^(attempt - 1), the exponent at most 16, capped."""
    exponent = F.greatest(F.least(attempt - 1, F.lit(16)), F.lit(0))
    return F.least(F.lit(most), (base * F.pow(F.lit(2.0), exponent)).cast("long"))


def size_text(n: Column) -> Column:
    """Byte size with a unit; like the database it stands for, units change at ten times their step."""
    out = F.concat(n.cast("string"), F.lit(" bytes"))
    for power, unit in enumerate(("kB", "MB", "GB", "TB"), 1):
        step = float(1024**power)
        shown = F.concat(F.round(n / step).cast("long").cast("string"), F.lit(f" {unit}"))
        out = F.when(F.abs(n) >= 10 * 1024**power, shown).otherwise(out)
    return out
