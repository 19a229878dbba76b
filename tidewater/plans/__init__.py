"""Named queries over the driver's tables, each with the SQL that checks it."""

from __future__ import annotations

from tidewater.plans import audit, codecs, market, measures, merges, parsing, registry, series


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
