"""Connected components of a link table, by alternating large-star and small-star steps.

A step only groups links by one end, takes a minimum and joins it back, so a hub with very
many links is pre-aggregated before it moves and its rows may be split over tasks. Each
round is written to the shared folder, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import staged


def _star(links: DataFrame) -> DataFrame:
    """Links (hi, lo), hi > lo, pointed at the least neighbour of each node."""
    both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        links.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = (
        both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
    )
    low = large.groupBy("hi").agg(F.min("lo").alias("m"))
    small = large.join(low, "hi").select(
        F.explode(
            F.array(
                F.struct("hi", F.col("m").alias("lo")),
                F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")),
            )
        ).alias("e")
    )
    return small.select("e.hi", "e.lo").filter("hi > lo").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node with a link, root the least node of its component.

    ``links``: columns a, b of one orderable type; order and repetition don't matter, rows
    with a null or with a = b are ignored. Raises if ``max_rounds`` don't suffice (the
    rounds needed grow with the logarithm of the longest path).
    """
    ends = links.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    now = staged(ends.distinct(), "links")
    mark = F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))
    seen = now.agg(F.count("*"), mark).first()
    for _ in range(max_rounds):
        if not seen[0]:
            break
        now = staged(_star(now), "links")
        then, seen = seen, now.agg(F.count("*"), mark).first()
        if then == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
        now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    )
