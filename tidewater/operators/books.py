"""Order-book levels and the order-flow imbalance of successive snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.numeric import ratio
from tidewater.operators.scan import Running, scanned

LEVEL = "array<struct<price:decimal(18,8),quantity:decimal(18,8)>>"


def levels(json_pairs: Column, best_first: str, depth: int = 10) -> Column:
    """The ``depth`` best levels of a JSON array of [price, quantity] texts.

    ``best_first`` is bid (prices fall) or ask (prices rise); malformed pairs are left out.
    """
    pairs = F.from_json(json_pairs, "array<array<string>>")
    typed = F.transform(
        pairs,
        lambda x: F.struct(
            F.try_element_at(x, F.lit(1)).try_cast("decimal(18,8)").alias("price"),
            F.try_element_at(x, F.lit(2)).try_cast("decimal(18,8)").alias("quantity"),
        ),
    )
    good = F.filter(typed, lambda x: (x["price"] > 0) & (x["quantity"] >= 0))
    return F.slice(F.sort_array(good, asc=best_first == "ask"), 1, depth)


def quantity_of(side: Column, k: int) -> Column:
    zero = F.lit(0).cast("decimal(28,8)")
    return F.aggregate(F.slice(side, 1, k), zero, lambda s, x: (s + x["quantity"]).cast("decimal(28,8)"))


def level_imbalance(bids: Column, asks: Column, k: int) -> Column:
    """(bids - asks) / (bids + asks) over k levels; null with fewer levels or no size."""
    b, a = quantity_of(bids, k), quantity_of(asks, k)
    enough = (F.size(bids) >= k) & (F.size(asks) >= k)
    return F.when(enough, ratio((b - a).cast("decimal(24,8)"), (b + a).cast("decimal(24,8)")).cast("decimal(20,8)"))


def depth_quote(bids: Column, asks: Column, side: Column, k: int = 10) -> Column:
    """Price times quantity over k levels of ``side``; null unless both sides have k."""
    zero = F.lit(0).cast("decimal(38,8)")
    total = F.aggregate(F.slice(side, 1, k), zero, lambda s, x: (s + x["price"] * x["quantity"]).cast("decimal(38,8)"))
    return F.when((F.size(bids) >= k) & (F.size(asks) >= k), total)


def best_of(side: Column, which: str) -> Column:
    """Best price of an unordered side: the highest bid or the lowest ask above zero."""
    prices = F.filter(F.transform(side, lambda x: x["price"]), lambda p: p > 0)
    return F.array_max(prices) if which == "bid" else F.array_min(prices)


def order_flow(books: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``ofi`` of each snapshot against the one before it of the same key; zero for the first.

    Add the connection epoch to ``by``: a comparison never reaches over a reconnect.
    """
    sides = ("bid", "bid_size", "ask", "ask_size")
    rows = scanned(books, by, order, {"_old": Running("last", F.struct(*sides), False)})
    old = {c: F.col("_old")[c] for c in sides}
    zero = F.lit(0).cast("decimal(18,8)")
    term = lambda when, value: F.when(when, value.cast("decimal(18,8)")).otherwise(zero)
    ofi = (
        term(F.col("bid") >= old["bid"], F.col("bid_size"))
        - term(F.col("bid") <= old["bid"], old["bid_size"])
        - term(F.col("ask") <= old["ask"], F.col("ask_size"))
        + term(F.col("ask") >= old["ask"], old["ask_size"])
    )
    return rows.withColumn("ofi", F.when(old["bid"].isNull(), zero).otherwise(ofi).cast("decimal(20,8)")).drop("_old")


def epochs(events: DataFrame, by: Sequence[str], order: Sequence[str], opens: Column) -> DataFrame:
    """``epoch``: how often the key's connection was opened up to each row."""
    return scanned(events, by, order, {"epoch": Running("sum", opens.cast("int"))})
