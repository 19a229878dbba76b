"""Feed messages: JSON text to typed rows, malformed ones to a reject side with a reason.

``raw`` has a JSON text column ``value`` and any receive columns (received_ms, sequence,
connection_id, ...), which are carried along. Each function works on a batch or a stream;
decimals are read from text, so no number passes through a double.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.clock import epoch_or_iso_ms, source_window_start
from tidewater.functions.text import bool_of, first_path, listed, strict_decimal, strict_integer, unwrapped, zipped
from tidewater.operators.books import levels
from tidewater.operators.rules import split

PRICE = "decimal(18,8)"


def _fields(raw: DataFrame, **paths: str) -> DataFrame:
    """``raw`` with text columns for JSON members of the (unwrapped) message."""
    doc = raw.withColumn("_doc", unwrapped(F.col("value")))
    return doc.withColumns({f"_{name}": F.get_json_object("_doc", path) for name, path in paths.items()})


def _typed(rows: DataFrame, rules: dict[str, Column], columns: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    kept = [c for c in rows.columns if not c.startswith("_") and c != "value"]
    good, bad = split(rows.withColumns(columns), rules)
    return good.select(*kept, *columns), bad.select(*kept, "value", "reject_reason")


def _product_is_perpetual(column: str = "_st") -> Column:
    return F.col(column).isNull() | (F.trim(column) == "1")


def aggregate_trades(raw: DataFrame, symbol: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Aggregate trades. A normal quantity above the quantity rejects the trade, or if not ``strict`` is nulled."""
    rows = _fields(raw, kind="$.e", event="$.E", id="$.a", s="$.s", p="$.p", q="$.q", f="$.f", l="$.l", time="$.T", m="$.m", nq="$.nq", st="$.st")
    quantity, normal = strict_decimal(F.col("_q"), PRICE, "positive"), strict_decimal(F.col("_nq"), PRICE, "non_negative")
    columns = {
        "symbol": F.col("_s"), "agg_trade_id": strict_integer(F.col("_id")), "price": strict_decimal(F.col("_p"), PRICE, "positive"), "quantity": quantity,
        "normal_quantity": F.when(normal <= quantity, normal), "first_id": strict_integer(F.col("_f")), "last_id": strict_integer(F.col("_l")),
        "trade_ms": strict_integer(F.col("_time"), True), "event_ms": strict_integer(F.col("_event"), True), "buyer_is_maker": bool_of(F.col("_m")),
    }
    rules = {
        "event_type": F.col("_kind") == "aggTrade", "symbol": F.col("_s") == symbol, "product": _product_is_perpetual(), "id": F.col("agg_trade_id") >= 0,
        "price": F.col("price").isNotNull(), "quantity": F.col("quantity").isNotNull(), "trade_ids": (F.col("first_id") >= 0) & (F.col("last_id") >= F.col("first_id")),
        "trade_time": F.col("trade_ms").isNotNull(), "maker": F.col("buyer_is_maker").isNotNull(),
        "normal_quantity": F.col("_nq").isNull() | (normal <= quantity) if strict else F.lit(True),
    }
    return _typed(rows, rules, columns)


def book_tickers(raw: DataFrame, symbol: str) -> tuple[DataFrame, DataFrame]:
    """Top of book; a crossed book is rejected, equal sides are not."""
    rows = _fields(raw, event="$.E", time="$.T", u="$.u", s="$.s", bid="$.b", bid_size="$.B", ask="$.a", ask_size="$.A")
    columns = {
        "symbol": F.col("_s"), "update_id": strict_integer(F.col("_u")), "bid": strict_decimal(F.col("_bid"), PRICE, "positive"), "bid_size": strict_decimal(F.col("_bid_size"), PRICE, "non_negative"),
        "ask": strict_decimal(F.col("_ask"), PRICE, "positive"), "ask_size": strict_decimal(F.col("_ask_size"), PRICE, "non_negative"),
        "event_ms": strict_integer(F.col("_event"), True), "transaction_ms": strict_integer(F.col("_time"), True),
    }
    rules = {
        "symbol": F.col("_s") == symbol, "sides": F.col("bid").isNotNull() & F.col("ask").isNotNull(), "sizes": F.col("bid_size").isNotNull() & F.col("ask_size").isNotNull(),
        "crossed": F.col("ask") >= F.col("bid"),
    }
    return _typed(rows, rules, columns)


def depth(raw: DataFrame, symbol: str, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """Depth snapshots of both venues: ``bids``/``asks`` or ``b``/``a``, at least ten levels a side."""
    rows = _fields(raw, s="$.s", event="$.E", time="$.T", bids="$.bids", asks="$.asks", b="$.b", a="$.a", st="$.st")
    stream = F.upper(F.split_part(F.get_json_object("value", "$.stream"), F.lit("@"), F.lit(1)))
    columns = {
        "symbol": F.coalesce(F.col("_s"), stream), "event_ms": strict_integer(F.coalesce("_time", "_event"), True),
        "bids": levels(F.coalesce("_bids", "_b"), "bid", least), "asks": levels(F.coalesce("_asks", "_a"), "ask", least),
    }
    rules = {
        "symbol": F.col("symbol") == symbol, "product": _product_is_perpetual(), "levels": (F.size("bids") >= least) & (F.size("asks") >= least),
        "crossed": F.col("asks")[0]["price"] >= F.col("bids")[0]["price"],
    }
    return _typed(rows, rules, columns)


def forced_orders(raw: DataFrame, symbol: str) -> tuple[DataFrame, DataFrame]:
    rows = _fields(raw, kind="$.e", st="$.st", s="$.o.s", side="$.o.S", ap="$.o.ap", p="$.o.p", l="$.o.l", time="$.o.T")
    number = lambda c: strict_decimal(F.col(c), PRICE, "non_negative")
    columns = {
        "symbol": F.col("_s"), "side": F.upper("_side"), "average_price": number("_ap"), "order_price": number("_p"), "filled_quantity": number("_l"),
        "trade_ms": strict_integer(F.col("_time"), True),
    }
    price = F.when(F.col("average_price") > 0, F.col("average_price")).otherwise(F.col("order_price"))
    rules = {
        "event_type": F.col("_kind") == "forceOrder", "product": _product_is_perpetual(), "symbol": F.col("_s") == symbol, "side": F.col("side").isin("BUY", "SELL"),
        "price": price > 0, "quantity": F.col("filled_quantity") > 0, "time": F.col("trade_ms").isNotNull(),
    }
    return _typed(rows, rules, columns)


def spot_tickers(raw: DataFrame, symbol: str) -> tuple[DataFrame, DataFrame]:
    rows = _fields(raw, s="$.s", c="$.c", event="$.E")
    columns = {"symbol": F.col("_s"), "price": strict_decimal(F.col("_c"), "decimal(38,18)", "positive"), "provider_event_ms": strict_integer(F.col("_event"), True)}
    rules = {"symbol": F.col("_s") == symbol, "price": F.col("price").isNotNull(), "time": F.col("provider_event_ms").isNotNull()}
    return _typed(rows, rules, columns)


def oracle_ticks(raw: DataFrame, topic: str = "crypto_prices_chainlink", symbol: str = "btc/usd") -> tuple[DataFrame, DataFrame]:
    """Oracle updates; the price must be storable as decimal(38,18) without loss."""
    fields = {"topic": "$.topic", "type": "$.type", "timestamp": "$.timestamp", "symbol": "$.payload.symbol", "price": "$.payload.value", "time": "$.payload.timestamp"}
    rows = raw.withColumns({f"_{k}": F.get_json_object("value", p) for k, p in fields.items()})
    columns = {
        "symbol": F.lower("_symbol"), "price": strict_decimal(F.col("_price"), "decimal(38,18)", "positive"),
        "provider_event_ms": strict_integer(F.col("_time"), True), "provider_message_ms": strict_integer(F.col("_timestamp"), True),
    }
    rules = {
        "topic": F.col("_topic") == topic, "type": F.col("_type") == "update", "symbol": F.col("symbol") == symbol, "price": F.col("price").isNotNull(),
        "time": F.col("provider_event_ms").isNotNull(),
    }
    return _typed(rows, rules, columns)


def futures_context(raw: DataFrame, symbol: str) -> tuple[DataFrame, DataFrame]:
    """Premium index and open interest joined on their poll: ``value`` holds {premium, interest}."""
    fields = {
        "s": "$.premium.symbol", "mark": "$.premium.markPrice", "index": "$.premium.indexPrice", "rate": "$.premium.lastFundingRate", "next": "$.premium.nextFundingTime",
        "time": "$.premium.time", "oi": "$.interest.openInterest", "oi_time": "$.interest.time",
    }
    rows = raw.withColumns({f"_{k}": F.get_json_object("value", p) for k, p in fields.items()})
    mark, index = strict_decimal(F.col("_mark"), PRICE, "positive"), strict_decimal(F.col("_index"), PRICE, "positive")
    held = strict_decimal(F.col("_oi"), PRICE, "non_negative")
    columns = {
        "symbol": F.col("_s"), "mark_price": mark, "index_price": index, "last_funding_rate": strict_decimal(F.col("_rate"), PRICE), "next_funding_time_ms": strict_integer(F.col("_next"), True),
        "premium_index_time_ms": strict_integer(F.col("_time"), True), "open_interest": held, "open_interest_time_ms": strict_integer(F.col("_oi_time"), True),
        "open_interest_notional": (held * mark).cast("decimal(38,8)"),
        "premium_bps": F.when(index > 0, (mark / index - 1) * 10_000).cast("decimal(20,8)"),
    }
    return _typed(rows, {"symbol": F.col("_s") == symbol, "anything": F.coalesce("_mark", "_oi").isNotNull()}, columns)


def interest_history(raw: DataFrame, now_ms: int) -> DataFrame:
    """Five-minute open-interest summaries of finished windows, effective in the window after."""
    rows = raw.select("*", F.explode(F.from_json("value", "array<map<string,string>>")).alias("_m"))
    stamp = strict_integer(F.col("_m")["timestamp"], True)
    start = source_window_start(stamp)
    out = rows.select(
        F.col("_m")["symbol"].alias("symbol"), start.alias("source_start_ms"), (start + 300_000).alias("source_end_ms"), F.call_function("div", start + 300_000, F.lit(300_000)).alias("market_id"),
        strict_decimal(F.col("_m")["sumOpenInterest"], PRICE).alias("open_interest"), strict_decimal(F.col("_m")["sumOpenInterestValue"], PRICE).alias("open_interest_value"),
    )
    return out.filter((F.col("source_end_ms") <= now_ms - now_ms % 1000) & F.col("open_interest").isNotNull())


def market_tokens(raw: DataFrame) -> DataFrame:
    """Up and down tokens of each market in an event document, in document order."""
    doc = "array<struct<id:string,slug:string,conditionId:string,question:string,outcomes:string,clobTokenIds:string,active:string,closed:string,endDate:string>>"
    markets = F.coalesce(F.from_json(F.get_json_object("value", "$.markets"), doc), F.from_json(F.concat(F.lit("["), "value", F.lit("]")), doc))
    rows = raw.select("*", F.posexplode(markets).alias("position", "m")).withColumn("p", F.explode(zipped(listed(F.col("m.outcomes")), listed(F.col("m.clobTokenIds")))))
    side = F.lower(F.trim("p.label"))
    kept = [c for c in raw.columns if c != "value"]
    return rows.groupBy(*kept, "position", F.col("m.id").alias("market"), F.col("m.slug").alias("slug"), F.col("m.conditionId").alias("condition_id")).agg(
        F.max(F.when(side.isin("up", "yes"), F.col("p.token"))).alias("up_token"), F.max(F.when(side.isin("down", "no"), F.col("p.token"))).alias("down_token"),
        F.first(bool_of(F.col("m.active"))).alias("active"), F.first(bool_of(F.col("m.closed"))).alias("closed"), F.first(epoch_or_iso_ms(F.col("m.endDate"))).alias("end_ms"),
    )


def resolutions(gamma: DataFrame, clob: DataFrame) -> DataFrame:
    """Outcome of each market from the two sources, by stated results only.

    ``gamma`` (market_id, value): final only if it says resolved and prices are exactly
    1/0, 0/1 or .5/.5. ``clob`` (market_id, up_token, down_token, value): final only if
    closed with one winner among the stored tokens, or by the even flag. Where both are
    final they must agree (``conflict``), and the second is named as source.
    """
    prices = listed(F.get_json_object("value", "$.outcomePrices"))
    up, down = (strict_decimal(F.try_element_at(prices, F.lit(i)), PRICE) for i in (1, 2))
    said = F.lower(F.get_json_object("value", "$.umaResolutionStatus")) == "resolved"
    g = gamma.select(
        "market_id", F.when(said & (up == 1) & (down == 0), "up").when(said & (up == 0) & (down == 1), "down").when(said & (up == 0.5) & (down == 0.5), "split").alias("g"),
        epoch_or_iso_ms(first_path(F.col("value"), "$.closedTime", "$.closed_time")).alias("closed_ms"),
    )
    tokens = F.from_json(F.get_json_object("value", "$.tokens"), "array<struct<token_id:string,winner:string>>")
    winners = F.filter(tokens, lambda t: bool_of(t["winner"]))
    won = F.when(F.size(winners) == 1, winners[0]["token_id"])
    closed, even = bool_of(F.get_json_object("value", "$.closed")), bool_of(F.get_json_object("value", "$.is_50_50_outcome"))
    c = clob.select("market_id", F.when(closed & even, "split").when(closed & (won == F.col("up_token")), "up").when(closed & (won == F.col("down_token")), "down").alias("c"))
    both = g.join(c, "market_id", "full")
    result = F.coalesce("c", "g")
    return both.select(
        "market_id", F.when(result.isNull(), "pending").otherwise("resolved").alias("resolution_status"), F.when(result == "split", "split").when(result.isNotNull(), "winner").alias("resolution_type"),
        F.when(result != "split", result).alias("winner"), F.when(result == "up", 1).when(result == "down", 0).when(result == "split", 0.5).cast("decimal(18,8)").alias("up_payout"),
        F.when(result == "down", 1).when(result == "up", 0).when(result == "split", 0.5).cast("decimal(18,8)").alias("down_payout"), "closed_ms",
        F.when(F.col("c").isNotNull(), "clob").when(F.col("g").isNotNull(), "gamma").alias("resolution_source"), F.coalesce(F.col("c") != F.col("g"), F.lit(False)).alias("conflict"),
    )


def order_book_messages(raw: DataFrame) -> DataFrame:
    """(asset_id, kind, bid, ask) rows of book, best_bid_ask and price_change messages."""
    level = "array<struct<price:string,size:string>>"
    best = lambda side, f: f(F.filter(F.transform(F.from_json(F.get_json_object("value", f"$.{side}"), level), lambda x: strict_decimal(x["price"], PRICE, "non_negative")), lambda p: p.between(0, 1)))
    kept = [c for c in raw.columns if c != "value"]
    kind = F.get_json_object("value", "$.event_type")
    text = lambda path: strict_decimal(F.get_json_object("value", path), PRICE, "non_negative")
    whole = raw.filter(kind.isin("book", "best_bid_ask")).select(
        *kept, F.get_json_object("value", "$.asset_id").alias("asset_id"), kind.alias("kind"),
        F.coalesce(best("bids", F.array_max), text("$.best_bid")).alias("bid"), F.coalesce(best("asks", F.array_min), text("$.best_ask")).alias("ask"),
    )
    change = "array<struct<asset_id:string,best_bid:string,best_ask:string>>"
    each = raw.filter(kind == "price_change").select(*kept, F.explode(F.from_json(F.get_json_object("value", "$.price_changes"), change)).alias("c"))
    number = lambda c: strict_decimal(F.col(c), PRICE, "non_negative")
    patches = each.select(*kept, "c.asset_id", F.lit("price_change").alias("kind"), number("c.best_bid").alias("bid"), number("c.best_ask").alias("ask"))
    return whole.unionByName(patches)
