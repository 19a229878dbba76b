"""Operators against hand-computed values."""

from __future__ import annotations

import json
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tidewater.functions import clock, numeric, text
from tidewater.operators import bars, books, merge, micro, rules, series, state
from tidewater.sources import messages, tables

T0 = 1_698_125_100_000


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


@pytest.mark.parametrize("ms,market,start", [(T0, T0 // 300_000, T0), (T0 - 1_000, T0 // 300_000 - 1, T0 - 300_000), (-1, -1, -300_000)])
def test_a_boundary_belongs_to_the_new_window(spark, ms, market, start):
    row = spark.range(1).select(*clock.market_columns(F.lit(ms))).first()
    assert tuple(row) == (market, start, start + 300_000)


def test_alignment_is_an_error(spark):
    assert one(spark, clock.require_aligned(F.lit(5_000))) == 5_000
    with pytest.raises(Exception, match="not aligned"):
        one(spark, clock.require_aligned(F.lit(5_001)))


@pytest.mark.parametrize(
    "value,ms",
    [("1698125100", T0), ("1698125100000", T0), ("2023-10-24T05:25:00Z", T0), ("2023-10-24 05:25:17+00", T0 + 17_000), ("2023-10-24T07:25:00+02:00", T0),
     ("2023-10-24T05:25:00", T0), ("2023-10-24T05:25:00.250Z", T0 + 250), ("junk", None), ("", None), (None, None)],
)
def test_epoch_or_iso(spark, value, ms):
    assert one(spark, clock.epoch_or_iso_ms(F.lit(value).cast("string"))) == ms


def test_iso_text(spark):
    assert one(spark, clock.iso_text(F.lit(T0))) == "2023-10-24T05:25:00Z"
    assert one(spark, clock.iso_text(F.lit(T0 + 250))) == "2023-10-24T05:25:00.250000Z"
    assert one(spark, clock.iso_text(F.lit(-1))) == "1969-12-31T23:59:59.999000Z"


def test_rounding_and_rendering(spark):
    price = lambda v, n: one(spark, numeric.fixed_text(F.lit(D(v)), n))
    assert [price("64250.004", 2), price("64247.375", 2), price("0.485", 2), price("-0.125", 2)] == ["64250.00", "64247.38", "0.49", "-0.13"]
    assert [one(spark, numeric.compact_text(F.lit(x))) for x in ("1.500", "100", "2.000", "0.0001")] == ["1.5", "100", "2", "0.0001"]
    assert [one(spark, numeric.retry_delay_seconds(F.lit(n))) for n in (0, 1, 2, 5, 40)] == [30, 30, 60, 480, 3600]
    assert one(spark, numeric.clamped_age(F.lit(5), F.lit(None).cast("int"))) is None
    assert one(spark, numeric.clamped_age(F.lit(5), F.lit(9))) == 0
    assert [one(spark, numeric.size_text(F.lit(n).cast("long"))) for n in (500, 10_239, 10_240, 20_000_000)] == ["500 bytes", "10239 bytes", "10 kB", "19 MB"]


@pytest.mark.parametrize("value,good", [("1.5", True), ("1e5", False), ("nan", False), (" 1", False), ("0.1234567890123456789", False), ("0.1234567890123456780", True), ("-3", True), (".5", True), ("1" * 25, False)])
def test_strict_decimal(spark, value, good):
    assert (one(spark, text.strict_decimal(F.lit(value))) is not None) == good


def test_json_helpers(spark):
    assert one(spark, text.listed(F.lit('["Up", "Down"]'))) == one(spark, text.listed(F.lit("[Up, Down]"))) == ["Up", "Down"]
    assert json.loads(one(spark, text.json_merge(F.lit('{"b":1,"a":2}'), F.lit('{"a":3}')))) == {"a": "3", "b": "1"}
    assert json.loads(one(spark, text.json_merge(F.lit(None).cast("string"), F.lit('{"a":3}')))) == {"a": "3"}


def raw(spark, *docs):
    return spark.createDataFrame([(json.dumps(d), T0 + i, i) for i, d in enumerate(docs)], "value string, received_ms long, sequence long")


TRADE = {"e": "aggTrade", "E": T0 + 125, "a": 10, "s": "BTCUSDT", "p": "100.00", "q": "2.000", "f": 100, "l": 102, "T": T0 + 100, "m": False, "nq": "1.250", "st": 1}


def test_trades_are_parsed_strictly(spark):
    bad = [TRADE | {"s": "ETHUSDT"}, TRADE | {"st": 2}, TRADE | {"p": "0"}, TRADE | {"l": 99}, TRADE | {"nq": "3"}, TRADE | {"m": "x"}, TRADE | {"e": "trade"}, TRADE | {"T": None}]
    good, rejected = messages.aggregate_trades(raw(spark, TRADE, {"stream": "x", "data": TRADE | {"st": "1"}}, *bad), "BTCUSDT")
    rows = good.collect()
    assert len(rows) == 2 and rows[0]["price"] == 100 and rows[0]["normal_quantity"] == D("1.25") and rows[0]["buyer_is_maker"] is False
    reasons = [r["reject_reason"] for r in rejected.orderBy("sequence").collect()]
    assert reasons == ["symbol", "product", "price", "trade_ids", "normal_quantity", "maker", "event_type", "trade_time"]
    lenient, _ = messages.aggregate_trades(raw(spark, TRADE | {"nq": "3"}), "BTCUSDT", strict=False)
    assert lenient.first()["normal_quantity"] is None


def test_books_and_orders_are_parsed(spark):
    ticker = {"e": "bookTicker", "E": T0, "T": T0, "u": 5, "s": "BTCUSDT", "b": "100", "B": "3", "a": "102", "A": "1"}
    good, bad = messages.book_tickers(raw(spark, ticker, ticker | {"a": "99"}), "BTCUSDT")
    assert good.count() == 1 and bad.first()["reject_reason"] == "crossed"
    row = bars.book_measures(good).first()
    assert (row["mid"], row["spread"], row["imbalance"], row["microprice"]) == (101, 2, D("0.5"), D("101.5"))
    assert row["spread_bps"] == D("198.01980198")
    sides = [[str(100 - i), "1"] for i in range(10)], [[str(101 + i), "2"] for i in range(10)]
    deep = {"stream": "btcusdt@depth10", "data": {"s": "BTCUSDT", "E": T0, "bids": sides[0][::-1], "asks": sides[1]}}
    good, bad = messages.depth(raw(spark, deep, {"data": {"s": "BTCUSDT", "E": T0, "bids": sides[0][:9], "asks": sides[1]}}), "BTCUSDT")
    row = good.first()
    assert row["bids"][0]["price"] == 100 and row["asks"][0]["price"] == 101 and bad.first()["reject_reason"] == "levels"
    b, a = F.col("bids"), F.col("asks")
    got = good.select(books.level_imbalance(b, a, 10), books.depth_quote(b, a, b), books.best_of(b, "bid"), books.best_of(a, "ask")).first()
    assert got[0] == D("-0.33333333") and got[1] == D(955) and got[2] == 100 and got[3] == 101
    order = {"e": "forceOrder", "st": 1, "o": {"s": "BTCUSDT", "S": "SELL", "ap": "100.5", "p": "99", "z": "9", "l": "2", "q": "9", "T": T0}}
    buy = {"e": "forceOrder", "st": 1, "o": {"s": "BTCUSDT", "S": "BUY", "ap": "0", "p": "101", "l": "3", "T": T0}}
    good, _ = messages.forced_orders(raw(spark, order, buy), "BTCUSDT")
    row = bars.liquidation_totals(good, ["symbol"]).first()
    assert (row["long_liq_usdt"], row["short_liq_usdt"], row["liq_snapshot_count"]) == (201, 303, 2)


def test_oracle_context_and_history(spark):
    tick = {"topic": "crypto_prices_chainlink", "type": "update", "timestamp": T0, "payload": {"symbol": "btc/usd", "value": 62074.123456789, "timestamp": T0}}
    good, bad = messages.oracle_ticks(raw(spark, tick, tick | {"type": "snapshot"}))
    assert good.first()["price"] == D("62074.123456789") and bad.count() == 1
    poll = {"premium": {"symbol": "BTCUSDT", "markPrice": "62074.88", "indexPrice": "62070.19", "time": T0}, "interest": {"openInterest": "74321.123", "time": T0}}
    row = messages.futures_context(raw(spark, poll), "BTCUSDT")[0].first()
    assert row["open_interest_notional"] == D("62074.88") * D("74321.123")
    assert abs(float(row["premium_bps"]) - (62074.88 / 62070.19 - 1) * 1e4) < 1e-6
    past = [{"symbol": "BTCUSDT", "sumOpenInterest": "5", "sumOpenInterestValue": "6", "timestamp": str(T0)}]
    row = messages.interest_history(raw(spark, past), T0 + 1).first()
    assert (row["source_start_ms"], row["source_end_ms"], row["market_id"]) == (T0 - 300_000, T0, T0 // 300_000)
    assert messages.interest_history(raw(spark, [past[0] | {"timestamp": str(T0 + 1)}]), T0 + 1_000).count() == 0


def test_markets_and_resolutions(spark):
    event = {"id": "e", "markets": [{"id": "m", "slug": "s", "outcomes": '["Up", "Down"]', "clobTokenIds": '["1", "2"]', "active": True, "closed": False, "endDate": "2023-10-24T05:25:00Z"}]}
    row = messages.market_tokens(raw(spark, event)).first()
    assert (row["up_token"], row["down_token"], row["active"], row["end_ms"]) == ("1", "2", True, T0)
    gamma = spark.createDataFrame([(i, json.dumps({"umaResolutionStatus": s, "outcomePrices": p, "closedTime": "2023-10-24 05:25:17+00"})) for i, s, p in
        [(1, "resolved", '["0","1"]'), (2, "resolved", '["0.5","0.5"]'), (3, "proposed", '["1","0"]'), (4, "resolved", '["1","0"]')]], "market_id long, value string")
    clob = spark.createDataFrame([(1, "u", "d", json.dumps({"closed": True, "tokens": [{"token_id": "u", "winner": False}, {"token_id": "d", "winner": True}]})),
        (4, "u", "d", json.dumps({"closed": True, "tokens": [{"token_id": "d", "winner": True}]}))], "market_id long, up_token string, down_token string, value string")
    got = {r["market_id"]: r for r in messages.resolutions(gamma, clob).collect()}
    assert (got[1]["winner"], got[1]["up_payout"], got[1]["down_payout"], got[1]["closed_ms"], got[1]["resolution_source"], got[1]["conflict"]) == ("down", 0, 1, T0 + 17_000, "clob", False)
    assert (got[2]["resolution_type"], got[2]["up_payout"]) == ("split", D("0.5")) and got[3]["resolution_status"] == "pending" and got[4]["conflict"]


def trades(spark, rows):
    """(trade_ms, price, quantity, maker, first, last)"""
    full = [("v", "BTC", ms, D(p), D(q), m, f, l, ms + 25, ms + 50) for ms, p, q, m, f, l in rows]  # noqa: E741
    return spark.createDataFrame(full, "venue string, symbol string, trade_ms long, price decimal(18,8), quantity decimal(18,8), buyer_is_maker boolean, first_id long, last_id long, event_ms long, received_ms long")


def test_flow_bar(spark):
    rows = trades(spark, [(T0 + 100, "100", "2", False, 100, 102), (T0 + 200, "110", "1", True, 103, 103)])
    row = bars.flow_features(bars.flow_bars(rows)).first()
    assert (row["buy_quote"], row["sell_quote"], row["delta_quote"], row["total_quote"]) == (200, 110, 90, 310)
    assert (row["cvd_quote"], row["cvd_10s_quote"], row["agg_trade_count"], row["trade_count"], row["max_trade_quote"]) == (90, 90, 2, 4, 200)
    assert row["taker_imbalance"] == D("0.29032258") and (row["first_trade_id"], row["last_trade_id"]) == (100, 103)


def test_gaps_are_filled_up_to_the_newest_data(spark):
    rows = trades(spark, [(T0 + 100, "100", "1", False, 1, 1), (T0 + 2_100, "50", "1", True, 2, 2)])
    got = bars.flow_features(bars.flow_bars(rows)).orderBy("sample_second_ms").collect()
    assert [r["delta_quote"] for r in got] == [100, 0, -50] and got[-1]["cvd_quote"] == got[-1]["cvd_10s_quote"] == 50
    assert got[1]["max_trade_quote"] is None and got[1]["taker_imbalance"] is None and got[1]["agg_trade_count"] == 0


def test_book_bar_takes_the_later_event_and_then_the_later_arrival(spark):
    rows = [("v", "b", T0 + 5, None, T0, 1, 1, 1, 2, 1), ("v", "b", T0 + 9, None, T0, 2, 3, 1, 4, 1), ("v", "b", T0 + 9, None, T0, 3, 5, 1, 6, 1), ("v", "b", T0 + 99, None, T0, 4, 9, 1, 8, 1)]
    frame = spark.createDataFrame(rows, "venue string, symbol string, event_ms long, transaction_ms long, received_ms long, arrival long, bid int, bid_size int, ask int, ask_size int")
    assert [r["bid"] for r in bars.book_bars(frame).collect()] == [5]


def test_trace(spark):
    ticks = [("c", T0 + 1, 1, 1, 500, 510, 100, 10), ("c", T0 + 25, 2, 2, 480, 515, 105, 10), ("c", T0 + 99, 3, 3, 450, 520, 95, 11), ("c", T0 + 100, 4, 4, 455, 521, 96, 12)]
    frame = spark.createDataFrame(ticks, "connection_id string, received_ms long, monotonic_ns long, sequence long, trade_ms long, event_ms long, price int, trade_id long")
    first, second = bars.trace_bars(frame).orderBy("bucket_start_ms").collect()
    assert (first["open"], first["high"], first["low"], first["close"], first["event_count"]) == (100, 105, 95, 95, 3)
    assert (first["first_trade_ms"], first["last_trade_ms"], first["first_trade_id"], first["last_trade_id"]) == (500, 450, 10, 11)
    assert second["event_count"] == 1
    back = frame.union(spark.createDataFrame([("c", T0 + 50, 9, 9, 1, 1, 1, 1), ("c", T0 + 150, 2, 10, 1, 1, 1, 1)], frame.schema))
    assert {r["sequence"] for r in bars.out_of_sequence(back).collect()} == {9, 10}


def test_asof_and_lags(spark):
    left = spark.createDataFrame([(1, t) for t in (0, 10, 20, 30)] + [(2, 5)], "m int, t long")
    right = spark.createDataFrame([(1, 0, "a", 1), (1, 10, "b", 1), (1, 10, "c", 2), (2, 9, "z", 1)], "m int, t long, v string, seq int")
    got = {(r["m"], r["t"]): (r["v"], r["asof_t"]) for r in series.asof(left, right, ["m"], "t", ["v"], 10, ["seq"]).collect()}
    assert got == {(1, 0): ("a", 0), (1, 10): ("c", 10), (1, 20): ("c", 10), (1, 30): (None, None), (2, 5): (None, None)}
    values = spark.createDataFrame([("s", 0, 5), ("s", 30, 9), ("s", 61, 11)], "k string, t long, v int")
    assert sorted((r["t"], r["d"]) for r in series.lagged(values, ["k"], "t", "v", {"d": 30}).collect()) == [(0, None), (30, 4), (61, None)]
    periods = spark.createDataFrame([("p", 0, 100_000_000), ("q", 99, 100), ("r", 5, 5)], "period string, start_ms long, end_ms long")
    inside = series.in_period(spark.createDataFrame([(99,), (100,), (100_000_000,), (-1,)], "t long"), periods, "t")
    assert sorted((r["t"], r["period"]) for r in inside.collect()) == [(99, "p"), (99, "q"), (100, "p")]


def test_order_flow_restarts_with_a_new_connection(spark):
    rows = [("k", 1, 1, 100, 5, 102, 5), ("k", 1, 2, 101, 7, 102, 4), ("k", 1, 3, 101, 6, 103, 9), ("k", 2, 4, 90, 1, 91, 1)]
    frame = spark.createDataFrame(rows, "k string, epoch int, seq int, bid int, bid_size int, ask int, ask_size int")
    got = [r["ofi"] for r in books.order_flow(frame, ["k", "epoch"], ["seq"]).orderBy("seq").collect()]
    assert got == [0, 7 - 4 + 5, 6 - 7 + 4, 0]


def test_resolved_rows_are_sticky(spark):
    names = "market_id long, resolution_status string, winner string, open_price int, close_price int, last_checked_ms long, next_check_ms long, resolution_attempts int"
    old = spark.createDataFrame([(1, "resolved", "up", None, 5, 10, 99, 3), (2, "pending", None, 1, None, 50, 60, 1), (3, "pending", None, None, None, 5, 6, 0)], names)
    new = spark.createDataFrame([(1, "pending", "down", 4, None, 20, 30, 2), (2, "pending", None, None, None, 40, 45, 9), (4, "pending", None, None, None, 1, 2, 0)], names)
    got = {r["market_id"]: tuple(r)[1:] for r in merge.merge(old, new, ["market_id"], merge.RESOLUTION_RULES).collect()}
    assert got[1] == ("resolved", "up", 4, 5, 20, None, 3)
    assert got[2] == ("pending", None, 1, None, 50, 60, 9)
    assert got[3][4:6] == (5, 6) and got[4][4:6] == (1, 2)
    markets = spark.createDataFrame([(1, False), (2, False)], "market_id long, closed boolean")
    assert {r["market_id"]: r["closed"] for r in merge.closed_by_resolution(markets, old).collect()} == {1: True, 2: False}


def test_upserts_and_guards(spark):
    names = "k string, received_ms long, v string"
    old = spark.createDataFrame([("a", 5, "old"), ("b", 1, "b")], names)
    new = spark.createDataFrame([("a", 4, "late"), ("b", 1, "tie"), ("c", 1, "x"), ("c", 2, "y")], names)
    assert {r["k"]: r["v"] for r in merge.upsert(old, new, ["k"], ["received_ms"]).collect()} == {"a": "late", "b": "tie", "c": "y"}
    guarded = merge.merge(old, new.filter("v <> 'x'"), ["k"], {}, merge.guarded("received_ms"))
    assert {r["k"]: r["v"] for r in guarded.collect()} == {"a": "old", "b": "tie", "c": "y"}


def test_state_helpers(spark):
    sizes = spark.createDataFrame([("g", i, s) for i, s in enumerate([1, 6, 5, 4, 3, 5])], "g string, i int, s int")
    assert [r["paused"] for r in state.paused(sizes, ["g"], ["i"], "s", warn=4, most=6).orderBy("i").collect()] == [False, True, True, True, False, False]
    assert [r["i"] for r in state.newest(sizes, ["g"], ["i"], 2).orderBy("i").collect()] == [4, 5]
    fresh = state.fresh_for(F.lit("c"), F.lit("c"), F.lit(10), F.col("id"), F.lit(5))
    assert [r[0] for r in spark.range(4, 12).select(fresh).collect()] == [False, True, True, True, True, True, True, False]


def test_retention_plan(spark):
    parts = spark.createDataFrame([(i, i + 1, 10) for i in range(8)], "start_ms long, end_ms long, bytes long")
    got = {r["start_ms"]: r["reason"] for r in rules.retention_plan(parts, 8, 6, 35, 7).collect()}
    assert got == {0: "expired", 1: "expired", 2: "over_budget", 3: "over_budget", 4: "over_budget", 5: None, 6: None, 7: None}


def test_validation(spark):
    rows = spark.createDataFrame([(5, 9, 1, 4, 2), (5, 4, 1, 4, 2), (5, 9, 6, 7, 0)], "open int, high int, low int, close int, event_count int")
    good, bad = rules.split(rows, rules.conditions(rules.OHLC_RULES))
    assert good.count() == 1 and sorted(r["reject_reason"] for r in bad.collect()) == ["high_is_highest", "low_is_lowest"]


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(i * 3_600_000, i) for i in range(48)], "ms long, v int")
    tables.append(rows, path, "ms")
    assert sorted(r["v"] for r in tables.read_range(spark, path, "ms", 5 * 3_600_000, 8 * 3_600_000).collect()) == [5, 6, 7]
    parts = tables.partitions(spark, [path, path])
    assert parts.count() == 8 and parts.filter("bytes > 0").count() == 8
    tables.keep_from(spark, path, str(tmp_path / "kept"), 40 * 3_600_000, "ms")
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 8
    tables.export_json(rows.limit(3), str(tmp_path / "x"))
    assert spark.read.json(str(tmp_path / "x")).count() == 3
    assert tables.export_name(7, "BTC", ["flow", "book"]) == "btc-7-book-flow.json.gz"


def test_micro_bar(spark):
    level = "array<struct<price:decimal(18,8),quantity:decimal(18,8)>>"
    side = lambda best, step: [(D(best + step * i), D(1)) for i in range(10)]
    book = lambda ms, seq, b: ("BTC", 1, ms, seq, ms - 50, side(b, -1), side(b + 2, 1))
    books_schema = f"symbol string, epoch int, received_ms long, sequence long, event_ms long, bids {level}, asks {level}"
    spot = spark.createDataFrame([book(T0 + 900, 1, 99), book(T0 + 1_900, 2, 99)], books_schema)
    fut = spark.createDataFrame([book(T0 + 900, 1, 100), book(T0 + 1_500, 2, 100), book(T0 + 1_900, 3, 100)], books_schema)
    trade_schema = "symbol string, received_ms long, sequence long, trade_ms long, price decimal(18,8), quantity decimal(18,8), normal_quantity decimal(18,8), buyer_is_maker boolean, first_id long, last_id long"
    deals = spark.createDataFrame([("BTC", T0 + 800, 1, T0 + 750, D(100), D("1.5"), D(1), True, 1, 3), ("BTC", T0 + 950, 2, T0 + 850, D(102), D("0.5"), D("0.5"), False, 4, 4)], trade_schema)
    orders = spark.createDataFrame([("BTC", "SELL", D("100.5"), D(1), D(2), T0, T0 + 100)], "symbol string, side string, average_price decimal(18,8), order_price decimal(18,8), filled_quantity decimal(18,8), trade_ms long, received_ms long")
    context = spark.createDataFrame([("BTC", T0 + 500, T0 + 400, D(101), D(100), T0 + 450, D("0.0001"), T0 + 60_000, D(10), T0 + 450), ("BTC", T0 + 1_500, T0 + 1_400, D(999), None, None, D("0.0001"), T0 + 60_000, None, None)],
        "symbol string, received_ms long, request_started_ms long, mark_price decimal(18,8), index_price decimal(18,8), premium_index_time_ms long, last_funding_rate decimal(18,8), next_funding_time_ms long, open_interest decimal(18,8), open_interest_time_ms long")
    markers = spark.createDataFrame([("BTC", T0 - 6_000, i, c, "open") for i, c in enumerate(micro.CONNECTIONS)], "symbol string, received_ms long, sequence long, connection string, event string")
    rows = micro.served(micro.micro_bars(spot, fut, deals, deals, orders, context, markers)).orderBy("sample_second_ms").collect()
    assert len(rows[0]) == 3 + 77 == 3 + len(micro.VALUE_COLUMNS)
    first, second = rows[-2:]
    assert (first["spot_mid"], first["fut_mid"], first["fut_sell_usdt"], first["fut_buy_usdt"], first["fut_rpi_sell_usdt"]) == (100, 101, 150, 51, 50)
    assert (first["fut_vwap"], first["fut_trade_lag_max_ms"], first["fut_trade_age_ms"], first["long_liq_usdt"]) == (D("100.5"), 100, 50, 201)
    assert (second["fut_buy_usdt"], second["fut_vwap"], second["fut_trade_age_ms"]) == (0, None, 1_050)
    assert (first["perp_spot_basis_bps"], first["mark_index_basis_bps"], second["mark_price"], second["open_interest_usdt"]) == (100, 100, 101, 1010)
    assert second["collector_healthy"] and not rows[0]["collector_healthy"]
