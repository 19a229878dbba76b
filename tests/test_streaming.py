"""Streams driven to completion over files written batch by batch."""

from __future__ import annotations

import pytest

from tidewater.operators.state import sequence_flags
from tidewater.sources.tables import read_version
from tidewater.streaming import bars, sinks, stateful

TRADES = "symbol string, venue string, sequence long, agg_trade_id long, trade_ms long, price string, quantity string, buyer_is_maker boolean, first_id long, last_id long, received_ms long"


@pytest.fixture
def drive(spark, tmp_path):
    """Run ``plan`` over batches, one micro-batch each, and give the rows of all of them."""

    def run(batches, schema, plan, mode="append", timed=0):
        source, name = str(tmp_path / "in"), f"out_{abs(hash(str(tmp_path)))}"
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{source}/{i}")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{source}/*")
        out = []
        query = plan(stream).writeStream.outputMode(mode).foreachBatch(lambda df, i: out.extend(df.collect()))
        query = query.option("checkpointLocation", str(tmp_path / name))
        if timed:  # a query with processing-time timeouts never runs out of batches
            query = query.start()
            for _ in range(60):
                query.awaitTermination(1)
                if len(out) >= timed:
                    break
            query.stop()
        else:
            query.trigger(availableNow=True).start().awaitTermination(120)
        return out

    return run


def trade(sequence, id, ms, price="100", quantity="1", maker=False):
    return ("BTC", "fut", sequence, id, ms, price, quantity, maker, id, id, ms)


def test_flow_windows_close_by_watermark_and_drop_late_trades(drive):
    first = [trade(1, 1, 100), trade(2, 2, 900, maker=True), trade(3, 3, 2_600)]
    rows = drive([first, [trade(4, 4, 9_000)], [trade(5, 5, 200), trade(6, 6, 9_100)]], TRADES, bars.flow_stream)
    got = {r["sample_second_ms"]: (float(r["buy_quote"]), float(r["sell_quote"]), r["agg_trade_count"]) for r in rows}
    assert got == {0: (100.0, 100.0, 2), 2_000: (100.0, 0.0, 1)}


def test_flags_match_the_batch_form(spark, drive):
    ids = [(1, 10, 5), (2, 10, 5), (3, 12, 6), (4, 11, 7), (5, 15, 4), (6, 13, 9), (7, 20, 9)]
    rows = [trade(s, i, ms) for s, i, ms in ids]
    streamed = {r["sequence"]: (r["duplicate"], r["regression"], r["missing"]) for r in drive([rows[:3], rows[3:]], TRADES, stateful.flagged_trades)}
    assert streamed == {1: (False, False, 0), 2: (True, False, 0), 3: (False, False, 1), 4: (False, True, 0), 5: (False, True, 0), 6: (False, False, 0), 7: (False, False, 6)}
    plain = sequence_flags(spark.createDataFrame(rows[:4], TRADES), ["symbol"], ["sequence"], "agg_trade_id", "trade_ms")
    assert {r["sequence"]: (r["duplicate"], r["regression"], r["missing"]) for r in plain.collect()} == {k: streamed[k] for k in (1, 2, 3, 4)}


def test_gaps_are_filled_across_batches(drive):
    schema = "symbol string, sample_second_ms long, buy_quote double, sell_quote double"
    rows = drive([[("BTC", 0, 100.0, 0.0)], [("BTC", 2_000, 0.0, 50.0), ("BTC", 0, 9.0, 9.0)]], schema, stateful.gap_filled)
    got = [(r["sample_second_ms"], r["delta_quote"], r["cvd_quote"], r["cvd_10s_quote"]) for r in rows]
    assert got == [(0, 100.0, 100.0, 100.0), (1_000, 0.0, 100.0, 100.0), (2_000, -50.0, 50.0, 50.0)]


def test_settled_ticks_give_the_newest_version(drive):
    schema = "symbol string, second_ms long, sequence long, price string, received_ms long"
    batches = [[("b", 1_000, 1, "1.0", 1_100), ("b", 1_000, 2, "1.1", 1_200)], [("b", 2_000, 3, "2.0", 2_100)], [("b", 2_000, 4, "2.5", 2_200), ("b", 3_000, 5, "3.0", 9_000)]]
    rows = drive(batches, schema, stateful.settled_ticks, timed=2)
    assert [(r["second_ms"], r["price"]) for r in rows][:2] == [(1_000, "1.1"), (2_000, "2.5")]


def test_top_of_book(drive):
    schema = "asset_id string, sequence long, kind string, bid double, ask double"
    batches = [[("u", 1, "book", 0.4, 0.6), ("u", 2, "price_change", None, 0.55)], [("u", 3, "best_bid_ask", 0.5, None), ("u", 4, "noise", 0.1, 0.1), ("u", 5, "market_resolved", None, None), ("u", 6, "book", 0.1, 0.2)]]
    rows = drive(batches, schema, stateful.top_of_book)
    assert [(r["sequence"], r["best_bid"], r["best_ask"]) for r in rows] == [(1, 0.4, 0.6), (2, 0.4, 0.55), (3, 0.5, None)]


def test_top_of_book_keeps_decimals(drive):
    from decimal import Decimal as D

    schema = "asset_id string, sequence long, kind string, bid decimal(18,8), ask decimal(18,8)"
    rows = drive([[("u", 1, "book", D("0.1"), D("0.3"))], [("u", 2, "price_change", None, D("0.29"))]], schema, stateful.top_of_book)
    assert [(r["best_bid"], r["best_ask"]) for r in rows] == [(D("0.1"), D("0.3")), (D("0.1"), D("0.29"))]


def test_late_bars_are_counted(drive):
    schema = "symbol string, sample_second_ms long, buy_quote double, sell_quote double"
    rows = drive([[("BTC", 5_000, 1.0, 0.0)], [("BTC", 0, 9.0, 9.0), ("BTC", 1_000, 9.0, 9.0)], [("BTC", 7_000, 0.0, 1.0)]], schema, stateful.gap_filled)
    assert [(r["sample_second_ms"], r["late"]) for r in rows] == [(5_000, 0), (6_000, 2), (7_000, 0)]


def test_traces_and_books(drive):
    schema = "connection_id string, received_ms long, monotonic_ns long, sequence long, price double, trade_id long"
    rows = drive([[("c", 1, 1, 1, 100.0, 10), ("c", 25, 2, 2, 105.0, 11), ("c", 99, 3, 3, 95.0, 12)], [("c", 100, 4, 4, 96.0, 13)], [("c", 900, 5, 5, 97.0, 14)]], schema, bars.trace_stream)
    assert tuple(rows[0])[1:] == (0, 100.0, 105.0, 95.0, 95.0, 3, 10, 12)


def test_newest_in_update_mode_and_merged_versions(spark, tmp_path):
    schema = "key string, received_ms long, value string"
    source = str(tmp_path / "in")
    for i, rows in enumerate([[("a", 1, "x"), ("b", 1, "y")], [("a", 2, "z"), ("a", 1, "old")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{source}/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{source}/*")
    seen = []
    table = str(tmp_path / "table")
    sink = sinks.in_turn(lambda df, i: seen.append({r["key"]: r["value"] for r in df.collect()}), sinks.upserting(table, ["key"], ["received_ms"]))
    query = bars.newest_stream(stream, ["key"], ["received_ms"]).writeStream.outputMode("update").foreachBatch(sink)
    query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert {r["key"]: r["value"] for r in read_version(spark, table, len(seen) - 1).collect()} == {"a": "z", "b": "y"}
