"""Live microstructure bars: a replay in shuffled micro-batches equals the batch form."""

from __future__ import annotations

import random
from decimal import Decimal as D

from tidewater.operators import micro
from tidewater.streaming import live, microbars

T0 = 1_709_251_200_000
SIDE = "array<struct<price decimal(18,8), quantity decimal(18,8)>>"
BOOK = f"symbol string, epoch long, received_ms long, sequence long, event_ms long, bids {SIDE}, asks {SIDE}"
TRADE = "symbol string, received_ms long, sequence long, trade_ms long, price decimal(18,8), quantity decimal(18,8), normal_quantity decimal(18,8), buyer_is_maker boolean, first_id long, last_id long"
SCHEMAS = {
    "spot_book": BOOK,
    "fut_book": BOOK,
    "spot_trade": TRADE,
    "fut_trade": TRADE,
    "liquidation": "symbol string, side string, average_price decimal(18,8), order_price decimal(18,8), filled_quantity decimal(18,8), trade_ms long, received_ms long",
    "context": "symbol string, received_ms long, request_started_ms long, mark_price decimal(18,8), index_price decimal(18,8), premium_index_time_ms long, last_funding_rate decimal(18,8), next_funding_time_ms long, open_interest decimal(18,8), open_interest_time_ms long",
    "marker": "symbol string, received_ms long, sequence long, connection string, event string",
}


def generated(rng):
    """Rows of two symbols over 14 s with silent seconds, one-sided books, reconnects and missing values."""
    out = {name: [] for name in SCHEMAS}
    times = iter(rng.sample(range(14_000), 400))  # no two rows of one time
    num = lambda low, high: D(rng.randrange(low, high)) / 100
    for i in range(30):
        s, none = rng.choice("ab"), rng.random() < 0.2
        for p in ("spot", "fut"):
            t = T0 + next(times) // 4_000 * 4_000 + rng.randrange(2_000)  # seconds 2 and 3 of every four have no books
            price = num(9_900, 10_100)
            levels = [[(price + (-k - 1 if side == "b" else k + 1), num(10, 500)) for k in range(11)] for side in "ba"]
            out[f"{p}_book"].append((s, (t - T0) // 5_000, t, i, t - 30, levels[0] if not none else [], levels[1]))
            t = T0 + next(times)
            q = num(10, 300)
            out[f"{p}_trade"].append((s, t, i, t - rng.randrange(200), num(9_900, 10_100), q, None if none else q / 2, rng.random() < 0.5, 3 * i, 3 * i + 2))
        t = T0 + next(times)
        out["liquidation"].append((s, rng.choice(["BUY", "SELL"]), D(0) if none else num(9_900, 10_100), D(100), num(10, 90), t - 40, t))
        t = T0 + next(times)
        interest = (None, None) if rng.random() < 0.4 else (num(1_000, 2_000), t - 100)
        out["context"].append((s, t, t - 90, num(9_900, 10_100), None if none else num(9_900, 10_100), t - 20, D("0.0001"), T0 + 3_600_000, *interest))
        t = T0 + next(times)
        out["marker"].append((s, t, i, rng.choice(micro.CONNECTIONS), rng.choice(["open", "open", "close"])))
    return out


def by_second(rows):
    return {(r["symbol"], r["sample_second_ms"]): r for r in rows}


def test_stream_equals_batch(spark, tmp_path):
    live.with_rocksdb(spark)
    rng = random.Random(29)
    rows = generated(rng)
    frames = {name: spark.createDataFrame(r, SCHEMAS[name]) for name, r in rows.items()}
    order = ("spot_book", "fut_book", "spot_trade", "fut_trade", "liquidation", "context", "marker")
    want = by_second(r.asDict(True) for r in micro.served(micro.micro_bars(*(frames[n] for n in order))).collect())
    far = ("far", "BUY", D(1), D(1), D(1), T0 + 500_000, T0 + 500_000)  # brings the newest time on
    streams = {}
    for name, own in rows.items():
        own = rng.sample(own, len(own))
        for i in range(3):
            more = [far] if name == "liquidation" and i == 2 else []
            spark.createDataFrame(own[i::3] + more, SCHEMAS[name]).coalesce(1).write.parquet(f"{tmp_path}/{name}/{i}")
        streams[name] = spark.readStream.schema(SCHEMAS[name]).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/*")
    out = []
    sink = microbars.micro_batches(microbars.schemas(frames), lambda bars, batch: out.extend(r.asDict(True) for r in bars.collect()))
    writer = microbars.second_stream(streams, delay_ms=20_000).writeStream.foreachBatch(sink)
    writer.option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination(180)
    got = by_second(r for r in out if r["symbol"] != "far")
    assert len(got) == len([r for r in out if r["symbol"] != "far"]) and got.keys() == want.keys() and len(want) > 20
    assert {r["collector_healthy"] for r in want.values()} <= {True, False} and any(r["spot_snapshot_bbo_ofi_usdt"] for r in want.values())
    for key, bar in want.items():
        assert got[key] == bar, {c: (got[key][c], bar[c]) for c in bar if got[key][c] != bar[c]}
