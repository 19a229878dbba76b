"""Per-key state over streams, by ``applyInPandasWithState``.

State is a few numbers per key (a connection, a venue and symbol, a token), so it stays
small whatever the stream's rate. Rows of a key arrive in micro-batches in any order and
are sorted by their receive sequence first.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

NONE = GroupStateTimeout.NoTimeout


def _batch(frames: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values(order, kind="stable")


def flagged_trades(trades: DataFrame, key: str = "symbol") -> DataFrame:
    """Trades with duplicate, regression and missing, against the last accepted trade of the key.

    ``trades``: key, sequence, agg_trade_id, trade_ms.
    """

    def run(group: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_id, last_ms = state.get if state.exists else (-1, -1)
        out = []
        for r in _batch(frames, ["sequence"]).itertuples():
            duplicate = last_id >= 0 and r.agg_trade_id == last_id
            regression = not duplicate and (r.agg_trade_id < last_id or r.trade_ms < last_ms)
            missing = 0
            if not duplicate and not regression:
                missing = max(0, r.agg_trade_id - last_id - 1) if last_id >= 0 else 0
                last_id, last_ms = r.agg_trade_id, r.trade_ms
            out.append((group[0], r.sequence, r.agg_trade_id, r.trade_ms, duplicate, regression, missing))
        state.update((int(last_id), int(last_ms)))
        yield pd.DataFrame(out, columns=[key, "sequence", "agg_trade_id", "trade_ms", "duplicate", "regression", "missing"])

    schema = f"{key} string, sequence long, agg_trade_id long, trade_ms long, duplicate boolean, regression boolean, missing long"
    return trades.select(key, "sequence", "agg_trade_id", "trade_ms").groupBy(key).applyInPandasWithState(run, schema, "last_id long, last_ms long", "append", NONE)


def gap_filled(bars: DataFrame, key: str = "symbol", step_ms: int = 1_000, windows: tuple[int, int] = (10, 30)) -> DataFrame:
    """Flow bars with zero bars for silent seconds, cumulative delta and rolling sums.

    ``bars``: key, sample_second_ms, buy_quote, sell_quote, each second once and in order
    over micro-batches. One that comes after its second has been given out is in no sum; the
    next bar tells in ``late`` how many there were. State: the last second, the cumulative
    delta, the deltas of the longest window and that number. Money is decimal with eight places.
    """
    longest = max(windows)
    names = [key, "sample_second_ms", "buy_quote", "sell_quote", "delta_quote", "cvd_quote", *(f"cvd_{w}s_quote" for w in windows), "late"]

    def run(group: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        zero = Decimal("0.00000000")
        last, cvd, recent, late = state.get if state.exists else (-1, zero, [], 0)
        recent, out = list(recent), []
        for r in _batch(frames, ["sample_second_ms"]).itertuples():
            if last >= 0 and r.sample_second_ms <= last:
                late += 1
                continue
            second = last + step_ms if last >= 0 else r.sample_second_ms
            while second <= r.sample_second_ms:
                buy, sell = (r.buy_quote, r.sell_quote) if second == r.sample_second_ms else (zero, zero)
                cvd += buy - sell
                recent = [*recent, buy - sell][-longest:]
                out.append((group[0], second, buy, sell, buy - sell, cvd, *(sum(recent[-w:], zero) for w in windows), late))
                second, late = second + step_ms, 0
                if len(out) == 10_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            last = r.sample_second_ms
        state.update((int(last), cvd, recent, int(late)))
        yield pd.DataFrame(out, columns=names)

    money = "decimal(38,8)"
    sums = ", ".join(f"cvd_{w}s_quote {money}" for w in windows)
    schema = f"{key} string, sample_second_ms long, buy_quote {money}, sell_quote {money}, delta_quote {money}, cvd_quote {money}, {sums}, late long"
    rows = bars.selectExpr(key, "sample_second_ms", f"cast(buy_quote as {money}) buy_quote", f"cast(sell_quote as {money}) sell_quote")
    return rows.groupBy(key).applyInPandasWithState(run, schema, f"last long, cvd {money}, recent array<{money}>, late long", "append", NONE)


def settled_ticks(ticks: DataFrame, key: str = "symbol", settle_ms: int = 1_000) -> DataFrame:
    """Newest version of each provider second once a newer second is pending or it has settled.

    ``ticks``: key, second_ms, sequence, price (text), received_ms. Seconds before the newest
    are given out at once, so only the newest one waits and none is ever given up.
    """

    def run(group: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seconds, sequences, prices, received = (list(x) for x in state.get) if state.exists else ([], [], [], [])
        pending = dict(zip(seconds, zip(sequences, prices, received)))
        now = 0
        for frame in [] if state.hasTimedOut else frames:
            for r in frame.itertuples():
                now = max(now, r.received_ms)
                if r.second_ms not in pending or pending[r.second_ms][0] < r.sequence:
                    pending[r.second_ms] = (int(r.sequence), r.price, int(r.received_ms))
        if state.hasTimedOut:
            now = state.getCurrentProcessingTimeMs()
        newest, out = max(pending, default=0), []
        for second in sorted(pending):
            sequence, price, at = pending[second]
            if second < newest or now - at >= settle_ms or state.hasTimedOut:
                out.append((group[0], second, sequence, price, at))
                del pending[second]
        if pending:
            rest = sorted(pending)
            state.update((rest, [pending[s][0] for s in rest], [pending[s][1] for s in rest], [pending[s][2] for s in rest]))
            state.setTimeoutDuration(settle_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[key, "second_ms", "sequence", "price", "received_ms"])

    schema = f"{key} string, second_ms long, sequence long, price string, received_ms long"
    held = "seconds array<long>, sequences array<long>, prices array<string>, received array<long>"
    return ticks.select(key, "second_ms", "sequence", "price", "received_ms").groupBy(key).applyInPandasWithState(
        run, schema, held, "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def top_of_book(messages: DataFrame, key: str = "asset_id") -> DataFrame:
    """Best bid and ask of a token after each message; a resolved market gives out no more.

    ``messages``: key, sequence, kind, bid, ask (null, or numbers of any type, which they keep).
    """

    def run(group: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bid, ask, resolved = state.get if state.exists else (None, None, False)
        out = []
        for r in _batch(frames, ["sequence"]).itertuples():
            given = [None if pd.isna(x) else x for x in (r.bid, r.ask)]
            if r.kind == "market_resolved":
                resolved = True
            elif r.kind in ("book", "best_bid_ask"):
                bid, ask = given
            elif r.kind == "price_change":
                bid, ask = (new if new is not None else old for new, old in zip(given, (bid, ask)))
            else:
                continue
            if not resolved:
                out.append((group[0], r.sequence, bid, ask))
        state.update((bid, ask, resolved))
        yield pd.DataFrame(out, columns=[key, "sequence", "best_bid", "best_ask"])

    bid, ask = (messages.schema[c].dataType.simpleString() for c in ("bid", "ask"))
    schema = f"{key} string, sequence long, best_bid {bid}, best_ask {ask}"
    rows = messages.select(key, "sequence", "kind", "bid", "ask")
    return rows.groupBy(key).applyInPandasWithState(run, schema, f"bid {bid}, ask {ask}, resolved boolean", "append", NONE)
