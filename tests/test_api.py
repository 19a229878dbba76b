"""The served queries over small market tables."""

from __future__ import annotations

from decimal import Decimal as D

import pytest

from tidewater.plans import api

M = 5_660_417
T0 = M * 300_000


@pytest.fixture(scope="module")
def t(spark):
    make = spark.createDataFrame
    price = "instrument_id long, market_id long, sample_second_ms long, price decimal(38,18), provider_event_ms long, received_ms long"
    samples = [(1, M, T0, D("64250.004"), T0 - 300, T0 + 650), (1, M, T0 + 1_000, D("64251"), None, T0 + 1_600), (2, M, T0, D("64247.375"), T0 - 250, T0 - 200), (1, M - 1, T0 - 1_000, D(5), None, T0), (3, M - 2, T0 - 600_000, D(7), None, T0)]
    snapshot = "symbol string, market_id long, sample_second_ms long, last_price decimal(18,8), mark_price decimal(18,8), index_price decimal(18,8), premium_bps decimal(20,8), open_interest decimal(18,8), open_interest_notional decimal(38,8)"
    shot = lambda s, oi: ("BTC", s // 300_000, s, D(1), D(2), D(3), D(4), D(oi), D(5))
    return {
        "providers": make([(1, "binance"), (2, "chainlink")], "provider_id long, provider string"),
        "instruments": make([(1, 1, "BTCUSDT", "USDT"), (2, 2, "BTCUSD", "USD"), (3, 1, "ETHUSDT", "USDT")], "instrument_id long, provider_id long, symbol string, quote_asset string"),
        "windows": make([(m, m * 300_000, m * 300_000 + 300_000) for m in range(M - 4, M + 2)], "market_id long, window_start_ms long, window_end_ms long"),
        "price_samples": make(samples, price),
        "snapshots": make([shot(T0, 100), shot(T0 + 30_000, 103), shot(T0 - 300_000, 90), shot(T0 - 30_000, 98)], snapshot),
        "flow": make([(M, T0, D(9), D(9), None)], "market_id long, sample_second_ms long, delta_quote decimal(38,8), cvd_quote decimal(38,8), taker_imbalance decimal(20,8)"),
        "book": make([(M - 3, T0 - 900_000, D(1), D(2), D("1.5"), D(1))], "market_id long, sample_second_ms long, bid decimal(18,8), ask decimal(18,8), mid decimal(18,8), spread_bps decimal(20,8)"),
        "probabilities": make([(M, T0, D("0.485"), D("0.5")), (M - 4, T0 - 1_200_000, D(1), None)], "market_id long, sample_second_ms long, up_ask decimal(18,8), down_ask decimal(18,8)"),
        "micro": make([("BTC", M, T0, True, 5), ("BTC", M, T0 + 1_000, False, 6)], "symbol string, market_id long, sample_second_ms long, collector_healthy boolean, spot_mid int"),
        "live": make([("spot", "1.5", T0), ("spot", "1.6", T0 + 5)], "source string, value string, received_ms long"),
        "resolutions": make([(1, "pending"), (3, "resolved")], "market_id long, resolution_status string"),
    }


def test_latest(spark, t):
    assert api.health_probe(spark).first()["ok"] == 1
    assert api.latest_price(t, "binance", "BTCUSDT").first()["sample_second_ms"] == T0 + 1_000
    assert api.latest_price(t, "binance", "nothing").count() == 0
    assert api.latest_market(t).first()["market_id"] == M
    assert api.instrument_id(t, "chainlink", "BTCUSD").first()[0] == 2
    with pytest.raises(Exception, match="no instrument"):
        api.instrument_id(t, "chainlink", "x").collect()
    assert [r["market_id"] for r in api.latest_resolutions(t, 1).collect()] == [3]


def test_index_pages(t):
    now = T0 + 10_000
    first = api.market_index(t, now, 2).collect()
    assert [r["market_id"] for r in first] == [M - 1, M - 2] and {r["next_cursor"] for r in first} == {M - 2}
    last = api.market_index(t, now, 2, before=M - 2).collect()
    assert [(r["market_id"], r["book_rows"], r["next_cursor"]) for r in last] == [(M - 3, 1, None)]
    current = api.market_index(t, now, 1, include_current=True).first()
    assert (current["market_id"], current["price_samples_rows"], current["snapshots_rows"], current["probabilities_rows"]) == (M, 3, 2, 1)


def test_summary_and_sources(t):
    row = api.market_summary(t, M, "binance", "BTCUSDT").first()
    assert (row["open"], row["close"], row["n"]) == (D("64250.004"), 64251, 2)
    rows = api.market_sources(t, M, [("chainlink", "BTCUSD"), ("binance", "BTCUSDT")]).collect()
    assert [r["provider"] for r in rows] == ["chainlink", "binance"] and rows[1]["newest"]["received_ms"] == T0 + 1_600


def test_series(t):
    rows = api.series_items(api.market_series(t, M, carry_ms=2_000)).collect()
    assert len(rows) == 300 and [r["t"] for r in rows[:2]] == [0, 1]
    first, second, third, fourth = rows[:4]
    assert (first["prices"]["spot"], first["prices"]["oracle"]) == ("64250.00", "64247.38")
    assert (first["freshness"]["spot_age_ms"], first["freshness"]["oracle_lag_ms"], first["freshness"]["oracle_carried_forward"]) == (350, 50, False)
    assert second["freshness"]["oracle_carried_forward"] and second["freshness"]["oracle_source_age_ms"] == 2_250
    assert third["prices"]["oracle"] == "64247.38" and fourth["prices"]["oracle"] is None
    assert first["probabilities"]["up_ask"] == "0.49" and first["flow"]["delta_quote"] == "9" and first["book"]["bid"] is None
    assert (first["open_interest"]["delta_30s"], first["open_interest"]["delta_60s"], first["open_interest"]["delta_300s"]) == ("2.000", None, "10.000")
    assert rows[30]["open_interest"]["delta_30s"] == "3.000"
    plain = api.market_series(t, M, layers=())
    assert "flow_delta_quote" not in plain.columns and plain.filter("oracle_price is not null").count() == 1


def test_microstructure_and_live(t):
    series = api.with_microstructure(api.market_series(t, M, layers=()), t, M, ["spot_mid", "collector_healthy"])
    assert series.filter("microstructure is not null").count() == 2
    assert tuple(api.microstructure_availability(t, M).first()) == (2, 1, 298)
    got = {r["source"]: (r["value"], r["age_ms"]) for r in api.live_prices(t, ["spot", "oracle"], T0 + 105).collect()}
    assert got == {"spot": ("1.6", 100), "oracle": (None, None)}
    assert tuple(api.live_microstructure(t, T0).select("market_id", "age_ms").first()) == (M, 0)
    row = api.current_snapshot(t, T0, ("binance", "BTCUSDT"), ("chainlink", "none")).first()
    assert row["spot"]["price"] == 64251 and row["oracle"] is None and row["futures"]["sample_second_ms"] == T0 + 30_000


def test_latest_reads_the_newest_partitions_first(spark, t, tmp_path):
    from tidewater.sources import tables

    six, path = 21_600_000, str(tmp_path / "samples")
    schema = t["price_samples"].schema
    rows = [(i, M, T0 - six * k, D(k), None, T0 - six * k + i) for k in range(12) for i in (1, 2) if i == 1 or k >= 7]
    tables.append(spark.createDataFrame(rows, schema), path, "sample_second_ms")
    own = {**t, "price_samples": spark.read.parquet(path)}
    assert api.latest_price(own, "binance", "BTCUSDT").first()["sample_second_ms"] == T0
    assert api.latest_price(own, "chainlink", "BTCUSD").first()["sample_second_ms"] == T0 - six * 7
    assert api.latest_price(own, "binance", "ETHUSDT").count() == 0
    plan = api.latest_price(own, "binance", "BTCUSDT")._jdf.queryExecution().executedPlan().toString()
    newest = T0 - T0 % six
    assert f">= {newest}" in plan[plan.index("PartitionFilters") :]
    assert api.latest_market(own).first()["market_id"] == M


def partition_filters(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [part.split("]")[0] for part in plan.split("PartitionFilters: ")[1:]]


def test_index_reads_the_newest_partitions_first(spark, t, tmp_path):
    """Pages of a long history with holes equal those of the same tables without partitions."""
    from tidewater.sources import tables

    six = 21_600_000
    top = T0 - T0 % six
    starts = [top - six * k + 300_000 * j for k in (0, 1, 6, 7, 40) for j in (0, 71) if top - six * k + 300_000 * j <= T0]
    make = spark.createDataFrame
    plain = {
        "windows": make([(s // 300_000, s, s + 300_000) for s in starts], "market_id long, window_start_ms long, window_end_ms long"),
        "price_samples": make([(s // 300_000, s + 1_000 * i) for n, s in enumerate(starts) if n % 4 for i in range(n)], "market_id long, sample_second_ms long"),
        "probabilities": make([(s // 300_000, s, D(1) if n % 3 else None, D(1)) for n, s in enumerate(starts)], "market_id long, sample_second_ms long, up_ask decimal(18,8), down_ask decimal(18,8)"),
        "book": make([(s // 300_000, s + 7_000) for n, s in enumerate(starts) if n % 5 == 0], "market_id long, sample_second_ms long"),
    }
    stored = dict(plain)
    for name in ("price_samples", "probabilities"):  # the book stays unpartitioned
        tables.append(plain[name], str(tmp_path / name), "sample_second_ms")
        stored[name] = spark.read.parquet(str(tmp_path / name))
    now, before = T0 + 600_000, None
    pages = 0
    while pages == 0 or before is not None:
        want, got = (api.market_index(x, now, 2, before).collect() for x in (plain, stored))
        assert want == got and want
        before, pages = got[0]["next_cursor"], pages + 1
    assert pages > 3
    assert api.market_index(stored, now, 2, before=min(starts) // 300_000).count() == 0
    first = api.market_index(stored, now, 2)
    plan = first._jdf.queryExecution().optimizedPlan().toString()
    low = top - six * 7  # the newest partition has one market, the newest four have three
    assert plan.count(f">= {low}") >= 2 and first.collect()
    assert all(r["market_id"] >= low // 300_000 for r in first.collect())


def test_newest_bars_read_the_newest_partitions_first(spark, tmp_path):
    from tidewater.sources import tables

    six = 21_600_000
    top = T0 - T0 % six
    bars = [("BTC", top - six * k + 1_000 * i, k) for k in range(12) for i in (0, 1)] + [("ETH", top - six * 9, 5), ("ETH", top - six * 10, 4)]
    micro = spark.createDataFrame(bars, "symbol string, sample_second_ms long, spot_mid int")
    tables.append(micro, str(tmp_path / "micro"), "sample_second_ms")
    stored = {"micro": spark.read.parquet(str(tmp_path / "micro"))}
    rows = lambda df: sorted(df.select("symbol", "sample_second_ms", "spot_mid", "market_id", "age_ms").collect())
    want = rows(api.live_microstructure({"micro": micro}, T0))
    assert [(r["symbol"], r["sample_second_ms"]) for r in want] == [("BTC", top + 1_000), ("ETH", top - six * 9)]
    assert rows(api.live_microstructure(stored, T0)) == want
    assert rows(api.live_microstructure(stored, T0, ["ETH", "BTC", "none"])) == want
    filters = partition_filters(api.live_microstructure(stored, T0, ["BTC"]))
    assert filters and all(f">= {top}" in f for f in filters)
