"""Live operators: replays in shuffled micro-batches against plain versions, and clocks that go on without rows."""

from __future__ import annotations

import json
import random
import time

import pytest

from tidewater.streaming import live

T0 = 1_704_067_200_000
EVENTS = "key string, ms long, sequence long, event string, value long"


@pytest.fixture
def replay(spark, tmp_path):
    """Run ``plan`` over feeds given as lists of micro-batches; give the rows of all output."""
    live.with_rocksdb(spark)

    def run(feeds, plan, seconds=None, enough=None):
        sources = {}
        for name, batches in feeds.items():
            for i, rows in enumerate(batches):
                spark.createDataFrame(rows, EVENTS).coalesce(1).write.json(f"{tmp_path}/{name}/{i}")
            sources[name] = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/{name}/*")
        out = []
        writer = plan(**sources).writeStream.outputMode("append").foreachBatch(lambda df, i: out.extend(r.asDict() for r in df.collect()))
        writer = writer.option("checkpointLocation", f"{tmp_path}/checkpoint")
        if seconds is None:
            writer.trigger(availableNow=True).start().awaitTermination(180)
        else:
            query = writer.trigger(processingTime="250 milliseconds").start()
            end = time.time() + seconds
            while time.time() < end and not (enough and enough(out)):
                query.awaitTermination(1)
            query.stop()
            if query.exception():
                raise query.exception()
        return out

    return run


def shuffled(rows, batches, seed):
    rng = random.Random(seed)
    rows = rng.sample(rows, len(rows))
    return [rows[i::batches] for i in range(batches)]


def far(ms):
    """A row of another key that brings the newest time on."""
    return ("far", ms, 0, "x", 0)


def test_causal_bars_of_four_feeds(replay):
    rng, feeds = random.Random(3), ("book", "trade", "mark", "marker")
    rows = {f: [(rng.choice("ab"), T0 + rng.randrange(12_000), i, f, rng.randrange(100)) for i in range(40)] for f in feeds}
    batches = {f: [*shuffled(rows[f], 3, k), [far(T0 + 500_000)]] for k, f in enumerate(feeds)}
    out = replay(batches, lambda **s: live.causal_bars(s, "key", "ms", delay_ms=20_000))
    out = [r for r in out if r["key"] != "far"]
    assert all(r["late"] == 0 for r in out)
    for key in "ab":
        own = sorted((r[1], r[2], f, r[4]) for f in feeds for r in rows[f] if r[0] == key)
        seconds = range(own[0][0] // 1_000 * 1_000, own[-1][0] // 1_000 * 1_000 + 1, 1_000)
        got = [r for r in out if r["key"] == key]
        assert [r["sample_second_ms"] for r in got] == list(seconds)
        for r, s in zip(got, seconds):
            for f in feeds:
                inside = [v for ms, _, g, v in own if g == f and s <= ms < s + 1_000]
                before = [(ms, v) for ms, _, g, v in own if g == f and ms < s + 1_000]
                assert [json.loads(b)["value"] for b in r[f"{f}_rows"]] == inside
                assert r[f"{f}_age_ms"] == (s + 1_000 - before[-1][0] if before else None)
                assert (json.loads(r[f"{f}_last"])["value"] if r[f"{f}_last"] else None) == (before[-1][1] if before else None)


def test_late_rows_are_counted(replay):
    batches = [[("a", T0, 1, "x", 1), ("a", T0 + 5_000, 2, "x", 2)], [("a", T0 + 5_500, 5, "x", 5)], [("a", T0 + 100, 3, "x", 3)], [("a", T0 + 9_000, 4, "x", 4)], [far(T0 + 500_000)]]
    out = [r for r in replay({"only": batches}, lambda only: live.causal_bars({"only": only}, "key", "ms")) if r["key"] == "a"]
    assert [(r["sample_second_ms"] - T0) // 1_000 for r in out] == list(range(10))
    told = next(i for i, r in enumerate(out) if r["late"])
    assert [r["gap_ms"] for r in out] == [None] * told + [T0 + (told + 1) * 1_000] * (10 - told)
    assert sum(r["late"] for r in out) == 1 and [len(r["only_rows"]) for r in out] == [1, 0, 0, 0, 0, 2, 0, 0, 0, 1]


def test_late_rows_under_lasting_names():
    bars, kept = live.CausalBars(["mark", "trade"], 250, 60_000, lasting=["mark"]), {"late": 2, "gap": None, "last": {"mark": [T0 + 100, "old"]}, "total": {"mark": 1}}
    bars.take((T0 + 200, 5, "mark", "late"), kept)
    bars.take((T0 + 50, 4, "mark", "older"), kept)
    row = dict(zip(bars.fields, bars.bar("a", T0 + 1_000, [(T0 + 1_500, 6, "trade", "t")], kept)))
    assert (row["late"], row["gap_ms"], row["mark_last"], row["mark_total"], row["mark_rows"], row["trade_before"]) == (2, T0 + 2_000, "late", 3, [], None)
    later = dict(zip(bars.fields, bars.bar("a", T0 + 2_000, [], kept)))
    assert (later["late"], later["gap_ms"], later["trade_before"], later["trade_age_ms"]) == (0, T0 + 2_000, "t", 1_500)


def test_asof_pairs(replay):
    rng = random.Random(8)
    left = [(rng.choice("ab"), T0 + rng.randrange(0, 20_000, 10), i, "l", i) for i in range(60)]
    right = [(rng.choice("ab"), T0 + rng.randrange(0, 20_000, 10), i, "r", i) for i in range(40)]
    feeds = {"left": [*shuffled(left, 3, 1), [far(T0 + 500_000)]], "right": [*shuffled(right, 4, 2), [far(T0 + 500_000)]]}
    out = replay(feeds, lambda left, right: live.asof_pairs(left, right, "key", "ms", 700, "30 seconds"))
    got = sorted((r["key"], r["ms"], json.loads(r["left"])["value"], r["right_ms"], json.loads(r["right"])["value"] if r["right"] else None) for r in out if r["key"] != "far")
    want = []
    for k, ms, _, _, v in left:
        best = max(((r[1], r[2], r[4]) for r in right if r[0] == k and ms - 700 <= r[1] <= ms), default=(None, None, None))
        want.append((k, ms, v, best[0], best[2]))
    assert got == sorted(want)


def test_boundaries_are_finalised_without_rows(replay):
    rows = [[("a", T0, 1, "x", 1), ("a", T0 + 1, 2, "x", 1)]]
    out = replay({"events": rows}, lambda events: live.finalised_stream(events, "key", "ms"), 60, lambda out: len(out) >= 4)
    boundaries = [r["boundary_ms"] for r in out]
    assert len(out) >= 4 and boundaries == list(range(boundaries[0], boundaries[-1] + 1, 1_000))
    assert all(r["jitter_ms"] == r["finalised_ms"] - r["boundary_ms"] - 250 >= 0 for r in out)
    assert [r["rows"] for r in out] == [2] + [0] * (len(out) - 1)


def test_sampler_speaks_while_its_source_is_silent(replay):
    now = int(time.time() * 1_000)
    rows = [[("a", now + 20_000, 2, "x", 7), ("a", now + 10_000, 1, "x", 6), ("old", now - 60_000, 1, "x", 1)]]
    out = replay({"prices": rows}, lambda prices: live.sampled_stream(prices, "key", "ms"), 60, lambda out: len(out) >= 3)
    assert len(out) >= 3 and {r["key"] for r in out} == {"a"}
    assert all(json.loads(r["body"])["value"] == 7 and r["sample_second_ms"] % 1_000 == 0 for r in out)
    assert len({r["sample_second_ms"] for r in out}) == len(out)


def test_sessions_end_by_close_silence_gap_and_reset(replay):
    a = [(0, "open"), (100, "data"), (200, "data"), (900, "close"), (2_000, "open"), (2_500, "data")]  # then silent
    b = [(0, "open"), (10, "data"), (500, "gap"), (600, "data"), (700, "open"), (800, "open"), (900, "close")]
    rows = [("a", T0 + ms, i, e, 0) for i, (ms, e) in enumerate(a)] + [("b", T0 + ms, i, e, 0) for i, (ms, e) in enumerate(b)]
    feeds = {"events": [*shuffled(rows, 3, 4), [far(T0 + 100_000)], [far(T0 + 200_000)]]}
    out = replay(feeds, lambda events: live.session_stream(events, "key", "ms", lateness="10 seconds"))
    got = [(r["key"], r["opened_ms"] - T0, r["closed_ms"] - T0, r["reason"], r["rows"], r["errors"], r["unhealthy_until_ms"] - T0) for r in out if r["key"] != "far"]
    want = [
        ("a", 0, 900, "close", 2, 1, 5_900), ("a", 2_000, 32_500, "silent", 1, 1, 37_500),
        ("b", 0, 500, "gap", 1, 0, 5_500), ("b", 700, 800, "reset", 0, 0, 5_800), ("b", 800, 900, "close", 0, 1, 5_900),
    ]
    assert sorted(got) == want


def test_markets_wake_themselves_up(replay):
    now = int(time.time() * 1_000)
    markets = [[("m", now, 1, "x", 0), ("n", now, 1, "x", 0)], [], []]
    plan = lambda markets, answers: live.resolution_stream(markets, answers, "key", "ms", first_ms=200, most_ms=400, attempts=3)
    answers = [[("n", now, 1, "won", 1)]]
    out = replay({"markets": markets[:1], "answers": answers}, plan, 60, lambda out: any(r["status"] == "given_up" for r in out))
    m, n = ([(r["status"], r["attempts"]) for r in out if r["key"] == k] for k in "mn")
    assert m == [("ask", 1), ("ask", 2), ("given_up", 3)]
    assert n[-1][0] == "resolved" and sum(s == "resolved" for s, _ in n) == 1


def test_two_generations_of_markets(replay):
    times = [300_000 - 45_001, 300_000 - 45_000, 300_000, 329_999, 330_000, 400_000]
    rows = [("a", T0 + t, i, "x", i) for i, t in enumerate(times)]
    out = replay({"messages": [rows[:3], rows[3:], [far(T0 + 2_000_000)]]}, lambda messages: live.rollover_stream(messages, "key", "ms", lateness="60 seconds"))
    own = [r for r in out if r["key"] == "a"]
    got = [((r["ms"] - T0), (r["market_ms"] - T0) // 300_000, r["phase"]) for r in own if r["phase"] != "closed"]
    want = []
    for t in times:
        for k in (0, 1, 2):
            if 300_000 * k - 45_000 <= t < 300_000 * (k + 1) + 30_000:
                want.append((t, k, "early" if t < 300_000 * k else "live" if t < 300_000 * (k + 1) else "late"))
    assert sorted(got) == sorted(want)
    assert {((r["market_ms"] - T0) // 300_000, r["sequence"]) for r in own if r["phase"] == "closed"} == {(0, 4), (1, 5)}
