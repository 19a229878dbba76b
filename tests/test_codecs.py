"""Codecs, folds and running-feed operators on small hand-made rows."""

from __future__ import annotations

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions import codec
from tidewater.operators import series, telemetry
from tidewater.operators.rules import checked
from tidewater.sources import tables
from tidewater.streaming import sinks

SCHEMA = {"n": "integer", "price": "decimal", "size": "decimal?", "ok": "boolean"}


def read(spark, texts, exact=True):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    columns, rules = codec.decoded(F.col("text"), SCHEMA, exact)
    out = checked(rows, rules).select("i", "reject_reason", *(c.alias(n) for n, c in columns.items()))
    return [tuple(r)[1:] for r in out.orderBy("i").collect()]


def test_decoding_is_strict(spark):
    good = '{"n":1,"price":"2.50","size":null,"ok":true}'
    cases = [
        (good, None), (' { "ok" : false , "n":-3,\n"price" : "1e3","size":"0.1" } ', None),
        ('{"n":1,"n":1,"price":"2","size":null,"ok":true}', "repeated_field"), ('{"n":1,"price":"2","ok":true}', "missing_field"),
        ('{"n":1,"price":"2","size":null,"ok":true,"x\\"y":1}', "unknown_field"), ('{"n":1.0,"price":"2","size":null,"ok":true}', "wrong_n"),
        ('{"n":true,"price":"2","size":null,"ok":true}', "wrong_n"), ('{"n":99999999999999999999,"price":"2","size":null,"ok":true}', "wrong_n"),
        ('{"n":1,"price":2.5,"size":null,"ok":true}', "wrong_price"), ('{"n":1,"price":"NaN","size":null,"ok":true}', "wrong_price"),
        ('{"n":1,"price":" 2","size":null,"ok":true}', "wrong_price"), ('{"n":1,"price":null,"size":null,"ok":true}', "wrong_price"),
        ('{"n":1,"price":"2","size":0,"ok":true}', "wrong_size"), ('{"n":1,"price":"2","size":null,"ok":"true"}', "wrong_ok"),
        ('{"n":1,"price":"2","size":null,"ok":[]}', "not_a_flat_object"), ("[1]", "not_a_flat_object"), ("", "not_a_flat_object"), (None, "not_a_flat_object"),
        (good[:-1], "not_a_flat_object"), ("{}", "missing_field"), ('{"n":01,"price":"2","size":null,"ok":true}', "not_a_flat_object"),
    ]
    got = read(spark, [t for t, _ in cases])
    assert [r[0] for r in got] == [want for _, want in cases]
    assert got[0][1:] == (1, "2.50", None, True) and got[1][1:] == (-3, "1e3", "0.1", False)
    assert read(spark, ['{"n":1,"price":"2","size":null,"ok":true,"more":{}}', good.replace("}", ',"more":"x"}')], exact=False)[1][0] is None


def test_rows_and_expressions_decode_alike(spark):
    texts = ['{"n":1,"price":"2","size":null,"ok":true}', ' {"n":2, "price":"3" ,"size":"1","ok":false,"n":4}\n', '{"n":"1","price":2}', "{ }", "{", '{"a":1,}', None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for exact in (True, False):
        found, columns, rules = codec.decoded_rows(rows, "text", SCHEMA, exact)
        out = checked(found, rules).select("i", "reject_reason", *(c.alias(n) for n, c in columns.items()))
        assert [tuple(r)[1:] for r in out.orderBy("i").collect()] == read(spark, texts, exact)


@pytest.mark.parametrize("name", ["snapshot_codec", "live_price_codec"])
def test_members_are_taken_apart_once(spark, name):
    from tidewater import plans

    plan = plans.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1 and plan.count("regexp_extract(") == 1


def test_encoding_round_trips(spark):
    rows = spark.createDataFrame([(1, Decimal("2.50"), None, True), (-7, Decimal("0.00"), Decimal("1.10"), False)], "n long, price decimal(10,2), size decimal(10,2), ok boolean")
    texts = [r[0] for r in rows.select(codec.encoded({c: F.col(c) for c in SCHEMA}, SCHEMA)).collect()]
    assert texts[0] == '{"n":1,"price":"2.50","size":null,"ok":true}'
    assert [json.loads(t)["price"] for t in texts] == ["2.50", "0.00"]
    assert read(spark, texts) == [(None, 1, "2.50", None, True), (None, -7, "0.00", "1.10", False)]


def test_financial_text(spark):
    texts = ["1.50", "+2", "1e5", "1.5E-3", "0e2", "NaN", "Infinity", "", " 1", "1,000", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    got = [r[0] for r in rows.select(codec.financial_text(F.col("t"), T.StringType())).collect()]
    assert got == ["1.50", "2", "100000", "0.0015", "0", None, None, None, None, None, None]
    for kind in (T.DoubleType(), T.FloatType(), T.BooleanType()):
        with pytest.raises(TypeError):
            codec.financial_text(F.col("t"), kind)


def test_fold_and_log_rows(spark, tmp_path):
    lines = [{"event": "s", "at": i, "depth": d, "ms": m} for i, (d, m) in enumerate([(3, 1.5), (9, None), (4, 2.0)])] + [{"event": "other", "at": 9, "depth": 99, "ms": 9}]
    (tmp_path / "log.txt").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    rows = tables.log_rows(spark, str(tmp_path / "log.txt"), "s", "at int, depth int, ms double")
    out = telemetry.fold(rows, [], ["at"], most=["depth"], least=["ms"], mean=["ms"], last=["depth", "ms"]).first()
    assert tuple(out) == (3, 9, 1.5, 1.75, 4, 2.0)
    assert telemetry.fold(rows.limit(0), [], ["at"], most=["depth"], last=["ms"]).first()["summaries"] == 0


def test_bytes_per_hour(spark):
    rows = spark.createDataFrame([(0,), (3_599_900,)], "ms long")
    sizes = spark.createDataFrame([(7_000,), (5_000,)], "bytes long")
    assert tuple(telemetry.bytes_per_hour(rows, sizes, "ms", 100).first()) == (2, 1.0, 12_000, "12 kB", 12_000)
    assert telemetry.bytes_per_hour(rows.limit(0), sizes, "ms", 100).first()["bytes_per_hour"] is None


def test_loss_markers(spark):
    offers = [("a", i, 10 * i, ok) for i, ok in enumerate([True, False, False, True, True, False])] + [("b", 1, 5, False), ("b", 2, 6, True)]
    rows = spark.createDataFrame(offers, "key string, n long, ms long, ok boolean").withColumn("kind", F.lit("trade"))
    got = sorted(tuple(r) for r in telemetry.with_loss_markers(rows, ["key"], "n", "ok", "ms", "kind").collect())
    assert got == [("a", 1, "trade", 0), ("a", 6, "error", 10), ("a", 7, "trade", 30), ("a", 9, "trade", 40), ("b", 4, "error", 5), ("b", 5, "trade", 6)]


def test_open_markets(spark):
    times = [300_000 - 45_001, 300_000 - 45_000, 300_000, 329_999, 330_000, 400_000]
    rows = spark.createDataFrame([(t,) for t in times], "ms long")
    got = {}
    for r in telemetry.open_markets(rows, "ms").collect():
        got.setdefault(r["ms"], {})[r["market_id"]] = r["phase"]
    assert [got[t] for t in times] == [{0: "live"}, {0: "live", 1: "early"}, {0: "late", 1: "live"}, {0: "late", 1: "live"}, {1: "live"}, {1: "live"}]


def test_catch_up_gives_every_boundary_its_row(spark):
    rows = spark.createDataFrame([("a", t) for t in (1_260, 2_249, 2_251, 2_400, 5_300)] + [("b", 9_000)], "key string, ms long")
    got = sorted(tuple(r) for r in telemetry.finalised(rows, ["key"], "ms").collect())
    assert got == [("a", 2_000, 2_251, 1, False), ("a", 3_000, 5_300, 2_050, True), ("a", 4_000, 5_300, 1_050, True), ("a", 5_000, 5_300, 50, False)]


def test_best_asks(spark):
    answers = ['{"u":{"SELL":"0.52"},"d":{"SELL":0.49}}', '{"u":{"SELL":"1.01"},"d":{"BUY":"0.4"}}', '{"u":5}', "nonsense", None]
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a string").orderBy("i")
    got = [tuple(r) for r in rows.select(*telemetry.best_asks(F.col("a"), {"up": F.lit("u"), "down": F.lit("d")})).collect()]
    assert got[0] == (Decimal("0.52"), Decimal("0.49")) and got[1:] == [(None, None)] * 4


def test_parameter_list(spark):
    assert sorted(r[0] for r in tables.listed(spark, [3, 1, 3], "k", "bigint").collect()) == [1, 3, 3]
    assert tables.listed(spark, [], "k").count() == 0


def test_reconciled(spark):
    columns = "market_id long, resolution_status string, open_price int, close_price int, last_checked_ms long, resolution_attempts long, next_check_ms long"
    known = spark.createDataFrame([(1, "pending", 5, None, 10, 2, 20), (2, "resolved", 5, 6, 10, 1, None), (3, "pending", None, None, 10, 0, 99_999)], columns)
    markets = spark.createDataFrame([(i, 50) for i in range(1, 6)], "market_id long, window_end_ms long")
    fetched = spark.createDataFrame([(1, "resolved", 5, 7)], "market_id long, resolution_status string, open_price int, close_price int")
    got = {r["market_id"]: tuple(r)[1:] for r in telemetry.reconciled(markets, known, fetched, 1_000, 10).collect()}
    assert got[1] == ("resolved", 5, 7, 1_000, 3, None)
    assert got[2] == ("resolved", 5, 6, 10, 1, None) and got[3] == ("pending", None, None, 10, 0, 99_999)
    assert got[4] == got[5] == ("pending", None, None, 1_000, 1, 31_000)


def test_gaps_across_buckets(spark):
    times = [5, 5, 90, 100, 101, 950, 951, 1_200, 3_000]
    rows = spark.createDataFrame([("a", i, t) for i, t in enumerate(times)] + [("b", 0, 7)], "key string, n long, ms long").repartition(3)
    got = sorted(tuple(r) for r in series.with_gaps(rows, ["key"], "ms", ["ms", "n"], "gap", "high", width=100).collect())
    want, high = [("a", 0, 5, None, None)], None
    for i in range(1, len(times)):
        gap = times[i] - times[i - 1]
        high = gap if high is None else max(high, gap)
        want.append(("a", i, times[i], gap, high))
    assert got == [*want, ("b", 0, 7, None, None)]


def test_an_epoch_written_twice_counts_once(spark, tmp_path):
    rows = spark.createDataFrame([("x", 5), ("y", 30_000_000)], "key string, ms long")
    seen = []
    write = sinks.in_turn(lambda batch, epoch: seen.append(batch.count()), sinks.appending(str(tmp_path / "t"), "ms", ["key"]), staging=str(tmp_path / "s"))
    for epoch in (0, 0, 1):
        write(rows, epoch)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4 and seen == [2, 2, 2]


def test_merging_rewrites_touched_partitions_only(spark, tmp_path):
    path, schema, six = str(tmp_path / "t"), "key string, ms long, received_ms long, v int", 21_600_000
    write = sinks.merging(path, "ms", ["key", "ms"], ["received_ms"])
    write(spark.createDataFrame([("k", six * i + j, 1, i) for i in range(6) for j in range(3)], schema), 0)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "t").glob("part_start_ms=*/*.parquet")}
    news = spark.createDataFrame([("k", six * 2, 2, 300), ("k", six * 2, 3, 301), ("new", six * 2 + 5, 1, 7), ("k", six * 9, 1, 9)], schema)
    for _ in range(2):  # a batch that runs again
        write(news, 1)
    got = {(r["key"], r["ms"]): r["v"] for r in spark.read.parquet(path).collect()}
    assert got == {("k", six * i + j): i for i in range(6) for j in range(3)} | {("k", six * 2): 301, ("new", six * 2 + 5): 7, ("k", six * 9): 9}
    kept = {f for f, at in before.items() if f.exists() and f.stat().st_mtime_ns == at}
    assert {f.parent.name for f in before.keys() - kept} == {f"part_start_ms={six * 2}"}
    with pytest.raises(ValueError, match="part of the key"):
        tables.merge_partitions(news, path, "ms", ["key"], ["received_ms"])


def test_latest_values_and_order_books(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", 1, 7), ("c", 1, 8)], "key string, received_ms long, v int")
    assert sorted((r["key"], r["v"]) for r in tables.latest_values(rows, "key", ["a", "b"]).collect()) == [("a", 6), ("b", 7)]


def test_one_day_filters_reach_the_scan(spark):
    from tidewater.plans.registry import ticks
    from tidewater.plans.series import DAY

    plan = ticks(spark, "/root/testdata/sf0.001", DAY, DAY + 86_400_000)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed
