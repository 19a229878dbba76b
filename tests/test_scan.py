"""Running values by segments, against a plain walk over each key's rows, and runs of empty buckets."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import audit
from tidewater.operators.scan import Running, scanned

ROWS = "key string, n long, m int, v int, _other int"


@pytest.mark.parametrize("width", [1, 7, 1 << 16])
@pytest.mark.parametrize("itself", [True, False])
def test_scan(spark, width, itself):
    rng = random.Random(width)
    rows = [(rng.choice(["a", "b", None]), rng.choice([*range(40), None]), i, rng.choice([None, *range(9)]), i) for i in range(300)]
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    values = {"last": Running("last", F.col("v"), itself), "most": Running("max", F.col("v"), itself), "total": Running("sum", F.col("v"), itself), "v": Running("last", F.struct("m"), itself)}
    out = scanned(df, ["key"], ["n", "m"], values, width)
    assert set(out.columns) == {*df.columns, *values}
    got = {r["m"]: (r["last"], r["most"], r["total"], r["v"]["m"] if r["v"] else None) for r in out.collect()}
    want = {}
    for key in ("a", "b", None):
        seen = []
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
            upto = [*seen, r] if itself else seen
            known = [x[3] for x in upto if x[3] is not None]
            want[r[2]] = (known[-1] if known else None, max(known, default=None), sum(known) if known else None, upto[-1][2] if upto else None)
            seen.append(r)
    assert got == want


def test_scan_of_times_and_of_texts(spark):
    df = spark.createDataFrame([("a", f"2024-01-0{d} 0{h}:30:00", d * 10 + h) for d in (1, 2) for h in (1, 2, 3)], "key string, at string, v int")
    out = scanned(df.withColumn("at", F.to_timestamp("at")), ["key"], ["at"], {"total": Running("sum", F.col("v"))})
    assert sorted(r["total"] for r in out.collect()) == [11, 23, 36, 57, 79, 102]
    with pytest.raises(TypeError, match="segments"):
        scanned(df, ["key"], ["at"], {"total": Running("sum", F.col("v"))})


def test_no_window_holds_a_whole_key(spark):
    from tidewater import plans

    for name in ("sequence_regressions", "overflow_markers", "connection_cooldown", "two_sided_top_state", "context_forward_fill", "bbo_order_flow_imbalance"):
        plan = plans.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        rows = [w for w in windows if "_segment" not in w.rsplit("], [", 2)[-2] and "_segment" not in w.rsplit("], [", 1)[-1]]
        assert windows and not rows, rows


def test_runs_of_empty_buckets(spark):
    rows = [("a", t) for t in (0, 0, 10, 40, 50, 70)] + [("b", 30), (None, 0), (None, 20)]
    got = audit.missing_runs(spark.createDataFrame(rows, "key string, t long"), ["key"], "t", 10).collect()
    assert sorted((tuple(r) for r in got), key=str) == [("a", 20, 30, 2), ("a", 60, 60, 1), (None, 10, 10, 1)]
