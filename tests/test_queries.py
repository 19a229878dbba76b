"""Every query with SQL against DuckDB on the smallest tables, and the guard around the llm folders."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from decimal import Decimal
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    return float(v) if isinstance(v, Decimal) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    rows = entry.queries()[name](spark, DATA)
    found = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(rows.columns) == sorted(columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in rows.collect()), key=repr)
    want = sorted((tuple(map(plain, r)) for r in found.fetchall()), key=repr)
    assert got == want


def test_levels_round_as_their_sql_does(spark, tmp_path):
    """Parts whose thousandfold is a tie in single precision only, and shares that are a tie in six places as text only."""
    np, pa, pq = pytest.importorskip("numpy"), pytest.importorskip("pyarrow"), pytest.importorskip("pyarrow.parquet")
    x = (np.arange(1, 4000) / 2000).astype(np.float32)
    tied = x[(x * np.float32(1000) % 1 == 0.5) & (x.astype(np.float64) * 1000 % 1 != 0.5)]
    rows = [[v, 0.5, -v, 1.0] * 3 for v in tied.tolist()]
    rows += [[(d - k) / 2000] + [0.0] * 4 + [(d + k) / 2000] + [0.0] * 4 for d in (1920, 3200) for k in range(1, 1200, 2)]
    pq.write_table(pa.table({"vec_id": pa.array(range(len(rows))), "embedding": pa.array(rows, pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    con = pytest.importorskip("duckdb").connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    found = con.execute(entry.oracle_sql()["nearest_level_imbalance"])
    columns = [c[0] for c in found.description]
    got = entry.queries()["nearest_level_imbalance"](spark, str(tmp_path)).select(columns).collect()
    assert len(tied) > 100 and sorted(map(tuple, got)) == sorted(found.fetchall())


def test_whole_series_hold_every_event(spark):
    """The one-day queries end after a day; these reach from the first event to the last."""
    get = lambda name: entry.queries()[name](spark, DATA)
    events = spark.read.parquet(f"{DATA}/events.parquet")
    n, minutes, typed = events.selectExpr("count(*)", "count(DISTINCT date_trunc('minute', ts))", "count(DISTINCT event_type, date_trunc('minute', ts))").first()
    dense = get("dense_grid_series_whole")
    assert dense.agg({"n": "sum"}).first()[0] == n
    assert get("exact_second_fallback_whole").filter("asof_ms IS NOT NULL").count() == typed
    kept = get("asof_carry_forward_whole").select("event_type", "ms").distinct().count()
    assert kept == get("exact_second_fallback_whole").count() > 5 * 1440
    assert get("missing_buckets_whole").first()["missing"] == dense.count() - minutes


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_the_rest_works_without_the_llm_folders(tmp_path):
    """A copy without the corpus part imports, answers its queries and passes tests of its own."""
    skipped = shutil.ignore_patterns("llm", "__pycache__", ".git", ".pytest_cache", "corpus_pipeline.py")
    where = tmp_path / "copy"
    shutil.copytree(ROOT, where, ignore=skipped)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = (
        "import __spark_entry__ as e; from pyspark.sql import SparkSession; q = e.queries(); assert len(q) > 90 and 'pipeline' not in q;"
        "assert not any(n.startswith('op') and n[2].isdigit() for n in q) and set(e.oracle_sql()) <= set(q);"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate(); assert e.entry(s).count() > 0"
    )
    subprocess.run([sys.executable, "-c", code], cwd=where, check=True, env=env)
    if os.environ.get("IN_COPY"):
        return
    chosen = ["tests/test_queries.py", "-k", "rest or flow or merge or whole", "-q", "-x", "-p", "no:cacheprovider"]
    subprocess.run([sys.executable, "-m", "pytest", *chosen], cwd=where, check=True, env=env | {"IN_COPY": "1"})


def test_broken_corpus_part_is_not_hidden(tmp_path):
    where = tmp_path / "copy"
    shutil.copytree(ROOT, where, ignore=shutil.ignore_patterns("__pycache__", ".git", "tests"))
    if not (where / "tidewater/llm").is_dir():
        pytest.skip("no corpus part")
    (where / "tidewater/llm/packing.py").write_text("import there_is_no_such_module\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=where, env=env, capture_output=True, text=True)
    assert done.returncode and "there_is_no_such_module" in done.stderr
