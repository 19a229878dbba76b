"""The stages on awkward rows, each against a plain version of its decision."""

from __future__ import annotations

from collections import defaultdict

import pytest

import corpus_pipeline
from tidewater.llm.quality import quality_verdicts

from .test_dedup import fingerprint, low, roots_of
from .test_text import contaminated


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory, awkward):
    where = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en", s, len(t or "")) for i, t, s, *_ in awkward]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    labels = [(1, 1, 0), (8, 1, 0), (9, 1, 0), (3, 1, 0), (11, 0, 0), (13, 0, 0), (10, 1, 0), (14, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    items = [(1, " ".join((awkward[7][1]).split()[30:50])), (2, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def plain(stage, rows, items):
    """Ids that a stage keeps, by looking at all rows at once; ids stand or fall together."""
    if stage == "exact_dedup":
        groups = defaultdict(list)
        for i, t in rows:
            groups[low(t)].append(i)
        return {max((i for i in ids if i is not None), default=None) for ids in groups.values()}
    if stage == "simhash_dedup":
        root = roots_of([fingerprint(t) for _, t in rows], 4)
        groups = defaultdict(list)
        for i, t in rows:
            groups[root[fingerprint(t)]].append(i)
        return {min((i for i in ids if i is not None), default=None) for ids in groups.values()}
    return {i for i, t in rows if not contaminated(t, items, 10)[-1]}


def test_stages(spark, sf_dir):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "simhash_dedup", "decontaminate", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, sf_dir)
        assert left.columns == docs.columns
        got = {r["doc_id"] for r in left.collect()}
        if name == "quality":
            picked = quality_verdicts(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            assert got == {r["doc_id"] for r in picked.filter("selected").collect()}
            left = docs  # the stages after it are tried on all rows
        else:
            assert got == plain(name, [(r["doc_id"], r["text"]) for r in docs.collect()], items)
        docs = left.cache()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r["doc_id"] for r in pieces.collect()} == {r["doc_id"] for r in docs.collect()}


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
