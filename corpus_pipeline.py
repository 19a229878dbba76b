"""Corpus preparation: five stages over ``documents``, each written out before the next.

A stage takes (spark, docs, sf_dir) and returns the documents it keeps, all columns as they
were; the last returns the packed pieces. Verdicts are those of rows, told apart by ``doc_id``
and a hash of all columns: rows that share an id but not their text are judged apart. Rows
that agree in all columns stand or fall together, until the exact dedup leaves one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm.decontaminate import contamination_rows
from tidewater.llm.exact_dedup import survivors
from tidewater.llm.packing import pack
from tidewater.llm.quality import quality_rows
from tidewater.llm.shared import rows_with, staged, table
from tidewater.llm.simhash_dedup import near_duplicate_rows, representatives


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling selects."""
    verdicts = quality_rows(docs, table(spark, sf_dir, "labels"))
    return rows_with(docs, staged(verdicts.filter("not selected").select("doc_id", "row_key"), "rejected"), without=True)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the largest id, of every group of equal texts."""
    return survivors(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the least id, of every component of near duplicates."""
    found = staged(near_duplicate_rows(docs).select("doc_id", "row_key", "root"), "components")
    first = staged(representatives(found), "representatives")
    rest = found.select("doc_id", "row_key").subtract(first)
    return rows_with(docs, staged(rest, "near-copies"), without=True)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word window of a benchmark item."""
    verdicts = contamination_rows(docs, table(spark, sf_dir, "benchmark"))
    return rows_with(docs, staged(verdicts.filter("contaminated").select("doc_id", "row_key"), "contaminated"), without=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, laid into windows."""
    return pack(docs)


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact),
    ("simhash_dedup", near),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: The classifier, the fingerprints and the packing aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
