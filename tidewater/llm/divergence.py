"""Source divergence audit: which sources of a language use other words than the rest.

Plain relational. The terms of every text are given out by a regular expression and counted
by language, source and term; a term's first occurrence in a text is marked, so that one pass
also counts documents. Terms in at least ``LEAST_DOCS`` documents of a language are its kept
vocabulary. Groups (language and source) are crossed with the vocabulary of their language,
which fills in zeros, and turned into smoothed shares in whole billionths. The shares are
joined with themselves by language and term and summed by pair of sources; the terms that a
source uses more than its language does are ranked.

Texts never move: what is shuffled are counts, added up before. The groups go to every task
only after they have been counted (``GROUPS``); more meet the vocabulary by a shuffle. The
self-join is dealt by language and term, so neither a frequent source nor a frequent language
gathers in one task, and each of its keys has a row for each source of the language. A
ranking keeps its first rows in every task before they meet.

Defined results:
* null text, language or source count as '' (a value of its own for the latter two); only A-Z are lower-cased;
* every row is a document of its own, repeated rows and ids too; other columns aren't looked at;
* a group without kept terms has shares that come from zeros alone; a language without a
  kept vocabulary has pairs of value 0 and no terms; a language of one source has no pairs;
* ranks are unique, equal values in the order of the items' UTF-8 bytes; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.shared import staged

LEAST_DOCS = 3
TOP_TERMS = 200
#: Shares are whole numbers of this unit's parts.
UNIT = 1_000_000_000
#: Groups that one broadcast may hold.
GROUPS = 50_000
#: What lies between terms: ASCII characters that aren't letters.
_BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _plain(docs: DataFrame, *names: str) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in names))


def _lowered(text: str) -> Column:
    """A-Z lower-cased; a text of ASCII alone by ``lower``, which is faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, n_docs): occurrences, and the documents that have the term.

    A text's terms are sorted, so that an occurrence is the text's first if it differs from the
    one before. ``posexplode_outer`` keeps Spark from working the array out once more for a
    filter on its size.
    """
    listed = _plain(docs, "lang", "source", "text").select("lang", "source", F.sort_array(F.split(_lowered("text"), _BETWEEN)).alias("terms"))
    each = listed.select("lang", "source", "terms", F.posexplode_outer("terms").alias("at", "term")).filter(F.length("term") > 0)
    first = F.when((F.col("at") == 0) | (F.col("term") != F.expr("terms[at - 1]")), 1).otherwise(0)
    return each.groupBy("lang", "source", "term").agg(F.count("*").alias("n"), F.sum(first).alias("n_docs"))


def _share(n: str, total: str) -> Column:
    """1 + floor(UNIT * (n + 1) / (total + kinds)), exact: in longs where they can't overflow, else in decimals."""
    short = f"({UNIT} * ({n} + 1)) div ({total} + kinds)"
    wide = f"(cast({UNIT} as decimal(10,0)) * cast({n} + 1 as decimal(20,0))) div cast({total} + kinds as decimal(20,0))"
    return F.expr(f"1 + CASE WHEN {total} + kinds <= {9 * UNIT} THEN {short} ELSE {wide} END")


def _distance(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def vocabulary(counts: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, in_lang, id): the kept terms, their occurrences in the language and a number each."""
    every = counts.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("n_docs").alias("in_docs"))
    return every.filter(F.col("in_docs") >= least).drop("in_docs").withColumn("id", F.monotonically_increasing_id())


def source_groups(docs: DataFrame, present: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, lang_total, kinds) of every group: kept occurrences there and in its language, and kept terms."""
    totals = present.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("in_lang").alias("lang_total"), F.count("*").alias("kinds"))
    groups = _plain(docs, "lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    return groups.na.fill(0, ["total", "lang_total", "kinds"]).withColumn("group", F.monotonically_increasing_id())


def dense_shares(present: DataFrame, kept: DataFrame, groups: DataFrame, most: int = GROUPS) -> DataFrame:
    """(id, group, p): every group's share of every kept term of its language."""
    groups = F.broadcast(groups) if groups.limit(most + 1).count() <= most else groups
    there = present.join(groups.select("lang", "source", "group"), ["lang", "source"]).select("id", "group", "n")
    crossed = kept.select("id", "lang").join(groups, "lang").select("id", "group", "total", "kinds")
    return crossed.join(there, ["id", "group"], "left").na.fill(0, ["n"]).select("id", "group", _share("n", "total").alias("p"))


def source_divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP_TERMS, most: int = GROUPS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank: how far a source is from the others, and by which terms."""
    counts = staged(term_counts(docs), "term-counts")
    kept = staged(vocabulary(counts, least), "vocabulary")
    present = staged(counts.drop("n_docs").join(kept, ["lang", "term"]), "kept-counts")
    groups = staged(source_groups(docs, present, kept), "source-groups")
    dense = staged(dense_shares(present, kept, groups, most), "shares")

    other = dense.select("id", F.col("group").alias("item_group"), F.col("p").alias("q"))
    apart = dense.join(other, "id").filter("group <> item_group").groupBy("group", "item_group").agg(F.sum(_distance("p", "q")).alias("value"))
    names = groups.select("lang", "source", "group")
    pairs = names.join(names.select("lang", F.col("source").alias("item"), F.col("group").alias("item_group")), "lang").filter("group <> item_group")
    pairs = pairs.join(apart, ["group", "item_group"], "left").na.fill(0, ["value"])

    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    shown = ["lang", "source", "part", "item", "value", F.row_number().over(by).alias("rank")]
    pairs = pairs.withColumn("part", F.lit("pair")).select(*shown)
    known = F.broadcast(groups) if groups.limit(most + 1).count() <= most else groups
    terms = present.join(known, ["lang", "source"]).withColumn("p", _share("n", "total")).withColumn("q", _share("in_lang", "lang_total"))
    terms = terms.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _distance("p", "q").alias("value"))
    return pairs.unionByName(terms.select(*shown).filter(F.col("rank") <= top))
