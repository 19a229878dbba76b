"""Benchmark decontamination over a positional inverted index, in DataFrame functions only.

The training side is indexed by document ranges: the words of every text are given out with
their positions, and those that a benchmark window uses are stored as postings (id of the
term, row, position). The postings of a range of documents (a bucket of rows) lie together,
sorted by term, so a term's list is spread over all ranges, however frequent it is, and
lists of one document meet without being moved.

The benchmark is cut into windows of consecutive words. A window's terms are ordered by the
lengths of their lists. The list of its rarest term, moved back by the term's offset, gives
places where the window may start. They are intersected with the list of the second rarest
term, moved back by its own offset, and what is left with the lists of all other terms. A
window that uses a word that the corpus lacks is dropped before that. What is looked for in
a list goes to the documents' range by row; the lists stay where they are. Proximity matches
(``slop``) look for each term at all its possible distances from the rarest one, and keep
the positions that lie on a chain through all terms.

Nothing is collected per word or per passage: a passage that a third of all documents carry
only gives that many hit rows, spread like the documents. The windows' terms are broadcast
up to a checked number (``block``); more meet the words by a shuffle.

Defined results:
* A-Z are lower-cased; words are runs of characters other than ASCII non-letters/digits;
* null or wordless text has no words: no window, no hit, ``n_items`` 0 and the digest of
  the empty string; an item of 1 to size-1 words is one window of its own length;
* repeated items count once; an item whose id is null marks words but is not named;
* with ``slop`` > 0 a window's words need only follow in order with at most ``slop`` other
  words between neighbours; the words of such a match are hit, those between are not;
* each document row has one result row, repeated rows and null ids too; empty tables on
  either side give an empty result or rows without hits; extra columns are not looked at.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.shared import bucket_count, bucketed, co_located, row_key, staged

WINDOW = 10
#: Windows, and terms / 8, that one broadcast may hold (about 15 MB).
BLOCK = 50_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Index(NamedTuple):
    """Postings (id, row, pos) by ranges of rows, and the terms (term, id) that have them."""

    postings: DataFrame
    terms: DataFrame
    buckets: int


def words_of(text: Column) -> Column:
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(low, _BETWEEN), "")


def positional_store(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """(row, doc_id, row_key, n_words, words) bucketed by row: words by position, ``row`` unique."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        row_key(docs).alias("row_key"),
        F.col("text").cast("string").alias("text"),
    )
    buckets = buckets or bucket_count(docs)
    dealt = rows.repartition(buckets, "row").select("row", "doc_id", "row_key", words_of(F.col("text")).alias("words"))
    return bucketed(dealt.select("row", "doc_id", "row_key", F.size("words").alias("n_words"), "words"), "words", "row", buckets)


def windows_of(items: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (window, terms, n) and the items that have them (window, item)."""
    words = items.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w"))
    words = words.filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    cut = words.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at"), size).alias("terms"))
    cut = cut.withColumn("window", F.sha2(F.array_join("terms", " "), 256)).distinct()
    cut = staged(cut, "windows")
    distinct = cut.select("window", "terms", F.size("terms").alias("n")).distinct()
    return distinct, cut.select("window", "item").distinct()


def _small(df: DataFrame, most: int) -> bool:
    return df.limit(most + 1).count() <= most


def inverted_index(store: DataFrame, windows: DataFrame, buckets: int, block: int = BLOCK) -> Index:
    """Postings of every word in ``store`` that a window uses."""
    terms = windows.select(F.explode("terms").alias("term")).distinct()
    terms = staged(terms.select("term", F.monotonically_increasing_id().alias("id")), "terms")
    tokens = store.select("row", F.posexplode("words").alias("pos", "term"))
    if _small(terms, 8 * block):
        found = tokens.join(F.broadcast(terms), "term").select("id", "row", "pos")
    else:
        found = tokens.join(terms, "term").select("id", "row", "pos").repartition(buckets, "row")
    return Index(bucketed(found, "postings", "row", buckets, "id"), terms, buckets)


def list_lengths(index: Index) -> DataFrame:
    """(id, freq): the lengths of the lists; absent terms have no row."""
    return staged(index.postings.groupBy("id").agg(F.count("*").alias("freq")), "freqs")


def ranked_windows(windows: DataFrame, index: Index) -> DataFrame:
    """(window, n, lists): a window's terms (freq, off, id), the rarest first; without those that use an absent term."""
    at = windows.select("window", "n", F.posexplode("terms").alias("off", "term")).join(index.terms, "term")
    lists = F.array_sort(F.collect_list(F.struct("freq", "off", "id"))).alias("lists")
    ranked = at.join(list_lengths(index), "id").groupBy("window", "n").agg(lists)
    return staged(ranked.filter(F.size("lists") == F.col("n")), "ranked")


def candidates(index: Index, ranked: DataFrame, block: int = BLOCK) -> DataFrame:
    """(row, pos, window, n, lists): the postings of each window's rarest term."""
    rarest = ranked.withColumn("id", F.col("lists")[0]["id"])
    rarest = F.broadcast(rarest) if _small(ranked, block) else rarest
    return index.postings.join(rarest, "id").drop("id")


def _listed(index: Index, wanted: DataFrame) -> DataFrame:
    """The rows of ``wanted`` (row, id, pos and others) whose posting is in the index; run it under ``co_located``."""
    there = wanted.repartition(index.buckets, "row").hint("shuffle_hash")
    return index.postings.join(there, ["row", "id", "pos"])


def phrase_hits(index: Index, ranked: DataFrame, slop: int = 0, block: int = BLOCK) -> DataFrame:
    """(row, window, start, n): runs of words, counted from 0, that belong to a match of the window.

    Exact matches are one run; of proximity matches each word is one.
    """
    start = F.col("pos") - F.col("lists")[0]["off"]
    found = candidates(index, ranked, block)
    if slop:
        return _chains(index, found, slop)
    found = found.select("row", start.alias("start"), "window", "n", "lists").filter("start >= 0")
    single = found.filter("n = 1").select("row", "window", "start", "n")
    second = F.col("lists")[1]
    pairs = found.filter("n > 1").select("*", second["id"].alias("id"), (F.col("start") + second["off"]).alias("pos"))
    with co_located(index.postings.sparkSession):
        left = staged(_listed(index, pairs).select("row", "window", "start", "n", "lists"), "pairs")
    rest = left.select("row", "window", "start", "n", F.explode(F.slice("lists", 3, F.greatest(F.size("lists") - 2, F.lit(0)))).alias("t"))
    rest = rest.select("row", "window", "start", "n", F.col("t.id").alias("id"), (F.col("start") + F.col("t.off")).alias("pos"))
    whole = _listed(index, rest).groupBy("row", "window", "start", "n").agg(F.count("*").alias("met")).filter("met = n - 2")
    with co_located(index.postings.sparkSession):
        whole = staged(whole.drop("met"), "whole")
    full = left.filter("n = 2").select("row", "window", "start", "n")
    return staged(single.unionByName(full).unionByName(whole), "matches")


def _chains(index: Index, found: DataFrame, slop: int) -> DataFrame:
    """Words on a chain through all terms of a window, at most ``slop`` other words between neighbours."""
    reach = F.col("t.off") - F.col("off")
    far = reach * (slop + 1)
    around = found.select("row", "window", "n", "pos", F.col("lists")[0]["off"].alias("off"), F.explode("lists").alias("t"))
    spread = F.explode(F.sequence(F.col("pos") + F.least(reach, far), F.col("pos") + F.greatest(reach, far))).alias("pos")
    wanted = around.select("row", "window", "n", F.col("t.off").alias("off"), F.col("t.id").alias("id"), spread).distinct()
    with co_located(index.postings.sparkSession):
        near = staged(_listed(index, wanted).select("row", "window", "n", "off", "pos"), "near")
    longest = near.agg(F.max("n")).first()[0] or 0  # at most the window's size

    def stepped(states: DataFrame, to: int, ahead: int) -> DataFrame:
        gaps = F.explode(F.sequence(F.lit(1), F.lit(slop + 1))).alias("gap")
        next_to = states.select("row", "window", gaps, "pos").select("row", "window", (F.col("pos") + ahead * F.col("gap")).alias("pos"))
        return next_to.distinct().withColumn("off", F.lit(to))

    ahead = [near.filter("off = 0")]
    for k in range(1, longest):
        ahead.append(staged(near.filter(F.col("off") == k).join(stepped(ahead[-1], k, 1), ["row", "window", "pos", "off"], "left_semi"), "ahead"))
    kept, out = None, []
    for k in range(longest - 1, -1, -1):
        own = ahead[k].filter(F.col("n") == k + 1)
        if kept is not None:
            own = own.unionByName(ahead[k].filter(F.col("n") > k + 1).join(stepped(kept, k, -1), ["row", "window", "pos", "off"], "left_semi"))
        kept = staged(own, "kept")
        out.append(kept)
    hits = near.limit(0)
    for states in out:
        hits = hits.unionByName(states)
    return hits.select("row", "window", F.col("pos").alias("start"), F.lit(1).alias("n"))


def contamination_rows(docs: DataFrame, items: DataFrame, size: int = WINDOW, slop: int = 0, block: int = BLOCK) -> DataFrame:
    """``contamination`` with ``row_key``, the hash of a row's columns."""
    buckets = bucket_count(docs)
    store = positional_store(docs, buckets)
    windows, owners = windows_of(items, size)
    index = inverted_index(store, windows, buckets, block)
    matches = phrase_hits(index, ranked_windows(windows, index), slop, block)

    end = F.col("start") + F.col("n")
    before = Window.partitionBy("row").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.col("start"))), F.lit(0))
    hit = (
        matches.select("row", "start", "n").distinct().withColumn("fresh", fresh)
        .groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    )
    named = (
        matches.select("row", "window").distinct().join(owners, "window").select("row", "item").distinct()
        .groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    )
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return (
        store.select("row", "doc_id", "row_key", "n_words").join(hit, "row", "left").join(named, "row", "left")
        .select(
            "doc_id",
            "row_key",
            F.col("n_words").cast("long").alias("n_words"),
            n_hit.alias("n_hit"),
            F.size(listed).cast("long").alias("n_items"),
            F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
            (n_hit > 0).alias("contaminated"),
        )
    )


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, slop: int = 0, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return contamination_rows(docs, items, size, slop, block).drop("row_key")
