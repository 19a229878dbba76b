"""Quality classifier by importance resampling of hashed n-gram models.

Two generative models of hashed unigrams and bigrams are counted: the raw one over every
document, the target one over the labelled documents of good quality that aren't toxic. The
importance of a document is the ratio of its chances under the two; ``log_weight`` is that
ratio's log, the sum over all its grams of log(target chance / raw chance). The target's
chances are smoothed towards the raw ones, by pseudo-counts (``priors``) and then by
``doubt`` standard errors of the log ratio: what counting a sample can make by chance is
taken off, so the common words of a long text don't drown its few bad ones. Grams too rare
to tell weigh nothing; a table with few labelled rows has many of these.

Resampling is Gumbel top-k: the keys are ``log_weight`` plus standard Gumbel noise drawn
from the document, and the ``k`` largest keys are selected, which draws k documents without
replacement with chances in proportion to their importance. ``k`` is a parameter. By
default it is the number of documents whose log_weight reaches the cut that parts good from
bad labelled documents best, a lost good one counting ``KEEP_WEIGHT`` times; only the size
comes from there, which documents are taken is up to weights and noise. The cut is read off
labelled documents that are held out of the target model: one whose own words are in the
model looks better than it is.

Bounds: ``MAX_LABELLED`` labelled rows (taken by id hash) are broadcast and used for the
target model and the cut; everything else is counted over all documents. The models have a
fixed number of buckets, so what reaches the driver does not grow with the corpus.

Defined results:
* labels with a null id, or null in both marks, are passed over; an id labelled more than
  once is good only if all its labels say so; without any good label all weights are 0, and
  without labels of both sorts among those held out k is the number of documents;
* null or wordless text has weight 0; each row has one result row; repeated rows share
  their weight and noise;
* exactly k rows are selected: equal keys are taken in the order of id (null last) and then
  of place in the table; an empty table gives an empty result; extra columns are not looked
  at, but tell rows of one id apart in their noise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import BLOCK_SCHEMA, block_batch, row_key, small_batches, staged, sum_blocks, text_chunks, utf8_view
from tidewater.llm.tokens import Tokens, mixed, per_text, tokens_of

#: Bits of the hash, and pseudo-counts that hold the target near the raw model, of unigrams and bigrams.
BITS, PRIORS = (20, 18), (1.0, 1.0)
#: Standard errors of a log ratio that are put down to chance.
DOUBT = 4.0
STARTS = np.cumsum([0, *(1 << b for b in BITS)]).tolist()
BUCKETS = STARTS[-1]
MAX_LABELLED = 50_000
#: How much a lost good document counts against a kept bad one when the sample's size is chosen.
KEEP_WEIGHT = 5.0
#: Tenths of the labelled sample that are held out of the target model.
HELD_OUT = 3
_BLOCKS = 40
_LAST = (1 << 63) - 1


def labelled_sample(labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """(label_id, good, held) of at most ``most`` ids, in the order of their hash."""
    bad = (F.coalesce("quality", F.lit(1)) < 1) | (F.coalesce("toxic", F.lit(0)) > 0)
    rows = labels.filter("doc_id is not null and (quality is not null or toxic is not null)")
    ids = rows.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min((~bad).cast("int")).alias("good"))
    held = F.pmod(F.xxhash64("label_id", F.lit(1)), F.lit(10)) < HELD_OUT
    return ids.orderBy(F.xxhash64("label_id"), "label_id").limit(most).withColumn("held", held)


def _grams(t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unigram buckets, bigram buckets, and where a token has a bigram (with the next one)."""
    pair = mixed(t.code[:-1] * np.uint64(0x9E3779B97F4A7C15) + t.code[1:])
    uni, bi = ((code >> np.uint64(64 - bits)).astype(np.int64) + start for code, bits, start in zip((t.code, pair), BITS, STARTS))
    return uni, bi, t.text[1:] == t.text[:-1]


def gram_counts(docs: DataFrame) -> np.ndarray:
    """Raw and target counts of every bucket over all documents.

    ``docs`` has (text, good), good being 1 for documents of the target.
    """
    width = -(-BUCKETS // _BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, _BLOCKS * width), dtype=np.int64)
        for batch in text_chunks(batches):
            data, ends = utf8_view(batch.column("text"))
            good = batch.column("good").fill_null(0).to_numpy() == 1
            t = tokens_of(data, ends)
            uni, bi, paired = _grams(t)
            for grams, text in ((uni, t.text), (bi[paired], t.text[1:][paired])):
                counts[0] += np.bincount(grams, minlength=counts.shape[1])
                counts[1] += np.bincount(grams[good[text]], minlength=counts.shape[1])
        parts = counts.reshape(2, _BLOCKS, width).transpose(1, 0, 2)
        yield block_batch([x.ravel() for x in parts], TaskContext.get().partitionId())

    each = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "good")
    counts = np.zeros((2, _BLOCKS, width))
    for block, total in sum_blocks(each.mapInArrow(run, BLOCK_SCHEMA), 2 * width).items():
        counts[:, block] = total.reshape(2, width)
    return counts.reshape(2, -1)[:, :BUCKETS]


def gram_weights(docs: DataFrame, sample: DataFrame, priors: Sequence[float] = PRIORS, doubt: float = DOUBT) -> np.ndarray:
    """Log ratio of smoothed target to raw chance per bucket; zeros if there is no target text."""
    marked = docs.select("doc_id", "text").join(F.broadcast(sample), docs["doc_id"].cast("long") == F.col("label_id"), "left")
    target = (F.col("good") * (~F.col("held")).cast("int")).alias("good")
    raw, target = gram_counts(marked.select("text", target))
    weights = np.zeros(BUCKETS, dtype=np.float32)
    for a, b, prior in zip(STARTS, STARTS[1:], priors):
        if target[a:b].sum():
            rate = target[a:b].sum() / raw[a:b].sum()
            expected = raw[a:b] * rate + prior
            ratio = np.log((target[a:b] + prior) / expected)
            chance = doubt * np.sqrt((1 - rate) / expected)
            weights[a:b] = np.sign(ratio) * np.maximum(np.abs(ratio) - chance, 0)
    return weights


def log_weights(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, row_key, log_weight): the log importance of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in text_chunks(batches):
            data, ends = utf8_view(batch.column("text"))
            t = tokens_of(data, ends)
            uni, bi, paired = _grams(t)
            value = w[uni].astype(np.float64)
            value[:-1] += np.where(paired, w[bi], 0)
            columns = [batch.column("doc_id"), batch.column("row_key"), pa.array(per_text(value, t.text, batch.num_rows))]
            yield pa.record_batch(columns, names=["doc_id", "row_key", "log_weight"])

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, row_key(docs).alias("row_key"))
    return rows.mapInArrow(run, "doc_id long, row_key long, log_weight double")


def choose_cut(weight: np.ndarray, good: np.ndarray, keep_weight: float = KEEP_WEIGHT) -> float:
    """The weight that parts good from bad labelled documents best; -inf without both sorts."""
    if good.all() or not good.any():
        return -math.inf
    tried = np.unique(weight)
    lost = np.searchsorted(np.sort(weight[good]), tried, side="left") / good.sum()
    caught = np.searchsorted(np.sort(weight[~good]), tried, side="left") / (~good).sum()
    return float(tried[int(np.argmax(caught - keep_weight * lost))])


def kth_row(rows: DataFrame, order: Sequence[str], k: int, small: int = 4096, bins: int = 1024) -> tuple:
    """The k-th row's values of ``order``, ascending: exact, by histograms.

    Each round counts the values of the interval that holds the k-th row in ``bins`` bins,
    and goes on with its bin, until ``small`` rows are left or all tie; ties are told apart
    by the next column in the same way, the last being unique.
    """
    inside, found = rows.select(*order), []
    for name in order:
        while True:
            low, high, n = inside.agg(F.min(name), F.max(name), F.count("*")).first()
            if n <= small or low == high:
                break
            wide = (F.col(name).cast("double") - float(low)) / (float(high) - float(low)) * bins
            part = F.greatest(F.lit(0), F.least(F.floor(wide), F.lit(bins - 1))).alias("bin")
            counts = inside.groupBy(part).agg(F.count("*").alias("n"), F.min(name).alias("lo"), F.max(name).alias("hi"))
            for row in sorted(counts.collect()):  # at most ``bins`` rows
                if row["n"] >= k:
                    break
                k -= row["n"]
            inside = inside.filter(F.col(name).between(row["lo"], row["hi"]))
            if len(counts.head(2)) == 1:  # a double can't part what is left: take halves of the whole range
                middle = low + (high - low) / 2 if isinstance(low, float) else low + (high - low) // 2
                below = inside.filter(F.col(name) <= middle).count()
                inside = inside.filter(F.col(name) <= middle if below >= k else F.col(name) > middle)
                k -= 0 if below >= k else below
        if n <= small:
            last = sorted(tuple(r) for r in inside.orderBy(*order).limit(k).collect())[-1]
            return (*found, *last[len(found) :])
        found.append(low)
        inside = inside.filter(F.col(name) == F.lit(low))
    return tuple(found)


def _gumbel(seed: int) -> Column:
    bits = F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1)), "row_key").bitwiseAND(F.lit((1 << 52) - 1))
    return -F.log(-F.log((bits + 0.5) / float(1 << 52)))


def quality_rows(
    docs: DataFrame,
    labels: DataFrame,
    k: int | None = None,
    priors: Sequence[float] = PRIORS,
    doubt: float = DOUBT,
    max_labelled: int = MAX_LABELLED,
    seed: int = 7,
) -> DataFrame:
    """``quality_verdicts`` with ``row_key``, the hash of a row's columns."""
    sample = staged(labelled_sample(labels, max_labelled), "labelled")
    place = F.monotonically_increasing_id().alias("place")
    with small_batches(docs.sparkSession):
        scored = log_weights(docs, gram_weights(docs, sample, priors, doubt))
        keyed = staged(scored.select("*", (F.col("log_weight") + _gumbel(seed)).alias("gumbel_key"), place), "keys")
    if k is None:
        known = keyed.join(F.broadcast(sample.filter("held")), F.col("doc_id") == F.col("label_id"))
        seen = known.groupBy("label_id").agg(F.min("log_weight").alias("w"), F.min("good").alias("good")).toPandas()
        cut = choose_cut(seen["w"].to_numpy(), seen["good"].to_numpy() == 1)
        k = keyed.filter(F.col("log_weight") >= cut).count()
    names = ["_last_key", "_last_id", "_last_place"]
    order = [-F.col("gumbel_key"), F.coalesce("doc_id", F.lit(_LAST)), F.col("place")]
    ranked = keyed.select(*(c.alias(n) for c, n in zip(order, names)))
    n = keyed.count()
    if k <= 0 or k >= n:
        selected = F.lit(k > 0)
    else:
        last = kth_row(ranked, names, k)
        kinds = ("double", "long", "long")
        selected = F.struct(*(c.alias(n) for c, n in zip(order, names))) <= F.struct(*(F.lit(v).cast(t).alias(n) for v, t, n in zip(last, kinds, names)))
    return keyed.select("doc_id", "row_key", "log_weight", "gumbel_key", selected.alias("selected"))


def quality_verdicts(docs: DataFrame, labels: DataFrame, k: int | None = None, **options) -> DataFrame:
    """One row per document: doc_id, log_weight, gumbel_key, selected.

    ``k`` is the sample's size, by default read off the labelled sample (see above).
    """
    return quality_rows(docs, labels, k, **options).drop("row_key")
