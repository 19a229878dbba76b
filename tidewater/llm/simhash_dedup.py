"""SimHash near-duplicates by generalised pigeonhole search.

Fingerprints of 64 bits come from word shingles. Two fingerprints within ``distance`` bits
must, for some part i of the bits, differ in at most t_i bits of that part, for any
thresholds with sum(t_i) = distance - parts + 1. The bits are dealt into parts so that
correlated bits share a part, and a dynamic program picks the thresholds that cost least,
from candidate counts estimated over all distinct fingerprints. Each fingerprint is indexed
by its part values and probes the values within t_i of its own; the join compares whole
fingerprints before it gives out a row, so only true links leave it.

Buckets with more than ``bucket_limit`` members would be compared at a quadratic cost. Their
members are linked in another exact way: each gives out the points within distance/2 of
it, and all members that share a point are linked to the least of them. Two fingerprints
within ``distance`` share such a point, and two that share one are within ``distance``.

Defined results:
* A-Z are lower-cased; words are runs of bytes other than space and \\x09-\\x0D;
* a text of 1 to shingle-1 words has its whole word sequence as the one shingle; an empty,
  blank or null text has fingerprint zero and is linked like any other;
* a bit is set if it is set in more than half of the shingle hashes;
* ``component_id`` is the least id of the component (null ids are passed over; null if
  there is no other), each row of the input has one row in the result, repeated rows too;
* an empty table gives an empty result; extra columns of the input are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.components import components
from tidewater.llm.shared import ASCII_LOWER, row_key, small_batches, staged, text_chunks, utf8_view

BITS = 64
SHINGLE = 4
DISTANCE = 4
HASH_SEED = 42
#: Members of one part value beyond which they are linked through shared midpoints.
BUCKET_LIMIT = 2000
#: Cost of giving out one probe row, in comparisons of two fingerprints within a bucket.
PROBE_COST = 40.0


def _long(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _shingle_hashes(low: bytes, shingle: int) -> list[int]:
    words = low.split()
    if not words:
        return []
    line, hash_of = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [hash_of(line, HASH_SEED)]
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))).tolist()
    starts = [0, *(e + 1 for e in ends[:-shingle])]
    return [hash_of(line[a:b], HASH_SEED) for a, b in zip(starts, ends[shingle - 1 :])]


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, row_key, fp) of every row; fp holds the 64 bits as a signed long, row_key hashes the row's columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            data, ends = utf8_view(batch.column("text"))
            low, cuts = data.tobytes().translate(ASCII_LOWER), ends.tolist()
            found = [_shingle_hashes(low[a:b], shingle) for a, b in zip(cuts, cuts[1:])]
            out = np.zeros(len(found), dtype=np.uint64)
            some = [i for i, x in enumerate(found) if x]
            if some:
                n = np.array([len(found[i]) for i in some])
                flat = np.array([h for i in some for h in found[i]], dtype="<u8")
                bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                set_in = np.add.reduceat(bits, np.cumsum(n) - n, axis=0, dtype=np.int64)
                packed = np.packbits(set_in * 2 > n[:, None], axis=1, bitorder="little")
                out[some] = packed.view("<u8").ravel()
            columns = [batch.column("doc_id"), batch.column("row_key"), pa.array(out.view(np.int64))]
            yield pa.record_batch(columns, names=["doc_id", "row_key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key(docs).alias("row_key"))
    return rows.mapInArrow(run, "doc_id long, row_key long, fp long")


def bit_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of distinct fingerprints and the 64 x 64 table of bits set together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            fp = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False).astype("<i8"))
            for at in range(0, len(fp), 1 << 16):
                part = fp[at : at + (1 << 16)]
                bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
            n += len(fp)
        row, col = np.divmod(np.arange(BITS * BITS), BITS)
        yield pa.record_batch(
            [pa.array(np.append(row, -1)), pa.array(np.append(col, -1)), pa.array(np.append(total.ravel(), n).astype(np.int64))],
            names=["i", "j", "n"],
        )

    sums = distinct.select("fp").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    table, n = np.zeros((BITS, BITS)), 0
    for i, j, k in sums.collect():  # 4,097 rows at most
        if i < 0:
            n = k
        else:
            table[i, j] = k
    return n, table


def group_bits(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Deal the bits into parts of even size, correlated bits into the same part."""
    p = np.diag(together) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    left, out = set(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k) + (len(left) % (parts - k) > 0)
        group = [max(sorted(left), key=lambda b: corr[b, sorted(left)].sum())]
        left.remove(group[0])
        while len(group) < size:
            best = max(sorted(left), key=lambda b: corr[b, group].sum())
            group.append(best)
            left.remove(best)
        out.append(sorted(group))
    return out


def _within(share: np.ndarray, group: list[int], most: int) -> np.ndarray:
    """Chance that two fingerprints differ in at most 0..most bits of a group.

    The number of bits in which two differ has its mean and variance from the chances of
    single bits and of pairs of bits (``share``), so from their correlation too; its
    distribution is taken to be the beta-binomial with these.
    """
    n, p = len(group), np.diag(share)[group]
    both = share[np.ix_(group, group)]
    one, none = p[:, None] - both, 1 - p[:, None] - p[None, :] + both
    apart = 2 * (both * none + one * one.T)  # both bits of a pair differ
    single = 2 * p * (1 - p)
    np.fill_diagonal(apart, single)
    mean = min(max(single.mean(), 1e-6), 1 - 1e-6)
    spread = max((apart - np.outer(single, single)).sum(), 1e-12) / (n * mean * (1 - mean))
    tied = min(max((spread - 1) / max(n - 1, 1), 1e-6), 1 - 1e-6)
    a, b = mean * (1 / tied - 1), (1 - mean) * (1 / tied - 1)
    beta = lambda x, y: math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y)
    ways = [math.log(math.comb(n, k)) + beta(k + a, n - k + b) - beta(a, b) for k in range(min(most, n) + 1)]
    return np.minimum(np.cumsum(np.exp(ways)), 1.0)


def thresholds(n: int, share: np.ndarray, groups: list[list[int]], distance: int) -> tuple[float, list[int]]:
    """Cheapest t_i >= -1 with sum(t_i) = distance - parts + 1, by dynamic programming."""
    budget = distance + 1  # in units of t_i + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for group in groups:
        near = _within(share, group, distance)
        cost = [0.0]
        for t in range(budget):
            probes = sum(math.comb(len(group), k) for k in range(t + 1))
            cost.append(n * (probes + 1) * PROBE_COST + n * n * float(near[min(t, len(near) - 1)]))
        then: dict[int, tuple[float, list[int]]] = {}
        for used, (so_far, ts) in best.items():
            for more in range(budget - used + 1):
                total = so_far + cost[more]
                if used + more not in then or total < then[used + more][0]:
                    then[used + more] = (total, [*ts, more - 1])
        best = then
    return best[budget]


def plan(n: int, together: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    """Parts of the bits with their thresholds, over the part counts 2 to distance + 1."""
    tried = []
    for parts in range(2, distance + 2):
        groups = group_bits(n, together, parts)
        cost, ts = thresholds(n, together / max(n, 1), groups, distance)
        tried.append((cost, parts, list(zip(groups, ts))))
    return [x for x in min(tried)[2] if x[1] >= 0]


def _masks(bits: list[int], most: int) -> list[int]:
    out, level = [0], [(0, -1)]
    for _ in range(most):
        level = [(m | 1 << bits[j], j) for m, i in level for j in range(i + 1, len(bits))]
        out += [m for m, _ in level]
    return out


def _flipped(part: int, own: Column) -> Callable[[Column], Column]:
    return lambda flip: F.struct(F.lit(part).alias("part"), own.bitwiseXOR(flip).alias("value"))


def _keys(nodes: DataFrame, chosen: list[tuple[list[int], int]], probe: bool) -> DataFrame:
    """(fp, part, value) rows: each part's own value, or with ``probe`` those within t_i too."""
    made = []
    for part, (bits, t) in enumerate(chosen):
        own = F.col("fp").bitwiseAND(F.lit(_long(sum(1 << b for b in bits))))
        flips = [_long(m) for m in _masks(bits, t if probe else 0)]
        made.append(F.transform(F.array(*map(F.lit, flips)), _flipped(part, own)))
    rows = made[0] if len(made) == 1 else F.concat(*made)
    return nodes.select("fp", F.explode(rows).alias("k")).select("fp", "k.part", "k.value")


def links(nodes: DataFrame, distance: int = DISTANCE, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Links (a, b) that join every two distinct fingerprints within ``distance`` bits.

    Members of large buckets are linked by chains of true links, so components are exact.
    """
    n, together = bit_counts(nodes)
    chosen = plan(n, together, distance)
    index, probes = _keys(nodes, chosen, False), _keys(nodes, chosen, True)
    hot = staged(
        index.groupBy("part", "value").agg(F.count("*").alias("n")).filter(F.col("n") > bucket_limit).drop("n"), "hot"
    )
    crowded = not hot.isEmpty()
    if crowded:
        index = index.join(hot, ["part", "value"], "left_anti")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    a, b = index.withColumnRenamed("fp", "a"), probes.withColumnRenamed("fp", "b")
    found = a.join(b, (a.part == b.part) & (a.value == b.value) & (F.col("a") < F.col("b")) & near).select("a", "b")
    if not crowded:
        return found
    members = probes.join(hot, ["part", "value"], "left_semi").select("fp").distinct()
    flips = [_long(m) for m in _masks(list(range(BITS)), (distance + 1) // 2)]
    points = members.select("fp", F.explode(F.array(*map(F.lit, flips))).alias("flip"))
    points = points.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("b"))
    # Spark's size estimate doesn't know of the thousands of points of a member: by it, it would broadcast them all
    linked = points.hint("merge").join(least.hint("merge"), "point").filter("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    return found.unionByName(linked)


def near_duplicate_rows(
    docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, bucket_limit: int = BUCKET_LIMIT
) -> DataFrame:
    """``near_duplicates`` with ``row_key``, the hash of a row's columns, and ``root``, a number of the component."""
    if bucket_limit < 1 or distance % 2:
        raise ValueError("distance is even and bucket_limit at least 1")
    with small_batches(docs.sparkSession):
        rows = staged(fingerprints(docs, shingle), "fingerprints")
    nodes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
    roots = components(links(nodes, distance, bucket_limit))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = staged(named, "roots")
    # written out, or the join would reuse the grouping's exchange, which can't be split for a huge component
    least = staged(named.groupBy("root").agg(F.min("least_id").alias("component_id")), "least")
    of_fp = named.join(least, "root").select("fp", "component_id", "root")
    return rows.join(of_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "row_key", "root"
    )


def near_duplicates(
    docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, bucket_limit: int = BUCKET_LIMIT
) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    return near_duplicate_rows(docs, distance, shingle, bucket_limit).drop("row_key", "root")


def representatives(rows: DataFrame) -> DataFrame:
    """(doc_id, row_key) of one row of each component: the least id's (null last), then the least hash."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first")
    return rows.groupBy("root").agg(first).select("first.doc_id", "first.row_key")
