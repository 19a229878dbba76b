"""Exact dedup by a tree merge of sorted digest runs.

A text's key is the SHA-256 of its normalised bytes, their number, and a second hash of
them by another function (XXH3, 128 bits). Every partition turns its rows into one sorted
run of keys, equal keys already collapsed into (best row, number of rows). Runs are cut into
ranges of the digest, and go through a binomial tree: in each round the blocks are paired by
the lowest bit of their number, and the runs of a pair meet range by range. There they are
merged, not sorted again: pieces of the runs come in the order of their first keys, so what
lies before the next piece is final and is given out. At every level equal keys collapse
into the best of their rows; keys count as equal only if all three parts agree, so an
identifier that is kept has been verified beyond its digest. After log2(blocks) rounds
each range has one run. A text with copies in every partition shrinks to one entry a
block before it moves, and no range ever holds more entries than distinct texts.

Defined results:
* null text counts as empty text; null ids come after all others, and a group of only null
  ids keeps a null id (its rows compare null-safe with ``keep_id``);
* texts are compared after lower-casing A-Z only;
* rows that repeat one document (same id, same text) count in ``group_size`` and all carry
  ``kept``; :func:`survivors` leaves exactly one row of every text: of the kept id, the one
  with the least hash over its columns, so one of texts that differ in case only, too;
* an empty table gives an empty result; extra columns of the input are not looked at (but
  :func:`survivors` returns them and lets them break ties).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import ASCII_LOWER, BROADCAST_IDS, row_key, small_batches, staged, text_chunks, utf8_view

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DIGESTS = "doc_id long, digest binary, n_bytes long, second binary, row_key long"
_RUN = "bucket int, block int, first binary, entries binary"
_TEXTS = "digest binary, n_bytes long, second binary, keep_id long, row_key long, group_size long, n_keeper_rows long"
#: Digest, length and second hash, in the order of which runs are sorted, and what is known of the text.
_ENTRY = np.dtype([("key", "S56"), ("null", "?"), ("id", "<i8"), ("row", "<i8"), ("n", "<i8"), ("same", "<i8")])
#: Entries of one piece of a run, and of a run that a task builds at once.
PIECE, RUN = 4096, 1 << 19
#: Rounds after which the runs are written out, so that a lost executor costs few rounds.
ROUNDS = 4


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n_bytes, second, row_key) of every row, text lower-cased for A-Z."""

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            data, ends = utf8_view(batch.column("text"))
            low = data.tobytes().translate(ASCII_LOWER)
            cuts = ends.tolist()
            texts = [low[a:b] for a, b in zip(cuts, cuts[1:])]
            found = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            second = pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary())
            columns = [batch.column("doc_id"), found, pa.array(np.diff(ends)), second, batch.column("row_key")]
            yield pa.record_batch(columns, names=["doc_id", "digest", "n_bytes", "second", "row_key"])

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key(docs).alias("row_key")
    )
    return rows.mapInArrow(hash_rows, _DIGESTS)


def collapsed(run: np.ndarray, largest: bool) -> np.ndarray:
    """A sorted run with one entry for each key: its best row, and sums over its rows."""
    if not len(run):
        return run
    new = np.ones(len(run), dtype=bool)
    new[1:] = run["key"][1:] != run["key"][:-1]
    heads, group = np.flatnonzero(new), np.cumsum(new) - 1
    if len(heads) == len(run):
        return run
    rank = ~run["id"] if largest else run["id"]
    order = np.lexsort((run["row"], rank, run["null"], group))
    out = run[order[heads]]  # a group's places are the same before and after
    best = out[group]
    equal = (run["null"] == best["null"]) & (run["id"] == best["id"]) & (run["row"] == best["row"])
    out["n"] = np.add.reduceat(run["n"], heads)
    out["same"] = np.add.reduceat(np.where(equal, run["same"], 0), heads)
    return out


def merged(runs: list[np.ndarray]) -> np.ndarray:
    """One sorted run of several: neighbours are merged two by two, by where keys fall."""
    runs = [r for r in runs if len(r)] or runs[:1]
    while len(runs) > 1:
        pairs = []
        for a, b in zip(runs[::2], runs[1::2]):
            at = np.searchsorted(a["key"], b["key"], side="right") + np.arange(len(b))
            both, own = np.empty(len(a) + len(b), _ENTRY), np.ones(len(a) + len(b), dtype=bool)
            own[at] = False
            both[at], both[own] = b, a
            pairs.append(both)
        runs = pairs + runs[len(runs) - len(runs) % 2 :]
    return runs[0]


def _entries(batch: pa.RecordBatch) -> np.ndarray:
    out = np.zeros(batch.num_rows, _ENTRY)
    size = batch.column("n_bytes").to_numpy().astype(">i8").tobytes()
    parts = zip(batch.column("digest").to_pylist(), batch.column("second").to_pylist())
    out["key"] = [d + size[8 * i : 8 * i + 8] + s for i, (d, s) in enumerate(parts)]
    out["null"] = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
    out["id"], out["row"] = batch.column("doc_id").fill_null(0).to_numpy(), batch.column("row_key").to_numpy()
    out["n"] = out["same"] = 1
    return out


def _pieces(run: np.ndarray, block: int, ranges: int | None, bucket: int = 0) -> Iterator[pa.RecordBatch]:
    """A run as rows of at most PIECE entries; with ``ranges`` it is cut into these first."""
    if ranges is None:
        cuts, buckets = [0, len(run)], [bucket]
    else:
        lead = np.frombuffer(run["key"].tobytes(), np.uint8).reshape(len(run), -1)[:, :2].astype(np.int64)
        of = (lead[:, 0] * 256 + lead[:, 1]) * ranges // 65536
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        cuts, buckets = [*starts.tolist(), len(run)], of[starts].tolist()
    rows = [(k, run[i : min(i + PIECE, b)]) for k, a, b in zip(buckets, cuts, cuts[1:]) for i in range(a, b, PIECE)]
    for at in range(0, len(rows), 64):
        some = rows[at : at + 64]
        yield pa.record_batch(
            [
                pa.array([k for k, _ in some], pa.int32()),
                pa.array([block] * len(some), pa.int32()),
                pa.array([x[:1].tobytes()[:56] for _, x in some], pa.binary()),
                pa.array([x.tobytes() for _, x in some], pa.binary()),
            ],
            names=["bucket", "block", "first", "entries"],
        )


def _merge(batches: Iterator[pa.RecordBatch], largest: bool) -> Iterator[pa.RecordBatch]:
    """Merge pieces that come sorted by (bucket, block, first key)."""
    place, pending = None, []

    def settled(before: bytes | None) -> np.ndarray:
        """The merged entries whose keys lie before ``before``, taken out of ``pending``."""
        done, rest = [], []
        for x in pending:
            n = len(x) if before is None else int(np.searchsorted(x["key"], np.array(before, "S56")))
            done.append(x[:n])
            rest.append(x[n:])
        pending[:] = [x for x in rest if len(x)]
        return collapsed(merged(done), largest) if done else np.empty(0, _ENTRY)

    for batch in batches:
        for bucket, block, first, raw in zip(*(c.to_pylist() for c in batch.columns)):
            if (bucket, block) != place:
                if place:
                    yield from _pieces(settled(None), place[1], None, place[0])
                place = (bucket, block)
            elif sum(map(len, pending)) >= PIECE:
                yield from _pieces(settled(first), block, None, bucket)
            pending.append(np.frombuffer(raw, _ENTRY))
    if place:
        yield from _pieces(settled(None), place[1], None, place[0])


def merged_runs(found: DataFrame, keep: str = "largest", fan_in: int = 2, ranges: int | None = None) -> DataFrame:
    """One row per distinct text from ``digests()`` rows, by rounds of run merges."""
    largest = keep == "largest"
    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(ranges or 4 * tasks, 1 << 16)
    blocks = max(1, found.rdd.getNumPartitions())

    def first_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, runs = TaskContext.get().partitionId(), []

        def given() -> Iterator[pa.RecordBatch]:
            yield from _pieces(collapsed(merged(runs), largest), block, ranges)
            runs.clear()

        for batch in batches:
            if batch.num_rows:
                run = _entries(batch)
                runs.append(collapsed(run[np.argsort(run["key"], kind="stable")], largest))
                if sum(map(len, runs)) >= RUN:
                    yield from given()
        if runs:
            yield from given()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _merge(batches, largest)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in merge(batches):
            for raw in batch.column("entries").to_pylist():
                x = np.frombuffer(raw, _ENTRY)
                key = np.frombuffer(x["key"].tobytes(), np.uint8).reshape(len(x), 56)
                cut = lambda a, b, key=key: pa.array([r.tobytes() for r in key[:, a:b]], pa.binary())
                size = np.ascontiguousarray(key[:, 32:40]).view(">i8").ravel().astype(np.int64)
                columns = [cut(0, 32), pa.array(size), cut(40, 56), pa.array(x["id"], mask=x["null"])]
                columns += [pa.array(x[c]) for c in ("row", "n", "same")]
                yield pa.record_batch(columns, names=[f.split()[0] for f in _TEXTS.split(", ")])

    runs, done = found.mapInArrow(first_run, _RUN), 0
    while blocks > 1 or not done:
        blocks, done = -(-blocks // fan_in), done + 1
        runs = runs.withColumn("block", F.floor(F.col("block") / fan_in).cast("int")).repartition(tasks, "bucket", "block")
        runs = runs.sortWithinPartitions("bucket", "block", "first")
        runs = runs.mapInArrow(merge, _RUN) if blocks > 1 else runs.mapInArrow(texts, _TEXTS)  # one worker a task: merge and read out at once
        if done % ROUNDS == 0 and blocks > 1:
            runs = staged(runs, "runs")
    return runs


def _checked(keep: str) -> str:
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    return keep


def exact_dedup(docs: DataFrame, keep: str = "largest", fan_in: int = 2) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_keeper_rows.

    ``fan_in`` runs meet in a merge: 2 is the binomial tree, 4 two of its levels at once.
    """
    with small_batches(docs.sparkSession):
        found = staged(digests(docs), "digests")
    runs = staged(merged_runs(found, _checked(keep), fan_in).drop("row_key"), "texts")
    return found.join(runs, ["digest", "n_bytes", "second"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "n_keeper_rows",
    )


def survivors(docs: DataFrame, keep: str = "largest", most: int = BROADCAST_IDS) -> DataFrame:
    """``docs`` with exactly one row left of every group of equal texts, all columns kept.

    Up to ``most`` texts with copies are broadcast, so that no text moves; more meet the
    rows by a shuffle.
    """
    with small_batches(docs.sparkSession):
        found = staged(digests(docs), "digests")
    runs = merged_runs(found, _checked(keep)).filter("group_size > 1")
    names = ["_digest", "_n_bytes", "_keep_id", "_keep_row", "_n_keeper_rows"]
    groups = staged(runs.select("digest", "n_bytes", "keep_id", "row_key", "n_keeper_rows").toDF(*names), "groups")
    crowded = not groups.filter("_n_keeper_rows > 1").isEmpty()
    if groups.limit(most + 1).count() <= most:
        groups = F.broadcast(groups)
    text = F.encode(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _UPPER, _LOWER), "utf-8")
    keyed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_all"),
        F.unhex(F.sha2(text, 256)).alias("_own"),
        F.octet_length(text).cast("long").alias("_size"),
        row_key(docs).alias("_row"),
    )
    met = keyed.join(groups, (F.col("_own") == F.col("_digest")) & (F.col("_size") == F.col("_n_bytes")), "left")
    best = F.col("_all.doc_id").cast("long").eqNullSafe(F.col("_keep_id")) & (F.col("_row") == F.col("_keep_row"))
    kept = met.filter(F.col("_digest").isNull() | best)
    if crowded:  # rows that agree in all columns
        again = kept.filter("_n_keeper_rows > 1").dropDuplicates(["_digest", "_n_bytes"])
        kept = kept.filter("_n_keeper_rows is null or _n_keeper_rows = 1").unionByName(again)
    return kept.select("_all.*")
