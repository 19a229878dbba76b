"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes; a chunk ends where the hash has its top ``mask_bits``
bits zero (and the next byte begins a character), but not before ``shortest`` bytes and at
the latest after ``longest``. As the hash sees only the last 32 bytes, chunks fall into
step again soon after an insertion. Chunks of the same 128-bit digest and length are one;
the occurrence in the least document (id, then row, then place) stays, the others go.

The digests are computed in the tasks that read the texts. One grouped minimum (with
map-side aggregation, so a chunk in very many documents moves once per task) names the
keepers; the occurrences are joined to them by digest, a side that has one row per digest.

Defined results:
* texts count whole, as UTF-8 bytes; null is empty: no chunk, nothing dropped;
* null ids come after all others in the choice of keepers; rows that repeat a document
  lose all chunks but the first row's; each row has one result row;
* a text's last chunk may be shorter than ``shortest``; it is compared like any other, but
  chunks under ``least`` bytes are never dropped unless ``tails`` is given (the query does):
  then such a last chunk goes where it and the chunk before it occur together elsewhere, and
  a text that is one such chunk goes where another text is the same, so that exact copies
  lose all their chunks;
* an empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import staged, text_chunks, utf8_view

MASK_BITS = 6
SHORTEST, LONGEST, LEAST = 32, 1024, 32
_CHUNKS = "row long, doc_id long, n_bytes long, chunks array<struct<digest: binary, start: int, size: int>>"
_CHUNK_TYPE = pa.list_(pa.struct([("digest", pa.binary()), ("start", pa.int32()), ("size", pa.int32())]))
#: Gear values of the 256 bytes.
GEAR = np.random.default_rng(1973).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each place the sum of the gear values of the last 32 bytes, each shifted by its age."""
    h, step = GEAR[data], 1
    while step < 32:
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        step *= 2
    return h


def cut_places(data: np.ndarray, ends: np.ndarray, mask_bits: int = MASK_BITS) -> np.ndarray:
    """Places where a chunk may end (exclusive): hash bits zero and a character begins there."""
    if not len(data):
        return np.empty(0, np.int64)
    found = np.flatnonzero(gear_hashes(data) >> np.uint32(32 - mask_bits) == 0) + 1
    found = found[found < len(data)]
    found = found[(data[found] & 0xC0) != 0x80]
    # the hash must not reach back over the start of the text
    return found[found - ends[np.searchsorted(ends, found, side="left") - 1] >= 32]


def chunk_bounds(data: np.ndarray, start: int, stop: int, places: list[int], shortest: int, longest: int) -> list[int]:
    """Ends of the chunks of the text at [start, stop), in order."""
    out, at = [], start
    for p in (*places, stop):
        while p - at > longest:
            cut = at + longest
            while cut < stop and data[cut] & 0xC0 == 0x80:
                cut += 1
            out.append(cut)
            at = cut
        if p - at >= shortest or p == stop > at:
            out.append(p)
            at = p
    return out


def chunks_of(
    docs: DataFrame, mask_bits: int = MASK_BITS, shortest: int = SHORTEST, longest: int = LONGEST, tails: int = 0
) -> DataFrame:
    """(row, doc_id, n_bytes, chunks) of every row of ``docs`` (row, doc_id, text).

    The digest of a last chunk under ``tails`` bytes covers the chunk before it, too.
    """
    if shortest < 32 or longest < 2 * shortest:
        raise ValueError("shortest is at least 32 and longest at least twice that")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            data, ends = utf8_view(batch.column("text"))
            raw, places = data.tobytes(), cut_places(data, ends, mask_bits)
            split = np.searchsorted(places, ends, side="left")
            out, cuts = [], ends.tolist()
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                at, before, found = a, a, []
                for end in chunk_bounds(data, a, b, places[split[i] : split[i + 1]].tolist(), shortest, longest):
                    whence = before if end == b and end - at < tails else at
                    digest = hashlib.blake2b(raw[whence:end], digest_size=16).digest()
                    found.append({"digest": digest, "start": at - a, "size": end - at})
                    before, at = at, end
                out.append(found)
            columns = [batch.column("row"), batch.column("doc_id"), pa.array(np.diff(ends)), pa.array(out, _CHUNK_TYPE)]
            yield pa.record_batch(columns, names=["row", "doc_id", "n_bytes", "chunks"])

    return docs.select("row", "doc_id", "text").mapInArrow(run, _CHUNKS)


def dropped_chunks(chunks: DataFrame, least: int = LEAST) -> DataFrame:
    """(row, start, size, keeper) of every chunk occurrence that goes, keeper a document id."""
    each = chunks.select("row", "doc_id", F.explode("chunks").alias("c")).filter(F.col("c.size") >= least)
    each = each.select("c.digest", "c.size", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "c.start").alias("at"))
    first = each.groupBy("digest", "size").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1")
    # written out, or the join would reuse the grouping's exchange, which can't be split for a hot chunk
    first = staged(first.select("digest", "size", "first"), "keepers")
    return (
        each.join(first, ["digest", "size"])
        .filter((F.col("at.row") != F.col("first.row")) | (F.col("at.start") != F.col("first.start")))
        .select("at.row", "at.start", "size", F.col("first.doc_id").alias("keeper"))
    )


def substring_dedup(
    docs: DataFrame, mask_bits: int = MASK_BITS, shortest: int = SHORTEST, longest: int = LONGEST, least: int = LEAST,
    tails: bool = False,
) -> DataFrame:
    """One row per document.

    doc_id, n_bytes, n_chunks, n_dropped, dropped_bytes, kept_in (sorted ids of documents
    that keep what is dropped here), spans (start:stop of what is dropped, in bytes, joined
    where chunks touch, comma-separated).
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    chunks = staged(chunks_of(rows, mask_bits, shortest, longest, least if tails else 0), "chunks")
    gone = dropped_chunks(chunks, 0 if tails else least).groupBy("row").agg(
        F.count("*").alias("n"),
        F.sum("size").alias("bytes"),
        F.sort_array(F.collect_set("keeper")).alias("kept_in"),
        F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.col("size")).alias("stop")))).alias("cut"),
    )
    zero = F.lit(0).cast("long")
    return (
        chunks.select("row", "doc_id", "n_bytes", F.size("chunks").cast("long").alias("n_chunks"))
        .join(gone, "row", "left")
        .select(
            "doc_id",
            "n_bytes",
            "n_chunks",
            F.coalesce("n", zero).alias("n_dropped"),
            F.coalesce("bytes", zero).alias("dropped_bytes"),
            F.coalesce("kept_in", F.array().cast("array<bigint>")).alias("kept_in"),
            joined_spans(F.coalesce("cut", F.array().cast("array<struct<start:int,stop:int>>"))).alias("spans"),
        )
    )


def joined_spans(cut: Column) -> Column:
    """Text of sorted disjoint spans, those that touch made one."""
    blank = F.struct(F.lit("").alias("done"), F.lit(-1).alias("start"), F.lit(-1).alias("stop"))

    def text(s: Column) -> Column:
        one = F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"))
        return F.when(s["start"] < 0, F.lit("")).when(s["done"] == "", one).otherwise(F.concat(s["done"], F.lit(","), one))

    def step(s: Column, x: Column) -> Column:
        touch = s["stop"] == x["start"]
        return F.struct(
            F.when(touch, s["done"]).otherwise(text(s)).alias("done"),
            F.when(touch, s["start"]).otherwise(x["start"]).alias("start"),
            x["stop"].alias("stop"),
        )

    return F.aggregate(cut, blank, step, text)
