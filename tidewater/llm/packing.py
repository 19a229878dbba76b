"""Packing token streams into windows by sum-of-squares online placement.

Each task packs the documents of its own partition, so no text moves. A document is its
token ids and one end id. Whole windows are cut off it first; what is left is an item of
1 to window-1 ids. The level array holds how many partially filled windows stand at each
fill level; an item goes to the level (an empty window counts as level 0) for which the
sum of the squared counts is least afterwards, ties to the fuller level.

When a partition ends, the emptiest open windows are poured into the gaps of the fullest
ones, cutting pieces where a gap ends, and what is left of the last one is laid out in
sequences whose lengths are powers of two, which need no padding. A task holds only its
open windows (at most one per level and surplus item) in memory, and its table of pieces,
which it lets go at its end: a worker that goes on to other work holds nothing of it.

Defined results:
* a null or empty text is one id, the end id; ids are those of the ``tokenizers`` library
  without special tokens put in (an added token that stands in a text is found there);
* every id of every input row lies in exactly one piece; repeated rows are packed again;
* a null id is carried as null; an empty table gives an empty result; other columns of the
  input are not looked at; sequence ids are unique, not dense, and depend on the layout of
  the input's partitions (a retried task gives the same ones).
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import text_chunks

WINDOW = 1024
END_ID = 0
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
#: Pieces that are given out together.
_ROWS = 20_000


def _byte_characters() -> dict[int, int]:
    """The character for each byte in a byte-level vocabulary: itself if it can be seen, else one from 256 on."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in seen)}


_BYTES = _byte_characters()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder(dict):
    """Token ids of the library; those of the pieces it cuts texts into are kept for the next time.

    A byte-level vocabulary with the usual pattern never joins bytes over the ends of a
    piece, so the ids of a text are those of its pieces. That way is taken for texts of the
    characters below, for which the pattern is spelt out; texts with others, or with an
    added token, go to the library whole. A piece not met before goes straight to the
    library's merges, each byte as the character that stands for it there. The dictionary
    maps pieces to the bytes of their ids.
    """

    #: Pieces that are kept before those not met again lately are let go, and the longest such piece.
    KEPT, LONGEST = 1 << 18, 64
    # Letters, numbers and white space below U+0250, and the pattern over them.
    LETTERS, NUMBERS, SPACE = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t\n\r \xa0"
    PATTERN = rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACE}{LETTERS}{NUMBERS}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
    KNOWN = "\t\n\r\x20-\x7e\xa0-\u024f"

    def __init__(self, vocabulary: str) -> None:
        self.library = tokenizers.Tokenizer.from_file(vocabulary)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        kind = self.library.pre_tokenizer
        usual = isinstance(kind, tokenizers.pre_tokenizers.ByteLevel) and kind.use_regex and not kind.add_prefix_space
        usual = usual and self.library.normalizer is None and self.library.truncation is None
        self.older: dict[str, bytes] = {}
        self.merged = self.library.model.tokenize
        self.pieces = re.compile(self.PATTERN).findall
        self.odd = re.compile(f"[^{self.KNOWN}]" if usual else "(?s:.)").search

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            found = [t.id for t in self.merged(piece.encode().decode("latin-1").translate(_BYTES))]
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(piece) <= self.LONGEST:
            if len(self) >= self.KEPT:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def forget(self) -> None:
        """Let all pieces go."""
        self.clear()
        self.older = {}

    def __call__(self, text: str) -> np.ndarray:
        if self.odd(text) or any(t in text for t in self.added):
            return np.array(self.whole(text), dtype="<u4")
        return np.frombuffer(b"".join(map(self.__getitem__, self.pieces(text))), dtype="<u4")


@cache
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


class Levels:
    """Open windows by fill level, and where the next item goes."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.open: list[list[list]] = [[] for _ in range(window + 1)]

    def level_for(self, size: int) -> int:
        held = self.counts[: self.window - size + 1]
        after = self.counts[size : self.window + 1]
        change = 2 * after + 1 - 2 * held + 1  # one window moves from level h to h + size
        change[-1] -= 2 * after[-1] + 1  # a full window leaves the array
        change[1:][held[1:] == 0] = np.iinfo(np.int64).max
        change[0] += 2 * held[0] - 1  # a new window leaves no level
        return len(change) - 1 - int(np.argmin(change[::-1]))

    def place(self, piece: tuple) -> list | None:
        """Put ``piece`` (its length comes third) into a window; the window, if now full."""
        size = piece[2]
        level = self.level_for(size)
        window = self.open[level].pop() if level else []
        window.append(piece)
        self.counts[level] -= level > 0
        if level + size == self.window:
            return window
        self.counts[level + size] += 1
        self.open[level + size].append(window)
        return None

    def drained(self) -> Iterator[list]:
        """The open windows' pieces in sequences without gaps, the rest by powers of two."""
        left = [(level, w) for level in range(self.window, 0, -1) for w in self.open[level]]
        i, j = 0, len(left) - 1
        while i < j:
            level, target = left[i]
            gap = self.window - level
            while gap and j > i:
                held, donor = left[j]
                moved, rest = _cut(donor.pop(), gap)
                target.append(moved)
                gap -= moved[2]
                if rest is not None:
                    donor.append(rest)
                left[j] = (held - moved[2], donor)
                j -= not donor
            left[i] = (self.window - gap, target)
            if not gap:
                yield target
                i += 1
        if i == j:
            level, rest = left[i]
            while level:
                size, out = 1 << level.bit_length() - 1, []
                level -= size
                while size:
                    moved, more = _cut(rest.pop(), size)
                    out.append(moved)
                    size -= moved[2]
                    if more is not None:
                        rest.append(more)
                yield out


def _cut(piece: tuple, size: int) -> tuple[tuple, tuple | None]:
    """The first ``size`` ids of a piece, and the others if there are any."""
    doc, start, length, ids, total = piece
    if length <= size:
        return piece, None
    return (doc, start, size, ids[:size], total), (doc, start + size, length - size, ids[size:], total)


def _packed(batches: Iterator[pa.RecordBatch], window: int, vocabulary: str) -> Iterator[pa.RecordBatch]:
    encode, levels = encoder(vocabulary), Levels(window)
    sequence = TaskContext.get().partitionId() << 33
    rows: list[tuple] = []

    def lay(pieces: list) -> None:
        nonlocal sequence
        at = 0
        for doc, start, length, ids, total in pieces:
            rows.append((doc, start, length, zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, at))
            at += length
        sequence += 1

    def given() -> pa.RecordBatch:
        columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
        rows.clear()
        return pa.record_batch(columns, names=[f.split()[0] for f in SCHEMA.split(", ")])

    try:
        for batch in text_chunks(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(END_ID))
                total = len(ids)
                whole = total - total % window
                for start in range(0, whole, window):
                    lay([(doc, start, window, ids[start : start + window], total)])
                if whole < total and (full := levels.place((doc, whole, total - whole, ids[whole:].copy(), total))):
                    lay(full)
                if len(rows) >= _ROWS:
                    yield given()
        for pieces in levels.drained():
            lay(pieces)
        if rows:
            yield given()
    finally:
        encode.forget()


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packed(batches, window, path)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)
