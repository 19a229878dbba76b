"""Removal of repeated byte strings by a distributed merge sort of sampled suffixes.

A string that starts at p is judged by its anchor: the leftmost least hash of 16-byte
strings among the ``window`` places from p on. The anchor depends on the string's own bytes
only, so equal strings have their anchors at equal offsets, and the suffixes at anchors
stand for all strings of ``short`` bytes or more.

1. Every document gives out its anchors, each with the places p it stands for and a hash
   of the ``short - window + 1`` bytes that follow it. Anchors whose hash is alone in the
   corpus are dropped; no repeated string has such an anchor.
2. The suffixes of the others are cut from the texts, sorted within a task into runs, and
   each run is front-coded: a suffix is kept as the length of the prefix it shares with the
   one before it and the bytes that follow. Runs are exchanged by the hash of step 1, so
   suffixes that can match meet. There a loser tree merges them: it knows how long a prefix
   each candidate shares with the last suffix given out, decides by that alone where the
   lengths differ, and reads bytes only from where they are equal. The merge leaves each
   suffix's common prefix with the one before it.
3. Suffixes that share at least ``short - window + 1`` bytes form a group. A string at one
   of their places is repeated if another suffix shares its bytes after the anchor (known
   from the common prefixes) and before it. Which two to look at is found by a hash of the
   whole string; what counts is the bytes: a pair's common prefix and its common left side.
   Where a hash has brought different strings together, these are told apart by their bytes.

A key with more than ``hot_limit`` suffixes is split before the merge. Suffixes that agree
in all their bytes, left side too, (by a 128-bit BLAKE2 digest of them) are one content: it
is counted by a shuffle with map-side aggregation, and one suffix of each content goes on.
Should a key still have more than ``hot_limit`` contents, their strings are given out one by
one and counted by such digests.

Texts are written once to the shared folder, bucketed by row, so that the two times they
meet a table keyed by row they aren't moved again.

Defined results:
* texts are judged whole and as UTF-8 bytes; null counts as empty; a string must lie in one
  document; strings that start at two places of the same document count; overlaps count;
* all bytes of every string of ``length`` bytes that occurs twice go, on the input as it is
  given: no copy is kept;
* strings from ``short`` bytes on are found, too, and only reported: ``n_passages`` counts
  the runs of bytes covered by them that hold at least ``PASSAGE_WORDS`` words;
* a text shorter than ``short`` has no strings; repeated rows are separate documents, so
  each is a copy of the other; null ids are carried; an empty table gives an empty result;
  extra columns are not looked at; a long text is worked on in pieces, with the same result.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import bucket_count, bucketed, staged, text_chunks, utf8_view

LENGTH, SHORT = 400, 288
WINDOW = 192
GRAM = 16
#: Words of a reported passage.
PASSAGE_WORDS = 50
#: Suffixes with one key beyond which it is split.
HOT_LIMIT = 20_000
#: Suffix bytes of one sorted run, and of the runs that one merge takes in.
RUN_BYTES = 4 << 20
MERGE_BYTES = 12 << 20
#: Text bytes of one numpy step.
CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15

_ANCHORS = "row long, at int, first int, last int, key long"
_RUNS = "part int, run long, packed binary"
_SPANS = "row long, start int, stop int, short_start int, short_stop int"
_NAMES = [f.split()[0] for f in _SPANS.split(", ")]


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling hash's base and of its inverse modulo 2^64."""
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, dtype=np.uint64), np.full(n, inverse, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@cache
def _byte_codes() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


class Rolling:
    """Hashes of substrings of one buffer, modulo 2^64."""

    def __init__(self, data: np.ndarray) -> None:
        kept = 2 * CHUNK_BYTES + 2  # a long single text's are made for it
        up, self.down = _powers(kept) if len(data) < kept else _powers.__wrapped__(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_byte_codes()[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.down[start]


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the GRAM bytes from each place on (too few bytes: the largest value)."""
    h = (_byte_codes()[data] >> np.uint64(32)).astype(np.uint32)
    n, step, factor = len(data), 1, 0x85EBCA6B
    while step < GRAM:
        h = h[: len(h) - step] * np.uint32(factor) + h[step:] if len(h) > step else h[:0]
        factor, step = factor * factor & 0xFFFFFFFF, step * 2
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return np.concatenate([h, np.full(n - len(h), 0xFFFFFFFF, np.uint32)])


def anchors_of(data: np.ndarray, ends: np.ndarray, short: int, window: int) -> tuple[np.ndarray, ...]:
    """Anchors of texts laid end to end: place, first and last string start, text number."""
    if len(data) < short:
        return (np.empty(0, np.int64),) * 4
    least = _gram_hashes(data).astype(np.uint64) << np.uint64(32) | np.arange(len(data), dtype=np.uint64)
    step = 1
    while step < window:
        more = min(step, window - step)
        least = np.minimum(least[: len(least) - more], least[more:])
        step += more
    starts = np.arange(len(data) - short + 1)
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[: len(starts)]
    inside = starts + short <= ends[text + 1]
    starts, text = starts[inside], text[inside]
    place = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(place), dtype=bool)
    new[1:] = place[1:] != place[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(place)) - 1 if len(at) else at
    return place[at], starts[at], starts[last], text[at]


def _pieces(batch: pa.RecordBatch, short: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Bytes, bounds and offset of the batch; a single long text in pieces that overlap."""
    data, ends = utf8_view(batch.column("text"))
    if batch.num_rows > 1 or len(data) <= 2 * CHUNK_BYTES:
        yield data, ends, 0
        return
    for at in range(0, len(data) - short + 1, CHUNK_BYTES):
        piece = data[at : at + CHUNK_BYTES + short - 1]
        yield piece, np.array([0, len(piece)]), at


def anchors(texts: DataFrame, short: int = SHORT, window: int = WINDOW) -> DataFrame:
    """(row, at, first, last, key) of every anchor, places counted within the text."""
    core = short - window + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, limit=CHUNK_BYTES):
            for data, ends, offset in _pieces(batch, short):
                at, first, last, text = anchors_of(data, ends, short, window)
                if not len(at):
                    continue
                key, base = Rolling(data).of(at, at + core), ends[text] - offset
                rows = batch.column("row").to_numpy()[text]
                columns = [rows, (at - base).astype(np.int32), (first - base).astype(np.int32)]
                columns += [(last - base).astype(np.int32), key.view(np.int64)]
                yield pa.record_batch(list(map(pa.array, columns)), names=["row", "at", "first", "last", "key"])

    return texts.select("row", "text").mapInArrow(run, _ANCHORS)


def _shared_from(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of ``a`` and ``b``, known to be at least ``at``."""
    most = min(len(a), len(b))
    if a[at:most] == b[at:most]:
        return most
    while a[at : at + 32] == b[at : at + 32]:
        at += 32
    x = int.from_bytes(a[at : at + 32], "little") ^ int.from_bytes(b[at : at + 32], "little")
    return min(at + ((x & -x).bit_length() - 1) // 8, most)


def front_coded(strings: list[bytes]) -> tuple[np.ndarray, bytes, np.ndarray]:
    """Shared prefix lengths, the remaining bytes, and their lengths, of sorted strings."""
    shared, before = np.zeros(len(strings), dtype=np.int32), b""
    for i, s in enumerate(strings):
        shared[i] = _shared_from(before, s, 0)
        before = s
    tails = [s[k:] for s, k in zip(strings, shared.tolist())]
    return shared, b"".join(tails), np.fromiter(map(len, tails), np.int32, len(tails))


def _decoded(shared: list[int], tails: bytes, sizes: list[int]) -> Iterator[tuple[bytes, int]]:
    at, before = 0, b""
    for k, n in zip(shared, sizes):
        before = before[:k] + tails[at : at + n]
        at += n
        yield before, k


def merged(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[int, bytes, int]]:
    """(run, suffix, prefix shared with the one before) in order, by a loser tree.

    ``runs`` give sorted suffixes, each with the prefix it shares with its predecessor.
    A tree node holds the loser of its match and the prefix the loser shares with the
    winner; the last winner being the last suffix given out, all candidates on the path
    that is played again know their shared prefix with it. The longer one is smaller; only
    equal ones are read, from that length on.
    """
    size = 1 << max(1, (len(runs) - 1).bit_length())
    done = (None, -1)
    heads = [next(r, done) for r in runs] + [done] * (size - len(runs))

    def match(a: int, b: int) -> tuple[int, int]:
        (x, k), (y, m) = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if k != m:
            return (a, b) if k > m else (b, a)
        both = _shared_from(x, y, k)
        if (x[both : both + 1], a) <= (y[both : both + 1], b):
            heads[b] = (y, both)
            return a, b
        heads[a] = (x, both)
        return b, a

    tree = [0] * size
    row, at = list(range(size)), size // 2
    while at:
        then = []
        for i in range(0, len(row), 2):
            win, lose = match(row[i], row[i + 1])
            tree[at + i // 2] = lose
            then.append(win)
        row, at = then, at // 2
    best = row[0]
    while heads[best][0] is not None:
        suffix, shared = heads[best]
        yield best, suffix, shared
        heads[best] = next(runs[best], done)
        node = (best + size) // 2
        while node:
            best, tree[node] = match(best, tree[node])
            node //= 2


def _packed_run(picked: list[tuple]) -> bytes:
    """Sorted, front-coded (suffix, left, delta, row, at), one entry for those that agree in the first three."""
    picked.sort()
    entries, places = [], []
    for suffix, left, delta, row, at in picked:
        if entries and entries[-1] == (suffix, left, delta):
            places[-1].append((row, at))
        else:
            entries.append((suffix, left, delta))
            places.append([(row, at)])
    shared, tails, sizes = front_coded([e[0] for e in entries])
    ints = np.array([shared, sizes, [len(e[1]) for e in entries], [e[2] for e in entries], list(map(len, places))], dtype=np.int32)
    where = np.array([x for p in places for x in p], dtype=np.int64)
    head = struct.pack("<4q", len(entries), len(tails), sum(map(len, places)), sum(len(e[1]) for e in entries))
    body = head + ints.tobytes() + where.tobytes() + tails + b"".join(e[1] for e in entries)
    return struct.pack("<q", len(body)) + pa.compress(body, "zstd", asbytes=True)


def _unpacked_run(packed: bytes) -> tuple[Iterator[tuple[bytes, int]], list[tuple[bytes, int, list]]]:
    """The suffixes with the prefixes they share, and (left, delta, places) of each."""
    body = pa.decompress(packed[8:], struct.unpack_from("<q", packed)[0], "zstd", asbytes=True)
    n, n_tails, n_places, n_lefts = struct.unpack_from("<4q", body)
    ints = np.frombuffer(body, np.int32, 5 * n, 32).reshape(5, n).tolist()
    at = 32 + 20 * n
    where = np.frombuffer(body, np.int64, 2 * n_places, at).reshape(-1, 2).tolist()
    at += 16 * n_places
    tails, lefts = body[at : at + n_tails], body[at + n_tails :]
    others, i, j = [], 0, 0
    for size, delta, count in zip(*ints[2:]):
        others.append((lefts[i : i + size], delta, where[j : j + count]))
        i, j = i + size, j + count
    return _decoded(ints[0], tails, ints[1]), others


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple]:
    """(suffix, left, last - at, row, at, key) of the picked anchors of texts."""
    for batch in text_chunks(batches, limit=CHUNK_BYTES):
        data, ends = utf8_view(batch.column("text"))
        raw, picked, cuts = data.tobytes(), batch.column("picked"), ends.tolist()
        counts = np.diff(picked.offsets.to_numpy())
        flat = picked.flatten()
        columns = [flat.field(c).to_numpy().tolist() for c in ("at", "first", "last", "key")]
        rows = np.repeat(batch.column("row").to_numpy(), counts).tolist()
        texts = np.repeat(np.arange(batch.num_rows), counts).tolist()
        for row, i, at, first, last, key in zip(rows, texts, *columns):
            a, b = cuts[i], cuts[i + 1]
            yield raw[a + at : min(a + at + length, b)], raw[a + first : a + at], last - at, row, at, key


def suffix_runs(texts: DataFrame, length: int, parts: int) -> DataFrame:
    """Front-coded sorted runs of the picked suffixes, one row for each run and part.

    ``texts`` has (row, text, picked), picked an array of (at, first, last, key).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, {}, 0

        def given() -> pa.RecordBatch:
            rows = [(part, number, _packed_run(picked)) for part, picked in held.items()]
            held.clear()
            types = [pa.int32(), pa.int64(), pa.binary()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["part", "run", "packed"])

        for context in _contexts(batches, length):
            held.setdefault(context[5] % parts, []).append(context[:5])
            size += len(context[0]) + len(context[1])
            if size >= RUN_BYTES:
                yield given()
                number, size = number + 1, 0
        if held:
            yield given()

    return texts.select("row", "text", "picked").mapInArrow(run, _RUNS)


class _Group:
    """Suffixes to be resolved together: several groups of the merge, one after the other."""

    def __init__(self) -> None:
        self.suffixes: list[bytes] = []
        self.lefts: list[bytes] = []
        self.shared: list[int] = []
        self.deltas: list[int] = []
        self.places: list[list] = []
        self.size = 0

    def add(self, suffix: bytes, left: bytes, shared: int, delta: int, places: list) -> None:
        self.suffixes.append(suffix)
        self.lefts.append(left)
        self.shared.append(shared)
        self.deltas.append(delta)
        self.places.append(places)
        self.size += len(suffix) + len(left)

    def spans(self, lengths: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length, first and last place (from ``first`` on) of a repeated string; last -1 if none."""
        texts = [a + b for a, b in zip(self.lefts, self.suffixes)]
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        lefts = np.fromiter(map(len, self.lefts), np.int64, len(texts))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        base, many = np.cumsum(sizes) - sizes, np.fromiter((len(p) > 1 for p in self.places), bool, len(texts))
        count = lefts + np.array(self.deltas) + 1
        owner = np.repeat(np.arange(len(texts)), count)
        heads = np.cumsum(count) - count
        step = np.arange(len(owner)) - heads[owner]
        alike = _Alike(data, base, lefts, np.array(self.shared))
        out = []
        for length in lengths:
            whole = np.flatnonzero(step + length <= sizes[owner])
            digest = self._digests(data, base, sizes, owner[whole], base[owner[whole]] + step[whole], length)
            order = np.argsort(digest, kind="stable")
            ranked, who = digest[order], whole[order]
            same = np.flatnonzero(ranked[1:] == ranked[:-1])
            a, b = owner[who[same]], owner[who[same + 1]]
            after = lefts[a] - step[who[same]]  # bytes of the string before its anchor
            true = alike.strings(a, b, after, lefts[b] - step[who[same + 1]], length)
            again = np.zeros(len(owner), dtype=bool)
            again[who[same[true]]] = again[who[same[true] + 1]] = True
            if not true.all():  # a hash of different strings: compare all that have it
                for d in np.unique(ranked[same[~true]]):
                    seen: dict[bytes, int] = {}
                    for k in who[np.searchsorted(ranked, d) : np.searchsorted(ranked, d, side="right")].tolist():
                        at = base[owner[k]] + step[k]
                        other = seen.setdefault(data[at : at + length].tobytes(), k)
                        if other != k:
                            again[k] = again[other] = True
            again[whole] |= many[owner[whole]]
            low = np.minimum.reduceat(np.where(again, step, np.iinfo(np.int64).max), heads)
            out.append((low, np.maximum.reduceat(np.where(again, step, -1), heads)))
        return out

    @staticmethod
    def _digests(data: np.ndarray, base: np.ndarray, sizes: np.ndarray, owner: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the strings at ``start`` (owners ascending), some texts at a time."""
        out, at = np.empty(len(start), np.uint64), 0
        while at < len(base):
            to = max(at + 1, int(np.searchsorted(base, base[at] + CHUNK_BYTES)))
            some = slice(np.searchsorted(owner, at), np.searchsorted(owner, to))
            low = start[some] - base[at]
            out[some] = Rolling(data[base[at] : base[to - 1] + sizes[to - 1]]).of(low, low + length)
            at = to
        return out


class _Alike:
    """Whether two suffixes of a group agree around their anchors, from known prefixes and left sides."""

    def __init__(self, data: np.ndarray, base: np.ndarray, lefts: np.ndarray, shared: np.ndarray) -> None:
        self.lefts, wide = lefts, int(lefts.max(initial=0))
        column = np.arange(wide)[None, ::-1]  # right-aligned: distance from the anchor
        near = column < lefts[:, None]
        self.left = np.where(near, data[np.where(near, (base + lefts)[:, None] - 1 - column, 0)], 0) if wide else np.zeros((len(lefts), 0), np.uint8)
        self.least = [shared]  # least shared prefix of 2^k neighbours
        while len(self.least[-1]) > 1 << len(self.least) - 1:
            x, k = self.least[-1], 1 << len(self.least) - 1
            self.least.append(np.minimum(x[: len(x) - k], x[k:]))

    def strings(self, a: np.ndarray, b: np.ndarray, before_a: np.ndarray, before_b: np.ndarray, length: int) -> np.ndarray:
        if not len(a):
            return np.zeros(0, dtype=bool)
        n = len(self.lefts)
        pair, back = np.unique(np.minimum(a, b) * n + np.maximum(a, b), return_inverse=True)
        i, j = pair // n, pair % n
        right = np.full(len(pair), np.iinfo(np.int64).max)
        apart = np.flatnonzero(i < j)  # neighbours in the merge: the least prefix between them
        level = np.frexp((j - i)[apart].astype(np.float64))[1] - 1
        for k in set(level.tolist()):
            some = apart[level == k]
            right[some] = np.minimum(self.least[k][i[some] + 1], self.least[k][j[some] + 1 - (1 << k)])
        left = np.minimum(self.lefts[i], self.lefts[j])
        for at in range(0, len(pair), 4096):
            part = slice(at, at + 4096)
            differ = (self.left[i[part]] != self.left[j[part]])[:, ::-1]
            if differ.shape[1]:
                left[part] = np.minimum(left[part], np.where(differ.any(1), differ.argmax(1), differ.shape[1]))
        return (before_a == before_b) & (left[back] >= before_a) & (right[back] >= length - before_a)


def _span_rows(group: _Group, length: int, short: int) -> Iterator[tuple]:
    """(row, start, stop, short_start, short_stop) of a resolved group, -1 where there is none."""
    found = group.spans((length, short))
    lows, highs = [x.tolist() for x, _ in found], [x.tolist() for _, x in found]
    for i, places in enumerate(group.places):
        if highs[1][i] < 0:
            continue
        for row, at in places:
            first = at - len(group.lefts[i])
            long = (first + lows[0][i], first + highs[0][i] + length) if highs[0][i] >= 0 else (-1, -1)
            yield row, *long, first + lows[1][i], first + highs[1][i] + short


def _span_batches(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []

    def given() -> pa.RecordBatch:
        columns = [pa.array(c, pa.int64() if k == 0 else pa.int32()) for k, c in enumerate(zip(*rows))]
        rows.clear()
        return pa.record_batch(columns, names=_NAMES)

    for x in found:
        rows.append(x)
        if len(rows) >= 50_000:
            yield given()
    if rows:
        yield given()


def merged_spans(runs: DataFrame, length: int, short: int, window: int, parts: int) -> DataFrame:
    """Spans of repeated strings, from runs exchanged by part."""
    core = short - window + 1

    def merge(packed: list[bytes]) -> Iterator[tuple]:
        opened = [_unpacked_run(p) for p in packed]
        next_of, ready, group, seen, before = [0] * len(opened), _Group(), [], {}, b""

        def close() -> None:
            if len(group) > 1 or group and len(group[0][4]) > 1:
                for x in group:
                    ready.add(*x)
            group.clear()

        for run, suffix, shared in merged([o[0] for o in opened]):
            left, delta, places = opened[run][1][next_of[run]]
            next_of[run] += 1
            if shared < core:
                close()
                if ready.size > CHUNK_BYTES:
                    yield from _span_rows(ready, length, short)
                    ready = _Group()
            if not shared == len(suffix) == len(before):
                seen.clear()
            before, known = suffix, seen.get((left, delta))
            if known is not None:
                known.extend(places)
            else:
                seen[left, delta] = places
                group.append((suffix, left, shared if group else 0, delta, places))
        close()
        if ready.size:
            yield from _span_rows(ready, length, short)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = None, []
        for batch in batches:
            for own, packed in zip(batch.column("part").to_pylist(), batch.column("packed").to_pylist()):
                if own != part and rows:
                    yield from _span_batches(merge(rows))
                    rows = []
                part = own
                rows.append(packed)
        if rows:
            yield from _span_batches(merge(rows))

    dealt = runs.repartitionById(parts, "part").sortWithinPartitions("part", "run")
    return dealt.mapInArrow(run, _SPANS)


def contents(texts: DataFrame, length: int) -> DataFrame:
    """The picked anchors with a digest of all the bytes that their strings can have.

    ``long_last`` is the last place at which a string of ``length`` bytes still lies in the text.
    """
    names = ["row", "at", "first", "last", "key", "long_last", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for suffix, left, delta, row, at, key in _contexts(batches, length):
            digest = hashlib.blake2b(left + suffix, digest_size=16, salt=struct.pack("<ii", len(left), delta)).digest()
            rows.append((row, at, at - len(left), at + delta, key, at + min(delta, len(suffix) - length), digest))
            if len(rows) >= 50_000:
                yield pa.record_batch([pa.array(c) for c in zip(*rows)], names=names)
                rows = []
        if rows:
            yield pa.record_batch([pa.array(c) for c in zip(*rows)], names=names)

    schema = ", ".join(f"{c} long" for c in names[:-1]) + ", content binary"
    return texts.select("row", "text", "picked").mapInArrow(run, schema)


def counted_spans(texts: DataFrame, length: int, short: int) -> DataFrame:
    """Spans of repeated strings of the picked anchors, by counting their digests one by one."""
    schema = "digest binary, size int, row long, start int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for suffix, left, delta, row, at, _ in _contexts(batches, length):
            text, first = left + suffix, at - len(left)
            made = [(n, k) for n in (length, short) for k in range(min(len(left) + delta, len(text) - n) + 1)]
            digests = [hashlib.blake2b(text[k : k + n], digest_size=16).digest() for n, k in made]
            columns = [pa.array(digests, pa.binary()), pa.array([n for n, _ in made], pa.int32())]
            columns += [pa.array([row] * len(made), pa.int64()), pa.array([first + k for _, k in made], pa.int32())]
            yield pa.record_batch(columns, names=["digest", "size", "row", "start"])

    strings = staged(texts.select("row", "text", "picked").mapInArrow(run, schema), "strings")
    again = strings.groupBy("digest", "size").agg(F.count("*").alias("n")).filter("n > 1").select("digest", "size")
    # written out, or the join would reuse the grouping's exchange, which can't be split for a hot key
    found = strings.join(staged(again, "again"), ["digest", "size"])
    long, stop = F.col("size") == length, F.col("start") + F.col("size")
    none = F.lit(-1)
    return found.select(
        "row", F.when(long, F.col("start")).otherwise(none).alias("start"), F.when(long, stop).otherwise(none).alias("stop"),
        F.when(long, none).otherwise(F.col("start")).alias("short_start"), F.when(long, none).otherwise(stop).alias("short_stop"),
    )


def _with_texts(texts: DataFrame, picked: DataFrame) -> DataFrame:
    by_row = picked.groupBy("row").agg(F.collect_list(F.struct("at", "first", "last", "key")).alias("picked"))
    return texts.join(by_row.hint("shuffle_hash"), "row")


def split_hot(texts: DataFrame, hot: DataFrame, length: int, short: int, hot_limit: int) -> tuple[DataFrame, DataFrame]:
    """Of hot anchors, one for each content to be merged, and the spans known without a merge."""
    every = staged(contents(_with_texts(texts, hot), length), "contents")
    one = F.min(F.struct("row", "at", "first", "last")).alias("one")
    each = staged(every.groupBy("content", "key").agg(F.count("*").alias("n"), one), "each")
    copies = every.join(each.filter("n > 1").select("content", "key"), ["content", "key"])
    fits = F.col("long_last") >= F.col("first")
    spans = copies.select(
        "row", F.when(fits, F.col("first")).otherwise(-1).cast("int").alias("start"),
        F.when(fits, F.col("long_last") + length).otherwise(-1).cast("int").alias("stop"),
        F.col("first").cast("int").alias("short_start"), (F.col("last") + short).cast("int").alias("short_stop"),
    )
    crowded = each.groupBy("key").agg(F.count("*").alias("contents")).filter(F.col("contents") > hot_limit).select("key")
    crowded = staged(crowded, "crowded")
    each = each.select("one.*", "key")
    merge = each.join(crowded, "key", "left_anti")
    if not crowded.isEmpty():
        rest = each.join(crowded, "key", "left_semi")
        spans = spans.unionByName(counted_spans(_with_texts(texts, rest), length, short))
    return merge, staged(spans, "hot-spans")


def repeated_spans(
    texts: DataFrame, length: int = LENGTH, short: int = SHORT, window: int = WINDOW, hot_limit: int = HOT_LIMIT
) -> DataFrame:
    """Spans (row, start, stop, short_start, short_stop) of repeated strings, -1 where there is none.

    The first two together cover exactly the bytes of repeated strings of ``length`` bytes,
    the others those of ``short`` bytes.
    """
    if not GRAM + window <= short <= length:
        raise ValueError("short is at most length, and window at most short - 16")
    found = staged(anchors(texts, short, window), "anchors")
    # written out, or the join would reuse the grouping's exchange, which can't be split for a hot key
    keys = staged(found.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "keys")
    picked = staged(found.join(keys, "key"), "picked")
    places = ["row", "at", "first", "last", "key"]
    cool, hot = picked.filter(F.col("n") <= hot_limit).select(places), picked.filter(F.col("n") > hot_limit).select(places)
    known = None
    if not keys.filter(F.col("n") > hot_limit).isEmpty():
        split, known = split_hot(texts, hot, length, short, hot_limit)
        split = split.select(*(F.col(c).cast(kind).alias(c) for c, kind in cool.dtypes))
        cool = cool.unionByName(staged(split, "split"))
    bytes_in = cool.agg(F.sum(F.col("at") - F.col("first") + length)).first()[0] or 0
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(tasks, -(-bytes_in // MERGE_BYTES))
    spans = merged_spans(suffix_runs(_with_texts(texts, cool), length, parts), length, short, window, parts)
    return staged(spans if known is None else spans.unionByName(known), "spans")


def _runs_of(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs covered by spans."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def suffix_dedup(
    docs: DataFrame,
    length: int = LENGTH,
    short: int = SHORT,
    window: int = WINDOW,
    hot_limit: int = HOT_LIMIT,
    with_text: bool = False,
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages.

    With ``with_text`` also ``kept``, the remaining bytes (they need not be valid UTF-8).
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text)
    buckets = bucket_count(docs)
    texts = bucketed(rows.repartition(buckets, "row"), "texts", "row", buckets)
    spans = repeated_spans(texts, length, short, window, hot_limit)
    by_row = spans.groupBy("row").agg(F.collect_list(F.struct(*_NAMES[1:])).alias("spans"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, limit=CHUNK_BYTES):
            data, ends = utf8_view(batch.column("text"))
            raw, cuts, out = data.tobytes(), ends.tolist(), []
            for i, spans_of in enumerate(batch.column("spans").to_pylist()):
                text, at, kept = raw[cuts[i] : cuts[i + 1]], 0, []
                gone = _runs_of([(x["start"], x["stop"]) for x in spans_of or () if x["start"] >= 0])
                alike = _runs_of([(x["short_start"], x["short_stop"]) for x in spans_of or () if x["short_start"] >= 0])
                for start, stop in gone:
                    kept.append(text[at:start])
                    at = stop
                kept = b"".join([*kept, text[at:]])
                passages = sum(len(text[a:b].split()) >= PASSAGE_WORDS for a, b in alike)
                out.append((len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), passages, kept))
            columns = [batch.column("doc_id")]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
            columns += [pa.array(c, kind) for c, kind in zip(zip(*out), kinds)]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "kept"]
            yield pa.record_batch(columns[: 7 if with_text else 6], names=names[: 7 if with_text else 6])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long" + ", kept binary" * with_text
    rows = texts.join(by_row.hint("shuffle_hash"), "row", "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(finish, schema)
