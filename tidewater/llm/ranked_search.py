"""Ranked lexical search: hierarchical max trees over document ranges, best first.

The texts are cut into words once for two numbers (documents with words, words in all) and
once for the index, in numpy over Arrow batches; no text moves. The index holds the postings
of the words that the queries use, by shards: ranges of documents of one task, closed at a
fixed number of documents or postings. For every word of a shard it has the documents, the
whole-number strength of each posting (the part of the score that doesn't depend on the
word's weight), and a tree of maxima: of ranges of ``LEAF`` documents, of ``FAN`` such
ranges, and so on up to the shard.

Weights follow from the index (lengths of lists). The sum over a query's words of weight
times maximum bounds every score below a node. The shards' roots are summed first, as a
table. Every query opens the ``FIRST`` shards of the highest bounds; its 50th best score
there is a floor, and only shards whose bound reaches the floor are opened after that. In a
shard a heap gives the nodes in the order of their summed bounds; a node is opened while its
bound reaches the floor, those that equal it too, since a tie may go to a smaller id. The
floor rises with the scores found. So the result is exact, whatever is left unopened.

Queries whose words are more than one broadcast may hold are run in blocks. What is gathered
per task is one shard (bounded above), never a word's whole list: a word in a third of all
documents lies in all shards. A query's results meet as at most 50 rows a shard.

Defined results:
* null or wordless text has no words: it isn't a document, or it finds nothing;
* every row of ``documents`` is a document of its own, repeated rows and ids too; equal
  scores come in the order of their ids, null ids after all others;
* every row of the items is ranked by itself, under its ``item_id``; repeated words count once;
* scores of 0 are left out; empty tables give no rows; extra columns aren't looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.shared import ASCII_LOWER, staged, text_chunks, utf8_view
from tidewater.llm.tokens import WORD, tokens_of

TOP = 50
#: Documents of a leaf, children of a node.
LEAF, FAN = 32, 8
#: A shard is closed at so many documents, or after the batch that reaches so many postings.
SHARD_DOCS, SHARD_POSTINGS = 16_384, 2_000_000
#: Shards that every query opens first.
FIRST = 2
#: Leaves whose documents are scored in one numpy step.
WAVE = 16
#: Words of queries that one task holds (about 40 MB); more queries are run in blocks.
BLOCK_WORDS = 400_000

#: Fixed values of the score.
WEIGHT_UNIT, STRENGTH_UNIT, TF_UNIT, NORM_UNIT, NORM_BASE, NORM_SHARE = 1000, 1_000_000_000, 1000, 20, 100, 50


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of a batch of texts; start, stop, code and text of their words."""
    data, ends = utf8_view(column)
    data = np.frombuffer(data.tobytes().translate(ASCII_LOWER), np.uint8)
    t = tokens_of(data, ends)
    word = t.kind == WORD
    return data, t.start[word], t.stop[word], t.code[word], t.text[word]


def query_words(items: DataFrame) -> DataFrame:
    """(query, item_id, word, code): the distinct words of every item; ``query`` numbers its rows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            data, start, stop, code, text = _words(batch.column("text"))
            raw, seen = data.tobytes(), set()
            for a, b, c, t in zip(start.tolist(), stop.tolist(), code.view(np.int64).tolist(), text.tolist()):
                seen.add((t, raw[a:b], c))
            rows = sorted(seen)
            at = pa.array([r[0] for r in rows], pa.int64())
            columns = [batch.column("query").take(at), batch.column("item_id").take(at), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())]
            yield pa.record_batch(columns, names=["query", "item_id", "word", "code"])

    rows = items.select(F.monotonically_increasing_id().alias("query"), "item_id", F.col("text").cast("string").alias("text"))
    kind = items.schema["item_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"query long, item_id {kind}, word binary, code long")


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Documents with at least one word, and words in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = total = 0
        for batch in text_chunks(batches):
            _, _, _, _, text = _words(batch.column("text"))
            sizes = np.bincount(text, minlength=batch.num_rows)
            some, total = some + int((sizes > 0).sum()), total + int(sizes.sum())
        yield pa.record_batch([pa.array([some], pa.int64()), pa.array([total], pa.int64())], names=["some", "total"])

    sizes = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "some long, total long")
    found = sizes.agg(F.sum("some"), F.sum("total")).first()
    return found[0] or 0, found[1] or 0


class _Lexicon:
    """Words of the queries by code; finds which of them the words of a batch are, byte by byte."""

    def __init__(self, words: list[bytes], codes: np.ndarray) -> None:
        order = np.argsort(codes, kind="stable")
        self.codes, self.ids = codes[order], order
        self.bytes = np.frombuffer(b"".join(words), np.uint8)
        self.ends = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)])
        self.same_code = int(np.unique(codes, return_counts=True)[1].max(initial=0))

    def find(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the batch's words are in the lexicon, and their numbers there."""
        at, found = np.searchsorted(self.codes, code), []
        for k in range(self.same_code):
            here = np.flatnonzero((at + k < len(self.codes)) & (self.codes[np.minimum(at + k, len(self.codes) - 1)] == code))
            word = self.ids[at[here] + k]
            size = stop[here] - start[here]
            same = size == self.ends[word + 1] - self.ends[word]
            here, word, size = here[same], word[same], size[same]
            if len(here):
                within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                equal = data[np.repeat(start[here], size) + within] == self.bytes[np.repeat(self.ends[word], size) + within]
                equal = np.logical_and.reduceat(equal, np.cumsum(size) - size)
                found.append((here[equal], word[equal]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def levels(n: int) -> list[int]:
    """Numbers of nodes of each level over ``n`` documents, leaves first, the root last."""
    sizes = [max(1, -(-n // LEAF))]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // FAN))
    return sizes


def max_tree(docs: np.ndarray, strength: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that hold a posting, numbered through the levels, and the maxima under them.

    ``docs`` are in order. The nodes come level by level, each in order; the last is the root.
    """
    nodes, peaks, base = [], [], 0
    at, top, width = docs, strength, LEAF
    for size in sizes:
        at = at // width
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        at, top, width = at[first], np.maximum.reduceat(top, first), FAN
        nodes.append(at + base)
        peaks.append(top)
        base += size
    return np.concatenate(nodes), np.concatenate(peaks)


INDEX = "shard long, word int, n_docs int, length int, top long, ids binary, docs binary, strength binary, nodes binary, peaks binary"


def build_index(docs: DataFrame, words: list[bytes], codes: list[int], some: int, total: int) -> DataFrame:
    """Postings and trees by shard and word (``INDEX``); ``ids`` are those of the documents of the postings.

    ``strength`` of a posting is STRENGTH_UNIT * tf div (TF_UNIT * tf + NORM_UNIT * m).
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _Lexicon(words, np.array(codes, np.int64).view(np.uint64))
        task, shard = TaskContext.get().partitionId() << 32, 0
        held, ids, known, sizes, n, postings = [], [], [], [], 0, 0

        def closed() -> Iterator[pa.RecordBatch]:
            word, doc, tf = (np.concatenate([h[k] for h in held]) for k in range(3))
            order = np.lexsort((doc, word))
            word, doc, tf = word[order], doc[order], tf[order]
            length = np.concatenate(sizes)[doc]
            m = NORM_BASE - NORM_SHARE + (NORM_SHARE * length * some) // total
            strength = (STRENGTH_UNIT * tf) // (TF_UNIT * tf + NORM_UNIT * m)
            every, is_known, tree = np.concatenate(ids), np.concatenate(known), levels(n)
            edge = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1], [True]]))
            rows = []
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                own = doc[a:b]
                nodes, peaks = max_tree(own, strength[a:b], tree)
                named = every[own].astype("<i8").tobytes() + is_known[own].astype(np.uint8).tobytes()
                rows.append((task + shard, int(word[a]), n, b - a, int(peaks[-1]), named, *(x.astype("<i4").tobytes() for x in (own, strength[a:b], nodes, peaks))))
                if len(rows) == 1_000:
                    yield made(rows)
                    rows = []
            if rows:
                yield made(rows)

        def made(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5]
            return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in INDEX.split(", ")])

        for batch in text_chunks(batches):
            data, start, stop, code, text = _words(batch.column("text"))
            sizes.append(np.bincount(text, minlength=batch.num_rows))
            here, word = lexicon.find(data, start, stop, code)
            pair, tf = np.unique(text[here] * len(words) + word, return_counts=True)
            held.append((pair % len(words), pair // len(words) + n, tf))
            column = batch.column("doc_id")
            ids.append(column.fill_null(0).to_numpy(zero_copy_only=False))
            known.append(column.is_valid().to_numpy(zero_copy_only=False))
            n, postings = n + batch.num_rows, postings + len(pair)
            if n >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                yield from closed()
                held, ids, known, sizes, n, postings, shard = [], [], [], [], 0, 0, shard + 1
        if postings:
            yield from closed()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(index, INDEX)


class _Found:
    """The best documents so far, and the score below which none can enter."""

    def __init__(self, floor: int, top: int) -> None:
        self.floor, self.top = floor, top
        self.score, self.id, self.known = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def add(self, score: np.ndarray, id: np.ndarray, known: np.ndarray) -> None:
        good = score >= self.floor
        score, id, known = (np.concatenate([old, new[good]]) for old, new in ((self.score, score), (self.id, id), (self.known, known)))
        order = np.lexsort((id, ~known, -score))[: self.top]
        self.score, self.id, self.known = score[order], id[order], known[order]
        if len(order) == self.top:
            self.floor = max(self.floor, int(self.score[-1]))


class _Postings:
    """One word's list in a shard, read from its row."""

    def __init__(self, ids: bytes, docs: bytes, strength: bytes, nodes: bytes, peaks: bytes, n_leaves: int) -> None:
        self.docs, self.strength = np.frombuffer(docs, "<i4"), np.frombuffer(strength, "<i4").astype(np.int64)
        self.ids, self.known = np.frombuffer(ids[: 8 * len(self.docs)], "<i8"), np.frombuffer(ids[8 * len(self.docs) :], np.uint8)
        self.nodes, self.peaks = np.frombuffer(nodes, "<i4"), np.frombuffer(peaks, "<i4").astype(np.int64)
        self.leaves = self.nodes[: np.searchsorted(self.nodes, n_leaves)]
        self.ends = np.append(np.searchsorted(self.docs, self.leaves * LEAF), len(self.docs))


def best_first(lists: list[tuple[int, _Postings]], n_docs: int, floor: int, top: int = TOP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, ids and whether these are known, of a shard's best documents that reach ``floor``.

    ``lists``: weight and postings of each word. Nodes leave a heap by falling bound; those
    below the floor end the search, those that equal it are opened.
    """
    tree, found = levels(n_docs), _Found(max(floor, 1), top)
    base = np.concatenate([[0], np.cumsum(tree)])
    bound = np.zeros(base[-1], np.int64)
    for weight, own in lists:
        bound[own.nodes] += weight * own.peaks
    leaf = np.concatenate([own.leaves for _, own in lists])
    order = np.argsort(leaf, kind="stable")
    leaf = leaf[order]
    which = np.repeat(np.arange(len(lists)), [len(own.leaves) for _, own in lists])[order]
    first, last = (np.concatenate([own.ends[s] for _, own in lists])[order] for s in (slice(-1), slice(1, None)))
    offset = np.concatenate([[0], np.cumsum([len(own.docs) for _, own in lists])])[:-1]
    docs, ids, known = (np.concatenate([getattr(own, x) for _, own in lists]) for x in ("docs", "ids", "known"))
    part = np.concatenate([weight * own.strength for weight, own in lists])

    def scored(wave: list[int]) -> None:
        wanted = np.array(wave)
        left, right = np.searchsorted(leaf, wanted), np.searchsorted(leaf, wanted, side="right")
        size = right - left
        entry = np.repeat(left, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        a, size = first[entry] + offset[which[entry]], last[entry] - first[entry]
        at = np.repeat(a, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        doc, one, inverse = np.unique(docs[at], return_index=True, return_inverse=True)
        score = np.zeros(len(doc), np.int64)
        np.add.at(score, inverse, part[at])
        found.add(score, ids[at][one], known[at][one].astype(bool))

    heap, wave, limits = [(-int(bound[-1]), len(tree) - 1, 0)], [], base.tolist()
    while heap:
        high, level, k = heapq.heappop(heap)
        if -high < found.floor:
            break
        if level:
            for child in range(k * FAN, min((k + 1) * FAN, tree[level - 1])):
                if (b := int(bound[limits[level - 1] + child])) >= found.floor:
                    heapq.heappush(heap, (-b, level - 1, child))
        else:
            wave.append(k)
        if len(wave) == WAVE:
            scored(wave)
            wave = []
    if wave:
        scored(wave)
    return found.score, found.id, found.known


HITS = "query long, doc_id long, score long"


def open_shards(index: DataFrame, pairs: DataFrame, weighted: DataFrame, top: int = TOP) -> DataFrame:
    """(query, doc_id, score): the best of every shard that ``pairs`` (query, shard, floor) names."""
    asked = pairs.join(weighted, "query").select("shard", "query", "floor", "word", "weight")
    used = asked.select("shard", "word").distinct()
    lists = index.join(used, ["shard", "word"], "left_semi")

    def search(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if rows.num_rows:
            n_docs = rows.column("n_docs")[0].as_py()
            n_leaves = levels(n_docs)[0]
            parts = (rows.column(c).to_pylist() for c in ("word", "ids", "docs", "strength", "nodes", "peaks"))
            held = {word: _Postings(*x, n_leaves) for word, *x in zip(*parts)}
            queries: dict[int, list] = {}
            for query, floor, word, weight in sorted(zip(*(asked.column(c).to_pylist() for c in ("query", "floor", "word", "weight")))):
                if word in held and weight:
                    queries.setdefault(query, [floor, []])[1].append((weight, held[word]))
            for query, (floor, own) in queries.items():
                score, id, known = best_first(own, n_docs, floor, top)
                out[0] += [query] * len(score)
                out[1] += [i if k else None for i, k in zip(id.tolist(), known.tolist())]
                out[2] += score.tolist()
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query", "doc_id", "score"), out)})

    return lists.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(search, HITS)


def _ranked(hits: DataFrame, top: int) -> DataFrame:
    """The ``top`` best rows of every query, in their final order."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def weights(index: DataFrame, queries: DataFrame, some: int) -> DataFrame:
    """(query, word, weight) of the words that documents have; natural logarithm in doubles."""
    df = index.groupBy("word").agg(F.sum("length").alias("df"))
    weight = F.floor(WEIGHT_UNIT * F.log(F.lit(2 * some + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    return queries.select("query", "word").join(df, "word").select("query", "word", weight.alias("weight"))


def _search_block(docs: DataFrame, queries: DataFrame, some: int, total: int, top: int, first: int) -> DataFrame:
    """(query, doc_id, score, rank) for queries (query, word, code) whose words one task can hold."""
    spark = docs.sparkSession
    known = sorted((bytes(r["word"]), r["code"]) for r in queries.select("word", "code").distinct().collect())
    words = [w for w, _ in known]
    numbers = spark.createDataFrame([(w, k) for k, w in enumerate(words)], "bytes binary, word int")
    queries = queries.select("query", F.col("word").alias("bytes")).join(F.broadcast(numbers), "bytes").select("query", "word")
    index = staged(build_index(docs, words, [c for _, c in known], some, total), "max-trees")
    weighted = staged(weights(index, queries, some), "query-weights")
    bound = F.sum(F.col("weight") * F.col("top")).alias("bound")
    bounds = index.select("shard", "word", "top").join(weighted, "word").groupBy("query", "shard").agg(bound).filter("bound > 0")
    order = Window.partitionBy("query").orderBy(F.desc("bound"), "shard")
    bounds = staged(bounds, "shard-bounds")
    begun = staged(bounds.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= first).select("query", "shard"), "first-shards")
    hits = staged(open_shards(index, begun.withColumn("floor", F.lit(1).cast("long")), weighted, top), "first-hits")
    floors = _ranked(hits, top).filter(F.col("rank") == top).select("query", F.col("score").alias("floor"))
    rest = bounds.join(begun, ["query", "shard"], "left_anti").join(floors, "query", "left").na.fill(1, ["floor"])
    rest = staged(rest.filter("bound >= floor").select("query", "shard", "floor"), "other-shards")
    return _ranked(hits.unionByName(open_shards(index, rest, weighted, top)), top)


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, block_words: int = BLOCK_WORDS, first: int = FIRST) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents of every item."""
    queries = staged(query_words(items), "query-words")
    some, total = corpus_size(docs)
    blocks = max(1, -(-queries.count() // block_words))
    out = None
    for k in range(blocks):
        own = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == k)
        found = _search_block(docs, own, some, total, top, first)
        out = found if out is None else out.unionByName(found)
    named = out.join(queries.select("query", "item_id").distinct(), "query")
    return named.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
