"""Embedding near-dedup: small-world graphs by shard, queried whole, then checked in full, verified in doubles.

Vectors of one direction (equal bits after scaling) are one class and are looked at once.
The classes are dealt into shards by a hash. Of every shard one task builds a hierarchical
navigable small-world graph: the vectors are put in by batches of growing size; every one
is led down the upper levels, finds its neighbours by a beam in the graph so far and among
its own batch, keeps the diverse ones of them, and is linked both ways.

Every two shards meet in one task: the vectors of the first query the graph of the second,
many in step. The task first takes an audit of its own queries, spread over all of them, and
widens the beam until ``RECALL`` of those that have a link there find one. A beam may still
miss links, so an exact check follows: the step's queries are compared with the whole shard
in single precision, and what the graph hasn't found and can't be ruled out is settled in
doubles. No link is left out, whatever the graph finds.

What leaves a task is, for each class with a link, the count of its links and one class
that it is joined to there, never the pairs of a group; the components are united over these.

A shard holds ``SHARD_BYTES`` of doubles at most, so a task's memory is bounded for vectors of
any length. Vectors move as they were given, in single precision if that holds them exactly,
one row each, and each goes once to every shard.

Defined results:
* null vectors, empty ones, ones of zeros and ones with null or non-finite components link
  with nothing, nor do vectors of different lengths;
* every row is a vector of its own, repeated rows and ids too; ``component_id`` is the smallest
  id of the component, null if it has none; a null id is never kept and comes with its own row;
* ``n_links`` counts other rows; an empty table gives no rows; extra columns aren't looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.components import components
from tidewater.llm.shared import staged

LEAST_COSINE = 0.9
#: Neighbours on the upper levels, and on the ground level; width of the beam while building and at first while searching.
LINKS, GROUND, BUILD_WIDTH, WIDTH = 12, 24, 48, 16
RECALL, AUDIT = 0.99, 256
SHARDS, SHARD_BYTES = 8, 32 << 20
#: Queries that walk a graph in step, and links that are looked at together.
STEP, TOGETHER = 256, 1 << 20
#: Cosines that are held at once: in the exact check, and between neighbours of nodes.
HELD, PAIRED = 1 << 22, 1 << 20
#: Vectors that are scaled together.
SCALED = 4096
#: Single-precision cosines are trusted to this distance; nearer ones are settled in doubles.
SLACK = 1e-4


class Graph(NamedTuple):
    """Unit vectors in single precision and, by level, the neighbours of each (-1: none); ``start`` is a node of the highest level."""

    vectors: np.ndarray
    links: list[np.ndarray]
    start: int


def beam(graph: Graph, level: int, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and cosines of the ``width`` nearest found for each query from its ``entry``, best first (-1: none)."""
    n, m = len(queries), len(graph.vectors)
    links, row = graph.links[level], np.arange(n)
    node = np.full((n, width), -1, np.int64)
    near = np.full((n, width), -np.inf, np.float32)
    done = np.ones((n, width), bool)
    seen = np.zeros((n, m + 1), bool)
    seen[:, m] = True  # where -1 leads
    node[:, 0], near[:, 0], done[:, 0] = entry, np.einsum("nd,nd->n", queries, graph.vectors[entry]), False
    seen[row, entry] = True
    live = row
    while len(live):
        open_ = np.where(done[live], -np.inf, near[live])
        best = open_.argmax(1)
        going = open_[np.arange(len(live)), best] > -np.inf
        live, best = live[going], best[going]
        if not len(live):
            break
        done[live, best] = True
        around = links[node[live, best]]
        fresh = ~seen[live[:, None], around]
        seen[live[:, None], around] = True
        fresh[around < 0] = False
        at, where = np.nonzero(fresh)
        cosine = np.full(around.shape, -np.inf, np.float32)
        cosine[at, where] = np.einsum("nd,nd->n", queries[live[at]], graph.vectors[around[at, where]])
        all_near = np.concatenate([near[live], cosine], 1)
        order = np.argsort(-all_near, 1, kind="stable")[:, :width]
        all_node = np.concatenate([node[live], np.where(fresh, around, -1)], 1)
        all_done = np.concatenate([done[live], ~fresh], 1)
        near[live], node[live], done[live] = (np.take_along_axis(x, order, 1) for x in (all_near, all_node, all_done))
    return node, near


def descend(graph: Graph, queries: np.ndarray, to: int) -> np.ndarray:
    """The node of level ``to`` + 1 nearest to each query, by greedy steps from the top."""
    at = np.full(len(queries), graph.start)
    for level in range(len(graph.links) - 1, to, -1):
        at = beam(graph, level, queries, at, 1)[0][:, 0]
    return at


def _diverse(vectors: np.ndarray, near: np.ndarray, cosine: np.ndarray, most: int) -> np.ndarray:
    """For each node (row) ``most`` of ``near`` (best first, -1: none), -1 where there are fewer: first those that are nearer to it (``cosine``) than to any taken before, then the best of the rest."""
    out = np.full((len(near), most), -1, np.int64)
    few = max(1, PAIRED // near.shape[1] ** 2)
    for at in range(0, len(near), few):
        own, close = near[at : at + few], cosine[at : at + few]
        node = vectors[own]
        among = node @ node.transpose(0, 2, 1)
        taken, nearest_taken = np.zeros(own.shape, bool), np.full(own.shape, -np.inf, np.float32)
        for k in range(own.shape[1]):
            taken[:, k] = (own[:, k] >= 0) & (nearest_taken[:, k] < close[:, k]) & (taken.sum(1) < most)
            np.maximum(nearest_taken, among[:, k], out=nearest_taken, where=taken[:, k, None])
        order = np.argsort(np.where(own < 0, 2, ~taken), 1, kind="stable")[:, :most]
        out[at : at + few, : order.shape[1]] = np.take_along_axis(own, order, 1)
    return out


def _padded(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows, filled up with -1, of values with the number of their row; both in the order of rows."""
    count = np.bincount(rows, minlength=n)
    out = np.full((n, max(1, int(count.max(initial=0)))), -1, np.int64)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)] = values
    return out


def _linked_back(vectors: np.ndarray, links: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Put links b - a into the table of ``links``; nodes that come to have too many keep the diverse ones."""
    node, row = np.unique(b, return_inverse=True)
    old = links[node]
    q, k = np.nonzero(old >= 0)
    both = np.unique(np.stack([np.concatenate([q, row]), np.concatenate([old[q, k], a])]), axis=1)
    count = np.bincount(both[0], minlength=len(node))
    for size in np.unique(np.maximum(links.shape[1], 1 << np.ceil(np.log2(count)).astype(int))).tolist():  # rows of like length together
        some = np.flatnonzero(np.maximum(links.shape[1], 1 << np.ceil(np.log2(count)).astype(int)) == size)
        part = np.isin(both[0], some)
        near = _padded(np.searchsorted(some, both[0, part]), both[1, part], len(some))
        if near.shape[1] > links.shape[1]:
            close = np.empty(near.shape, np.float32)
            for at in range(0, len(near), STEP):
                close[at : at + STEP] = np.einsum("nkd,nd->nk", vectors[near[at : at + STEP]], vectors[node[some[at : at + STEP]]])
            close[near < 0] = -np.inf
            by = np.argsort(-close, 1, kind="stable")
            near = _diverse(vectors, np.take_along_axis(near, by, 1), np.take_along_axis(close, by, 1), links.shape[1])
        links[node[some]] = -1
        links[node[some], : near.shape[1]] = near


def build(vectors: np.ndarray, seed: int = 7) -> Graph:
    """A graph over unit vectors; levels thin out by a factor of ``LINKS``."""
    n, rng = len(vectors), np.random.default_rng(seed)
    level_of = np.minimum((-np.log(rng.random(n) + 1e-300) / np.log(LINKS)).astype(int), 6)
    order = np.argsort(-level_of, kind="stable")  # the upper levels' members come first
    tallest = int(level_of[order[0]]) if n else 0
    width = [GROUND] + [LINKS] * tallest
    links = [np.full((n, width[k]), -1, np.int64) for k in range(tallest + 1)]
    graph = Graph(vectors, links, int(order[0]) if n else 0)
    done = 1
    while done < n:
        size = min(max(8, done // 4), STEP, n - done)
        batch = order[done : done + size]
        done += size
        own = vectors[batch]
        high = level_of[batch]
        at = np.full(size, graph.start)
        for level in range(tallest, -1, -1):
            member = np.flatnonzero(high >= level)
            passing = np.flatnonzero(high < level)
            if len(passing):
                at[passing] = beam(graph, level, own[passing], at[passing], 1)[0][:, 0]
            if not len(member):
                continue
            node, cosine = beam(graph, level, own[member], at[member], BUILD_WIDTH)
            at[member] = node[:, 0]
            among = own[member] @ own[member].T
            np.fill_diagonal(among, -np.inf)
            few = min(LINKS, len(member))
            mates = np.argsort(-among, 1, kind="stable")[:, :few]
            near = np.concatenate([node, batch[member][mates]], 1)
            close = np.concatenate([np.where(node >= 0, cosine, -np.inf), np.take_along_axis(among, mates, 1)], 1)
            near[close == -np.inf] = -1
            by = np.argsort(-close, 1, kind="stable")
            chosen = _diverse(vectors, np.take_along_axis(near, by, 1), np.take_along_axis(close, by, 1), LINKS)
            links[level][batch[member], :LINKS] = chosen
            q, k = np.nonzero(chosen >= 0)
            _linked_back(vectors, links[level], batch[member][q], chosen[q, k])
    lost = np.setdiff1d(np.arange(n), links[0])  # nodes that no other leads to
    for i in lost[links[0][lost, 0] >= 0].tolist():
        j = links[0][i, 0]
        links[0][j, min(int((links[0][j] >= 0).sum()), GROUND - 1)] = i
    return graph


def nearest(graph: Graph, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``beam`` on the ground level after the way down, in steps of ``STEP`` queries."""
    out = []
    for k in range(0, len(queries), STEP):
        some = queries[k : k + STEP]
        out.append(beam(graph, 0, some, descend(graph, some, 0), min(width, len(graph.vectors))))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _pairs(graph: Graph, exact: np.ndarray, queries: np.ndarray, width: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) with a cosine of at least ``least`` in doubles: of what a beam of ``width`` finds, or all if it is as wide as the shard."""
    if width >= len(exact):
        few = STEP // 4
        found = [np.nonzero(queries[k : k + few] @ exact.T >= least) for k in range(0, len(queries), few)]
        return np.concatenate([q + k * few for k, (q, _) in enumerate(found)]), np.concatenate([node for _, node in found])
    node, near = nearest(graph, queries.astype(np.float32), width)
    q, k = np.nonzero((near >= least - SLACK) & (node >= 0))
    return _verified(exact, queries, q, node[q, k], least)


def _verified(exact: np.ndarray, queries: np.ndarray, q: np.ndarray, node: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    good = np.empty(len(q), bool)
    for k in range(0, len(q), 65_536):
        part = slice(k, k + 65_536)
        good[part] = np.einsum("nd,nd->n", queries[q[part]], exact[node[part]]) >= least
    return q[good], node[good]


def audited_width(graph: Graph, exact: np.ndarray, queries: np.ndarray, least: float, root: np.ndarray | None = None, recall: float = RECALL, width: int = WIDTH) -> int:
    """The beam, doubled until an audit of ``AUDIT`` queries finds ``recall`` of the components (``root``) that they link with.

    Without ``root`` the queries are the shard's own vectors, and any other vector that they link with will do.
    """
    at = np.unique(np.linspace(0, len(queries) - 1, AUDIT).astype(int))

    def met(q: np.ndarray, node: np.ndarray) -> int:
        return len(np.unique(q[node != at[q]])) if root is None else len(np.unique(q * len(exact) + root[node]))

    true = met(*_pairs(graph, exact, queries[at], len(exact), least))
    while width < len(exact) and met(*_pairs(graph, exact, queries[at], width, least)) < recall * true:
        width *= 2
    return width


def local_roots(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """The least node of the component of each of ``n`` nodes under links a - b and those that gave ``root``."""
    root = np.arange(n) if root is None else root
    apart = root[a] != root[b]
    a, b = a[apart], b[apart]
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def pair_links(graph: Graph, own: np.ndarray, there: np.ndarray, size: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """For the nodes of ``own`` and then of ``there`` (unit vectors, those of the graph): rows that each links with in the other, and the least node that it is joined to.

    If ``there`` is ``own``, the nodes are counted once. ``size`` holds the rows of each node.
    """
    same, at = there is own, 0 if there is own else len(own)
    slack = SLACK + 1.2e-7 * own.shape[1]
    n, root = np.zeros(at + len(there)), np.arange(at + len(there))
    asked, against = own.astype(np.float32), graph.vectors
    width = audited_width(graph, there, own, least, None if same else np.zeros(len(there), np.int64))
    for k in range(0, len(own), STEP):
        step = slice(k, k + STEP)
        q, node = _pairs(graph, there, own[step], width, least) if width < len(there) else (np.zeros(0, np.int64),) * 2
        n, root = _joined(n, root, q + k, node + at, size) if not same else _joined(n, root, *(x[node > q + k] for x in (q + k, node)), size)
        few = max(1, HELD // len(there))
        for first in range(k, min(k + STEP, len(own)), few):
            cosine = asked[first : min(first + few, k + STEP)] @ against.T
            near = cosine >= least - slack
            if same:  # every pair once
                near &= np.arange(len(there)) > np.arange(first, first + len(near))[:, None]
            met = (q + k >= first) & (q + k < first + len(near))
            near[q[met] + k - first, node[met]] = False
            ends = np.cumsum(near.sum(1))
            row = 0
            while row < len(near) and ends[-1] > (ends[row - 1] if row else 0):
                to = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + TOGETHER, side="right")))
                a, b = np.nonzero(near[row:to])
                sure = cosine[a + row, b] >= least + slack
                more = _verified(there, own, a[~sure] + row + first, b[~sure], least)
                n, root = _joined(n, root, np.concatenate([a[sure] + row + first, more[0]]), np.concatenate([b[sure], more[1]]) + at, size)
                row = to
    return n.astype(np.int64), root


def _joined(n: np.ndarray, root: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(a):
        n = n + np.bincount(a, size[b], len(n)) + np.bincount(b, size[a], len(n))
        root = local_roots(len(n), a, b, root)
    return n, root


GRAPH = "dim int, shard int, start int, links array<binary>"
MET = "class long, n long, met long"


def classes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (row, vec_id, key), key null where a vector links with nothing; and their classes (key, class, size, dim, raw)."""

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, raws, keys = [], [], []
            for x in batch.column("embedding"):
                v = x.as_py()
                v = np.array([np.nan if c is None else c for c in v], np.float64) if v else None
                if v is None or not np.isfinite(v).all() or not v.any():
                    dims.append(None), raws.append(None), keys.append(None)
                    continue
                with np.errstate(over="ignore"):
                    short = v.astype("<f4")
                dims.append(len(v))
                raws.append(short.tobytes() if (short == v).all() else v.astype("<f8").tobytes())
                keys.append(hashlib.sha256(_scaled(v[None])[0].tobytes()).hexdigest())
            columns = [batch.column("row"), batch.column("vec_id"), pa.array(dims, pa.int32()), pa.array(raws, pa.binary()), pa.array(keys, pa.string())]
            yield pa.record_batch(columns, names=["row", "vec_id", "dim", "raw", "key"])

    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = staged(rows.mapInArrow(unit, "row long, vec_id long, dim int, raw binary, key string"), "vectors")
    classes = rows.filter("key IS NOT NULL").groupBy("key", "dim").agg(F.min("row").alias("class"), F.count("*").alias("size"), F.first("raw").alias("raw"))
    return rows.drop("raw", "dim"), staged(classes, "vector-classes")


def _scaled(x: np.ndarray) -> np.ndarray:
    """Unit vectors of rows, whose length may be beyond what doubles can square."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None] + 0.0


def _units(raw: pa.ChunkedArray, dim: int, order: np.ndarray) -> np.ndarray:
    """Unit vectors in doubles of vectors that are given in either precision, in the ``order`` of their places."""
    out = np.empty((len(order), dim))
    for at in range(0, len(order), SCALED):
        part = raw.take(pa.array(order[at : at + SCALED]))
        to, short = out[at : at + SCALED], pc.equal(pc.binary_length(part), 4 * dim)
        for mask, kind in ((short, "<f4"), (pc.invert(short), "<f8")):
            to[mask.to_numpy()] = np.frombuffer(b"".join(part.filter(mask).to_pylist()), kind).reshape(-1, dim)
        to[:] = _scaled(to)
    return out


def shard_graphs(dealt: DataFrame) -> DataFrame:
    """One row a shard (``GRAPH``): the graph of its classes, numbered in their order."""

    def index(rows: pa.Table) -> pa.Table:
        dim = rows.column("dim")[0].as_py()
        graph = build(_units(rows.column("raw"), dim, np.argsort(rows.column("class").to_numpy())).astype(np.float32))
        links = [pa.compress(x.astype("<i4").tobytes(), "zstd", asbytes=True) for x in graph.links]
        kinds = (("dim", dim, pa.int32()), ("shard", rows.column("shard")[0].as_py(), pa.int32()), ("start", graph.start, pa.int32()), ("links", links, pa.list_(pa.binary())))
        return pa.table({name: pa.array([x], kind) for name, x, kind in kinds})

    return staged(dealt.groupBy("dim", "shard").applyInArrow(index, GRAPH), "graphs")


def meet(graphs: DataFrame, dealt: DataFrame, shards: int, least: float) -> DataFrame:
    """(class, n, met): by two shards, the rows that a class links with in the other, and one class for all that are joined in these."""

    def search(there: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
        if there.num_rows and rows.num_rows:
            low = rows.column("low")[0].as_py()
            g = there.slice(0, 1).to_pylist()[0]
            ids, size, shard = (rows.column(c).to_numpy() for c in ("class", "size", "shard"))
            order = np.lexsort((ids, shard))
            ids, size, shard = ids[order], size[order], shard[order]
            other = _units(rows.column("raw"), g["dim"], order[shard == g["shard"]])
            wide = [GROUND] + [LINKS] * (len(g["links"]) - 1)
            links = [np.frombuffer(pa.decompress(x, len(other) * w * 4, "zstd"), "<i4").astype(np.int64).reshape(-1, w) for x, w in zip(g["links"], wide)]
            graph = Graph(other.astype(np.float32), links, g["start"])
            own = other if low == g["shard"] else _units(rows.column("raw"), g["dim"], order[shard == low])
            if len(own):
                n, root = pair_links(graph, own, other, size, least)
                some = np.flatnonzero(n)
                out = [ids[some], n[some], ids[root[some]]]
        return pa.table({name: pa.array(x, pa.int64()) for name, x in zip(("class", "n", "met"), out)})

    low, high = (f(F.col("shard"), F.col("other")).alias(name) for f, name in ((F.least, "low"), (F.greatest, "high")))
    each = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("other")
    graphs = graphs.select("dim", "shard", "start", "links", each).filter("other <= shard").select("dim", low, high, "shard", "start", "links")
    rows = dealt.select("dim", "shard", "class", "size", "raw", each).select("dim", low, high, "shard", "class", "size", "raw")
    by, tasks = ("dim", "low", "high"), 2 * shards * (shards + 1)
    dealt_out = (x.repartition(tasks, *by).groupBy(*by) for x in (graphs, rows))
    return next(dealt_out).cogroup(next(dealt_out)).applyInArrow(search, MET)


def near_vectors(vectors: DataFrame, least: float = LEAST_COSINE, shards: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vector."""
    rows, classes = classes_of(vectors)
    n_bytes = classes.agg(F.sum("dim")).first()[0] or 0
    shards = shards or max(SHARDS, -(-8 * n_bytes // SHARD_BYTES))
    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("class"), F.lit(shards)).cast("int"))
    met = staged(meet(shard_graphs(dealt), dealt, shards, least), "met")
    links = met.select(F.col("class").alias("a"), F.col("met").alias("b"))
    roots = components(links).select(F.col("node").alias("class"), "root")
    counted = classes.select("key", "class", "size").join(met.groupBy("class").agg(F.sum("n").alias("n")), "class", "left")
    counted = counted.join(roots, "class", "left").select("key", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("root", "class").alias("root"))
    told = staged(rows.join(counted, "key", "left").select("row", "vec_id", "n_links", F.coalesce("root", "row").alias("root")), "linked-vectors")
    least_id = told.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    return told.join(least_id, "root").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")
    )
