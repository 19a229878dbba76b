"""Ranked search, embedding near-dedup and source divergence against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewater.llm import ranked_search as rank
from tidewater.llm import vector_dedup as vec
from tidewater.llm.divergence import source_divergence
from tidewater.llm.shared import ASCII_LOWER

ROWS = "doc_id long, text string, lang string, source string, term string, shard int, n long"


def low(text):
    return (text or "").encode().translate(ASCII_LOWER).decode()


# ---------------------------------------------------------------- ranked search


def best(docs, items, top):
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    words = [(i, Counter(re.findall(r"[0-9a-z\x80-\U0010ffff]+", low(t)))) for i, t in docs]
    words = [(i, c) for i, c in words if c]
    n_docs, total = len(words), sum(sum(c.values()) for _, c in words)
    df = Counter(w for _, c in words for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in words:
            m = 50 + (50 * sum(c.values()) * n_docs) // total
            terms = set(re.findall(r"[0-9a-z\x80-\U0010ffff]+", low(text))) & set(c)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 20 * m)) for w in terms)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:top])]
    return Counter(out)


@pytest.mark.parametrize(("top", "first", "block_words"), [(5, 1, 10**6), (50, 2, 10**6), (3, 1, 4)])
def test_ranked_search(spark, awkward, top, first, block_words):
    rng = random.Random(top)
    docs = [(i, t) for i, t, *_ in awkward] + [(100 + i, " ".join(f"w{rng.randint(0, 60)}" for _ in range(rng.randint(0, 30)))) for i in range(200)]
    docs += [(400 - i, "W1 same-text W1") for i in range(12)]  # ties
    items = [(1, "w1 W2 w3"), (2, None), (3, "--"), (4, docs[0][1]), (4, "w5 w5 same"), (None, "é" * 700), (6, "absent words")]
    table = spark.createDataFrame([(i, t, "en", "s", "x", 1, 2) for i, t in docs], ROWS).repartition(5)
    asked = spark.createDataFrame([(i, t, 1, "q") for i, t in items], "item_id long, text string, query int, word string")
    got = rank.ranked_search(table, asked, top, block_words, first)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "bigint"]
    assert Counter(tuple(r) for r in got.collect()) == best(docs, items, top)


def test_ranked_search_of_empty_tables(spark, none):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert rank.ranked_search(none, items).count() == 0
    assert rank.ranked_search(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), items.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_best_first_equals_all_scores(seed):
    """Trees of several levels, floors, and so many equal scores that bounds are equal too."""
    rng = np.random.default_rng(seed)
    n = 5_000
    tree, score, lists = rank.levels(n), np.zeros(n, np.int64), []
    for _ in range(6):
        docs = np.flatnonzero(rng.random(n) < rng.choice([0.003, 0.1, 0.6]))
        strength = rng.integers(1, 4 if seed % 2 else 900_000, len(docs))
        nodes, peaks = rank.max_tree(docs, strength, tree)
        assert peaks[-1] == strength.max() and nodes[-1] == sum(tree) - 1
        own = (docs.astype("<i8").tobytes() + np.ones(len(docs), np.uint8).tobytes(), *(x.astype("<i4").tobytes() for x in (docs, strength, nodes, peaks)))
        weight = int(rng.integers(1, 3 if seed % 2 else 9_000))
        lists.append((weight, rank._Postings(*own, tree[0])))
        score[docs] += weight * strength
    for floor in (1, int(np.sort(score)[-20])):
        want = [(s, i) for s, i in sorted(zip((-score).tolist(), range(n)))[:50] if -s >= floor]
        got_score, got_id, known = rank.best_first(lists, n, floor)
        assert [(-s, i) for s, i in zip(got_score.tolist(), got_id.tolist())] == want and known.all()


# ---------------------------------------------------------------- embeddings


def linked(rows, least=0.9):
    """(vec_id, n_links, component_id, kept) by comparing all pairs."""
    unit = []
    for _, v in rows:
        ok = v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        x = np.array(v, float) / max(map(abs, v)) if ok else None
        unit.append(x / np.linalg.norm(x) if ok else None)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    n = [0] * len(rows)
    for i, a in enumerate(unit):
        for j, b in enumerate(unit):
            if i != j and a is not None and b is not None and len(a) == len(b) and a @ b >= least:
                n[i] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    ids = defaultdict(list)
    for i, (vec_id, _) in enumerate(rows):
        ids[find(i)].append(vec_id)
    least_id = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return Counter((r[0], n[i], least_id[find(i)], r[0] is not None and r[0] == least_id[find(i)]) for i, r in enumerate(rows))


def test_near_vectors(spark):
    rng = np.random.default_rng(5)
    rows, ids = [], iter(range(10**6))
    for size in (1, 1, 2, 3, 40, 300):  # near copies round a centre
        centre = rng.normal(size=16)
        rows += [(next(ids), (centre + 0.04 * rng.normal(size=16)).tolist()) for _ in range(size)]
    start = rng.normal(size=16)
    for k in range(12):  # a chain: neighbours are near, its ends aren't
        other = np.roll(start, 1)
        rows.append((next(ids), (math.cos(0.3 * k) * start + math.sin(0.3 * k) * other).tolist()))
    rows += [(next(ids), rng.normal(size=16).tolist()) for _ in range(500)]
    copy = rng.normal(size=16).tolist()
    rows += [(next(ids), [x * s for x in copy]) for s in (1, 1, 2, 1024, 1) for _ in range(5)]
    rows += [(next(ids), v) for v in (None, [], [0.0] * 16, [None] * 16, [math.nan] * 16, [math.inf] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [1e300, 1e-300], [-0.0, 1.0], [0.0, 1.0], [1e-310, 0.0])]
    rows += [(None, copy), (None, None), (rows[0][0], rows[0][1])]
    rng.shuffle(rows)
    table = spark.createDataFrame([(i, v, 1, "k", 2) for i, v in rows], "vec_id long, embedding array<double>, class int, key string, root int").repartition(4)
    got = Counter(tuple(r) for r in vec.near_vectors(table, shards=3).collect())
    assert got == linked(rows)
    assert vec.near_vectors(table.limit(0)).count() == 0


def test_no_link_is_left_out(spark):
    """Pairs just over the threshold, far from all others: beams miss some of them, and too few for an audit to see."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(2_500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.normal(size=x.shape)
    y -= np.einsum("nd,nd->n", x, y)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, 0.9005 * x + math.sqrt(1 - 0.9005**2) * y]))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {r[0]: (r[1], r[2]) for r in vec.near_vectors(table, shards=2).collect()}
    assert len(got) == 5_000 and all(got[i] == (1, i % 2_500) for i in range(5_000))


def test_graph_finds_neighbours():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3_000, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = vec.build(x)
    assert len(graph.links) > 2 and len(np.unique(graph.links[0][graph.links[0] >= 0])) == len(x)
    asked = x[:200] + 0.05 * rng.normal(size=(200, 24)).astype(np.float32)
    asked /= np.linalg.norm(asked, axis=1)[:, None]
    true = np.argsort(-(asked @ x.T), 1)[:, :10]
    node, near = vec.nearest(graph, asked, 64)
    assert (np.diff(near, axis=1) <= 0).all()
    found = sum(len(set(a) & set(b)) for a, b in zip(node[:, :10].tolist(), true.tolist()))
    assert found >= 0.9 * true.size


def test_audit_widens_the_beam():
    """A graph cut in two: no beam passes between the halves, so the audit ends at the whole shard."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = vec.build(x.astype(np.float32))
    links = graph.links[0]
    links[(np.arange(600) < 300)[:, None] != (links < 300)] = -1
    asked = np.arange(600)
    root = np.arange(600)
    width = vec.audited_width(vec.Graph(graph.vectors, [links], 0), x, x, 0.9, root)
    assert width >= 600
    q, node = vec._pairs(graph, x, x, width, 0.9)
    assert len(q) == int((x @ x.T >= 0.9).sum()) and set(asked) == set(q)


# ---------------------------------------------------------------- source divergence


def audited(rows, least=3, top=200):
    words = [(lang or "", source or "", re.findall(r"[a-z\x80-\U0010ffff]+", low(text))) for text, lang, source in rows]
    out = []
    for lang in {w[0] for w in words}:
        own = [(s, w) for x, s, w in words if x == lang]
        df = Counter(t for _, w in own for t in set(w))
        kept = sorted(t for t in df if df[t] >= least)
        count = defaultdict(Counter)
        for s, w in own:
            count[s].update(t for t in w if df[t] >= least)
        whole = sum(count.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in count.items()}, share(whole)
        for s in count:
            pair = [("pair", o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in count if o != s]
            term = [("term", t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, most in ((pair, None), (term, top)):
                part.sort(key=lambda x: (-x[2], x[1].encode()))
                out += [(lang, s, *x, k + 1) for k, x in enumerate(part[:most])]
    return Counter(out)


@pytest.mark.parametrize(("top", "most"), [(200, 50_000), (4, 0)])
def test_source_divergence(spark, awkward, top, most):
    rng = random.Random(9)
    rows = [(t, "xx", "s") for _, t, *_ in awkward]
    for _ in range(300):
        source = rng.choice("abcd")
        text = " ".join(rng.choice(["The", "the", "é", "Éa", "ünï", f"w{source}", f"k{chr(97 + rng.randint(0, 20))}", "x1y"]) for _ in range(rng.randint(0, 9)))
        rows.append((text, rng.choice(["en", "fr", None, ""]), rng.choice([source, source, None])))
    rows += [(None, "en", "quiet"), ("once", "lone", "only"), ("one", "two", "a"), (None, "two", "b"), (None, None, None)]
    table = spark.createDataFrame([(i % 50, t, x, s, "k", 1, 2) for i, (t, x, s) in enumerate(rows)], ROWS).repartition(4)
    got = source_divergence(table, top=top, most=most)
    assert [f.dataType.simpleString() for f in got.schema] == ["string", "string", "string", "string", "bigint", "int"]
    assert Counter(tuple(r) for r in got.collect()) == audited(rows, top=top)
    assert source_divergence(table.limit(0)).count() == 0


def test_shares_of_very_large_counts(spark):
    from tidewater.llm.divergence import _share

    n, total = 9_000_000_000_000, 40_000_000_000_000
    row = spark.createDataFrame([(n, total, 7)], "n long, total long, kinds long").select(_share("n", "total")).first()
    assert row[0] == 1 + 10**9 * (n + 1) // (total + 7)


def test_exact_check_in_small_pieces(monkeypatch):
    monkeypatch.setattr(vec, "HELD", 300)
    monkeypatch.setattr(vec, "PAIRED", 2_000)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(30, 8)).repeat(10, 0) + rng.normal(size=(300, 8)) * 0.3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for own, there in ((x, x), (x[:130], x[130:])):
        n, root = vec.pair_links(vec.build(there.astype(np.float32)), own, there, np.ones(300, np.int64), 0.9)
        near = x @ x.T >= 0.9
        np.fill_diagonal(near, False)
        if own is not there:
            near[:130, :130] = near[130:, 130:] = False
        a, b = np.nonzero(near)
        assert (n == near.sum(1)).all() and (root == vec.local_roots(300, a, b)).all()
