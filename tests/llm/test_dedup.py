"""Exact, SimHash, chunk and suffix dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tidewater.llm import exact_dedup as exact
from tidewater.llm import quality as qual
from tidewater.llm import simhash_dedup as sim
from tidewater.llm import substring_dedup as sub
from tidewater.llm import suffix_dedup as suf
from tidewater.llm.components import components
from tidewater.llm.exact_dedup import exact_dedup, survivors
from tidewater.llm.shared import ASCII_LOWER, TEXT_ROWS


def low(text):
    return (text or "").encode().translate(ASCII_LOWER)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("fan_in", [2, 8])
def test_exact(docs, awkward, keep, fan_in):
    groups = defaultdict(list)
    for r in awkward:
        groups[low(r[1])].append(r[0])
    want = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (max if keep == "largest" else min)(known) if known else None
        want += [(i, best, len(ids), i == best, hashlib.sha256(text).hexdigest()) for i in ids]
    got = [tuple(r)[:5] for r in exact_dedup(docs, keep, fan_in).collect()]
    assert Counter(got) == Counter(want)


def test_survivors_leave_one_row_and_all_columns(docs, awkward):
    left = survivors(docs)
    assert left.columns == docs.columns
    got = Counter(r["doc_id"] for r in left.collect())
    assert got[12] == 1 and got[1] == got[2] == 0
    texts = [low(r["text"]) for r in left.collect()]
    assert len(texts) == len(set(texts)) or None in got


def test_survivors_by_row(spark):
    """One id with two texts, one of them twice, and texts that differ in case only."""
    rows = [(5, "A", 1), (5, "B", 1), (5, "B", 1), (7, "x", 1), (7, "X", 2), (7, "x", 3), (8, None, 1), (None, "", 1), (9, "b", 4), (None, "q", 1), (None, "Q", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _digest int").repartition(4)
    for keep, most in (("largest", 10), ("smallest", 10), ("largest", 1)):
        left = survivors(docs, keep, most).collect()
        assert Counter(low(r["text"]) for r in left) == Counter({low(t): 1 for _, t, _ in rows})
        assert all(tuple(r) in set(rows) for r in left)
        best = {b"a": 5, b"b": 9 if keep == "largest" else 5, b"x": 7, b"": 8, b"q": None}
        assert {low(r["text"]): r["doc_id"] for r in left} == best


def test_runs_merge_without_sorting():
    """Pieces of several runs, with keys that they share, against one sorted list."""
    rng = random.Random(3)
    keys = [hashlib.sha256(bytes([rng.randrange(40)])).digest() + bytes(24) for _ in range(900)]
    entries = np.zeros(900, exact._ENTRY)
    entries["key"], entries["id"], entries["row"] = keys, [rng.randrange(50) for _ in keys], [rng.randrange(3) for _ in keys]
    entries["null"] = [rng.random() < 0.2 for _ in keys]
    entries["n"] = entries["same"] = 1
    for largest in (True, False):
        runs = []
        for part in np.array_split(entries, 7):
            runs.append(exact.collapsed(part[np.argsort(part["key"], kind="stable")], largest))
        out = exact.collapsed(exact.merged(runs), largest)
        want = {}
        for k in set(keys):
            own = [(bool(e["null"]), (-1 if largest else 1) * int(e["id"]), int(e["row"])) for e in entries if e["key"] == np.array(k, "S56")]
            want[k.rstrip(b"\0")] = (min(own), len(own), own.count(min(own)))
        got = {bytes(e["key"]): ((bool(e["null"]), (-1 if largest else 1) * int(e["id"]), int(e["row"])), int(e["n"]), int(e["same"])) for e in out}
        assert got == want and list(out["key"]) == sorted(out["key"])


def test_a_task_of_the_merge_has_one_python_worker(spark, docs):
    plan = exact.merged_runs(exact.staged(exact.digests(docs), "digests"))._jdf.queryExecution().sparkPlan().toString()
    nodes = [line.strip(" +-:*") for line in plan.splitlines() if not re.match(r"\W*(Project|Sort)\b", line)]
    assert sum(x.startswith("MapInArrow") for x in nodes) > 2
    assert not any(x.startswith("MapInArrow") and y.startswith("MapInArrow") for x, y in zip(nodes, nodes[1:]))


def test_whole_texts_go_to_workers_by_few_rows(spark, docs, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", {}
    before = spark.conf.get(name)
    for module in (exact, sim, qual):

        def noted(df, what, staged=module.staged):
            seen[what] = int(spark.conf.get(name))
            return staged(df, what)

        monkeypatch.setattr(module, "staged", noted)
    exact.survivors(docs)
    sim.near_duplicate_rows(docs)
    qual.quality_rows(docs, spark.createDataFrame([(1, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int"))
    assert all(seen[x] == TEXT_ROWS < int(before) for x in ("digests", "fingerprints", "keys"))
    assert spark.conf.get(name) == before


@pytest.mark.parametrize("piece", [1, 3])
def test_long_runs_come_in_pieces(spark, monkeypatch, piece):
    """Many pieces a run, in this process: keys, best ids and counts stay whole."""
    monkeypatch.setattr(exact, "PIECE", piece)
    rows = [(i, hashlib.sha256(b"%d" % (i % 60)).digest()) for i in range(300)]
    pieces = []
    for part in range(5):
        own = np.zeros(60, exact._ENTRY)
        own["key"], own["id"] = [d + bytes(24) for _, d in rows[part::5]], [i for i, _ in rows[part::5]]
        own["n"] = own["same"] = 1
        run = exact.collapsed(own[np.argsort(own["key"], kind="stable")], True)
        for batch in exact._pieces(run, 0, 4):
            pieces += batch.to_pylist()
    pieces.sort(key=lambda r: (r["bucket"], r["block"], r["first"]))
    batch = pa.record_batch([pa.array([p[c] for p in pieces]) for c in ("bucket", "block", "first", "entries")], names=["bucket", "block", "first", "entries"])
    out = np.concatenate([np.frombuffer(e, exact._ENTRY) for b in exact._merge(iter([batch]), True) for e in b.column("entries").to_pylist()])
    assert len(out) == 60 and sorted(out["id"]) == list(range(240, 300)) and set(out["n"]) == {5}


def test_empty(none):
    assert exact_dedup(none).count() == survivors(none).count() == 0
    assert sim.near_duplicates(none).count() == 0
    assert sub.substring_dedup(none).count() == 0
    assert suf.suffix_dedup(none).count() == 0


def fingerprint(text):
    words = low(text).split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_of(fps, distance):
    """Component of each fingerprint by comparing all pairs."""
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {f: find(f) for f in fps}


def test_simhash(docs, awkward):
    fps = [fingerprint(r[1]) for r in awkward]
    root = roots_of(fps, 4)
    least = defaultdict(list)
    for r, f in zip(awkward, fps):
        least[root[f]].append(r[0])
    want = []
    for r, f in zip(awkward, fps):
        known = [i for i in least[root[f]] if i is not None]
        want.append((r[0], f"{f:016x}", min(known) if known else None))
    got = [tuple(r) for r in sim.near_duplicates(docs).collect()]
    assert Counter(got) == Counter(want)


def test_points_of_large_buckets_are_never_broadcast(spark):
    """Members are few bytes for the planner, but each has 2,081 points, whose rows a driver can't hold."""
    nodes = spark.range(40).selectExpr("id % 8 AS fp").distinct()
    linked = sim.links(nodes, 4, 1)
    assert len(linked.collect()) >= 7  # the plan is final only then
    plan = linked._jdf.queryExecution().executedPlan().toString()
    assert "point#" in plan and not re.search(r"BroadcastHashJoin \[point#", plan)


@pytest.mark.parametrize("bucket_limit", [2000, 3])
def test_links_join_what_all_pairs_join(spark, bucket_limit):
    """Random fingerprints with dense balls around a few, with and without hot buckets."""
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(150)} | {0, (1 << 64) - 1}
    for centre in list(fps)[:4]:
        for _ in range(25):
            f = centre
            for b in rng.sample(range(64), rng.randint(1, 5)):
                f ^= 1 << b
            fps.add(f)
    nodes = spark.createDataFrame([(sim._long(f),) for f in fps], "fp long")
    got = defaultdict(lambda: None)
    for r in components(sim.links(nodes, 4, bucket_limit)).collect():
        got[r["node"]] = r["root"]
    want = roots_of(fps, 4)
    groups = defaultdict(set)
    for f, r in want.items():
        groups[r].add(sim._long(f))
    for group in groups.values():
        assert {got[f] if got[f] is not None else f for f in group} == {min(group)}


def test_thresholds_keep_the_pigeonhole():
    rng = np.random.default_rng(1)
    bits = rng.random((500, 64)) < rng.random(64)
    together = bits.T.astype(float) @ bits
    for n in (500, 10**5, 10**7):
        for distance in (2, 4, 6):
            chosen = sim.plan(n, together, distance)
            assert sum(t + 1 for _, t in chosen) == distance + 1
            used = [b for bits, _ in chosen for b in bits]
            assert len(used) == len(set(used))


def test_candidate_estimates_see_correlation():
    """Chances of few differing bits, against counts over pairs: bits that go together differ together."""
    rng = np.random.default_rng(2)
    base = rng.random((4000, 8)) < 0.5
    bits = np.repeat(base, 2, axis=1) ^ (rng.random((4000, 16)) < 0.05)
    bits = np.concatenate([bits, rng.random((4000, 48)) < 0.3], axis=1)
    share = bits.T.astype(float) @ bits / len(bits)
    a, b = bits[:2000], bits[2000:]
    for group in (list(range(16)), list(range(16, 32))):
        differ = (a[:, group] ^ b[:, group]).sum(1)
        found = sim._within(share, group, 4)
        for t in (2, 4):
            assert abs(found[t] - (differ <= t).mean()) < 0.25 * (differ <= t).mean() + 0.004
    assert sim._within(share, list(range(16)), 2)[2] > 3 * sim._within(np.outer(np.diag(share), np.diag(share)) * (1 - np.eye(64)) + np.diag(np.diag(share)), list(range(16)), 2)[2]


def test_components_of_a_long_chain_and_a_hub(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}}


def chunk_brute(raw):
    """Chunks of one text by rolling the gear hash byte by byte."""
    h, ends, start, n = 0, [], 0, len(raw)
    for i, b in enumerate(raw):
        h = ((h << 1) + int(sub.GEAR[b])) & 0xFFFFFFFF
        place = i + 1
        boundary = place == n or raw[place] & 0xC0 != 0x80
        cut = h >> (32 - sub.MASK_BITS) == 0 and place >= 32 and place < n and boundary
        if (cut and place - start >= sub.SHORTEST) or place == n or (place - start >= sub.LONGEST and boundary):
            ends.append(place)
            start = place
    return ends


def test_chunks(docs, awkward):
    seen, want = {}, {}
    rows = [(r[0] is None, r[0] or 0, k, (r[1] or "").encode()) for k, r in enumerate(awkward)]
    for none, i, k, raw in sorted(rows, key=lambda x: x[:3]):
        start, dropped = 0, 0
        for end in chunk_brute(raw):
            if end - start >= sub.LEAST:
                key = raw[start:end]
                dropped += (end - start) if key in seen else 0
                seen.setdefault(key, i)
            start = end
        want[k] = (None if none else i, len(raw), dropped)
    got = sub.substring_dedup(docs).collect()
    assert Counter((r["n_bytes"], r["dropped_bytes"]) for r in got) == Counter((n, d) for _, n, d in want.values())
    for r in got:
        spans = [tuple(map(int, s.split(":"))) for s in r["spans"].split(",") if s]
        assert sum(b - a for a, b in spans) == r["dropped_bytes"]
        assert (r["n_dropped"] > 0) == bool(spans)


def test_chunks_fall_into_step_after_an_insertion(spark):
    rng = random.Random(4)
    text = " ".join(f"{rng.getrandbits(40):x}" for _ in range(2000))
    rows = spark.createDataFrame([(1, text), (2, "an insertion " + text)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in sub.substring_dedup(rows).collect()}
    assert got[1]["dropped_bytes"] == 0 and got[2]["kept_in"] == [1]
    assert got[2]["dropped_bytes"] > 0.95 * len(text)


def test_exact_copies_lose_all_chunks(spark, tmp_path):
    """Short texts and short tails too, but no tail that merely looks like another."""
    from tidewater.llm.queries import QUERIES

    rng = random.Random(9)
    long = next(t for t in (prose_of(rng) for _ in range(500)) if 0 < last_size(t) < 32)
    other = next(t for t in (prose_of(rng) for _ in range(2000)) if last_size(t) == last_size(long))
    other = other[: -last_size(long)] + long[-last_size(long) :]
    texts = ["Die tz.", "Die tz.", long, long, other, long[-last_size(long) :], "", "", "Die tz.", long + " and more of it, which goes on"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in QUERIES["op3_substring_dedup"](spark, str(tmp_path)).collect()}
    assert [got[i]["dropped_bytes"] for i in range(9)] == [0, 7, 0, len(long), 0, 0, 0, 0, 7]
    assert got[3]["n_dropped"] == got[3]["n_chunks"] and got[3]["kept_in"] == [2] and got[8]["kept_in"] == [0]
    assert got[9]["dropped_bytes"] >= sub.SHORTEST  # the chunks before the tail are still found


def prose_of(rng):
    return " ".join(f"{rng.getrandbits(40):x}" for _ in range(60))


def last_size(text):
    ends = chunk_brute(text.encode())
    return ends[-1] - ([0] + ends)[-2]


def covered(raws, length):
    """For each text, the bytes in strings of ``length`` bytes that start at two places."""
    counts = Counter(raw[i : i + length] for raw in raws for i in range(len(raw) - length + 1))
    out = []
    for raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if counts[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append(gone)
    return out


def suffix_brute(raws, length, short=288):
    out = []
    for raw, gone, alike in zip(raws, covered(raws, length), covered(raws, short)):
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = re.finditer(b"\1+", bytes(gone))
        passages = sum(len(raw[m.start() : m.end()].split()) >= 50 for m in re.finditer(b"\1+", bytes(alike)))
        out.append((len(raw), sum(gone), sum(1 for _ in runs), hashlib.sha256(kept).hexdigest(), passages))
    return out


@pytest.mark.parametrize("hot_limit", [20_000, 2, 1])
def test_suffix(docs, awkward, hot_limit):
    want = suffix_brute([(r[1] or "").encode() for r in awkward], 400)
    got = suf.suffix_dedup(docs, hot_limit=hot_limit).collect()
    assert Counter(tuple(r) for r in got) == Counter((r[0], *w) for r, w in zip(awkward, want))


@pytest.mark.parametrize("hot_limit", [20_000, 3])
def test_suffix_partial_overlaps(spark, hot_limit):
    """Passages that start and end anywhere, at every offset to an anchor; some in many copies, some in texts cut short."""
    rng = random.Random(8)
    word = lambda n: bytes(rng.choice(b"abcd ef") for _ in range(n))
    passages = [word(n) for n in (280, 289, 330, 395, 400, 401, 450, 900)]
    raws = []
    for p in passages * 8:
        cut = p[rng.randint(0, 3) :]
        raws.append(word(rng.randint(0, 300)) + cut + word(rng.choice((0, 0, 40, rng.randint(0, 300)))))
    raws += [passages[-1][200:]] * 3 + [b"ab" * 400, b"x" * 700, b"x" * 420]
    rows = spark.createDataFrame([(i, r.decode()) for i, r in enumerate(raws)], "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in suf.suffix_dedup(rows, hot_limit=hot_limit).collect()}
    for i, w in enumerate(suffix_brute(raws, 400)):
        assert got[i] == w, i


def test_suffix_tells_strings_of_one_hash_apart(monkeypatch):
    """With a hash that brings all strings together, the bytes decide; and long texts in pieces."""
    rng = random.Random(5)
    base = bytes(rng.choice(b"abcdefgh") for _ in range(700))
    group = suf._Group()
    at, texts = 150, [base, base[:60] + b"!" + base[61:], base[:350] + b"?" + base[351:], base[:149] + b"#" + base[150:]]
    order = sorted(texts, key=lambda t: t[at : at + 400])
    before = b""
    for t in order:
        suffix = t[at : at + 400]
        shared = next((k for k, (x, y) in enumerate(zip(before, suffix)) if x != y), min(len(before), len(suffix)))
        group.add(suffix, t[:at], shared, 0, [(0, at)])
        before = suffix
    want = []
    for length in (400, 288):
        strings = Counter(t[p : p + length] for t in order for p in range(at + 1) if p + length <= at + 400)
        again = [[p for p in range(at + 1) if strings[t[p : p + length]] > 1] for t in order]
        want.append([(min(a), max(a)) if a else None for a in again])
    for _ in range(2):
        got = [[(a, b) if b >= 0 else None for a, b in zip(low.tolist(), high.tolist())] for low, high in group.spans((400, 288))]
        assert got == want
        monkeypatch.setattr(suf.Rolling, "of", lambda self, start, stop: (start % 2).astype(np.uint64))


def test_suffix_of_a_long_text_in_pieces(monkeypatch):
    rng = random.Random(6)
    text = "".join(rng.choice("abcde f") for _ in range(30_000))
    batch = pa.record_batch([pa.array([7]), pa.array([text])], names=["row", "text"])
    places = []
    for size in (1 << 20, 1000):
        monkeypatch.setattr(suf, "CHUNK_BYTES", size)
        found = set()
        for data, ends, offset in suf._pieces(batch, 288):
            for at, first, last, _ in zip(*(x.tolist() for x in suf.anchors_of(data, ends, 288, 192))):
                found |= {(at + offset, p + offset) for p in range(first, last + 1)}
        places.append(found)
    assert places[0] == places[1] and len(places[0]) == 30_000 - 287


def test_loser_tree_merges_with_known_prefixes():
    rng = random.Random(2)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(400)]
    runs = [sorted(strings[k::7]) for k in range(7)] + [[]]
    coded = []
    for run in runs:
        shared, tails, lengths = suf.front_coded(run)
        coded.append(suf._decoded(shared.tolist(), tails, lengths.tolist()))
    out = list(suf.merged(coded))
    assert [s for _, s, _ in out] == sorted(strings)
    before = b""
    for _, s, k in out:
        most = next((i for i, (x, y) in enumerate(zip(before, s)) if x != y), min(len(before), len(s)))
        assert k == most
        before = s
