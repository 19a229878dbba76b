"""Document scores by masked pseudo-likelihood.

A window network predicts every token from the ``REACH`` tokens on both its sides: each
neighbour's place has its own embedding table, their sum goes through tanh, and the token's
chance is that of its class times that of the token within the class (two small softmaxes).
A document's score is the sum of its tokens' conditional log chances.

The vocabulary comes from word counts over the whole corpus. Frequent tokens have numbers of
their own, more of them in a larger corpus (at least 768; then all that occur at least
``OWN`` times the root of the corpus's tokens), and as many classes as tokens in a class.
The others share ``RARE`` hashed numbers, and such a token's chance is its number's chance
times its share in the occurrences behind that number. Each task has the counts of up to
``KNOWN`` tokens; those of all others are joined to the documents by code.

Training is data-parallel: in each of ``ROUNDS`` rounds every task starts from the same
weights, walks over its own texts by Adagrad in numpy, and the weights are averaged, each
task counting by its positions. A round takes every ``ROUNDS``-th chunk of a task's texts,
the next one each round, so every token of the corpus is a target once. Batches grow with
the positions that a task has seen. Only arrays of the network's fixed size reach the
driver. Sums are taken task by task, so results repeat for the same partitions.

Defined results:
* a null or blank text has 0 tokens, log_prob 0 and a null mean; each row has one result
  row, repeated rows and null ids too; an empty table gives an empty result;
* the neighbours beyond a text's ends are one special token; texts count whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import BLOCK_SCHEMA, CHUNK_BYTES, block_batch, staged, sum_blocks, text_chunks, utf8_view
from tidewater.llm.tokens import mixed, tokens_of

#: Classes, and tokens in a class, of the smallest network; a larger corpus has a wider one.
SIDE = 32
RARE = 256
#: A token that occurs at least the root of all tokens times this has a number of its own.
OWN = 0.25
#: Counts of so many tokens at most go to every task; those of the others are joined by code.
KNOWN = 1 << 18
#: Logs are added up as whole numbers of this part, so that sums don't depend on their order.
_UNIT = float(1 << 28)
REACH, HIDDEN = 2, 16
ROUNDS = 2
#: Positions of the first and of the largest batches; one is a 16th of the positions seen in between.
FIRST_BATCH, BATCH, RATE = 256, 4096, 0.3
_STEP = 1 << 11
_PARTS = ["row", "doc_id", "code", "times", "n_tokens", "total"]
#: Pieces in which weights are exchanged, so that no task adds up whole networks.
BLOCKS = 48


class Vocabulary(NamedTuple):
    side: int
    codes: np.ndarray  # of tokens with numbers of their own, sorted
    numbers: np.ndarray  # of those codes
    known: np.ndarray  # codes whose counts are at hand, sorted
    log_counts: np.ndarray  # of those codes
    log_bucket: np.ndarray  # log of the occurrences behind each hashed number

    def numbers_of(self, codes: np.ndarray) -> np.ndarray:
        rare = self.side**2 - RARE + (codes >> np.uint64(56)).astype(np.int64)
        at, found = _find(self.codes, codes)
        return np.where(found, self.numbers[at], rare) if len(self.codes) else rare


def _find(sorted_codes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_codes):
        return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
    at = np.minimum(np.searchsorted(sorted_codes, codes), len(sorted_codes) - 1)
    return at, sorted_codes[at] == codes


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )


def word_counts(docs: DataFrame) -> DataFrame:
    """(code, n): how often each token occurs in the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def given() -> pa.RecordBatch:
            codes, where = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            counts = np.bincount(where, weights=np.concatenate([n for _, n in held]), minlength=len(codes)).astype(np.int64)
            held.clear()
            return pa.record_batch([pa.array(codes.view(np.int64)), pa.array(counts)], names=["code", "n"])

        for batch in text_chunks(batches, limit=CHUNK_BYTES):
            held.append(np.unique(tokens_of(*utf8_view(batch.column("text"))).code, return_counts=True))
            if sum(len(c) for c, _ in held) > 1 << 21:
                yield given()
        if held:
            yield given()

    each = _texts(docs).mapInArrow(run, "code long, n long")
    return each.groupBy("code").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, known: int = KNOWN) -> Vocabulary:
    """Numbers by the corpus counts ``counts`` (code, n)."""
    band = F.floor(F.log2("n") * 8).cast("int")
    bands = counts.groupBy(band.alias("band")).agg(F.count("*").alias("codes"), F.sum("n").alias("n")).collect()
    least, held = 1 << 10, 0
    for band_of, codes, _ in sorted(bands, reverse=True):  # a few hundred rows
        held += codes
        if held > known:
            break
        least = band_of
    table = counts.filter(band >= least).select("code", "n").toArrow()
    code = table["code"].to_numpy().view(np.uint64)
    n = table["n"].to_numpy()
    order = np.lexsort((code.view(np.int64), -n))
    code, n = code[order], n[order]
    own = int((n >= OWN * sum(b["n"] for b in bands) ** 0.5).sum())
    side = max(SIDE, math.isqrt(max(own + RARE - 1, 0)) + 1)
    common = code[: side**2 - RARE]
    behind = np.zeros(RARE)
    bucket = F.shiftrightunsigned("code", 56).cast("int").alias("bucket")
    for at, total in counts.groupBy(bucket).agg(F.sum("n")).collect():  # RARE rows
        behind[at] = total
    np.subtract.at(behind, (common >> np.uint64(56)).astype(np.int64), n[: len(common)])
    first, every = np.argsort(common), np.argsort(code)
    return Vocabulary(side, common[first], first, code[every], np.log(n[every]), np.log(np.maximum(behind, 1)))


class Network:
    """Weights and the two passes; every array is float32."""

    def __init__(self, seed: int = 11, side: int = SIDE) -> None:
        self.side = side  # classes, and tokens in a class
        rng = np.random.default_rng(seed)
        normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        self.weights = {
            "near": normal(0.1, 2 * REACH, side**2 + 1, HIDDEN),
            "bias": np.zeros(HIDDEN, np.float32),
            "class": normal(0.1, HIDDEN, side),
            "class_bias": np.zeros(side, np.float32),
            "word": normal(0.1, side, HIDDEN, side),
            "word_bias": np.zeros((side, side), np.float32),
        }

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights.values()])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for name, w in self.weights.items():
            self.weights[name] = flat[at : at + w.size].reshape(w.shape).astype(np.float32)
            at += w.size
        return self

    def hidden(self, near: np.ndarray) -> np.ndarray:
        w = self.weights
        total = w["near"][0][near[0]] + w["bias"]
        for k in range(1, 2 * REACH):
            total += w["near"][k][near[k]]
        return np.tanh(total, out=total)

    def small_logits(self) -> bool:
        """Whether no logit can overflow exp: hidden values lie between -1 and 1."""
        w = self.weights
        first = np.abs(w["class"]).sum(0) + np.abs(w["class_bias"])
        second = np.abs(w["word"]).sum(1) + np.abs(w["word_bias"])
        return max(float(first.max()), float(second.max())) < 80

    def log_chances(self, near: np.ndarray, token: np.ndarray, small: bool = False) -> np.ndarray:
        """Log chances of tokens in their places; worked out class by class, so that each step has one class."""
        w = self.weights
        cls, word = np.divmod(token, self.side)
        out = np.empty(len(token))
        order = np.argsort(cls.astype(np.uint16), kind="stable")
        bounds = np.searchsorted(cls[order], np.arange(self.side + 1)).tolist()
        for c, (a, b) in enumerate(zip(bounds, bounds[1:])):
            for at in range(a, b, _STEP):
                rows = order[at : min(at + _STEP, b)]
                h = self.hidden(near[:, rows])
                own, inner = h @ w["class"], h @ w["word"][c]
                own += w["class_bias"]
                inner += w["word_bias"][c]
                out[rows] = _log_softmax_at(own, c, small) + _log_softmax_at(inner, word[rows], small)
        return out

    def gradients(self, near: np.ndarray, token: np.ndarray) -> dict[str, np.ndarray]:
        grads, touched = self.gradient_rows(near, token)
        grads["near"] = np.zeros_like(self.weights["near"])
        for k, (ids, rows) in enumerate(touched):
            grads["near"][k][ids] = rows
        return grads

    def gradient_rows(self, near: np.ndarray, token: np.ndarray) -> tuple[dict[str, np.ndarray], list]:
        """Gradients without ``near``, and for each of its places the rows that are not zero."""
        w, h, n = self.weights, self.hidden(near), len(token)
        cls, word = np.divmod(token, self.side)
        cls = cls.astype(np.uint16)
        ones = np.ones(n, h.dtype)
        logits = h @ w["class"]
        logits += w["class_bias"]
        small = self.small_logits()
        up = _softmax_error(logits, cls, small)
        grads = {"class": h.T @ up, "class_bias": ones @ up}
        back = up @ w["class"].T
        grads["word"], grads["word_bias"] = np.zeros_like(w["word"]), np.zeros_like(w["word_bias"])
        order = np.argsort(cls, kind="stable")
        bounds = np.searchsorted(cls[order], np.arange(self.side + 1)).tolist()
        spans = [(c, slice(a, b)) for c, (a, b) in enumerate(zip(bounds, bounds[1:])) if a < b]
        own, logits, more = h[order], np.empty((n, self.side), h.dtype), np.empty_like(h)
        for c, part in spans:
            np.matmul(own[part], w["word"][c], out=logits[part])
        logits += w["word_bias"][cls[order]]
        up = _softmax_error(logits, word[order], small)
        for c, part in spans:
            np.matmul(own[part].T, up[part], out=grads["word"][c])
            np.matmul(ones[part], up[part], out=grads["word_bias"][c])
            np.matmul(up[part], w["word"][c].T, out=more[part])
        back[order] += more
        back *= 1 - h * h
        grads["bias"] = ones @ back
        touched = []
        for k in range(2 * REACH):
            order = np.argsort(near[k], kind="stable")
            ids = near[k][order]
            heads = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            touched.append((ids[heads], np.add.reduceat(back[order], heads, axis=0)))
        return grads, touched


def _log_softmax_at(logits: np.ndarray, at: np.ndarray | int, small: bool) -> np.ndarray:
    if not small:
        logits -= logits.max(axis=1, keepdims=True)
    chosen = logits[np.arange(len(logits)), at]
    return (chosen - np.log(np.exp(logits, out=logits) @ np.ones(logits.shape[1], logits.dtype))).astype(np.float64)


def _softmax_error(logits: np.ndarray, at: np.ndarray, small: bool) -> np.ndarray:
    """Gradient of the mean loss by the logits, which are overwritten."""
    if not small:
        logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits, out=logits)
    p *= (1 / (len(p) * (p @ np.ones(p.shape[1], p.dtype))))[:, None]
    p[np.arange(len(at)), at] -= p.dtype.type(1 / len(p))
    return p


def _numbered(batch: pa.RecordBatch, words: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token numbers, their neighbours' numbers (one row per place), their texts and their codes."""
    t = tokens_of(*utf8_view(batch.column("text")))
    token = words.numbers_of(t.code)
    # 16 bits where they hold all numbers: numpy sorts those by radix
    kind = np.uint16 if words.side**2 < 1 << 16 else np.int64
    token, near = token.astype(kind), np.full((2 * REACH, len(token)), words.side**2, dtype=kind)
    for k in range(1, REACH + 1):
        same = t.text[k:] == t.text[:-k]
        near[k - 1][k:][same] = token[:-k][same]
        near[REACH + k - 1][:-k][same] = token[k:][same]
    return token, near, t.text, t.code


def step(net: Network, squares: dict[str, np.ndarray], near: np.ndarray, token: np.ndarray) -> None:
    """One Adagrad step over a batch; ``squares`` holds the sums of squared gradients."""
    grads, touched = net.gradient_rows(near, token)

    def move(g: np.ndarray, held: np.ndarray) -> np.ndarray:
        """The step along ``g``, whose square is added to ``held``."""
        held += g * g
        g *= -RATE
        g /= np.sqrt(held)
        return g

    for name, g in grads.items():
        net.weights[name] += move(g, squares[name])
    for k, (ids, g) in enumerate(touched):
        held = squares["near"][k][ids]
        net.weights["near"][k][ids] += move(g, held)
        squares["near"][k][ids] = held


def trained(docs: DataFrame, words: Vocabulary, rounds: int = ROUNDS) -> Network:
    net = Network(side=words.side)
    size = len(net.flat())
    width = -(-(size + 1) // BLOCKS)

    for turn in range(rounds):
        start = docs.sparkSession.sparkContext.broadcast((words, net.flat()))

        def run(batches: Iterator[pa.RecordBatch], turn: int = turn, start=start) -> Iterator[pa.RecordBatch]:
            words, flat = start.value
            own, seen = Network(side=words.side).load(flat), 0
            squares = {k: np.full_like(w, 1e-3) for k, w in own.weights.items()}
            for number, batch in enumerate(text_chunks(batches, limit=CHUNK_BYTES)):
                if number % rounds != turn:
                    continue
                token, near, _, _ = _numbered(batch, words)
                order, at = np.random.default_rng(len(token)).permutation(len(token)), 0
                while at < len(order):
                    some = order[at : at + min(max((seen + at) // 16, FIRST_BATCH), BATCH)]
                    step(own, squares, near[:, some], token[some])
                    at += len(some)
                seen += len(order)
            weighted = np.zeros(BLOCKS * width)
            weighted[:size], weighted[-1] = own.flat() * float(seen), seen
            yield block_batch(list(weighted.reshape(BLOCKS, width)), TaskContext.get().partitionId())

        total = np.zeros((BLOCKS, width))
        for block, values in sum_blocks(_texts(docs).mapInArrow(run, BLOCK_SCHEMA), width).items():
            total[block] = values
        total = total.ravel()
        if total[-1]:
            net.load(total[:size] / total[-1])
    return net


def lm_scores(docs: DataFrame, rounds: int = ROUNDS, known: int = KNOWN) -> DataFrame:
    """One row per document: doc_id, n_tokens, log_prob, mean_log_prob."""
    counts = staged(word_counts(docs), "words")
    words = vocabulary(counts, known)
    shared = docs.sparkSession.sparkContext.broadcast((words, trained(docs, words, rounds).flat()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, flat = shared.value
        net, first = Network(side=words.side).load(flat), words.side**2 - RARE
        small = net.small_logits()
        for batch in text_chunks(batches, limit=CHUNK_BYTES):
            token, near, text, code = _numbered(batch, words)
            logs = net.log_chances(near, token, small)
            rare = np.flatnonzero(token >= first)
            at, found = _find(words.known, code[rare])
            logs[rare] -= words.log_bucket[token[rare] - first]
            logs[rare[found]] += words.log_counts[at[found]]
            row = batch.column("row").to_numpy()
            n = np.bincount(text, minlength=batch.num_rows).astype(np.int64)
            total = np.rint(np.bincount(text, weights=logs, minlength=batch.num_rows) * _UNIT).astype(np.int64)
            # a text's own row has no token to look up; its code only spreads such rows
            yield pa.record_batch(
                [batch.column("row"), batch.column("doc_id"), pa.array(mixed(row.view(np.uint64)).view(np.int64)),
                 pa.array(np.zeros(len(row), np.int64)), pa.array(n), pa.array(total)], names=_PARTS
            )
            missed = rare[~found]
            if len(missed):
                order = missed[np.lexsort((code[missed], text[missed]))]
                new = np.ones(len(order), bool)
                new[1:] = (code[order][1:] != code[order][:-1]) | (text[order][1:] != text[order][:-1])
                heads = np.flatnonzero(new)
                times = np.diff(np.append(heads, len(order)))
                zero, at = np.zeros(len(heads), np.int64), order[heads]
                yield pa.record_batch(
                    [pa.array(row[text[at]]), pa.nulls(len(at), pa.int64()), pa.array(code[at].view(np.int64)),
                     pa.array(times), pa.array(zero), pa.array(zero)], names=_PARTS
                )

    texts = _texts(docs).withColumn("row", F.monotonically_increasing_id())
    parts = texts.mapInArrow(run, ", ".join(f"{c} long" for c in _PARTS))
    log = F.round(F.log("n") * _UNIT).cast("long")
    all_parts = parts.join(counts.select("code", log.alias("log")), "code", "left")
    total = F.sum(F.col("total") + F.when(F.col("times") > 0, F.col("times") * F.col("log")).otherwise(F.lit(0)))
    scores = all_parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), (total / _UNIT).alias("log_prob"))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("mean_log_prob")
    return scores.select("doc_id", "n_tokens", "log_prob", mean)
