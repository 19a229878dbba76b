"""Personal data in texts: fixed patterns, and a linear-chain conditional random field.

The four base kinds (email, ip, card, phone) are found by pattern and check, leftmost and
without overlap within a kind; a match that fails its check is dropped and not tried again
from a later place. The random field adds what patterns miss (secrets, local phone numbers,
IPv6 addresses, account numbers, mail addresses of a bare host). It labels every token of a
text from the shapes of a token and its neighbours. Its weights are learnt on the driver
from a small labelled table. Tasks score the tokens of a batch in numpy, each distinct token
and pair of shapes once, and decode by Viterbi. A token is left out of the decoding where
its scores and its neighbour's alone show that the best sequence has it outside, whatever
the others are; the rest falls into short runs, many of which are decoded at once. Added
spans that meet a base span, or hold neither a digit nor ``@``, are dropped.

Defined results:
* a null or empty text has no spans; every row has one result row, repeated rows and null
  ids too; texts count whole; places are code points, ends exclusive;
* ``n_email`` to ``n_phone`` count the base spans, ``n_account`` and ``n_secret`` what the
  field added of these kinds, ``n_spans`` all spans; ``spans`` lists them, by kind (the base
  kinds first), then start; an empty table gives an empty result;
* extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.shared import text_chunks

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("email", "ip", "phone", "account", "secret")
KINDS = (*BASE_KINDS, "account", "secret")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit run that fails can't match from its middle, so a match may only start a run.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CLUE = re.compile(r"[0-9@=]")
_TOKEN = re.compile(r"\S+")
_LOCAL_REACH = 256
_PLAIN = re.compile(r"([A-ZÀ-ÖØ-Þ]?)[a-zß-öø-ÿ]+([.,]?)")
_IN_TURNS = re.compile("[xXwd]{4,}")
_NOT_HEX = re.compile(r"[g-zß-öø-ÿ]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start, reach = at, _LOCAL_REACH
        while start == at or start > done and at - start >= reach // 2:  # widen until the run's start is in view
            low = max(done, at - reach)
            found = _LOCAL.search(text[low:at]) if text[at - 1 : at] and at > done else None
            start = low + found.start() if found else at
            if not found or start > low or low == done:
                break
            reach *= 2
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of the base kinds, by kind as listed, then start."""
    out = [("email", *x) for x in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


# -- shapes ------------------------------------------------------------------------------

#: Rows of each feature's weight table; features are hashed into them.
SLOT = 1024
N_FEATURES = 7
TAGS = 1 + 2 * len(ADDED_KINDS)


@cache
def _hashed(feature: str) -> int:
    return int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=4).digest(), "little") % SLOT


def _char_class(c: str) -> str:
    return "d" if c in "0123456789" else "x" if c.islower() else "X" if c.isupper() else "w" if c.isalpha() else c


def shape(token: str) -> str:
    """Character classes of a token with runs collapsed, letters and digits in turns as one class; signs at its end are left out."""
    out, last = [], ""
    for c in map(_char_class, token.rstrip("!?#$%&*.,;:") or token):
        if c != last:
            out.append(c)
            last = c
    return _IN_TURNS.sub("m", "".join(out))


def _marks(token: str) -> str:
    n, digits = len(token), sum(c in "0123456789" for c in token)
    core = token.strip("\"'`()[]{}<>,.;:!?#$%&*")
    core = core.rpartition("=")[2].strip("\"'") or core
    mixed = len(core) >= 12 and bool(re.fullmatch(r"[A-Za-z0-9_/+-]+", core))
    mixed = mixed and any(c in "0123456789" for c in core) and any(c.isalpha() for c in core)
    hexed = bool(re.fullmatch(r"[0-9a-fA-F]{12,}", core))
    numeric = len(core) if core.isascii() and core.isdigit() else 0
    parts = [n // 4 if n < 40 else 8 + n.bit_length() // 2, 4 * digits // max(n, 1), mixed, hexed, (len(core) // 6).bit_length() if mixed else 0]
    return f"{parts}{min(numeric, 20) // 2}{_signs(token)}"


def _signs(token: str) -> str:
    return f"{'@' in token}{token.count(':')}{'=' in token}{token.count('-')}{token[:1] == '('}"


def features(tokens: list[str]) -> np.ndarray:
    """Feature rows of a sequence of tokens: their own shape, size and marks, and the neighbours'."""
    return Types().rows(tokens, [len(tokens)])


class Types:
    """Feature rows of tokens, worked out once for each distinct token and pair of shapes."""

    KEPT = 1 << 19

    def __init__(self) -> None:
        self.shapes: dict[str, int] = {"^": 0, "$": 1}
        self.names = ["^", "$"]
        self.tokens: dict[str, int] = {}
        self.table = np.zeros((1024, 6), dtype=np.int32)  # shape, then rows of features 0, 1, 4, 5 and 6
        self.pairs: dict[int, tuple[int, int]] = {}
        self.plain: dict[tuple, int] = {}
        self.count = 0

    def _new(self, token: str) -> int:
        key = None
        m = _PLAIN.fullmatch(token)
        if m and (len(token) < 12 or _NOT_HEX.search(token)):  # such words of one length look the same
            key = (bool(m[1]), len(token), m[2])
            if key in self.plain:
                self.tokens[token] = self.plain[key]
                return self.plain[key]
        own, n = shape(token), self.count
        if own not in self.shapes:
            self.shapes[own] = len(self.names)
            self.names.append(own)
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        found = [own, _marks(token), own, own, f"{_signs(token)}{len(token) >= 12}"]
        self.table[n] = [self.shapes[own], *(k * SLOT + _hashed(f"{k}{f}") for k, f in zip((0, 1, 4, 5, 6), found))]
        self.tokens[token] = n
        self.count += 1
        if key:
            self.plain[key] = n
        return n

    def _pair(self, code: int) -> tuple[int, int]:
        a, b = self.names[code >> 32], self.names[code & 0xFFFFFFFF]
        out = self.pairs[code] = tuple(k * SLOT + _hashed(f"{k}{a}|{b}") for k in (2, 3))
        return out

    def of(self, tokens: Iterable[str]) -> np.ndarray:
        """Numbers of tokens; they hold until the next call."""
        if len(self.tokens) > self.KEPT:
            self.__init__()
        known, new = self.tokens.get, self._new
        return np.fromiter((k if (k := known(t)) is not None else new(t) for t in tokens), np.int64)

    def around(self, types: np.ndarray, sizes: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shapes of tokens and of their neighbours, in sequences of ``sizes`` tokens."""
        own = self.table[types, 0].astype(np.int64)
        before, after = np.roll(own, 1), np.roll(own, -1)
        ends = np.cumsum([n for n in sizes if n])
        before[np.append(0, ends[:-1])] = 0
        after[ends - 1] = 1
        return own, before, after

    def assembled(self, types: np.ndarray, own: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        out = np.zeros((len(types), N_FEATURES), dtype=np.int64)
        out[:, [0, 1, 6]] = self.table[types][:, [1, 2, 5]]
        edge = np.array([k * SLOT + _hashed(f"{k}{f}") for k, f in ((4, "^"), (5, "$"))])
        by_shape = np.zeros((len(self.names), 2), dtype=np.int64)
        by_shape[self.table[: self.count, 0]] = self.table[: self.count, 3:5]
        by_shape[[0, 1], [0, 1]] = edge
        out[:, 4], out[:, 5] = by_shape[before, 0], by_shape[after, 1]
        for column, code in ((2, before << 32 | own), (3, own << 32 | after)):
            pairs, back = np.unique(code, return_inverse=True)
            rows = [(self.pairs.get(c) or self._pair(c))[column - 2] for c in pairs.tolist()]
            out[:, column] = np.array(rows, dtype=np.int64)[back]
        return out

    def rows(self, tokens: list[str], sizes: Sequence[int]) -> np.ndarray:
        types = self.of(tokens)
        if not len(types):
            return np.zeros((0, N_FEATURES), dtype=np.int64)
        return self.assembled(types, *self.around(types, sizes))


# -- the random field --------------------------------------------------------------------


def _allowed() -> np.ndarray:
    """0 where a tag may follow another, -inf-like where not: inside only after its own kind."""
    out = np.zeros((TAGS, TAGS))
    for k in range(len(ADDED_KINDS)):
        inside = 2 + 2 * k
        out[:, inside] = -1e6
        out[[inside - 1, inside], inside] = 0
    return out


class Field:
    """Weights of the random field; ``emission`` by feature and tag, ``step`` by tag pair."""

    def __init__(self) -> None:
        self.emission = np.zeros((N_FEATURES * SLOT, TAGS))
        self.step = np.zeros((TAGS, TAGS))

    def scores(self, feats: np.ndarray) -> np.ndarray:
        return self.emission[feats].sum(axis=-2)

    def scores_of(self, feats: np.ndarray) -> np.ndarray:
        """``scores`` of a long list of tokens, one feature after the other."""
        out = self.emission[feats[:, 0]]
        for k in range(1, N_FEATURES):
            out += self.emission[feats[:, k]]
        return out

    def viterbi(self, runs: list[np.ndarray]) -> list[np.ndarray]:
        """Best tags of sequences of feature rows, outside at both ends."""
        return self.decoded([self.scores(r) for r in runs])

    def outside(self, scores: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Where every best sequence has a token outside, whatever the rest of it is.

        A sequence that tags such a token otherwise gets better by tagging it outside (and
        by beginning the span one token later, if it goes on). The bounds hold for all tags
        of the neighbours, or for outside where that is settled or a sequence ends (``first``
        and ``last`` mark the ends); so what is settled settles more.
        """
        step = self.step + _allowed()
        inside = np.arange(2, TAGS, 2)
        free = np.setdiff1d(np.arange(TAGS), inside)
        lead = np.stack([(step - step[:, :1]).max(axis=0), step[0] - step[0, 0]])  # over the tag before, or outside
        trail = np.stack([(step[:, free] - step[0, free]).max(axis=1), step[:, 0] - step[0, 0]])
        gain = scores[:, :1] - scores
        later = np.zeros((len(scores), len(inside)))  # of beginning later instead of going on
        later[:-1] = scores[1:, inside - 1] - scores[1:, inside]
        out = np.zeros(len(scores) + 1, dtype=bool)  # the last for the place before the first
        at = np.arange(len(scores))
        while len(at):
            ahead, behind = lead[(first[at] | out[at - 1]).astype(int)], last[at] | out[at + 1]
            settled = (gain[at] > ahead + trail[behind.astype(int)])[:, 1:].all(axis=1)
            for k, i in enumerate(inside.tolist()):
                rest = (step[i] - step[i - 1]).max()
                for tag in (i - 1, i):
                    goes_on = ahead[:, tag] + step[tag, i] - step[0, i - 1] + rest
                    settled &= behind | (gain[at, tag] + later[at, k] > goes_on)
            new = at[settled]
            out[new] = True
            near = np.unique(np.concatenate([new - 1, new + 1]))
            near = near[(near >= 0) & (near < len(scores))]
            at = near[~out[near]]
        return out[:-1]

    def decoded(self, runs: list[np.ndarray]) -> list[np.ndarray]:
        """Best tags of each run of scores, runs of like length decoded together; outside at both ends."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(runs)
        order = sorted(range(len(runs)), key=lambda i: len(runs[i]))
        step = self.step + _allowed()
        at = 0
        while at < len(order):
            longest = len(runs[order[at]]) * 5 // 4 + 4
            to = at
            while to < len(order) and len(runs[order[to]]) <= longest and (to - at) * longest < 200_000:
                to += 1
            some, at = order[at:to], to
            sizes = np.array([len(runs[i]) for i in some])
            n, t = len(some), int(sizes.max())
            scores = np.zeros((n, t, TAGS))
            for k, i in enumerate(some):
                scores[k, : sizes[k]] = runs[i]
            best, back = scores[:, 0] + step[0], np.zeros((n, t, TAGS), dtype=np.int8)
            ends = np.where((sizes == 1)[:, None], best, -np.inf)
            for j in range(1, t):
                ways = best[:, :, None] + step
                back[:, j] = ways.argmax(axis=1)
                best = ways.max(axis=1) + scores[:, j]
                ends = np.where((sizes == j + 1)[:, None], best, ends)
            tag = (ends + step[:, 0]).argmax(axis=1)
            tags = np.zeros((n, t), dtype=np.int64)
            for j in range(t - 1, -1, -1):
                tags[:, j] = np.where(j < sizes, tag, 0)
                tag = np.where(j < sizes, back[np.arange(n), j, tag], tag) if j else tag
            for k, i in enumerate(some):
                out[i] = tags[k, : sizes[k]]
        return out

    def gradients(self, feats: np.ndarray, tags: np.ndarray, real: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log likelihood of padded runs and its gradients (forward-backward in log space)."""
        n, t = tags.shape
        scores = np.where(real[:, :, None], self.scores(feats), 0.0)
        step = self.step + _allowed()
        ahead = np.zeros((n, t, TAGS))
        ahead[:, 0] = scores[:, 0] + step[0]
        for j in range(1, t):
            new = _log_sum(ahead[:, j - 1, :, None] + step, 1) + scores[:, j]
            ahead[:, j] = np.where(real[:, j, None], new, ahead[:, j - 1])
        total = _log_sum(ahead[:, -1] + step[:, 0], 1)
        behind = np.zeros((n, t, TAGS))
        behind[:, -1] = step[:, 0]
        for j in range(t - 2, -1, -1):
            new = _log_sum(step[None] + (scores[:, j + 1] + behind[:, j + 1])[:, None, :], 2)
            behind[:, j] = np.where(real[:, j + 1, None], new, step[:, 0])
        share = np.exp(ahead + behind - total[:, None, None]) * real[:, :, None]
        emission, moves = np.zeros_like(self.emission), np.zeros_like(self.step)
        gold = np.eye(TAGS)[tags] * real[:, :, None]
        apart, rows = (gold - share).reshape(-1, TAGS), feats.reshape(-1, N_FEATURES)
        for tag in range(TAGS):
            weight = np.repeat(apart[:, tag], N_FEATURES)
            emission[:, tag] = np.bincount(rows.ravel(), weights=weight, minlength=len(emission))
        like = -total.sum() + (gold * scores).sum()
        last = real.sum(1) - 1
        before = np.concatenate([np.zeros((n, 1), np.int64), tags[:, :-1]], axis=1)
        for a, b in ((before[real], tags[real]), (tags[np.arange(n), last], np.zeros(n, np.int64))):
            np.add.at(moves, (a, b), 1)
            like += step[a, b].sum()
        moves[0] -= share[:, 0].sum(0)
        moves[:, 0] -= share[np.arange(n), last].sum(0)
        for j in range(1, t):
            ways = ahead[:, j - 1, :, None] + step + (scores[:, j] + behind[:, j])[:, None, :]
            moves -= (np.exp(ways - total[:, None, None]) * real[:, j, None, None]).sum(0)
        return float(like), emission, moves


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def labelled_rows(seed: int = 5, each: int = 16) -> list[tuple[str, str]]:
    """The default labelled table: (text, spans), spans as kind:start:end, comma-joined.

    Sentences are filled from patterns by a seeded generator, plain, in capitals, or with
    signs put after every word; those without spans teach what is not personal (versions,
    dates, amounts, short numbers, assignments).
    """
    rng = random.Random(seed)
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    digits, hexa, low, alnum = "0123456789", "0123456789abcdef", "abcdefghiklmnoprstuvwz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    name = lambda: rng.choice(("password", "token", "secret", "key", "api_key", "auth", "pwd"))
    word = lambda: pick(low + rng.choice(("", "éüñ")), rng.randint(1, 12))
    made = {
        "secret": [
            lambda: (f"{name()}=", pick(hexa, rng.choice((16, 18, 24, 32))), ""), lambda: (f'{name()} = "', pick(hexa, rng.choice((32, 40, 64))), '"'),
            lambda: (f'{name()}: "', pick(hexa, 40), '"'), lambda: ("", "AKIA" + pick(alnum, 16), ""),
            lambda: (f"{name()}: ", "sk_" + pick(low + digits, 14) + pick(digits + low.upper(), 10), ""),
            lambda: (f"{name()}='", pick(low + low.upper() + digits, 22) + "7aB", "'"), lambda: ("", "ghp_" + pick(low + low.upper() + digits, 28) + "4kZ9", ""),
            lambda: (f"{name()} = ", pick(hexa, 40), ""),
        ],
        "phone": [
            lambda: ("", f"{pick(digits, 3)}-{pick(digits, 3)}-{pick(digits, 4)}", ""), lambda: ("", f"({pick(digits, 3)}) {pick(digits, 3)}-{pick(digits, 4)}", ""),
            lambda: ("", f"0{pick(digits, 3)}/{pick(digits, 7)}", ""), lambda: ("", f"{pick(digits, 3)}.{pick(digits, 3)}.{pick(digits, 4)}", ""),
        ],
        "email": [lambda: ("", f"{word()}{pick(digits, 2)}@{word()}", ""), lambda: ("", f"{word()}.{word()}@localhost", "")],
        "ip": [lambda: ("", ":".join(pick(hexa, 4) for _ in range(8)), ""), lambda: ("", "fe80::" + ":".join(pick(hexa, 4) for _ in range(3)), "")],
        "account": [
            lambda: ("", pick("ADEFGNS", 2) + pick(digits, 2) + pick(digits, 18), ""), lambda: ("", pick(digits, rng.choice((14, 15, 16, 18))), ""), lambda: ("", pick(digits, 16), ""), lambda: ("", pick(digits, 16), ""),
            lambda: ("", pick("ADEFGNS", 2) + pick(digits, 2) + " " + " ".join(pick(digits, 4) for _ in range(4)), ""),
            lambda: ("", "-".join(pick(digits, 4) for _ in range(4)), ""), lambda: ("", " ".join(pick(digits, 4) for _ in range(4)), ""),
        ],
    }
    plain = [
        lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 9)}.", lambda: f"20{pick(digits, 2)}-{pick('01', 2)}-{pick('012', 2)}", lambda: str(rng.randint(0, 10 ** rng.randint(1, 10))),
        lambda: f"{word()}={word()}", lambda: f"{word()} = {rng.randint(0, 999)}", lambda: f"${rng.randint(1, 999)}.{pick(digits, 2)}", lambda: f"{word()}{rng.randint(0, 99)}",
        lambda: f"{rng.randint(1, 12)}:{pick('012345', 2)}", lambda: f"@{word()}", lambda: f"{rng.randint(1, 99)}%", lambda: f"({rng.randint(1, 2030)})", lambda: f"{word()}-{rng.randint(1, 20)}",
        lambda: "###", lambda: "=" * rng.randint(1, 9), lambda: "| " + word() + " |", lambda: f"{rng.randint(1, 400)},{pick(digits, 3)}", lambda: f"{word()}{pick(digits, 1)}{word()}{pick(digits, 2)}",
        lambda: f"+{pick(digits, 1)} ({pick(digits, 3)}) {pick(digits, 3)}-{pick(digits, 4)} x", lambda: f"{word()}.{pick(digits, 2)}@{word()}.example.com",
        lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), lambda: f'{name()} = "{word()}"', lambda: f"{word()}, Version {rng.randint(1, 9)}.{rng.randint(0, 9)}.", lambda: f"CC BY-NC {rng.randint(1, 5)}.0.",
        lambda: " ".join(word() for _ in range(12)), lambda: f"{word()}_{word()}-{word()}/{word()}", lambda: f"{word().capitalize()}. {word().capitalize()}", lambda: " | ".join(word() for _ in range(4)),
    ]
    rows = []

    def row(kind: str, head: str, value: str, tail: str) -> None:
        noise, loud = rng.choice(("!!", "###", "$$$", "%%%", "&&&", "***")) * (rng.random() < 0.25), rng.random() < 0.1
        words = lambda: " ".join(word() + noise for _ in range(rng.randint(2, 5)))
        text = f"{words()} {head}"
        start = len(text)
        after = "" if noise and kind else rng.choice(["", ".", ",", ""])
        text += value + tail + (noise or after) + f" {words()}"
        rows.append((text.upper() if loud and len(text.upper()) == len(text) else text, f"{kind}:{start}:{start + len(value)}" if kind else ""))

    for _ in range(each):
        for kind, forms in made.items():
            for form in forms:
                row(kind, *form())
        for form in plain:
            row("", "", form(), "")
    return rows


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_rows(), "text string, spans string")


def _by_length(data: list[tuple[np.ndarray, list[int]]]) -> Iterator[list[tuple[np.ndarray, list[int]]]]:
    """Runs in groups of like length, so that padding stays under a third."""
    some: list[tuple[np.ndarray, list[int]]] = []
    for run in sorted(data, key=lambda x: len(x[1])):
        if some and len(run[1]) > len(some[0][1]) * 4 // 3 + 1:
            yield some
            some = []
        some.append(run)
    yield some


def _padded(data: list[tuple[np.ndarray, list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, tags and which places are real, of runs padded to one length."""
    longest = max(len(t) for _, t in data)
    feats = np.zeros((len(data), longest, N_FEATURES), dtype=np.int64)
    tags, real = np.zeros((len(data), longest), dtype=np.int64), np.zeros((len(data), longest), dtype=bool)
    for i, (f, t) in enumerate(data):
        feats[i, : len(t)], tags[i, : len(t)], real[i, : len(t)] = f, t, True
    return feats, tags, real


@cache
def fitted(rows: tuple[tuple[str, str], ...]) -> Field:
    """``train``, kept by its rows: a second query of the process doesn't fit again."""
    return train(list(rows))


def train(rows: list[tuple[str, str]], epochs: int = 150, rate: float = 0.6, decay: float = 3e-5) -> Field:
    """Fit a field to labelled texts by Adagrad on the penalised likelihood."""
    data = []
    for text, spans in rows:
        marked = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in (spans or "").split(",") if s)]
        found = [(m[0], m.start()) for m in _TOKEN.finditer(text or "")]
        tokens, places = [t for t, _ in found], [p for _, p in found]
        tags = []
        for token, place in found:
            tag = 0
            for kind, a, b in marked:
                if kind in ADDED_KINDS and place < b and a < place + len(token):
                    first = not any(p < b and a < p + len(t) for t, p in zip(tokens[: len(tags)], places))
                    tag = 2 * ADDED_KINDS.index(kind) + (1 if first else 2)
            tags.append(tag)
        if tokens:
            data.append((features(tokens), tags))
    field = Field()
    if not data:
        return field
    groups = [_padded(some) for some in _by_length(data)]
    squares = [np.full_like(field.emission, 1e-6), np.full_like(field.step, 1e-6)]
    for _ in range(epochs):
        each = [field.gradients(*group) for group in groups]
        emission, moves = (sum(x[k] for x in each) for k in (1, 2))
        for weights, grad, square in ((field.emission, emission, squares[0]), (field.step, moves, squares[1])):
            grad = grad / len(data) - decay * weights
            square += grad * grad
            weights += rate * grad / np.sqrt(square)
    return field


_TRIM_LEFT, _TRIM_RIGHT = "\"'`[{<,.;!?|=:#$%&*", "\"'`)]}>,.;!?|=:#$%&*"


def _tag_spans(text: str, tokens: list[str], places: list[int], tags: np.ndarray) -> Iterator[tuple[str, int, int]]:
    i = 0
    while i < len(tokens):
        if tags[i] == 0:
            i += 1
            continue
        kind, j = ADDED_KINDS[(int(tags[i]) - 1) // 2], i + 1
        while j < len(tokens) and tags[j] == tags[i] + tags[i] % 2:
            j += 1
        start, end = places[i], places[j - 1] + len(tokens[j - 1])
        i = j
        if kind == "secret" and "=" in text[start:end].rstrip("="):
            start = text.index("=", start, end) + 1
        while start < end and text[start] in _TRIM_LEFT:
            start += 1
        while end > start and text[end - 1] in _TRIM_RIGHT:
            end -= 1
        found = text[start:end]
        if _CLUE.search(found) and any(c in "0123456789@" for c in found):
            yield kind, start, end


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


#: Tokens that one numpy step scores, and characters of a text beyond which its tokens aren't held as strings.
STEP, LONG = 1 << 16, 1 << 22


def added_spans(texts: list[str], field: Field, types: Types) -> list[list[tuple[str, int, int]]]:
    """Spans of each text by the field: every token is scored, the unsettled ones are decoded."""
    numbers = [types.of(t.split() if len(t) <= LONG else (m[0] for m in _TOKEN.finditer(t))) for t in texts[:1]]
    for t in texts[1:]:
        if len(types.tokens) > types.KEPT:  # numbers hold for one table only: the rest by itself
            return added_spans(texts[: len(numbers)], field, types) + added_spans(texts[len(numbers) :], field, types)
        numbers.append(types.of(t.split() if len(t) <= LONG else (m[0] for m in _TOKEN.finditer(t))))
    sizes = [len(x) for x in numbers]
    out: list[list] = [[] for _ in texts]
    every = np.concatenate(numbers) if numbers else np.empty(0, np.int64)
    if not len(every):
        return out
    shapes = types.around(every, sizes)
    last = np.zeros(len(every), dtype=bool)
    last[np.cumsum([n for n in sizes if n]) - 1] = True
    first, settled = np.append(True, last[:-1]), np.zeros(len(every), dtype=bool)

    def scores(a: int, b: int) -> np.ndarray:
        return field.scores_of(types.assembled(every[a:b], *(x[a:b] for x in shapes)))

    for at in range(0, len(every), STEP):  # the token after the step counts, too
        to = min(at + STEP, len(every))
        settled[at:to] = field.outside(scores(at, min(to + 1, len(every))), first[at : to + 1], last[at : to + 1])[: to - at]
    open_ = ~settled
    begins = np.flatnonzero(open_ & np.concatenate([[True], settled[:-1] | last[:-1]]))
    ends = np.flatnonzero(open_ & (last | np.concatenate([settled[1:], [True]]))) + 1
    some = np.concatenate([np.arange(a, b) for a, b in zip(begins, ends)]) if len(begins) else np.empty(0, np.int64)
    if not len(some):
        return out
    flat = field.scores_of(types.assembled(every[some], *(x[some] for x in shapes)))
    tags = field.decoded(np.split(flat, np.cumsum(ends - begins)[:-1]))
    starts, places = np.cumsum([0, *sizes]), {}
    of_text = np.searchsorted(starts, begins, side="right") - 1
    for i, a, b, own in zip(of_text.tolist(), begins.tolist(), ends.tolist(), tags):
        if own.any():
            if i not in places:
                places = {i: [m.span() for m in _TOKEN.finditer(texts[i])]}
            where = places[i][a - starts[i] : b - starts[i]]
            out[i] += _tag_spans(texts[i], [texts[i][x:y] for x, y in where], [x for x, _ in where], own)
    return out


@cache
def _types() -> Types:
    """A worker's table, kept from task to task."""
    return Types()


def find_pii(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_account, n_secret, n_spans.

    ``labelled``: the field's training table (text, spans); it is read on the driver and
    must be small. By default the table that ``labelled_table`` makes.
    """
    rows = labelled_rows() if labelled is None else [(r["text"], r["spans"]) for r in labelled.select("text", "spans").collect()]
    shared = docs.sparkSession.sparkContext.broadcast(fitted(tuple(rows)))
    names = ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_account", "n_secret", "n_spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, types = shared.value, _types()
        for batch in text_chunks(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            out = []
            for text, more in zip(texts, added_spans(texts, field, types)):
                own = base_spans(text) if _CLUE.search(text) else []
                free = [s for s in more if not any(s[1] < b and a < s[2] for _, a, b in own)]
                every = sorted({*own, *free}, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
                counts = [sum(s[0] == kind for s in own) for kind in BASE_KINDS]
                joined = hashlib.sha256(_joined(own).encode()).hexdigest(), _joined(every)
                out.append((*counts, *joined, *(sum(s[0] == k for s in every) for k in ("account", "secret")), len(every)))
            columns = [batch.column("doc_id")]
            columns += [pa.array(c, pa.string() if k in (4, 5) else pa.int64()) for k, c in enumerate(zip(*out))]
            yield pa.record_batch(columns, names=names)

    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return each.mapInArrow(run, ", ".join(f"{c} {'string' if c in ('base_sha256', 'spans') else 'long'}" for c in names))
