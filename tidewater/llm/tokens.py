"""Tokens of byte text as numpy arrays: bounds, hashes and the text they belong to."""

from __future__ import annotations

from functools import cache
from typing import NamedTuple

import numpy as np

_BASE = 0xD6E8FEB86659FD93
SPACE, WORD, SYMBOL = 0, 1, 2


class Tokens(NamedTuple):
    start: np.ndarray
    stop: np.ndarray
    code: np.ndarray
    kind: np.ndarray
    text: np.ndarray


@cache
def _kinds() -> np.ndarray:
    """Kind of each byte: ASCII white space and controls, letters and digits, other signs."""
    kind = np.full(256, WORD, dtype=np.uint8)
    for b in range(128):
        c = chr(b)
        kind[b] = WORD if c.isalnum() else SPACE if b <= 32 or b == 127 else SYMBOL
    return kind


#: Powers up to this number are kept; those of a longer text are made for it.
_KEPT = 1 << 20


def _made(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_kept = cache(_made)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the base and of its inverse modulo 2^64."""
    return _kept(_KEPT) if n <= _KEPT else _made(n)


def mixed(code: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit codes, so that low bits can pick a bucket."""
    code = code ^ (code >> np.uint64(31))
    code = code * np.uint64(0x7FB5D329728EA185)
    return code ^ (code >> np.uint64(27))


def tokens_of(data: np.ndarray, ends: np.ndarray) -> Tokens:
    """Maximal runs of one kind, white space left out, that lie in one of the texts.

    ``data`` holds the texts end to end, ``ends`` their bounds (first 0). A token's code is
    a 64-bit hash of its bytes.
    """
    if not len(data):
        none = np.empty(0, np.int64)
        return Tokens(none, none, none.astype(np.uint64), none.astype(np.uint8), none)
    kind = _kinds()[data]
    edge = np.ones(len(data) + 1, dtype=bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[ends] = True
    at = np.flatnonzero(edge)
    start, stop = at[:-1], at[1:]
    real = kind[start] != SPACE
    start, stop = start[real], stop[real]
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    code = mixed((sums[stop] - sums[start]) * down[start])
    text = np.repeat(np.arange(len(ends) - 1), np.diff(np.searchsorted(start, ends)))
    return Tokens(start, stop, code, kind[start], text)


def per_text(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` for each of ``n`` texts."""
    return np.bincount(text, weights=values, minlength=n) if len(text) else np.zeros(n)
