"""Vectorised kernels over whole texts: words, rolling hashes, window anchors.

A text is UTF-8 bytes. A word is a run of bytes outside 0x20 and 0x09-0x0D,
the byte form of ``[^\\x20\\x09-\\x0D]+``. All hashes are 64 bits wide and the
same on every machine, so they may be joined on.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.Generator(np.random.PCG64(20260101)).integers(1, 2**63, 256, dtype=np.uint64)
_BASE, _BASE2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64, for i below n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        both = []
        for b in (base, pow(base, -1, 2**64)):
            x = np.full(size, U(b), U)
            x[0] = U(1)
            both.append(np.multiply.accumulate(x))
        _powers[base] = have = (both[0], both[1])
    return have[0][:n], have[1][:n]


def sums(symbols: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Prefix sums of which differences are polynomial hashes."""
    out = np.zeros(len(symbols) + 1, U)
    np.cumsum(symbols * powers(len(symbols), base)[0], out=out[1:])
    return out


def sliding(symbols: np.ndarray, n: int, base: int = _BASE) -> np.ndarray:
    """A hash of each n consecutive symbols."""
    if len(symbols) < n:
        return np.zeros(0, U)
    s = sums(symbols, base)
    return mix((s[n:] - s[:-n]) * powers(len(symbols), base)[1][: len(symbols) - n + 1])


def spans_hash(symbols: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _BASE) -> np.ndarray:
    """A hash of each run symbols[start:end], its length included."""
    s = sums(symbols, base)
    return mix((s[end] - s[start]) * powers(len(symbols) + 1, base)[1][start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of a byte array."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.diff(np.concatenate(([True], _SPACE[buf], [True])).view(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return spans_hash(_BYTE[buf], start, end)


def byte_symbols(buf: np.ndarray) -> np.ndarray:
    return _BYTE[buf]


def second(symbols: np.ndarray) -> np.ndarray:
    """Symbols for a second, independent hash: with the first they make 128 bits."""
    return mix(symbols ^ U(0xA0761D6478BD642F))


def window_anchors(symbols: np.ndarray, doc: np.ndarray, length: int, k: int, live: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """For each window of ``length`` symbols of one document its anchor: the
    leftmost smallest hash among the window's k-grams.

    Equal windows have their anchor at the same offset, so a window that
    occurs twice shares an anchor hash. Windows of one anchor are consecutive.
    Only windows that begin where ``live`` is true count, if it is given.
    Returns, by anchor: hash, position, first window, number of windows.
    """
    none = np.zeros(0, np.int64)
    n = len(symbols) - length + 1
    if n <= 0:
        return np.zeros(0, U), none, none, none
    h = sliding(symbols, k)
    wide = length - k + 1
    low, at, span = h, np.arange(len(h), dtype=np.int32), 1
    while span * 2 <= wide:
        take = low[span:] < low[:-span]
        at = np.where(take, at[span:], at[:-span])
        low = np.where(take, low[span:], low[:-span])
        span *= 2
    rest = wide - span
    if rest:
        take = low[rest:] < low[:-rest]
        at = np.where(take, at[rest:], at[:-rest])
    at = at[:n]
    good = doc[:n] == doc[length - 1 :]
    if live is not None:
        good &= live[:n]
    new = np.ones(n, bool)
    new[1:] = (at[1:] != at[:-1]) | (good[1:] != good[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, n))
    keep = good[first]
    first, count = first[keep], count[keep]
    pos = at[first].astype(np.int64)
    return h[pos], pos, first, count
