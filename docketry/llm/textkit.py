"""Hashes of words and word windows of many texts at once, with numpy.

A word's hash is a polynomial over its bytes in 64-bit arithmetic with random byte values, taken from
prefix sums and mixed; a window's hash is a mixed sum of its words' hashes with one odd factor for
each place. Hashes are the same in all processes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

WS = b" \t\n\x0b\x0c\r"
_CHUNK = 1 << 19
_GAP = re.compile(b"[ \t\n\x0b\x0c\r]")
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_IS_WS = np.zeros(256, dtype=bool)
_IS_WS[list(WS)] = True
_POWERS: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values with good avalanche."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        m = max(n, 2 * _CHUNK + 2)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(m, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def _chunk_hashes(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of a buffer."""
    arr = np.frombuffer(buf, dtype=np.uint8)
    ws = _IS_WS[arr]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], ws, [True]]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _powers(len(arr) + 1)
    total = np.zeros(len(arr) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[arr] * up[: len(arr)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def _pieces(buf: bytes) -> Iterator[tuple[int, int, bool]]:
    """(from, to, one long word?) of parts of at most two chunks that split no word, and of words longer than a chunk."""
    lo, n = 0, len(buf)
    while lo < n:
        hi = min(n, lo + _CHUNK)
        gap = _GAP.search(buf, hi) if hi < n else None
        end = gap.start() if gap else n
        if end - hi > _CHUNK:
            begin = max(buf.rfind(bytes([c]), lo, hi) for c in WS) + 1 or lo
            if begin > lo:
                yield lo, begin, False
            yield begin, end, True
        else:
            yield lo, end, False
        lo = end


def _long_word(buf: bytes) -> np.ndarray:
    """The hash of one word, chunk by chunk."""
    total = 0
    for lo in range(0, len(buf), _CHUNK):
        part = np.frombuffer(buf, dtype=np.uint8, count=min(_CHUNK, len(buf) - lo), offset=lo)
        up, _ = _powers(len(part))
        total += int((_BYTE[part] * up[: len(part)]).sum(dtype=np.uint64)) * pow(_BASE, lo, 1 << 64)
    return mix64(np.array([(total + len(buf)) % (1 << 64)], dtype=np.uint64))


def _text_hashes(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    if len(buf) <= 2 * _CHUNK:
        return _chunk_hashes(buf)
    hashes, starts = [], []
    for lo, hi, long in _pieces(buf):
        h, at = (_long_word(buf[lo:hi]), np.zeros(1, dtype=np.int64)) if long else _chunk_hashes(buf[lo:hi])
        hashes.append(h)
        starts.append(at + lo)
    return np.concatenate(hashes), np.concatenate(starts)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of all texts, first): text i has the words first[i]:first[i + 1]."""
    hashes, counts, i = [], [], 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < _CHUNK):
            size += len(texts[j]) + 1
            j += 1
        h, starts = _text_hashes(b" ".join(texts[i:j]))
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts[i:j]])
        counts.append(np.diff(np.searchsorted(starts, bounds)))
        hashes.append(h)
        i = j
    first = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64) if counts else np.zeros(1, dtype=np.int64)
    return np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64), first


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of words[i:i + k] at each i that has k words (document borders are the caller's)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        total += words[j : j + n] * _PLACE[j]
    return mix64(total)


def windows_of(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the k-word windows that lie in one document each."""
    if len(words) < k:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    last = np.repeat(first[1:], np.diff(first))
    ok = np.flatnonzero(np.arange(len(words)) + k <= last)
    return window_hashes(words, k)[ok], ok


def shingle_sets(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; a shorter text is one shingle; no words, none."""
    words, first = word_hashes(texts)
    all_h = window_hashes(words, k)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        n = int(b - a)
        if n >= k:
            out.append(np.unique(all_h[a : b - k + 1]))
        elif n:
            out.append(window_hashes(words[a:b], n))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
