"""Vectorised work on the UTF-8 bytes of Arrow columns: words, their hashes, and hashes of byte windows.

Everything here sees a batch of texts as one run of bytes with offsets, as Arrow stores it, so that no Python string is
made per word. Words and shingles are hashed by chains that mix each eight bytes (each word) into the state before the next one.
Spans of short fixed lengths (13 words, a hundred or two bytes) have polynomials mod 2**64, taken from prefix sums and mixed at the
end; these are not used for spans of any length, as long repetitive strings over two letters make such polynomials equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20240131).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = {"n": 0}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that white space parts: all but the space and 0x09 to 0x0D.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words of digits, letters and everything from 0x80, once A-Z are lower case.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets of its values; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """first, last + 1, bytes and offsets of runs of texts of about ``limit`` bytes; a longer text is a run of its own."""
    data, at = text_bytes(column)
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, mod 2**64."""
    if _powers["n"] < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, U)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=U)
        _powers["n"] = size
    return _powers["up"][:n], _powers["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit depends on all."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """0 and the running sums of values * base**i, from which ``span_hashes`` takes any span's hash."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], dtype=U, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end]; equal values and lengths give equal hashes wherever they stand."""
    _, down = powers(len(sums))
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(U))


def byte_sums(data: np.ndarray) -> np.ndarray:
    return prefix_sums(_BYTE_VALUES[data])


#: Bytes of the longest words that are hashed side by side; longer ones are few or of a text of their own.
SIDE_BY_SIDE = 256


def _stirred(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The state after the next value; for a given state it is a bijection of values."""
    h = (h ^ x) * U(0x9FB21C651E98DF25)
    h ^= h >> U(32)
    return h


def bytes_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of data[start:end], of any length; another seed gives unrelated ones."""
    size = end - start
    h = mixed(size.astype(U) + U(seed * 0xD1B54A32D192ED03 & (1 << 64) - 1))
    lanes = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    live = np.flatnonzero((size > 0) & (size <= SIDE_BY_SIDE))
    for k in range(0, SIDE_BY_SIDE, 8):
        if not len(live):
            break
        x, left = lanes[start[live] + k], size[live] - k
        short = left < 8
        x[short] &= (U(1) << (left[short] * 8).astype(U)) - U(1)
        h[live] = mixed(_stirred(h[live], x))
        live = live[left > 8]
    for i in np.flatnonzero(size > SIDE_BY_SIDE).tolist():
        digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little"))
        h[i] = int.from_bytes(digest.digest(), "little")
    return h


def word_spans(data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start and end of the words of a run of texts, and the n + 1 offsets into them by text."""
    inside = kind[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = at[:-1] < at[1:]
    before[at[:-1][full]] = False
    after[at[1:][full] - 1] = False
    start = np.flatnonzero(inside & ~before)
    return start, np.flatnonzero(inside & ~after) + 1, np.searchsorted(start, at)


class Words:
    """The words of a run of texts in lower case: start, end (bytes), at (n + 1 offsets into them by text), hash."""

    def __init__(self, data: np.ndarray, at: np.ndarray, kind: np.ndarray):
        self.data = LOWER[data]
        self.start, self.end, self.at = word_spans(self.data, at, kind)
        self.hash = self.hashes()

    def hashes(self, seed: int = 0) -> np.ndarray:
        return bytes_hashes(self.data, self.start, self.end, seed)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words in a text, and their n + 1 offsets; shorter texts give their whole sequence."""
        counts = np.diff(self.at)
        n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
        out_at = np.concatenate([[0], np.cumsum(n)])
        text = np.repeat(np.arange(len(n)), n)
        start = np.arange(out_at[-1]) - out_at[text] + self.at[text]
        whole = max(0, len(self.hash) - k + 1)
        h = np.full(whole, k, U)
        for j in range(k):
            h = _stirred(h, self.hash[j : whole + j])
        out = np.empty(len(start), U)
        full = counts[text] >= k
        out[full] = h[start[full]]
        first = start[~full]
        size = counts[text[~full]]
        h = size.astype(U)
        for j in range(k - 1):
            more = size > j
            h[more] = _stirred(h[more], self.hash[first[more] + j])
        out[~full] = h
        return mixed(out), out_at


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Index of the least value in each window of w, the first of equals; needs len(values) >= w."""
    n, best, done = len(values), np.arange(len(values)), 1
    while done < w:
        step = min(done, w - done)
        left, right = best[: n - done - step + 1], best[step : n - done + 1]
        best = np.where(values[right] < values[left], right, left)
        done += step
    return best
