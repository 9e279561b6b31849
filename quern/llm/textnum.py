"""Words of whole texts as 64-bit numbers, computed on UTF-8 bytes with numpy.

A chunk of an Arrow string column becomes one byte array; words are runs of word bytes inside a row, and a word's
number is a polynomial of its bytes modulo 2**64, taken from one running sum over the chunk and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _pow(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, base, U)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 1 << 21:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that near-by numbers become unrelated ones."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _table(is_word) -> tuple[np.ndarray, np.ndarray]:
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    return low, np.array([is_word(int(b)) for b in low])


#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased: digits, letters and all beyond ASCII.
ALNUM = _table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: Words ``[^\x20\x09-\x0D]+`` after A-Z are lower-cased: all but ASCII white space.
SPACED = _table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose texts hold about ``most`` bytes (a longer text stands alone)."""
    n = batch.num_rows
    if not n:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and each row's start, with the end behind; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def bounds(raw: np.ndarray, at: np.ndarray, kind: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and ends of all words in order; no word reaches over a row's start (``at``, as of :func:`flat`)."""
    n = len(raw)
    low, table = kind
    inside = table[low[raw]]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    return start, np.flatnonzero(inside & (~after | edge[1:])) + 1


def words(texts: pa.Array, kind: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all words in order, each row's first word's place with the count behind)."""
    raw, at = flat(texts)
    n = len(raw)
    if not n:
        return np.zeros(0, U), np.zeros(len(at), np.int64)
    start, end = bounds(raw, at, kind)
    total = np.zeros(n + 1, U)
    np.cumsum((kind[0][raw].astype(U) + U(1)) * _pow(_BASE, n), out=total[1:])
    number = mix((total[end] - total[start]) * _pow(_INV, n)[start])
    return number, np.searchsorted(start, at)


def shingles(number: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of each row's runs of ``k`` words (all its words as one where it has fewer), and where each row's start."""
    count = np.diff(at)
    made = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    to = np.zeros(len(at), np.int64)
    np.cumsum(made, out=to[1:])
    total = int(to[-1])
    if not total:
        return np.zeros(0, U), to
    row = np.repeat(np.arange(len(count)), made)
    first = at[:-1][row] + np.arange(total) - to[:-1][row]
    left = at[1:][row] - first
    out = np.zeros(total, U)
    padded = np.concatenate([number, np.zeros(k, U)])
    for j in range(k):
        out = mix(out * U(0xD6E8FEB86659FD93) + np.where(left > j, padded[first + j], U(0)) + U(j + 1))
    return out, to
