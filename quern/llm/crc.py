"""CRC-32 of words and of runs of words, without writing any run out.

The CRC of ``A`` followed by ``B`` is that of ``A`` shifted by the length of ``B``, xor that of ``B``. A shift by one byte is a 32 x 32
matrix over GF(2); shifts by more are its powers. Each matrix is kept as four tables of 256 (one for each byte of what is shifted).
"""

from __future__ import annotations

import zlib

import numpy as np

#: Shifts of up to SHORT bytes have a table of their own; words of more than LONG bytes are taken one by one.
SHORT, LONG = 64, 48


def _times(columns: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The matrix with these columns times each of ``x``."""
    bits = (x[..., None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)
    return np.bitwise_xor.reduce(bits * columns, axis=-1)


def _tables(columns: np.ndarray) -> np.ndarray:
    """(4, 256): what each value of each byte becomes."""
    byte = np.arange(256, dtype=np.uint32)
    return np.stack([_times(columns, byte << np.uint32(8 * i)) for i in range(4)])


#: The step of a byte through the register, by the reflected polynomial of CRC-32.
_STEP = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _STEP = (_STEP >> np.uint32(1)) ^ (_STEP & np.uint32(1)) * np.uint32(0xEDB88320)
_UNITS = np.uint32(1) << np.arange(32, dtype=np.uint32)
_ONE = _STEP[_UNITS & 255] ^ (_UNITS >> np.uint32(8))  # the matrix of one zero byte


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Tables of shifts by 0 to SHORT bytes, and by 1, 2, 4, ... bytes."""
    short, columns = [], _UNITS
    for _ in range(SHORT + 1):
        short.append(_tables(columns))
        columns = _times(_ONE, columns)
    square, columns = [], _ONE
    for _ in range(40):
        square.append(_tables(columns))
        columns = _times(columns, columns)
    return np.stack(short), np.stack(square)


_SHORT, _SQUARE = _powers()


def shift(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What each CRC becomes when ``length`` zero bytes follow (no conditioning: the linear part alone)."""
    n = np.minimum(length, SHORT)
    out = _SHORT[n, 0, crc & 255]
    for i in (1, 2, 3):
        out ^= _SHORT[n, i, (crc >> np.uint32(8 * i)) & 255]
    if len(more := np.flatnonzero(length > SHORT)):
        rest, x = length[more] - SHORT, out[more]
        for k in range(int(rest.max()).bit_length()):
            t = _SQUARE[k]
            moved = t[0, x & 255] ^ t[1, (x >> np.uint32(8)) & 255] ^ t[2, (x >> np.uint32(16)) & 255] ^ t[3, x >> np.uint32(24)]
            x = np.where((rest >> k) & 1, moved, x)
        out[more] = x
    return out


def join(a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of strings with CRC ``a`` followed by strings with CRC ``b`` and ``length`` bytes."""
    return shift(a, length) ^ b


def of(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The CRC of each stretch of ``raw``: all stretches step by step, longest first, so that those still running are a prefix."""
    length = end - start
    order = np.argsort(-length, kind="stable")
    begin, size = start[order], length[order]
    state = np.full(len(order), 0xFFFFFFFF, np.uint32)
    at = np.searchsorted(-size, -LONG, "left")  # stretches of over LONG bytes
    for j in range(int(min(size[at], LONG)) if at < len(size) else 0):
        to = np.searchsorted(-size, -j, "left")
        x = state[at:to]
        state[at:to] = _STEP[(x ^ raw[begin[at:to] + j]) & 255] ^ (x >> np.uint32(8))
    out = np.empty(len(order), np.uint32)
    out[order] = ~state
    for i in order[:at]:
        out[i] = zlib.crc32(raw[start[i] : end[i]])
    return out


def runs(crc: np.ndarray, length: np.ndarray, most: int, between: bytes = b" "):
    """For k of 1 to ``most``: CRCs of the runs of k consecutive words from each word on, as far as words go, ``between`` put between
    words; run i of k words starts at word i."""
    gap = zlib.crc32(between)
    lead = join(np.full(len(crc), gap, np.uint32), crc, length)  # between, and the word
    run = crc
    yield run
    for k in range(1, most):
        run = join(run[:-1], lead[k:], length[k:] + len(between)) if len(run) else run
        yield run
