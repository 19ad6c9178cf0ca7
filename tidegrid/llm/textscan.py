"""Word hashes of whole texts by numpy, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes taken at once; rows are kept whole, so a longer row makes a longer piece.
PIECE = 1 << 20
SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15


def _mixed(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mixed(256, 7)
_power = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n; kept for segments of usual length only."""
    made = dict(_power)
    if len(made["up"]) < n:
        for k, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            f = np.full(n, b, np.uint64)
            f[0] = 1
            made[k] = np.multiply.accumulate(f)
        if n <= 2 * SEGMENT:
            _power.update(made)
    return made["up"], made["down"]


def word_bytes(kind: str) -> np.ndarray:
    """Which bytes belong to words, after A-Z are lower-cased: 'space' for runs without ASCII white space, 'alnum' for runs
    of a-z, 0-9 and everything outside ASCII."""
    out = np.ones(256, bool)
    if kind == "space":
        out[[0x20, *range(0x09, 0x0E)]] = False
    else:
        out[:128] = False
        out[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x41, 0x5B)]] = True
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWERED = _BYTE[_LOWER]


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def pieces(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about PIECE bytes."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + PIECE, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def runs(data: np.ndarray, rel: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start bytes, end bytes) of the longest runs of bytes that are inside; ``rel`` delimits rows, which no run crosses."""
    n = len(data)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edge = rel[(rel > 0) & (rel < n)]
    begin[edge] = inside[edge]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:]
    finish[edge - 1] = inside[edge - 1]
    return np.flatnonzero(begin), np.flatnonzero(finish) + 1


def words(data: np.ndarray, at: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first word of each row and the end, start bytes, end bytes) of the words of the rows that ``at`` delimits.

    Bytes count from ``at[0]``.  A word never crosses rows.
    """
    data = data[at[0] : at[-1]]
    rel = at - at[0]
    a, b = runs(data, rel, member[data])
    h = np.empty(len(a), np.uint64)
    w = 0
    while w < len(a):  # segments of whole words, so that memory stays bounded in long texts
        e = max(w + 1, int(np.searchsorted(b, a[w] + SEGMENT, side="right")))
        lo, hi = a[w], b[e - 1]
        up, down = _powers(int(hi - lo) + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_LOWERED[data[lo:hi]] * up[: hi - lo], out=total[1:])
        h[w:e] = (total[b[w:e] - lo] - total[a[w:e] - lo]) * down[a[w:e] - lo]
        w = e
    return mix(h), np.searchsorted(a, rel), a, b
