"""Vectorised byte and word helpers that run inside Arrow batches.

Everything works on one flat ``uint8`` array holding many texts end to end plus an
``int64`` offsets array, the layout Arrow itself uses, so no per-row Python objects
are made.  Hashes are polynomial in a fixed odd base modulo 2**64 over a table of
mixed byte codes and finished with an avalanche step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POW: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Avalanche step: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _codes() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64))


CODES = _codes()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse powers for i < n (cached, grown in steps)."""
    have = _POW.get("p")
    if have is None or len(have) < n:
        size = -(-n // 65_536) * 65_536
        inv = np.uint64(pow(int(BASE), -1, 1 << 64))
        for key, base in (("p", BASE), ("q", inv)):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            _POW[key] = np.multiply.accumulate(out)
    return _POW["p"][:n], _POW["q"][:n]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary Arrow column as (bytes, offsets); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo, hi = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    return body[lo:hi], (offsets - lo if len(offsets) else np.zeros(1, np.int64))


def slices(offsets: np.ndarray, limit: int):
    """Row ranges of at most ``limit`` bytes (one row at least), to bound temporaries."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def prefix_hash(body: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of code(c_t) * BASE**t over t < i, modulo 2**64."""
    out = np.zeros(len(body) + 1, np.uint64)
    pw, _ = powers(max(len(body), 1))
    np.cumsum(CODES[body] * pw[: len(body)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of body[start:end] for arrays of spans."""
    _, inv = powers(len(prefix))
    return mix64((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(np.uint64))


def lower_ascii(body: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[body]


def class_table(separators: bytes) -> np.ndarray:
    """1 for bytes that belong to a word, 0 for separators."""
    table = np.ones(256, np.uint8)
    table[np.frombuffer(separators, np.uint8)] = 0
    return table


def word_spans(body: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """Starts and ends of maximal runs of non-zero equal class within each row, and row word counts.

    Runs never cross a row end. Returns (start, end, first) where first[r]:first[r+1]
    are the words of row r.
    """
    if not len(body):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = table[body]
    change = np.empty(len(body) + 1, bool)
    change[0] = change[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:-1])
    change[offsets] = True
    edge = np.flatnonzero(change)
    keep = kind[edge[:-1]] != 0
    start, end = edge[:-1][keep], edge[1:][keep]
    return start, end, np.searchsorted(start, offsets)
