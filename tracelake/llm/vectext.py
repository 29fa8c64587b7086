"""Vectorised text primitives on Arrow string columns.

Everything here works on the raw UTF-8 buffers that Arrow hands to a Python worker: words are found
with byte masks, hashed with a prefix-sum polynomial (mod 2**64, odd base, so it can be inverted) and
combined into word shingles without a Python loop over words.  Buffers are handled in pieces of a few
megabytes, so the working memory does not depend on the batch or (bar a single giant word) the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
SHINGLE_WORDS = 5

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64) over uint64 values."""
    x = np.asarray(x, dtype=_U)
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U(30))
        x = x * _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


def _byte_table() -> np.ndarray:
    """A random 64-bit value for each byte; A-Z share those of a-z."""
    with np.errstate(over="ignore"):
        t = mix64((np.arange(256, dtype=_U) + _U(1)) * _U(0x9E3779B97F4A7C15))
    t[65:91] = t[97:123]
    return t


FOLDED = _byte_table()
BASE = 0x5851F42D4C957F2D
UNBASE = pow(BASE, -1, 1 << 64)

#: Bytes of a word in the sense of ``[^\x20\x09-\x0D]+``.
SPACE_SPLIT = np.ones(256, dtype=bool)
SPACE_SPLIT[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n).bit_length())
        out = np.full(size, _U(base), dtype=_U)
        out[0] = 1
        with np.errstate(over="ignore"):
            np.cumprod(out, out=out)
        _powers[base] = have = out
    return have


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    n = len(column)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; a longer row is a range of its own."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


def word_spans(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray = SPACE_SPLIT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row) for rows given by offsets; the last array has one entry more than rows.

    Positions are relative to ``offsets[0]``; a word never spans two rows.
    """
    lo, hi = int(offsets[0]), int(offsets[-1])
    tok = inside[raw[lo:hi]]
    n = len(tok)
    rel = offsets - lo
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    edge = rel[:-1][np.diff(rel) > 0]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = tok[:-1]
    before[edge] = False
    starts = np.flatnonzero(tok & ~before)
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = tok[1:]
    after[edge[1:] - 1] = False
    ends = np.flatnonzero(tok & ~after) + 1
    return starts, ends, np.searchsorted(starts, rel)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = FOLDED, limit: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each byte span, the same wherever the span lies."""
    out = np.empty(len(starts), dtype=_U)
    a = 0
    with np.errstate(over="ignore"):
        while a < len(starts):
            b = int(np.searchsorted(starts, starts[a] + limit))
            lo, hi = int(starts[a]), int(ends[b - 1])
            sums = np.empty(hi - lo + 1, dtype=_U)
            sums[0] = 0
            np.cumsum(table[raw[lo:hi]] * _power(BASE, hi - lo)[: hi - lo], out=sums[1:])
            s, e = starts[a:b] - lo, ends[a:b] - lo
            out[a:b] = (sums[e] - sums[s]) * _power(UNBASE, hi - lo)[s] + (e - s).astype(_U)
            a = b
    return mix64(out)


_STEP = [_U(pow(0xD6E8FEB86659FD93, k, 1 << 64)) for k in range(32)]


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words (of one flat array, row borders included)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    with np.errstate(over="ignore"):
        out = words[:n] * _STEP[1]
        for k in range(1, size):
            out += words[k : k + n] * _STEP[k + 1]
    return mix64(out + _U(size))


def shingle_rows(raw: np.ndarray, offsets: np.ndarray, size: int = SHINGLE_WORDS) -> Iterator[tuple[int, np.ndarray, int]]:
    """(row, shingle hashes in text order, number of words) for every row; words split at white space, A-Z lower-cased.

    A text with fewer words than ``size`` has its whole sequence as its one shingle; one without words has none.
    """
    for a, b in pieces(offsets):
        part = offsets[a : b + 1]
        starts, ends, first = word_spans(raw, part)
        words = span_hashes(raw[int(part[0]) : int(part[-1])], starts, ends)
        runs = window_hashes(words, size)
        for i in range(b - a):
            lo, hi = int(first[i]), int(first[i + 1])
            n = hi - lo
            if n >= size:
                yield a + i, runs[lo : hi - size + 1], n
            elif n:
                yield a + i, window_hashes(words[lo:hi], n), n
            else:
                yield a + i, runs[:0], 0


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
