"""Word and shingle hashes of a whole Arrow batch of texts at once, in numpy.

A word is `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z.  Its hash is a polynomial over its bytes,
modulo 2**64: with prefix sums of byte * P**position, each word's value is one difference times
P**-start, so a batch needs a few array passes and no Python loop over words.  Hashes depend on the
word alone, so they agree between tasks, runs and machines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes that are hashed at one go; a longer text is one go of its own.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit (two multiply-shift rounds)."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


#: The bytes that are white space: \x20 and \x09-\x0D.
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_BYTE = mix(_FOLD.astype(U) + U(1))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, at most for the longest go so far."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK), base, U)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def goes(column: pa.Array, size: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about `size` bytes, CHUNK if 0."""
    data, at = utf8(column)
    row = 0
    while row < len(at) - 1:
        end = max(row + 1, int(np.searchsorted(at, at[row] + (size or CHUNK), "right")) - 1)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text where its words begin (with one end more)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    inner = ~_SPACE[data]
    first, last = inner.copy(), inner.copy()
    first[1:] &= ~inner[:-1]
    last[:-1] &= ~inner[1:]
    edge = at[:-1][np.diff(at) > 0]
    first[edge] = inner[edge]
    stop = at[1:][np.diff(at) > 0] - 1
    last[stop] = inner[stop]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, at)


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and for each text where its words begin (with one end more)."""
    start, end, of = word_spans(data, at)
    if not len(start):
        return np.zeros(0, U), of
    total = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=total[1:])
    h = (total[end] - total[start]) * _power(_INVERSE, len(data))[start]
    return mix(h + (end - start).astype(U) * U(0xA24BAED4963EE407)), of


_ROLL = mix(np.arange(11, 75, dtype=U)) | U(1)


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n neighbours in h; shorter than h by n - 1."""
    out = np.zeros(max(0, len(h) - n + 1), U)
    for k in range(n if len(out) else 0):
        out += h[k : k + len(out)] * _ROLL[k]
    return mix(out + U(n))


def shingle_sets(column: pa.Array, n: int = 5) -> Iterator[np.ndarray]:
    """For each text its sorted distinct n-word shingles; fewer words: the whole sequence as one;
    none without words or text."""
    for row, end, data, at in goes(column):
        h, of = word_hashes(data, at)
        runs = ngram_hashes(h, n)
        for k in range(end - row):
            a, b = of[k], of[k + 1]
            if b - a >= n:
                s = np.sort(runs[a : b - n + 1])
                yield s[np.flatnonzero(np.diff(s, prepend=s[0] + U(1)))] if len(s) else s
            elif b > a:
                yield ngram_hashes(h[a:b], int(b - a))
            else:
                yield np.zeros(0, U)
