"""Word hashes and shingle sets of text batches in numpy, and Arrow helpers for the operators.

Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes with A-Z lower-cased.  A word's hash is a polynomial
over a table of random 64-bit values, so sets are compared as sets of 64-bit hashes: two different words
or shingles meet with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

from ..runtime import python_ready

U64 = np.uint64
SPAN, LONG = 1 << 18, 1 << 16  # bytes hashed at once; longer words are hashed by blake2b
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (splitmix finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = mix64(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))[_LOWER]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, U64)
    out[1:] = U64(base)
    return np.multiply.accumulate(out)


_POW = _powers(_BASE, SPAN + LONG + 1)
_INV = _powers(pow(_BASE, -1, 1 << 64), SPAN + LONG + 1)


def words_at(data: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of ``data`` (uint8); no word crosses an offset in ``cuts``."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ink = ~SPACE[data]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    if cuts is not None:
        inner = cuts[(cuts > 0) & (cuts < len(data))]
        first[inner] |= ink[inner]
        last[inner - 1] |= ink[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _TABLE) -> np.ndarray:
    """A 64-bit hash of each word, lower-cased; ``table`` has a value for each byte."""
    out = np.empty(len(starts), U64)
    long = np.flatnonzero(ends - starts > LONG)
    for i in long:
        out[i] = int.from_bytes(blake2b(_LOWER[data[starts[i] : ends[i]]].tobytes(), digest_size=8).digest(), "little")
    for a, b in zip([0, *(long + 1)], [*long, len(starts)], strict=True):
        while a < b:
            at = starts[a]
            c = min(b, max(a + 1, int(np.searchsorted(starts, at + SPAN))))
            run = np.zeros(int(ends[c - 1] - at) + 1, U64)
            np.cumsum(table[data[at : ends[c - 1]]] * _POW[: len(run) - 1], out=run[1:])
            s, e = starts[a:c] - at, ends[a:c] - at
            out[a:c] = (run[e] - run[s]) * _INV[s] + (e - s).astype(U64)
            a = c
    return mix64(out)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` words; with fewer words, of the whole sequence; none without words."""
    n = len(words)
    if n == 0:
        return words
    if n < width:
        total = words * _POW[np.arange(1, n + 1) * 11]
        return mix64(total.sum(dtype=U64, keepdims=True) + U64(n))
    total = np.zeros(n - width + 1, U64)
    for j in range(width):
        total += words[j : n - width + 1 + j] * _POW[7 * j + 3]
    return mix64(total)


def text_bytes(text) -> bytes:
    return b"" if text is None else text.encode()


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8, int(off[-1] - off[0]), int(off[0])) if data is not None and off[-1] > off[0] else np.empty(0, np.uint8)
    return raw, off - off[0]


def texts_words(column: pa.Array, block: int = 1 << 20) -> Iterator[np.ndarray]:
    """The word hashes of each text of a column, computed for about ``block`` bytes at a time."""
    data, off = column_bytes(column)
    i = 0
    while i < len(off) - 1:
        j = max(i + 1, int(np.searchsorted(off, off[i] + block, "right")) - 1)
        part, cuts = data[off[i] : off[j]], off[i : j + 1] - off[i]
        starts, ends = words_at(part, cuts)
        words, at = hash_words(part, starts, ends), np.searchsorted(starts, cuts)
        for d in range(j - i):
            yield words[at[d] : at[d + 1]]
        i = j


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """The distinct shingle hashes, ascending."""
    return np.unique(shingle_hashes(words, width))


def small_batches(spark, rows: int = 400) -> None:
    """Hand texts to Python a few hundred rows at a time, so very long texts fit a worker."""
    python_ready(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
