"""Hashed features of letter words, for the trained classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .text_hash import U64, _powers, mix64

#: Bytes that are looked at together; a longer text is cut between words (a longer word inside).
PIECE = 1 << 19
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_TABLE = mix64(np.arange(1, 257, dtype=U64) * U64(0xCA5A826395121157))
_POW, _INV = _powers(0x9FB21C651E98DF25, PIECE + 1), _powers(pow(0x9FB21C651E98DF25, -1, 1 << 64), PIECE + 1)


def fold_of(key: Column) -> Column:
    """crc32 of the key as text, modulo 5; null for a null key."""
    return (F.crc32(key.cast("string").cast("binary")) % 5).cast("int")


def pieces(text: str | None) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of the lower-cased text in pieces that end between words."""
    data = np.frombuffer((text or "").lower().encode(), np.uint8)
    at = 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        if end < len(data):
            gaps = np.flatnonzero(~LETTER[data[at:end]])
            end = at + int(gaps[-1]) + 1 if len(gaps) else end
        yield data[at:end]
        at = end


class Words:
    """The letter words of a piece (several texts: with the offsets that separate them)."""

    def __init__(self, data: np.ndarray, cuts: np.ndarray | None = None):
        ink = LETTER[data]
        first, last = ink.copy(), ink.copy()
        first[1:] &= ~ink[:-1]
        last[:-1] &= ~ink[1:]
        if cuts is not None:
            inner = cuts[(cuts > 0) & (cuts < len(data))]
            first[inner] |= ink[inner]
            last[inner - 1] |= ink[inner - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(_TABLE[data] * _POW[: len(data)], out=self.sums[1:])

    def __len__(self) -> int:
        return len(self.starts)

    def print_of(self, a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
        """Hashes of the bytes from a to b as features of one kind."""
        return mix64((self.sums[b] - self.sums[a]) * _INV[a] + U64(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1))

    def whole(self) -> np.ndarray:
        return self.print_of(self.starts, self.ends, 1)

    def prefix(self, n: int) -> np.ndarray:
        return self.print_of(self.starts, np.minimum(self.starts + n, self.ends), 10 + n)

    def suffix(self, n: int) -> np.ndarray:
        return self.print_of(np.maximum(self.ends - n, self.starts), self.ends, 30 + n)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n-grams inside words, and the word of each."""
        count = np.maximum(self.ends - self.starts - n + 1, 0)
        word = np.repeat(np.arange(len(self)), count)
        at = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count) + self.starts[word]
        return self.print_of(at, at + n, 50 + n), word


def labelled_sample(docs: DataFrame, label: str, per_label: int, key: str, most_bytes: int, columns: list[str]) -> list:
    """Rows for training: of each label those of least key hash, at most ``per_label``; whole texts of at
    most ``most_bytes``.  Only keys outside fold 0 are learned from.

    All labels are counted in one scan and sampled in a second one; a model holds weights for each label,
    so one count a label is no more than it.
    """
    ready = docs.where((fold_of(F.col(key)) != 0) & F.col("text").isNotNull() & F.col(label).isNotNull() & (F.octet_length("text") <= most_bytes) & (F.length("text") > 0))
    counts = {r[0]: r["n"] for r in ready.groupBy(label).agg(F.count("*").alias("n")).collect()}
    # only rows of hashes low enough to be among the first are ranked, so few rows are shuffled
    shares = {value: (1.5 * per_label + 100) / n for value, n in counts.items()}
    limits = [x for value, share in shares.items() if share < 1 for x in (F.lit(value), F.lit(int(-(2**63) + share * 2**64)))]
    low = ready.withColumn("_hash", F.xxhash64(key))
    if limits:
        most = F.try_element_at(F.create_map(*limits), F.col(label))
        low = low.where(most.isNull() | (F.col("_hash") < most))
    place = F.row_number().over(Window.partitionBy(label).orderBy("_hash", "text"))
    return low.withColumn("_place", place).where(F.col("_place") <= per_label).orderBy(label, "_place").select(*columns).collect()
