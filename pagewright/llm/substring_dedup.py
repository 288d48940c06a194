"""Suffix-array dedup: remove every byte covered by a long string that also starts anywhere else.

Winnowing cuts the start positions of a text into intervals by content: positions whose first window of
hashes has the same least gram lie in one interval, and equal long strings start in intervals around
equal grams.  The bytes from one interval to the next are a piece, and a block of texts is a sequence of
pieces.  Its suffix array (grouping construction) decides what repeats inside the block:

1. an interval repeats as a whole if its suffix shares its whole context (all bytes of the strings that
   start in it) with a neighbour in the array; its bytes are given out there and then;
2. intervals that share their context with each other are one class, and one of them goes on for all.

So a passage in a third of all texts is one row a block.  What goes on meets the other blocks:

3. an interval whose core (the bytes that all its long strings hold) is met in one class only is done;
4. a context that two blocks have, by its fingerprint of 128 bits, repeats at every start;
5. the others are the edges of repeats: there every start's long string is counted by itself, by 96 bits.

Shorter passages that repeat are told of, not removed: a string of ``passage`` bytes holds the anchor (the gram
and the bytes after it) of an interval around it.  Anchors are the cores by which blocks meet first, then.

Only fingerprints and places move between tasks, with counts combined before each shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..runtime import cut_lineage, cut_to_table
from .suffix_array import common_prefixes, suffix_array
from .text_hash import U64, _powers, mix64, small_batches

#: Start positions that are looked at together; longer texts are cut, with their contexts overlapping.
SEGMENT = 1 << 17
#: Bytes of text of a block whose suffix array is made.
BLOCK = 1 << 21
GRAM = 8
#: Bytes of the passages that ``op8_suffix_array`` tells of: 51 words of five bytes, their spaces counted.
PASSAGE = 255
#: The bits of a context's second fingerprint that tell all bytes its long strings share.
DEEP = (1 << 32) - 1
#: Rows of one core that meet in one task, about; a core of more is dealt to several.
CORE_ROWS = 4000
#: Lists of at most so many places or runs in all (about 40 bytes each) are broadcast to the texts; longer ones are joined by key.
BROADCAST_ITEMS = 1_000_000

_TABLES = [mix64(np.arange(1, 257, dtype=U64) * U64(k)) for k in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_BASES = [0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]
_GROWN: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _power_pair(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, (n - 1).bit_length())
    if (which, size) not in _GROWN:
        _GROWN[which, size] = _powers(_BASES[which], size), _powers(pow(_BASES[which], -1, 1 << 64), size)
    return _GROWN[which, size]


class Prints:
    """Fingerprints of any substring of some bytes."""

    def __init__(self, data: np.ndarray, words: tuple[int, ...] = (0, 1)):
        self.sums, self.inverse = [], []
        for which in words:
            power, inverse = _power_pair(which, len(data) + 1)
            run = np.zeros(len(data) + 1, U64)
            np.cumsum(_TABLES[which][data] * power[: len(data)], out=run[1:])
            self.sums.append(run)
            self.inverse.append(inverse)

    def of(self, which: int, a: np.ndarray, b: np.ndarray, salt=0) -> np.ndarray:
        raw = (self.sums[which][b] - self.sums[which][a]) * self.inverse[which][a]
        return mix64(raw + np.asarray(salt).astype(U64) * U64(0x9E3779B97F4A7C15))


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` consecutive values."""
    n = len(x)
    pad = -n % w
    grid = np.concatenate([x, np.full(pad, np.iinfo(U64).max, U64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def window(length: int) -> int:
    """Grams a window: about a third of the length, so cores keep the rest."""
    return max(2, min(128, length // 3))


def intervals(data: np.ndarray, length: int, w: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last start position of each interval, and the position of its gram."""
    w, n = w or window(length), len(data)
    starts = n - length + 1
    grams = np.empty(n - GRAM + 1, U64)
    for r in range(GRAM):
        part = data[r : r + (n - r) // GRAM * GRAM].view("<u8")
        grams[r::GRAM] = part[: len(grams[r::GRAM])]
    grams = grams[: starts + w - 1]
    at = np.arange(len(grams), dtype=U64)
    # the rightmost of equal grams wins
    order = (grams * U64(0x9E3779B97F4A7C15) & U64(0xFFFFFFFF00000000)) | (U64(0xFFFFFFFF) - at)
    least = (U64(0xFFFFFFFF) - (_sliding_least(order, w) & U64(0xFFFFFFFF))).astype(np.int64)[:starts]
    lo = np.concatenate([[0], np.flatnonzero(np.diff(least)) + 1])
    return lo, np.append(lo[1:], starts) - 1, least[lo]


def segments(data: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Parts of a text with their offsets; each start position is in one part."""
    for a in range(0, max(0, len(data) - length + 1), SEGMENT):
        yield a, np.ascontiguousarray(data[a : a + SEGMENT + length - 1])


class Part(NamedTuple):
    """A segment of a text with its intervals and pieces."""

    id: int
    print: int
    offset: int
    lo: np.ndarray  # first and last start of each interval, within the segment
    hi: np.ndarray
    gram: np.ndarray  # the gram's place after lo
    core: np.ndarray
    context: tuple[np.ndarray, np.ndarray]  # fingerprints of two words
    pieces: tuple[np.ndarray, np.ndarray]  # the same of the pieces: each interval's, and the tail
    rest: tuple[np.ndarray, np.ndarray]  # starts and cores of the anchors after all intervals, at the text's end
    met: np.ndarray  # 1 for each core, those of the rest too, that is the text's first of its kind, else 0


def cut_part(id: int, own: int, offset: int, part: np.ndarray, length: int, passage: int | None = None, ends: bool = True, seen: np.ndarray | None = None) -> Part:
    """``ends`` tells that the text ends with the part; ``seen`` has the cores of the parts before it."""
    w, none = window(length), np.zeros(0, U64)
    p = Prints(part)
    starts = max(0, len(part) - length + 1)
    lo, hi, gram = intervals(part, passage or length, w)
    core = p.of(0, gram, gram + (passage or length) - w + 1)
    inner, late = lo < starts, (lo >= starts) & ends
    rest = lo[late], core[late]
    lo, hi, gram, core = (x[inner] for x in (lo, np.minimum(hi, starts - 1), gram, core))
    cores = np.concatenate([core, rest[1]])
    met = np.zeros(len(cores), np.int64)
    met[np.unique(cores, return_index=True)[1]] = 1
    if seen is not None:
        met[np.isin(cores, seen)] = 0
    if not starts:
        return Part(id, own, offset, lo, hi, gram, core, (none, none), (none, none), rest, met)
    deep = p.of(0, gram, gram + length - w + 1)
    shape = (gram - lo) * (length + 1) + (hi - lo) + 1
    f1, f2 = (p.of(k, lo, hi + length, shape) for k in (0, 1))
    f2 = f2 & ~U64(DEEP) | deep >> U64(32)
    begin, end = np.append(lo, hi[-1] + 1), np.append(hi + 1, len(part))
    return Part(id, own, offset, lo, hi, gram - lo, core, (f1, f2), tuple(p.of(k, begin, end) for k in (0, 1)), rest, met)


def _symbols(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, int]:
    """Whole numbers from 0 that are equal where both fingerprints are, and how many."""
    distinct, at, symbols = np.unique(first, return_index=True, return_inverse=True)
    if (second[at][symbols] != second).any():
        distinct, symbols = np.unique(np.stack([first, second], 1), axis=0, return_inverse=True)
    return symbols.ravel(), len(distinct)


def block_classes(parts: list[Part], length: int) -> tuple[np.ndarray, np.ndarray]:
    """For all intervals of a block: whether it repeats as a whole inside it, and whether it stands for its class.

    Both are read off the suffix array of the block's pieces: suffixes that share the most are neighbours.
    """
    symbols, n = _symbols(*(np.concatenate([p.pieces[k] for p in parts]) for k in (0, 1)))
    text: list[int] = []
    ends, need, gram = [], [], []
    at = 0
    for k, p in enumerate(parts):
        text += symbols[at : at + len(p.lo) + 1].tolist()
        text.append(n + k)  # separators differ, so no prefix crosses a text
        at += len(p.lo) + 1
        ends.append(np.append(p.lo, [p.hi[-1] + 1, p.hi[-1] + length]))
        need.append(np.append(p.hi - p.lo + length, [0, 0]))
        gram.append(np.append(p.gram, [0, 0]))
    array = suffix_array(text)
    order, shared = np.array(array), np.array(common_prefixes(text, array))
    ends, need, gram = (np.concatenate(x)[order] for x in (ends, need, gram))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))

    def bytes_shared(symbols_shared: np.ndarray) -> np.ndarray:
        return ends[place[np.minimum(order + symbols_shared, len(order) - 1)]] - ends

    before = bytes_shared(shared) >= need  # shares its context with the suffix before it in the array
    after = bytes_shared(np.append(shared[1:], 0)) >= need
    alike = before.copy()
    alike[1:] &= (need[1:] == need[:-1]) & (gram[1:] == gram[:-1])
    real = need > 0
    repeats, stands = np.zeros(len(order), bool), np.zeros(len(order), bool)
    repeats[order], stands[order] = real & (before | after), real & ~alike
    some = np.zeros(len(order), bool)
    some[order] = real
    return repeats[some], stands[some]


def block_rows(parts: list[Part], length: int) -> pa.RecordBatch:
    """What a block gives out: runs of bytes that repeat inside it (n = 0), one row for each class of
    intervals (n = 1, or 2 if it repeats inside the block), and the anchors of the rest (n = 3).  ``met``
    is 1 for the first row of a core in its text, 2 for what repeats inside the block."""
    rows = []
    for p in parts:
        at, core = p.rest
        m, none = len(at), np.zeros(len(at), np.int64)
        rows.append((np.full(m, p.id), np.full(m, p.print), p.offset + at, none, core.view(np.int64), none, none, none + 3, p.met[len(p.lo) :]))
    parts = [p for p in parts if len(p.lo)]
    repeats, stands = block_classes(parts, length) if parts else (None, None)
    cuts = np.cumsum([0, *(len(p.lo) for p in parts)])
    for p, a, b in zip(parts, cuts[:-1], cuts[1:], strict=True):
        edge = np.diff(np.concatenate([[0], repeats[a:b].astype(np.int8), [0]]))
        lo, end = p.lo[np.flatnonzero(edge == 1)], p.hi[np.flatnonzero(edge == -1) - 1] + length
        own = np.flatnonzero(stands[a:b])
        none = np.zeros(len(lo), np.int64)
        m = len(lo) + len(own)
        rows.append((
            np.full(m, p.id), np.full(m, p.print), p.offset + np.append(lo, p.lo[own]), np.append(end - lo, p.hi[own] - p.lo[own] + 1),
            *(np.append(none, x.view(np.int64)[own]) for x in (p.core, *p.context)), np.append(none, repeats[a:b][own] + 1),
            np.append(none, np.where(repeats[a:b], 2, p.met[: len(p.lo)])[own]),
        ))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)).cast(k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=ROWS)


ROWS = ["id", "print", "lo", "size", "core", "f1", "f2", "n", "met"]


def _texts(batch, column: str = "text"):
    for t in batch.column(column):
        t = t.as_py()
        yield np.frombuffer(b"" if t is None else t.encode(), np.uint8)


def _keyed(docs: DataFrame, key: str, text: str) -> list:
    """``id`` and ``print``, which tell a text: its key and a hash of it; a text of null key has another hash for an id."""
    data = F.coalesce(F.col(text), F.lit(""))
    return [F.coalesce(F.col(key).cast("long"), F.xxhash64(data, F.lit("no key"))).alias("id"), F.xxhash64(data).alias("print")]


def repeated_spans(docs: DataFrame, length: int, key: str = "doc_id", text: str = "text", passage: int | None = None) -> DataFrame:
    """id, print, lo, end: the maximal runs of removable bytes [lo, end) of the texts that have some; with
    ``passage`` also a row of null ``lo`` and ``end`` for each text with an anchor that stands in another text.

    A text is known by its id and 64 bits of its bytes (null ids: 128 bits).
    """
    if passage and not window(length) + GRAM <= passage + 1 <= length + 1:
        raise ValueError(f"a passage has {window(length) + GRAM - 1} to {length} bytes")
    spark = docs.sparkSession
    small_batches(spark)
    least = passage or length
    table = docs.select(*_keyed(docs, key, text), F.col(text).alias("text")).where(F.octet_length("text") >= least)

    def blocks(batches):
        parts, held = [], 0
        for b in batches:
            for i, own, data in zip(b.column("id").to_pylist(), b.column("print").to_pylist(), _texts(b), strict=True):
                seen = None
                for a, part in segments(data, length) if len(data) >= length else [(0, data)]:
                    parts.append(cut_part(i, own, a, part, length, passage, a + len(part) == len(data), seen))
                    if len(data) > len(part):
                        seen = parts[-1].core if seen is None else np.concatenate([seen, parts[-1].core])
                    held += len(part)
                    if held >= BLOCK:
                        yield block_rows(parts, length)
                        parts, held = [], 0
        if parts:
            yield block_rows(parts, length)
        parts = None
        pa.default_memory_pool().release_unused()

    found = cut_to_table(table.mapInArrow(blocks, "id long, print long, lo long, size int, core long, f1 long, f2 long, n int, met int"))
    runs = found.where("n = 0").select("id", "print", "lo", (F.col("lo") + F.col("size")).alias("end"))
    rows = found.where("n > 0")
    shared = rows.groupBy("core").agg(F.count("*").alias("classes"), F.sum("met").alias("met")).where("classes > 1")
    shared = cut_to_table(shared.select("core", F.ceil(F.col("classes") / CORE_ROWS).cast("int").alias("shares"), (F.col("met") > 1).alias("told")))
    # the rows of a common core are dealt into shares
    common = F.broadcast(shared.where("shares > 1").select("core", "shares"))
    dealt = rows.drop("met").join(common, "core", "left").withColumn("share", F.coalesce(F.pmod(F.xxhash64("id", "print", "lo"), "shares"), F.lit(0)).cast("int")).drop("shares")
    each = shared.select("core", "told", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    places = cut_to_table(dealt.join(each, ["core", "share"]).drop("share"))
    told = places.where("told").select("id", "print").distinct() if passage else None
    places = places.where("n < 3")
    kinds = places.groupBy("f1", "f2").agg(F.sum("n").alias("n"), F.min(F.struct("id", "print", "lo", "size", "core")).alias("first"))
    kinds = cut_to_table(kinds.select("f1", "f2", "n", "first.*"))
    # those that repeat inside a block are among the runs already
    whole = places.where("n = 1").join(kinds.where("n > 1").select("f1", "f2"), ["f1", "f2"]).select("id", "print", "lo", (F.col("lo") + F.col("size") - 1 + length).alias("end"))

    # edges: contexts of equal shared bytes, one of them met once; one place stands for each context
    kinds = kinds.withColumn("deep", F.col("f2").bitwiseAND(F.lit(DEEP)))
    mixed = kinds.groupBy("core", "deep").agg(F.count("*").alias("contexts"), F.min("n").alias("least")).where("contexts > 1 and least = 1")
    asked = kinds.join(mixed, ["core", "deep"], "left_semi").groupBy("id", "print").agg(F.collect_list(F.struct("lo", "size", (F.col("n") == 1).alias("alone"))).alias("places"))

    def each_start(batches):
        for b in batches:
            for i, own, data, spots in zip(b.column("id").to_pylist(), b.column("print").to_pylist(), _texts(b), b.column("places").to_pylist(), strict=True):
                spots = sorted({(s["lo"], s["size"], s["alone"]) for s in spots})
                starts = np.concatenate([np.arange(lo, lo + n) for lo, n, _ in spots])
                alone = np.repeat([x for _, _, x in spots], [n for _, n, _ in spots])
                for a, part in segments(data, length):
                    use = (starts >= a) & (starts < a + SEGMENT)
                    if not use.any():
                        continue
                    s, p = starts[use] - a, Prints(part)
                    h1, h2 = (p.of(k, s, s + length) for k in (0, 1))
                    n = len(s)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h1.view(np.int64)), pa.array((h2 >> U64(32)).astype(np.uint32).view(np.int32)), pa.array(np.where(alone[use], 1, 2)), pa.array(np.full(n, i, np.int64)), pa.array(np.full(n, own, np.int64)), pa.array(s + a)],
                        names=["h1", "h2", "n", "id", "print", "lo"],
                    )

    near = _beside(table, asked, "places").select("id", "print", "text", "places").mapInArrow(each_start, "h1 long, h2 int, n long, id long, print long, lo long")
    near = cut_to_table(near)
    again = near.groupBy("h1", "h2").agg(F.sum("n").alias("n")).where("n > 1").select("h1", "h2")
    single = near.where("n = 1").join(again, ["h1", "h2"]).select("id", "print", "lo", (F.col("lo") + length).alias("end"))
    text_of = Window.partitionBy("id", "print").orderBy("lo", "end")
    reach = F.max("end").over(text_of.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (F.col("lo") > F.coalesce(reach, F.lit(-1))).cast("int")
    run = runs.union(whole).union(single).withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(text_of.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = run.groupBy("id", "print", "_run").agg(F.min("lo").alias("lo"), F.max("end").alias("end")).drop("_run")
    return spans.unionByName(told, allowMissingColumns=True) if passage else spans


def _beside(table: DataFrame, lists: DataFrame, column: str, how: str = "inner") -> DataFrame:
    """``table`` with the lists of its texts."""
    lists = cut_lineage(lists)
    if (lists.agg(F.sum(F.greatest(F.size(column), F.lit(1)))).first()[0] or 0) <= BROADCAST_ITEMS:
        lists = F.broadcast(lists)
    return table.join(lists, ["id", "print"], how)


def remove_repeats(docs: DataFrame, length: int = 400, key: str = "doc_id", text: str = "text", as_text: bool = False, passage: int | None = None) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``kept`` (bytes; with
    ``as_text`` the text of its whole characters: bytes left of a cut character are dropped).

    A text is its UTF-8 bytes (null: none).  Removed is each byte covered by a string of ``length``
    bytes that also starts elsewhere, in the same or another text; overlaps count, matches never cross
    texts and are judged on the input.  ``n_spans`` counts the maximal removed runs.

    With ``passage`` (bytes, at most ``length``), ``repeats`` is 1 if bytes are removed or the text holds an
    anchor that another text holds too, else 0.  Anchors are strings of ``passage - window(length) + 1``
    bytes chosen by content; each string of ``passage`` bytes holds one, so no text that has such a string
    in common with another has a 0.

    Texts shorter than ``length`` are kept whole.  Null keys are allowed; rows of one key and text are
    copies of each other.  Columns of ``docs`` named like the results are replaced.
    """
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", *(["repeats"] if passage else [])]
    out = [c for c in docs.columns if c not in names]
    table = docs.select(*_keyed(docs, key, text), F.col(text).alias("text"), *[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(out)])
    spans = F.when(F.col("lo").isNotNull(), F.struct("lo", "end"))
    lists = repeated_spans(docs, length, key, text, passage).groupBy("id", "print").agg(F.array_sort(F.collect_list(spans)).alias("lists"))
    joined = _beside(table, lists, "lists", "left").select("text", "lists", *[f"_k{i}" for i in range(len(out))])

    def cut(batches):
        for b in batches:
            rows = []
            for data, lists in zip(_texts(b), b.column("lists").to_pylist(), strict=True):
                kept, at, raw = [], 0, data.tobytes()
                for s in lists or ():
                    kept.append(raw[at : s["lo"]])
                    at = s["end"]
                rest = b"".join([*kept, raw[at:]])
                rows.append((len(raw), len(raw) - len(rest), len(lists or ()), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if as_text else rest, int(lists is not None))[: len(names)])
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string() if as_text else pa.binary(), pa.int32()][: len(names)]
            arrays = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([*b.columns[2:], *arrays], names=[*b.schema.names[2:], *names])

    kinds = [f"_k{i} {kind}" for i, (_, kind) in enumerate(joined.drop("text", "lists").dtypes)]
    made = joined.mapInArrow(cut, ", ".join([*kinds, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", "kept string" if as_text else "kept binary", *(["repeats int"] if passage else [])]))
    return made.withColumnsRenamed({f"_k{i}": c for i, c in enumerate(out)})


def op8_suffix_array(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` without the bytes of repeated 400-byte strings; ``text`` is what is left, in whole characters,
    and ``repeats`` tells of shorter passages that stand in other documents too (all of 255 bytes; they stay)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, 400, as_text=True, passage=PASSAGE).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("kept").alias("text"), "repeats")
