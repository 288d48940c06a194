"""SentencePiece BPE: encoding by vectorised merge rounds over flat symbol arrays, and decoding.

The words of a batch (cut where no piece of the vocabulary goes on) lie one after another in one array of
symbols.  A round finds, for each word, the best rank of its neighbouring pairs, merges the leftmost of
the pairs that have it, all that don't overlap at once, and closes the gaps.  A merge after which a pair of
no worse rank stands beside it ends its word's round there, so the order is that of merging one pair after
another.  Words without pairs leave.  A word that is still open after many rounds (a very long one, or a
long run of spaces, whose pieces have equal ranks) is finished by a queue of its pairs, with the same result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text_hash import U64, column_bytes, small_batches

SPACE, NONE = "▁", -1
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
WORST = np.iinfo(np.int64).max
#: Symbols that are merged at once, and rounds after which a word goes to the queue.
FLAT, ROUNDS = 1 << 20, 300


def _fields(data: bytes):
    """(number, value) of the fields of a protocol buffer message: whole numbers, or bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


class Codec:
    """Encodes and decodes with the model of a file: BPE, bytes for unknown characters, no normalising but of spaces."""

    def __init__(self, model: bytes):
        self.pieces, self.scores, self.kinds = [], [], []
        trainer, normal = {}, {}
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append(f[1].decode())
                self.scores.append(struct.unpack("<f", f.get(2, bytes(4)))[0])
                self.kinds.append(f.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normal = dict(_fields(value))
        kinds, self.n = np.array(self.kinds), len(self.pieces)
        if trainer.get(3) != 2 or not trainer.get(35) or normal.get(2) or normal.get(4, 1) or not normal.get(5, 1) or trainer.get(24) or set(self.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("not a BPE model with byte fallback that keeps its text")
        self.prefix = normal.get(3, 1)
        self.bos, self.eos = trainer.get(41, 1), trainer.get(42, 2)
        known = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        scores = np.array(self.scores)
        self.rank = np.full(self.n + 1, WORST)  # the last place stands for no piece
        self.rank[:-1][kinds == NORMAL] = np.unique(-scores[kinds == NORMAL], return_inverse=True)[1]
        #: A character is its piece, or else what follows the pieces.
        self.symbol = np.arange(self.n, self.n + 0x110000)
        for p, i in known.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        place = lambda p: known.get(p, self.n + ord(p) if len(p) == 1 else NONE)
        pairs = {(place(p[:k]), place(p[k:])): i for p, i in known.items() for k in range(1, len(p))}
        pairs = {k: i for k, i in pairs.items() if min(k) >= 0}
        self.shift = 64 - max(4, (4 * len(pairs)).bit_length())
        self.keys, self.values = np.zeros(1 << (64 - self.shift), U64), np.full(1 << (64 - self.shift), NONE)
        for (a, b), i in pairs.items():
            key = (a << 32) + b + 1
            slot = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> self.shift
            while self.keys[slot]:
                slot = (slot + 1) % len(self.keys)
            self.keys[slot], self.values[slot] = key, i
        self.pairs = pairs
        #: Whether texts can be cut before a space that doesn't follow one.
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in known)
        self.splitter = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if self.cuts else "(?s:.+)")
        self.byte = np.zeros(256, np.int64)
        for i in np.flatnonzero(kinds == BYTE):
            self.byte[int(self.pieces[i][1:-1], 16)] = i
        shown = {CONTROL: lambda p: b"", BYTE: lambda p: bytes([int(p[1:-1], 16)]), UNKNOWN: lambda p: " ⁇ ".encode()}
        self.table = pa.array([shown.get(k, lambda p: p.replace(SPACE, " ").encode())(p) for p, k in zip(self.pieces, self.kinds, strict=True)], pa.binary())
        self.kinds = kinds

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, or NONE."""
        key = (left.astype(U64) << U64(32)) + right.astype(U64) + U64(1)
        slot = (key * U64(0x9E3779B97F4A7C15) >> U64(self.shift)).astype(np.int64)
        there = self.keys[slot]
        out = np.where(there == key, self.values[slot], NONE)
        rest = np.flatnonzero((there != key) & (there != 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) % len(self.keys)
            there = self.keys[slot[rest]]
            hit = there == key[rest]
            out[rest[hit]] = self.values[slot[rest[hit]]]
            rest = rest[~hit & (there != 0)]
        return out

    def merge(self, symbols: np.ndarray, sizes: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words (``sizes``: of each, none 0) after all merges, and their numbers."""
        word, n_words = np.repeat(np.arange(len(sizes)), sizes), len(sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []

        def pairs_at(i):
            """Pieces of the pairs that begin at ``i``, none across words."""
            j = np.minimum(i + 1, len(symbols) - 1)
            return np.where((i < j) & (word[i] == word[j]), self.merged(symbols[i], symbols[j]), NONE)

        pair = pairs_at(np.arange(len(symbols)))
        for turn in range(rounds + 1):
            rank = self.rank[pair]
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))[: len(word)]
            best = np.minimum.reduceat(rank, starts) if len(starts) else np.empty(0, np.int64)
            of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(word))))
            ready = best == WORST
            if ready.any():
                out = ready[of]
                done.append((word[out], symbols[out]))
                symbols, word, pair, rank, of = (x[~out] for x in (symbols, word, pair, rank, of))
            if not len(symbols):
                break
            if turn == rounds:
                starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
                for a, b in zip(starts, [*starts[1:], len(word)], strict=True):
                    left = self._queue(symbols[a:b].tolist())
                    done.append((np.full(len(left), word[a]), np.array(left)))
                break
            level = best[of]
            at = np.flatnonzero(rank == level)
            run = np.append(True, at[1:] != at[:-1] + 1)
            inside = np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            at = at[inside % 2 == 0]  # of overlapping pairs every other one
            new = pair[at]
            # the neighbours that a merge meets: on the left what the merge before made, on the right what is still unmerged
            before, after = np.maximum(at - 1, 0), np.minimum(at + 2, len(symbols) - 1)
            touching = np.append(False, at[1:] == at[:-1] + 2)
            left = np.where(touching, np.append(0, new[:-1]), symbols[before])
            has_left, has_right = (at > 0) & (word[before] == word[at]), (after == at + 2) & (word[after] == word[at])
            first = np.where(has_left, self.rank[self.merged(left, new)], WORST)
            second = np.where(has_right, self.rank[self.merged(new, symbols[after])], WORST)
            stop = np.flatnonzero((first <= level[at]) | (second <= level[at]))
            if len(stop):
                last = np.full(n_words, WORST)
                last[word[at[stop[::-1]]]] = at[stop[::-1]]
                kept = at <= last[word[at]]
                at, new = at[kept], new[kept]
            symbols[at] = new
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            place = at - np.arange(len(at))  # where a merged symbol stands when the gaps are closed
            symbols, word, pair = symbols[stay], word[stay], pair[stay]
            near = np.unique(np.concatenate([place, place[place > 0] - 1]))
            pair[near] = pairs_at(near)
        if not done:
            return np.empty(0, np.int64), np.zeros(n_words, np.int64)
        word, symbols = (np.concatenate([d[k] for d in done]) for k in range(2))
        return symbols[np.argsort(word, kind="stable")], np.bincount(word, minlength=n_words)

    def _queue(self, symbols: list[int]) -> list[int]:
        """One word's symbols after all merges, best pair first, the leftmost of equal rank."""
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue: list[tuple[int, int, int, int, int]] = []

        def ask(i, j):
            if i >= 0 and j < n and (piece := self.pairs.get((symbols[i], symbols[j]))) is not None:
                heapq.heappush(queue, (int(self.rank[piece]), i, j, symbols[i], symbols[j]))

        for i in range(n - 1):
            ask(i, i + 1)
        while queue:
            _, i, j, a, b = heapq.heappop(queue)
            if symbols[i] == a and symbols[j] == b and after[i] == j:
                symbols[i], symbols[j] = self.pairs[a, b], NONE
                after[i] = after[j]
                if after[i] < n:
                    before[after[i]] = i
                ask(before[i], i)
                ask(i, after[i])
        return [s for s in symbols if s != NONE]

    def words(self, words: pa.Array) -> pa.LargeListArray:
        """The ids of each word of a string array."""
        data, off = column_bytes(words)
        tokens, counts = [], []
        a = 0
        while a < len(words):
            b = max(a + 1, int(np.searchsorted(off, off[a] + FLAT, "right")) - 1)
            part = data[off[a] : off[b]]
            heads = np.append(0, np.cumsum((part & 0xC0) != 0x80))  # characters before each byte
            points = np.frombuffer(part.tobytes().decode().encode("utf-32-le"), np.uint32)
            symbols, n = self.merge(self.symbol[points], np.diff(heads[off[a : b + 1] - off[a]]))
            foreign = np.flatnonzero(symbols >= self.n)
            if len(foreign):  # characters that are no piece become bytes
                as_bytes = [chr(x).encode() for x in (symbols[foreign] - self.n).tolist()]
                width = np.ones(len(symbols), np.int64)
                width[foreign] = [len(x) for x in as_bytes]
                n = np.add.reduceat(np.append(width, 0), np.append(0, np.cumsum(n))[:-1]) * (n > 0)
                is_foreign = np.repeat(symbols >= self.n, width)
                symbols = np.repeat(symbols, width)
                symbols[is_foreign] = self.byte[np.frombuffer(b"".join(as_bytes), np.uint8)]
            tokens.append(symbols)
            counts.append(n)
            a = b
        return pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.concatenate(counts or [np.empty(0, np.int64)])))), pa.array(np.concatenate(tokens or [np.empty(0, np.int64)]).astype(np.int32)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, with begin and end ids.  Equal words are encoded once."""
        words, ends = [], []
        for text in texts:
            if text:
                words += self.splitter.findall((SPACE if self.prefix else "") + text.replace(" ", SPACE))
            ends.append(len(words))
        coded = pa.array(words, pa.string()).dictionary_encode()
        found = self.words(coded.dictionary).take(coded.indices)
        cuts, ids = found.offsets.to_numpy()[np.append(0, ends)], found.values.to_numpy()
        return [np.concatenate([[self.bos], ids[a:b], [self.eos]]).astype(np.int32) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: bytes that are no UTF-8 become U+FFFD each, control ids nothing."""
        ids = np.asarray(ids, np.int64)
        shown = np.flatnonzero(self.kinds[ids] != CONTROL)
        ids = ids[shown[0] : shown[-1] + 1] if len(shown) else ids[:0]
        skip = self.prefix and len(ids) and self.kinds[ids[0]] == NORMAL and self.pieces[ids[0]].startswith(SPACE)
        data, off = column_bytes(self.table.take(pa.array(ids)))
        if len(shown) == len(ids):  # else a control id may part the bytes of a character
            try:
                return data.tobytes()[int(skip) :].decode()
            except UnicodeDecodeError:
                pass
        out, byte = [], self.kinds[ids] == BYTE
        runs = np.flatnonzero(np.append(True, byte[1:] != byte[:-1]))
        for a, b in zip(runs, [*runs[1:], len(ids)], strict=True):
            part = data[off[a] : off[b]].tobytes()
            if not byte[a]:
                out.append(part.decode())
            while byte[a] and part:
                try:
                    out.append(part.decode())
                    break
                except UnicodeDecodeError as fault:
                    out.append(part[: fault.start].decode() + "�")
                    part = part[fault.start + 1 :]
        return "".join(out)[int(skip) :]


_MADE: dict[str, Codec] = {}


def _codec(path: str) -> Codec:
    """The codec of a worker, made once from the model's path."""
    if path not in _MADE:
        _MADE.clear()
        with open(path, "rb") as f:
            _MADE[path] = Codec(f.read())
    return _MADE[path]


def encode_texts(docs: DataFrame, model: str, text: str = "text", keep: list[str] | None = None, ids: bool = True) -> DataFrame:
    """``docs``'s columns ``keep`` with ``n_tokens``, ``ids``, ``ids_sha256`` and ``decoded_sha256``.

    ``model`` is the path of a model that is installed on every worker.  The ids have begin and end; null and
    empty texts have only these.  ``decoded_sha256`` is of the text that the ids decode to.  Each row is encoded
    by itself, so null keys and repeated rows are kept as they are; a column of ``docs`` that is named like a
    result is not kept.  ``ids=False`` leaves the ids out.
    """
    small_batches(docs.sparkSession)
    results = {"n_tokens": "long", **({"ids": "array<int>"} if ids else {}), "ids_sha256": "string", "decoded_sha256": "string"}
    keep = [c for c in (keep or [c for c in docs.columns if c != text]) if c not in ("ids", *results)]
    table = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("_text"))

    def run(batches):
        codec = _codec(model)
        for b in batches:
            found = codec.encode([t or "" for t in b.column("_text").to_pylist()])
            more = [pa.array([len(x) for x in found], pa.int64()), *([pa.array(found, pa.list_(pa.int32()))] if ids else [])]
            more.append(pa.array([hashlib.sha256(x.astype("<u4")).hexdigest() for x in found], pa.string()))
            more.append(pa.array([hashlib.sha256(codec.decode(x).encode()).hexdigest() for x in found], pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *more], names=[*b.schema.names[:-1], *results])
        pa.default_memory_pool().release_unused()

    kinds = [f"_k{i} {kind}" for i, (_, kind) in enumerate(table.drop("_text").dtypes)]
    out = table.mapInArrow(run, ", ".join([*kinds, *(f"{c} {k}" for c, k in results.items())]))
    return out.withColumnsRenamed({f"_k{i}": c for i, c in enumerate(keep)})


def decode_ids(rows: DataFrame, model: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """``rows`` with the text ``to`` of the ids ``ids``.

    Null ids give a null text; an id that the model lacks is an error.  A column named like the result is replaced.
    """
    small_batches(rows.sparkSession)
    keep = [c for c in rows.columns if c != to]
    table = rows.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], F.col(f"`{ids}`").alias("_ids"))

    def run(batches):
        codec = _codec(model)
        for b in batches:
            out = []
            for x in b.column("_ids"):
                asked = np.array(x.as_py(), np.int64) if x.is_valid else None
                if asked is not None and ((asked < 0) | (asked >= codec.n)).any():
                    raise ValueError("an id is not in the model")
                out.append(None if asked is None else codec.decode(asked))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.string())], names=[*b.schema.names[:-1], "_text"])

    kinds = ", ".join([*(f"_k{i} {kind}" for i, (_, kind) in enumerate(table.drop("_ids").dtypes)), "_text string"])
    return table.mapInArrow(run, kinds).withColumnsRenamed({f"_k{i}": c for i, c in enumerate(keep)} | {"_text": to})


def op12_pieces(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded again."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"], ids=False)
