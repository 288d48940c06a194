"""Byte-level BPE: merges as a lazily determinised transducer, and a streaming decoder.

After every byte of a pre-token the transducer tells the *last token* of the bytes so far: the longest
token that ends there and may stand after the last token of the bytes before it.  A state holds no more
than later bytes need: the places where a token may still be open (nodes of the tree of all tokens),
each with the last token before it.  States and moves are made when a text first needs them, for all
pre-tokens of a batch together, and are kept in flat tables of bounded size.

Tokens are read off backwards from a place that every segmentation still open runs through: the end of a
short pre-token, or, every few thousand bytes of a long one, a place less than twice the longest token back.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from .text_hash import column_bytes, small_batches

NONE = -1
NEVER = np.int64(1) << 62


def parse_ranks(lines) -> dict[bytes, int]:
    """Ranks of tokens from lines of base64 token and rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class LongMap:
    """Distinct whole numbers of at least 0 and their places in the order of coming; open addressing in numpy."""

    def __init__(self, bits: int = 14):
        self.n, self.bits = 0, bits
        self.keys, self.at = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for one that is missing."""
        slot, mask = self._slots(keys), len(self.keys) - 1
        held = self.keys[slot]
        out = np.where(held == keys, self.at[slot], -1)
        left = np.flatnonzero((held != keys) & (held >= 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & mask
            held, own = self.keys[slot], keys[left]
            hit = held == own
            out[left[hit]] = self.at[slot[hit]]
            go = ~hit & (held >= 0)
            left, slot = left[go], slot[go]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Add distinct keys that are missing."""
        if self.n + len(keys) > len(self.keys) // 2:
            used = np.flatnonzero(self.keys >= 0)
            old = self.keys[used][np.argsort(self.at[used])]
            self.__init__(max(self.bits + 1, int(2 * (self.n + len(keys))).bit_length()))
            self.add(old)
        slot, mask = self._slots(keys), len(self.keys) - 1
        place = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        self.n += len(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] < 0)
            self.keys[slot[free]] = keys[free]  # the last of those that meet in a slot stays
            stays = self.keys[slot] == keys
            self.at[slot[stays]] = place[stays]
            go = ~stays
            keys, place, slot = keys[go], place[go], (slot[go] + 1) & mask


class Column:
    """A growing array."""

    def __init__(self, kind):
        self.data, self.n = np.zeros(1 << 12, kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.data):
            grown = np.zeros(2 * (self.n + len(more)), self.data.dtype)
            grown[: self.n] = self.data[: self.n]
            self.data = grown
        self.data[self.n : self.n + len(more)] = more
        self.n += len(more)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of ``counts`` items: the group and the place in it of each item."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


class Transducer:
    """BPE of pre-tokens by rank merges, left to right with bounded lookahead."""

    #: Live places (8 bytes each) of all states that are remembered; beyond it the automaton is made anew.
    KEEP = 500_000
    #: Pre-tokens of more bytes are read one by one, and their settled tokens emitted every so many bytes.
    SHORT, EMIT = 128, 4096
    #: Moves that are remembered for long pre-tokens.
    KEEP_LONG = 50_000

    def __init__(self, ranks: dict[bytes, int]):
        tokens = sorted(ranks, key=ranks.get)
        number = {t: i for i, t in enumerate(tokens)}
        self.tokens, self.table = tokens, pa.array(tokens, pa.binary())
        self.ids = np.array([ranks[t] for t in tokens], np.int64)
        self.size = np.array([len(t) for t in tokens], np.int32)
        self.n, self.longest = len(tokens), int(self.size.max())
        # the merges: pairs of tokens and the token that they make
        pairs = {}
        for i, t in enumerate(tokens):
            for k in range(1, len(t)):
                if (a := number.get(t[:k])) is not None and (b := number.get(t[k:])) is not None:
                    pairs[a * self.n + b] = i
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_makes = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        halves = [self._halves(t, number, pairs) for t in tokens]
        self.left, self.right = np.array(halves, np.int64).reshape(-1, 2).T.copy()
        self._grow_tree(tokens)
        self.forget()

    def _halves(self, data: bytes, number: dict[bytes, int], pairs: dict[int, int]) -> tuple[int, int]:
        """The two tokens of the last merge that gives the token ``data``; NONE for one byte or no such merge."""
        token = number[data]
        parts = [number.get(data[i : i + 1], NONE) for i in range(len(data))]
        while len(parts) > 2:
            made, i = min((pairs.get(parts[i] * self.n + parts[i + 1], token) if min(parts[i], parts[i + 1]) >= 0 else token, i) for i in range(len(parts) - 1))
            if made >= token:
                break
            parts[i : i + 2] = [made]
        return (parts[0], parts[1]) if len(parts) == 2 and min(parts) >= 0 else (NONE, NONE)

    def _grow_tree(self, tokens: list[bytes]) -> None:
        """The tree of all tokens: node 0 is the root, ``kids`` finds a node by its parent and byte."""
        nodes, keys = {b"": 0}, []
        for t in tokens:
            for k in range(1, len(t) + 1):
                if t[:k] not in nodes:
                    nodes[t[:k]] = len(nodes)
                    keys.append(nodes[t[: k - 1]] << 8 | t[k - 1])
        self.kids = LongMap(max(8, (4 * len(keys)).bit_length()))
        self.kids.add(np.array(keys, np.int64))  # a node is the place of its key plus one
        self.keys = np.array(keys, np.int64)
        self.inner = np.zeros(len(nodes), bool)
        self.inner[np.array(keys, np.int64) >> 8] = True
        self.depth = np.array([len(p) for p in nodes], np.int32)
        self.token_at = np.full(len(nodes), NONE, np.int64)
        for i, t in enumerate(tokens):
            if len(t) == 1 or self.left[i] >= 0:  # others are reached by no merge
                self.token_at[nodes[t]] = i

    def forget(self) -> None:
        """Empty the automaton; state 0 is the start: one place, the root, with no token before it."""
        self.number: dict[bytes, int] = {}
        self.first, self.nodes, self.lasts = Column(np.int64), Column(np.int32), Column(np.int32)
        self.first.add(np.zeros(1, np.int64))
        self.moves, self.to, self.tells = LongMap(), Column(np.int32), Column(np.int32)
        self.steps: dict[tuple, tuple] = {}
        self._states(np.array([0]), np.array([0], np.int32), np.array([NONE], np.int32))

    def _states(self, ends_before: np.ndarray, nodes: np.ndarray, lasts: np.ndarray) -> np.ndarray:
        """The numbers of states given as lists of live places; ``ends_before`` has where each list begins."""
        blob = np.stack([nodes, lasts], 1).astype(np.int32).tobytes()
        cuts = [*(8 * ends_before).tolist(), len(blob)]
        number, out, fresh = self.number, [], []
        for k in range(len(cuts) - 1):
            key = blob[cuts[k] : cuts[k + 1]]
            state = number.get(key)
            if state is None:
                state = number[key] = len(number)
                fresh.append(k)
            out.append(state)
        if fresh:
            fresh = np.array(fresh)
            bounds = np.append(ends_before, len(nodes))
            sizes = bounds[fresh + 1] - bounds[fresh]
            group, place = _spread(sizes)
            rows = bounds[fresh][group] + place
            self.first.add(self.first.data[self.first.n - 1] + np.cumsum(sizes))
            self.nodes.add(nodes[rows])
            self.lasts.add(lasts[rows])
        return np.array(out, np.int64)

    def adjacent(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of both tokens gives just these two.

        The merges on either side of the border are undone, latest first.  The border holds if at no
        stage its two neighbours could merge before the merge that was undone last.
        """
        ok, at = np.ones(len(left), bool), np.arange(len(left))
        a, b, limit = left.astype(np.int64), right.astype(np.int64), np.full(len(left), NEVER)
        while len(at):
            key = a * self.n + b
            place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            merge = np.where(self.pair_keys[place] == key, self.pair_makes[place], NEVER) if len(self.pair_keys) else np.full(len(at), NEVER)
            broken = merge < limit
            ok[at[broken]] = False
            has_a, has_b = self.left[a] >= 0, self.left[b] >= 0
            go = ~broken & (has_a | has_b)
            at, a, b, has_a, has_b = at[go], a[go], b[go], has_a[go], has_b[go]
            # on the left side a merge of equal rank comes first, on the right side the border's does
            undo_left = ~has_b | (has_a & (a > b))
            limit = np.where(undo_left, a, b + 1)
            a, b = np.where(undo_left, self.right[a], a), np.where(undo_left, b, self.left[b])
        return ok

    def _make(self, keys: np.ndarray) -> None:
        """Make the moves of ``keys`` (state << 8 | byte), all at once."""
        state, byte = keys >> 8, keys & 255
        begin = self.first.data[state]
        m, place = _spread(self.first.data[state + 1] - begin)
        rows = begin[m] + place
        node = self.kids.find(self.nodes.data[rows].astype(np.int64) << 8 | byte[m]) + 1
        alive = node > 0
        m, node, before = m[alive], node[alive], self.lasts.data[rows[alive]]
        token = self.token_at[node]
        may = np.flatnonzero(token >= 0)
        known = before[may] >= 0
        fits = np.ones(len(may), bool)
        fits[known] = self.adjacent(before[may][known], token[may][known])
        may = may[fits]  # the longest token first
        told, first = np.unique(m[may], return_index=True)
        if len(told) < len(keys):
            raise ValueError("a byte of a text is no token")
        tells = token[may[first]].astype(np.int32)
        stays = self.inner[node]
        m = np.concatenate([m[stays], np.arange(len(keys))])
        order = np.argsort(m, kind="stable")
        nodes = np.concatenate([node[stays], np.zeros(len(keys), np.int64)])[order].astype(np.int32)
        lasts = np.concatenate([before[stays], tells])[order].astype(np.int32)
        to = self._states(np.searchsorted(m[order], np.arange(len(keys))), nodes, lasts)
        self.moves.add(keys)
        self.to.add(to.astype(np.int32))
        self.tells.add(tells)

    def _move(self, keys: np.ndarray) -> np.ndarray:
        """Places of the moves ``keys`` in the tables; those that are missing are made."""
        at = self.moves.find(keys)
        gone = at < 0
        if gone.any():
            self._make(np.unique(keys[gone]))
            at[gone] = self.moves.find(keys[gone])
        return at

    def encode(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens (places in ``ids``) of all pieces (an array of bytes) in turn, and how many each piece has."""
        data, cuts = column_bytes(pieces)
        begin, sizes = cuts[:-1], np.diff(cuts)
        own = pc.index_in(pieces, value_set=self.table).fill_null(NONE).to_numpy(zero_copy_only=False).astype(np.int64)
        lanes = np.flatnonzero((own < 0) & (sizes > 0) & (sizes <= self.SHORT))
        lanes = lanes[np.argsort(-sizes[lanes], kind="stable")]
        told = np.zeros(len(data), np.int32)
        state, at = np.zeros(len(lanes), np.int64), begin[lanes]
        ends_at = len(lanes) - np.searchsorted(sizes[lanes][::-1], np.arange(self.SHORT + 1), "right")  # lanes of more than k bytes
        for k in range(int(sizes[lanes[0]]) if len(lanes) else 0):
            n = ends_at[k]
            here = at[:n] + k
            move = self._move(state[:n] << 8 | data[here])
            state = self.to.data[move].astype(np.int64)
            told[here] = self.tells.data[move]
            if self.nodes.n > self.KEEP:
                state = self._restart(state)
        # backwards from each end
        counts = (own >= 0).astype(np.int64)
        rounds, left, end = [], lanes, (begin + sizes)[lanes]
        while len(left):
            token = told[end - 1]
            rounds.append((left, token))
            counts[left] += 1
            end = end - self.size[token]
            go = end > begin[left]
            left, end = left[go], end[go]
        long = {int(i): np.concatenate([*self.stream(data[cuts[i] : cuts[i + 1]].tobytes())]) for i in np.flatnonzero((own < 0) & (sizes > self.SHORT))}
        for i, tokens in long.items():
            counts[i] = len(tokens)
        out = np.zeros(int(counts.sum()), np.int32)
        last = np.cumsum(counts) - 1
        out[last[own >= 0]] = own[own >= 0]
        for r, (which, token) in enumerate(rounds):
            out[last[which] - r] = token
        for i, tokens in long.items():
            out[last[i] + 1 - len(tokens) : last[i] + 1] = tokens
        return out, counts

    def _restart(self, state: np.ndarray) -> np.ndarray:
        """Forget all states but the given ones; their new numbers."""
        held, which = np.unique(state, return_inverse=True)
        begin = self.first.data[held]
        sizes = self.first.data[held + 1] - begin
        group, place = _spread(sizes)
        rows = begin[group] + place
        nodes, lasts = self.nodes.data[rows], self.lasts.data[rows]
        self.forget()
        return self._states(np.cumsum(sizes) - sizes, nodes, lasts)[which]

    @cached_property
    def kid(self) -> dict[int, int]:
        """``kids`` for one step at a time; only long pre-tokens need it, as ``pairs``."""
        return {k: i for i, k in enumerate(self.keys.tolist(), 1)}

    @cached_property
    def pairs(self) -> dict[int, int]:
        return dict(zip(self.pair_keys.tolist(), self.pair_makes.tolist(), strict=True))

    def _border(self, a: int, b: int) -> bool:
        """``adjacent`` of one pair."""
        limit = 1 << 62
        while True:
            if self.pairs.get(a * self.n + b, limit) < limit:
                return False
            has_a, has_b = self.left[a] >= 0, self.left[b] >= 0
            if not (has_a or has_b):
                return True
            if not has_b or (has_a and a > b):
                limit, a = a, int(self.right[a])
            else:
                limit, b = b + 1, int(self.left[b])

    def _step(self, live: tuple, byte: int) -> tuple[tuple, int]:
        """The move of one state, given as its live places."""
        if (known := self.steps.get((live, byte))) is not None:
            return known
        told, stay = NONE, []
        for node, before in live:
            if node := self.kid.get(node << 8 | byte):
                token = int(self.token_at[node])
                if told < 0 <= token and (before < 0 or self._border(before, token)):
                    told = token
                if self.inner[node]:
                    stay.append((node, before))
        if told < 0:
            raise ValueError("a byte of a text is no token")
        if len(self.steps) >= self.KEEP_LONG:
            self.steps.clear()
        self.steps[live, byte] = out = (*stay, (0, told)), told
        return out

    def stream(self, piece: bytes):
        """The tokens of one piece in parts; each part is settled whatever bytes follow it."""
        live, told = ((0, NONE),), []  # told: of the bytes that are not settled
        for a in range(0, len(piece), self.EMIT):
            for byte in piece[a : a + self.EMIT]:
                live, token = self._step(live, byte)
                told.append(token)
            ends = {len(told)} if a + self.EMIT >= len(piece) else {len(told) - int(self.depth[node]) for node, _ in live}
            while len(ends) > 1:  # the last place that all open segmentations run through
                i = max(ends)
                ends = ends - {i} | {i - int(self.size[told[i - 1]])}
            (end,) = ends
            out, i = [], end
            while i > 0:
                out.append(told[i - 1])
                i -= int(self.size[told[i - 1]])
            yield np.array(out[::-1], np.int32)
            told = told[end:]


def _utf8_classes() -> tuple[list[int], list[list[int]]]:
    """Classes of bytes and moves of the machine of well-formed UTF-8.

    States: 0 between characters, 1-3 so many continuation bytes are due, 4-7 the second byte after E0,
    ED, F0, F4 is bound to a part of the continuation bytes, 8 no UTF-8.
    """
    kind = [0] * 128 + [1] * 16 + [2] * 16 + [3] * 32 + [4] * 2 + [5] * 30 + [6] + [7] * 12 + [8] + [7] * 2 + [9] + [10] * 3 + [11] + [4] * 11
    bad = 8
    moves = [[bad] * 12 for _ in range(9)]
    moves[0] = [0, bad, bad, bad, bad, 1, 4, 2, 5, 6, 3, 7]
    for s, low in ((1, 0), (2, 1), (3, 2)):
        moves[s][1:4] = [low] * 3
    moves[4][3], moves[5][1:3], moves[6][2:4], moves[7][1] = 1, [1, 1], [2, 2], 2
    return kind, moves


_KIND, _MOVES = _utf8_classes()
_NOT_ASCII, _OPEN_END = re.compile(rb"[\x80-\xff]+"), re.compile(rb"[\xc2-\xf4][\x80-\xbf]{0,2}\Z")


class Utf8Stream:
    """Decodes bytes that come in pieces by an incremental state machine.

    ``feed`` returns the text of all characters that are complete; ``finish`` tells whether none is open.
    What is no UTF-8 becomes one U+FFFD for each longest beginning of a character or other byte, as in the
    ``replace`` mode of a whole decoding, and is counted in ``faults``.  Bytes below 0x80 leave the state
    between characters as it is, so the machine need only step through the runs of others, and only once
    through equal runs; if all are sound, the characters are made at once.
    """

    #: Runs that the machine has gone through from and to the state between characters, of at most so many bytes.
    KEEP, RUN = 100_000, 64
    sound: set[bytes] = set()

    def __init__(self):
        self.state, self.point, self.faults = 0, 0, 0

    def feed(self, piece: bytes) -> str:
        head = 0
        while self.state and head < len(piece) and piece[head] > 0x7F:
            head += 1
            if head == 4:
                break
        tail = len(piece)
        if tail > head and (m := _OPEN_END.search(piece, max(head, tail - 3))):
            tail = m.start()
        out: list[str] = []
        self._steps(piece[:head], out)
        middle = piece[head:tail]
        if self.state == 0 and all(map(self._sound, set(_NOT_ASCII.findall(middle)))):
            out.append(middle.decode())
        else:
            self._steps(middle, out)
        self._steps(piece[tail:], out)
        return "".join(out)

    def _sound(self, run: bytes) -> bool:
        if run in self.sound:
            return True
        state = 0
        for byte in run:
            state = _MOVES[state][_KIND[byte]]
            if state == 8:
                return False
        if state == 0 and len(run) <= self.RUN:
            if len(self.sound) >= self.KEEP:
                self.sound.clear()
            self.sound.add(run)
        return state == 0

    def _steps(self, piece: bytes, out: list[str]) -> None:
        state, point = self.state, self.point
        for byte in piece:
            kind = _KIND[byte]
            to = _MOVES[state][kind]
            if to == 8 and state:  # a character was broken off; the byte begins anew
                self.faults += 1
                out.append("\ufffd")
                state, to = 0, _MOVES[0][kind]
            if to == 8:
                self.faults += 1
                out.append("\ufffd")
                to = 0
            elif state:
                point = point << 6 | byte & 0x3F
                if not to:
                    out.append(chr(point))
            elif to:
                point = byte & (0x1F if kind == 5 else 0x0F if kind in (6, 7, 8) else 0x07)
            else:
                out.append(chr(byte))
            state = to
        self.state, self.point = state, point

    def finish(self) -> bool:
        done, self.state = not self.state, 0
        return done


class Codec:
    """Encodes and decodes lists of texts with one vocabulary and splitting pattern."""

    #: Pre-tokens that are held at once; a longer text is worked on in parts.
    PART = 200_000

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.machine, self.splitter = Transducer(ranks), regex.compile(pattern)
        self.place = np.full(int(self.machine.ids.max()) + 1, NONE, np.int64)
        self.place[self.machine.ids] = np.arange(self.machine.n)

    def tokens_of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens (places in ``ids``) of all pieces in turn, and where each piece's begin (and the end).  Equal pieces are encoded once."""
        coded = pa.array(pieces, pa.string()).dictionary_encode()
        tokens, counts = self.machine.encode(coded.dictionary.cast(pa.binary()))
        lists = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts))), pa.array(tokens))
        found = lists.take(coded.indices)
        return found.flatten().to_numpy(), found.offsets.to_numpy()

    def bytes_of(self, tokens: np.ndarray) -> bytes:
        """The bytes of tokens in turn."""
        data, _ = column_bytes(self.machine.table.take(pa.array(tokens)))
        return data.tobytes()

    def encode(self, texts: list[str]):
        """(place of the text, its tokens) in order; a text may come in several parts, and each has one at least."""
        pieces, ends = [], []

        def parts():
            tokens, cuts = self.tokens_of(pieces)
            at = 0
            for i, end in ends:
                yield i, tokens[cuts[at] : cuts[end]]
                at = end

        for i, text in enumerate(texts):
            found = self.splitter.finditer(text) if len(text) > self.PART else None
            while True:
                pieces += [m[0] for m in islice(found, self.PART)] if found else self.splitter.findall(text)
                ends.append((i, len(pieces)))
                full = len(pieces) >= self.PART
                if full:
                    yield from parts()
                    pieces, ends = [], []
                if not (found and full):
                    break
        yield from parts()

    def decode(self, tokens: np.ndarray, step: int = 65_536):
        """The bytes of tokens in pieces."""
        for a in range(0, len(tokens), step):
            yield self.bytes_of(tokens[a : a + step])


_MADE: dict = {}


def _codec(vocab: str, pattern: str) -> Codec:
    """The codec of a worker, made once from the vocabulary's path; its automaton serves all partitions."""
    if (vocab, pattern) not in _MADE:
        _MADE.clear()
        with open(vocab, "rb") as f:
            _MADE[vocab, pattern] = Codec(parse_ranks(f), pattern)
    return _MADE[vocab, pattern]


def encode_texts(docs: DataFrame, vocab: str, pattern: str, text: str = "text", keep: list[str] | None = None, ids: bool = True) -> DataFrame:
    """``docs``'s columns ``keep`` with ``n_tokens``, ``ids``, ``ids_sha256``, ``decoded_sha256`` and ``n_decoded``.

    ``decoded_sha256`` is of the bytes that the ids decode to, ``n_decoded`` the characters that the
    streaming decoder makes of them.  ``vocab`` is the path of a rank file that is installed on every
    worker.  Null and empty texts have no tokens.  Each row is encoded by itself, so null keys and repeated
    rows are kept as they are; a column of ``docs`` that is named like a result is not kept.  ``ids=False``
    leaves the ids out.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in (keep or [c for c in docs.columns if c != text]) if c not in ("n_tokens", "ids", "ids_sha256", "decoded_sha256", "n_decoded")]
    table = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text).alias("_text"))
    names = ["n_tokens", *(["ids"] if ids else []), "ids_sha256", "decoded_sha256", "n_decoded"]

    def run(batches):
        codec = _codec(vocab, pattern)
        for b in batches:
            n = b.num_rows
            count, chars, lists = np.zeros(n, np.int64), np.zeros(n, np.int64), [[] for _ in range(n)]
            sha, back, machines = ([f() for _ in range(n)] for f in (hashlib.sha256, hashlib.sha256, Utf8Stream))
            for i, tokens in codec.encode([t or "" for t in b.column("_text").to_pylist()]):
                found = codec.machine.ids[tokens].astype("<u4")
                sha[i].update(found)
                for piece in codec.decode(tokens):
                    back[i].update(piece)
                    chars[i] += len(machines[i].feed(piece))
                count[i] += len(found)
                if ids:
                    lists[i].append(found.astype(np.int32))
            more = [pa.array(count), *([pa.array([np.concatenate(x) for x in lists], pa.list_(pa.int32()))] if ids else []), *(pa.array([x.hexdigest() for x in h], pa.string()) for h in (sha, back)), pa.array(chars)]
            yield pa.RecordBatch.from_arrays([*[b.column(f"_k{i}") for i in range(len(keep))], *more], names=[*[f"_k{i}" for i in range(len(keep))], *names])
        pa.default_memory_pool().release_unused()

    kinds = ", ".join(f"_k{i} {kind}" for i, (_, kind) in enumerate(table.drop("_text").dtypes))
    results = ", ".join(["n_tokens long", *(["ids array<int>"] if ids else []), "ids_sha256 string", "decoded_sha256 string", "n_decoded long"])
    out = table.mapInArrow(run, f"{kinds}, {results}" if kinds else results)
    return out.withColumnsRenamed({f"_k{i}": c for i, c in enumerate(keep)})


def decode_ids(rows: DataFrame, vocab: str, pattern: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """``rows`` with the text ``to`` of the token ids ``ids``, decoded in a stream.

    Null ids give a null text; an id that the vocabulary lacks is an error.  Bytes that are no UTF-8 become
    U+FFFD, an open character at the end too.  A column named like the result is replaced.
    """
    small_batches(rows.sparkSession)
    keep = [c for c in rows.columns if c != to]
    table = rows.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], F.col(ids).alias("_ids"))

    def run(batches):
        codec = _codec(vocab, pattern)
        for b in batches:
            out = []
            for x in b.column("_ids"):
                if not x.is_valid:
                    out.append(None)
                    continue
                asked = np.array(x.as_py(), np.int64)
                known = asked[(asked >= 0) & (asked < len(codec.place))]
                places = codec.place[known]
                if len(known) < len(asked) or (places < 0).any():
                    raise ValueError("an id is not in the vocabulary")
                machine = Utf8Stream()
                text = "".join(machine.feed(piece) for piece in codec.decode(places))
                out.append(text if machine.finish() else text + "�")
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.string())], names=[*b.schema.names[:-1], "_text"])

    kinds = ", ".join([*(f"_k{i} {kind}" for i, (_, kind) in enumerate(table.drop("_ids").dtypes)), "_text string"])
    return table.mapInArrow(run, kinds).withColumnsRenamed({f"_k{i}": c for i, c in enumerate(keep)} | {"_text": to})


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded again."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"], ids=False)
