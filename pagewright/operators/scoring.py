"""BM25 by text: tokens are counted inside a text's row, and a task keeps only the best rows of each query.

A text's counts never leave its row, so what is shuffled are ``k`` rows for each query and task, whatever the
number of texts that share a word with a query.  Rows are taken in blocks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..functions.text import tokens
from ..runtime import python_ready

K1, B = 1.2, 0.75
#: Cells (texts by queries) that a block has at most, and products that are added up at once.
CELLS, PRODUCTS = 1 << 22, 1 << 23
#: Texts that are looked at together for rare tokens, and scored ones that wait to be compared with the best so far.
TEXTS, WAITING = 1 << 12, 1 << 19


def counted(chunks: DataFrame, vocabulary: list[str], fields: tuple[str, ...], keep: list[str]) -> DataFrame:
    """``keep``, and of each field the number of tokens (``<field>_len``, null without a text), the places in ``vocabulary`` of those it has and their counts."""
    python_ready(chunks.sparkSession)
    x = chunks.select(*keep, *[tokens(F.col(f)).alias(f"_{i}") for i, f in enumerate(fields)])
    schema = StructType([x.schema[c] for c in keep])
    for f in fields:
        schema = schema.add(f"{f}_len", IntegerType()).add(f"{f}_ids", ArrayType(IntegerType())).add(f"{f}_tfs", ArrayType(IntegerType()))
    known = chunks.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        words = pa.array(known.value, pa.string())
        for b in batches:
            columns = [b.column(i) for i in range(len(keep))]
            for i in range(len(fields)):
                lists = b.column(len(keep) + i)
                flat = lists.flatten()
                place = pc.index_in(flat, value_set=words.cast(flat.type))
                hit = place.is_valid().to_numpy(zero_copy_only=False)
                row = pc.list_parent_indices(lists).to_numpy()[hit].astype(np.int64)
                key, times = np.unique(row * max(1, len(words)) + place.drop_null().to_numpy(), return_counts=True)
                row, place = np.divmod(key, max(1, len(words)))
                ends = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32))
                columns += [pc.list_value_length(lists).cast(pa.int32())]
                columns += [pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32))) for v in (place, times)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return x.mapInArrow(run, schema)


def scope_key(scope: list[str]) -> Column:
    return F.xxhash64(*scope) if scope else F.lit(0).cast("long")


def gain(tf, size, mean):
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))


class Weights:
    """The weights of all queries by field, scope and token, sorted for lookups.

    With a column ``rare`` the lookups are by the rare tokens alone, and each query's own weights are kept beside.
    """

    def __init__(self, table: pa.Table):
        self.queries, cls = np.unique(table["query_id"].to_numpy(zero_copy_only=False), return_inverse=True)
        self.scopes, scope = np.unique(table["_scope"].to_numpy(), return_inverse=True)
        place = table["place"].to_numpy().astype(np.int64)
        self.words = int(place.max()) + 1 if len(place) else 1
        key = (table["_field"].to_numpy().astype(np.int64) * max(1, len(self.scopes)) + scope) * self.words + place
        w = table["w"].to_numpy()
        self.positive = bool((w > 0).all())
        if "rare" in table.column_names:
            own = np.argsort(cls, kind="stable")
            self.own = np.searchsorted(cls[own], np.arange(len(self.queries) + 1))  # where each query's weights begin
            self.own_field, self.own_scope, self.own_place, self.own_w = table["_field"].to_numpy().astype(np.int64)[own], scope[own], place[own], w[own]
            rare = table["rare"].to_numpy(zero_copy_only=False)
            key, cls, w = key[rare], cls[rare], w[rare]
        order = np.argsort(key, kind="stable")
        self.keys, self.starts = np.unique(key[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(order))
        self.cls, self.w = cls[order], w[order]

    def found(self, field: np.ndarray | int, scope: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the weights of the entries' tokens are in ``keys``, and whether there are any."""
        key = (field * len(self.scopes) + scope) * self.words + place
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return at, (self.keys[at] == key) & (place < self.words)

    def scores(self, rows: int, row: np.ndarray, field: int, scope: np.ndarray, place: np.ndarray, gains: np.ndarray, into: np.ndarray, seen: np.ndarray | None) -> None:
        """Adds what the entries (row, scope and place of a token, gain) give each query to ``into`` (rows by queries)."""
        at, ok = self.found(field, scope, place)
        at, row, gains = at[ok], row[ok], gains[ok]
        times = self.ends[at] - self.starts[at]
        upto = np.cumsum(times)
        a = 0
        while a < len(at):
            z = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PRODUCTS, "right")))
            n = times[a:z]
            held = spans(self.starts[at[a:z]], n)
            cell = np.repeat(row[a:z], n) * len(self.queries) + self.cls[held]
            into += np.bincount(cell, self.w[held] * np.repeat(gains[a:z], n), into.size)
            if seen is not None:
                seen |= np.bincount(cell, minlength=into.size) > 0
            a = z

    def of_rare(self, rows: int, row: np.ndarray, field: np.ndarray, scope: np.ndarray, place: np.ndarray, gains: np.ndarray):
        """Texts (places in a block of ``rows``), queries that have a rare token of theirs, and whole scores, in parts; the entries are all those of the texts, ``scope`` is by text."""
        entry = (field * rows + row) * self.words + place
        order = np.argsort(entry, kind="stable")
        order = order[place[order] < self.words]
        entry, gains = entry[order], gains[order]
        at, ok = self.found(field, scope[row], place)
        at, row = at[ok], row[ok]
        order = np.argsort(row, kind="stable")  # a text's entries, of all fields, together
        at, row = at[order], row[order]
        times = self.ends[at] - self.starts[at]
        upto, a = np.cumsum(times), 0
        while a < len(at):
            z = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PRODUCTS // 8, "right")))
            z = int(np.searchsorted(row, row[z - 1], "right"))
            pair = np.unique(np.repeat(row[a:z], times[a:z]) * len(self.queries) + self.cls[spans(self.starts[at[a:z]], times[a:z])])
            text, cls = np.divmod(pair, len(self.queries))
            n = self.own[cls + 1] - self.own[cls]
            score, total, b = np.zeros(len(pair)), np.cumsum(n), 0
            while b < len(pair):
                y = max(b + 1, int(np.searchsorted(total, (total[b - 1] if b else 0) + PRODUCTS, "right")))
                mine, nth = spans(self.own[cls[b:y]], n[b:y]), np.repeat(np.arange(b, y), n[b:y])
                key = (self.own_field[mine] * rows + text[nth]) * self.words + self.own_place[mine]
                spot = np.minimum(np.searchsorted(entry, key), len(entry) - 1)
                ok = (entry[spot] == key) & (self.own_scope[mine] == scope[text[nth]])
                score += np.bincount(nth[ok], self.own_w[mine[ok]] * gains[spot[ok]], len(pair))
                b = y
            yield text, cls, score
            a = z


def spans(starts: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The places of all spans, one after the other."""
    return np.repeat(starts - (np.cumsum(times) - times), times) + np.arange(times.sum())


def rounded(score: np.ndarray) -> np.ndarray:
    return np.floor(score * 1e6 + 0.5) / 1e6


class Best:
    """The best ``k`` texts of each of ``n`` queries so far: greatest score, then least id."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.cls, self.score, self.ids = np.empty(0, np.int64), np.empty(0), None
        self.reached = np.full(n, -np.inf)  # the k-th score so far

    def add(self, into: np.ndarray, seen: np.ndarray | None, ids: pa.Array) -> None:
        """``into``: scores of the texts ``ids`` by query; those that have no token of a query are not ``seen`` (null: score 0)."""
        k, rows = self.k, len(ids)
        some = (into > 0 if seen is None else seen).reshape(rows, self.n)
        into = rounded(into).reshape(rows, self.n)
        into[~some] = -np.inf
        if rows > k:
            np.maximum(self.reached, np.partition(into, rows - k, axis=0)[rows - k], out=self.reached)
        row, cls = np.nonzero(some & (into >= self.reached))
        if len(row):
            self.keep(cls, into[row, cls], ids.take(pa.array(row)))

    def keep(self, cls: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        """Keeps the best of these texts and of those so far."""
        k = self.k
        if self.ids is not None:
            cls, score, ids = np.append(self.cls, cls), np.append(self.score, score), pa.concat_arrays([self.ids, ids])
        order = np.lexsort((pc.rank(ids, null_placement="at_start", tiebreaker="dense").to_numpy(), -score, cls))
        cls = cls[order]
        start = np.flatnonzero(np.append(True, cls[1:] != cls[:-1]))
        nth = np.arange(len(cls)) - np.repeat(start, np.diff(np.append(start, len(cls))))
        order = order[nth < k]
        self.cls, self.score, self.ids = cls[nth < k], score[order], ids.take(pa.array(order))
        full = np.bincount(self.cls, minlength=self.n) >= k
        last = np.searchsorted(self.cls, np.flatnonzero(full), "right") - 1
        self.reached[full] = np.maximum(self.reached[full], self.score[last])

    def found(self, queries: pa.Array) -> pa.RecordBatch:
        """query_id, chunk_id, score; ``queries``: the ids of all."""
        return pa.RecordBatch.from_arrays([queries.take(pa.array(self.cls)), self.ids, pa.array(self.score)], names=["query_id", "chunk_id", "score"])


def best(rows: DataFrame, weights: DataFrame, fields: tuple[str, ...], k: int) -> DataFrame:
    """query_id, chunk_id, score: the best ``k`` texts of each query in each task; scores have six places.

    ``rows`` are those of ``counted`` with chunk_id, ``_scope`` and a ``<field>_mean``; ``weights`` (query_id,
    ``_scope``, ``_field``, place, w) are held by every task.  Where they have a column ``rare``, only texts are
    scored that have a rare token of a query: the work of a text is then that of the queries it shares one with.
    """
    python_ready(rows.sparkSession)
    x = rows.select("chunk_id", "_scope", *[c for f in fields for c in (f"{f}_len", f"{f}_mean", f"{f}_ids", f"{f}_tfs")])
    schema = StructType([weights.schema["query_id"], rows.schema["chunk_id"], StructField("score", DoubleType())])
    kind, rare = schema["query_id"].dataType, "rare" in weights.columns
    known = rows.sparkSession.sparkContext.broadcast(Weights(weights.select("query_id", "_scope", "_field", "place", "w", *["rare"] * rare).toArrow()))

    def entries(b, a, z, live):
        """Rows, fields, tokens and gains of a block's texts, by field."""
        for i in range(len(fields)):
            size, mean = (b.column(2 + 4 * i + j).slice(a, z - a).to_numpy(zero_copy_only=False).astype(float) for j in (0, 1))
            ids, tfs = (b.column(2 + 4 * i + j).slice(a, z - a) for j in (2, 3))
            row = pc.list_parent_indices(ids).to_numpy().astype(np.int64)
            ok = live[row]
            row, place, tf = row[ok], ids.flatten().to_numpy()[ok].astype(np.int64), tfs.flatten().to_numpy()[ok].astype(float)
            yield row, i, place, gain(tf, size[row], mean[row])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        net = known.value
        n = len(net.queries)
        if not n or not len(net.keys):
            return
        held = Best(n, k)
        step, wait = TEXTS if rare else max(1, CELLS // n), []

        def settle():
            if wait:
                held.keep(*(np.concatenate(v) for v in list(zip(*wait, strict=True))[:2]), pa.concat_arrays([w[2] for w in wait]))
                wait.clear()

        for b in batches:
            hash_ = b.column(1).to_numpy()
            scope = np.minimum(np.searchsorted(net.scopes, hash_), len(net.scopes) - 1)
            live = net.scopes[scope] == hash_
            for a in range(0, b.num_rows, step):
                z = min(a + step, b.num_rows)
                ids, parts = b.column(0).slice(a, z - a), entries(b, a, z, live[a:z])
                if rare:
                    row, field, place, gains = (np.concatenate(v) for v in zip(*[(r, np.full(len(r), i, np.int64), p, g) for r, i, p, g in parts], strict=True))
                    for text, cls, score in net.of_rare(z - a, row, field, scope[a:z], place, gains):
                        score = rounded(score)
                        ok = score >= held.reached[cls]
                        wait.append((cls[ok], score[ok], ids.take(pa.array(text[ok]))))
                    if sum(len(w[0]) for w in wait) > WAITING:
                        settle()
                    continue
                into = np.zeros((z - a) * n)
                seen = None if net.positive else np.zeros((z - a) * n, bool)
                for row, i, place, gains in parts:
                    net.scores(z - a, row, i, scope[a:z][row], place, gains, into, seen)
                held.add(into, seen, ids)
        settle()
        if held.ids is not None:
            yield held.found(pa.array(net.queries, to_arrow_type(kind)))

    return x.mapInArrow(run, schema)
