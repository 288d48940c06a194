"""Toxicity: a convolutional text classifier trained in numpy.

A word is the sum of hashed embeddings of itself and of its first bytes.  Filters of one, two and three
words slide over the text, the greatest answer of each filter is kept, and a logistic layer scores them.
Every labelled row is used: four fifths of them teach the weights, the others, which training does not see,
set the thresholds by language.  Rows are dealt over shards of bounded size; each round, every shard goes on
from the same weights, and what the shards changed is averaged.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import deepcopy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..runtime import cut_to_table
from .text_hash import small_batches
from .word_features import Words, fold_of, pieces

#: Parameters: rows and bytes of text of a shard, about; labels of at most so many rows are broadcast.
SHARD_ROWS, SHARD_BYTES, BROADCAST_MARKS = 4000, 1 << 25, 2_000_000
#: Steps of a changed weight in one, as changes are added up in whole numbers; steps of a score that thresholds tell apart.
FINE, STEPS = 1 << 32, 1000
BITS, DIM, WIDTHS, FILTERS = 16, 6, (1, 2, 3), 6
PREFIXES = (4, 5, 6)
EPOCHS, RATE, BATCH = 4, 0.02, 32


def features(data: np.ndarray) -> np.ndarray:
    """Rows of the embedding table of each word of a piece."""
    w = Words(data)
    if not len(w):
        return np.empty((0, 1 + len(PREFIXES)), np.int64)
    return np.stack([w.whole(), *[w.prefix(n) for n in PREFIXES]], 1).astype(np.uint64).__rshift__(np.uint64(64 - BITS)).astype(np.int64)


def document(text: str | None) -> np.ndarray:
    parts = [features(p) for p in pieces(text)]
    return np.concatenate(parts) if parts else np.empty((0, 1 + len(PREFIXES)), np.int64)


class Classifier:
    """Embeddings, filters and the last layer."""

    def __init__(self, seen: np.ndarray, total: np.ndarray, seed: int = 7):
        """``seen``: texts of each label (0, 1) with each feature; ``total``: texts of each label."""
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.05, (1 << BITS, DIM)).astype(np.float32)
        # the first component starts as the log odds of a feature among toxic and other texts
        seen, total = seen + 0.5, np.maximum(total, 1)
        odds = np.log(seen[1] / total[1]) - np.log(seen[0] / total[0])
        odds[(seen.sum(0) <= 1.5)] = 0
        self.table[:, 0] = np.maximum(odds, -1) / 4
        self.filters = [rng.normal(0, 0.1, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f, w in zip(self.filters, WIDTHS, strict=True):
            f[np.arange(w) * DIM, :2] += 1.0 / w
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.last = np.full(FILTERS * len(WIDTHS), 0.3, np.float32)
        self.base = np.float32(-1.0)

    def weights(self) -> np.ndarray:
        """All weights as rows of ``DIM``, the table's rows first."""
        rest = np.concatenate([*[f.ravel() for f in self.filters], *self.bias, self.last, [self.base]]).astype(np.float64)
        return np.vstack([self.table, np.pad(rest, (0, -len(rest) % DIM)).reshape(-1, DIM)])

    def set_weights(self, rows: np.ndarray) -> None:
        self.table = rows[: 1 << BITS].astype(np.float32)
        rest, at = rows[1 << BITS :].ravel().astype(np.float32), 0
        for held in [*self.filters, *self.bias, self.last]:
            held[...] = rest[at : at + held.size].reshape(held.shape)
            at += held.size
        self.base = rest[at]

    def embed(self, ids: np.ndarray) -> np.ndarray:
        return self.table[ids].sum(1)

    def answers(self, x: np.ndarray, filters: np.ndarray, width: int) -> np.ndarray:
        """Answers at each word; the text goes on with zeros."""
        if width > 1:
            padded = np.vstack([x, np.zeros((width - 1, DIM), np.float32)])
            x = np.hstack([padded[j : j + len(x)] for j in range(width)])
        return x @ filters

    def pooled(self, text: str | None) -> np.ndarray:
        """The greatest answer of every filter over the whole text; 0 at least."""
        return self.greatest(features(data) for data in pieces(text))

    def greatest(self, parts: Iterator[np.ndarray]) -> np.ndarray:
        """``pooled`` of a text by the features of its pieces."""
        best, carry = np.zeros(FILTERS * len(WIDTHS), np.float32), np.empty((0, DIM), np.float32)
        for ids in parts:
            # the last words of a piece are seen again with the next
            x = np.vstack([carry, self.embed(ids)])
            carry = x[-(max(WIDTHS) - 1) :]
            for a in range(0, len(x), 8192):
                part = x[a : a + 8192 + max(WIDTHS) - 1]
                got = [self.answers(part, f, w).max(0) + b for f, b, w in zip(self.filters, self.bias, WIDTHS, strict=True)]
                np.maximum(best, np.concatenate(got), out=best)
        return best

    def score(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(pooled @ self.last + self.base, -30, 30).astype(np.float64)))

    def fit(self, docs: list[np.ndarray], labels: np.ndarray, epoch: int, seed: int = 11) -> None:
        """One round of plain stochastic gradient steps; the gradient reaches the words where filters answer most."""
        if len(docs):
            rate = RATE / (1 + epoch)
            turn = np.random.default_rng((seed, epoch)).permutation(len(docs))
            for start in range(0, len(docs), BATCH):
                step = [np.zeros_like(f) for f in self.filters]
                bias = [np.zeros_like(b) for b in self.bias]
                last, base, words = np.zeros_like(self.last), 0.0, []
                for d in turn[start : start + BATCH]:
                    ids = docs[d]
                    if not len(ids):
                        base += float(self.score(np.zeros(len(self.last)))) - labels[d]
                        continue
                    x = self.embed(ids)
                    at, h = [], []
                    for f, b, w in zip(self.filters, self.bias, WIDTHS, strict=True):
                        z = self.answers(x, f, w)
                        at.append(z.argmax(0))
                        h.append(z.max(0) + b)
                    h = np.concatenate(h)
                    wrong = np.float32(self.score(np.maximum(h, 0)) - labels[d])
                    base += wrong
                    last += wrong * np.maximum(h, 0)
                    back = wrong * self.last * (h > 0)
                    for k, w in enumerate(WIDTHS):
                        own = back[k * FILTERS : (k + 1) * FILTERS]
                        bias[k] += own
                        for j in range(w):
                            rows = np.minimum(at[k] + j, len(x) - 1)
                            live = at[k] + j < len(x)
                            step[k][j * DIM : (j + 1) * DIM] += (x[rows] * (own * live)[:, None]).T
                            words.append((ids[rows], (self.filters[k][j * DIM : (j + 1) * DIM] * (own * live)).T))
                for k in range(len(WIDTHS)):
                    self.filters[k] -= rate * step[k]
                    self.bias[k] -= rate * bias[k]
                self.last -= rate * last
                self.base -= np.float32(rate * base)
                if words:
                    ids, g = np.concatenate([i for i, _ in words]), np.concatenate([g for _, g in words])
                    np.add.at(self.table, ids, -rate * g[:, None, :])


def _threshold(n: np.ndarray) -> float:
    """The threshold of greatest F1, of numbers of texts by step of the score and label; between equal ones that nearest to a half."""
    cuts = np.union1d(np.flatnonzero(n.sum(1)), STEPS // 2)
    found = n[::-1].cumsum(0)[::-1][cuts]
    f1 = 2 * found[:, 1] / np.maximum(1, found.sum(1) + n[:, 1].sum())
    best = cuts[f1 >= f1.max() - 1e-12]
    return float(best[np.abs(best - STEPS // 2).argmin()] / STEPS)


def _read(b: pa.RecordBatch) -> list[np.ndarray]:
    """The features of each text of a batch of the table that ``_features`` makes."""
    return [np.frombuffer(x.as_py(), np.uint16).reshape(-1, 1 + len(PREFIXES)) for x in b.column("ids")]


def _features(rows: DataFrame) -> DataFrame:
    """``rows`` (toxic, lang, held, shard, turn, text) with the features of the whole text for ``text``."""

    def run(batches):
        for b in batches:
            ids = pa.array([document(t.as_py()).astype(np.uint16).tobytes() for t in b.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], ids], names=[*b.schema.names[:-1], "ids"])

    return rows.select("toxic", "lang", "held", "shard", "turn", "text").mapInArrow(run, "toxic int, lang string, held boolean, shard int, turn long, ids binary")


def _started(seen_by: DataFrame) -> Classifier:
    """The classifier before training: every text's features are counted in tasks, the counts added up by Spark."""

    def run(batches):
        n, total = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
        for b in batches:
            for d, y in zip(_read(b), b.column("toxic").to_pylist(), strict=True):
                n[y, np.unique(d)] += 1
                total[y] += 1
        flat = np.append(n.ravel(), total)
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(flat[at])], names=["at", "n"])

    flat = np.zeros((2 << BITS) + 2)
    counts = seen_by.select("toxic", "ids").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # a row a feature and label
    flat[counts["at"].to_numpy()] = counts["n"].to_numpy()
    return Classifier(flat[:-2].reshape(2, -1), flat[-2:])


def _round(model: Classifier, rows: DataFrame, epoch: int) -> None:
    """One round: every shard trains from the model's weights; the mean of their changes, by rows, is the model's."""
    known = rows.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches):
        start = known.value
        before = start.weights()
        change, n = np.zeros(before.shape, np.int64), 0

        def learn(shard, docs, labels):
            own = deepcopy(start)
            own.fit(docs, np.array(labels), epoch, shard)
            return np.rint((own.weights() - before) * FINE).astype(np.int64) * len(docs)

        shard, docs, labels = None, [], []
        for b in batches:
            for s, d, y in zip(b.column("shard").to_pylist(), _read(b), b.column("toxic").to_pylist(), strict=True):
                if s != shard and docs:
                    change, n, docs, labels = change + learn(shard, docs, labels), n + len(docs), [], []
                shard = s
                docs.append(d)
                labels.append(y)
        if docs:
            change, n = change + learn(shard, docs, labels), n + len(docs)
        at = np.flatnonzero(change.any(1))
        columns = [pa.array(np.append(at, -1).astype(np.int32)), *[pa.array(np.append(change[at, j], n if j == 0 else 0)) for j in range(DIM)]]
        yield pa.RecordBatch.from_arrays(columns, names=["at", *[f"d{j}" for j in range(DIM)]])

    kind = ", ".join(["at int", *[f"d{j} long" for j in range(DIM)]])
    made = rows.select("shard", "toxic", "ids").mapInArrow(run, kind)
    made = made.groupBy("at").agg(*[F.sum(f"d{j}").alias(f"d{j}") for j in range(DIM)]).toArrow()  # at most a row of each row of weights
    at = made["at"].to_numpy()
    change = np.stack([made[f"d{j}"].to_numpy() for j in range(DIM)], 1)
    n = int(change[at == -1, 0].sum())
    weights = model.weights()
    weights[at[at >= 0]] += change[at >= 0] / (FINE * max(1, n))
    model.set_weights(weights)
    known.destroy()


def _thresholds(model: Classifier, rows: DataFrame) -> dict:
    """The thresholds by language, from the scores of ``rows``; languages of fewer than 5 toxic rows have none of their own."""
    known = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        net = known.value
        for b in batches:
            step = [int(float(net.score(net.greatest([d]))) * STEPS) for d in _read(b)]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("toxic"), pa.array(step, pa.int32())], names=["lang", "toxic", "step"])

    counts = cut_to_table(rows.select("lang", "toxic", "ids").mapInArrow(run, "lang string, toxic int, step int").groupBy("lang", "toxic", "step").agg(F.count("*").alias("n")))
    every = np.zeros((STEPS + 1, 2), np.int64)
    for r in counts.groupBy("toxic", "step").agg(F.sum("n").alias("n")).collect():  # a row a step and label
        every[r["step"], r.toxic] = r.n
    thresholds, by_lang = {None: _threshold(every) if every.any() else 0.5}, {}
    often = counts.where("toxic = 1 AND lang <> ''").groupBy("lang").agg(F.sum("n").alias("n")).where("n >= 5").select("lang")
    for r in counts.join(often, "lang").collect():  # a row a step, label and language with a threshold
        by_lang.setdefault(r.lang, np.zeros((STEPS + 1, 2), np.int64))[r["step"], r.toxic] = r.n
    return thresholds | {lang: _threshold(n) for lang, n in sorted(by_lang.items())}


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> tuple[Classifier | None, dict]:
    """A classifier and its thresholds by language (None: for any other), of all labelled rows outside fold 0 with their whole texts.

    ``labels`` has ``key`` and ``toxic`` (0, 1; others are ignored; a key labelled both ways is toxic).  About
    each fifth row, by a hash of its key, is held for the thresholds.  Null and empty texts teach nothing;
    without labelled rows there is no classifier.
    """
    small_batches(docs.sparkSession)
    marks = labels.where(F.col("toxic").isin(0, 1) & (fold_of(F.col(key)) != 0)).groupBy(key).agg(F.max("toxic").cast("int").alias("toxic"))
    marks = cut_to_table(marks)
    if marks.count() <= BROADCAST_MARKS:
        marks = F.broadcast(marks)
    found = docs.where(F.length("text") > 0).select(key, "text", "lang").join(marks, key)
    held = F.pmod(F.xxhash64(F.col(key), F.lit("held")), F.lit(5)) == 0
    size = found.agg(F.count("*").alias("n"), F.count_if(~held).alias("taught"), F.sum(F.octet_length("text")).alias("bytes")).first()
    if not size.n:
        return None, {None: 0.5}
    shards = max(1, -(-size.n // SHARD_ROWS), -(-size.bytes // SHARD_BYTES))
    rows = found.withColumns({"held": held if size.taught else F.lit(False), "turn": F.xxhash64(key)})
    rows = _features(rows.withColumn("shard", F.pmod(F.xxhash64(F.col(key), F.lit("shard")), F.lit(shards)).cast("int")))
    rows = cut_to_table(rows.repartition(shards, "held", "shard").sortWithinPartitions("held", "shard", "turn", "ids"))
    taught = rows.where("NOT held")
    model = _started(taught)
    for epoch in range(EPOCHS):
        _round(model, taught, epoch)
    return model, _thresholds(model, rows.where("held"))


def score_toxicity(docs: DataFrame, model: Classifier | None, thresholds: dict, text: str = "text", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """``docs``'s columns ``keep`` with ``score`` (of the whole text alone) and ``flagged``.

    ``flagged`` holds the score against the threshold of the row's language.  Null and empty texts get
    the score of a text without words; without a classifier all scores are 0.5.  Rows are judged one by
    one; columns named like the results are not kept.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in (keep or docs.columns) if c not in ("score", "flagged")]
    table = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], F.col(lang).alias("_lang"), F.col(text).alias("_text"))
    known = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size

    def run(batches):
        net = known.value
        for b in batches:
            scores = [0.5 if net is None else float(net.score(net.pooled(t.as_py()))) for t in b.column("_text")]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores, pa.float64())], names=[*b.schema.names[:-1], "score"])

    kinds = [f"_k{i} {kind}" for i, (_, kind) in enumerate(table.drop("_text", "_lang").dtypes)]
    made = table.mapInArrow(run, ", ".join([*kinds, "_lang string", "score double"]))
    cut = F.coalesce(*[F.when(F.col("_lang") == k, F.lit(v)) for k, v in thresholds.items() if k is not None], F.lit(thresholds[None]))
    return made.withColumn("flagged", F.col("score") >= cut).drop("_lang").withColumnsRenamed({f"_k{i}": c for i, c in enumerate(keep)})


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """A toxicity score of every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model, thresholds = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_toxicity(docs, model, thresholds, keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "flagged")
