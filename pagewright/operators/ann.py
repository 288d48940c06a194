"""Approximate nearest vectors by cosine: cells, product-quantised residuals, and exact scores of the best.

Cells and codebooks are learned by k-means on a bounded sample.  The index holds every vector: its cell, and its
residual as one byte for each few dimensions.  A query looks into the cells nearest to it, estimates scores from
tables of its products with the codewords, and only the vectors with the best estimates are fetched and scored
exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType

from ..runtime import cut_lineage, python_ready

#: Vectors that are learned from at most, rounds of k-means, codewords of a part, dimensions of a part.
SAMPLE, ROUNDS, WORDS, WIDTH = 8192, 10, 256, 2
#: Vectors of a cell that a task holds, and queries of a block.
CHUNK, BLOCK = 65_536, 8192


@dataclass
class Model:
    """Cells (unit vectors) and, for each part of the dimensions, codewords of residuals."""

    cells: np.ndarray
    words: np.ndarray

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell and the codes of each (unit) row."""
        cell = (x @ self.cells.T).argmax(1)
        rest = x - self.cells[cell]
        codes = np.empty((len(x), len(self.words)), np.uint8)
        for p, words in enumerate(self.words):
            part = rest[:, p * WIDTH : (p + 1) * WIDTH]
            codes[:, p] = ((words * words).sum(1) - 2 * part @ words[:, : part.shape[1]].T).argmin(1)
        return cell, codes

    def tables(self, x: np.ndarray) -> np.ndarray:
        """Products of each row's parts with the codewords: rows x parts x words."""
        padded = np.zeros((len(x), len(self.words) * WIDTH))
        padded[:, : x.shape[1]] = x
        return np.einsum("qpd,pwd->qpw", padded.reshape(len(x), len(self.words), WIDTH), self.words)


def _means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` centres of the rows; a centre without rows takes a random row."""
    centres = x[rng.permutation(len(x))[:k]]
    for _ in range(ROUNDS):
        own = ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)
        n = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=len(centres))])
    return centres


def _unit(lists) -> np.ndarray:
    x = np.stack([np.asarray(v, float) for v in lists])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def learned(vectors: DataFrame, cells: int, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` vectors (those of the least id hashes), all of one size and not null vectors."""
    rows = vectors.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select("vector").collect()  # at most ``sample`` rows
    x, rng = _unit([r[0] for r in rows]), np.random.default_rng(7)
    centres = _means(x, min(cells, len(x)), rng)
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    rest = x - centres[(x @ centres.T).argmax(1)]
    parts = -(-x.shape[1] // WIDTH)
    padded = np.zeros((len(x), parts * WIDTH))
    padded[:, : x.shape[1]] = rest
    words = np.stack([_means(padded[:, p * WIDTH : (p + 1) * WIDTH], min(WORDS, len(x)), rng) for p in range(parts)])
    return Model(centres, words)


def indexed(vectors: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """chunk_id, keys, cell, code of every vector: what a search reads."""
    python_ready(vectors.sparkSession)
    schema = StructType([vectors.schema["chunk_id"], *(vectors.schema[k] for k in keys), StructField("cell", IntegerType()), StructField("code", BinaryType())])

    def run(batches):
        for b in batches:
            if len(b):
                cell, codes = model.encode(_unit(b["vector"]))
                yield pd.concat([b.drop(columns="vector"), pd.DataFrame({"cell": cell.astype("int32"), "code": [c.tobytes() for c in codes]}, index=b.index)], axis=1)

    return vectors.select("chunk_id", *keys, "vector").mapInPandas(run, schema)


def candidates(index: DataFrame, queries: DataFrame, model: Model, keys: list[str], probes: int, most: int) -> DataFrame:
    """query_id, chunk_id, estimate: the ``most`` best estimates of each query in its ``probes`` nearest cells and its scope."""
    n = {r.cell: r.n for r in index.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a cell
    chunks = {c: -(-k // CHUNK) for c, k in n.items()}
    blocks = max(1, -(-queries.count() // BLOCK))
    kind = queries.schema
    probe = StructType([kind["query_id"], *(kind[k] for k in keys), kind["vector"], StructField("cell", IntegerType()), StructField("chunk", IntegerType())])

    def probing(batches):
        for b in batches:
            if not len(b):
                continue
            order = np.argsort(-(_unit(b["vector"]) @ model.cells.T), axis=1, kind="stable")[:, :probes]
            for at in range(0, len(b), 256):  # a slice of queries for each frame
                part = b.iloc[at : at + 256]
                row, cell, chunk = zip(*[(i, c, k) for i, own in enumerate(order[at : at + 256].tolist()) for c in own for k in range(chunks.get(c, 0))], strict=True)
                yield part.iloc[list(row)].assign(cell=np.array(cell, "int32"), chunk=np.array(chunk, "int32"))

    many = F.element_at(F.array(*[F.lit(max(1, chunks.get(c, 1))) for c in range(len(model.cells))]), F.col("cell") + 1)
    a = index.withColumn("chunk", F.pmod(F.xxhash64("chunk_id"), many).cast("int")).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    q = queries.select("query_id", *keys, "vector").mapInPandas(probing, probe).withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    of = ["cell", "chunk", "_block"]

    def solve(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(held) and len(asked):
            held = held.sort_values("chunk_id", kind="stable")
            codes = np.frombuffer(b"".join(held["code"]), np.uint8).reshape(len(held), -1)
            ids, centre = held["chunk_id"].to_numpy(), model.cells[held["cell"].iloc[0]]
            scopes = list(zip(*(held[k] for k in keys), strict=True)) if keys else None
            for at in range(0, len(asked), 64):
                part = asked.iloc[at : at + 64]
                x = _unit(part["vector"])
                tables = model.tables(x)
                estimate = np.repeat((x @ centre)[:, None], len(ids), 1)
                for p in range(codes.shape[1]):
                    estimate += tables[:, p][:, codes[:, p]]
                for i, me in enumerate(part["query_id"]):
                    s, ok = estimate[i], np.arange(len(ids))
                    if keys:
                        mine = tuple(part[k].iloc[i] for k in keys)
                        ok = np.flatnonzero([y == mine for y in scopes])
                    if len(ok) > most:
                        ok = ok[np.argpartition(-s[ok], most - 1)[:most]]
                    out.append(pd.DataFrame({"query_id": me, "chunk_id": ids[ok], "estimate": s[ok]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "chunk_id": [], "estimate": []})

    found = a.groupBy(*of).cogroup(q.groupBy(*of)).applyInPandas(solve, StructType([kind["query_id"], index.schema["chunk_id"], StructField("estimate", DoubleType())]))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("estimate"), "chunk_id"))
    return found.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def scored(found: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, chunk_id, score: the exact cosine of each found pair, to five places."""
    from .retrieval import dot, norm

    x = found.select("query_id", "chunk_id").join(queries.select("query_id", F.col("vector").alias("_q")), "query_id")
    x = cut_lineage(x).join(vectors.select("chunk_id", F.col("vector").alias("_v")), "chunk_id")
    return x.select("query_id", "chunk_id", F.round(dot(F.col("_q"), F.col("_v")) / (norm(F.col("_q")) * norm(F.col("_v"))), 5).alias("score"))
