"""Exact top-k search by inner product: a Voronoi kNN join.

Inner product search becomes Euclidean by one more component: data get sqrt(M - |x|^2), queries 0, so
|q - x|^2 = |q|^2 + M - 2 q.x.  Queries are grouped by their nearest pivot.  Summaries of each cell (the
greatest distance of its queries, the k+1 least distances of its data) bound the k-th distance of every
query of a group; a data row is sent to a group only if its own least possible distance is within that
bound.  Groups are cut into blocks of queries and of data, solved in tasks, and merged per query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import cut_to_table, python_ready

#: Rows of a block of queries and of data; a task holds one block of each.  What is shuffled is the data
#: once for each block of queries and the queries once for each block of data, so blocks are large.
QUERY_BLOCK, DATA_BLOCK = 4096, 32_768
#: Pivots: one for each block of queries, within these bounds; the rows of least id hash.  Only pivots, their
#: summaries (k+1 numbers a cell) and counts reach the driver.
LEAST_PIVOTS, MOST_PIVOTS = 4, 1024
#: Rows that a task sends to groups at once.
SENT = 10_000


def usable(vector: Column) -> Column:
    """Not null and every component finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(float("inf"))))


def whole(vector: Column) -> Column:
    """floor(256 x) of each component as a double."""
    return F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")))


def _matrix(lists, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width))
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def _gaps(x: np.ndarray, last: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows (last: their extra component) to pivots."""
    sq = (x * x).sum(1) + last * last
    dot = x @ pivots[:, :-1].T + last[:, None] * pivots[:, -1]
    return np.sqrt(np.maximum(sq[:, None] + (pivots * pivots).sum(1) - 2 * dot, 0))


def top_k(data: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "vector", n_pivots: int | None = None, query_block: int = QUERY_BLOCK, data_block: int = DATA_BLOCK, sent_rows: int = SENT) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest inner products of each query with all of ``data``.

    ``vector`` is an array of whole numbers.  A query's own row, that is any row of its id, is no
    candidate.  Ties go to the smaller id.  Null ids and null vectors take no part; vectors of unequal
    length are padded with zeros; a query that occurs twice counts once, a data row that occurs twice
    counts twice; with fewer rows than ``k`` all are returned; empty tables give no rows.
    """
    spark = data.sparkSession
    python_ready(spark)
    rows = cut_to_table(data.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<long>").alias("v")))
    asked = cut_to_table(queries.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("query_id"), F.col(vector).cast("array<long>").alias("v")).distinct())
    square = F.aggregate(F.transform("v", lambda x: x.cast("double") * x), F.lit(0.0), lambda a, x: a + x)
    n, width, most = rows.agg(F.count("*"), F.max(F.size("v")), F.max(square)).first()
    schema = "query_id long, rank int, vec_id long, score long"
    n_asked, q_width = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n or q_width is None:
        return spark.createDataFrame([], schema)
    width = max(width, q_width, 1)
    n_pivots = n_pivots or min(MOST_PIVOTS, max(LEAST_PIVOTS, -(-n_asked // query_block)))
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(n_pivots).collect()  # at most n_pivots rows
    pivots = _matrix([r.v for r in chosen], width)
    pivots = np.hstack([pivots, np.sqrt(np.maximum(most - (pivots * pivots).sum(1), 0))[:, None]])
    p = len(pivots)

    def of_data(x):
        return _gaps(x, np.sqrt(np.maximum(most - (x * x).sum(1), 0)), pivots)

    def grouped(batches):
        for b in batches:
            gaps = _gaps(x := _matrix(b["v"], width), np.zeros(len(x)), pivots)
            cell = gaps.argmin(1)
            yield pd.DataFrame({"query_id": b["query_id"], "v": b["v"], "cell": cell.astype("int32"), "gap": gaps[np.arange(len(b)), cell]})

    def nearest(batches):
        best = [np.empty(0)] * p
        for b in batches:
            gaps = of_data(_matrix(b["v"], width))
            cell, least = gaps.argmin(1), gaps.min(1)
            for c in np.unique(cell):
                best[c] = np.sort(np.concatenate([best[c], least[cell == c]]))[: k + 1]
        yield pd.DataFrame([(c, g) for c in range(p) for g in best[c]], columns=["cell", "gap"]).astype({"cell": "int32", "gap": "double"})

    cells = asked.mapInPandas(grouped, "query_id long, v array<long>, cell int, gap double")
    reach = {r.cell: (r.far, r.n) for r in cells.groupBy("cell").agg(F.max("gap").alias("far"), F.count("*").alias("n")).collect()}  # a row a pivot
    near = rows.mapInPandas(nearest, "cell int, gap double").groupBy("cell").agg(F.slice(F.array_sort(F.collect_list("gap")), 1, k + 1).alias("gaps")).collect()  # k+1 numbers a pivot
    between = np.sqrt(np.maximum(((pivots[:, None] - pivots[None]) ** 2).sum(2), 0))
    bound = np.full(p, -1.0)
    for c, (far, _) in reach.items():
        ups = np.sort(np.concatenate([far + between[c, r.cell] + np.array(r.gaps) for r in near]))
        # within ``bound`` of the pivot lies every row that can be among the k nearest of a query of the cell
        bound[c] = (ups[k] + far) * (1 + 1e-9) + 1e-6 if len(ups) > k else np.inf
    blocks = np.array([-(-reach.get(c, (0, 0))[1] // query_block) for c in range(p)])
    n_chunks = max(1, -(-n // data_block))

    def sent(batches):
        for b in batches:
            go = of_data(_matrix(b["v"], width)) <= bound[None]
            row, cell = np.nonzero(go)
            times = blocks[cell]
            ends, at = np.cumsum(times), 0
            while at < len(row):  # a vector that goes to many groups is not repeated for all of them at once
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + sent_rows, "right")))
                which, group = np.repeat(row[at:to], times[at:to]), np.repeat(cell[at:to], times[at:to])
                turn = np.concatenate([np.arange(t) for t in times[at:to]])
                yield pd.DataFrame({"vec_id": b["vec_id"].values[which], "v": b["v"].values[which], "cell": group.astype("int32"), "block": turn.astype("int32")})
                at = to

    left = (
        cells.withColumn("block", F.pmod(F.xxhash64("query_id"), F.element_at(F.array(*[F.lit(int(max(x, 1))) for x in blocks]), F.col("cell") + 1)).cast("int"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1)))).select("cell", "block", "chunk", "query_id", "v")
    )
    right = rows.mapInPandas(sent, "vec_id long, v array<long>, cell int, block int").withColumn("chunk", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_chunks)).cast("int"))

    def solve(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(d):
            d = d.sort_values("vec_id", kind="stable")
            ids, x = d["vec_id"].to_numpy(), _matrix(d["v"], width)
            small = np.abs(x).max(initial=0) * max(1.0, max((max(map(abs, v), default=0) for v in q["v"]), default=0)) * width < 2**52
            x = x if small else np.array([list(v) + [0] * (width - len(v)) for v in d["v"]], dtype=object)
            for a in range(0, len(q), 64):
                part = q.iloc[a : a + 64]
                y = _matrix(part["v"], width) if small else np.array([list(v) + [0] * (width - len(v)) for v in part["v"]], dtype=object)
                scores = y @ x.T
                for i, me in enumerate(part["query_id"]):
                    s = np.where(ids == me, -np.inf if small else None, scores[i]) if small else scores[i]
                    ok = np.flatnonzero(ids != me)
                    if small and len(ok) > k:
                        cut = np.partition(s[ok], len(ok) - k)[len(ok) - k]
                        ok = ok[s[ok] >= cut]
                    best = sorted(ok, key=lambda j: (-s[j], ids[j]))[:k]
                    out += [(me, i + a, int(ids[j]), int(s[j])) for j in best]
        return pd.DataFrame(out, columns=["query_id", "which", "vec_id", "score"])

    keys = ["cell", "block", "chunk"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(solve, "query_id long, which long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_top_k(spark, sf_dir: str) -> DataFrame:
    """The five best rows for every vector whose id is divisible by 50, against all rows."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    ready = table.where(usable(F.col("embedding"))).select("vec_id", whole(F.col("embedding")).alias("vector"))
    return top_k(ready, ready.where(F.col("vec_id") % 50 == 0), 5)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(q.v, d.v)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
