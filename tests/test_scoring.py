"""BM25 inside rows: as by joins, in small blocks, with rare tokens apart, and with few rows out of a task."""

import random

from pyspark.sql import functions as F

from pagewright.functions.text import tokens
from pagewright.operators import retrieval as R, scoring


def tables(spark, n=300):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    texts = [(f"c{i:04d}", " ".join(rng.choices(words, range(40, 0, -1), k=rng.randint(1, 12))) + (f" only{i}" if i % 3 == 0 else ""), rng.choice(words), rng.choice("ab")) for i in range(n)]
    texts += [("none", None, "w1", "a"), ("scopeless", "w1 w2", "w3", None)]
    asked = [(i, " ".join(rng.choices(words, k=3)) + f" only{rng.randrange(n)}", rng.choice("ab"), 2.5) for i in range(30)] + [(90, "w1 w1 w2", "a", 2.5), (91, "w2 w1 w1", "a", 2.5), (92, "nowhere", "a", 1.0)]
    chunks = spark.createDataFrame(texts, "chunk_id string, body string, section string, lang string").repartition(3)
    return chunks, spark.createDataFrame(asked, "query_id long, text string, lang string, section_weight double").withColumn("terms", tokens(F.col("text")))


def rows(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 5)) for r in df.collect())


def test_as_by_joins(spark, monkeypatch):
    chunks, asked = tables(spark)
    by_rows = {s: rows(R.bm25(chunks, asked, 4, scope=list(s), fields=("body", "section"))) for s in ((), ("lang",))}
    monkeypatch.setattr(R, "MOST_TOKENS", 3)
    by_joins = {s: rows(R.bm25(chunks, asked, 4, scope=list(s), fields=("body", "section"))) for s in by_rows}
    assert by_rows == by_joins and len(by_rows[()]) > 100


def test_small_blocks_and_rare_tokens(spark, monkeypatch):
    chunks, asked = tables(spark)
    want = rows(R.bm25(chunks, asked, 4, fields=("body", "section")))
    monkeypatch.setattr(R, "MOST_CLASSES", 2)
    monkeypatch.setattr(R, "RARE", 25)
    assert rows(R.bm25(chunks, asked, 4, fields=("body", "section"))) == want
    twice = chunks.unionByName(chunks.where("chunk_id < 'c0010'"))  # ids that occur twice are one text
    assert rows(R.bm25(twice, asked, 4)) == rows(R.joined_bm25(twice, asked.select("query_id", F.lit(1.0).alias("body_weight"), F.explode("terms").alias("token")).groupBy("query_id", "body_weight", "token").agg(F.count("*").alias("times")), 4, [], ("body",)))


def test_few_rows_leave_a_task(spark, monkeypatch):
    chunks, asked = tables(spark, 400)
    seen = []
    best = scoring.best
    monkeypatch.setattr(scoring, "best", lambda *a: seen.append(best(*a)) or seen[-1])
    R.bm25(chunks, asked, 2).collect()
    assert seen[0].count() <= 2 * 33 * seen[0].rdd.getNumPartitions() and asked.count() == 33


def test_tasks_grow_with_rows(spark):
    from pagewright.runtime import spread

    df = spread(spark.range(1000).withColumn("document_id", F.col("id") % 50), 20, "document_id")
    assert df.rdd.getNumPartitions() == 50 and df.count() == 1000


def test_chunks_are_made_once(spark, monkeypatch):
    """A query that needs hits and their chunks makes the chunks once, and sorts none of them for ordinals that it doesn't use."""
    from pagewright.plans import chunk_queries as Q, session_queries as S

    made, every = [], Q.every_chunk
    monkeypatch.setattr(Q, "every_chunk", lambda *a: made.append(every(*a)) or made[-1])
    S.citations(spark, "/root/testdata/sf0.001")
    assert len(made) == 1
    plan = made[0].select("strategy", "kind")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_many_queries_are_not_joined(spark, monkeypatch):
    """Many different queries whose tokens no few texts have are scored where the texts are, in parts of any size; no join makes pairs of them."""
    chunks, asked = tables(spark)
    scopes = ((), ("lang",))
    want = {s: rows(R.bm25(chunks, asked, 4, scope=list(s), fields=("body", "section"))) for s in scopes}
    monkeypatch.setattr(R, "joined_bm25", None)
    for name, value in (("MOST_CLASSES", 2), ("RARE", 1), ("MOST_TOKENS", 75), ("MOST_WEIGHTS", 90)):
        monkeypatch.setattr(R, name, value, raising=False)
    for name, value in (("PRODUCTS", 64), ("TEXTS", 16), ("WAITING", 5)):
        monkeypatch.setattr(scoring, name, value, raising=False)
    assert {s: rows(R.bm25(chunks, asked, 4, scope=list(s), fields=("body", "section"))) for s in scopes} == want


def test_copies_are_one_text(spark):
    chunks, asked = tables(spark)
    twice = chunks.unionByName(chunks.where("chunk_id < 'c0100'"))
    assert rows(R.bm25(twice, asked, 4, fields=("body", "section"), copies=True)) == rows(R.bm25(chunks, asked, 4, fields=("body", "section")))


def test_scores_that_round_to_nothing_are_hits():
    """As in SQL: a token that nearly all of millions of texts have gives 0.000000, and its texts are hits."""
    import numpy as np
    import pyarrow as pa

    held = scoring.Best(1, 2)
    held.add(np.array([2e-8, 0.0, 0.5]), None, pa.array([7, 8, 9]))
    assert held.ids.to_pylist() == [9, 7] and held.score.tolist() == [0.5, 0.0]


def test_rare_tokens_in_parts(monkeypatch):
    """However few products are made at once, each text and query that share a rare token are found once, with the whole score."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    place = rng.integers(0, 30, 400)
    weights = pa.table({"query_id": rng.integers(0, 50, 400), "_scope": rng.integers(0, 2, 400), "_field": rng.integers(0, 2, 400), "place": place, "w": rng.random(400), "rare": place > 9})
    net = scoring.Weights(weights)
    entry = np.unique(rng.integers(0, 2 * 60 * 33, 1500))  # field, text, token; tokens from 30 on are no query's
    field, row, token = entry // (60 * 33), entry // 33 % 60, entry % 33
    gains, scope = rng.random(len(entry)), rng.integers(0, 2, 60)
    want = {}
    for q, s, f, p, w, r in zip(*weights.to_pydict().values(), strict=True):
        for i in np.flatnonzero((field == f) & (token == p) & (scope[row] == s)):
            key = (row[i], int(np.searchsorted(net.queries, q)))
            total, some = want.get(key, (0.0, False))
            want[key] = total + w * gains[i], some or r
    want = {k: round(v, 9) for k, (v, some) in want.items() if some}
    for most in (1 << 23, 40):
        monkeypatch.setattr(scoring, "PRODUCTS", most)
        parts = [p for x in net.of_rare(60, row, field, scope, token, gains) for p in zip(*x, strict=True)]
        assert len(parts) == len(want) > 100 and {(t, c): round(v, 9) for t, c, v in parts} == want
