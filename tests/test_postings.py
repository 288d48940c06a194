"""The index on disk against BM25 over the texts."""

import random

import pytest
from pyspark.sql import functions as F

from pagewright.functions.text import tokens
from pagewright.operators import postings as P, retrieval as R


def test_index_equals_bm25_and_grows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_DOCS", 8)  # many blocks, so some are ruled out
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(words[min(59, int(rng.expovariate(0.1)))] for _ in range(n))
    rows = [(i, text(rng.randint(0, 40)), text(rng.randint(0, 3))) for i in range(300)] + [(900, None, "w1"), (901, "", None), (902, "w59 w59 w58", "w59")]
    chunks = spark.createDataFrame(rows, "chunk_id int, body string, section string")
    asked = spark.createDataFrame([(i, text(5), 2.5 if i % 2 else 1.0) for i in range(20)] + [(99, "unheard", 1.0), (98, "w59 w59", 1.0)], "query_id int, text string, section_weight double")
    asked = asked.withColumn("terms", tokens(F.col("text")))
    path, fields = str(tmp_path / "index"), ("body", "section")

    def same(some):
        a = [tuple(r) for r in P.search(spark, path, asked, 4).orderBy("query_id", "rank").collect()]
        b = [tuple(r) for r in R.bm25(some, asked, 4, fields=fields).select("query_id", "chunk_id", "score", "rank").orderBy("query_id", "rank").collect()]
        assert a == b and len(a) > 60

    P.add_documents(chunks.where("chunk_id < 200"), path, fields)
    same(chunks.where("chunk_id < 200"))
    P.add_documents(chunks.where("chunk_id >= 200"), path, fields)
    same(chunks)
    P.compact(spark, path)
    same(chunks)
    assert P._segments(spark, path)[0] == 3 and len(P._segments(spark, path)[1]) == 1
    for bad in (chunks.where("chunk_id = 5"), chunks.selectExpr("7000 AS chunk_id", "body", "section")):
        with pytest.raises(ValueError):
            P.add_documents(bad, path, fields)


def test_index_has_a_row_for_each_block(spark, tmp_path, monkeypatch):
    """Lists are made where the texts are read: a token's row for each block of a task, not one for each text; few queries at once give the same."""
    chunks = spark.createDataFrame([(f"d{i:03}", "same words here" + (" rare" if i in (7, 250) else "")) for i in range(256)] + [(None, "rare words")], "chunk_id string, body string").coalesce(1)
    path = str(tmp_path / "index")
    P.add_documents(chunks, path)
    rows = P._postings(spark, path, P._segments(spark, path)[1])
    assert sorted(r.n for r in rows.where("token = 'same'").collect()) == [128, 128] and rows.where("token = 'rare'").count() == 3
    asked = spark.createDataFrame([(i, ["rare", "same"]) for i in range(9)], "query_id int, terms array<string>")
    want = [tuple(r) for r in R.bm25(chunks, asked, 3).select("query_id", "chunk_id", "score", "rank").orderBy("query_id", "rank").collect()]
    monkeypatch.setattr(P, "QUERIES", 2)
    assert [tuple(r) for r in P.search(spark, path, asked, 3).orderBy("query_id", "rank").collect()] == want and len(want) == 27


def test_merged_percentiles(spark):
    from pagewright.operators import percentiles as K

    rows = spark.range(30_000).selectExpr("id % 3 AS k", "id % 7 AS d", "CASE WHEN id % 1000 = 0 THEN NULL ELSE CAST((id * 7919) % 30000 AS DOUBLE) END AS v")
    sketches = K.day_sketches(rows, ["k"], F.col("d"), "v")
    assert sketches.count() == 21
    for r in K.merged_percentiles(sketches, ["k"], [0.0, 0.5, 1.0]).collect():
        assert r.n == 9990 and r.percentiles[0] < 60 and abs(r.percentiles[1] - 15_000) < 600 and r.percentiles[2] > 29_900
    assert K.merged_percentiles(sketches.where("d < 2"), ["k"], [0.5]).count() == 3 and K.merged_percentiles(sketches.limit(0), ["k"], [0.5]).count() == 0
