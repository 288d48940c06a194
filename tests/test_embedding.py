import math

import pytest
from pyspark.sql import functions as F

from pagewright.operators import assets as A, retrieval as R
from pagewright.operators.embedding import embedded


def test_embedding(spark, tmp_path):
    rows = [(1, "ab b"), (2, "AB  b "), (3, None), (4, ""), (5, "a b c d e"), (6, "zz"), (7, "ab b"), (8, "nan")]
    texts = spark.createDataFrame(rows, "id int, text string")
    log = str(tmp_path)

    def model(batch):
        with open(f"{log}/asked", "a") as f:
            f.write("".join(t + "\n" for t in batch))
        return [[1.0] if t == "zz" else [float("nan"), 1.0] if t == "nan" else [float(t.count("a")), float(t.count("b"))] for t in batch]

    got = {r.id: (r.vector, r.fault) for r in embedded(texts, model, 2, fold=True, most_tokens=4, batch=2).collect()}
    assert [got[i][1] for i in range(1, 9)] == [None, None, "no_text", "bad_vector", "too_long", "bad_vector", None, "bad_vector"]
    assert got[1][0] == got[2][0] == got[7][0] == pytest.approx([1 / math.sqrt(5), 2 / math.sqrt(5)])
    assert sorted(open(f"{log}/asked").read().split("\n")) == sorted(["", "", "ab b", "nan", "zz"])  # equal texts once, long ones never
    assert embedded(texts.limit(0), model, 2).count() == 0
    with pytest.raises(Exception, match="another number of vectors"):
        embedded(texts, lambda batch: [], 2).collect()


def test_strategy_choice(spark):
    data = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.when(F.col("vec_id") % 10 == 0, "few").otherwise("many").alias("scope"))
    asked = data.where("chunk_id % 25 < 2").withColumnRenamed("chunk_id", "query_id").unionByName(data.limit(1).select(F.lit(-1).cast("long").alias("query_id"), "vector", F.lit("none").alias("scope")))
    plan = {r.query_id: (r.candidates, r.exact) for r in R.strategies(data, asked, ["scope"]).collect()}
    assert plan[0] == (50, True) and plan[1] == (450, False) and plan[-1] == (0, True)
    assert {r.exact for r in R.strategies(data, asked, ["scope"], exact=False).collect()} == {False}
    got = [(r.query_id, r.chunk_id) for r in R.nearest(data, asked, 5, ["scope"]).collect()]
    want = {(r.query_id, r.chunk_id) for r in R.nearest(data, asked, 5, ["scope"], exact=True).collect()}
    assert len(got) == len(set(got)) == len(want) == 5 * (len(plan) - 1)
    scope = {r.chunk_id: r.scope for r in data.collect()}
    assert all(scope[q] == scope[c] for q, c in got)
    assert len(want & set(got)) >= 0.9 * len(want)


def test_tools_and_manifest(spark):
    calls = spark.createDataFrame([("search_manual", " tray "), ("find_error_code", "E4"), ("search_manual", " "), ("find_error_code", None), ("open_manual_page", "x")], "tool string, value string")
    assert [r[0] for r in calls.select(R.tool_query(F.col("tool"), F.col("value"))).collect()] == ["tray", "error code E4", None, None, None]
    images = spark.createDataFrame([("a", "valid", 2, bytearray(b"x")), ("b", "reject", 3, bytearray(b"y")), ("c", None, None, None), ("d", "reject", None, None)], "asset_id string, classification string, n_occurrences int, content binary")
    kept, rejected = A.manifest(images)
    assert sorted(r.asset_id for r in kept.collect()) == ["a", "c"] and "content" not in kept.columns
    assert sorted((r.asset_id, r.occurrence_count) for r in rejected.collect()) == [("b", 3), ("d", 0)]
