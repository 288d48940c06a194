import pytest
from pyspark.sql import functions as F

from pagewright.functions.text import tokens
from pagewright.operators import retrieval as R


def chunks(spark):
    return spark.createDataFrame([("a", "Error E42 means the tray is open.", "E42"), ("b", "Connect the cable.", None), ("c", "", None)], "chunk_id string, body string, normalized_value string")


def test_bm25_and_exact(spark):
    q = spark.createDataFrame([(1, "error E-42 Wi-Fi tray"), (2, "nothing")], "query_id int, text string").withColumn("terms", tokens(F.col("text")))
    hits = R.bm25(chunks(spark), q, 5).collect()
    assert [(h.query_id, h.chunk_id, h["rank"]) for h in hits] == [(1, "a", 1)]
    exact = R.exact_hits(chunks(spark), q)
    assert [(h.query_id, h.chunk_id, h.score) for h in exact.collect()] == [(1, "a", 1.0)]
    assert [r.abstained for r in R.abstentions(q, R.bm25(chunks(spark), q, 5)).orderBy("query_id").collect()] == [False, True]


def test_rewriting(spark):
    q = spark.createDataFrame([("Example 1 recommended tools", "Example 1"), ("it will not print", ""), ("which topic is it", ""), ("the paper topic", None)], "q string, identity string")
    got = [r[0] for r in q.select(R.rewritten(F.col("q"), F.col("identity"))).collect()]
    assert got[0] == ["recommended", "tools"] and got[1][-2:] == ["problem", "solve"] and got[2] == ["topic", "topics"] and got[3] == ["the", "paper", "topic"]


def test_fusion_and_diversity(spark):
    d = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, chunk_id string, rank int")
    x = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id int, chunk_id string, rank int")
    hits = R.fuse(d, x, 3)
    assert [h.chunk_id for h in hits.orderBy("rank").collect()] == ["y", "z", "x"]
    grouped = hits.withColumn("g", F.when(F.col("chunk_id") == "x", "h").otherwise("g"))
    assert [h.chunk_id for h in R.diversify(grouped, "g", 3).orderBy("rank").collect()] == ["y", "x", "z"]
    with pytest.raises(ValueError):
        R.fuse(d, x, 0)


def test_recall(spark):
    hits = spark.createDataFrame([(1, "answer", 1), (1, "other", 2)], "query_id int, chunk_id string, rank int")
    labels = spark.createDataFrame([(1, "answer"), (2, "gone")], "query_id int, chunk_id string")
    assert sorted((r.query_id, r.recall, r.reciprocal_rank) for r in R.recall_and_rank(hits, labels).collect()) == [(1, 1.0, 1.0), (2, 0.0, 0.0)]


def test_dense_in_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.integers(-3, 4, (90, 5)).astype(float)
    x[40:60] = x[7]
    v = spark.createDataFrame([(i, r.tolist(), i % 2) for i, r in enumerate(x)] + [(90, None, 0), (91, [1.0], 1), (92, [0.0] * 5, 0)], "chunk_id long, vector array<double>, label int")
    q = v.where("chunk_id < 70").select(F.col("chunk_id").alias("query_id"), "vector", "label")
    monkeypatch.setattr(R, "QUERY_BLOCK", 9)
    monkeypatch.setattr(R, "VECTOR_CHUNK", 20)

    def want(i, match, least):
        n = np.linalg.norm(x, axis=1)
        s = [(round(float(x[i] @ x[j] / (n[i] * n[j])), 6), j) for j in range(90) if n[i] > 0 and n[j] > 0 and (not match or i % 2 == j % 2)]
        return [(i, j, r + 1) for r, (a, j) in enumerate(sorted((p for p in s if least is None or p[0] >= least), key=lambda p: (-p[0], p[1]))[:4])]

    for match, least in ((None, None), (["label"], 0.3)):
        got = R.dense(v if match else v.drop("label"), q, 4, match=match, least=least).collect()
        assert sorted((r.query_id, r.chunk_id, r["rank"]) for r in got) == sorted(w for i in range(70) for w in want(i, match, least))


def test_recall_of_the_compressed_index(spark):
    """At least 0.9 of the exact neighbours of the whole query set, and ten rows a query."""
    from pagewright.plans import search_queries as Q

    data = "/root/testdata/sf0.001"
    exact = {(r.query_id, r.chunk_id) for r in Q.dense_topk(spark, data).collect()}
    found = [(r.query_id, r.chunk_id) for r in Q.dense_topk_approximate(spark, data).collect()]
    assert len(found) == len(exact) == 10 * len({q for q, _ in exact}) and {q for q, _ in exact} == set(range(0, 500, 20))
    assert len(exact & set(found)) >= 0.9 * len(exact)


def test_approximate_search_in_scopes(spark):
    import random

    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]), [rng.gauss(0, 1) for _ in range(7)]) for i in range(300)] + [(300, "rare", [1.0] * 7), (301, "a", [0.0] * 7)]
    v = spark.createDataFrame(rows, "chunk_id int, label string, vector array<double>")
    q = v.where("chunk_id % 10 = 0").withColumnRenamed("chunk_id", "query_id")
    # all cells and all vectors: exact; a scope of one vector gives one row, null scopes and null vectors none
    got = R.approximate(v, q, 5, ["label"], cells=8, probes=8, most=300).select("query_id", "chunk_id", "rank").collect()
    exact = R.dense(v, q, 5, ["label"]).select("query_id", "chunk_id", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, exact)) and sum(r.query_id == 300 for r in got) == 1
    few = R.approximate(v, q, 5, ["label"], cells=8, probes=4)
    assert few.count() == len(exact)
    assert R.approximate(v.limit(0), q, 5).count() == 0 and R.approximate(v, q.limit(0), 5).count() == 0


def test_passages_are_found_by_anchors(spark):
    texts = [(1, "the red foxes jump over a-lazy dog today"), (2, "Red fox jump over a-lazy dog"), (3, None), (4, "jump over"), (5, "red foxes jump over a lazy dog")]
    asked = [(10, "ed foxes jump over a-lazy do"), (11, "jump over"), (12, None), (13, "zz"), (14, "over a-lazy dog")]
    chunks, passages = spark.createDataFrame(texts, "chunk_id int, text string"), spark.createDataFrame(asked, "query_id int, passage string")
    want = sorted((q, c) for q, p in asked for c, t in texts if p and t and p in t)
    assert sorted(tuple(r) for r in R.holding(chunks, passages).collect()) == want and len(want) > 5
    assert R.holding(chunks, passages.where("query_id = 10")).count() == 1 and R.holding(chunks.limit(0), passages).count() == 0


def test_passages_are_found_in_the_rows_of_texts(spark):
    """Nothing is shuffled for passages of at least 16 bytes; places, copies and ends of texts are told apart."""
    rows = [(1, "ab " * 9 + "long passage with ünï end"), (2, ""), (3, None), (4, "long passage with ünï en"), (5, "x" + "long passage with ünï end" * 3), (6, " " * 40), (7, "d")]
    asked = [("a", "long passage with ünï end"), ("b", "long passage with ünï en"), ("c", " " * 20), ("d", " " * 41), ("e", "long passage wit"), ("f", "ab ab ab ab ab ab ab "), ("g", None), ("a2", "long passage with ünï end")]
    chunks, passages = spark.createDataFrame(rows, "chunk_id int, text string").coalesce(1), spark.createDataFrame(asked, "query_id string, passage string")
    found = R.holding(chunks, passages)
    want = sorted((q, c) for q, p in asked for c, t in rows if p and t and p in t)
    assert sorted(tuple(r) for r in found.collect()) == want and len(want) > 9
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in R.joined_holding(chunks, passages).collect()) == want


def test_filters_need_a_field(spark):
    from pagewright.sources import tables as X

    chunks = spark.createDataFrame([(1, "a", "m"), (2, "a", None), (3, None, "m")], "chunk_id int, manufacturer string, model string")
    filters = spark.createDataFrame([("x", "a", None), ("y", "a", "m"), ("z", None, "q")], "f string, manufacturer string, model string")
    assert sorted(tuple(r) for r in X.matching(filters, chunks, ["manufacturer", "model"]).collect()) == [("x", 1), ("x", 2), ("y", 1)]
    with pytest.raises(ValueError):
        X.matching(filters.where("f = 'x'").withColumn("manufacturer", F.lit(None).cast("string")), chunks, ["manufacturer", "model"])


def test_looked_up_in_parts(spark, monkeypatch):
    """Keys beyond what is broadcast at once are looked up in parts, and the rows are not shuffled."""
    rows = spark.range(500).select(F.col("id").cast("string").alias("chunk_id"), "id")
    asked = spark.createDataFrame([(str(i),) for i in [*range(0, 300, 3), 3, 6, 900]], "chunk_id string")
    monkeypatch.setattr(R, "BROADCAST_ROWS", 20)
    for most in (16, 2):
        monkeypatch.setattr(R, "MOST_PARTS", most)
        found = R.looked_up(rows, asked, "chunk_id")
        assert sorted(r.id for r in found.collect()) == list(range(0, 300, 3))
        assert most == 2 or "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_citations_sort_no_chunks(spark, monkeypatch):
    """What is cited needs no ordinals: no table of chunks that is looked up has any."""
    from pagewright.plans import session_queries as Q

    seen, look = [], Q.looked_up
    monkeypatch.setattr(Q, "looked_up", lambda rows, *a: seen.append(rows) or look(rows, *a))
    Q._evidence(spark, "/root/testdata/sf0.001")
    assert len(seen) == 2 and all("Window" not in x._jdf.queryExecution().optimizedPlan().toString() for x in seen)


def test_route_makes_no_table_of_chunks(spark, monkeypatch):
    """The exact route reads the identifiers alone, from lines that are kept, and the other route reads the chunks once."""
    from pagewright.plans import chunk_queries as C, session_queries as Q
    from pagewright.runtime import held

    data = "/root/testdata/sf0.001"
    monkeypatch.setattr(C, "every_chunk", None)
    assert Q.exact_identifier_route(spark, data).count() > 2
    with held(C._lines(spark, data)) as line:
        plan = R.exact_hits(C.strategies(line), Q._part_queries(spark, data), 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") == 1


def test_evidence_is_dealt_by_query_once(spark):
    """Contexts and citations are made where a query's evidence was put together."""
    from pagewright.operators import evidence as E

    spot = "array<struct<source_file:string,page:int,section:string,content:string,line_start:bigint,line_end:bigint>>"
    chunks = spark.createDataFrame([("own", "own text", [4], "d1", [("f", 4, "S", "x", 0, 0)])], f"chunk_id string, content string, pages array<int>, document_id string, evidence {spot}")
    documents = spark.createDataFrame([("d1", "T1", "M1", "m", "1", "u1")], "document_id string, title string, manufacturer string, model string, version string, source_url string")
    hits = spark.createDataFrame([("q", 1, "own"), ("q", 2, "own"), ("r", 1, "own")], "query_id string, rank int, chunk_id string")
    found = E.assembled(hits, chunks, documents)
    for out, rows in ((E.contexts(found), 2), (E.citations(found), 2)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning(query_id") == 1 and out.count() == rows
