"""Links of assets to chunks."""

from pagewright.operators import assets as A


def test_links_are_told_apart_once(spark):
    shown = spark.createDataFrame([("a", 1, 1), ("a", 1, 1), ("a", 2, 1), ("b", 1, 2)], "asset_id string, document_id int, page int")
    chunks = spark.createDataFrame([(10, 1, [1, 2, 1]), (11, 2, [1]), (12, None, [1])], "chunk_id int, document_id int, pages array<int>")
    got = A.chunk_links(shown, chunks)
    assert sorted(map(tuple, got.collect())) == [("a", 10, 1), ("a", 11, 1), ("b", 10, 2)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2  # none over the links
    shared = chunks.unionByName(spark.createDataFrame([(10, 2, [1])], chunks.schema))
    assert sorted(map(tuple, A.chunk_links(shown, shared).collect())) == [("a", 10, 1), ("a", 11, 1), ("b", 10, 2)]
