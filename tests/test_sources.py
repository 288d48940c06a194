"""Scans, sinks, gates and recognised pages against values worked out by hand."""

import json

import pytest

from pagewright.operators import evidence as E, sessions as S
from pagewright.sources import tables as X


def chunk(**more):
    return {"chunk_id": "c", "document_id": "d", "ordinal": 1, "content": "x", "retrieval_profiles": ["bm25"]} | more


def test_chunk_lines_are_filtered_ordered_and_checked(spark, tmp_path):
    for folder, rows in {"a": [chunk(chunk_id="2", ordinal=2), chunk(chunk_id="1", ordinal=1, retrieval_profiles=["exact"])], "b": [chunk(chunk_id="3", document_id="e")]}.items():
        (tmp_path / "chunks" / folder).mkdir(parents=True)
        (tmp_path / "chunks" / folder / "f.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    path = str(tmp_path / "chunks" / "*")
    ids = lambda **how: [r.chunk_id for r in X.chunk_lines(spark, path, **how).collect()]
    assert ids(limit=2) == ["1", "2"] and sorted(ids()) == ["1", "2", "3"]
    assert ids(profile="exact") == ["1"] and ids(document_id="e") == ["3"] and sorted(ids(category="a")) == ["1", "2"]
    (tmp_path / "chunks" / "b" / "g.jsonl").write_text(json.dumps(chunk()) + "\n\nnot a chunk\nnor this\n")
    with pytest.raises(ValueError, match=r"g\.jsonl:3: not a chunk: not a chunk"):
        X.chunk_lines(spark, path)


def case(**more):
    return {"case_id": "1", "query": "q", "question_type": "procedure", "expected_chunk_ids": ["a"], "should_abstain": False} | more


def test_evaluation_cases(spark, tmp_path):
    kind = sorted(X.QUESTION_TYPES)[0] if "procedure" not in X.QUESTION_TYPES else "procedure"

    def read(*rows):
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.jsonl"
        path.write_text("".join(json.dumps({"question_type": kind} | r) + "\n" for r in rows))
        return X.evaluation_cases(spark, str(path))

    good = case(question_type=kind)
    (r,) = read(good).collect()
    assert r.acceptable_chunk_ids == ["a"]  # the expected ones
    for bad in ([], [good, good], [good | {"question_type": "riddle"}], [good | {"should_abstain": True}], [good | {"acceptable_chunk_ids": ["b"]}], [good | {"question_type": "unanswerable"}]):
        with pytest.raises(ValueError):
            read(*bad).collect()


def test_pages_of_recognised_items(spark):
    items = spark.createDataFrame([("d", 1, 2, "b", 0.5), ("d", 1, 1, "a", 1.0), ("d", 1, 3, " ", 0.0), ("d", 2, 1, " ", 0.9), ("d", 3, 1, "c", 0.9)], "document_id string, page int, place int, text string, confidence double")
    pages = X.ocr_pages(items)
    assert sorted(tuple(r) for r in pages.collect()) == [("d", 1, "a\nb", 0.75, 2), ("d", 2, "", 0.0, 0), ("d", 3, "c", 0.9, 1)]
    again = spark.createDataFrame([("d", 1, "better", 0.8, 1), ("d", 2, "", 0.0, 0), ("d", 3, "unasked", 1.0, 1)], "document_id string, page int, text string, confidence double, items long")
    assert sorted((r.page, r.text, r.fallback_from) for r in X.with_fallback(pages, again, "m").collect()) == [(1, "better", "m"), (2, "", None), (3, "c", None)]


def test_strided_sample(spark):
    pages = spark.createDataFrame([("d", p) for p in range(10, 17)] + [("e", 1)], "document_id string, page int")
    wanted = spark.createDataFrame([("d", 3), ("e", 4), ("f", 1)], "document_id string, count int")
    # seven pages, three asked for: every second one, the first three of them
    assert sorted(tuple(r) for r in X.strided_sample(pages, wanted).collect()) == [("d", 10), ("d", 12), ("d", 14), ("e", 1)]


def test_category_of_a_payload(spark):
    paths = ["data/raw/printers/hp/x.pdf", "x.pdf", "raw/y.pdf", "data/raw/z.pdf"]
    doc = ("d", "t", "m", "o", "v", "u")
    rows = spark.createDataFrame([(str(i), "c", doc, p, {}) for i, p in enumerate(paths)], "chunk_id string, content string, document struct<document_id:string,title:string,manufacturer:string,model:string,version:string,source_url:string>, source_file string, metadata map<string,string>")
    assert [r.category for r in X.payload(rows).orderBy("chunk_id").collect()] == ["printers", "unknown", "unknown", "z.pdf"]


def test_missing_observations(spark):
    rows = spark.createDataFrame([("p", "m", "o"), ("p", "", None), ("the printer will not print", "m", "o"), ("it cannot print", None, "o")], "query string, manufacturer string, model string")
    got = [(r.missing, r.question) for r in E.missing_observations(rows, detail=True).collect()]
    assert got[0] == ([], None) and got[1] == (["manufacturer", "model"], "Which manufacturer and model are you working with?")
    assert got[2][0] == [E.DETAIL] and got[2][1].startswith("What exactly appears") and got[3] == (["manufacturer", E.DETAIL], E.NO_QUESTION)


def test_a_hot_query_tells_the_driver_little(spark):
    """Times of one query a second apart: reused but for each 900th, whatever the ranges."""
    asked = spark.range(20_000).selectExpr("id AS query_id", "'same' AS text", "CAST(id AS DOUBLE) AS at")
    got = S.collapse_repeats(asked, 900.0, [])
    assert got.where("reused = (query_id % 900 = 0)").count() == 0
