import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.functions.text import acknowledgement, broad_failure
from pagewright.operators import assets as A
from pagewright.operators import sessions as S
from pagewright.sources import store, tables as X
from pagewright.streaming import sessions as Z


def test_acknowledgement(spark):
    said = {"Got it": True, "The light blinks amber": False, "ok, what next?": True, "yes the light is red": False, "next": False, "I checked it.": True, "Thank you!": True, "": False, "got it " + "and more " * 6: False}
    rows = spark.createDataFrame([(k,) for k in said] + [(None,)], "t string")
    assert {r.t: r.a for r in rows.select("t", acknowledgement(F.col("t")).alias("a")).collect()} == said | {None: None}
    assert spark.sql("SELECT 'print fails' AS q").select(broad_failure(F.col("q"))).first()[0]


def test_fact_history(spark):
    e = spark.createDataFrame([("s", 1, "light", "amber", "t1", "light"), ("s", 2, "light", "white", "t2", None)], "session string, seq int, key string, value string, turn_id string, recheck_of string")
    last = S.fact_history(e).orderBy("seq").collect()[1]
    assert (last.previous_value, last.observed_after) == ("amber", "t1:action")
    assert S.latest_facts(e).first().value == "white"


def test_turn_contract(spark):
    raw = spark.createDataFrame([('```json\n{"mode":"solve","facts":[{"key":"a"},{"key":"a"}],"source_ids":["x"]}\n```', ["y"]), ("no json", ["y"])], "json string, evidence_ids array<string>")
    got = [r.violations for r in S.parsed_turns(raw).collect()]
    assert got[0] == ["unknown_source", "fact_twice"] and got[1][0] == "unreadable"


def test_collapse(spark):
    q = spark.createDataFrame([(1, "A  b", 0.0), (2, "a b", 899.0), (3, "a b", 900.0), (4, "c", 1.0)], "query_id long, text string, at double")
    assert {r.query_id: r.reused for r in S.collapse_repeats(q, 900.0, []).collect()} == {1: False, 2: True, 3: False, 4: False}


def test_streams(spark, tmp_path):
    rows = [(1, 1, "k", "a", False), (1, 2, "k", "b", False), (2, 1, "k", "a", False)]
    spark.createDataFrame(rows, "session long, seq long, key string, value string, deleted boolean").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session long, seq long, key string, value string, deleted boolean").parquet(str(tmp_path / "in"))
    out = Z.collected(spark, Z.fact_history_stream(stream), str(tmp_path / "c"), str(tmp_path / "o"))
    assert sorted((r.session, r.seq, r.previous_value) for r in out.collect()) == [(1, 1, None), (1, 2, "a"), (2, 1, None)]
    plain = stream.select("session", "seq", "value")
    Z.upsert_each_batch(plain, str(tmp_path / "t"), "session", "seq", str(tmp_path / "c2")).awaitTermination()
    assert sorted((r.session, r.value) for r in store.read(spark, str(tmp_path / "t"), plain.schema).collect()) == [(1, "b"), (2, "a")]


def test_keyed_store(spark, tmp_path):
    path, kind = str(tmp_path / "s"), "k long, seq long, v string, gone boolean"
    rows = lambda *x: spark.createDataFrame(list(x), kind)
    held = lambda epoch=None: sorted((r.k, r.v) for r in store.read(spark, path, rows().schema, epoch, "gone").collect())
    assert held() == []
    assert len(store.merge(spark.range(500).selectExpr("id AS k", "0L AS seq", "'a' AS v", "false AS gone"), 0, path, "k", "seq", 16)) == 16
    before = store.folders(spark, path)
    touched = store.merge(rows((7, 1, "b", False), (7, 2, "c", False), (8, 1, "x", True), (900, 0, "n", False), (9, -1, "late", False)), 1, path, "k", "seq", 16)
    after = store.folders(spark, path)
    assert 1 <= len(touched) <= 4 and {b for b in after if after[b] != before.get(b)} == set(touched)  # only these are rewritten
    expected = sorted([(k, "a") for k in range(500) if k not in (7, 8)] + [(7, "c"), (900, "n")])
    assert held() == expected and held(0) == [(k, "a") for k in range(500)]
    assert store.merge(rows((1, 99, "other", False)), 1, path, "k", "seq", 16) == [] and held() == expected  # a replay
    assert len(store.merge(rows((8, 0, "older", False)), 2, path, "k", "seq", 16)) == 1 and held() == expected  # the tombstone stays
    assert store.merge(rows((5, 0, "p", False), (5, 0, "q", False)), 3, path, "k", "seq", 16) and (5, "q") in held()
    assert store.vacuum(spark, path, keep=1) >= 2 and (5, "q") in held() and len(held()) == 500
    with pytest.raises(ValueError):
        store.merge(rows((None, 1, "x", False)), 4, path, "k", "seq", 16)


def test_sources(spark, tmp_path):
    (tmp_path / "printers").mkdir()
    (tmp_path / "printers" / "x.pdf").write_bytes(b"data")
    (row,) = X.binary_documents(spark, str(tmp_path)).collect()
    assert row.document_id == "printers-x" and row.version == "sha256:" + row.sha256
    entries = spark.createDataFrame([("printers/x.pdf", "T")], "relative_path string, title string")
    assert X.resolved_sources(entries, X.binary_documents(spark, str(tmp_path))).count() == 1
    with pytest.raises(ValueError):
        X.resolved_sources(entries.limit(0), X.binary_documents(spark, str(tmp_path)))
    with pytest.raises(ValueError):
        X.scoped_delete(entries)
    assert isinstance(dt.datetime.fromisoformat(row.retrieved_at.replace("Z", "+00:00")), dt.datetime)


def test_pixels(spark):
    width = height = 100
    px = bytearray()
    for r in range(height):
        for c in range(width):
            v = 0 if 10 < r < 90 and 10 < c < 90 and (r // 8 + c // 8) % 2 else 255
            px += bytes((v, v, v))
    rows = spark.createDataFrame([("a", height, width, 3, bytes(px)), ("n", None, None, None, None)], "asset_id string, height int, width int, nChannels int, data binary")
    got = {r.asset_id: r for r in A.pixel_features(rows).collect()}
    # neighbours that differ by more than 20, as the mean of the shares of both axes
    dark = lambda r, c: px[(r * width + c) * 3]
    across = sum(dark(r, c) != dark(r, c + 1) for r in range(100) for c in range(99)) / 9900
    down = sum(dark(r, c) != dark(r + 1, c) for r in range(99) for c in range(100)) / 9900
    expected = (across + down) / 2
    assert got["a"].entropy > 0.5 and got["a"].edge_density == pytest.approx(expected) and got["n"].entropy is None


def test_pixel_helpers():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 256, (64, 64)).astype(float)
    assert np.array_equal(A._shrunk(x, 64, 64), x) and np.array_equal(A._shrunk(np.full((300, 7), 9.0), 8, 9), np.full((8, 9), 9.0))
    ramp = A._shrunk(np.repeat(np.arange(0, 256, 2.0)[None], 5, 0), 5, 16)
    assert (np.diff(ramp, axis=1) > 10).all()
    for _ in range(30):
        grid = rng.random((12, 9)) < 0.3
        seen, count = set(), 0
        for cell in zip(*np.nonzero(grid), strict=True):
            if cell in seen:
                continue
            count, todo = count + 1, [cell]
            while todo:
                r, c = todo.pop()
                if (r, c) in seen or not (0 <= r < 12 and 0 <= c < 9) or not grid[r, c]:
                    continue
                seen.add((r, c))
                todo += [(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        assert A._components(grid) == count
    assert A._edges(np.array([[0.0, 30.0], [0.0, 0.0]])) == 0.5 and A._edges(np.zeros((1, 1))) == 0.0


def test_undecodable_images_are_no_twins(spark):
    rows = [(i, h, 300, 300, 1, 0, "valid", ["x"]) for i, h in enumerate(["a", "a", None, None, "b"])]
    df = spark.createDataFrame(rows, "asset_id long, perceptual_hash string, width int, height int, n_occurrences int, quality_score int, classification string, reasons array<string>")
    assert {r.asset_id: r.duplicate_of for r in A.demote(df).collect()} == {0: None, 1: 0, 2: None, 3: None, 4: None}


def test_page_documents(spark, tmp_path):
    for name in ("printer", "scanner", "parse_report"):
        page = {"page_number": 1, "text": name, "parser": "native", "confidence": 1.0, "requires_ocr": False}
        (tmp_path / f"{name}.json").write_text(json.dumps({"source_file": name, "pdf_type": "native", "pages": [page, page | {"page_number": 2}]}, indent=1))
    got = X.page_documents(spark, str(tmp_path)).collect()
    assert sorted((r.document_id, r.page_seq, r.page_number) for r in got) == [(n, i, i + 1) for n in ("printer", "scanner") for i in (0, 1)]


def test_policy(spark):
    schema = "session int, turn int, mode string, response string, interpretation string, action string, why string, causes array<string>, asks_key string, recheck boolean, facts array<struct<key:string,value:string>>"
    rows = [
        (1, 1, "clarify", "which light?", None, None, None, ["a"], "light", False, []),
        (1, 2, "advance", "try it", None, "hold power", "because", ["a", "b"], "light", True, [("light", "Amber")]),
        (1, 3, "solve", "It went from amber to white.", None, None, None, None, None, False, [("light", "white")]),
        (2, 1, "advance", None, None, None, None, None, None, False, [("k", "1"), ("k", "2")]),
        (2, 2, "clarify", None, None, "act", None, None, "k", False, []),
        (2, 3, "abstain", None, None, None, None, None, "z", True, []),
    ]
    cases = spark.createDataFrame([(1, True, 0, "solve", 2), (2, True, 1, "solve", 1)], "session int, evidence_sufficient boolean, tool_calls int, expected_mode string, most_turns int")
    turns = spark.createDataFrame(rows, schema)
    found = S.policy_violations(turns, cases)
    assert sorted((r.session, r.turn or 0, r.violation) for r in found.collect()) == [
        (2, 0, "needless_search"), (2, 0, "terminal_mode"), (2, 1, "advance_without_action"), (2, 1, "advance_without_discrimination"), (2, 1, "advance_without_reason"), (2, 1, "changed_without_recheck"),
        (2, 1, "transition_not_acknowledged"), (2, 2, "clarify_with_action"), (2, 2, "clarify_without_basis"), (2, 2, "known_fact_asked_again"), (2, 3, "abstain_goes_on"), (2, 3, "recheck_without_action"),
    ]
    r = S.policy_report(turns, found).first()
    assert (r.sessions, r.pass_rate, r.longest_clarify, r.transitions, r.acknowledged_rate) == (2, 0.5, 1, 2, 0.5)


def test_whole_search_set(spark):
    from pagewright.plans import session_queries as Q

    data = "/root/testdata/sf0.001"
    asked = {r.query_id for r in Q._part_queries(spark, data).collect()}
    part = spark.read.parquet(f"{data}/part.parquet")
    assert asked == {r.p_partkey for r in part.where("p_partkey % 20 = 0").collect()} and len(asked) > 2
    routes = {r.query_id: r.route for r in Q.exact_identifier_route(spark, data).collect()}
    assert {q for q, r in routes.items() if r == "exact"} == {r.query_id for r in Q.exact_identifier_hits(spark, data).collect()}
    assert set(routes) <= asked and len(routes) > 2
    orders = spark.read.parquet(f"{data}/lineitem.parquet")
    assert {r.query_id for r in Q.image_for_hits(spark, data).collect()} <= {r.l_orderkey for r in orders.collect()}


def test_collapse_of_frequent_queries(spark):
    """A frequent query in many ranges is judged as one fold over its times does."""
    import random

    rng = random.Random(6)
    rows = [(i, rng.choice(["hot", "hot  ", "HOT", f"q{i % 7}"]), None if i % 97 == 0 else float(rng.randint(0, 9000))) for i in range(3000)]
    asked = spark.createDataFrame(rows, "query_id long, text string, at double")
    want, starts = {}, {}
    for i, text, at in sorted(rows, key=lambda r: (-1 if r[2] is None else r[2], r[0])):
        start = starts.get(c := text.strip().lower())
        want[i] = start is not None and at < start + 70
        starts[c] = start if want[i] else at
    out = S.collapse_repeats(asked, 70.0, [])
    assert {r.query_id: r.reused for r in out.collect()} == want and out.columns == ["query_id", "text", "at", "canonical", "reused"]
    assert "collect_list" not in out._jdf.queryExecution().toString()  # no query's askings in one row
    assert out.where("lower(trim(text)) = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert S.collapse_repeats(asked.limit(0), 70.0, []).count() == 0


def test_query_stream_is_its_batch_twin(spark, tmp_path):
    """Whole texts and times decide, in one micro-batch and over several."""
    long = "how do i check the "
    rows = [(i, long + ["paper", "toner", "Paper "][i % 3], i * 130.0) for i in range(40)]
    asked = spark.createDataFrame(rows, "query_id long, text string, at double")
    want = {r.query_id for r in S.collapse_repeats(asked, 900.0, []).where("not reused").collect()}
    assert 2 < len(want) < 40
    for name, cuts in (("one", [(0, 40)]), ("three", [(0, 11), (11, 25), (25, 40)])):
        for a, b in cuts:
            part = asked.where(f"query_id >= {a} and query_id < {b}").withColumn("at", F.timestamp_seconds(F.col("at") + 1_700_000_000))
            part.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            stream = spark.readStream.schema(part.schema).parquet(str(tmp_path / name))
            out = Z.collected(spark, Z.first_queries_stream(stream), str(tmp_path / f"c{name}"), str(tmp_path / f"o{name}"))
        assert sorted(r.query_id for r in out.collect()) == sorted(want)


def test_query_stream_keeps_a_row_a_bucket(spark, tmp_path, monkeypatch):
    """Thousands of different texts are judged in few groups; those of one bucket keep their own times."""
    monkeypatch.setattr(Z, "TEXT_BUCKETS", 16, raising=False)
    rows = [(i, None if i == 5 else f"text {i % 900}", float(i) / 10) for i in range(1800)]
    asked = spark.createDataFrame(rows, "query_id long, text string, at double").withColumn("at", F.timestamp_seconds(F.col("at") + 1_700_000_000))
    asked.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(asked.schema).parquet(str(tmp_path / "in"))
    out = Z.collected(spark, Z.first_queries_stream(stream), str(tmp_path / "c"), str(tmp_path / "o"))
    assert sorted(r.query_id for r in out.collect()) == [*range(900), 905]
    assert spark.read.format("statestore").load(str(tmp_path / "c")).count() <= 16
