"""Packing and chunks against values worked out by hand."""

import random

from pyspark.sql import functions as F

from pagewright.operators import chunking as K, evidence as E, structure as S
from pagewright.operators.packing import packed


def lines(spark, *texts):
    pages = spark.createDataFrame([("d", "d.pdf", i, i + 1, t) for i, t in enumerate(texts)], "document_id string, source_file string, page_seq int, page_number int, text string")
    return S.structured_lines(pages)


def test_packing_follows_the_rule(spark):
    rng = random.Random(1)
    most = {None: 60, 1: 100, 2: 60, 3: 1}
    rows = [(k, i, rng.choice([0, 1, 5, 30, 99, 120]), m) for k, m in most.items() for i in range(150)]
    for times in (None, 4):
        expected, used, held, part = {}, 0, 0, {}
        for k, i, size, m in rows:
            if k not in part or used + size > m or (times and held >= times):
                part[k] = part.get(k, -1) + 1
                used = held = 0
            used, held = used + size, held + 1
            expected[k, i] = part[k]
        df = spark.createDataFrame(rows, "k int, i int, s int, m int").repartition(3)
        assert {(r.k, r.i): r.part for r in packed(df, ["k"], ["i"], F.col("s"), F.col("m"), times).collect()} == expected
    assert packed(df.limit(0), ["k"], ["i"], F.col("s"), 5).count() == 0


def test_packing_of_a_long_key_over_many_batches(spark):
    n = 100_000  # 22 units of 100 characters and one more each fit in 2300
    df = spark.range(n).select(F.lit("s").alias("k"), F.col("id").alias("i"))
    got = packed(df, ["k"], ["i"], F.lit(101), 2300)
    assert got.where(F.col("part") != F.floor(F.col("i") / 22)).count() == 0


def test_pieces_of_a_long_text(spark):
    def cut(text, most):
        return spark.range(1).select(K.pieces(F.lit(text), most)).first()[0]

    # a piece's words and one character more each make 8 at most: "aa bb" is 6, with "cc" it would be 9
    assert cut("aa bb cc\n dd  e", 8) == ["aa bb", "cc dd e"]
    assert cut("a " + "x" * 20 + " b c", 8) == ["a", "x" * 20, "b c"]
    assert cut("x" * 8 + " " + "y" * 7, 8) == ["x" * 8, "y" * 7]


def test_each_chunk_has_the_pages_of_its_own_lines(spark):
    first = "# S\n" + "\n".join("a" * 99 for _ in range(20))  # with the heading 4 + 2000 characters
    rows = K.section_chunks(lines(spark, first, "1. " + "b" * 1000)).orderBy("part").collect()
    assert [(r.pages, r.page) for r in rows] == [([1], 1), ([2], 2)]
    assert rows[0].content == "# S\n\n" + "\n".join(["a" * 99] * 20) and rows[1].content == "1. " + "b" * 1000
    # equal lines of a page are one evidence, the first
    assert [(e.source_file, e.page, e.section, e.content, e.line_start, e.line_end) for e in rows[0].evidence] == [("d.pdf", 1, "S", "# S", 0, 0), ("d.pdf", 1, "S", "a" * 99, 1, 1)]
    assert [(e.page, e.line_start) for e in rows[1].evidence] == [(2, 0)]


def test_the_pieces_of_a_long_unit_stand_alone(spark):
    long = " ".join(["word"] * 600)  # 5 characters each: 480 words are 2400
    rows = K.section_chunks(lines(spark, f"# S\n{long}\n1. A short step after.")).orderBy("part").collect()
    assert [r.content for r in rows] == ["# S", " ".join(["word"] * 480), " ".join(["word"] * 120), "1. A short step after."]
    assert [[e.content for e in r.evidence] for r in rows[1:3]] == [[rows[1].content], [rows[2].content]]
    assert [e.line_start for r in rows for e in r.evidence] == [0, 1, 1, 2]


def test_children_repeat_the_end_of_the_one_before(spark):
    # runs of two block types by turns, 301 characters each with the one counted: a child (1160) takes three
    body = "\n".join(("NOTICE " if i % 2 else "plain ") + chr(97 + i) * (293 if i % 2 else 294) for i in range(6)) + "\nNOTICE tail\nplain tail"
    rows = K.parent_child_chunks(lines(spark, "# S\n" + body)).orderBy("part", "kind").collect()
    parent, = [r for r in rows if r.kind == "parent"]
    children = [r for r in rows if r.kind == "child"]
    assert all(c.parent_chunk_id == parent.chunk_id for c in children)
    # "# S" (4) and three runs are 907; then three runs (903) and the two tails (12 + 11) are 926
    assert [c.overlap_before for c in children] == [0, 0]
    assert [len(c.evidence) for c in children] == [4, 5]
    short = "\n".join(("NOTICE " if i % 2 else "plain ") + chr(97 + i) * (93 if i % 2 else 94) for i in range(24))
    rows = K.parent_child_chunks(lines(spark, "# S\n" + short)).orderBy("part", "kind").collect()
    children = [r for r in rows if r.kind == "child"]
    # runs of 101: "# S" and eleven are 1115, then eleven (1111) and two; two runs (202) of the one before are repeated
    assert [c.overlap_before for c in children] == [0, 202, 202]
    assert [len(c.evidence) for c in children] == [12, 13, 4]
    assert children[1].evidence[0].line_start == 10


def test_step_groups_are_split_and_framed(spark):
    text = "# Reset\nBefore you begin, unplug.\n1. Hold.\nCaution: hot.\n2. " + "w " * 1000 + "\n3. Wait."
    rows = K.procedure_chunks(S.procedures(lines(spark, text, "4. Release.\n5. Done.\n6. End."))).orderBy("part").collect()
    frame = "Prerequisite: Before you begin, unplug.\nWarning: Caution: hot.\n"
    assert rows[0].kind == "procedure" and rows[0].pages == [1, 2]
    assert rows[0].content == frame + "1. Hold.\nCaution: hot.\n2. " + ("w " * 1000).strip() + "\n3. Wait.\n4. Release.\n5. Done.\n6. End."
    # the frame takes 39 + 1 + 22 and 1 more, so 1637 characters are left: 818 words of step 2, then 182
    assert [r.content.removeprefix(frame) for r in rows[1:]] == [
        "1. Hold.\nCaution: hot.", "2. " + ("w " * 818).strip(), "2. " + ("w " * 182).strip() + "\n3. Wait.\n4. Release.\n5. Done.", "6. End.",
    ]
    assert [r.pages for r in rows[1:]] == [[1], [1], [1, 2], [1, 2]]
    assert [e.content for e in rows[1].evidence] == ["Before you begin, unplug.", "Caution: hot.", "1. Hold.\nCaution: hot."]
    assert all(r.parent_chunk_id == rows[0].chunk_id for r in rows[1:])


def test_citations_with_and_without_a_payload(spark):
    spot = "array<struct<source_file:string,page:int,section:string,content:string,line_start:bigint,line_end:bigint>>"
    chunks = spark.createDataFrame(
        [("own", "own text", [4, 5], "d1", [("f", 5, "S > T", "x", 0, 0)]), ("up", "parent text", [7], "d2", [("f", 7, "U", "y", 0, 0)]), ("empty", "", [1], "d1", [("f", 1, "E", "z", 0, 0)])],
        f"chunk_id string, content string, pages array<int>, document_id string, evidence {spot}",
    )
    documents = spark.createDataFrame([("d1", "T1", "M1", None, "1", "u1"), ("d2", "T2", "M2", "m2", None, "u2")], "document_id string, title string, manufacturer string, model string, version string, source_url string")
    full = ("D", "Title", "Maker", "Model", "v", 9, "Sec", "url")
    rows = [
        ("q", 1, "own", " said ", None, *full), ("q", 2, "own", "again", None, *full), ("q", 3, "gone", None, "up", *full[:4], "", 9, "Sec", "url"),
        ("q", 4, "lost", "text", None, *full[:7], None), ("q", 5, "empty", "", None, *full), ("r", 1, "own", None, None, None, *full[1:]),
    ]
    hits = spark.createDataFrame(rows, "query_id string, rank int, chunk_id string, text string, parent_chunk_id string, document_id string, document_title string, manufacturer string, model string, document_version string, page int, section string, source_url string")
    got = {(r.query_id, r.rank): (r.content, r.pages, tuple(r.citation)) for r in E.assembled(hits, chunks, documents).collect()}
    assert got == {
        ("q", 1): ("said", [4, 5], full), ("q", 3): ("parent text", [7], ("d2", "T2", "M2", "m2", "", 7, "U", "u2")),
        ("r", 1): ("own text", [4, 5], ("d1", "T1", "M1", "", "1", 5, "S > T", "u1")),
    }


def test_groups_over_many_batches(spark):
    """Groups made from rows in batches of any size, and from lists, are those of ``packed``, with rows that stand alone."""
    from pagewright.operators.packing import grouped_lists, grouped_rows

    rng = random.Random(4)
    rows = [(k, i, f"{k}/{i}", rng.choice([1, 5, 30, 99, 120]), rng.random() < 0.1) for k in range(9) for i in range(rng.choice([1, 40, 150]))]
    want, back = {}, {}
    for k, i, t, size, alone in rows:
        groups = want.setdefault(k, [])
        if not groups or alone or groups[-1][-1][2] or sum(x[1] for x in groups[-1]) + size > 100:
            groups.append([])
        groups[-1].append((t, size, alone))
    for k, groups in want.items():
        back[k, 0] = (0, [x[0] for x in groups[0]])
        for n, (one, two) in enumerate(zip(groups, groups[1:]), 1):
            again = [x for j, x in enumerate(one) if sum(y[1] for y in one[j:]) <= 35]
            back[k, n] = (sum(x[1] for x in again), [x[0] for x in again + two])
    want = {(k, n): [x[0] for x in g] for k, groups in want.items() for n, g in enumerate(groups)}
    df = spark.createDataFrame(rows, "k int, i int, t string, size long, alone boolean").repartition(3)
    lists = df.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", "t", "size", "alone"))).alias("units"))
    for batch in ("3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = grouped_rows(df, ["k"], ["i"], ["t"], F.col("size"), F.col("alone"), 100).collect()
            assert {(r.k, r.part): r.t for r in got} == want and len(got) == len(want)
            got = grouped_lists(lists, ["k"], ["t"], F.lit(100), 35).collect()
            assert {(r.k, r.part): (r.over, r.t) for r in got} == back and len(got) == len(back)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert grouped_rows(df.limit(0), ["k"], ["i"], ["t"], F.col("size"), F.col("alone"), 100).count() == 0


def test_chunks_of_held_lines_shuffle_no_texts(spark):
    """Lines that are dealt by document are packed and cut where they are."""
    from pagewright.runtime import held

    with held(lines(spark, "# S\n" + "\n".join(f"{i}. Step {i}\nNotice {i}" for i in range(90))).repartition(3, "document_id")) as line:
        for make in (K.section_chunks, K.parent_child_chunks, lambda x: K.table_row_chunks(S.table_rows(x)), lambda x: K.identifier_chunks(S.identifiers(x))):
            chunks = make(line)
            chunks.count()
            plan = chunks._jdf.queryExecution().executedPlan().toString()
            own = [x for x in plan.split("InMemoryRelation")[0].splitlines() if "Exchange" in x]
            assert not own, own
