from pagewright.operators import cleaning as C


def clean(spark, *texts):
    pages = spark.createDataFrame([("d", i, i + 1, t) for i, t in enumerate(texts)], "document_id string, page_seq int, page_number int, text string")
    return [r.asDict(recursive=True) for r in C.cleaned_pages(pages).orderBy("page_seq").collect()]


def reasons(page):
    return [r["reason"] for r in page["removed_fragments"]]


def test_page_numbers_and_repeated_heading(spark):
    out = clean(spark, *[f"## Contents list\nbody {i} ends.\nWARNING: hot.\n{i + 1}" for i in range(3)])
    assert [reasons(p) for p in out] == [["page_number"], ["repeated_page_boundary", "page_number"], ["repeated_page_boundary", "page_number"]]
    assert all("WARNING: hot." in p["text"] for p in out)


def test_leaders_tags_and_links(spark):
    (p,) = clean(spark, "Safety precautions......7\n<u>Reset</u> **[Support**](https://x.test**)\n____ gap")
    assert p["text"].split("\n")[0].startswith("Safety precautions 7")
    assert "<u>" not in p["text"] and "**[Support](https://x.test)**" in p["text"]
    assert (p["dot_leaders"], p["underscore_leaders"], p["html_format_tags"], p["markdown_repairs"]) == (1, 1, 2, 1)


def test_contents_and_duplicates(spark):
    out = clean(spark, "# Contents\nIntro 1\nSetup 2", "Same text here.", "Same text here.", "   ")
    assert [p["exclusion_reason"] for p in out] == ["table_of_contents", None, "duplicate_page", "empty_page"]
    assert out[2]["removed_fragments"][-1]["text"] == "Duplicate of page 2"


def test_wrapped_lines(spark):
    (p,) = clean(spark, "The cable goes\ninto the sock-\net. Then\n- item\n\n\nEnd")
    assert p["text"] == "The cable goes into the socket. Then\n- item\n\nEnd"


def test_artifacts(spark):
    (p,) = clean(spark, "Text one.\n.\n--------------\n• bullet")
    assert reasons(p) == ["standalone_artifact", "layout_rule"] and "• bullet" in p["text"]


def test_empty_table(spark):
    assert clean(spark) == []


def test_lines_stay_in_their_pages(spark):
    """First occurrences, copies of a boundary line inside a page and lines of other manuals; no window carries lines."""
    pages = [("d", i, f"Guide\nbody {i} one.\nbody {i} two.\nGuide\nbody {i} three.\nmid\nmore {i}.\nend {i}.\nENWW") for i in range(4)] + [("e", 1, "Guide\nonly."), ("e", 2, None)]
    df = spark.createDataFrame([(d, i, i + 1, t) for d, i, t in pages], "document_id string, page_seq int, page_number int, text string")
    gone = sorted((r.document_id, r.page_seq, r.line_index, r.line) for r in C.audit(df).where("reason = 'repeated_page_boundary'").collect())
    assert gone == sorted([("d", i, j, "Guide") for i in range(4) for j in (0, 3) if (i, j) != (0, 0)] + [("d", i, 8, "ENWW") for i in range(4)])
    plan = C.cleaned_pages(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
