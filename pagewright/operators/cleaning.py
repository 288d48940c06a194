"""Cleaning of page texts with an audit trail, at line grain.

``pages`` has document_id, page_seq (order), page_number and text.  A page's lines stay in its row; only
its boundary lines are counted over the document, and windows of pages carry no text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..runtime import cut_to_table
from .retrieval import small

#: A boundary line repeats if on so many pages at least (a tenth of them, within these bounds).
LEAST_PAGES, MOST_PAGES = 3, 20
#: Lines at either end of a page that are its boundary.
EDGE = 3


def lines(pages: DataFrame) -> DataFrame:
    """document_id, page_seq, page_number, line_index, pos, raw, line: one row a line; ``pos`` orders a document."""
    out = pages.select("document_id", "page_seq", "page_number", F.posexplode(T.lines_of(F.col("text"))).alias("line_index", "raw"))
    return out.withColumn("line", T.normalized(F.col("raw"))).withColumn("pos", F.struct("page_seq", "line_index"))


def boundary_marks(all_lines: DataFrame) -> DataFrame:
    """``all_lines`` with ``at_edge``: the text equals one of the page's first or last three non-empty lines."""
    page = Window.partitionBy("document_id", "page_seq")
    some = F.col("line") != ""
    up = F.sum(some.cast("int")).over(page.orderBy("line_index"))
    whole = F.sum(some.cast("int")).over(page)
    edge = some & ((up <= EDGE) | (up > whole - EDGE))
    marked = all_lines.withColumn("_edge", edge)
    same = Window.partitionBy("document_id", "page_seq", "line")
    return marked.withColumn("at_edge", F.max("_edge").over(same) & some).drop("_edge")


def repeated_boundaries(all_lines: DataFrame, pages: DataFrame) -> DataFrame:
    """document_id, line, pages: boundary lines that repeat and may be running titles."""
    edge = boundary_marks(all_lines).where("at_edge")
    count = edge.groupBy("document_id", "line").agg(F.countDistinct("page_seq").alias("pages"))
    n = pages.groupBy("document_id").agg(F.count("*").alias("n"))
    enough = F.greatest(F.lit(LEAST_PAGES), F.least(F.lit(MOST_PAGES), F.ceil(F.col("n") / 10)))
    return count.join(n, "document_id").where((F.col("pages") >= enough) & T.boundary_candidate(F.col("line"))).select("document_id", "line", "pages")


def _page_lines(pages: DataFrame) -> DataFrame:
    """document_id, page_seq, page_number, _row (of the page), raws, lines: each page with its lines, normalised once."""
    x = pages.select("document_id", "page_seq", "page_number", T.lines_of(F.col("text")).alias("raws"))
    return cut_to_table(x.withColumns({"lines": F.transform("raws", T.normalized), "_row": F.monotonically_increasing_id()}))


def _edges(lines: Column) -> Column:
    """The different lines among the first and last three non-empty ones."""
    some = F.filter(lines, lambda x: x != "")
    return F.array_distinct(F.concat(F.slice(some, 1, EDGE), F.slice(some, F.greatest(F.size(some) - EDGE + 1, F.lit(1)), EDGE)))


def _marked(table: DataFrame) -> DataFrame:
    """``table`` (``_page_lines``) with ``marked``: line_index, line and reason (null: it stays) of each line.

    A line goes on its own account, or as a repeated boundary line after its first occurrence in the
    document (page numbers, ENWW and single characters always).
    """
    edge = table.select("document_id", "page_seq", "_row", F.explode(_edges(F.col("lines"))).alias("line"), "lines")
    edge = cut_to_table(edge.select("document_id", "page_seq", "_row", "line", (F.array_position("lines", F.col("line")).cast("int") - 1).alias("line_index")))
    here = F.struct("page_seq", "line_index", "_row")
    line = edge.groupBy("document_id", "line").agg(F.countDistinct("page_seq").alias("pages"), F.min(here).alias("first"))
    n = table.groupBy("document_id").agg(F.count("*").alias("n"))
    enough = F.greatest(F.lit(LEAST_PAGES), F.least(F.lit(MOST_PAGES), F.ceil(F.col("n") / 10)))
    line = line.join(n, "document_id").where((F.col("pages") >= enough) & T.boundary_candidate(F.col("line")))
    always = (F.upper("line") == "ENWW") | (F.length(T.plain(F.col("line"))) == 1)
    line = line.select("document_id", "line", F.when(~always, F.col("first")).alias("first"))
    # the place of a line's first occurrence on its own page, else -1
    stays = F.when(F.col("first._row") == F.col("_row"), F.col("line_index")).otherwise(-1)
    again = edge.join(line, ["document_id", "line"]).groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("line", stays))).alias("again"))
    x = table.join(small(cut_to_table(again)), "_row", "left")

    def reason(line: Column, i: Column) -> Column:
        place = F.try_element_at(F.col("again"), line)
        return F.coalesce(T.line_reason(line), F.when(place.isNotNull() & (place != i), F.lit("repeated_page_boundary")))

    return x.withColumn("marked", F.transform("lines", lambda line, i: F.struct(i.alias("line_index"), line.alias("line"), reason(line, i).alias("reason")))).drop("again")


def audit(pages: DataFrame) -> DataFrame:
    """Every line with the reason of its removal (null: it stays), as ``_marked`` has it."""
    x = _marked(_page_lines(pages))
    each = x.select("document_id", "page_seq", "page_number", F.explode(F.arrays_zip("raws", "marked")).alias("x"))
    return each.select("document_id", "page_seq", "page_number", F.col("x.marked.line_index").alias("line_index"), F.col("x.raws").alias("raw"), F.col("x.marked.line").alias("line"), F.struct("page_seq", F.col("x.marked.line_index").alias("line_index")).alias("pos"), F.col("x.marked.reason").alias("reason"))


def joined(kept: Column) -> Column:
    """Kept lines of a page with wrapped lines joined; blanks collapse, and none is left at either end.

    A fold over the page's lines: a line goes on with the one before if neither is structural, that one
    ends no sentence, and it begins with a small letter or digit; a hyphen before a small letter goes.
    """
    last = lambda a: F.element_at(a, -1)
    small, digit = r"^\p{Ll}", r"^\p{Nd}"

    def step(out: Column, line: Column) -> Column:
        prev = F.when(F.size(out) > 0, last(out)).otherwise(F.lit(""))
        goes_on = (prev != "") & ~prev.rlike(T.STRUCTURAL) & ~line.rlike(T.STRUCTURAL) & ~prev.rlike("[.!?:;]$") & (line.rlike(small) | line.rlike(digit))
        glued = F.when(prev.endswith("-") & line.rlike(small), F.concat(F.substring(prev, F.lit(1), F.length(prev) - 1), line)).otherwise(F.concat(prev, F.lit(" "), line))
        rest = F.slice(out, 1, F.size(out) - 1)
        return (
            F.when((line == "") & (prev == ""), out)
            .when(line == "", F.concat(out, F.array(F.lit(""))))
            .when(goes_on, F.concat(rest, F.array(glued)))
            .otherwise(F.concat(out, F.array(line)))
        )

    out = F.aggregate(kept, F.array().cast("array<string>"), step)
    return F.when((F.size(out) > 0) & (last(out) == ""), F.slice(out, 1, F.size(out) - 1)).otherwise(out)


def cleaned_pages(pages: DataFrame) -> DataFrame:
    """One row a page: text, lines, exclusion_reason, removed fragments and normalisation counts.

    A contents page starts with its signals and goes on while the next page looks like one; in closed
    form, the last start is later than the last page that neither starts nor goes on.  Then empty pages
    and pages equal to an earlier kept page are excluded.
    """
    x = _marked(_page_lines(pages))
    none = F.array().cast("array<string>")
    counted = lambda f: F.aggregate("raws", F.lit(0).cast("long"), lambda n, raw: n + f(raw))
    kept, gone = (F.filter("marked", f) for f in (lambda m: m["reason"].isNull(), lambda m: m["reason"].isNotNull()))
    page = x.select(
        "document_id", "page_seq", "page_number", "_row", joined(F.transform(kept, lambda m: m["line"])).alias("lines"), F.transform(gone, lambda m: F.struct(m["line"].alias("text"), m["reason"].alias("reason"))).alias("gone"),
        counted(lambda r: F.regexp_count(r, F.lit(T.DOTS))).alias("dot_leaders"), counted(lambda r: F.regexp_count(r, F.lit(T.UNDERSCORES))).alias("underscore_leaders"),
        counted(lambda r: F.regexp_count(r, F.lit(T.FORMAT_TAG))).alias("html_format_tags"), counted(T.repairs).alias("markdown_repairs"),
    )
    # null keys have no lines, as in a join by them
    known = F.col("document_id").isNotNull() & F.col("page_seq").isNotNull() & F.col("page_number").isNotNull()
    page = page.withColumns({c: F.when(known, F.col(c)) for c in ("gone", "dot_leaders", "underscore_leaders", "html_format_tags", "markdown_repairs")} | {"lines": F.coalesce(F.when(known, F.col("lines")), none)})
    leaders = F.coalesce(F.col("dot_leaders") + F.col("underscore_leaders"), F.lit(0))
    some = F.filter("lines", lambda x: x != "")
    entries = F.size(F.filter(some, lambda x: x.rlike(T.CONTENTS_ENTRY) & ~x.rlike(T.HEADING_START)))
    starts = (F.size(some) > 0) & ((F.exists(some, lambda x: x.rlike(T.CONTENTS_HEADING)) & (entries >= 2)) | ((leaders >= 8) & F.exists(some, lambda x: x.startswith("#"))))
    goes_on = (F.size(some) > 0) & (((entries >= 8) & (entries / F.size(some) >= 0.5)) | (leaders >= 8))
    content = cut_to_table(page.withColumns({"_starts": starts, "_goes": goes_on, "text": F.array_join("lines", "\n")}).withColumns({"_empty": F.trim("text") == "", "_print": F.sha2("text", 256)}))
    page = content.select("document_id", "page_seq", "page_number", "_row", "_starts", "_goes", "_empty", "_print")
    doc = Window.partitionBy("document_id").orderBy("page_seq")
    start, stop = F.max(F.when(F.col("_starts"), F.col("page_seq"))).over(doc), F.max(F.when(~F.col("_starts") & ~F.col("_goes"), F.col("page_seq"))).over(doc)
    page = page.withColumn("_contents", F.coalesce(start > F.coalesce(stop, F.lit(-1)), F.lit(False)))
    page = page.withColumn("_live", ~F.col("_contents") & ~F.col("_empty"))
    equal = Window.partitionBy("document_id", "_print", "_live").orderBy("page_seq")
    page = page.withColumn("_first", F.first("page_number").over(equal)).withColumn("_turn", F.row_number().over(equal))
    reason = F.when(F.col("_contents"), "table_of_contents").when(F.col("_empty"), "empty_page").when(F.col("_live") & (F.col("_turn") > 1), "duplicate_page")
    verdict = page.withColumn("exclusion_reason", reason).where("exclusion_reason IS NOT NULL").select("_row", "exclusion_reason", "_first")
    page = content.join(small(cut_to_table(verdict)), "_row", "left")
    of_page = (
        F.when(F.col("exclusion_reason") == "table_of_contents", F.transform(F.filter("lines", lambda x: x != ""), lambda x: F.struct(x.alias("text"), F.lit("table_of_contents").alias("reason"))))
        .when(F.col("exclusion_reason") == "duplicate_page", F.array(F.struct(F.concat(F.lit("Duplicate of page "), F.col("_first").cast("string")).alias("text"), F.lit("duplicate_page").alias("reason"))))
        .otherwise(F.array().cast("array<struct<text:string,reason:string>>"))
    )
    gone = F.coalesce("gone", F.array().cast("array<struct<text:string,reason:string>>"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return page.select(
        "document_id", "page_seq", "page_number", F.when(F.col("exclusion_reason").isin("table_of_contents", "duplicate_page"), "").otherwise(F.col("text")).alias("text"),
        F.col("exclusion_reason").isNotNull().alias("excluded_from_chunking"), "exclusion_reason", F.concat(gone, of_page).alias("removed_fragments"),
        zero("dot_leaders"), zero("underscore_leaders"), zero("html_format_tags"), zero("markdown_repairs"),
    )


def cleaning_report(cleaned: DataFrame) -> DataFrame:
    """One row a document: pages, excluded pages, removed fragments and their counts by reason."""
    reasons = ["page_number", "copyright_boilerplate", "navigation_label", "standalone_artifact", "layout_rule", "repeated_page_boundary", "table_of_contents", "duplicate_page"]
    n_of = lambda r: F.sum(F.size(F.filter("removed_fragments", lambda x: x["reason"] == r))).alias(r)
    return cleaned.groupBy("document_id").agg(
        F.count("*").alias("pages"), F.count_if("excluded_from_chunking").alias("excluded_pages"), F.sum(F.size("removed_fragments")).alias("removed_fragments"),
        *[n_of(r) for r in reasons], F.count_if(F.col("exclusion_reason") == "empty_page").alias("empty_page"),
        *[F.sum(c).alias(c) for c in ("dot_leaders", "underscore_leaders", "html_format_tags", "markdown_repairs")],
    )
