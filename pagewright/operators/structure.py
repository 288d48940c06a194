"""Structure of cleaned pages at line grain: sections, procedures, table rows and identifiers.

Sequential rules are closed forms over windows within a document; ``pos`` is a line's place in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T

#: Contexts and patterns of identifiers by kind. Spaced numbers need a context of their own.
ERROR_CONTEXT = r"(?i)\b(?:error|failure|fault|diagnostic|message)\b"
BLINK_CONTEXT = r"(?i)\b(?:blink(?:ing)?|flash(?:ing)?|LED|light pattern|failure code)\b"
SPACED_CONTEXT = r"(?i)\b(?:blink|flash|LED|light pattern)\b"
PART_CONTEXT = r"(?i)\b(?:part|spare part|replacement part|FRU|component)\s+number\b"
MODEL_CONTEXT = r"(?i)\b(?:model|product)\s+(?:number|name|code)\b"
BRACKET_CODE = r"\[\s*\d{1,2}(?:\s*[,/-]\s*\d{1,2})+\s*\]"
SEQUENCE_CODE = r"(?i)\b(?:ON|OFF|FLASH|BLINK)(?:[-/](?:ON|OFF|FLASH|BLINK)){2,}\b"
SEPARATED_NUMBERS = r"\b\d{1,2}[-/]\d{1,2}(?:[-/]\d{1,2})*\b"
SPACED_NUMBERS = r"(?<![A-Za-z0-9])\d{1,2}\s+\d{1,2}(?![A-Za-z0-9])"
PART_NUMBER = r"(?i)\b[A-Z]\d{4,6}-(?:\d{3}|[A-Z0-9]{3})\b"
MODEL_NUMBER = r"(?i)\b(?=[A-Z0-9-]*\d)(?:[A-Z]{1,8}(?:-[A-Z0-9]{1,8}){1,3}|[A-Z]{1,6}\d{2,6}[A-Z0-9]*)\b"
GENERIC_MODELS = ["ERROR", "FAILURE", "SYSTEM", "PRODUCT", "NUMBER", "CODE", "MODEL"]
KINDS = ["error_code", "blink_pattern", "part_number", "model_number"]


def structured_lines(pages: DataFrame) -> DataFrame:
    """document_id, source_file, page, line_index, pos, text, is_heading, level, title, section.

    ``pages`` has document_id, page_seq, page_number, text and maybe source_file (else the document stands for
    it) and excluded_from_chunking; excluded pages have no lines.  A heading of level L is on the path as long as no later heading is of L or less.
    """
    if "excluded_from_chunking" in pages.columns:
        pages = pages.where(~F.col("excluded_from_chunking"))
    source = F.col("source_file") if "source_file" in pages.columns else F.col("document_id")
    line = pages.select("document_id", source.alias("source_file"), "page_seq", F.col("page_number").alias("page"), F.posexplode(T.lines_of(F.col("text"))).alias("line_index", "text"))
    doc = Window.partitionBy("document_id").orderBy("page_seq", "line_index")
    marks, asked = F.regexp_extract("text", T.HEADING, 1), F.regexp_extract("text", T.QUESTION_HEADING, 1)
    line = line.withColumn("pos", F.row_number().over(doc).cast("long"))
    line = line.withColumn("level", F.when(marks != "", F.length(marks)).when(asked != "", 2))
    line = line.withColumn("title", F.when(marks != "", F.regexp_extract("text", T.HEADING, 2)).when(asked != "", asked))
    upto = Window.partitionBy("document_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = [F.max(F.when(F.col("level") == n, F.struct("pos", "title"))).over(upto).alias(f"_h{n}") for n in range(1, 7)]
    line = line.select("*", *last)

    def live(n: int) -> Column:
        own = F.col(f"_h{n}")
        ok = own.isNotNull()
        for k in range(1, n):
            ok = ok & (F.col(f"_h{k}").isNull() | (own["pos"] > F.col(f"_h{k}")["pos"]))
        return F.when(ok, own["title"])

    path = F.concat_ws(" > ", *[live(n) for n in range(1, 7)])
    return line.select("document_id", "source_file", "page", "line_index", "pos", "text", F.col("level").isNotNull().alias("is_heading"), "level", "title", path.alias("section"))


def headings(lines: DataFrame) -> DataFrame:
    return lines.where("is_heading").select("document_id", "page", "line_index", "level", "title", "section")


def procedures(lines: DataFrame) -> DataFrame:
    """document_id, run, section, pages, steps, prerequisites, warnings: numbered runs of two steps or more.

    Prerequisites and warnings are evidence (source_file, page, section, content, line_start, line_end); a step
    has number, page, content and the evidence of its first line, whose content goes on as the step's does.

    A run ends at a heading or at a paragraph after a blank line, and a step whose number isn't above
    the one before starts a new run.  Lines in between go on with the step; marked lines before a run,
    while none is active, are its prerequisites.
    """
    doc = Window.partitionBy("document_id").orderBy("pos")
    upto, before = doc.rowsBetween(Window.unboundedPreceding, Window.currentRow), doc.rowsBetween(Window.unboundedPreceding, -1)
    number = F.when(~F.col("is_heading"), F.nullif(F.regexp_extract("text", T.ORDERED_STEP, 1), F.lit("")))
    x = lines.withColumn("number", number.cast("long")).withColumn("body", F.trim(F.regexp_extract("text", T.ORDERED_STEP, 2)))
    step, blank = F.col("number").isNotNull(), F.trim("text") == ""
    mark = F.col("text").rlike(T.WARNING)
    after_blank = F.coalesce(F.trim(F.lag("text").over(doc)) == "", F.lit(False))
    x = x.withColumn("_brk", F.col("is_heading") | (~blank & ~step & ~mark & after_blank))
    x = x.withColumn("_last_break", F.max(F.when(F.col("_brk"), F.col("pos"))).over(upto))
    x = x.withColumn("_step_before", F.max(F.when(step, F.struct("pos", "number"))).over(before))
    x = x.withColumn("_last_step", F.max(F.when(step, F.col("pos"))).over(upto))
    begins = step & (F.col("_step_before").isNull() | (F.coalesce("_last_break", F.lit(-1)) > F.col("_step_before.pos")) | (F.col("number") <= F.col("_step_before.number")))
    x = x.withColumn("run", F.sum(begins.cast("int")).over(upto))
    inside = ~blank & F.col("_last_step").isNotNull() & (F.coalesce("_last_break", F.lit(-1)) < F.col("_last_step"))
    first_text_break = F.col("_brk") & ~F.col("is_heading") & F.col("_step_before").isNotNull() & (F.coalesce(F.lag("_last_break").over(doc), F.lit(-1)) < F.col("_step_before.pos"))
    need = ~step & ~inside & ~first_text_break & T.plain(F.col("text")).rlike(T.PREREQUISITE)
    x = x.withColumns({"_inside": inside, "_need": need, "_step": step, "_warn": mark})
    line = F.col("line_index").cast("long")
    x = x.withColumn("_e", F.struct("source_file", "page", "section", F.col("text").alias("content"), line.alias("line_start"), line.alias("line_end")))
    member = x.where("_inside").groupBy("document_id", "run", "_last_step").agg(
        F.min_by(F.struct("number", "page", "section", "_e"), "pos").alias("first"),
        F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("_step"), F.col("body")).otherwise(F.col("text")).alias("t"), F.col("text").alias("raw")))).alias("said"),
        F.array_sort(F.collect_list(F.when(F.col("_warn"), F.struct("pos", "_e")))).alias("warned"),
    )
    joined = lambda c: F.array_join(F.col(c), "\n")
    e = F.col("first._e")
    whole = F.struct(e["source_file"].alias("source_file"), e["page"].alias("page"), e["section"].alias("section"), joined("said.raw").alias("content"), e["line_start"].alias("line_start"), e["line_end"].alias("line_end"))
    step_of = F.struct("_last_step", F.struct(F.col("first.number").alias("number"), F.col("first.page").alias("page"), joined("said.t").alias("content"), whole.alias("evidence")).alias("s"))
    run = member.groupBy("document_id", "run").agg(
        F.min_by("first.section", "_last_step").alias("section"), F.array_sort(F.collect_list(step_of))["s"].alias("steps"), F.array_sort(F.flatten(F.collect_list("warned")))["_e"].alias("warnings"),
    )
    needs = x.where("_need").groupBy("document_id", (F.col("run") + 1).alias("run")).agg(F.array_sort(F.collect_list(F.struct("pos", "_e")))["_e"].alias("prerequisites"))
    out = run.join(needs, ["document_id", "run"], "left").withColumn("prerequisites", F.coalesce("prerequisites", F.array().cast("array<struct<source_file:string,page:int,section:string,content:string,line_start:bigint,line_end:bigint>>")))
    of_steps = F.transform("steps", lambda s: s["page"])
    out = out.withColumn("pages", F.array_sort(F.array_distinct(F.concat(of_steps, F.col("prerequisites.page"), F.col("warnings.page")))))
    good = (F.size("steps") >= 2) & (F.col("section") != "") & ~F.col("section").rlike(T.NO_PROCEDURE)
    return out.where(good).select("document_id", "run", "section", "pages", "steps", "prerequisites", "warnings")


def cells(row: Column) -> Column:
    """The trimmed cells of a pipe row."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(row), r"^\|", ""), r"\|$", "")
    return F.transform(F.split(bare, r"\|"), lambda c: F.trim(c))


def table_rows(lines: DataFrame) -> DataFrame:
    """document_id, table_pos, row_index, page, section, headers, cells, source_file, line_index, text: rows of pipe tables that have a header and a separator."""
    doc = Window.partitionBy("document_id").orderBy("pos")
    pipe = ~F.col("is_heading") & F.col("text").rlike(T.PIPE_ROW)
    x = lines.withColumn("_pipe", pipe).withColumn("_new", F.col("_pipe") & ~F.coalesce(F.lag("_pipe").over(doc), F.lit(False)))
    x = x.withColumn("_run", F.sum(F.col("_new").cast("int")).over(doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    x = x.withColumn("cells", cells(F.col("text"))).withColumn("_some", F.exists("cells", lambda c: c != ""))
    x = x.withColumn("_sep_next", F.lead(F.col("_pipe") & F.trim("text").rlike(T.TABLE_SEPARATOR)).over(doc))
    x = x.where("_pipe AND section <> ''")
    run = Window.partitionBy("document_id", "_run")
    x = x.withColumn("_head", F.min(F.when(F.col("_some") & F.col("_sep_next"), F.struct("pos", "cells"))).over(run))
    rows = x.where(F.col("_some") & (F.col("pos") > F.col("_head.pos") + 1))
    at = F.row_number().over(Window.partitionBy("document_id", "_run").orderBy("pos")) - 1
    return rows.select("document_id", F.col("_head.pos").alias("table_pos"), at.alias("row_index"), "page", "section", F.col("_head.cells").alias("headers"), "cells", "source_file", "line_index", "text")


def identifiers(lines: DataFrame) -> DataFrame:
    """document_id, kind, value, normalized_value, page, section, context, occurrence, source_file, line_index: identifiers in their contexts, once per page and section."""
    t = F.col("text")
    found = lambda p: F.transform(F.regexp_extract_all(t, F.lit(p), F.lit(0)), lambda v: F.trim(v))
    none = F.array().cast("array<string>")
    codes = F.concat(found(BRACKET_CODE), found(SEQUENCE_CODE))
    by_kind = [
        F.when(t.rlike(ERROR_CONTEXT), codes),
        F.when(t.rlike(BLINK_CONTEXT), F.concat(codes, found(SEPARATED_NUMBERS), F.when(t.rlike(SPACED_CONTEXT), found(SPACED_NUMBERS)).otherwise(none))),
        F.when(t.rlike(PART_CONTEXT), found(PART_NUMBER)),
        F.when(t.rlike(MODEL_CONTEXT), F.filter(found(MODEL_NUMBER), lambda v: ~F.upper(v).isin(GENERIC_MODELS))),
    ]

    def numbered(values: Column, kind: int) -> Column:
        return F.transform(F.coalesce(values, none), lambda v, i: F.struct(F.lit(kind).alias("k"), i.alias("i"), v.alias("value")))

    pairs = F.flatten(F.array(*[numbered(v, k) for k, v in enumerate(by_kind)]))
    x = lines.where("section <> ''").select("document_id", "source_file", "line_index", "page", "section", "pos", F.col("text").alias("context"), F.explode(pairs).alias("v"))
    x = x.select("*", F.element_at(F.array(*map(F.lit, KINDS)), F.col("v.k") + 1).alias("kind"), F.col("v.value").alias("value"), F.upper(F.regexp_replace("v.value", r"\s+", "")).alias("normalized_value"))
    once = F.row_number().over(Window.partitionBy("document_id", "kind", "normalized_value", "page", "section").orderBy("pos", "v.k", "v.i"))
    x = x.where("normalized_value <> ''").withColumn("_n", once).where("_n = 1")
    nth = F.row_number().over(Window.partitionBy("document_id").orderBy("pos", "v.k", "v.i"))
    return x.select("document_id", "kind", "value", "normalized_value", "page", "section", "context", nth.alias("occurrence"), "source_file", "line_index")
