"""Registered queries of cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from ..operators import cleaning as C
from . import manuals as M

QUERIES: dict = {}
ORACLES: dict = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to}', 'g')"


def _norm(x: str) -> str:
    x = _sub(_sub(_sub(x, T.FORMAT_TAG, ""), T.BROKEN_LINK, r"**[\1](\2)**"), T.MANY_STARS, "**")
    return f"trim({_sub(f'replace({_sub(_sub(x, T.DOTS, chr(32)), T.UNDERSCORES, chr(32))}, chr(160), chr(32))', '[ ' + chr(9) + ']+', ' ')})"


def _has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def _plain(x: str) -> str:
    return "trim(" + _sub(x, r"^[#*_\s]+|[#*_\s]+$", "") + ")"


_REASON = f"""CASE WHEN line = '' THEN NULL WHEN {_has('line', T.PAGE_NUMBER)} THEN 'page_number' WHEN {_has('line', T.COPYRIGHT)} THEN 'copyright_boilerplate'
  WHEN {_has('line', T.NAVIGATION)} THEN 'navigation_label' WHEN line IN ('.', '®') THEN 'standalone_artifact' WHEN {_has('line', T.LAYOUT_RULE)} THEN 'layout_rule' END"""
_CANDIDATE = f"""CASE WHEN {_has('line', T.PAGE_NUMBER)} OR upper(line) = 'ENWW' THEN true
  WHEN {_has('line', T.TABLE_SEPARATOR)} OR ({_has('line', T.STRUCTURAL)} AND NOT starts_with(line, '#')) THEN false
  WHEN lower({_plain('line')}) IN ({', '.join(repr(p) for p in T.PROTECTED)}) THEN false
  WHEN length({_plain('line')}) = 1 THEN {_has(_plain('line'), '^[' + chr(92) + 'p{L}' + chr(92) + 'p{N}.]$')}
  WHEN {_plain('line')} = '' OR length({_plain('line')}) > 140 OR {_has(_plain('line'), '[.!?;:]$')} THEN false
  ELSE len(regexp_split_to_array({_plain('line')}, '\\s+')) <= 14 END"""


def _lines(pages: str) -> str:
    """CTEs: ``l`` (every line, with at_edge and reason) and ``rep`` (repeated boundary lines)."""
    return f"""
WITH pg AS ({pages}
), split AS (SELECT document_id, page_seq, page_number, string_split(CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END, chr(10)) AS a FROM pg WHERE text <> ''
), raw AS (SELECT document_id, page_seq, page_number, unnest(a) AS raw, unnest(range(len(a))) AS line_index FROM split
), n0 AS (SELECT *, {_norm('raw')} AS line FROM raw
), n1 AS (
  SELECT *, sum((line <> '')::INT) OVER (PARTITION BY document_id, page_seq ORDER BY line_index) AS up, sum((line <> '')::INT) OVER (PARTITION BY document_id, page_seq) AS whole FROM n0
), n2 AS (SELECT *, line <> '' AND bool_or(line <> '' AND (up <= 3 OR up > whole - 3)) OVER (PARTITION BY document_id, page_seq, line) AS at_edge FROM n1
), cnt AS (SELECT document_id, line, count(DISTINCT page_seq) AS pages FROM n2 WHERE at_edge GROUP BY 1, 2
), np AS (SELECT document_id, count(*) AS n FROM pg GROUP BY 1
), rep AS (SELECT document_id, line, pages FROM cnt JOIN np USING (document_id) WHERE pages >= greatest(3, least(20, ceil(n / 10.0))) AND {_CANDIDATE}
), n3 AS (SELECT n2.*, {_REASON} AS own, rep.line IS NOT NULL AS repeats FROM n2 LEFT JOIN rep USING (document_id, line)
), n4 AS (SELECT *, own IS NULL AND repeats AND at_edge AS reach FROM n3
), l AS (
  SELECT *, coalesce(own, CASE WHEN reach AND (upper(line) = 'ENWW' OR length({_plain('line')}) = 1
      OR row_number() OVER (PARTITION BY document_id, line, reach ORDER BY page_seq, line_index) > 1) THEN 'repeated_page_boundary' END) AS reason FROM n4
)"""


@_query(_lines(M.DOCUMENT_PAGES) + f"""
SELECT document_id, coalesce(reason, 'kept') AS reason, count(*) AS lines, sum(length(line))::BIGINT AS characters,
       sum(len(regexp_extract_all(raw, '{T.DOTS}')))::BIGINT AS dot_leaders, sum(len(regexp_extract_all(raw, '{T.FORMAT_TAG}')))::BIGINT AS html_format_tags
FROM l GROUP BY 1, 2
""")
def clean_line_audit(spark, sf_dir: str) -> DataFrame:
    """Lines, characters and leaders of each manual by reason of removal."""
    a = C.audit(M.document_pages(spark, sf_dir))
    return a.groupBy("document_id", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(
        F.count("*").alias("lines"), F.sum(F.length("line")).alias("characters"), F.sum(F.regexp_count("raw", F.lit(T.DOTS))).alias("dot_leaders"),
        F.sum(F.regexp_count("raw", F.lit(T.FORMAT_TAG))).alias("html_format_tags"),
    )


@_query(_lines(M.DOCUMENT_PAGES) + "SELECT document_id, line, pages FROM rep UNION ALL SELECT document_id, line, pages FROM (" + _lines(M.MANUAL_PAGES) + "SELECT document_id, line, pages FROM rep)")
def repeated_boundary_lines(spark, sf_dir: str) -> DataFrame:
    """Repeated boundary lines of the documents' and the parts' manuals."""
    out = [C.repeated_boundaries(C.lines(p), p) for p in (M.document_pages(spark, sf_dir), M.manual_pages(spark, sf_dir))]
    return out[0].unionByName(out[1])


@_query(_lines(M.MANUAL_PAGES) + "SELECT document_id, page_seq AS page, line_index, line, reason FROM l WHERE reason IS NOT NULL")
def first_occurrence_removal(spark, sf_dir: str) -> DataFrame:
    """Removed lines of the parts' manuals with their reasons."""
    return C.audit(M.manual_pages(spark, sf_dir)).where("reason IS NOT NULL").select("document_id", F.col("page_seq").alias("page"), "line_index", "line", "reason")


_STRUCT = T.STRUCTURAL
_JOINED = f""", k AS (SELECT document_id, page_seq, page_number, line_index, line, row_number() OVER (PARTITION BY document_id, page_seq ORDER BY line_index) AS i FROM l WHERE reason IS NULL
), j AS (SELECT *, lag(line) OVER (PARTITION BY document_id, page_seq ORDER BY i) AS prev FROM k
), g AS (
  SELECT *, coalesce(prev <> '' AND line <> '' AND NOT {_has('prev', _STRUCT)} AND NOT {_has('line', _STRUCT)} AND NOT {_has('prev', '[.!?:;]$')} AND {_has('line', '^[' + chr(92) + 'p{Ll}' + chr(92) + 'p{Nd}]')}, false) AS goes_on FROM j
), pt AS (
  SELECT *, CASE WHEN lead(goes_on) OVER w AND ends_with(line, '-') AND {_has('lead(line) OVER w', '^' + chr(92) + 'p{Ll}')} THEN line[:-2] ELSE line END
      || CASE WHEN lead(goes_on) OVER w AND NOT (ends_with(line, '-') AND {_has('lead(line) OVER w', '^' + chr(92) + 'p{Ll}')}) THEN ' '
              WHEN lead(goes_on) OVER w THEN '' WHEN lead(line) OVER w IS NULL THEN '' ELSE chr(10) END AS piece
  FROM g WHERE NOT (line = '' AND coalesce(prev, '') = '') WINDOW w AS (PARTITION BY document_id, page_seq ORDER BY i)
), tx AS (SELECT document_id, page_seq, page_number, rtrim(string_agg(piece, '' ORDER BY i), chr(10)) AS text FROM pt GROUP BY 1, 2, 3
), page AS (SELECT pg.document_id, pg.page_seq, pg.page_number, coalesce(tx.text, '') AS text FROM pg LEFT JOIN tx USING (document_id, page_seq)
)"""


@_query(_lines(M.DOCUMENT_PAGES) + _JOINED + "SELECT document_id, page_seq, md5(text) AS text_md5, length(text) AS n_chars FROM page")
def join_wrapped_lines(spark, sf_dir: str) -> DataFrame:
    """Kept lines of each page with wrapped lines joined."""
    kept = C.audit(M.document_pages(spark, sf_dir)).where("reason IS NULL")
    pages = kept.groupBy("document_id", "page_seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_index", "line"))), lambda x: x["line"]).alias("k"))
    every = M.document_pages(spark, sf_dir).select("document_id", "page_seq").join(pages, ["document_id", "page_seq"], "left")
    text = F.array_join(C.joined(F.coalesce("k", F.array().cast("array<string>"))), "\n")
    return every.select("document_id", "page_seq", F.md5(text).alias("text_md5"), F.length(text).cast("long").alias("n_chars"))


_EXCLUDED = f""", sig AS (
  SELECT *, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS inked,
         coalesce((SELECT sum(len(regexp_extract_all(raw, '{T.DOTS}')) + len(regexp_extract_all(raw, '{T.UNDERSCORES}'))) FROM raw r WHERE r.document_id = page.document_id AND r.page_seq = page.page_seq), 0) AS leaders FROM page
), e AS (SELECT *, len(list_filter(inked, lambda x: regexp_matches(x, '{T.CONTENTS_ENTRY}') AND NOT regexp_matches(x, '{T.HEADING_START}'))) AS entries FROM sig
), f AS (
  SELECT *, len(inked) > 0 AND ((len(list_filter(inked, lambda x: regexp_matches(x, '{T.CONTENTS_HEADING}'))) > 0 AND entries >= 2) OR (leaders >= 8 AND len(list_filter(inked, lambda x: starts_with(x, '#'))) > 0)) AS starts,
         len(inked) > 0 AND ((entries >= 8 AND entries / len(inked) >= 0.5) OR leaders >= 8) AS goes FROM e
), c AS (
  SELECT *, coalesce(max(CASE WHEN starts THEN page_seq END) OVER w > coalesce(max(CASE WHEN NOT starts AND NOT goes THEN page_seq END) OVER w, -1), false) AS contents
  FROM f WINDOW w AS (PARTITION BY document_id ORDER BY page_seq)
), x AS (
  SELECT *, CASE WHEN contents THEN 'table_of_contents' WHEN trim(text) = '' THEN 'empty_page'
         WHEN row_number() OVER w2 > 1 THEN 'duplicate_page' END AS exclusion_reason, first(page_number) OVER w2 AS first_page
  FROM c WINDOW w2 AS (PARTITION BY document_id, text, NOT contents AND trim(text) <> '' ORDER BY page_seq)
)"""


@_query(_lines(M.MANUAL_PAGES) + _JOINED + _EXCLUDED + "SELECT document_id, page_number, exclusion_reason, leaders::BIGINT AS leaders FROM x")
def contents_pages(spark, sf_dir: str) -> DataFrame:
    """Contents pages of the parts' manuals: every page with its exclusion and its leaders."""
    c = C.cleaned_pages(M.manual_pages(spark, sf_dir))
    return c.select("document_id", "page_number", "exclusion_reason", (F.col("dot_leaders") + F.col("underscore_leaders")).alias("leaders"))


@_query(_lines(M.DOCUMENT_PAGES) + _JOINED + _EXCLUDED + "SELECT document_id, page_number, exclusion_reason, CASE WHEN exclusion_reason = 'duplicate_page' THEN 'Duplicate of page ' || first_page END AS note FROM x WHERE exclusion_reason IS NOT NULL")
def excluded_pages(spark, sf_dir: str) -> DataFrame:
    """Empty and duplicate pages of the documents' manuals."""
    c = C.cleaned_pages(M.document_pages(spark, sf_dir)).where("excluded_from_chunking")
    note = F.when(F.col("exclusion_reason") == "duplicate_page", F.element_at("removed_fragments", -1)["text"])
    return c.select("document_id", "page_number", "exclusion_reason", note.alias("note"))


@_query(_lines(M.DOCUMENT_PAGES) + _JOINED + _EXCLUDED + """, byline AS (SELECT document_id, count(*) AS removed, count(*) FILTER (reason = 'copyright_boilerplate') AS copyright_boilerplate, count(*) FILTER (reason = 'repeated_page_boundary') AS repeated_page_boundary FROM l WHERE reason IS NOT NULL GROUP BY 1)
SELECT x.document_id, count(*) AS pages, count(exclusion_reason) AS excluded_pages, count(*) FILTER (exclusion_reason = 'duplicate_page') AS duplicate_page,
       (coalesce(any_value(removed), 0) + count(*) FILTER (exclusion_reason = 'duplicate_page') + coalesce(sum(len(inked)) FILTER (exclusion_reason = 'table_of_contents'), 0))::BIGINT AS removed_fragments,
       coalesce(any_value(copyright_boilerplate), 0) AS copyright_boilerplate, coalesce(any_value(repeated_page_boundary), 0) AS repeated_page_boundary
FROM x LEFT JOIN byline USING (document_id) GROUP BY 1
""")
def cleaning_report(spark, sf_dir: str) -> DataFrame:
    """Counts of the cleaning by manual."""
    r = C.cleaning_report(C.cleaned_pages(M.document_pages(spark, sf_dir)))
    return r.select("document_id", "pages", "excluded_pages", "duplicate_page", "removed_fragments", "copyright_boilerplate", "repeated_page_boundary")


@_query("""
SELECT concat_ws('/', source, (doc_id // 1000)::VARCHAR) AS document_id, count(*) AS pages, sum(length(text))::BIGINT AS characters, count(*) FILTER (trim(text) = '') AS empty_pages,
       substr(arg_min(text, doc_id) FILTER (trim(text) <> ''), 1, 240) AS preview FROM documents GROUP BY 1
""")
def parse_report(spark, sf_dir: str) -> DataFrame:
    """Pages, characters, empty pages and the beginning of the first text of each manual."""
    p, some = M.document_pages(spark, sf_dir), F.trim("text") != ""
    return p.groupBy("document_id").agg(
        F.count("*").alias("pages"), F.sum(F.length("text")).alias("characters"), F.count_if(~some).alias("empty_pages"),
        F.substring(F.min_by("text", F.when(some, F.col("page_seq"))), 1, 240).alias("preview"),
    )
