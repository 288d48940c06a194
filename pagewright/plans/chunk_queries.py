"""Registered queries of structure and chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import chunking as K, structure as S
from ..runtime import cut_to_table, held, spread, table
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


#: Pages that a task of the windows by manual holds about at most (a manual stays in one task).
TASK_PAGES = 1000


def _lines(spark, sf_dir) -> DataFrame:
    return S.structured_lines(spread(cut_to_table(M.manual_pages(spark, sf_dir)), TASK_PAGES, "document_id"))


_BASE = "WITH l0 AS (" + M.MANUAL_LINES.replace("{part}", "part") + r"""
), l1 AS (
  SELECT document_id, page, (row_number() OVER (PARTITION BY document_id, page ORDER BY line_index) - 1)::INT AS line_index, text, row_number() OVER (PARTITION BY document_id ORDER BY page, line_index) AS pos,
         length(regexp_extract(text, '^\s*(#{1,6})\s+(.+?)\s*#*\s*$', 1)) AS lv, regexp_extract(text, '^\s*(#{1,6})\s+(.+?)\s*#*\s*$', 2) AS title FROM l0
), l2 AS (
  SELECT *, max(CASE WHEN lv = 1 THEN {'p': pos, 't': title} END) OVER w AS h1, max(CASE WHEN lv = 2 THEN {'p': pos, 't': title} END) OVER w AS h2, max(CASE WHEN lv = 4 THEN {'p': pos, 't': title} END) OVER w AS h4
  FROM l1 WINDOW w AS (PARTITION BY document_id ORDER BY pos)
), l AS (
  SELECT document_id, page, line_index, text, pos, lv > 0 AS is_heading, nullif(lv, 0) AS level, nullif(title, '') AS title,
         concat_ws(' > ', h1.t, CASE WHEN h2.p > coalesce(h1.p, 0) THEN h2.t END, CASE WHEN h4.p > greatest(coalesce(h1.p, 0), coalesce(h2.p, 0)) THEN h4.t END) AS section FROM l2
)
"""


@_query(_BASE + "SELECT document_id, page, line_index, section, is_heading FROM l")
def section_paths(spark, sf_dir: str) -> DataFrame:
    """The section of every line of the parts' manuals."""
    return _lines(spark, sf_dir).select("document_id", "page", "line_index", "section", "is_heading")


@_query(_BASE + "SELECT document_id, page, line_index, level, title, section FROM l WHERE is_heading")
def headings(spark, sf_dir: str) -> DataFrame:
    """The headings of the parts' manuals."""
    return S.headings(_lines(spark, sf_dir))


@_query(r"""
SELECT page_id, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS title, len(regexp_extract_all(html, '<li>')) AS items, len(regexp_extract_all(html, '<p>')) AS paragraphs
FROM pages WHERE regexp_matches(html, '<h1>.+?</h1>')
""")
def page_headings(spark, sf_dir: str) -> DataFrame:
    """Web pages that have a heading, with their list items and paragraphs."""
    h = F.col("html")
    return table(spark, sf_dir, "pages").where(h.rlike("<h1>.+?</h1>")).select(
        "page_id", F.regexp_extract(h, "<h1>(.*?)</h1>", 1).alias("title"), F.regexp_count(h, F.lit("<li>")).cast("long").alias("items"), F.regexp_count(h, F.lit("<p>")).cast("long").alias("paragraphs")
    )


_STEPS = _BASE + r""", s0 AS (
  SELECT *, CASE WHEN NOT is_heading THEN nullif(regexp_extract(text, '^\s*(?:\*\*)?(\d+)[.)](?:\*\*)?\s+(.+?)\s*$', 1), '')::BIGINT END AS number,
         trim(regexp_extract(text, '^\s*(?:\*\*)?(\d+)[.)](?:\*\*)?\s+(.+?)\s*$', 2)) AS body, regexp_matches(text, '(?i)\b(?:warning|caution|danger|notice|important)\b') AS warn FROM l
), s1 AS (SELECT *, is_heading OR (trim(text) <> '' AND number IS NULL AND NOT warn AND coalesce(trim(lag(text) OVER w) = '', false)) AS brk FROM s0 WINDOW w AS (PARTITION BY document_id ORDER BY pos)
), s2 AS (
  SELECT *, coalesce(max(CASE WHEN brk THEN pos END) OVER w, -1) AS lb, max(CASE WHEN number IS NOT NULL THEN pos END) OVER w AS ls,
         max(CASE WHEN number IS NOT NULL THEN {'p': pos, 'n': number} END) OVER (PARTITION BY document_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sb
  FROM s1 WINDOW w AS (PARTITION BY document_id ORDER BY pos)
), s3 AS (SELECT *, sum((number IS NOT NULL AND (sb IS NULL OR lb > sb.p OR number <= sb.n))::INT) OVER (PARTITION BY document_id ORDER BY pos) AS run FROM s2
), st AS (
  SELECT document_id, run, ls, min(number) AS number, min(page) AS page, arg_min(section, pos) AS section,
         string_agg(CASE WHEN number IS NOT NULL THEN body ELSE text END, chr(10) ORDER BY pos) AS content, count(*) FILTER (warn) AS warnings,
         {'page': arg_min(page, pos), 'section': arg_min(section, pos), 'line': arg_min(line_index, pos), 'content': string_agg(text, chr(10) ORDER BY pos)} AS e, least(min(page), min(page) FILTER (warn)) AS lo, greatest(min(page), max(page) FILTER (warn)) AS hi
  FROM s3 WHERE trim(text) <> '' AND ls IS NOT NULL AND lb < ls GROUP BY 1, 2, 3
), rn AS (
  SELECT document_id, run, arg_min(section, ls) AS section, count(*) AS steps, sum(warnings)::BIGINT AS warnings, min(lo) AS first_page, max(hi) AS last_page, string_agg(number || '. ' || content, chr(10) ORDER BY ls) AS text
  FROM st GROUP BY 1, 2
), nd AS (SELECT document_id, run + 1 AS run, count(*) AS prerequisites, min(page) AS np, max(page) AS xp FROM s3 WHERE number IS NULL AND NOT (ls IS NOT NULL AND lb < ls) AND regexp_matches(trim(text), '(?i)^(?:before you begin|prerequisites?|preparation|prepare|requirements?|required tools?|you will need)\b') GROUP BY 1, 2)
"""


@_query(_STEPS + r"""
SELECT rn.document_id, rn.run::BIGINT AS run, section, steps, warnings, least(first_page, np) AS first_page, greatest(last_page, xp) AS last_page, text, coalesce(prerequisites, 0) AS prerequisites
FROM rn LEFT JOIN nd ON rn.document_id = nd.document_id AND rn.run = nd.run WHERE steps >= 2 AND section <> '' AND NOT regexp_matches(section, '(?i)\b(?:licenses?|trademarks?|copyright|glossary)\b')
""")
def procedures(spark, sf_dir: str) -> DataFrame:
    """Procedures of the parts' manuals."""
    p = S.procedures(_lines(spark, sf_dir))
    text = F.array_join(F.transform("steps", lambda s: F.concat(s["number"].cast("string"), F.lit(". "), s["content"])), "\n")
    return p.select("document_id", F.col("run").cast("long").alias("run"), "section", F.size("steps").cast("long").alias("steps"), F.size("warnings").cast("long").alias("warnings"), F.array_min("pages").alias("first_page"), F.array_max("pages").alias("last_page"), text.alias("text"), F.size("prerequisites").cast("long").alias("prerequisites"))


_ROWS = _BASE + r""", t0 AS (SELECT *, NOT is_heading AND regexp_matches(text, '^\s*\|[^\n]*\|\s*$') AS pipe FROM l
), t1 AS (SELECT *, pipe AND NOT coalesce(lag(pipe) OVER w, false) AS new, lead(pipe AND regexp_matches(trim(text), '^\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)+\|?$')) OVER w AS sep FROM t0 WINDOW w AS (PARTITION BY document_id ORDER BY pos)
), t2 AS (SELECT *, sum(new::INT) OVER (PARTITION BY document_id ORDER BY pos) AS run, list_transform(string_split(regexp_replace(regexp_replace(trim(text), '^\|', ''), '\|$', ''), '|'), lambda x: trim(x)) AS cells FROM t1
), t3 AS (SELECT *, min(CASE WHEN sep AND len(list_filter(cells, lambda x: x <> '')) > 0 THEN {'p': pos, 'c': cells} END) OVER (PARTITION BY document_id, run) AS head FROM t2 WHERE pipe AND section <> ''
), tr AS (
  SELECT document_id, head.p AS table_pos, (row_number() OVER (PARTITION BY document_id, run ORDER BY pos) - 1)::INT AS row_index, page, section, head.c AS headers, cells, [{'page': page, 'section': section, 'line': line_index, 'content': text}] AS ev
  FROM t3 WHERE pos > head.p + 1 AND len(list_filter(cells, lambda x: x <> '')) > 0
)"""


@_query(_ROWS + "SELECT document_id, table_pos, row_index, page, section, array_to_string(headers, '|') AS headers, array_to_string(cells, '|') AS cells FROM tr")
def table_rows(spark, sf_dir: str) -> DataFrame:
    """Table rows of the parts' manuals."""
    return S.table_rows(_lines(spark, sf_dir)).withColumns({"headers": F.array_join("headers", "|"), "cells": F.array_join("cells", "|")}).drop("source_file", "line_index", "text")


_CHUNK_ID = "'{0}:' || substr(sha256(document_id || '|{0}|' || section || '|' || page || '|' || content), 1, 24)"


@_query(_ROWS + f"""SELECT {_CHUNK_ID.format('table_row')} AS chunk_id, document_id, section, page, content FROM (
  SELECT *, array_to_string(list_transform(list_zip(headers, cells, true), lambda x: x[1] || ': ' || x[2]), ' | ') AS content FROM tr)""")
def table_row_chunks(spark, sf_dir: str) -> DataFrame:
    """Chunks of the table rows."""
    c = K.table_row_chunks(S.table_rows(_lines(spark, sf_dir)))
    return c.select("chunk_id", "document_id", "section", F.element_at("pages", 1).alias("page"), "content")


_IDENTS = _BASE + r""", v AS (
  SELECT document_id, page, line_index, section, pos, text, 0 AS k, 'error_code' AS kind, unnest(regexp_extract_all(text, '\[\s*\d{1,2}(?:\s*[,/-]\s*\d{1,2})+\s*\]')) AS value, unnest(range(50)) AS i FROM l WHERE section <> '' AND regexp_matches(text, '(?i)\b(?:error|failure|fault|diagnostic|message)\b')
  UNION ALL SELECT document_id, page, line_index, section, pos, text, 2, 'part_number', unnest(regexp_extract_all(text, '(?i)\b[A-Z]\d{4,6}-(?:\d{3}|[A-Z0-9]{3})\b')), unnest(range(50)) FROM l WHERE section <> '' AND regexp_matches(text, '(?i)\b(?:part|spare part|replacement part|FRU|component)\s+number\b')
), o AS (
  SELECT *, upper(regexp_replace(value, '\s+', '', 'g')) AS normalized_value FROM v WHERE value IS NOT NULL
), d AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY document_id, kind, normalized_value, page, section ORDER BY pos, k, i) = 1
), idn AS (SELECT document_id, kind, value, normalized_value, page, section, text AS context, row_number() OVER (PARTITION BY document_id ORDER BY pos, k, i)::INT AS occurrence, [{'page': page, 'section': section, 'line': line_index, 'content': text}] AS ev FROM d)
"""


@_query(_IDENTS + "SELECT * EXCLUDE (ev) FROM idn")
def identifiers(spark, sf_dir: str) -> DataFrame:
    """Identifiers of the parts' manuals."""
    return S.identifiers(_lines(spark, sf_dir)).drop("source_file", "line_index")


@_query(_IDENTS + f"SELECT {_CHUNK_ID.format('exact')} AS chunk_id, document_id, section, page, content, normalized_value FROM (SELECT *, context AS content FROM idn)")
def identifier_chunks(spark, sf_dir: str) -> DataFrame:
    """Chunks of the identifiers."""
    c = K.identifier_chunks(S.identifiers(_lines(spark, sf_dir)))
    return c.select("chunk_id", "document_id", "section", F.element_at("pages", 1).alias("page"), "content", "normalized_value")


def _piece(text: str) -> str:
    return f"list_transform(ev, lambda e: {{'page': e.page, 'section': e.section, 'line': e.line, 'content': {text}}})"


def _packed(x: str, units: str, most: int) -> str:
    """CTEs that pack ``units`` (k, n, text, ev) one by one: ``{x}g`` has k, i, text, ev and the number of the ``part``."""
    word, unit = f"used + length(w.w) + 1 <= {most}", f"NOT o.alone AND NOT g.alone AND used + length(o.text) + 1 <= {most}"
    return f""", {x}w AS (
  SELECT k, n, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT k, n, regexp_split_to_array(text, '\\s+') AS ws FROM {units} WHERE length(text) > {most})
), {x}r AS (
  SELECT k, n, i, w, 1 AS piece, length(w) + 1 AS used FROM {x}w WHERE i = 1
  UNION ALL SELECT w.k, w.n, w.i, w.w, CASE WHEN {word} THEN piece ELSE piece + 1 END, CASE WHEN {word} THEN used ELSE 0 END + length(w.w) + 1 FROM {x}r r JOIN {x}w w ON w.k = r.k AND w.n = r.n AND w.i = r.i + 1
), {x}p AS (SELECT k, n, piece, string_agg(w, ' ' ORDER BY i) AS t FROM {x}r GROUP BY 1, 2, 3
), {x}s AS (SELECT k, n, 1 AS piece, text, ev, false AS alone FROM {units} WHERE length(text) <= {most} UNION ALL SELECT k, n, piece, t, {_piece('t')}, true FROM {x}p JOIN {units} USING (k, n)
), {x}o AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY n, piece) AS i, text, ev, alone FROM {x}s
), {x}g AS (
  SELECT k, i, text, ev, alone, 0 AS part, length(text) + 1 AS used FROM {x}o WHERE i = 1
  UNION ALL SELECT o.k, o.i, o.text, o.ev, o.alone, CASE WHEN {unit} THEN part ELSE part + 1 END, CASE WHEN {unit} THEN used ELSE 0 END + length(o.text) + 1 FROM {x}g g JOIN {x}o o ON o.k = g.k AND o.i = g.i + 1
)"""


def _ready(source: str) -> str:
    """Rows of ``source`` (ev) with repeated evidence left out, and with their pages."""
    return f"""(SELECT *, list_sort(list_distinct(list_transform(ev, lambda e: e.page))) AS pages FROM (
      SELECT * EXCLUDE (ev, ks), list_filter(ev, lambda e, i: list_position(ks, ks[i]) = i) AS ev FROM (SELECT *, list_transform(ev, lambda e: {{'p': e.page, 's': e.section, 'c': e.content}}) AS ks FROM {source})))"""


def _finished(source: str, strategy: str, kind: str, profiles: str, parent: str = "NULL::VARCHAR", over: str = "0") -> str:
    """The columns of chunks of ``source`` (document_id, section, content, ev)."""
    return f"""SELECT {_PAGED_ID.format(strategy)} AS chunk_id, document_id, section, pages[1] AS page, {_PAGES} AS pages, content, '{kind}' AS kind, '{strategy}' AS strategy, {parent} AS parent_chunk_id, ({over})::INT AS overlap_before, '{profiles}' AS retrieval_profiles,
  array_to_string(list_transform(ev, lambda e: e.page || ':' || e.line || ' ' || e.section || ' ' || e.content), chr(10)) AS evidence FROM {_ready(source)}"""


_PAGES = "array_to_string(pages, ',')"
_PAGED_ID = "'{0}:' || substr(sha256(document_id || '|{0}|' || section || '|' || " + _PAGES + " || '|' || content), 1, 24)"
_UNITS = r""", b0 AS (
  SELECT document_id, section, pos, page, line_index, text AS raw, trim(text) AS text, CASE WHEN is_heading THEN 'heading' WHEN regexp_matches(trim(text), '(?i)\b(?:warning|caution|danger|notice|important)\b') THEN 'warning'
         WHEN regexp_matches(trim(text), '(?i)^(?:before you begin|prerequisite|preparation|prepare|requirements?|required tools?)\b') THEN 'prerequisite' WHEN regexp_matches(trim(text), '^(?:\*\*)?\d+[.)](?:\*\*)?\s+') THEN 'ordered_list'
         WHEN trim(text) LIKE '|%' AND trim(text) LIKE '%|' THEN 'table' WHEN regexp_matches(trim(text), '(?i)\b(?:error code|failure code|blink(?:ing)? pattern|part number|model number)\b') THEN 'technical_identifier' ELSE 'narrative' END AS kind
  FROM l WHERE trim(text) <> '' AND section <> ''
), b1 AS (SELECT *, coalesce(lag(kind) OVER w <> kind OR lag(kind) OVER w = 'heading', true)::INT AS new FROM b0 WINDOW w AS (PARTITION BY document_id, section ORDER BY pos)
), b2 AS (SELECT *, document_id || '|' || section AS k, sum(new) OVER (PARTITION BY document_id, section ORDER BY pos) AS n FROM b1
), b3 AS (SELECT k, n, string_agg(text, chr(10) ORDER BY pos) AS text, list({'page': page, 'section': section, 'line': line_index, 'content': raw} ORDER BY pos) AS ev FROM b2 GROUP BY 1, 2
), sec AS (SELECT DISTINCT k, document_id, section FROM b2
)"""
_TEXT, _EV = "string_agg(text, chr(10) || chr(10) ORDER BY i)", "flatten(list(ev ORDER BY i))"
_SECTIONS = _packed("s", "b3", 2400) + f", sc AS (SELECT document_id, section, part, {_TEXT} AS content, {_EV} AS ev FROM sg JOIN sec USING (k) GROUP BY 1, 2, 3)"
_FAMILIES = (
    _packed("p", "b3", 6000)
    + f", pc AS (SELECT k || '|' || part AS k, document_id, section, {_TEXT} AS content, {_EV} AS ev FROM pg JOIN sec USING (k) GROUP BY k, part, document_id, section), cu AS (SELECT k || '|' || part AS k, i AS n, text, ev FROM pg)"
    + _packed("c", "cu", 1160)
    + f""", ct AS (SELECT k, part + 1 AS part, i, text, ev, sum(length(text) + 1) OVER (PARTITION BY k, part ORDER BY i DESC) AS back FROM cg
), cb AS (SELECT k, part, i, text, ev, true AS before FROM ct WHERE back <= 240 AND (k, part) IN (SELECT (k, part) FROM cg) UNION ALL SELECT k, part, i, text, ev, false FROM cg
), pi AS (SELECT k, document_id, section, {_PAGED_ID.format('parent_child')} AS parent FROM {_ready('pc')}
), cc AS (SELECT document_id, section, parent, part, {_TEXT} AS content, {_EV} AS ev, coalesce(sum(length(text) + 1) FILTER (before), 0) AS over FROM pi JOIN cb USING (k) GROUP BY k, document_id, section, parent, part)"""
)
_LINE = "{'page': page, 'section': section, 'line': line_index, 'content': text}"
_FRAMED = f""", fr AS (
  SELECT document_id, run, section, coalesce(needs, []) || coalesce(warned, []) AS frame, coalesce(ne, []) || coalesce(we, []) AS fev
  FROM (SELECT document_id, run, arg_min(section, ls) AS section FROM st GROUP BY 1, 2 HAVING count(*) >= 2) a
  LEFT JOIN (SELECT document_id, run, list('Warning: ' || text ORDER BY pos) AS warned, list({_LINE} ORDER BY pos) AS we FROM s3 WHERE warn AND trim(text) <> '' AND ls IS NOT NULL AND lb < ls GROUP BY 1, 2) b USING (document_id, run)
  LEFT JOIN (SELECT document_id, run + 1 AS run, list('Prerequisite: ' || text ORDER BY pos) AS needs, list({_LINE} ORDER BY pos) AS ne FROM s3 WHERE number IS NULL AND NOT (ls IS NOT NULL AND lb < ls) AND regexp_matches(trim(text), '(?i)^(?:before you begin|prerequisites?|preparation|prepare|requirements?|required tools?|you will need)\\b') GROUP BY 1, 2) c USING (document_id, run)
  WHERE section <> '' AND NOT regexp_matches(section, '(?i)\\b(?:licenses?|licen[cs]es?|trademarks?|copyright|terms\\s*(?:and|&)\\s*conditions|glossary)\\b')
), fs AS (SELECT document_id, run, number, content AS body, e, row_number() OVER (PARTITION BY document_id, run ORDER BY ls) AS i FROM st
), fw AS (
  SELECT document_id, run, section, frame, fev, greatest(200, 1700 - length(array_to_string(frame, chr(10))) - (len(frame) > 0)::INT) AS room, array_to_string(frame || list(number || '. ' || body ORDER BY i), chr(10)) AS content, fev || list(e ORDER BY i) AS ev
  FROM fr JOIN fs USING (document_id, run) GROUP BY document_id, run, section, frame, fev
), fx AS (SELECT document_id, run, i, room, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS j FROM (SELECT document_id, run, i, room, regexp_split_to_array(trim(body), '\\s+') AS ws FROM fw JOIN fs USING (document_id, run) WHERE length(body) > room)
), fy AS (
  SELECT *, 1 AS piece, length(w) + 1 AS used FROM fx WHERE j = 1
  UNION ALL SELECT x.*, CASE WHEN y.used + length(x.w) + 1 <= x.room THEN piece ELSE piece + 1 END, CASE WHEN y.used + length(x.w) + 1 <= x.room THEN y.used ELSE 0 END + length(x.w) + 1 FROM fy y JOIN fx x ON x.document_id = y.document_id AND x.run = y.run AND x.i = y.i AND x.j = y.j + 1
), fz AS (
  SELECT document_id, run, room, e, number, body, row_number() OVER (PARTITION BY document_id, run ORDER BY i, piece) AS i FROM (
    SELECT document_id, run, room, i, 0 AS piece, number, body, e FROM fw JOIN fs USING (document_id, run) WHERE length(body) <= room
    UNION ALL SELECT document_id, run, room, i, piece, number, t, e FROM (SELECT document_id, run, i, room, piece, string_agg(w, ' ' ORDER BY j) AS t FROM fy GROUP BY ALL) JOIN fs USING (document_id, run, i))
), fg AS (
  SELECT *, 0 AS part, 1 AS held, length(body) AS used FROM fz WHERE i = 1
  UNION ALL SELECT s.*, CASE WHEN {{fits}} THEN part ELSE part + 1 END, CASE WHEN {{fits}} THEN held ELSE 0 END + 1, CASE WHEN {{fits}} THEN used ELSE 0 END + length(s.body)
  FROM fg g JOIN fz s ON s.document_id = g.document_id AND s.run = g.run AND s.i = g.i + 1
), fi AS (SELECT document_id, run, section, frame, fev, {_PAGED_ID.format('procedure')} AS parent FROM {_ready('fw')}
), fc AS (
  SELECT document_id, section, parent, array_to_string(frame || list(number || '. ' || body ORDER BY i), chr(10)) AS content, fev || list(e ORDER BY i) AS ev
  FROM fi JOIN fg USING (document_id, run) GROUP BY document_id, run, section, frame, fev, part, parent
)""".replace("{fits}", "held < 4 AND used + length(s.body) <= s.room")
_SECTION_ROWS = _finished("sc", "section", "section", "bm25,vector")
_FAMILY_ROWS = _finished("pc", "parent_child", "parent", "context") + " UNION ALL " + _finished("cc", "parent_child", "child", "bm25,vector", "parent", "over")
_PROCEDURE_ROWS = _finished("fw", "procedure", "procedure", "context") + " UNION ALL " + _finished("fc", "procedure", "step_group", "bm25,vector", "parent")


def _recursive(sql: str) -> str:
    return "WITH RECURSIVE" + sql.removeprefix("WITH")


def _written(chunks: DataFrame) -> DataFrame:
    """Chunks without their places, with lists as texts."""
    said = F.transform("evidence", lambda e: F.concat(e["page"].cast("string"), F.lit(":"), e["line_start"].cast("string"), F.lit(" "), e["section"], F.lit(" "), e["content"]))
    return chunks.drop("at", "part").withColumns({c: F.array_join(c, ",") for c in ("pages", "retrieval_profiles")}).withColumn("evidence", F.array_join(said, "\n"))


@_query(_recursive(_BASE + _UNITS + _SECTIONS + _SECTION_ROWS))
def section_chunks(spark, sf_dir: str) -> DataFrame:
    """Section chunks of the parts' manuals."""
    return _written(K.section_chunks(_lines(spark, sf_dir)))


@_query(_recursive(_BASE + _UNITS + _FAMILIES + _FAMILY_ROWS))
def parent_child_chunks(spark, sf_dir: str) -> DataFrame:
    """Parent and child chunks of the parts' manuals."""
    return _written(K.parent_child_chunks(_lines(spark, sf_dir)))


@_query(_recursive(_STEPS + _FRAMED + _PROCEDURE_ROWS))
def procedure_step_groups(spark, sf_dir: str) -> DataFrame:
    """Procedure chunks of the parts' manuals."""
    return _written(K.procedure_chunks(S.procedures(_lines(spark, sf_dir))))


def strategies(line: DataFrame) -> DataFrame:
    """The chunks of all strategies of these lines, in no table yet."""
    return K.every_strategy(K.section_chunks(line), K.parent_child_chunks(line), K.procedure_chunks(S.procedures(line)), K.table_row_chunks(S.table_rows(line)), K.identifier_chunks(S.identifiers(line)))


def every_chunk(spark, sf_dir: str, evidence: int | None = None) -> DataFrame:
    """All chunks of the parts' manuals with their ordinals; with so much of their ``evidence`` if no more is read."""
    with held(_lines(spark, sf_dir)) as line:  # read by every strategy
        chunks = strategies(line)
        return K.with_ordinals(chunks.withColumn("evidence", F.slice("evidence", 1, evidence)) if evidence else chunks)


#: The rows of ``every_chunk`` in SQL: CTE ``every``.
EVERY = _recursive(_STEPS + _FRAMED + _UNITS + _SECTIONS + _FAMILIES + _ROWS.removeprefix(_BASE) + _IDENTS.removeprefix(_BASE)) + f""", trc AS (
  SELECT document_id, section, ev, array_to_string(list_transform(list_zip(headers, cells, true), lambda x: x[1] || ': ' || x[2]), ' | ') AS content FROM tr
), idc AS (SELECT document_id, section, ev, context AS content FROM idn
), every AS ({_SECTION_ROWS} UNION ALL {_FAMILY_ROWS} UNION ALL {_PROCEDURE_ROWS} UNION ALL {_finished("trc", "table_row", "table_row", "exact,bm25,vector")} UNION ALL {_finished("idc", "exact", "identifier", "exact,bm25")})
"""


@_query(EVERY + ", p AS (SELECT strategy, kind, unnest(string_split(retrieval_profiles, ',')) AS profile FROM every) SELECT strategy, kind, " + ", ".join(f"nullif(count(*) FILTER (profile = '{p}'), 0) AS {p}" for p in ("exact", "bm25", "vector", "context")) + " FROM p GROUP BY 1, 2")
def chunk_report(spark, sf_dir: str) -> DataFrame:
    """Chunks by strategy and profile."""
    return every_chunk(spark, sf_dir).select("strategy", "kind", F.explode("retrieval_profiles").alias("profile")).groupBy("strategy", "kind").pivot("profile", ["exact", "bm25", "vector", "context"]).count()


@_query("""
WITH c AS (
  SELECT p_partkey AS id, p_name AS content, CASE WHEN p_partkey % 7 <> 0 THEN p_type END AS model, CASE WHEN p_partkey % 19 <> 0 THEN 'v1' END AS version, CASE WHEN p_partkey % 5 = 0 THEN [2, 1] ELSE [1, 2] END AS pages, CASE WHEN p_partkey % 11 = 0 THEN 9 WHEN p_partkey % 5 = 0 THEN 2 ELSE 1 END AS page,
         CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 17 = 0 THEN [3] ELSE [1] END AS ev FROM part
)
SELECT id, array_to_string(list_filter([CASE WHEN model IS NULL THEN 'unresolved_model' END, CASE WHEN version IS NULL THEN 'unresolved_version' END, CASE WHEN pages <> list_sort(pages) THEN 'pages_not_sorted' END, CASE WHEN page <> pages[1] THEN 'page_not_first' END,
  CASE WHEN ev IS NULL THEN 'no_evidence' END, CASE WHEN ev[1] = 3 THEN 'evidence_page_unknown' END], lambda x: x IS NOT NULL), ',') AS reasons FROM c
""")
def chunk_quality_gate(spark, sf_dir: str) -> DataFrame:
    """Faulty chunks made of parts, with the reasons why they can't be cited."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(
        k.alias("id"), F.col("p_name").alias("content"), F.when(k % 7 != 0, F.col("p_type")).alias("model"), F.when(k % 19 != 0, "v1").alias("version"), F.when(k % 5 == 0, F.array(F.lit(2), F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2))).alias("pages"),
        F.when(k % 11 == 0, 9).when(k % 5 == 0, 2).otherwise(1).alias("page"),
        F.when(k % 13 == 0, None).otherwise(F.array(F.struct(F.when(k % 17 == 0, 3).otherwise(1).alias("page"), F.lit("manual.pdf").alias("source_file")))).alias("evidence"),
    )
    return K.violations(p).select("id", F.array_join("reasons", ",").alias("reasons"))
