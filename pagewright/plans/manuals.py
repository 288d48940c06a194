"""Manuals made of the given tables: documents as pages, and service manuals of the parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..runtime import table

#: A manual of documents holds so many document ids at most, so its windows are bounded.
VOLUME = 1000


def document_pages(spark, sf_dir: str) -> DataFrame:
    """Documents as pages: a manual is a source's volume, a page a document."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat_ws("/", "source", F.floor(F.col("doc_id") / VOLUME).cast("string")).alias("document_id"), F.col("doc_id").alias("page_seq"), F.col("doc_id").alias("page_number"), "text")


DOCUMENT_PAGES = f"SELECT concat_ws('/', source, (doc_id // {VOLUME})::VARCHAR) AS document_id, doc_id AS page_seq, doc_id AS page_number, text FROM documents"

#: Lines of the parts' manuals, in SQL that both engines run: ``{part}`` is the table.
MANUAL_LINES = """
WITH p AS (
  SELECT concat(p_brand, '/', CAST(floor(p_partkey / 20000) AS INT)) AS manual, p_type AS section, p_partkey, p_name, p_size,
         row_number() OVER (PARTITION BY p_brand, floor(p_partkey / 20000), p_type ORDER BY p_partkey) AS n FROM {part}
), m AS (SELECT DISTINCT manual FROM p
), s AS (SELECT DISTINCT manual, section FROM p
), body AS (
  SELECT manual, '' AS section, 0 AS kind, 0 AS n, concat('# ', manual, ' service manual') AS text FROM m
  UNION ALL SELECT manual, '', 1, 0, '## Contents' FROM m
  UNION ALL SELECT manual, '', 2, row_number() OVER (PARTITION BY manual ORDER BY section), concat(section, ' .......... ', CAST(row_number() OVER (PARTITION BY manual ORDER BY section) AS INT)) FROM s
  UNION ALL SELECT manual, section, 1, 0, concat('## ', section) FROM s
  UNION ALL SELECT manual, section, 2, 0, 'Before you begin, unplug the unit.' FROM s
  UNION ALL SELECT manual, section, 3, n, concat(CAST(n AS INT), '. Check ', p_name, CASE WHEN p_size % 7 = 0 THEN ' WARNING: hot surface.' ELSE '' END) FROM p WHERE n <= 6
  UNION ALL SELECT manual, section, 4, 0, '' FROM s
  UNION ALL SELECT manual, section, 5, 0, '| Code | Part | Size |' FROM s
  UNION ALL SELECT manual, section, 5, 1, '| --- | --- | --- |' FROM s
  UNION ALL SELECT manual, section, 6, n, concat('| E', CAST(p_size AS INT), ' | ', p_name, ' | ', CAST(p_size AS INT), ' |') FROM p
  UNION ALL SELECT manual, section, 7, n, concat('Spare part number M', lpad(CAST(p_partkey AS VARCHAR(12)), 5, '0'), '-001 fits error code [', CAST(p_size % 10 AS INT), ',', CAST(n % 10 AS INT), '].') FROM p
  UNION ALL SELECT manual, section, 8, n, concat('#### ', p_name, ' notes') FROM p WHERE n % 10 = 0
  UNION ALL SELECT manual, section, 9, n, concat(p_name, ' is serviced once a year.') FROM p WHERE n % 10 = 0
), placed AS (SELECT manual, text, row_number() OVER (PARTITION BY manual ORDER BY section, kind, n) - 1 AS spot FROM body
), paged AS (SELECT manual, CAST(floor(spot / 40) + 1 AS INT) AS page, CAST(spot % 40 + 1 AS INT) AS line_index, text FROM placed)
SELECT manual AS document_id, page, line_index, text FROM paged
UNION ALL SELECT DISTINCT manual, page, 0, concat(manual, ' handbook') FROM paged
UNION ALL SELECT DISTINCT manual, page, 41, concat('Page ', page) FROM paged
"""


#: The parts' manuals as documents, in SQL that both engines run.
MANUAL_DOCUMENTS = """
SELECT document_id, concat(document_id, ' service manual') AS title, min(p_brand) AS manufacturer, min(p_type) AS model, concat('edition ', CAST(count(*) AS INT)) AS version, concat('https://manuals.example/', document_id) AS source_url
FROM (SELECT *, concat(p_brand, '/', CAST(floor(p_partkey / 20000) AS INT)) AS document_id FROM {part}) GROUP BY document_id
"""


def manual_documents(spark, sf_dir: str) -> DataFrame:
    """document_id, title, manufacturer, model, version, source_url of the parts' manuals."""
    return spark.sql(MANUAL_DOCUMENTS, part=table(spark, sf_dir, "part"))


def manual_lines(spark, sf_dir: str) -> DataFrame:
    """document_id, page, line_index, text."""
    return spark.sql(MANUAL_LINES, part=table(spark, sf_dir, "part"))


def manual_pages(spark, sf_dir: str) -> DataFrame:
    """The parts' manuals as pages."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_index", "text"))), lambda x: x["text"]), "\n")
    return manual_lines(spark, sf_dir).groupBy("document_id", "page").agg(text.alias("text")).select("document_id", F.col("page").alias("page_seq"), F.col("page").alias("page_number"), "text")


MANUAL_PAGES = "SELECT document_id, page AS page_seq, page AS page_number, string_agg(text, chr(10) ORDER BY line_index) AS text FROM (" + MANUAL_LINES.replace("{part}", "part") + ") GROUP BY 1, 2, 3"
