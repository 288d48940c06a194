"""Registered queries of scopes, fetches, expansions, citations and links, over orders as queries and parts as chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import assets as A, evidence as E, retrieval as R, sessions as S
from ..runtime import table
from ..sources import tables as X

QUERIES: dict = {}
ORACLES: dict = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _sql(spark, sf_dir: str, text: str) -> DataFrame:
    """Rows that both engines make alike."""
    names = [t for t in ("part", "lineitem", "conversations") if "{" + t + "}" in text]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in names})


def _duck(text: str) -> str:
    for t in ("part", "lineitem", "conversations"):
        text = text.replace("{" + t + "}", t)
    return text


_CHUNKS = "SELECT p_partkey AS chunk_id, p_brand AS manufacturer, p_type AS model, concat('d', p_size % 9) AS document_id FROM {part}"
_FILTERS = "SELECT DISTINCT concat(p_brand, p_size % 4) AS filter_id, CASE WHEN p_size % 4 < 3 THEN p_brand END AS manufacturer, CASE WHEN p_size % 4 IN (1, 3) THEN 'SMALL' END AS model, CASE WHEN p_size % 4 = 2 THEN 'd1' END AS document_id FROM {part}"


@_query(f"""SELECT filter_id, chunk_id FROM ({_duck(_FILTERS)}) f JOIN ({_duck(_CHUNKS)}) c
ON (f.manufacturer IS NULL OR f.manufacturer = c.manufacturer) AND (f.model IS NULL OR f.model = c.model) AND (f.document_id IS NULL OR f.document_id = c.document_id)""")
def metadata_filter(spark, sf_dir: str) -> DataFrame:
    """Parts that each metadata filter lets through."""
    return X.matching(_sql(spark, sf_dir, _FILTERS), _sql(spark, sf_dir, _CHUNKS), ["manufacturer", "model", "document_id"])


_ASKED = "SELECT conv_id AS session, turn, text AS query, CASE WHEN turn % 3 = 0 THEN concat('m', conv_id % 4) END AS manufacturer, CASE WHEN turn % 2 = 0 THEN concat('x', length(text) % 3) END AS model FROM {conversations} WHERE role = 'user'"
_SCOPES = "SELECT conv_id AS session, concat('m', conv_id % 5) AS manufacturer, CASE WHEN conv_id % 2 = 0 THEN 'x1' END AS model FROM {conversations} WHERE conv_id % 7 <> 0 GROUP BY conv_id"


@_query(f"""SELECT q.session, turn, coalesce(q.manufacturer, s.manufacturer) AS manufacturer, coalesce(q.model, s.model) AS model,
  concat_ws(',', CASE WHEN q.manufacturer <> s.manufacturer THEN 'manufacturer' END, CASE WHEN q.model <> s.model THEN 'model' END) AS conflict
FROM ({_duck(_ASKED)}) q LEFT JOIN ({_duck(_SCOPES)}) s ON q.session = s.session""")
def scope_merge(spark, sf_dir: str) -> DataFrame:
    """User turns with what their session's scope adds, and the fields that disagree."""
    m = X.merged_scope(_sql(spark, sf_dir, _ASKED), _sql(spark, sf_dir, _SCOPES), ["manufacturer", "model"])
    return m.select("session", "turn", "manufacturer", "model", F.array_join("conflict", ",").alias("conflict"))


@_query("""WITH w AS (SELECT l_orderkey AS request, list(l_partkey * 2 ORDER BY l_linenumber, l_partkey) AS ids FROM lineitem GROUP BY 1),
u AS (SELECT request, unnest(range(len(ids))) AS place, unnest(ids) AS p_partkey FROM w)
SELECT request, place::INT AS place, p_partkey, p_name FROM u JOIN part USING (p_partkey)""")
def fetch_by_ids(spark, sf_dir: str) -> DataFrame:
    """Parts by lists of ids, in their order; unknown ids are left out."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_partkey") * 2).alias("id")))), lambda x: x["id"])
    wanted = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("request")).agg(items.alias("ids"))
    return X.fetched(table(spark, sf_dir, "part").select("p_partkey", "p_name"), wanted, "p_partkey").select("request", "place", "p_partkey", "p_name")


_RANK = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)"
_HITS = f"SELECT l_orderkey AS query_id, l_partkey AS chunk_id, {_RANK} AS rank, 1.0D / {_RANK} AS score FROM {{lineitem}}"
_DUCK_HITS = _duck(_HITS).replace("1.0D", "1.0::DOUBLE")


@_query(f"""WITH h AS ({_DUCK_HITS}), p AS (
  SELECT query_id, rank, 0 AS side, chunk_id FROM h
  UNION ALL SELECT query_id, rank, 1, chunk_id % 100 FROM h WHERE chunk_id % 3 = 0 AND chunk_id IN (SELECT p_partkey FROM part)
), o AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY min(struct_pack(r := rank, s := side))) AS place FROM p GROUP BY 1, 2)
SELECT query_id, chunk_id, place::INT AS place FROM o WHERE chunk_id IN (SELECT p_partkey FROM part)""")
def parent_expansion(spark, sf_dir: str) -> DataFrame:
    """Each hit and its parent, once a query in order of first mention."""
    chunks = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_id"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey") % 100).alias("parent_chunk_id"))
    return R.with_parents(_sql(spark, sf_dir, _HITS), chunks)


@_query(f"""WITH h AS ({_DUCK_HITS}), b AS (
  SELECT query_id, chunk_id, score, rank, 0 AS tier FROM h WHERE chunk_id % 4 = 0 UNION ALL SELECT query_id, chunk_id % 50 AS chunk_id, score, rank, 1 FROM h
), o AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY tier, rank) = 1)
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY tier, rank)::INT AS rank FROM o QUALIFY rank <= 5""".replace("QUALIFY rank <= 5", "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY tier, o.rank) <= 5").replace("ORDER BY tier, rank)::INT", "ORDER BY tier, o.rank)::INT"))
def combined_lexical(spark, sf_dir: str) -> DataFrame:
    """Exact hits before lexical ones, each chunk once."""
    h = _sql(spark, sf_dir, _HITS)
    return R.combined(h.where("chunk_id % 4 = 0"), h.withColumn("chunk_id", F.col("chunk_id") % 50), 5)


@_query(f"""WITH h AS ({_DUCK_HITS}), b AS (SELECT query_id, chunk_id % 20 AS chunk_id, rank, 0 AS t FROM h WHERE rank <= 3 UNION ALL SELECT query_id, chunk_id % 30, rank, 1 FROM h WHERE rank >= 2
), o AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY t, rank) = 1)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY t, rank)::INT AS place FROM o""")
def evidence_merge(spark, sf_dir: str) -> DataFrame:
    """Two evidence lists of each order as one, each chunk once."""
    h = _sql(spark, sf_dir, _HITS)
    return E.merged(h.where("rank <= 3").select("query_id", (F.col("chunk_id") % 20).alias("chunk_id"), "rank"), h.where("rank >= 2").select("query_id", (F.col("chunk_id") % 30).alias("chunk_id"), "rank"))


_EVIDENCE = f"SELECT l_orderkey AS query_id, l_partkey AS chunk_id, {_RANK} AS rank, CASE WHEN l_partkey % 7 > 0 THEN concat('d', l_suppkey) END AS document_id, CASE WHEN l_partkey % 11 > 0 THEN l_partkey % 5 END AS page, CASE l_partkey % 13 WHEN 0 THEN '' ELSE concat('s', l_partkey % 6) END AS section, concat('Manual ', l_suppkey) AS document_title, concat('text ', l_partkey) AS content FROM {{lineitem}}"


@_query(f"SELECT query_id, count(*) AS hits, avg((document_id IS NOT NULL AND coalesce(page, 0) <> 0 AND section <> '')::INT) AS ready_rate FROM ({_duck(_EVIDENCE)}) GROUP BY 1")
def citation_ready_rate(spark, sf_dir: str) -> DataFrame:
    """The share of each order's hits that can be cited."""
    return E.citation_ready(_sql(spark, sf_dir, _EVIDENCE))


@_query(f"""WITH e AS ({_duck(_EVIDENCE)}), r AS (SELECT DISTINCT query_id, document_id, page FROM e WHERE rank % 2 = 0)
SELECT query_id, chunk_id, rank FROM e WHERE EXISTS (SELECT 1 FROM r WHERE r.query_id = e.query_id AND r.document_id = e.document_id AND r.page = e.page)""")
def open_page(spark, sf_dir: str) -> DataFrame:
    """The evidence on the pages that are asked for."""
    e = _sql(spark, sf_dir, _EVIDENCE)
    return E.opened_page(e, e.where("rank % 2 = 0")).select("query_id", "chunk_id", "rank")


@_query(f"SELECT query_id, arg_min(content, rank) AS answer FROM ({_duck(_EVIDENCE)}) GROUP BY 1")
def verbatim_answers(spark, sf_dir: str) -> DataFrame:
    """The first evidence of each order as its answer."""
    return E.verbatim_answers(_sql(spark, sf_dir, _EVIDENCE))


_ANSWERS = "SELECT l_orderkey AS query_id, concat('Try it [source:', min(l_partkey), '] or [source:', max(l_partkey + l_partkey % 2), '].') AS text FROM {lineitem} WHERE l_orderkey % 5 > 0 GROUP BY l_orderkey UNION ALL SELECT DISTINCT l_orderkey, 'No source.' FROM {lineitem} WHERE l_orderkey % 5 = 0"


@_query(f"""WITH a AS ({_duck(_ANSWERS)}), k AS (SELECT l_orderkey AS query_id, list(DISTINCT l_partkey::VARCHAR) AS ids FROM lineitem GROUP BY 1)
SELECT query_id, len(regexp_extract_all(text, '\\[source:([^\\]]+)\\]', 1)) > 0 AND len(list_filter(regexp_extract_all(text, '\\[source:([^\\]]+)\\]', 1), lambda x: NOT list_contains(ids, x))) = 0 AS citation_ok FROM a JOIN k USING (query_id)""")
def answer_citations(spark, sf_dir: str) -> DataFrame:
    """Answers whose markers are all known evidence, and at least one."""
    ids = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("query_id")).agg(F.collect_set(F.col("l_partkey").cast("string")).alias("evidence_ids"))
    return E.cited(_sql(spark, sf_dir, _ANSWERS).join(ids, "query_id")).select("query_id", "citation_ok")


@_query(f"""WITH e AS (SELECT query_id, chunk_id, arg_min('[' || document_title || ' · p. ' || chunk_id % 5 || ' · s' || chunk_id % 6 || ']', rank) AS label FROM ({_duck(_EVIDENCE)}) GROUP BY 1, 2), a AS ({_duck(_ANSWERS)}
), m AS (SELECT *, regexp_extract(text, 'it \\[source:([0-9]+)\\]', 1) AS one, regexp_extract(text, 'or \\[source:([0-9]+)\\]', 1) AS two FROM a)
SELECT m.query_id, CASE WHEN one = '' THEN text ELSE 'Try it ' || coalesce(x.label, '[source:' || one || ']') || ' or ' || coalesce(y.label, '[source:' || two || ']') || '.' END AS answer
FROM m LEFT JOIN e x ON x.query_id = m.query_id AND x.chunk_id::VARCHAR = one LEFT JOIN e y ON y.query_id = m.query_id AND y.chunk_id::VARCHAR = two""")
def expanded_citations(spark, sf_dir: str) -> DataFrame:
    """Answers with their markers written out."""
    e = _sql(spark, sf_dir, _EVIDENCE).withColumns({"page": F.col("chunk_id") % 5, "section": F.concat(F.lit("s"), (F.col("chunk_id") % 6).cast("string"))})
    return E.expanded(_sql(spark, sf_dir, _ANSWERS), e).select("query_id", "answer")


_ITEMS = "SELECT l_suppkey AS chunk_id, l_orderkey * 10 + l_linenumber AS place, concat('f', l_partkey % 3) AS source_file, l_partkey % 4 AS page, 's' AS section, concat('c', l_partkey % 5) AS content FROM {lineitem}"


@_query(f"SELECT chunk_id, min(place) AS place, source_file, page, content FROM ({_duck(_ITEMS)}) GROUP BY ALL")
def evidence_dedupe(spark, sf_dir: str) -> DataFrame:
    """Evidence of chunks without repeats."""
    return E.distinct_evidence(_sql(spark, sf_dir, _ITEMS)).select("chunk_id", "place", "source_file", "page", "content")


_OCR = "SELECT l_orderkey AS document_id, l_linenumber % 3 AS page, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey AS place, CASE WHEN l_partkey % 7 = 0 THEN ' ' ELSE concat('P', l_partkey) END AS text, (l_partkey % 100) / 100.0D AS confidence FROM {lineitem}"


_RECOGNISED = """SELECT document_id, page, coalesce(string_agg(text, chr(10) ORDER BY place, text) FILTER (trim(text) <> ''), '') AS text, coalesce(avg(confidence) FILTER (trim(text) <> ''), 0) AS confidence, count(*) FILTER (trim(text) <> '') AS items
FROM ({items}) GROUP BY 1, 2"""
_OCR_DUCK = _duck(_OCR).replace("100.0D", "100.0::DOUBLE")


@_query(f"SELECT * REPLACE (round(confidence, 6) AS confidence) FROM ({_RECOGNISED.format(items=_OCR_DUCK)})")
def ocr_pages(spark, sf_dir: str) -> DataFrame:
    """Recognised items as pages; a page of blank items is empty."""
    return X.ocr_pages(_sql(spark, sf_dir, _OCR)).withColumn("confidence", F.round("confidence", 6))


# sums of these confidences are exact
_SMALL = _OCR.replace("(l_partkey % 100) / 100.0D", "(l_partkey % 64) / 64.0D")
_AGAIN = _SMALL.replace("concat('P', l_partkey)", "concat('Q', l_suppkey)").replace("(l_partkey % 64)", "(l_suppkey % 64)")


@_query(f"""WITH a AS ({_RECOGNISED.format(items=_duck(_SMALL).replace('64.0D', '64.0::DOUBLE'))}), b AS ({_RECOGNISED.format(items=_duck(_AGAIN).replace('64.0D', '64.0::DOUBLE'))}), c AS (SELECT a.*, b.text AS t, b.confidence AS f, b.items AS i, a.confidence < 0.85 AND b.confidence > a.confidence AS better FROM a JOIN b USING (document_id, page))
SELECT document_id, page, CASE WHEN better THEN t ELSE text END AS text, round(CASE WHEN better THEN f ELSE confidence END, 6) AS confidence, CASE WHEN better THEN i ELSE items END AS items, CASE WHEN better THEN 'small' END AS fallback_from FROM c""")
def ocr_fallback(spark, sf_dir: str) -> DataFrame:
    """Unsure pages as a second model recognised them, where it is surer."""
    first, second = X.ocr_pages(_sql(spark, sf_dir, _SMALL)), X.ocr_pages(_sql(spark, sf_dir, _AGAIN))
    return X.with_fallback(first, second, "small").withColumn("confidence", F.round("confidence", 6))


@_query("""WITH p AS (SELECT DISTINCT l_suppkey AS document_id, l_partkey AS page FROM lineitem), o AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page) - 1 AS i, count(*) OVER (PARTITION BY document_id) AS n, document_id % 5 + 1 AS want FROM p WHERE document_id % 10 > 0)
SELECT document_id, page FROM o WHERE i % greatest(1, n // want) = 0 AND i / greatest(1, n // want) < want""")
def ocr_sample(spark, sf_dir: str) -> DataFrame:
    """Pages at equal strides of each document, for a benchmark of recognition."""
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("document_id"), F.col("l_partkey").alias("page")).distinct()
    wanted = pages.where("document_id % 10 > 0").select("document_id", (F.col("document_id") % 5 + 1).alias("count")).distinct()
    return X.strided_sample(pages, wanted)


_LACKING = "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'My printer will not print' ELSE concat('How to use ', p_name) END AS query, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS manufacturer, CASE WHEN p_partkey % 5 < 3 THEN p_type END AS model FROM {part}"
_PANEL, _ASK = E.DETAIL, {k: v.replace("'", "''") for k, v in E.QUESTIONS.items()}


@_query(f"""WITH r AS ({_duck(_LACKING)}), m AS (SELECT id, list_filter([CASE WHEN manufacturer = '' THEN 'manufacturer' END, CASE WHEN model IS NULL THEN 'model' END, CASE WHEN id % 3 = 0 THEN '{_PANEL}' END], lambda x: x IS NOT NULL) AS missing FROM r)
SELECT id, array_to_string(missing, '|') AS missing, CASE array_to_string(missing, '|') WHEN '' THEN NULL {" ".join(f"WHEN '{'|'.join(k)}' THEN '{v}'" for k, v in _ASK.items())} ELSE '{E.NO_QUESTION}' END AS question FROM m""")
def observation_questions(spark, sf_dir: str) -> DataFrame:
    """What reports about parts lack, and the question that asks for it."""
    return E.missing_observations(_sql(spark, sf_dir, _LACKING), detail=True).select("id", F.array_join("missing", "|").alias("missing"), "question")


@_query("""SELECT p_partkey AS chunk_id, p_name AS text, 'd' || p_size AS document_id, p_brand AS manufacturer, p_type AS model, 'v1' AS document_version, lower(p_type) AS category, p_name AS document_title, 'http://x/' || p_partkey AS source_url,
  CASE WHEN p_partkey % 3 = 0 THEN 'code' END AS identifier_kind, NULL::VARCHAR AS normalized_value FROM part""")
def payload_rows(spark, sf_dir: str) -> DataFrame:
    """Parts as chunks, flattened for a vector store."""
    k = F.col("p_partkey")
    doc = F.struct(F.concat(F.lit("d"), F.col("p_size").cast("string")).alias("document_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("manufacturer"), F.col("p_type").alias("model"), F.lit("v1").alias("version"), F.concat(F.lit("http://x/"), k.cast("string")).alias("source_url"))
    meta = F.when(k % 3 == 0, F.create_map(F.lit("identifier_kind"), F.lit("code"))).otherwise(F.create_map().cast("map<string,string>"))
    return X.payload(table(spark, sf_dir, "part").select(k.alias("chunk_id"), F.col("p_name").alias("content"), doc.alias("document"), F.concat(F.lit("data/raw/"), F.lower("p_type"), F.lit("/x.pdf")).alias("source_file"), meta.alias("metadata")))


_SHOWN = "SELECT concat('a', l_partkey % 200) AS asset_id, l_suppkey AS document_id, l_linenumber AS page FROM {lineitem}"
_PAGES = "SELECT p_partkey AS chunk_id, p_partkey % 90 + 1 AS document_id, array(p_size % 7, p_size % 7 + 1) AS pages FROM {part}"


@_query(f"SELECT DISTINCT asset_id, chunk_id, page FROM ({_duck(_SHOWN)}) o JOIN (SELECT chunk_id, document_id, unnest(pages) AS page FROM ({_duck(_PAGES).replace('array(p_size % 7, p_size % 7 + 1)', '[p_size % 7, p_size % 7 + 1]')})) c USING (document_id, page)")
def page_chunk_links(spark, sf_dir: str) -> DataFrame:
    """The chunks on the pages that show an asset."""
    return A.chunk_links(_sql(spark, sf_dir, _SHOWN), _sql(spark, sf_dir, _PAGES))


@_query("""WITH b AS (SELECT DISTINCT 'a' || l_partkey % 200 AS asset_id, l_suppkey AS document_id, l_linenumber AS page, l_partkey % 3 AS x FROM lineitem WHERE l_orderkey % 3 > 0), n AS (SELECT asset_id, document_id, page, count(*) AS boxes, min(x)::DOUBLE AS first_x FROM b GROUP BY 1, 2, 3)
SELECT DISTINCT asset_id, document_id, page, coalesce(boxes, 0) AS boxes, first_x FROM (SELECT 'a' || l_partkey % 200 AS asset_id, l_suppkey AS document_id, l_linenumber AS page FROM lineitem) LEFT JOIN n USING (asset_id, document_id, page)""")
def placements(spark, sf_dir: str) -> DataFrame:
    """Where each asset stands on its pages."""
    x = (F.col("l_partkey") % 3).cast("double")
    rows = table(spark, sf_dir, "lineitem").where("l_orderkey % 3 > 0").select(F.concat(F.lit("a"), (F.col("l_partkey") % 200).cast("string")).alias("asset_id"), F.col("l_suppkey").alias("document_id"), F.col("l_linenumber").alias("page"), x.alias("x0"), x.alias("y0"), (x + 1).alias("x1"), (x + 1).alias("y1"))
    found = A.placed(_sql(spark, sf_dir, _SHOWN).distinct(), rows)
    return found.select("asset_id", "document_id", "page", F.size("boxes").cast("long").alias("boxes"), F.try_element_at("boxes", F.lit(1))["x0"].alias("first_x"))


_REPORTS = "SELECT conv_id, turn, text AS query, CASE WHEN turn % 2 = 0 THEN 'red light' END AS observed, concat('o', turn % 3) AS chosen FROM {conversations} WHERE role = 'user'"


@_query(f"""SELECT conv_id, turn, concat_ws(' ', query, 'Observed: ' || observed, 'Selected result: ' || CASE chosen WHEN 'o0' THEN 'yes' WHEN 'o1' THEN 'No, it stays' END) AS composed FROM ({_duck(_REPORTS)})""")
def composed_queries(spark, sf_dir: str) -> DataFrame:
    """User turns as queries with what was observed and the option that was chosen."""
    options = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(label).alias("label"), F.lit(value).alias("value")) for i, label, value in (("o0", "Yes", "yes"), ("o1", "No, it stays", None))])
    r = _sql(spark, sf_dir, _REPORTS).withColumn("selected", S.resolved_option(options, F.col("chosen")))
    return E.composed_query(r).select("conv_id", "turn", "composed")
