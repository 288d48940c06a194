"""Registered queries of retrieval and its evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..functions.text import tokens
from ..operators import percentiles, postings as P, retrieval as R
from ..operators.embedding import embedded
from ..runtime import cut_lineage, shared_folder, table

QUERIES: dict = {}
ORACLES: dict = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _chunks(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("body"), F.substring_index("text", "\n", 1).alias("section"), "lang")


def _asked(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_TOKENS = "regexp_extract_all(lower({}), '[a-z0-9]+(?:[-_][a-z0-9]+)*')"
_BM25 = f"""
WITH q AS (SELECT item_id AS query_id, unnest({_TOKENS.format('text')}) AS token FROM benchmark
), qt AS (SELECT query_id, token, count(*) AS times FROM q GROUP BY 1, 2
), d AS (
  SELECT 'body' AS field, doc_id, {_TOKENS.format('text')} AS t FROM documents
  UNION ALL SELECT 'section', doc_id, {_TOKENS.format("split_part(text, chr(10), 1)")} FROM documents
), s AS (SELECT field, count(*) AS n, greatest(avg(len(t)), 1.0) AS mean FROM d GROUP BY 1
), h AS (
  SELECT field, doc_id, len, token, count(*) AS tf FROM (SELECT field, doc_id, len(t) AS len, unnest(t) AS token FROM d)
  WHERE token IN (SELECT token FROM qt) GROUP BY 1, 2, 3, 4
), f AS (SELECT field, token, count(*) AS df FROM h GROUP BY 1, 2
), r AS (
  SELECT query_id, doc_id AS chunk_id,
         round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score
  FROM h JOIN f USING (field, token) JOIN s USING (field) JOIN qt USING (token) GROUP BY 1, 2
), bm AS (
  SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM r QUALIFY rank <= 5
), lab AS (SELECT item_id AS query_id, doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))
"""


@_query(_BM25 + "SELECT query_id, chunk_id, score, rank FROM bm")
def bm25_top5(spark, sf_dir: str) -> DataFrame:
    """Fielded BM25 (whole text and first line) of each benchmark passage over all documents."""
    queries = _asked(spark, sf_dir).withColumn("terms", tokens(F.col("text")))
    return R.bm25(_chunks(spark, sf_dir), queries, 5, fields=("body", "section"))


@_query(_BM25 + "SELECT query_id, chunk_id, score, rank FROM bm")
def bm25_indexed(spark, sf_dir: str) -> DataFrame:
    """The same hits from an inverted index on disk, to which every tenth document is added later."""
    path = f"{shared_folder(spark)}/indexes/{uuid.uuid4().hex}"
    chunks, late = _chunks(spark, sf_dir), F.coalesce(F.col("chunk_id") % 10 == 3, F.lit(False))
    for part in (chunks.where(~late), chunks.where(late)):
        P.add_documents(part, path, fields=("body", "section"))
    return P.search(spark, path, _asked(spark, sf_dir).withColumn("terms", tokens(F.col("text"))), 5)


@_query(f"""
WITH q AS (SELECT item_id * 10 + l.k AS query_id, lang, unnest({_TOKENS.format('text')}) AS token FROM benchmark, (SELECT lang, (row_number() OVER (ORDER BY lang))::BIGINT AS k FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)) l
), qt AS (SELECT query_id, lang, token, count(*) AS times FROM q GROUP BY 1, 2, 3
), d AS (SELECT lang, doc_id, {_TOKENS.format('text')} AS t FROM documents
), s AS (SELECT lang, count(*) AS n, greatest(avg(len(t)), 1.0) AS mean FROM d GROUP BY 1
), h AS (SELECT lang, doc_id, len, token, count(*) AS tf FROM (SELECT lang, doc_id, len(t) AS len, unnest(t) AS token FROM d) WHERE token IN (SELECT token FROM qt) GROUP BY 1, 2, 3, 4
), f AS (SELECT lang, token, count(*) AS df FROM h GROUP BY 1, 2
), r AS (
  SELECT query_id, doc_id AS chunk_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score
  FROM h JOIN f USING (lang, token) JOIN s USING (lang) JOIN qt USING (lang, token) GROUP BY 1, 2
)
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM r QUALIFY rank <= 5
""")
def bm25_scoped(spark, sf_dir: str) -> DataFrame:
    """BM25 of each passage inside each language, with the language's own statistics."""
    from pyspark.sql import Window

    langs = table(spark, sf_dir, "documents").where("lang IS NOT NULL").select("lang").distinct().withColumn("k", F.row_number().over(Window.orderBy("lang")))
    queries = _asked(spark, sf_dir).join(F.broadcast(langs)).select((F.col("query_id") * 10 + F.col("k")).alias("query_id"), "lang", tokens(F.col("text")).alias("terms"))
    return R.bm25(_chunks(spark, sf_dir), queries, 5, scope=["lang"])


def _labels(spark, sf_dir) -> DataFrame:
    """Documents that hold a passage word for word."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return R.holding(docs, _asked(spark, sf_dir).withColumnRenamed("text", "passage"))


@_query(_BM25 + """, m AS (
  SELECT l.query_id, count(bm.rank)::DOUBLE / count(*) AS recall, coalesce(1.0 / min(bm.rank), 0)::DOUBLE AS rr FROM (SELECT DISTINCT * FROM lab) l LEFT JOIN bm USING (query_id, chunk_id) GROUP BY 1
), a AS (
  SELECT item_id AS query_id, item_id % 3 AS kind, m.recall, m.rr, (m.recall IS NULL) AS should_abstain, (t.query_id IS NULL) AS abstained
  FROM benchmark LEFT JOIN m ON item_id = m.query_id LEFT JOIN (SELECT DISTINCT query_id FROM bm) t ON item_id = t.query_id
)
SELECT kind, count(*) AS cases, count(recall) AS labelled, round(avg(recall), 6) AS recall_at_5, round(avg(rr), 6) AS mrr,
       round(avg((abstained = should_abstain)::INT), 6) AS abstention_accuracy,
       count(*) FILTER (recall < 1) AS expected_chunk_not_in_top5, count(*) FILTER (abstained <> should_abstain) AS wrong_abstention
FROM a GROUP BY GROUPING SETS ((kind), ())
""")
def retrieval_metrics(spark, sf_dir: str) -> DataFrame:
    """Recall, MRR, abstention accuracy and failures by kind of case and over all (null kind)."""
    asked, hits = _asked(spark, sf_dir), bm25_top5(spark, sf_dir)
    scores = R.recall_and_rank(hits, _labels(spark, sf_dir))
    cases = asked.join(scores, "query_id", "left").join(R.abstentions(asked, hits), "query_id").withColumn("kind", F.col("query_id") % 3)
    right = F.col("abstained") == F.col("recall").isNull()
    return cases.groupingSets([("kind",), ()], "kind").agg(
        F.count("*").alias("cases"), F.count("recall").alias("labelled"), F.round(F.avg("recall"), 6).alias("recall_at_5"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"),
        F.round(F.avg(right.cast("int")), 6).alias("abstention_accuracy"), F.count_if(F.col("recall") < 1).alias("expected_chunk_not_in_top5"), F.count_if(~right).alias("wrong_abstention"),
    )


#: The query set of the searches: each row whose id is divisible by 20.
WHOLE = "{id} % 20 = 0"


def _vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


_DENSE = """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
), dense AS (
  SELECT q.vec_id AS query_id, d.vec_id AS chunk_id, round(list_cosine_similarity(q.v, d.v), 6) AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.v, d.v), 6) DESC, d.vec_id)::INT AS rank
  FROM v q JOIN v d ON q.vec_id % 20 = 0 QUALIFY rank <= 32
)"""


@_query(_DENSE + "SELECT query_id, chunk_id, score, rank FROM dense WHERE rank <= 10")
def dense_topk(spark, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of the query vectors (ids divisible by 20), exact cosine."""
    return _near(spark, sf_dir, 10)


def _near(spark, sf_dir, k, asked=WHOLE) -> DataFrame:
    v = _vectors(spark, sf_dir).drop("label")
    return R.dense(v, v.where(asked.format(id="chunk_id")).select(F.col("chunk_id").alias("query_id"), "vector"), k)


@_query("""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT q.vec_id AS query_id, d.vec_id AS chunk_id, round(list_cosine_similarity(q.v, d.v), 6) AS score,
       row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.v, d.v), 6) DESC, d.vec_id)::INT AS rank
FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.label = d.label AND round(list_cosine_similarity(q.v, d.v), 6) >= 0.1 QUALIFY rank <= 5
""")
def dense_topk_filtered(spark, sf_dir: str) -> DataFrame:
    """The nearest vectors of the same label with a score of 0.1 or more."""
    return _near_of_label(spark, sf_dir)


def _near_of_label(spark, sf_dir, asked=WHOLE) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return R.dense(v, v.where(asked.format(id="chunk_id")).select(F.col("chunk_id").alias("query_id"), "vector", "label"), 5, match=["label"], least=0.1)


@_query()
def dense_topk_approximate(spark, sf_dir: str) -> DataFrame:
    """Approximate nearest vectors of every vector whose id is divisible by 20, by cells and compressed residuals, the best scored exactly."""
    v = _vectors(spark, sf_dir).drop("label")
    return R.approximate(v, v.where(WHOLE.format(id="chunk_id")).withColumnRenamed("chunk_id", "query_id"), 10)


@_query("SELECT count(*) FILTER (vec_id % 20 = 0) AS queries, true AS recall_reached, true AS few_scored FROM embeddings")
def approximate_recall(spark, sf_dir: str) -> DataFrame:
    """Whether the approximate search finds nine of ten of the exact neighbours and scores less than a tenth of all pairs exactly."""
    exact, found = _near(spark, sf_dir, 10), dense_topk_approximate(spark, sf_dir)
    hit = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    recall = hit.agg(F.countDistinct("query_id").alias("queries"), (F.sum(F.coalesce("hit", F.lit(0))) / F.count("*") >= 0.9).alias("recall_reached"))
    scored = _vectors(spark, sf_dir).agg((F.lit(4 * 10) / F.count("*") < 0.1).alias("few_scored"))
    return recall.crossJoin(F.broadcast(scored))  # one row each


@_query("""
WITH n AS (SELECT label, count(*) AS candidates FROM embeddings GROUP BY 1)
SELECT vec_id AS query_id, coalesce(candidates, 0) AS candidates, coalesce(candidates, 0) <= 128 AS exact FROM embeddings LEFT JOIN n USING (label) WHERE vec_id % 20 = 0
""")
def search_strategies(spark, sf_dir: str) -> DataFrame:
    """Whether each query vector is searched exactly inside its label."""
    v = _vectors(spark, sf_dir)
    return R.strategies(v, v.where(WHOLE.format(id="chunk_id")).withColumnRenamed("chunk_id", "query_id"), ["label"])


_DENSE_ITEMS = _DENSE.replace("q.vec_id % 20 = 0", "q.vec_id IN (SELECT item_id FROM benchmark)")


def _lexical_sql(asked: str) -> str:
    """CTEs up to ``lex``: the 32 best whole texts by BM25 for each row (query_id, text) of ``asked``."""
    return f""", q AS ({asked}), qt AS (SELECT query_id, token, count(*) AS times FROM (SELECT query_id, unnest({_TOKENS.format('text')}) AS token FROM q) GROUP BY 1, 2
), d AS (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents
), s AS (SELECT count(*) AS n, greatest(avg(len(t)), 1.0) AS mean FROM d WHERE t IS NOT NULL
), h AS (SELECT doc_id, len, token, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS token FROM d) WHERE token IN (SELECT token FROM qt) GROUP BY 1, 2, 3
), f AS (SELECT token, count(*) AS df FROM h GROUP BY 1
), r AS (
  SELECT query_id, doc_id AS chunk_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM h JOIN f USING (token) JOIN qt USING (token), s GROUP BY 1, 2
), lex AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM r QUALIFY rank <= 32
), fused AS (
  SELECT query_id, chunk_id, d.rank AS dense_rank, l.rank AS lexical_rank, round(coalesce(1.0::DOUBLE / (30.0::DOUBLE + d.rank), 0) + coalesce(1.5::DOUBLE / (30.0::DOUBLE + l.rank), 0), 9) AS score
  FROM (SELECT * FROM dense WHERE query_id IN (SELECT query_id FROM q)) d FULL JOIN lex l USING (query_id, chunk_id)
)"""


_FUSED = _DENSE_ITEMS + _lexical_sql("SELECT item_id AS query_id, text FROM benchmark")


def _fused(spark, sf_dir, k):
    """Each whole passage of ``benchmark`` against all whole texts by words, and the vector of its id against all vectors."""
    asked, v = _asked(spark, sf_dir), _vectors(spark, sf_dir).drop("label")
    near = R.dense(v, v.join(asked, F.col("chunk_id") == F.col("query_id"), "left_semi").withColumnRenamed("chunk_id", "query_id"), 32)
    words = R.bm25(_chunks(spark, sf_dir), asked.select("query_id", tokens(F.col("text")).alias("terms")), 32)
    return near, R.fuse(near, words, k)


@_query(_FUSED + "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense_rank NULLS LAST, lexical_rank NULLS LAST, chunk_id)::INT AS rank FROM fused QUALIFY rank <= 10")
def rrf_fusion(spark, sf_dir: str) -> DataFrame:
    """Dense hits of vectors and word hits of whole documents, fused by rank."""
    return _fused(spark, sf_dir, 10)[1].select("query_id", "chunk_id", "dense_rank", "lexical_rank", "score", "rank")


@_query(_FUSED + """, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense_rank NULLS LAST, lexical_rank NULLS LAST, chunk_id)::INT AS was FROM fused QUALIFY was <= 32
), g AS (SELECT top.*, source, row_number() OVER (PARTITION BY query_id, source ORDER BY was) > 1 AS later FROM top JOIN documents ON chunk_id = doc_id)
SELECT query_id, chunk_id, source, score, row_number() OVER (PARTITION BY query_id ORDER BY later, was)::INT AS rank FROM g QUALIFY rank <= 5
""")
def rrf_diversified(spark, sf_dir: str) -> DataFrame:
    """The fused hits with one hit of each source first."""
    hits = cut_lineage(_fused(spark, sf_dir, 32)[1])  # 32 rows a query, counted and joined
    source = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "source")
    return R.diversify(source.join(R.small(hits), "chunk_id"), "source", 5).select("query_id", "chunk_id", "source", "score", "rank")


@_query(_FUSED + """, status AS (SELECT query_id, max(score) AS best FROM dense GROUP BY 1)
SELECT query_id, coalesce(best, 0) < 0.999 AS abstained, CASE WHEN coalesce(best, 0) < 0.999 THEN 'low_dense_confidence' END AS reason,
       count(dense_rank) AS dense_candidates, count(lexical_rank) AS lexical_candidates, count(*) FILTER (dense_rank IS NOT NULL AND lexical_rank IS NOT NULL) AS overlap
FROM fused LEFT JOIN status USING (query_id) GROUP BY query_id, best
""")
def retrieval_diagnostics(spark, sf_dir: str) -> DataFrame:
    """Candidates of both lists, their overlap, and abstention at a dense threshold."""
    near, hits = _fused(spark, sf_dir, 1000)
    counts = hits.groupBy("query_id").agg(F.count("dense_rank").alias("dense_candidates"), F.count("lexical_rank").alias("lexical_candidates"), F.count_if(F.col("dense_rank").isNotNull() & F.col("lexical_rank").isNotNull()).alias("overlap"))
    return R.abstentions(counts, hits, near, 0.999).join(counts, "query_id")


_SAID = "SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN 'error code ' ELSE '' END || trim(text) AS text FROM benchmark WHERE trim(text) <> ''"


@_query(_DENSE_ITEMS + _lexical_sql(_SAID) + """, w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense_rank NULLS LAST, lexical_rank NULLS LAST, chunk_id) AS was FROM fused QUALIFY was <= 32
), g AS (SELECT w.*, row_number() OVER (PARTITION BY query_id, source ORDER BY was) > 1 AS later FROM w JOIN documents ON chunk_id = doc_id)
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY later, was)::INT AS rank FROM g QUALIFY rank <= 5
""")
def manual_search(spark, sf_dir: str) -> DataFrame:
    """Tool calls for the whole benchmark passages, every third one as an error code."""
    d, asked = table(spark, sf_dir, "documents"), _asked(spark, sf_dir)
    tool = F.when(F.col("query_id") % 3 == 0, "find_error_code").otherwise("search_manual")
    v = _vectors(spark, sf_dir).drop("label")
    calls = asked.select("query_id", tool.alias("tool"), F.col("text").alias("value")).join(v.withColumnRenamed("chunk_id", "query_id"), "query_id", "left")
    return R.manual_search(d.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("body"), "source"), v, calls, "source")


_LETTERS = "aeinorst"


@_query(f"""
WITH c AS (SELECT doc_id, text, [{", ".join(f"length(text) - length(replace(text, '{c}', ''))" for c in _LETTERS)}] AS v, len({_TOKENS.format('text')}) AS n FROM documents
), e AS (SELECT *, CASE WHEN text IS NULL THEN 'no_text' WHEN n > 2000 THEN 'too_long' WHEN list_sum(v) = 0 THEN 'bad_vector' END AS fault FROM c)
SELECT doc_id, fault, i::INT AS i, CASE WHEN fault IS NULL THEN round(v[i + 1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) END AS value FROM e, range({len(_LETTERS)}) t(i) WHERE fault IS NULL OR i = 0
""")
def embedded_documents(spark, sf_dir: str) -> DataFrame:
    """Unit vectors of whole documents by a user function (here counts of letters), and why some have none."""
    letters = _LETTERS  # the function is shipped with its values, not with this module
    e = embedded(table(spark, sf_dir, "documents").select("doc_id", "text"), lambda texts: [[t.count(c) for c in letters] for t in texts], len(_LETTERS), most_tokens=2000)
    x = e.select("doc_id", "fault", F.posexplode_outer("vector").alias("i", "value"))
    return x.select("doc_id", "fault", F.coalesce("i", F.lit(0)).alias("i"), F.round("value", 6).alias("value"))


@_query("""
WITH e AS (SELECT embedding AS a, list_transform(embedding, lambda x: round(x::DOUBLE, 2)) AS b FROM embeddings),
c AS (SELECT list_cosine_similarity(list_transform(a, lambda x: x::DOUBLE), b) AS s FROM e WHERE len(a) = 64)
SELECT count(*) AS pairs, round(min(s), 6) AS min_cosine, round(avg(s), 6) AS mean_cosine FROM c
""")
def embedding_parity(spark, sf_dir: str) -> DataFrame:
    """Cosine of each vector with its copy rounded to two places: least and mean."""
    e = table(spark, sf_dir, "embeddings").where(R.vector_ok(F.col("embedding"), 64))
    copy = F.transform("embedding", lambda x: F.round(x.cast("double"), 2))
    s = e.select((R.dot(F.col("embedding"), copy) / (R.norm(F.col("embedding")) * R.norm(copy))).alias("s"))
    return s.agg(F.count("*").alias("pairs"), F.round(F.min("s"), 6).alias("min_cosine"), F.round(F.avg("s"), 6).alias("mean_cosine"))


@_query("""
WITH w AS (SELECT doc_id, trim(array_to_string(list_slice(string_split(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '\\s+', ' ', 'g'), ' '), 1, 14), ' '), ' .,:;()[]') AS query FROM documents)
SELECT min(doc_id) AS doc_id, query FROM w WHERE length(query) >= 24 GROUP BY query
""")
def proxy_queries(spark, sf_dir: str) -> DataFrame:
    """Queries made of the first 14 words of a text, once each."""
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    q = F.btrim(F.array_join(F.slice(F.split(flat, " "), 1, 14), " "), F.lit(" .,:;()[]"))
    return table(spark, sf_dir, "documents").select("doc_id", q.alias("query")).where(F.length("query") >= 24).groupBy("query").agg(F.min("doc_id").alias("doc_id"))


@_query("""
SELECT coalesce(event_type, 'all') AS component, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.7), 6) AS p70,
       round(quantile_cont(value, 0.99), 6) AS p99, round(quantile_cont(value, 1.0), 6) AS p100, max(value) AS max
FROM events GROUP BY GROUPING SETS ((event_type), ())
""")
def latency_summary(spark, sf_dir: str) -> DataFrame:
    """Latency percentiles by component and over all."""
    e = table(spark, sf_dir, "events")
    p = lambda x: F.round(F.percentile("value", F.lit(x)), 6)
    g = e.groupingSets([("event_type",), ()], "event_type").agg(p(0.5).alias("p50"), p(0.7).alias("p70"), p(0.99).alias("p99"), p(1.0).alias("p100"), F.max("value").alias("max"))
    return g.select(F.coalesce("event_type", F.lit("all")).alias("component"), "p50", "p70", "p99", "p100", "max")


@_query("SELECT event_type AS component, i::INT AS place, count(*) AS n, true AS near FROM events, range(3) t(i) WHERE value IS NOT NULL GROUP BY 1, 2")
def latency_sketches(spark, sf_dir: str) -> DataFrame:
    """Percentiles 0.5, 0.7 and 0.99 by component from sketches of each day: whether their ranks are within 2 % of the rows."""
    shares = [0.5, 0.7, 0.99]
    e = table(spark, sf_dir, "events")
    found = percentiles.merged_percentiles(percentiles.day_sketches(e, ["event_type"], F.to_date("ts"), "value"), ["event_type"], shares)
    asked = found.select(F.col("event_type").alias("component"), "n", F.posexplode("percentiles").alias("place", "estimate"))
    # the ranks that rows equal to the estimate have
    ranked = e.join(asked, F.col("event_type") == F.col("component")).groupBy("component", "place", "n").agg(F.count_if(F.col("value") < F.col("estimate")).alias("below"), F.count_if(F.col("value") <= F.col("estimate")).alias("upto"))
    share = F.element_at(F.array(*map(F.lit, shares)), F.col("place") + 1)
    return ranked.select("component", "place", "n", ((F.col("below") / F.col("n") <= share + 0.02) & (F.col("upto") / F.col("n") >= share - 0.02)).alias("near"))
