"""Batch retrieval: fielded BM25, exact identifiers, vector top-k, fusion, diversification, abstention."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.text import any_of, identifiers, tokens
from ..runtime import cut_lineage, cut_to_table, python_ready
from . import ann, scoring

K1, B = scoring.K1, scoring.B
#: Tokens that texts are counted by in their rows at most; queries that are asked one by one at most; texts that have a rare token, at least tried.
MOST_TOKENS, MOST_CLASSES, RARE = 200_000, 2000, 100
#: Weights of queries that a task holds at once.
MOST_WEIGHTS = 2_000_000
#: A table of query tokens of at most so many rows is broadcast.
BROADCAST_ROWS = 200_000
#: Parts of keys that are looked up one beside the other at most; more are joined.
MOST_PARTS = 16
#: Query vectors and vectors that meet in one task are about so many at most.
QUERY_BLOCK, VECTOR_CHUNK = 20_000, 16_384
#: A scope of so many vectors at most is searched exactly; the settings of the search tools.
EXACT_CANDIDATES = 128
SEARCH = {"limit": 5, "candidates": 32, "weights": (1.0, 1.5), "rrf_k": 30}
#: Expansions of query tokens, and the words that a broad failure report brings in.
SYNONYMS = {
    "topic": ["topics"], "chapter": ["topics"], "required": ["requirements", "requirement"], "setting": ["setup"],
    "lcd": ["control", "panel", "overview", "liquid", "display"], "toner": ["led"], "paper": ["led"],
    "warning": ["caution", "safety"], "caution": ["warning", "safety"], "button": ["power"], "buttons": ["power"],
    "plus": ["buttons"], "minus": ["buttons"],
}
FAILURE = ["not", "cannot", "unable", "wont", "fails", "failure", "offline"]
FAILURE_WORDS = ["printer", "does", "not", "print", "troubleshoot", "problem", "solve"]
TOPIC_WORDS = ["topic", "topics", "chapter", "section"]
#: Wordings of a query that weigh sections more.
TOPIC_TERMS = ["chapter", "topic", "section", "where is"]
SECTION_TERMS = ["how do i", "how can i", "steps", "set up", "setup", "connect", "remove", "warning", "caution", "safety", "hot surface", "led", "light", "blink", "beep", "lcd", "button"]
FAILING_TERMS = ["not", "cannot", "unable", "won't", "wont", "offline"]


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def looked_up(rows: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """The ``rows`` whose ``key`` is one of ``asked``, without a shuffle of ``rows``: the keys are broadcast in parts of at most about BROADCAST_ROWS."""
    keys = cut_to_table(asked.select(key).distinct())
    n = max(1, -(-keys.count() // BROADCAST_ROWS))
    if n > MOST_PARTS:
        return rows.join(keys, key, "left_semi")
    out = None
    for i in range(n):
        part = rows.join(F.broadcast(keys.where(F.pmod(F.xxhash64(key), F.lit(n)) == i)), key, "left_semi")
        out = part if out is None else out.unionByName(part)
    return out


def top(df: DataFrame, by: str | list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group with their rank; ``order`` must be total."""
    keys = [by] if isinstance(by, str) else by
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def rewritten(query: Column, identity: Column | None = None) -> Column:
    """Query tokens without the tokens of the device's identity, with synonyms, bridges and the topic mode.

    Where no device is known (no ``identity``, or a null one) the query's plain tokens.
    """
    if identity is None:
        return tokens(query)
    words = F.filter(tokens(query), lambda w: ~F.array_contains(tokens(F.coalesce(identity, F.lit(""))), w))
    table = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    none = F.array().cast("array<string>")
    more = F.flatten(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), none)))
    off = F.when(F.array_contains(words, "turn") & F.array_contains(words, "off"), F.array(F.lit("power"), F.lit("button"))).otherwise(none)
    fails = F.arrays_overlap(words, F.array(*map(F.lit, FAILURE))) & F.array_contains(words, "print")
    bridge = F.when(fails, F.array(*map(F.lit, FAILURE_WORDS))).otherwise(none)
    full = F.concat(words, more, off, bridge)
    topic = F.array_contains(words, "topic") | F.array_contains(words, "topics")
    return F.when(identity.isNull(), tokens(query)).when(topic, F.filter(full, lambda w: w.isin(TOPIC_WORDS))).otherwise(full)


def field_weights(query: Column) -> tuple[Column, Column]:
    """Weights of body and section that the wording of a query asks for."""
    q = F.lower(query)
    topic = any_of(q, TOPIC_TERMS)
    plain = any_of(q, SECTION_TERMS)
    section = F.when(topic, 6.0).when(plain, 2.5).otherwise(1.0)
    failing = F.contains(q, F.lit("print")) & any_of(q, FAILING_TERMS)
    return F.when(topic, 0.35).otherwise(1.0), F.when(failing, F.greatest(section, F.lit(4.0))).otherwise(section)


def bm25(chunks: DataFrame, queries: DataFrame, k: int = 5, scope: list[str] | None = None, fields: tuple[str, ...] = ("body",), copies: bool = False) -> DataFrame:
    """query_id, chunk_id, score, rank: the best chunks by fielded BM25.

    ``chunks`` has chunk_id and a text column for each field; ``queries`` query_id, ``terms`` (tokens in
    order, repeats count) and a ``<field>_weight`` where a field's weight isn't 1.  With ``scope``, both
    have these columns, and statistics and matches stay inside a scope.  Only tokens that a query has
    are counted, inside the row of a text, and a task keeps the best ``k`` of each query (``scoring``).

    Queries that weigh the same tokens alike are asked once.  Of many, texts with a token that few texts have
    are scored by those that ask for it, and what the other tokens make of a query is asked once for all that
    share it.  More than MOST_TOKENS tokens, or ids that are null or not unique, are joined instead
    (``joined_bm25``); with ``copies`` rows of one id are copies, of which one counts.
    """
    scope = scope or []
    term = queries.select("query_id", *scope, *[F.col(f"{f}_weight") if f"{f}_weight" in queries.columns else F.lit(1.0).alias(f"{f}_weight") for f in fields], F.explode("terms").alias("token"))
    term = cut_to_table(term.groupBy("query_id", *scope, *[f"{f}_weight" for f in fields], "token").agg(F.count("*").alias("times")))
    vocabulary = sorted(r.token for r in term.select("token").distinct().limit(MOST_TOKENS + 1).collect())
    if len(vocabulary) > MOST_TOKENS:
        return joined_bm25(chunks.dropDuplicates(["chunk_id"]) if copies else chunks, term, k, scope, fields)
    spark = chunks.sparkSession
    rows = scoring.counted(chunks, vocabulary, fields, ["chunk_id", *scope])
    # counts are narrower than texts
    rows = cut_to_table((rows.dropDuplicates(["chunk_id"]) if copies else rows).withColumn("_scope", scoring.scope_key(scope)))
    odd = rows.where("chunk_id IS NULL") if copies else rows.groupBy("chunk_id").count().where("count > 1 OR chunk_id IS NULL")
    if not odd.isEmpty():
        return joined_bm25(chunks.dropDuplicates(["chunk_id"]) if copies else chunks, term, k, scope, fields)
    # a row a scope
    size = cut_lineage(rows.groupBy(*scope, "_scope").agg(*[x for f in fields for x in (F.count(f"{f}_len").alias(f"{f}_n"), F.greatest(F.avg(f"{f}_len"), F.lit(1.0)).alias(f"{f}_mean"))]))
    rows = rows.join(F.broadcast(size.select("_scope", *[f"{f}_mean" for f in fields])), "_scope")
    places = spark.createDataFrame(pd.DataFrame({"place": range(len(vocabulary)), "token": vocabulary}), "place int, token string")
    held = None
    for i, f in enumerate(fields):
        part = rows.select("_scope", F.lit(i).alias("_field"), F.explode(f"{f}_ids").alias("place"))
        held = part if held is None else held.unionByName(part)
    df = cut_lineage(held.groupBy("_scope", "_field", "place").agg(F.count("*").alias("df")))
    n = F.coalesce(*[F.when(F.col("_field") == i, F.col(f"{f}_n")) for i, f in enumerate(fields)])
    weight = F.coalesce(*[F.when(F.col("_field") == i, F.col(f"{f}_weight")) for i, f in enumerate(fields)])
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = term.join(F.broadcast(places), "token").join(F.broadcast(size), scope) if scope else term.join(F.broadcast(places), "token").crossJoin(F.broadcast(size))
    asked = cut_to_table(asked.join(small(df), ["_scope", "place"]).select("query_id", "_scope", "_field", "place", (F.col("times") * weight * idf).alias("w")))
    said = cut_to_table(_said(asked))
    first = said.groupBy("said").agg(F.min("query_id").alias("first"))
    alike = said.join(first, "said").select("query_id", "first")
    asked = cut_to_table(asked.join(first.select(F.col("first").alias("query_id")), "query_id", "left_semi"))
    found = _best_of_many(rows, asked, df, fields, k) if first.limit(MOST_CLASSES + 1).count() > MOST_CLASSES else scoring.best(rows, asked, fields, k)
    found = cut_to_table(top(found, "query_id", [F.desc("score"), "chunk_id"], k))
    return found.withColumnRenamed("query_id", "first").join(alike, "first").select("query_id", "chunk_id", "score", "rank")


def _said(weights: DataFrame) -> DataFrame:
    """What each query weighs, as a hash."""
    return weights.groupBy("query_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("_scope", "_field", "place", "w")))), 256).alias("said"))


def _best_of_many(rows: DataFrame, asked: DataFrame, df: DataFrame, fields: tuple[str, ...], k: int) -> DataFrame:
    """query_id, chunk_id, score: rows among which are the best ``k`` texts of each of many different queries.

    A token is rare if at most so many texts have it that the queries' other tokens make at most MOST_CLASSES
    different queries.  Texts with a rare token of a query are scored where they are; what the others score is
    what those other tokens give, asked once for all queries that share them.  That is exact, since a further
    token never lowers a score: a text of the latter that has a rare token too stands no better than among the
    former.  No pair of a query and a text leaves a task but its ``k`` best of each query.
    """
    held, most = df.groupBy("place").agg(F.sum("df").alias("all")), RARE
    asked = cut_to_table(asked.join(small(held), "place"))
    while True:
        said = _said(asked.where(F.col("all") > most))
        if said.select("said").distinct().limit(MOST_CLASSES + 1).count() <= MOST_CLASSES:
            break
        most *= 4
    said = cut_to_table(said)
    first = said.groupBy("said").agg(F.min("query_id").alias("first"))
    alike = said.join(first, "said").select("query_id", "first")
    common = asked.where(F.col("all") > most).join(first.select(F.col("first").alias("query_id")), "query_id", "left_semi")
    others = cut_to_table(top(scoring.best(rows, common, fields, k), "query_id", [F.desc("score"), "chunk_id"], k).drop("rank"))
    others = others.withColumnRenamed("query_id", "first").join(alike, "first").select("query_id", "chunk_id", "score")
    weights = asked.withColumn("rare", F.col("all") <= most)
    parts = -(-asked.count() // MOST_WEIGHTS)
    for i in range(parts):  # weights that a task holds are bounded
        found = scoring.best(rows, weights.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i) if parts > 1 else weights, fields, k)
        others = others.unionByName(found.select("query_id", "chunk_id", "score"))
    return others.repartition("query_id").groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))  # dealt once for this and for the ranks


def joined_bm25(chunks: DataFrame, term: DataFrame, k: int, scope: list[str], fields: tuple[str, ...]) -> DataFrame:
    """``bm25`` by joins on tokens, for any number of tokens; ``term``: query_id, scope, ``<field>_weight``, token, times."""
    term = small(term)
    wanted = small(term.select(*scope, "token").distinct().withColumn("asked", F.lit(True)))
    texts = chunks.select("chunk_id", *scope, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("t")) for f in fields])).alias("x"))
    # the null token stands for the text itself
    listed = texts.select("chunk_id", *scope, "x.field", F.size("x.t").alias("len"), F.explode(F.concat(F.array(F.lit(None).cast("string")), "x.t")).alias("token"))
    kept = listed.join(wanted, [*scope, "token"], "left").where("token IS NULL OR asked")
    rows = cut_to_table(kept.groupBy("chunk_id", *scope, "field", "len", "token").agg(F.count("*").alias("tf")))
    by = [*scope, "field"]
    size = rows.where("token IS NULL").groupBy(*by).agg(F.sum("tf").alias("n"), F.greatest(F.avg("len"), F.lit(1.0)).alias("mean"))
    hit = rows.where("token IS NOT NULL")
    df = hit.groupBy(*by, "token").agg(F.count("*").alias("df")).join(F.broadcast(size), by)  # a row a field and scope
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.coalesce(*[F.when(F.col("field") == f, F.col(f"{f}_weight")) for f in fields])
    weight = small(term.join(df, [*scope, "token"]).select("query_id", *by, "token", "mean", (F.col("times") * weight * idf).alias("w")))
    scored = hit.join(weight, [*by, "token"]).select("query_id", "chunk_id", (F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))).alias("s"))
    total = scored.groupBy("query_id", "chunk_id").agg(F.round(F.sum("s"), 6).alias("score"))
    return top(total, "query_id", [F.desc("score"), "chunk_id"], k)


def exact_hits(chunks: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, chunk_id, rank, score 1: chunks whose ``normalized_value`` is an identifier of the query."""
    asked = queries.select("query_id", F.posexplode(identifiers(F.col("text"))).alias("place", "value")).groupBy("query_id", "value").agg(F.min("place").alias("place"))
    held = chunks.where(F.col("normalized_value").isNotNull()).select("chunk_id", F.regexp_replace(F.lower("normalized_value"), "[^a-z0-9]", "").alias("value"))
    # dealt once, by query, for its distinct chunks and for their ranks
    found = held.join(small(asked), "value").repartition("query_id").groupBy("query_id", "chunk_id").agg(F.min("place").alias("place"))
    return top(found, "query_id", ["place", "chunk_id"], k).select("query_id", "chunk_id", "rank", F.lit(1.0).alias("score"))


def routed(exact: DataFrame, other: DataFrame, queries: DataFrame) -> DataFrame:
    """Exact hits where a query has any, else the other route's; ``route`` says which."""
    some = exact.select("query_id").distinct()
    rest = other.join(queries.select("query_id").join(some, "query_id", "left_anti"), "query_id", "left_semi")
    return exact.withColumn("route", F.lit("exact")).unionByName(rest.withColumn("route", F.lit("hybrid")))


def combined(exact: DataFrame, lexical: DataFrame, k: int = 5) -> DataFrame:
    """Exact hits first, then lexical ones, each chunk once."""
    both = exact.withColumn("tier", F.lit(0)).unionByName(lexical.withColumn("tier", F.lit(1)))
    once = top(both, ["query_id", "chunk_id"], ["tier", "rank"], 1, "copy").drop("copy")
    return top(once.withColumnRenamed("rank", "was"), "query_id", ["tier", "was"], k).select("query_id", "chunk_id", "score", "rank")


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_ok(v: Column, size: int) -> Column:
    """Whether a vector has the right size and only finite components."""
    return v.isNotNull() & (F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def dense(vectors: DataFrame, queries: DataFrame, k: int, match: list[str] | None = None, least: float | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank: exact cosine top-k of each query vector over all vectors.

    Blocks of queries meet chunks of vectors, both of bounded size, and only a chunk's best ``k`` of each
    query leave a task.  ``match`` columns must be equal; vectors of different sizes have no cosine.
    """
    python_ready(vectors.sparkSession)
    keys = [*(match or []), "_size"]

    def ready(df: DataFrame, name: str) -> DataFrame:
        # fresh columns, since queries are often made of the vectors
        x = df.select(F.col(name).alias(name), *[F.col(c).alias(c) for c in keys[:-1]], F.size("vector").alias("_size"), F.transform("vector", lambda x: x.cast("double")).alias("vector"), norm(F.col("vector")).alias("_n"))
        return x.where("_n > 0").dropna(subset=keys)

    def dealt(name: str, n: int) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(n)).cast("int")

    blocks, chunks = max(1, -(-queries.count() // QUERY_BLOCK)), max(1, -(-vectors.count() // VECTOR_CHUNK))
    a = ready(vectors, "chunk_id").withColumns({"_chunk": dealt("chunk_id", chunks), "_block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    q = ready(queries, "query_id").withColumns({"_block": dealt("query_id", blocks), "_chunk": F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))})

    def solve(d: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        held = dict(list(d.groupby(keys)))
        for key, mine in asked.groupby(keys):
            if key not in held:
                continue
            near = held[key].sort_values("chunk_id", kind="stable")
            ids, x = near["chunk_id"].to_numpy(), np.stack(near["vector"].to_numpy())
            for at in range(0, len(mine), 256):
                part = mine.iloc[at : at + 256]
                raw = (np.stack(part["vector"].to_numpy()) @ x.T) / (part["_n"].to_numpy()[:, None] * near["_n"].to_numpy())
                scores = np.sign(raw) * np.floor(np.abs(raw) * 1e6 + 0.5) / 1e6  # half away from zero, as round() does
                for me, s in zip(part["query_id"], scores, strict=True):
                    order = np.where(np.isnan(s), -np.inf, -s)  # NaN comes first in a descending order
                    ok = np.arange(len(ids)) if least is None else np.flatnonzero(~(s < least))
                    if len(ok) > k:
                        ok = ok[order[ok] <= np.partition(order[ok], k - 1)[k - 1]]
                    best = ok[np.argsort(order[ok], kind="stable")][:k]
                    out.append(pd.DataFrame({"query_id": me, "chunk_id": ids[best], "score": s[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})

    kind = StructType([queries.schema["query_id"], vectors.schema["chunk_id"], StructField("score", DoubleType())])
    found = a.groupBy("_block", "_chunk").cogroup(q.groupBy("_block", "_chunk")).applyInPandas(solve, kind)
    return top(found, "query_id", [F.desc("score"), "chunk_id"], k)


def approximate(vectors: DataFrame, queries: DataFrame, k: int, match: list[str] | None = None, cells: int = 64, probes: int = 48, most: int | None = None) -> DataFrame:
    """Like ``dense``, by an index of cells and compressed residuals (``ann``); scores to five places.

    A query looks into its ``probes`` nearest of ``cells`` and scores its ``most`` (4 k) best estimates exactly.
    One that finds fewer than ``k`` vectors in its scope is answered exactly; ``vectors`` have one size.
    """
    keys = match or []
    v = vectors.select("chunk_id", *keys, "vector").where(norm(F.col("vector")) > 0).dropna(subset=keys or ["vector"])
    asked = cut_lineage(queries.select("query_id", *keys, "vector").where(norm(F.col("vector")) > 0).dropna(subset=keys or ["vector"]))
    if v.isEmpty():
        return dense(v, asked, k, match)
    model = ann.learned(v, cells)
    found = ann.candidates(cut_to_table(ann.indexed(v, model, keys)), asked, model, keys, probes, most or 4 * k)
    found = cut_lineage(top(ann.scored(found, v, asked), "query_id", [F.desc("score"), "chunk_id"], k))
    short = asked.join(found.where(F.col("rank") == k), "query_id", "left_anti").select("query_id", *keys, "vector")
    rest = dense(v, short, k, match).withColumn("score", F.round("score", 5))
    return found.join(short, "query_id", "left_anti").unionByName(rest)


def strategies(vectors: DataFrame, queries: DataFrame, match: list[str], exact: bool | None = None) -> DataFrame:
    """query_id, candidates, exact: a query whose scope has few vectors is searched exactly, unless ``exact`` decides for all."""
    n = vectors.groupBy(*match).agg(F.count("*").alias("candidates"))
    x = queries.select("query_id", *match).join(n, match, "left").withColumn("candidates", F.coalesce("candidates", F.lit(0).cast("long")))
    return x.select("query_id", "candidates", (F.col("candidates") <= EXACT_CANDIDATES if exact is None else F.lit(exact)).alias("exact"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, match: list[str], exact: bool | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank of the scope's nearest vectors, exactly or by projections as ``strategies`` says."""
    own = queries.join(strategies(vectors, queries, match, exact).select("query_id", "exact"), "query_id")
    near = dense(vectors, own.where("exact").drop("exact"), k, match).withColumn("score", F.round("score", 5)) if exact is not False else None
    far = approximate(vectors, own.where("NOT exact").drop("exact"), k, match) if exact is not True else None
    return near.unionByName(far) if near is not None and far is not None else near if far is None else far


def tool_query(tool: Column, value: Column) -> Column:
    """What a tool call searches for; null for a blank value and for tools that don't search."""
    said = F.nullif(F.trim(value), F.lit(""))
    return F.when(tool == "find_error_code", F.concat(F.lit("error code "), said)).when(tool == "search_manual", said)


def manual_search(chunks: DataFrame, vectors: DataFrame, calls: DataFrame, group: str) -> DataFrame:
    """query_id, chunk_id, score, rank for tool ``calls`` (query_id, tool, value, vector).

    Word and vector candidates are fused by rank, and one hit of each ``group`` comes first.  ``chunks``
    has chunk_id, body and ``group``; calls that search for nothing have no rows.
    """
    q = calls.withColumn("text", tool_query(F.col("tool"), F.col("value"))).where("text IS NOT NULL")
    words = bm25(chunks, q.select("query_id", tokens(F.col("text")).alias("terms")), SEARCH["candidates"])
    near = dense(vectors, q.select("query_id", "vector"), SEARCH["candidates"])
    hits = cut_lineage(fuse(near, words, SEARCH["candidates"], SEARCH["weights"], SEARCH["rrf_k"]))  # counted and joined
    hits = chunks.select("chunk_id", group).join(small(hits), "chunk_id")
    return diversify(hits, group, SEARCH["limit"]).select("query_id", "chunk_id", "score", "rank")


def fuse(dense_hits: DataFrame, lexical_hits: DataFrame, k: int, weights: tuple[float, float] = (1.0, 1.5), rrf_k: int = 30) -> DataFrame:
    """query_id, chunk_id, score, rank, dense_rank, lexical_rank by reciprocal rank fusion; ties keep dense order first."""
    if k <= 0 or rrf_k <= 0 or min(weights) < 0 or max(weights) == 0:
        raise ValueError("limit, rrf_k and weights must be positive")
    d, x = dense_hits.select("query_id", "chunk_id", F.col("rank").alias("dense_rank")), lexical_hits.select("query_id", "chunk_id", F.col("rank").alias("lexical_rank"))
    both = d.join(x, ["query_id", "chunk_id"], "full")
    part = lambda c, w: F.coalesce(F.lit(w) / (F.lit(float(rrf_k)) + F.col(c)), F.lit(0.0))
    both = both.withColumn("score", F.round(part("dense_rank", weights[0]) + part("lexical_rank", weights[1]), 9))
    order = [F.desc("score"), F.col("dense_rank").asc_nulls_last(), F.col("lexical_rank").asc_nulls_last(), "chunk_id"]
    return top(both, "query_id", order, k)


def diversify(hits: DataFrame, group: str, k: int) -> DataFrame:
    """First one hit of each evidence group in order, then the others in order; ``rank`` becomes the new rank."""
    turn = F.row_number().over(Window.partitionBy("query_id", group).orderBy("rank"))
    return top(hits.withColumn("_later", turn > 1).withColumnRenamed("rank", "was"), "query_id", ["_later", "was"], k).drop("_later", "was")


def abstentions(queries: DataFrame, hits: DataFrame, dense_hits: DataFrame | None = None, threshold: float | None = None) -> DataFrame:
    """query_id, abstained, reason: no hits, or the best dense score (0 without dense hits) below the threshold."""
    status = queries.select("query_id").join(hits.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left")
    low = F.lit(False)
    if threshold is not None and dense_hits is not None:
        status = status.join(dense_hits.groupBy("query_id").agg(F.max("score").alias("best")), "query_id", "left")
        low = F.coalesce("best", F.lit(0.0)) < threshold
    reason = F.when(low, "low_dense_confidence").when(F.col("n").isNull(), "no_retrieval_hits")
    return status.select("query_id", reason.isNotNull().alias("abstained"), reason.alias("reason"))


def with_parents(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, chunk_id, place: each hit and its parent once per query, in order of first mention."""
    pair = hits.join(chunks.select("chunk_id", "parent_chunk_id"), "chunk_id", "left").select("query_id", "rank", F.posexplode(F.array_compact(F.array("chunk_id", "parent_chunk_id"))).alias("side", "chunk_id"))
    first = pair.groupBy("query_id", "chunk_id").agg(F.min(F.struct("rank", "side")).alias("at"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("at"))
    return first.withColumn("place", place).join(chunks.select("chunk_id"), "chunk_id", "left_semi").select("query_id", "chunk_id", "place")


#: Bytes at the start of a passage by which texts that may hold it are found; passages that each task holds at most, and their bytes; tokens of ``joined_holding``.
START, MOST_PASSAGES, PASSAGE_BYTES, ANCHOR = 16, 50_000, 1 << 26, 3


def holding(chunks: DataFrame, passages: DataFrame) -> DataFrame:
    """query_id, chunk_id: the ``chunks`` (chunk_id, text) whose text holds a passage (query_id, passage) as it is.

    Texts are looked through once, in their rows: where the bytes are those that a passage starts with, the
    rest is compared.  Shorter passages are sought in every text; of more than MOST_PASSAGES, texts are found
    by a join (``joined_holding``).  Null texts and passages give no rows.
    """
    asked = cut_to_table(passages.where(F.col("passage").isNotNull()).select("query_id", "passage"))
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("passage")), F.lit(0)).alias("bytes")).first()
    if size.n > MOST_PASSAGES or size.bytes > PASSAGE_BYTES:
        return joined_holding(chunks, asked)
    long, short = (asked.where(x) for x in (F.octet_length("passage") >= START, F.octet_length("passage") < START))
    found = _started_in(chunks, long)
    if short.isEmpty():
        return found
    return found.unionByName(chunks.join(F.broadcast(short), F.contains("text", F.col("passage"))).select("query_id", "chunk_id"))


def _windows(data: np.ndarray, n: int) -> np.ndarray:
    """The 8 bytes from each of the first ``n`` places as a number."""
    out = np.empty(n, np.uint64)
    for r in range(min(8, n)):
        out[r::8] = data[r : r + len(out[r::8]) * 8].view("<u8")
    return out


def _started_in(chunks: DataFrame, passages: DataFrame) -> DataFrame:
    """``holding`` for passages of at least START bytes, all of them held by every task."""
    python_ready(chunks.sparkSession)
    table = passages.toArrow()
    kind = StructType([passages.schema["query_id"], chunks.schema["chunk_id"]])
    whole = [x.encode() for x in table["passage"].to_pylist()]
    known = chunks.sparkSession.sparkContext.broadcast((table["query_id"].combine_chunks(), whole))
    odd = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

    def run(batches):
        queries, whole = known.value
        if not whole:
            return
        ends = [np.array([int.from_bytes(p[a:][:8], "little") for p in whole], np.uint64) for a in (0, 8)]
        last = np.array([int.from_bytes(p[-8:], "little") for p in whole], np.uint64)
        size = np.array([len(p) for p in whole])
        key = ends[0] * odd[0] + ends[1] * odd[1]
        order = np.argsort(key, kind="stable")
        keys, first = np.unique(key[order], return_index=True)
        upto = np.append(first[1:], len(order))
        may = np.zeros(1 << 16, bool)
        may[(keys >> np.uint64(48)).astype(np.int64)] = True
        for b in batches:
            texts = b.column("text").cast(pa.large_binary())
            row = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False))
            texts = texts.drop_null()
            if not len(texts):
                continue
            off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
            off = off - off[0]
            hits = []
            for a in range(0, len(data) - START + 1, 1 << 20):  # a part of the bytes at a time
                n = min(1 << 20, len(data) - START + 1 - a)
                w = _windows(data[a : a + n + START - 1], n + 8)
                at_key = w[:n] * odd[0] + w[8:] * odd[1]
                at = np.flatnonzero(may[(at_key >> np.uint64(48)).astype(np.int64)])
                spot = np.minimum(np.searchsorted(keys, at_key[at]), len(keys) - 1)
                ok = keys[spot] == at_key[at]
                at, spot = at[ok] + a, spot[ok]
                times = upto[spot] - first[spot]
                passage = order[np.repeat(first[spot] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
                at = np.repeat(at, times)
                text = np.searchsorted(off, at, "right") - 1
                ok = at + size[passage] <= off[text + 1]
                at, passage, text = at[ok], passage[ok], text[ok]
                tail = data[(at + size[passage] - 8)[:, None] + np.arange(8)].copy().view("<u8").ravel()
                ok = tail == last[passage]
                hits += [(t, p) for i, p, t in zip(at[ok].tolist(), passage[ok].tolist(), text[ok].tolist(), strict=True) if data[i : i + len(whole[p])].tobytes() == whole[p]]
            if hits:
                text, passage = np.unique(np.array(hits, np.int64), axis=0).T
                yield pa.RecordBatch.from_arrays([queries.take(pa.array(passage)), b.column("chunk_id").take(pa.array(row[text]))], names=["query_id", "chunk_id"])

    return chunks.select("chunk_id", "text").mapInArrow(run, kind)


def joined_holding(chunks: DataFrame, passages: DataFrame) -> DataFrame:
    """``holding`` by a join, for any number of passages.

    The first and last token of a passage may be parts of a text's tokens, the others are whole: texts that
    have the tokens after the first in a row are looked at closely.  Passages of fewer tokens are sought in
    every text.  Null texts and passages give no rows.
    """
    t = tokens(F.col("passage"))
    asked = passages.where(F.col("passage").isNotNull()).select("query_id", "passage", F.when(F.size(t) >= ANCHOR + 2, F.xxhash64(*[F.get(t, F.lit(1 + i)) for i in range(ANCHOR)])).alias("anchor"))
    own = tokens(F.col("text"))
    shifted = F.arrays_zip(*[F.slice(own, F.lit(1 + i), F.size(own)).alias(f"t{i}") for i in range(ANCHOR)])
    runs = F.array_distinct(F.transform(shifted, lambda x: F.xxhash64(*[x[f"t{i}"] for i in range(ANCHOR)])))
    anchors = small(asked.where("anchor IS NOT NULL").select("anchor").distinct())
    may = chunks.select("chunk_id", F.explode(runs).alias("anchor")).join(anchors, "anchor")
    found = may.join(small(asked), "anchor").join(chunks, "chunk_id").where(F.contains("text", F.col("passage"))).select("query_id", "chunk_id")
    short = asked.where("anchor IS NULL").select("query_id", "passage")
    if short.isEmpty():
        return found
    return found.unionByName(chunks.join(small(short), F.contains("text", F.col("passage"))).select("query_id", "chunk_id"))


def recall_and_rank(hits: DataFrame, labels: DataFrame, k: int = 5) -> DataFrame:
    """query_id, recall, reciprocal_rank for each labelled query: share of its relevant chunks among the first ``k``."""
    relevant = labels.select("query_id", "chunk_id").distinct()
    found = relevant.join(hits.where(F.col("rank") <= k), ["query_id", "chunk_id"], "left")
    return found.groupBy("query_id").agg((F.count("rank") / F.count("*")).alias("recall"), F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("reciprocal_rank"))
