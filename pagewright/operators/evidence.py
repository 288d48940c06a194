"""Evidence around hits: filters, assembly, citations, contexts and citation markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as T
from .retrieval import top

#: Circumstances that evidence may name only if a broad failure report does.
CONDITIONS = [
    ["wireless", "wi-fi", "wifi", "wlan"], ["firewall"], ["multiple sheets", "misfeed", "pick up paper", "paper feed"],
    ["print quality", "image defect", "toner", "streak", "blur", "blank page"], ["job storage", "stored job", "private print", "delayed print"],
]
MARKER = r"\[source:([^\]]+)\]"


def specific_evidence(hits: DataFrame) -> DataFrame:
    """Hits that stay: for a broad failure report only sections that say so, without a condition that the query lacks.

    ``hits``: query, section, content and more; others stay as they are.
    """
    q, s, body = F.lower("query"), F.lower("section"), F.lower(F.concat_ws("\n", "section", "content"))
    says = T.any_of(s, ["does not print", "cannot print"])
    foreign = F.lit(False)
    for group in CONDITIONS:
        foreign = foreign | (T.any_of(body, group) & ~T.any_of(q, group))
    return hits.where(~T.broad_failure(F.col("query")) | (says & ~foreign & ~F.contains(s, F.lit("after "))))


#: What a broad failure report lacks, and what to ask for each list of missing facts.
DETAIL = "any message or error code shown on the printer control panel"
QUESTIONS = {
    (DETAIL,): "What exactly appears on the printer control panel—an error code, a message, or its normal status?",
    ("manufacturer", "model"): "Which manufacturer and model are you working with?",
    ("manufacturer",): "Which manufacturer made the device?",
    ("model",): "What is the device model?",
}
NO_QUESTION = "I could not verify a safe next step from the available manual evidence."


def missing_observations(requests: DataFrame, detail: bool = False) -> DataFrame:
    """``requests`` (query, manufacturer, model) with what is ``missing`` and the ``question`` that asks for it (null: nothing is missing).

    With ``detail``, a report that only says that printing fails lacks what the panel shows.
    """
    gone = [F.when(F.coalesce(f, F.lit("")) == "", F.lit(f)) for f in ("manufacturer", "model")]
    if detail:
        gone.append(F.when(F.coalesce(T.broad_failure(F.col("query")), F.lit(False)), F.lit(DETAIL)))
    x = requests.withColumn("missing", F.array_compact(F.array(*gone)))
    question = F.when(F.size("missing") == 0, F.lit(None).cast("string"))
    for facts, asked in QUESTIONS.items():
        question = question.when(F.col("missing") == F.array(*map(F.lit, facts)), asked)
    return x.withColumn("question", question.otherwise(NO_QUESTION))


def composed_query(df: DataFrame) -> DataFrame:
    """``df`` with ``composed``: query, observation and selected result in one text."""
    return df.withColumn("composed", F.concat_ws(" ", "query", F.concat(F.lit("Observed: "), F.col("observed")), F.concat(F.lit("Selected result: "), F.col("selected"))))


#: What a hit's payload must hold to be cited as it is, and where a document has it.
CITED = {"document_id": "document_id", "document_title": "title", "manufacturer": "manufacturer", "model": "model", "document_version": "version", "page": None, "section": None, "source_url": "source_url"}


def assembled(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """query_id, rank, chunk_id, content, pages, citation: the hits that have a text and can be cited, each chunk once.

    ``hits`` has query_id, rank, chunk_id and what its payload holds of text, parent_chunk_id and the fields of
    a citation.  The text is the payload's, else the chunk's, else its parent's.  A payload that lacks a field
    (null or empty) is cited by the first evidence of the chunk, else of the parent, and their document; hits
    with neither are left out.  ``chunks`` and ``documents`` are looked up by id, one row an id.
    """
    have = set(hits.columns)
    said = {c: F.col(c) if c in have else F.lit(None).cast("int" if c == "page" else "string") for c in ["text", "parent_chunk_id", *CITED]}
    x = hits.select("query_id", "rank", "chunk_id", F.struct(*[v.alias(k) for k, v in said.items()]).alias("said"))
    held = F.struct("content", "pages", "document_id", F.element_at("evidence", 1).alias("first"))
    known = top(chunks.select("chunk_id", held.alias("held")), ["chunk_id"], ["held"], 1, "_n").drop("_n")
    x = x.join(known.withColumnRenamed("held", "own"), "chunk_id", "left")
    x = x.join(known.select(F.col("chunk_id").alias("_up"), F.col("held").alias("parent")), F.col("said.parent_chunk_id") == F.col("_up"), "left")
    x = x.withColumn("base", F.coalesce("own", "parent"))
    x = x.join(documents.select(F.col("document_id").alias("_doc"), F.struct(*[c for c in CITED.values() if c]).alias("doc")), F.col("base.document_id") == F.col("_doc"), "left")
    text = lambda c: F.nullif(c, F.lit(""))
    whole = F.lit(True)
    for c in CITED:
        whole = whole & (F.coalesce(F.col(f"said.{c}").cast("string"), F.lit("")) != "")
    payload = F.struct(*[F.col(f"said.{c}").cast("int" if c == "page" else "string").alias(c) for c in CITED])
    looked_up = F.struct(*[(F.col(f"base.first.{c}") if at is None else F.coalesce(F.col(f"doc.{at}"), F.lit("")) if c in ("model", "document_version") else F.col(f"doc.{at}")).alias(c) for c, at in CITED.items()])
    x = x.withColumns({
        "content": F.coalesce(text(F.trim("said.text")), text(F.col("own.content")), text(F.col("parent.content"))),
        "citation": F.when(whole, payload).when(F.col("base.first").isNotNull() & F.col("doc").isNotNull(), looked_up),
        "pages": F.coalesce("own.pages", "parent.pages", F.array(F.col("said.page").cast("int"))),
    })
    # dealt once by query: what is done with a query's evidence needs no further shuffle
    good = x.where(F.col("content").isNotNull() & F.col("citation").isNotNull()).repartition("query_id")
    return top(good, ["query_id", "chunk_id"], ["rank"], 1, "_n").select("query_id", "rank", "chunk_id", "content", "pages", "citation")


def citations(evidence: DataFrame) -> DataFrame:
    """query_id, rank and the eight fields of a citation: the first evidence of each document, page and section."""
    x = evidence.select("query_id", "rank", "citation.*")
    return top(x, ["query_id", "document_id", "page", "section"], ["rank"], 1, "_n").drop("_n")


def contexts(evidence: DataFrame) -> DataFrame:
    """query_id, context: evidence blocks in rank order, as one text."""
    block = F.concat(F.lit("[source:"), F.col("chunk_id").cast("string"), F.lit("] "), F.col("citation.document_id"), F.lit(" p. "), F.col("citation.page").cast("string"), F.lit(" "), F.col("citation.section"), F.lit("\n"), F.col("content"))
    rows = evidence.select("query_id", F.struct("rank", block.alias("b")).alias("r"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["b"]), "\n\n").alias("context"))


def cited(answers: DataFrame) -> DataFrame:
    """``answers`` (text, evidence_ids) with ``markers`` and ``citation_ok``: at least one marker, all known."""
    marks = F.regexp_extract_all("text", F.lit(MARKER), F.lit(1))
    return answers.withColumn("markers", marks).withColumn("citation_ok", (F.size(marks) > 0) & (F.size(F.array_except(marks, "evidence_ids")) == 0))


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """Ordered union of two evidence lists of each query, each chunk once."""
    both = first.withColumn("_t", F.lit(0)).unionByName(second.withColumn("_t", F.lit(1)))
    once = top(both, ["query_id", "chunk_id"], ["_t", "rank"], 1, "_n")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("_t", "rank"))
    return once.withColumn("place", place).select("query_id", "chunk_id", "place")


def distinct_evidence(items: DataFrame) -> DataFrame:
    """``items`` (chunk_id, place, source_file, page, section, content) without repeats inside a chunk: the first of equal ones stays."""
    return top(items, ["chunk_id", "source_file", "page", "section", "content"], ["place"], 1, "_n").drop("_n")


def citation_ready(hits: DataFrame) -> DataFrame:
    """query_id, hits, ready_rate: the share of a query's hits that name document, page and section."""
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    ready = given("document_id") & given("section") & F.coalesce(F.col("page") != 0, F.lit(False))
    return hits.groupBy("query_id").agg(F.count("*").alias("hits"), F.avg(ready.cast("int")).alias("ready_rate"))


def opened_page(evidence: DataFrame, requests: DataFrame) -> DataFrame:
    """The evidence of each request's page: ``requests`` and ``evidence`` share query_id, document_id and page."""
    return evidence.join(requests.select("query_id", "document_id", "page").distinct(), ["query_id", "document_id", "page"], "left_semi")


def verbatim_answers(evidence: DataFrame) -> DataFrame:
    """query_id, answer: the text of the first evidence; queries without evidence have none."""
    return evidence.groupBy("query_id").agg(F.min_by("content", "rank").alias("answer"))


def expanded(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """``answers`` (query_id, text) with ``answer``: its markers as ``[title · p. page · section]`` of the query's evidence.

    A marker of unknown evidence stays as it is.
    """
    label = F.concat(F.lit("["), F.col("document_title"), F.lit(" · p. "), F.col("page").cast("string"), F.lit(" · "), F.col("section"), F.lit("]"))
    once = top(evidence, ["query_id", "chunk_id"], ["rank"], 1, "_n").select("query_id", F.col("chunk_id").cast("string").alias("id"), label.alias("label"))
    known = once.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("id", "label"))).alias("_known"))
    marks = F.array_distinct(F.regexp_extract_all("text", F.lit(MARKER), F.lit(1)))

    def put(text, id):
        marker = F.concat(F.lit("[source:"), id, F.lit("]"))
        return F.replace(text, marker, F.coalesce(F.try_element_at("_known", id), marker))

    return answers.join(known, "query_id", "left").withColumn("answer", F.aggregate(marks, F.col("text"), put)).drop("_known")
