"""Scans, sinks and keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

PAGE_DOCUMENT = "source_file string, pdf_type string, pages array<struct<page_number:int,text:string,parser:string,confidence:double,requires_ocr:boolean>>"
CHUNK = "chunk_id string, document_id string, section string, pages array<int>, content string, kind string, strategy string, parent_chunk_id string, retrieval_profiles array<string>, ordinal int"
CASE = "case_id string, query string, category string, question_type string, manufacturer string, model string, expected_chunk_ids array<string>, acceptable_chunk_ids array<string>, should_abstain boolean"
#: Kinds of evaluation questions, and fields of a metadata filter.
QUESTION_TYPES = ["procedure", "factual", "error_code", "symptom", "unanswerable"]
FILTER_FIELDS = ["manufacturer", "model", "document_id", "document_version", "parent_chunk_id", "kind", "strategy", "normalized_value"]


def binary_documents(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Files with their checksum, version, retrieval time and id ``<folder>-<stem>``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    parts = F.split(F.col("path"), "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    digest = F.sha2("content", 256)
    return files.select(
        F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1)).alias("relative_path"), F.concat_ws("-", F.element_at(parts, -2), stem).alias("document_id"), digest.alias("sha256"),
        F.concat(F.lit("sha256:"), digest).alias("version"), F.date_format(F.to_utc_timestamp("modificationTime", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("retrieved_at"), "length",
    )


def registry(spark: SparkSession, path: str) -> DataFrame:
    """The source registry, one row an entry, from a JSON file of one map."""
    kind = "struct<sources:map<string,struct<title:string,manufacturer:string,model:string,source_url:string>>>"
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", kind)["sources"]).alias("relative_path", "e")).select("relative_path", "e.*")


def reconcile(entries: DataFrame, files: DataFrame, key: str = "relative_path") -> DataFrame:
    """Entries and files side by side with ``status``: matched, unregistered_file or missing_file."""
    e, f = entries.withColumn("_e", F.lit(True)), files.withColumn("_f", F.lit(True))
    status = F.when(F.col("_e").isNull(), "unregistered_file").when(F.col("_f").isNull(), "missing_file").otherwise("matched")
    return e.join(f, key, "full").withColumn("status", status).drop("_e", "_f")


def resolved_sources(entries: DataFrame, files: DataFrame, key: str = "relative_path") -> DataFrame:
    """The matched sources; an entry without a file or a file without an entry is an error."""
    both = reconcile(entries, files, key)
    if bad := both.where("status <> 'matched'").select(key, "status").limit(5).collect():
        raise ValueError(f"registry and files differ: {[tuple(r) for r in bad]}")
    return both.drop("status")


def page_documents(spark: SparkSession, path: str) -> DataFrame:
    """document_id, page_seq (order in the file), page_number, text and more from page documents."""
    raw = spark.read.schema(PAGE_DOCUMENT).option("multiLine", "true").option("pathGlobFilter", "*.json").json(path)
    raw = raw.where(F.col("_metadata.file_name") != "parse_report.json")
    return raw.select(F.col("source_file").alias("document_id"), F.posexplode("pages").alias("page_seq", "p")).select("document_id", "page_seq", "p.*")


def chunk_lines(spark: SparkSession, path: str, profile: str | None = None, document_id: str | None = None, limit: int | None = None, category: str | None = None) -> DataFrame:
    """Chunks of JSON lines in a stable order; a line that can't be read is an error that names file and line. ``category``: a folder of the path.

    Blank lines are passed over.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = spark.read.text(path).select("value", place.alias("_at"))
    read = F.from_json("value", CHUNK + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    raw = lines.where(F.trim("value") != "").select(read.alias("c"), "_at", "value")
    bad = raw.where("c IS NULL OR c._corrupt_record IS NOT NULL").select("_at", "value").orderBy("_at").limit(1).collect()
    if bad:
        at = bad[0]["_at"]
        own = lines.select("_at.*").where((F.col("file") == at.file) & ((F.col("block") < at.block) | ((F.col("block") == at.block) & (F.col("row") <= at.row))))
        raise ValueError(f"{at.file}:{own.count()}: not a chunk: {bad[0]['value'][:200]}")
    raw = raw.select("c.*", F.col("_at.file").alias("_file"))
    out = raw.drop("_corrupt_record")
    if category:
        out = out.where(F.array_contains(F.split("_file", "/"), category))
    if profile:
        out = out.where(F.array_contains("retrieval_profiles", profile))
    if document_id:
        out = out.where(F.col("document_id") == document_id)
    return out.orderBy("_file", "ordinal").limit(limit).drop("_file") if limit else out.drop("_file")


def evaluation_cases(spark: SparkSession, path: str) -> DataFrame:
    """Valid evaluation cases; none, a repeated id or an invalid case is an error."""
    cases = spark.read.schema(CASE).json(path)
    if cases.isEmpty():
        raise ValueError("no evaluation cases")
    if twice := cases.groupBy("case_id").count().where("count > 1").limit(3).collect():
        raise ValueError(f"case ids occur twice: {[r[0] for r in twice]}")
    judged = case_violations(cases)
    if bad := judged.where(F.size("violations") > 0).select("case_id", "violations").limit(3).collect():
        raise ValueError(f"invalid cases: {[tuple(r) for r in bad]}")
    return judged.drop("violations")


def case_violations(cases: DataFrame) -> DataFrame:
    """``cases`` with acceptable ids defaulted to the expected ones, and ``violations``."""
    none = F.array().cast("array<string>")
    expected = F.coalesce("expected_chunk_ids", none)
    accepted = F.coalesce("acceptable_chunk_ids", expected)
    checks = [
        (~F.col("question_type").isin(QUESTION_TYPES), "unknown_question_type"), (F.col("should_abstain") != (F.col("question_type") == "unanswerable"), "abstention_mismatch"),
        (F.size(F.array_except(expected, accepted)) > 0, "expected_not_acceptable"),
    ]
    bad = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(r)) for c, r in checks]))
    return cases.withColumn("violations", bad).withColumn("acceptable_chunk_ids", accepted)


def matches(filters: str = "f", chunks: str = "c", fields: list[str] = FILTER_FIELDS) -> Column:
    """A join condition: each field of a filter that isn't null equals the chunk's."""
    out = F.lit(True)
    for x in fields:
        out = out & (F.col(f"{filters}.{x}").isNull() | (F.col(f"{filters}.{x}") == F.col(f"{chunks}.{x}")))
    return out


def merged_scope(queries: DataFrame, scopes: DataFrame, fields: list[str]) -> DataFrame:
    """Queries with their session's scope filled in; ``conflict`` lists fields that differ."""
    s = scopes.select("session", *[F.col(x).alias(f"_{x}") for x in fields])
    out = queries.join(s, "session", "left")
    clash = F.array_compact(F.array(*[F.when(F.col(x) != F.col(f"_{x}"), F.lit(x)) for x in fields]))
    return out.withColumn("conflict", clash).withColumns({x: F.coalesce(x, f"_{x}") for x in fields}).drop(*[f"_{x}" for x in fields])


def upsert(base: DataFrame, updates: DataFrame, key: str, seq: str) -> DataFrame:
    """The latest row of each key; ``updates`` win ties."""
    both = base.withColumn("_t", F.lit(0)).unionByName(updates.withColumn("_t", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc(seq), F.desc("_t"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_t")


def scoped_delete(base: DataFrame, **fields) -> DataFrame:
    """``base`` without the rows that have all the given values; no value at all is refused."""
    given = {k: v for k, v in fields.items() if v is not None}
    if not given:
        raise ValueError("a delete needs a filter")
    hit = F.lit(True)
    for k, v in given.items():
        hit = hit & F.col(k).eqNullSafe(F.lit(v))
    return base.where(~hit)


def fetched(base: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of ``wanted``'s array ``ids`` in its order; unknown ids are left out."""
    return wanted.select("request", F.posexplode("ids").alias("place", key)).join(base, key)


def device_catalog(chunks: DataFrame, categories: list[str]) -> DataFrame:
    """Distinct category, manufacturer, model, trimmed and not blank; category is the first known folder of the path."""
    folder = F.try_element_at(F.filter(F.split("source_file", "/"), lambda p: p.isin(categories)), F.lit(1))
    x = chunks.select(folder.alias("category"), F.trim("manufacturer").alias("manufacturer"), F.trim("model").alias("model"))
    return x.where("category IS NOT NULL AND manufacturer <> '' AND model <> ''").distinct()


def write_mirrored(df: DataFrame, path: str, *by: str) -> None:
    """JSON files in folders by ``by``, replacing only the folders that are written."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).json(path)


def matching(filters: DataFrame, chunks: DataFrame, fields: list[str] = FILTER_FIELDS) -> DataFrame:
    """``filters``' other columns and ``chunks``' chunk_id of each match: every field of a filter that isn't null is the chunk's.

    Filters that set the same fields are one equality join; one that sets none matches every chunk and is refused.
    """
    rest = [c for c in filters.columns if c not in fields]
    kinds = [tuple(f for f in fields if r[f]) for r in filters.select(*[F.col(f).isNotNull().alias(f) for f in fields]).distinct().collect()]  # at most 2 ** len(fields) rows
    if () in kinds:
        raise ValueError("a filter sets no field")
    out = filters.select(*rest).limit(0).crossJoin(chunks.select("chunk_id").limit(0))
    for kind in kinds:
        own = filters.where(" AND ".join(f"{f} IS {'NOT ' if f in kind else ''}NULL" for f in fields))
        out = out.unionByName(own.select(*rest, *kind).join(chunks.select("chunk_id", *kind), list(kind)).select(*rest, "chunk_id"))
    return out


def payload(chunks: DataFrame) -> DataFrame:
    """``chunks`` (chunk_id, content, document struct, source_file, metadata map) as flat rows for a vector store.

    ``category`` is the third part of the file's path, ``unknown`` without one; identifier fields are null where the metadata lacks them.
    """
    parts = F.split("source_file", "/")
    d = F.col("document")
    return chunks.select(
        "chunk_id", F.col("content").alias("text"), d["document_id"].alias("document_id"), d["manufacturer"].alias("manufacturer"), d["model"].alias("model"), d["version"].alias("document_version"),
        F.coalesce(F.get(parts, 2), F.lit("unknown")).alias("category"), d["title"].alias("document_title"), d["source_url"].alias("source_url"),
        *[F.try_element_at("metadata", F.lit(k)).alias(k) for k in ("identifier_kind", "normalized_value")],
    )


def ocr_pages(items: DataFrame) -> DataFrame:
    """document_id, page, text, confidence, items: the pages of recognised ``items`` (document_id, page, place, text, confidence).

    Blank items are left out; the text has an item a line in order of place, the confidence is the items' mean.
    A page of blank items only has an empty text and the confidence 0.
    """
    seen = F.trim("text") != ""
    return items.groupBy("document_id", "page").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(seen, F.struct("place", "text")))), lambda x: x["text"]), "\n").alias("text"),
        F.coalesce(F.avg(F.when(seen, F.col("confidence"))), F.lit(0.0)).alias("confidence"), F.count(F.when(seen, 1)).alias("items"),
    )


#: A page recognised less surely than this is recognised again by the fallback model.
SURE = 0.85


def with_fallback(pages: DataFrame, fallback: DataFrame, model: str, sure: float = SURE) -> DataFrame:
    """``pages`` (``ocr_pages``) where an unsure page is the ``fallback``'s if that is surer; ``fallback_from`` then names ``model``."""
    again = fallback.select("document_id", "page", F.struct("text", "confidence", "items").alias("_again"))
    better = (F.col("confidence") < sure) & F.coalesce(F.col("_again.confidence") > F.col("confidence"), F.lit(False))
    x = pages.join(again, ["document_id", "page"], "left").withColumn("_better", better)
    return x.select("document_id", "page", *[F.when(F.col("_better"), F.col(f"_again.{c}")).otherwise(F.col(c)).alias(c) for c in ("text", "confidence", "items")], F.when(F.col("_better"), F.lit(model)).alias("fallback_from"))


def strided_sample(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """The pages (document_id, page) at equal strides of each document, as many as ``wanted`` (document_id, count) asks for; from the first on."""
    order = F.row_number().over(Window.partitionBy("document_id").orderBy("page")) - 1
    n = pages.groupBy("document_id").agg(F.count("*").alias("_n"))
    x = pages.join(n, "document_id").join(wanted, "document_id").withColumn("_i", order).withColumn("_stride", F.greatest(F.lit(1), F.floor(F.col("_n") / F.greatest("count", F.lit(1)))))
    return x.where((F.col("_i") % F.col("_stride") == 0) & (F.col("_i") / F.col("_stride") < F.col("count"))).select(*pages.columns)
