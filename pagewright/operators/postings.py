"""A persisted inverted index: BM25 over postings on disk, with block maxima, and new documents as new segments.

A segment holds the postings of the documents that were added together, in Parquet folders by bucket of the token.
A row is the part of a token's list that falls into one block of documents, with its greatest count and least length;
the block's own row, of a null token, lists its documents.  Blocks are documents that a task reads one after another,
so their lists are made there and only these lists are shuffled.  A version names the segments that are searched;
adding documents writes one segment and the next version, compacting writes all postings as one segment.  One writer
at a time; readers keep the version that they began with.

A search reads the buckets of its tokens and no text.  The lists of a block meet in one task, which keeps the best
documents of each query.  A block's greatest possible score for a query is the sum of what its maxima allow; one
that can reach the k-th score of no query is not scored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.text import tokens
from ..runtime import cut_lineage, cut_to_table, partitions, python_ready
from . import scoring
from .retrieval import top

#: Buckets of tokens (folders of a segment), the one of the blocks' own rows, and documents of a block.
BUCKETS, OWN, BLOCK_DOCS = 64, -1, 128
#: Documents of a writing task and of a bucket's file, about; queries that are asked at once.
TASK_DOCS, FILE_DOCS, QUERIES = 20_000, 200_000, 20_000


def _segments(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    versions = spark.read.parquet(f"{path}/versions")
    n = versions.agg(F.max("version")).first()[0]
    return n, sorted(r.segment for r in versions.where(F.col("version") == n).select("segment").collect())  # a row a segment


def _publish(spark: SparkSession, path: str, version: int, segments: list[str]) -> None:
    spark.createDataFrame([(version, s) for s in segments], "version long, segment string").coalesce(1).write.mode("append").parquet(f"{path}/versions")


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def _write(rows: DataFrame, documents: int, path: str, segment: str) -> None:
    """``rows``: field, token, block, n, most, least, ids, tfs, lens."""
    files = -(-documents // FILE_DOCS) or 1
    rows = rows.withColumns({"bucket": F.when(F.col("token").isNull(), OWN).otherwise(_bucket(F.col("token"))), "_file": F.pmod(F.xxhash64("block"), F.lit(files))})
    rows = rows.repartition(max(partitions(rows.sparkSession), -(-documents // TASK_DOCS)), "bucket", "_file").drop("_file")
    rows.sortWithinPartitions("bucket", "token").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/postings/{segment}")


def _listed(chunks: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """The rows of ``_write``, made in the tasks that read the texts."""
    python_ready(chunks.sparkSession)
    x = chunks.select("chunk_id", *[tokens(F.col(f)).alias(f"_{i}") for i, f in enumerate(fields)])
    kind = StructType([StructField("field", StringType()), StructField("token", StringType()), StructField("block", LongType()), StructField("n", LongType()), StructField("most", IntegerType()), StructField("least", IntegerType())])
    kind = kind.add("ids", ArrayType(x.schema["chunk_id"].dataType)).add("tfs", ArrayType(IntegerType())).add("lens", ArrayType(IntegerType()))
    size = BLOCK_DOCS

    def made(field, token, group, row, tf, lens, ids, first):
        """A row for each run of equal ``group``; ``row``, ``tf``: the documents and their counts."""
        at = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        ends = pa.array(np.append(at, len(row)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, v) for v in (ids.take(pa.array(row)), pa.array(tf.astype(np.int32)), pa.array(lens[row].astype(np.int32)))]
        columns = [pa.array([field] * len(at)), token(at), pa.array(first + row[at] // size), pa.array(np.diff(np.append(at, len(row)))), pa.array(np.maximum.reduceat(tf, at).astype(np.int32)), pa.array(np.minimum.reduceat(lens[row], at).astype(np.int32))]
        return pa.RecordBatch.from_arrays([*columns, *lists], names=kind.names)

    def run(batches):
        first = TaskContext.get().partitionId() << 33
        for b in batches:
            ids = b.column(0)
            for i, field in enumerate(fields):
                lists = b.column(1 + i)
                own = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
                if not len(own):
                    continue
                lens = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
                yield made(field, lambda at: pa.nulls(len(at), pa.string()), own // size, own, np.zeros(len(own), np.int64), lens, ids, first)
                words = lists.flatten().dictionary_encode()
                if not len(words):
                    continue
                row = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
                key, tf = np.unique(words.indices.to_numpy().astype(np.int64) * b.num_rows + row, return_counts=True)
                code, row = np.divmod(key, b.num_rows)
                named = lambda at: words.dictionary.take(pa.array(code[at])).cast(pa.string())  # noqa: B023, E731
                yield made(field, named, code * (b.num_rows // size + 1) + row // size, row, tf, lens, ids, first)
            first += b.num_rows // size + 1

    return x.mapInArrow(run, kind)


def add_documents(chunks: DataFrame, path: str, fields: tuple[str, ...] = ("body",)) -> None:
    """Adds ``chunks`` (chunk_id and a text column for each field) to the index at ``path``, which is begun if there is none.

    Each id occurs once in the index; ids that are there already, or twice in ``chunks``, are refused.  A null text counts as
    no text: it has no tokens and doesn't count among the texts of its field.
    """
    spark = chunks.sparkSession
    try:
        version, segments = _segments(spark, path)
    except Exception as fault:  # only the absence of an index begins one
        if "PATH_NOT_FOUND" not in str(fault):
            raise
        version, segments = 0, []
    if not chunks.groupBy("chunk_id").count().where("count > 1").isEmpty() or segments and not _docs(spark, path, segments).join(chunks.select("chunk_id"), "chunk_id", "left_semi").isEmpty():
        raise ValueError("a chunk id is in the index already or occurs twice")
    segment = uuid.uuid4().hex
    _write(_listed(chunks, fields), chunks.count(), path, segment)
    _publish(spark, path, version + 1, [*segments, segment])


def compact(spark: SparkSession, path: str) -> None:
    """Writes the segments as one, without reading a text; the old ones stay for readers of older versions."""
    version, segments = _segments(spark, path)
    each = _postings(spark, path, segments).select("field", "token", F.explode(F.arrays_zip("ids", "tfs", "lens")).alias("h"))
    documents = _docs(spark, path, segments).select("chunk_id").distinct().count()
    block = F.pmod(F.xxhash64("h.ids"), F.lit(max(1, -(-documents // BLOCK_DOCS))))
    held = each.groupBy("field", "token", block.alias("block")).agg(F.count("*").alias("n"), F.max("h.tfs").alias("most"), F.min("h.lens").alias("least"), F.collect_list(F.struct("h.ids", "h.tfs", "h.lens")).alias("h"))
    segment = uuid.uuid4().hex
    _write(held.select("field", "token", "block", "n", "most", "least", *[F.col(f"h.{c}").alias(c) for c in ("ids", "tfs", "lens")]), documents, path, segment)
    _publish(spark, path, version + 1, [segment])


def _docs(spark: SparkSession, path: str, segments: list[str]) -> DataFrame:
    own = _postings(spark, path, segments).where(F.col("bucket") == OWN)
    return own.select("field", F.explode(F.arrays_zip("ids", "lens")).alias("h")).select(F.col("h.ids").alias("chunk_id"), "field", F.col("h.lens").alias("len"))


def _postings(spark: SparkSession, path: str, segments: list[str]) -> DataFrame:
    out = None
    for i, s in enumerate(segments):
        part = spark.read.parquet(f"{path}/postings/{s}").withColumn("segment", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, chunk_id, score, rank as ``retrieval.bm25`` gives them over all documents of the index.

    ``queries``: query_id, ``terms`` and a ``<field>_weight`` where a field's weight isn't 1.
    """
    _, segments = _segments(spark, path)
    stats = cut_lineage(_docs(spark, path, segments).groupBy("field").agg(F.count("*").alias("texts"), F.greatest(F.avg("len"), F.lit(1.0)).alias("mean")))
    fields = sorted(r.field for r in stats.collect())  # a row a field
    named = [c for c in queries.columns if c.endswith("_weight")]
    term = queries.select("query_id", *named, F.explode("terms").alias("token")).groupBy("query_id", *named, "token").agg(F.count("*").alias("times"))
    term = cut_to_table(term.withColumn("bucket", _bucket(F.col("token"))))
    parts = max(1, -(-term.select("query_id").distinct().count() // QUERIES))
    out = None
    for i in range(parts):
        own = term.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i)
        found = _found(_postings(spark, path, segments), stats, fields, own, named, k)
        out = found if out is None else out.unionByName(found)
    return top(out, "query_id", [F.desc("score"), "chunk_id"], k)


def _found(postings: DataFrame, stats: DataFrame, fields: list[str], term: DataFrame, named: list[str], k: int) -> DataFrame:
    """query_id, chunk_id, score: the best ``k`` documents of each query in each task; ``term`` are those of QUERIES queries at most."""
    spark = postings.sparkSession
    wanted = sorted((r.bucket, r.token) for r in term.select("bucket", "token").distinct().collect())
    places = spark.createDataFrame([(*x, i) for i, x in enumerate(wanted)], "bucket int, token string, place int")
    field = F.array_position(F.array(*map(F.lit, fields)), F.col("field")).cast("int") - 1 if fields else F.lit(0)
    rows = postings.where(F.col("bucket") != OWN).join(F.broadcast(places), ["bucket", "token"]).withColumn("_field", field)
    df = rows.groupBy("field", "place").agg(F.sum("n").alias("df")).join(F.broadcast(stats), "field")
    weight = F.lit(1.0)
    for c in named:
        weight = F.when(F.col("field") == c.removesuffix("_weight"), F.col(c)).otherwise(weight)
    idf = F.log(1 + (F.col("texts") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = term.join(F.broadcast(places), ["bucket", "token"]).join(df, "place")
    weights = weights.select("query_id", F.lit(0).cast("long").alias("_scope"), field.alias("_field"), "place", (F.col("times") * weight * idf).alias("w"))
    net = scoring.Weights(weights.toArrow())
    kind = StructType([term.schema["query_id"], StructField("chunk_id", postings.schema["ids"].dataType.elementType), StructField("score", DoubleType())])
    if not len(net.queries):
        return spark.createDataFrame([], kind)
    known, asked = spark.sparkContext.broadcast(net), term.schema["query_id"].dataType
    rows = rows.join(F.broadcast(stats), "field").select("segment", "block", "_field", "place", "mean", "most", "least", "ids", "tfs", "lens")
    rows = rows.repartition("segment", "block").sortWithinPartitions("segment", "block")

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        net = known.value
        n = len(net.queries)
        best = scoring.Best(n, k)

        def scored(part: pa.Table) -> None:
            list_field, place, mean, most, least = (part[c].to_numpy() for c in ("_field", "place", "mean", "most", "least"))
            lists = part["ids"].combine_chunks()
            times = pc.list_value_length(lists).to_numpy()
            known_ids = lists.flatten().dictionary_encode("encode")
            row = known_ids.indices.to_numpy().astype(np.int64)
            tf, size = (part[c].combine_chunks().flatten().to_numpy().astype(float) for c in ("tfs", "lens"))

            def total(rows, row, field, place, gains, seen):
                into = np.zeros(rows * n)
                for f in range(len(fields)):
                    ok = field == f
                    net.scores(rows, row[ok], f, np.zeros(int(ok.sum()), np.int64), place[ok].astype(np.int64), gains[ok], into, seen)
                return into

            # rounding lifts a score by less than a millionth
            if net.positive and (total(1, np.zeros(len(place), np.int64), list_field, place, scoring.gain(most, least, mean), None) < best.reached - 0.000001).all():
                return
            rows = len(known_ids.dictionary)
            gains = scoring.gain(tf, size, np.repeat(mean, times))
            list_field, place = np.repeat(list_field, times), np.repeat(place, times)
            step = max(1, scoring.CELLS // n)
            for a in range(0, rows, step):
                z, ok = min(a + step, rows), (row >= a) & (row < a + step)
                seen = None if net.positive else np.zeros((z - a) * n, bool)
                best.add(total(z - a, row[ok] - a, list_field[ok], place[ok], gains[ok], seen), seen, known_ids.dictionary.slice(a, z - a))

        held, last = [], None  # the batches of the block that goes on
        for b in batches:
            at = b.column("segment").to_numpy().astype(np.int64), b.column("block").to_numpy()
            cut = np.append(np.append(0, np.flatnonzero((np.diff(at[0]) != 0) | (np.diff(at[1]) != 0)) + 1), b.num_rows)
            for a, z in zip(cut[:-1], cut[1:], strict=True):
                if z == a:
                    continue
                if held and last != (at[0][a], at[1][a]):
                    scored(pa.Table.from_batches(held))
                    held = []
                held, last = [*held, b.slice(a, z - a)], (at[0][a], at[1][a])
        if held:
            scored(pa.Table.from_batches(held))
        if best.ids is not None:
            yield best.found(pa.array(net.queries, to_arrow_type(asked)))

    return rows.mapInArrow(run, kind)
