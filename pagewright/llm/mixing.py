"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Each document of a source has the same expected number of copies, target / source size.  The copies
are prefix-summed in a fixed order within the source, one random offset is added, and a document is
emitted once for each integer boundary that its interval crosses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
#: The order within a source is: bit length of the size, slice, size, id.  A slice is a hash of the id.
#: Ranks are counted within (source, bit length, slice) and added to the running count of the blocks
#: before, so a source with a third of all rows is still dealt over many tasks.
SLICES = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """``sources`` (source, source_size) with ``target``.

    Sources in code point order, null last, take ``weights`` in turn and share ``share`` of all sizes in
    proportion to them; a target stops at ``cap`` times its source's size and the excess is shared
    again by weight until none is above.  With sources ordered by cap / weight the level is found in
    closed form: a source is capped if what is left at its turn, dealt by weight, exceeds its cap; the
    first that isn't fixes the level (later ones would give a lower one).
    The table has a row a source, so its windows are small.
    """
    n = len(weights)
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (at % n + 1).cast("int"))
    order = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weight_left = F.col("_weights") - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    return (
        sources.withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_total", F.sum("source_size").over(whole) * F.lit(float(share))).withColumn("_weights", F.sum("_w").over(whole))
        .withColumn("_level", left / weight_left)
        .withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(whole))
        .withColumn("target", F.when(F.col("_level").isNull() | (F.col("_ratio") <= F.col("_level")), F.col("_cap")).otherwise(F.col("_level") * F.col("_w")))
        .select("source", "source_size", "target")
    )


def mix(docs: DataFrame, weights: list[float], share: float = 1.0, cap: float = 3.0, text: str = "text", key: str = "doc_id", source: str = "source", seed: str = "mix", keep: list[str] | None = None, extra_source: bool = False) -> DataFrame:
    """``docs``'s columns ``keep`` (and ``source`` with ``extra_source``) with ``size``, ``source_size``, ``target`` and ``copies``.

    ``size`` counts the words of the whole text (null: 0), ``copies`` says how often the mix takes the
    document.  A document of no words counts as one to be drawn, which adds nothing to the mix.  Null
    sources form a source of their own, null keys hash as an empty string, and repeated rows are each
    drawn; ties in the order only concern equal rows.  A source whose size is 0 has target 0 and no
    copies.  Clashing columns of ``docs`` are not kept.  Reruns give the same rows.
    """
    keep = keep or [key]
    id_text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    sized = (
        docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.col(key).alias("_key"), (F.conv(F.substring(F.md5(id_text), 1, 4), 16, 10).cast("int") % SLICES).alias("slice"))
        .withColumn("bits", F.length(F.bin("size")))
    )
    if text not in keep:  # the words of narrow rows are counted once; whole texts are not stored for it
        sized = cut_lineage(sized)
    block = ["source", "bits", "slice"]
    blocks = sized.groupBy(*block).agg(F.count("*").alias("_n"), F.sum("size").alias("_size"))
    targets = water_fill(blocks.groupBy("source").agg(F.sum("_size").alias("source_size")), weights, share, cap)
    # the one random offset of a source, in [0, 1), from a hash of its name
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("source"), F.lit("|null")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    running = F.sum("_n").over(Window.partitionBy("source").orderBy("bits", "slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    blocks = (
        blocks.withColumns({"_before": running, "_offset": offset}).alias("b").join(targets.alias("t"), F.expr("b.source <=> t.source"))
        .select(*[F.col(f"b.{c}").alias(f"_{c}") for c in block], "_before", "source_size", "target", "_offset")
    )
    rank = F.row_number().over(Window.partitionBy(*block).orderBy("size", F.col("_key").asc_nulls_last()))
    ranked = sized.withColumn("_rank", rank).join(blocks, F.expr(" AND ".join(f"{c} <=> _{c}" for c in block)))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    upto = lambda k: F.floor(expected * (F.col("_before") + F.col("_rank") - k) + F.col("_offset"))
    return ranked.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], *([F.col("source").alias(source)] if extra_source else []), "size", "source_size", "target", (upto(0) - upto(1)).cast("long").alias("copies"))


#: The weights of the registered query and of the pipeline.
WEIGHTS = [5.0, 2.0, 1.0]


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of all ``documents``; ``taken`` is the words that it takes of each, repeats counted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mix(docs, WEIGHTS)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 4))::INT % 64 AS slice FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1
), w AS (
  SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s
), r AS (SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / w AS ratio, sum(source_size) OVER ()::DOUBLE AS total, sum(w) OVER () AS weights FROM w
), l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / (weights - coalesce(sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM r
), m AS (SELECT max(level) FILTER (level <= ratio) AS level FROM l
), t AS (SELECT source, source_size, CASE WHEN m.level IS NULL OR ratio <= m.level THEN cap ELSE m.level * w END AS target FROM l, m
), k AS (
  SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY length(bin(size)), slice, size, doc_id NULLS LAST) AS rank FROM sized d
), c AS (
  SELECT doc_id, size, source_size, target, rank, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS e,
         ('0x' || substr(md5('mix|' || coalesce(k.source, '|null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, size * (floor(e * rank + u) - floor(e * (rank - 1) + u))::BIGINT AS taken FROM c
"""
