"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the k least of a text's distinct shingle hashes (48 bits each), ascending.  Sketches of
parts merge into the sketch of the whole, and two sketches estimate resemblance, containment and the
number of distinct shingles.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..runtime import partitions
from .text_hash import hash_words, shingle_hashes, small_batches, words_at

K, WIDTH, BITS = 128, 5, 48


def sketch(text: bytes, k: int = K, width: int = WIDTH) -> np.ndarray:
    """The sketch of one text: words per ``text_hash``, shingles of ``width`` words (fewer: the whole)."""
    data = np.frombuffer(text, np.uint8)
    hashes = shingle_hashes(hash_words(data, *words_at(data)), width) >> np.uint64(64 - BITS)
    if len(hashes) > 4 * k:
        least = np.unique(np.partition(hashes, 2 * k)[: 2 * k])
        if len(least) >= k:
            return least[:k]
    return np.unique(hashes)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles: exact below k, else from the k-th least hash."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**BITS / float(a[k - 1] + np.uint64(1))


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated intersection / union; of two empty sets 1, of an empty and another 0."""
    both = merge(a, b, k)
    if not len(both):
        return 1.0
    return len(np.intersect1d(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True)) / len(both)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    union, of_a = distinct(merge(a, b, k), k), distinct(a, k)
    return min(1.0, resemblance(a, b, k) * union / of_a) if of_a else 1.0


def to_text(a: np.ndarray) -> str:
    """A sketch as base64 of 6-byte big-endian hashes."""
    return base64.b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, BITS // 8)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, 2:] = raw
    return full.view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None, k: int = K, width: int = WIDTH) -> DataFrame:
    """``docs``'s columns ``keep`` with ``fingerprint`` and ``n_distinct`` (estimated distinct shingles).

    Null and empty texts have the empty fingerprint ''.  Rows are judged one by one, so null keys,
    repeated rows and empty tables need no rule; columns named like the results are not kept.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in (keep or [c for c in docs.columns if c != text]) if c not in ("fingerprint", "n_distinct")]
    table = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text).alias("_text"))

    def run(batches):
        for b in batches:
            made = [sketch((t.as_py() or "").encode(), k, width) for t in b.column("_text")]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array([to_text(a) for a in made], pa.string()), pa.array([distinct(a, k) for a in made], pa.float64())],
                names=[*b.schema.names[:-1], "fingerprint", "n_distinct"],
            )

    kinds = [f"_k{i} {kind}" for i, (_, kind) in enumerate(table.drop("_text").dtypes)]
    return table.mapInArrow(run, ", ".join([*kinds, "fingerprint string", "n_distinct double"])).withColumnsRenamed({f"_k{i}": c for i, c in enumerate(keep)})


def merge_fingerprints(parts: DataFrame, group: str, fingerprint: str = "fingerprint", k: int = K) -> DataFrame:
    """``group`` and the ``fingerprint`` of the union of its rows'.

    Each hash of a fingerprint becomes a row, so that the k least distinct ones are found by a ranking
    after the distinct hashes were gathered map-side; no group is collected whole.
    """
    size = BITS // 8 * 4 // 3
    hashes = F.transform(F.sequence(F.lit(0), F.floor(F.length(fingerprint) / size) - 1), lambda i: F.substring(F.col(fingerprint), (i * size + 1).cast("int"), F.lit(size)))
    rows = parts.select(F.col(group).alias("_g"), F.explode_outer(F.when(F.length(fingerprint) > 0, hashes)).alias("_h")).distinct()
    # base64 isn't in order of the hashes, so the order is that of the decoded bytes
    rank = F.row_number().over(Window.partitionBy("_g").orderBy(F.unbase64("_h")))
    best = rows.where(F.col("_h").isNotNull()).withColumn("_r", rank).where(F.col("_r") <= k)
    merged = best.groupBy("_g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_h"))), lambda x: x["_h"]), "").alias("fingerprint"))
    empty = rows.select("_g").distinct()
    return empty.alias("e").join(merged.alias("m"), F.expr("e._g <=> m._g"), "left").select(F.col("e._g").alias(group), F.coalesce("m.fingerprint", F.lit("")).alias("fingerprint"))


def edit(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half] if half else text


def next_in_order(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, list]:
    """Rows (key, text, slot, spare) dealt by ranges of the key, and the rows that end the ranges.

    A range is a slot.  The first row of a slot is also sent, as ``spare``, to the slot before, and the
    first row of all to the last slot, so each slot has the follower of each of its rows.  Only bounds
    and first keys of the slots, a number each, reach the driver.
    """
    spark = docs.sparkSession
    n = 8 * partitions(spark)
    ids = docs.select(F.col(key).alias("_id")).where(F.col("_id").isNotNull())
    bounds = ids.agg(F.percentile_approx("_id", F.array(*[F.lit(i / n) for i in range(1, n)]), 10_000)).first()[0] if n > 1 else []
    bounds = sorted(set(bounds or []))
    table = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<long>")

    def slot(df: DataFrame, column: str) -> DataFrame:
        return df.withColumn("_slot", F.when(F.col(column).isNull(), 0).otherwise(F.size(F.filter(table, lambda b: b <= F.col(column)))).cast("int"))

    firsts = {r["_slot"]: r["first"] for r in slot(docs.select(F.col(key).alias("_id")), "_id").groupBy("_slot").agg(F.min(F.struct(F.col("_id").isNotNull().alias("some"), F.col("_id").alias("id"))).alias("first")).collect()}
    used = sorted(firsts)
    return slot(docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text")), "_id"), [(s, used[i - 1], firsts[s]["id"]) for i, s in enumerate(used)]


def edited_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    The next document is the one of the next greater id, after the last the first; null ids come
    first, and rows of equal id are in order of their texts' UTF-8 bytes, null first.  Null texts are
    empty.  A table of one row is its own follower; an empty table gives no rows.  ``near`` values are
    estimated resemblances, 1 for two empty texts.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows, heads = next_in_order(docs, key, text)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if not heads:
        return spark.createDataFrame([], schema)
    # the whole row that begins a slot: the least text of the least id
    wanted = F.broadcast(spark.createDataFrame(heads, "slot int, goes int, id long"))  # a row a slot
    first = rows.join(wanted, (F.col("_slot") == F.col("slot")) & F.col("_id").eqNullSafe(F.col("id")))
    spare = first.groupBy("goes", "_slot", "_id").agg(F.min(F.struct(F.col("_text").isNotNull().alias("some"), F.col("_text"))).alias("t")).select("_id", F.col("t._text").alias("_text"), F.col("goes").alias("_slot"), F.lit(True).alias("_spare"))
    dealt = rows.withColumn("_spare", F.lit(False)).unionByName(spare)
    order = ["_slot", "_spare", F.col("_id").asc_nulls_first(), F.col("_text").asc_nulls_first()]
    dealt = dealt.repartition(partitions(spark), "_slot").sortWithinPartitions(*order)

    def run(batches):
        held = None
        for b in batches:
            out = []
            for doc, t, slot, spare in zip(b.column("_id").to_pylist(), b.column("_text"), b.column("_slot").to_pylist(), b.column("_spare").to_pylist(), strict=True):
                t = t.as_py() or ""
                own = sketch(t.encode(), k, width)
                if held is not None and held[0] == slot:
                    _, last, before, seen = held
                    changed = edit(before, t).encode()
                    new = sketch(changed, k, width)
                    out.append((last, len(before), hashlib.sha256(changed).hexdigest(), to_text(seen), to_text(new), resemblance(seen, new, k), resemblance(seen, own, k)))
                held = None if spare else (slot, doc, t, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return dealt.mapInArrow(run, schema)


def op4_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` against its edited text and the next document."""
    return edited_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
