"""A keyed table in hash buckets: each update rewrites only the buckets that it touches.

``data/e<epoch>/_bucket=<n>`` holds the rows of a bucket as of an epoch, ``manifest/_epoch=<epoch>`` one row for each
bucket: the folder where it stands.  An epoch is written as data first and as its manifest last, so readers see it
whole or not at all, and an epoch whose manifest exists is not written again: a replay changes nothing.  One writer
at a time; epochs grow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .tables import upsert

BUCKETS = 64


def _manifest(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema("_bucket int, folder string, _epoch long").parquet(f"{path}/manifest")
    except Exception as fault:
        if "PATH_NOT_FOUND" in str(fault):
            return None
        raise


def folders(spark: SparkSession, path: str, epoch: int | None = None) -> dict[int, str]:
    """The folder of each bucket as of an epoch (None: the last); BUCKETS rows at most."""
    manifest = _manifest(spark, path)
    if manifest is None:
        return {}
    upto = manifest if epoch is None else manifest.where(F.col("_epoch") <= epoch)
    last = upto.agg(F.max("_epoch")).first()[0]
    return {} if last is None else {r["_bucket"]: r.folder for r in manifest.where(F.col("_epoch") == last).collect()}


def read(spark: SparkSession, path: str, schema, epoch: int | None = None, deleted: str | None = None) -> DataFrame:
    """The latest row of each key as of an epoch (None: the last), without those whose column ``deleted`` says so."""
    held = folders(spark, path, epoch)
    rows = spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in held.values()]) if held else spark.createDataFrame([], schema)
    return rows.where(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else rows


def merge(batch: DataFrame, epoch: int, path: str, key: str, seq: str, buckets: int = BUCKETS) -> list[int]:
    """Merges ``batch`` as an epoch, the row of greatest ``seq`` of each key staying; the buckets that were rewritten.

    Of rows of one key and ``seq`` the batch's wins over the table's, and the greatest (by its columns) over the
    others of the batch.  Deleted rows stay as tombstones, so an older row that comes late doesn't revive them.  Rows
    of null key are refused.
    """
    spark, schema = batch.sparkSession, batch.schema
    manifest = _manifest(spark, path)
    if manifest is not None and not manifest.where(F.col("_epoch") == epoch).isEmpty():
        return []
    if not batch.where(F.col(key).isNull()).isEmpty():
        raise ValueError("a row has no key")
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    new = batch.groupBy(key, seq).agg(F.max(F.struct(*batch.columns)).alias("r")).select("r.*")
    touched = sorted(r[0] for r in batch.select(bucket).distinct().collect())  # ``buckets`` rows at most
    held = folders(spark, path)
    old = [f"{path}/{held[b]}" for b in touched if b in held]
    base = spark.read.schema(schema).parquet(*old) if old else batch.limit(0)
    merged = upsert(base, new, key, seq).withColumn("_bucket", bucket)
    merged.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/data/e{epoch}")
    now = held | {b: f"data/e{epoch}/_bucket={b}" for b in touched}
    spark.createDataFrame(sorted(now.items()), "_bucket int, folder string").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/_epoch={epoch}")
    return touched


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes what none of the last ``keep`` epochs needs; the number of folders that went."""
    manifest = _manifest(spark, path)
    epochs = sorted((r[0] for r in manifest.select("_epoch").distinct().collect()), reverse=True)  # those not yet vacuumed
    needed = {r.folder for r in manifest.where(F.col("_epoch").isin(epochs[:keep])).select("folder").distinct().collect()}
    gone = [r.folder for r in manifest.where(~F.col("_epoch").isin(epochs[:keep])).select("folder").distinct().collect() if r.folder not in needed]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for folder in [*gone, *(f"manifest/_epoch={e}" for e in epochs[keep:])]:
        at = hadoop.Path(f"{path}/{folder}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return len(gone)
