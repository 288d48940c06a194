"""As-of join: each row with the last row of another table up to its time, by a merge of sorted ranges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StringType, StructType

from ..runtime import cut_lineage, partitions, python_ready


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, to: str = "asof", inclusive: bool = False) -> DataFrame:
    """``left`` with ``to``: the columns of the last row of ``right`` with equal ``keys`` before (or at) ``at``; null without one.

    Of right rows at one time the greatest (by its columns) is the last.  Rows with a null key or time find
    nothing.  Both tables are sorted together into ranges of (keys, time), so a frequent key has several ranges:
    each range says what its last key ends with (one row a range), and the next goes on from there.
    """
    spark = left.sparkSession
    python_ready(spark)
    usable = F.lit(True)
    for k in [*keys, at]:
        usable = usable & F.col(k).isNotNull()
    held = F.struct(*[F.col(c) for c in right.columns])
    key = F.to_json(F.struct(*keys)).alias("_key")
    time = left.schema[at].dataType
    first, second = (0, 1) if inclusive else (1, 0)  # of equal times the one with the lower number is met first
    rows = left.where(usable).select(key, F.col(at).alias("_at"), F.lit(second).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(held.alias("h")).schema["h"].dataType).alias("_right"))
    known = right.where(usable).select(key, F.col(at).cast(time).alias("_at"), F.lit(first).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("l")).schema["l"].dataType).alias("_left"), held.alias("_right"))
    order = ["_key", "_at", "_side", "_right"]
    both = rows.unionByName(known).repartitionByRange(partitions(spark), "_key", "_at", "_side").sortWithinPartitions(*order)
    both = cut_lineage(both).withColumn("_part", F.spark_partition_id())

    def filled(batches, key, value):
        """Each batch with the place of each row's right row in the batch's ``[value, *its right rows]`` (-1: none)."""
        for b in batches:
            if not b.num_rows:
                continue
            names = b.column("_key")
            new = np.ones(b.num_rows, bool)
            new[1:] = pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)
            new[0] = names[0].as_py() != key
            is_right = b.column("_right").is_valid().to_numpy(zero_copy_only=False)
            place = np.where(is_right, np.arange(1, b.num_rows + 1), np.where(new, -1, -2))  # -2: as the row before
            place[0] = place[0] if place[0] != -2 else (0 if value is not None else -1)
            at = np.maximum.accumulate(np.where(place == -2, 0, np.arange(b.num_rows)))
            place = place[at]
            pool = pa.concat_arrays([pa.array([value], b.column("_right").type), b.column("_right")])
            key = names[-1].as_py()
            value = pool[int(place[-1])].as_py() if place[-1] >= 0 else None
            yield b, place, pool, key, value

    def ends(batches):
        part = key = value = None
        for b, _, _, key, value in filled(batches, None, None):
            part = b.column("_part")[0].as_py()
        if part is not None:
            yield pa.RecordBatch.from_pylist([{"part": part, "key": key, "value": value}], schema=pa.schema([("part", pa.int32()), ("key", pa.string()), ("value", value_type)]))

    value_type = to_arrow_type(both.schema["_right"].dataType)
    schema = StructType().add("part", IntegerType()).add("key", StringType()).add("value", both.schema["_right"].dataType)
    before, key_, value_ = {}, None, None
    for r in sorted(both.mapInArrow(ends, schema).collect(), key=lambda r: r.part):  # a row a range
        before[r.part] = (key_, value_)
        own = r.value.asDict(recursive=True) if r.value is not None else None
        key_, value_ = r.key, own if own is not None or r.key != key_ else value_

    def joined(batches):
        batches = iter(batches)
        b = next(batches, None)
        if b is None:
            return
        key, value = before[b.column("_part")[0].as_py()] if b.num_rows else (None, None)

        def all_of():
            yield b
            yield from batches

        for x, place, pool, _, _ in filled(all_of(), key, value):
            rows = np.flatnonzero(x.column("_left").is_valid().to_numpy(zero_copy_only=False))
            found = pa.array(np.maximum(place[rows], 0), mask=place[rows] < 0)
            yield pa.RecordBatch.from_arrays([x.column("_left").take(pa.array(rows)), pool.take(found)], names=["_left", "_right"])

    out = both.mapInArrow(joined, StructType([both.schema["_left"], both.schema["_right"]])).select("_left.*", F.col("_right").alias(to))
    return out.unionByName(left.where(~usable).withColumn(to, F.lit(None).cast(both.schema["_right"].dataType)))
