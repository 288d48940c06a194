"""Percentiles that can be kept and merged: a KLL sketch for each key and day, merged over any days later.

A sketch has a bounded size whatever it saw.  With ``K`` = 200 the rank of an estimate is off by about 1.3 % of the
rows with a confidence of 99 %; where that is too much, ``percentile`` over the rows is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

K = 200


def day_sketches(rows: DataFrame, keys: list[str], day: Column, value: str, k: int = K) -> DataFrame:
    """keys, day, n, sketch of the values of each key and day; null values and NaN don't count."""
    x = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return x.groupBy(*keys, day.alias("day")).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def merged_percentiles(sketches: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """keys, n, percentiles (an array as ``shares``) over all the days of ``sketches``."""
    whole = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return whole.select(*keys, "n", F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(float(x)) for x in shares])).alias("percentiles"))
