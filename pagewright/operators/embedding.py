"""Vectors of texts by a model that the user brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.text import tokens
from ..runtime import python_ready
from .retrieval import norm, vector_ok


def embedded(texts: DataFrame, model: Callable[[list[str]], list], size: int, fold: bool = False, most_tokens: int | None = None, batch: int = 128) -> DataFrame:
    """``texts`` (text and more) with ``vector``, of unit length, and ``fault`` where there is none.

    ``model`` takes a list of texts and returns a vector of ``size`` for each; equal texts are asked once,
    with ``fold`` also those that differ in case or space only.  Faults: ``no_text``; ``too_long`` (more than
    ``most_tokens`` tokens: such texts are refused, never cut); ``bad_vector`` (another size, a component that
    isn't finite, or only zeros).  Another number of vectors than texts is an error.
    """
    python_ready(texts.sparkSession)
    said = F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))) if fold else F.col("text")
    fits = F.lit(True) if most_tokens is None else F.size(tokens(F.col("text"))) <= most_tokens
    x = texts.withColumns({"_key": F.sha2(said, 256), "_fits": fits})
    once = x.where("text IS NOT NULL AND _fits").select("_key", said.alias("text")).dropDuplicates(["_key"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                vectors = list(model(part["text"].tolist()))
                if len(vectors) != len(part):
                    raise ValueError("the model returned another number of vectors than texts")
                yield pd.DataFrame({"_key": part["_key"], "_raw": [np.asarray(v, dtype=float) for v in vectors]})

    raw = once.mapInPandas(run, "_key string, _raw array<double>").withColumn("_n", norm(F.col("_raw")))
    good = vector_ok(F.col("_raw"), size) & (F.col("_n") > 0)
    raw = raw.select("_key", F.when(good, F.transform("_raw", lambda v: v / F.col("_n"))).alias("vector"))
    fault = F.when(F.col("text").isNull(), "no_text").when(~F.col("_fits"), "too_long").when(F.col("vector").isNull(), "bad_vector")
    return x.join(raw, "_key", "left").withColumn("fault", fault).drop("_key", "_fits")
