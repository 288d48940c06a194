"""Canonical JSON and ids against Python's."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from pagewright.functions import canonical as C


def test_canonical_json(spark):
    rng = random.Random(1)
    pieces = ["a", "B", " ", "é", "€", "😀", "\n", "\x1f", "\x0b", "\\", '"', "/", "\\u001F", "\x7f", "_", "u00"]
    word = lambda: "".join(rng.choice(pieces) for _ in range(rng.randint(0, 6)))

    def value(depth):
        kind = rng.randint(0, 5 if depth else 3)
        return [word, lambda: rng.randint(-(10**15), 10**15), lambda: None, lambda: rng.random() < 0.5, lambda: [value(depth - 1) for _ in range(rng.randint(0, 3))], lambda: {word(): value(depth - 1) for _ in range(rng.randint(0, 4))}][kind]()

    values = [{word(): value(3) for _ in range(4)} for _ in range(200)] + [[], {}, "", {"b": 1, "a": [{"d": 1, "c": 2}]}]
    rows = spark.createDataFrame([(i, json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2]))) for i, v in enumerate(values)], "i int, t string")
    for r in rows.select("i", C.canonical_json(F.col("t")).alias("c"), C.turn_id(F.col("t")).alias("id")).collect():
        expected = json.dumps(values[r.i], sort_keys=True, separators=(",", ":"))
        assert r.c == expected and r.id == "turn-" + hashlib.sha256(expected.encode()).hexdigest()[:16]
    assert spark.range(1).select(C.canonical_json(F.lit("{no")), C.canonical_json(F.lit(None).cast("string"))).first() == (None, None)


def test_option_ids(spark):
    rows = spark.createDataFrame([("It beeps, twice!", 1), ("¿?", 2), ("A" * 80, 3), ("--x--", 4)], "label string, i int")
    assert [r[0] for r in rows.select(C.option_id(F.col("label"), F.col("i"))).collect()] == ["it-beeps-twice-1", "option-2", "a" * 56 + "-3", "x-4"]


def test_each_step_is_worked_out_once(spark):
    plan = spark.range(1).select(C.turn_id(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("to_json") + plan.count("StructsToJson") <= 2
