"""Sessions as state, as-of joins and the turn contract against values worked out by hand and plain rules."""

import random

from pyspark.sql import functions as F

from pagewright.operators import sessions as S
from pagewright.operators.asof import asof_join
from pagewright.streaming import sessions as Z


def request(session, seq, observation=None, option=None, query="help"):
    return (session, seq, "request", observation, option, query, None, None, None, None, None)


def turn(session, seq, id, acts=False, facts=(), ruled_out=(), asks=None):
    return (session, seq, "turn", None, None, None, id, acts, [tuple(f) for f in facts], list(ruled_out), asks)


def delete(session, seq):
    return (session, seq, "delete", *[None] * 8)


EVENTS = [
    request(1, 1, "It is dark"),  # nothing was asked yet: kept as pending only
    turn(1, 2, "t2", True, asks=("r1", "lamp", True, [("a", "On", "lamp on"), ("b", "Off", None)])),
    request(1, 3, "ok, what next"),  # only acknowledges
    request(1, 4, None, "b"),  # a chosen option without a value says its label
    turn(1, 5, "t5", facts=[("lamp", "off", "Lamp"), ("fuse", "old", "Fuse")], ruled_out=["wire", "plug", "wire"], asks=("r2", "fuse", False, [])),
    turn(1, 6, "t6", facts=[("fuse", "new", "Fuse")], ruled_out=["plug", "fuse"]),  # answers r2 by a fact
    request(2, 1, "broken"), turn(2, 2, "u2", asks=("r1", "k", False, [])), request(2, 3, "red"), delete(2, 4),
    turn(2, 5, "u5", asks=("r9", "k", False, [])), request(2, 6, "", "done", "q"),  # an option that isn't offered is its own text
    request(3, 1, "x"), delete(3, 2),
]
EXPECTED = {
    1: (6, False, None, ["r1", "r2"], ["wire", "plug", "fuse"], [("r1", "Off"), ("lamp", "Lamp: off"), ("fuse", "Fuse: new")], [("lamp", "off", "t2:action"), ("fuse", "new", None)]),
    2: (6, False, "done", ["r9"], [], [("r9", "done")], []),
}


def told(states):
    return {r.session: (r.seq, r.acknowledged, r.pending, r.completed, r.ruled_out, [tuple(o) for o in r.observations], [tuple(f) for f in r.facts]) for r in states.collect()}


def test_states_of_sessions(spark):
    events = spark.createDataFrame(EVENTS, S.EVENT)
    assert told(S.session_states(events)) == EXPECTED
    assert told(S.session_states(events.where("seq <= 3 AND session = 1"))) == {1: (3, True, None, [], [], [], [])}
    assert S.session_states(events.limit(0)).count() == 0


def test_stream_equals_batch_over_micro_batches_and_replays(spark, tmp_path):
    rng = random.Random(4)
    more = list(EVENTS)
    for s in range(4, 9):
        for q in range(1, 30):
            asks = (f"r{rng.randint(1, 5)}", f"k{rng.randint(1, 4)}", rng.random() < 0.5, [("a", "A", rng.choice([None, "va"]))]) if rng.random() < 0.8 else None
            facts = [(k, rng.choice("xyz"), k.upper()) for k in rng.sample(["k1", "k2", "k3", "k4"], rng.randint(0, 2))]
            made = [lambda: request(s, q, rng.choice([None, "", "yes", "it beeps", "i understand you"]), rng.choice([None, None, "a", "zz"])), lambda: turn(s, q, f"t{q}", rng.random() < 0.5, facts, rng.sample("abcd", 2), asks)]  # noqa: B023
            more.append(delete(s, q) if rng.random() < 0.06 else rng.choice(made)())
    schema = spark.createDataFrame([], S.EVENT).schema
    for i, low in enumerate((0, 5, 12, 12, 20)):  # the fourth file replays the third
        high = (5, 12, 20, 20, 99)[i]
        spark.createDataFrame([e for e in more if low < e[1] <= high], schema).coalesce(1).write.parquet(f"{tmp_path}/{i}")
        part, = (tmp_path / str(i)).glob("part-*")
        (tmp_path / "in").mkdir(exist_ok=True)
        part.rename(tmp_path / "in" / f"{i}.parquet")
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    snapshots = Z.collected(spark, Z.session_states_stream(raw), str(tmp_path / "check"), str(tmp_path / "out"))
    got = told(S.latest_sessions(snapshots))
    assert got == told(S.session_states(spark.createDataFrame(more, schema)))
    assert got[1] == EXPECTED[1] and got[2] == EXPECTED[2] and 3 not in got
    assert snapshots.where("session = 3 AND deleted").count() == 1  # the tombstone


def test_asof(spark):
    rng = random.Random(2)
    left = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.choice([None, *range(60)]), i) for i in range(400)]
    right = [(rng.choice(["hot", "hot", "hot", "a", "c", None]), rng.choice([None, *range(60)]), rng.randint(0, 9)) for _ in range(90)]
    x, y = spark.createDataFrame(left, "k string, t int, i int"), spark.createDataFrame(right, "k string, t int, v int")
    for inclusive in (False, True):
        expected = {}
        for k, t, i in left:
            known = [(u, v) for h, u, v in right if None not in (h, u, t) and h == k and (u < t or inclusive and u == t)]
            expected[i] = (k, t, max(known, default=None))
        got = {r.i: (r.k, r.t, (r["asof"].t, r["asof"].v) if r["asof"] else None) for r in asof_join(x, y, ["k"], "t", inclusive=inclusive).collect()}
        assert got == expected
    assert asof_join(x.limit(0), y, ["k"], "t").count() == 0
    assert asof_join(x, y.limit(0), ["k"], "t").where("asof IS NULL").count() == 400


def test_contract(spark):
    ask = '{"fact_key": "%s", "recheck_after_action": %s, "options": [{"id": "a"}, {"id": "%s"}]}'
    said = [
        ('{"mode": "clarify", "observation_request": %s, "decision_basis": {}, "facts_learned": [{"key": "k"}], "source_ids": ["[source:s1]"]}' % (ask % ("k", "false", "b")), []),
        ('{"mode": "clarify", "observation_request": %s, "decision_basis": {}, "source_ids": ["s1"]}' % (ask % ("k", "false", "a")), ["option_twice", "known_fact_asked_again"]),
        ('{"mode": "clarify", "observation_request": %s, "next_action": {"why": "w"}, "source_ids": ["source:s1 "]}' % (ask % ("k", "true", "b")), ["clarify_with_action", "clarify_without_basis"]),
        ('{"mode": "clarify", "observation_request": %s, "decision_basis": {}, "source_ids": ["s1", "s7"]}' % (ask % ("k", "true", "b")), ["unknown_source", "recheck_without_action"]),
        ('{"mode": "advance", "next_action": {"why": ""}, "decision_basis": {"discriminates_between": ["a"]}, "source_ids": ["s1"]}', ["advance_without_reason", "advance_without_discrimination"]),
        ('{"mode": "advance", "next_action": {"why": "w"}, "decision_basis": {"discriminates_between": ["a", "b"]}, "facts_learned": [{"key": "z"}, {"key": "z"}], "source_ids": ["s1"]}', ["fact_twice"]),
        ('{"mode": "abstain", "decision_basis": {}}', ["no_source", "abstain_with_basis"]),
        ('{"mode": "solve", "next_action": {}, "source_ids": ["s1"]}', ["solve_goes_on"]),
        ("nothing", ["unreadable", "no_source"]),
    ]
    raw = spark.createDataFrame([("s", i, f"```json\n{t}\n```", ["s1"]) for i, (t, _) in enumerate(said)], "session string, seq int, json string, evidence_ids array<string>")
    got = S.contract_violations(S.planned_turns(raw)).orderBy("seq").select("violations").collect()
    assert [r.violations for r in got] == [v for _, v in said]


def test_canonical_sources(spark):
    ids = ["a", " [source:a] ", "source:a", "[source:source:a]", "a]", "[a"]
    df = spark.createDataFrame([(x,) for x in ids], "id string").select(S.canonical_source(F.col("id")).alias("c"))
    assert [r.c for r in df.collect()] == ["a", "a", "a", "a", "a", "[a"]


def test_typed_stream_on_a_session_without_rocksdb(spark):
    """The state store that typed state needs is set for the stream alone."""
    import os

    import pytest

    from pagewright.plans import session_queries as Q

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    own, default = spark.newSession(), "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    own.conf.set(Z.PROVIDER, default)
    got, want = Q.session_state_stream(own, "/root/testdata/sf0.001"), Q.session_states(own, "/root/testdata/sf0.001")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    assert own.conf.get(Z.PROVIDER) == default
