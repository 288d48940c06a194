"""Registered queries of sessions, evidence, assets, sources and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..functions.canonical import turn_id
from ..operators import assets as A, evidence as E, sessions as S
from ..operators.retrieval import bm25, exact_hits, field_weights, looked_up, rewritten, routed, small
from ..runtime import cut_to_table, held, shared_folder, table
from ..sources import store, tables as X
from ..streaming import sessions as Z
from . import chunk_queries as Q, manuals as M

QUERIES: dict = {}
ORACLES: dict = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _events(spark, sf_dir) -> DataFrame:
    """Events as facts: the user is the session, the type the key, the rounded value the value."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("long").alias("session"), F.col("event_id").alias("seq"), F.col("event_type").alias("key"), F.round("value").cast("long").cast("string").alias("value"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("turn_id"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("recheck_of"))


_EVENTS = "WITH e AS (SELECT user_id::BIGINT AS session, event_id AS seq, event_type AS key, round(value)::BIGINT::VARCHAR AS value, 't' || event_id AS turn_id, CASE WHEN event_id % 3 = 0 THEN event_type END AS recheck_of FROM events)"


@_query(_EVENTS + " SELECT session, key, arg_max(value, seq) AS value FROM e GROUP BY 1, 2")
def fact_ledger(spark, sf_dir: str) -> DataFrame:
    """The last value of each fact."""
    return S.latest_facts(_events(spark, sf_dir))


@_query(_EVENTS + """ SELECT session, seq, key, value, CASE WHEN lag(value) OVER f <> value THEN lag(value) OVER f END AS previous_value,
  CASE WHEN lag(recheck_of) OVER t = key THEN lag(turn_id) OVER t || ':action' END AS observed_after
FROM e WINDOW f AS (PARTITION BY session, key ORDER BY seq), t AS (PARTITION BY session ORDER BY seq)""")
def fact_history(spark, sf_dir: str) -> DataFrame:
    """Each observation with the value before and the recheck it followed."""
    return S.fact_history(_events(spark, sf_dir)).select("session", "seq", "key", "value", "previous_value", "observed_after")


_ACK = f"""trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))"""
_ACKS = "['yes', 'yeah', 'yep', 'okay', 'ok', 'done', 'thanks', 'thank you', 'understood']"
_ACK_PHRASES = "['got it', 'what next', 'what is next', 'whats next', 'i understand', 'i have done it', 'i checked it']"


@_query(f"""
WITH a AS (SELECT conv_id AS session, turn, role, {_ACK} AS said FROM conversations
), b AS (SELECT *, role = 'user' AND (list_contains({_ACKS}, said) OR (len(string_split(said, ' ')) <= 12 AND len(list_filter({_ACK_PHRASES}, lambda k: contains(said, k))) > 0)) AS acknowledged FROM a
), c AS (SELECT *, role = 'user' AND NOT acknowledged AND coalesce(lag(role) OVER w = 'assistant', false) AS answers FROM b WINDOW w AS (PARTITION BY session ORDER BY turn)
), d AS (SELECT *, sum(answers::INT) OVER (PARTITION BY session ORDER BY turn)::BIGINT AS completed FROM c)
SELECT session, turn, acknowledged, completed FROM d WHERE role = 'user'
""")
def session_progress(spark, sf_dir: str) -> DataFrame:
    """Completed steps of each conversation after its user turns."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn", "role", "text")
    return S.progress(c)


def _asked(c: DataFrame, text: Column) -> DataFrame:
    return c.where("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), text.alias("text"), (F.col("conv_id") * 60.0 + F.col("turn")).alias("at"))


@_query("""
WITH RECURSIVE q AS (
  SELECT conv_id * 100 + turn AS query_id, conv_id * 60.0::DOUBLE + turn AS tm, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS c FROM conversations WHERE role = 'user'
), o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY tm, query_id) AS n FROM q
), r AS (
  SELECT c, n, query_id, tm, tm AS start, false AS reused FROM o WHERE n = 1
  UNION ALL SELECT o.c, o.n, o.query_id, o.tm, CASE WHEN o.tm < r.start + 900 THEN r.start ELSE o.tm END, o.tm < r.start + 900 FROM r JOIN o ON o.c = r.c AND o.n = r.n + 1
)
SELECT query_id, reused FROM r
""")
def repeat_query_collapse(spark, sf_dir: str) -> DataFrame:
    """User turns as queries: which ones a retrieval of the last 900 seconds serves."""
    return S.collapse_repeats(_asked(table(spark, sf_dir, "conversations"), F.col("text")), 900.0, []).select("query_id", "reused")


#: Conversations as events of sessions, in SQL that both engines run: users report, assistants ask, some sessions are deleted on the way.
_SESSION_EVENTS = """
SELECT session, seq * 2 + 1 AS seq, CASE WHEN role = 'user' THEN 'request' ELSE 'turn' END AS kind, role, n, CASE WHEN n % 3 > 0 THEN text END AS observation, CASE WHEN n % 5 = 0 THEN concat('o', CAST(n % 3 AS INT)) END AS selected_option, text AS query
FROM (SELECT CAST(conv_id AS BIGINT) AS session, CAST(turn AS BIGINT) AS seq, role, text, length(text) AS n FROM {conversations})
UNION ALL SELECT CAST(conv_id AS BIGINT), CAST(turn AS BIGINT) * 2, 'delete', role, 0, NULL, NULL, NULL FROM {conversations} WHERE length(text) % 13 = 0
"""


def _session_events(c: DataFrame) -> DataFrame:
    """The events with what their turns ask and learn."""
    x = c.sparkSession.sql(_SESSION_EVENTS, conversations=c)
    n, turn = F.col("n"), F.col("kind") == "turn"
    name = lambda prefix, k: F.concat(F.lit(prefix), (n % k).cast("string"))
    option = lambda i, value: F.struct(F.lit(f"o{i}").alias("id"), F.lit(f"Option {i}").alias("label"), value.alias("value"))
    asks = F.struct(name("r", 4).alias("request_id"), name("k", 3).alias("fact_key"), (n % 2 == 0).alias("recheck"), F.array(option(0, F.lit(None).cast("string")), option(1, name("value ", 7))).alias("options"))
    fact = lambda k, v: F.struct(name("k", k).alias("key"), name("v", v).alias("value"), name("Fact ", k).alias("label"))
    return x.select(
        "session", "seq", "kind", "observation", "selected_option", "query", F.when(turn, F.concat(F.lit("t"), F.col("seq").cast("string"))).alias("turn_id"), F.when(turn, n % 3 != 1).alias("acts"),
        F.when(turn, F.array(fact(5, 4), fact(3, 2))).alias("facts"), F.when(turn, F.array(name("c", 5), name("c", 3))).alias("ruled_out"), F.when(turn & (n % 7 != 0), asks).alias("asks"),
    )


def _state_text(states: DataFrame) -> DataFrame:
    """States with their lists as texts."""
    return states.select(
        "session", "seq", "acknowledged", "pending", F.array_join("completed", ",").alias("completed"), F.array_join("ruled_out", ",").alias("ruled_out"),
        F.array_join(F.transform("observations", lambda o: F.concat(o["id"], F.lit("="), o["text"])), "|").alias("observations"),
        F.array_join(F.transform("facts", lambda f: F.concat(f["key"], F.lit("="), f["value"], F.coalesce(F.concat(F.lit("@"), f["after"]), F.lit("")))), "|").alias("facts"),
    )


_STATES = f"""
WITH e0 AS ({_SESSION_EVENTS.replace('{conversations}', 'conversations')}
), e1 AS (SELECT *, count(*) FILTER (kind = 'delete') OVER (PARTITION BY session ORDER BY seq) AS life, count(*) FILTER (kind = 'delete') OVER (PARTITION BY session) AS lives FROM e0
), e2 AS (SELECT *, max(CASE WHEN kind = 'turn' THEN {{'seq': seq, 'n': n}} END) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM e1 WHERE life = lives AND kind <> 'delete'
), e3 AS (SELECT *, CASE WHEN t.n % 7 <> 0 THEN t.n END AS asked, CASE WHEN kind = 'request' THEN nullif(CASE WHEN t.n % 7 <> 0 AND selected_option = 'o0' THEN 'Option 0' WHEN t.n % 7 <> 0 AND selected_option = 'o1' THEN 'value ' || (t.n % 7) ELSE coalesce(nullif(observation, ''), selected_option, query) END, '') END AS said FROM e2
), e4 AS (SELECT *, {_ACK.replace('text', 'said')} AS bare FROM e3
), e5 AS (
  SELECT *, coalesce(kind = 'request' AND said IS NOT NULL AND asked IS NOT NULL AND selected_option IS NULL AND (list_contains({_ACKS}, bare) OR (len(string_split(bare, ' ')) <= 12 AND len(list_filter({_ACK_PHRASES}, lambda k: contains(bare, k))) > 0)), false) AS ack FROM e4
), i AS (
  SELECT session, seq, 0 AS pos, 'step' AS what, 'r' || (asked % 4) AS id, NULL AS txt, NULL AS aft FROM e5 WHERE asked IS NOT NULL AND ((kind = 'request' AND said IS NOT NULL AND NOT ack) OR (kind = 'turn' AND (n % 5 = asked % 3 OR n % 3 = asked % 3)))
  UNION ALL SELECT session, seq, 0, 'observation', 'r' || (asked % 4), said, NULL FROM e5 WHERE asked IS NOT NULL AND kind = 'request' AND said IS NOT NULL AND NOT ack
  UNION ALL SELECT session, seq, 1, 'observation', 'k' || (n % 5), 'Fact ' || (n % 5) || ': v' || (n % 4), NULL FROM e5 WHERE kind = 'turn'
  UNION ALL SELECT session, seq, 2, 'observation', 'k' || (n % 3), 'Fact ' || (n % 3) || ': v' || (n % 2), NULL FROM e5 WHERE kind = 'turn'
  UNION ALL SELECT session, seq, 1, 'fact', 'k' || (n % 5), 'v' || (n % 4), CASE WHEN asked % 2 = 0 AND t.n % 3 <> 1 AND n % 5 = asked % 3 THEN 't' || t.seq || ':action' END FROM e5 WHERE kind = 'turn'
  UNION ALL SELECT session, seq, 2, 'fact', 'k' || (n % 3), 'v' || (n % 2), CASE WHEN asked % 2 = 0 AND t.n % 3 <> 1 AND n % 3 = asked % 3 THEN 't' || t.seq || ':action' END FROM e5 WHERE kind = 'turn'
  UNION ALL SELECT session, seq, 1, 'cause', 'c' || (n % 5), NULL, NULL FROM e5 WHERE kind = 'turn' UNION ALL SELECT session, seq, 2, 'cause', 'c' || (n % 3), NULL, NULL FROM e5 WHERE kind = 'turn'
), j AS (SELECT session, what, id, min(seq * 10 + pos) AS place, arg_max(txt, seq * 10 + pos) AS txt, max({{'s': seq * 10 + pos, 'a': aft}}).a AS aft FROM i GROUP BY 1, 2, 3
), k AS (
  SELECT session, coalesce(string_agg(id, ',' ORDER BY place) FILTER (what = 'step'), '') AS completed, coalesce(string_agg(id, ',' ORDER BY place) FILTER (what = 'cause'), '') AS ruled_out,
         coalesce(string_agg(id || '=' || txt, '|' ORDER BY place) FILTER (what = 'observation'), '') AS observations, coalesce(string_agg(id || '=' || txt || coalesce('@' || aft, ''), '|' ORDER BY place) FILTER (what = 'fact'), '') AS facts FROM j GROUP BY 1
), z AS (SELECT session, max(seq) AS seq, arg_max(ack, seq) AS acknowledged, max({{'s': seq, 'p': CASE WHEN NOT ack THEN said END}}).p AS pending FROM e5 GROUP BY 1)
SELECT z.session, z.seq, acknowledged, pending, coalesce(completed, '') AS completed, coalesce(ruled_out, '') AS ruled_out, coalesce(observations, '') AS observations, coalesce(facts, '') AS facts FROM z LEFT JOIN k ON z.session = k.session
"""


@_query(_STATES)
def session_states(spark, sf_dir: str) -> DataFrame:
    """The state of each conversation's session, from its last deletion on: steps, causes, observations and facts."""
    return _state_text(S.session_states(_session_events(table(spark, sf_dir, "conversations"))))


@_query(_STATES)
def session_state_stream(spark, sf_dir: str) -> DataFrame:
    """The same sessions through the state store: the last snapshot of each one that is not deleted."""
    raw = spark.readStream.schema(table(spark, sf_dir, "conversations").schema).parquet(f"{sf_dir}/conversation[s].parquet")
    return _state_text(S.latest_sessions(Z.collected(spark, Z.session_states_stream(_session_events(raw)), *_work(spark, "sessions"), typed=True)))


def _turns(spark, sf_dir) -> DataFrame:
    """Conversation turns as diagnostic turns with some faults; a turn learns one or two facts."""
    c, t = table(spark, sf_dir, "conversations"), F.col("turn")
    n = F.length("text")
    mode = F.when(F.col("role") == "user", "clarify").when(n % 4 == 0, "solve").when(n % 4 == 1, "advance").otherwise("clarify")
    fact = lambda k, v: F.struct(F.concat(F.lit("k"), k.cast("string")).alias("key"), F.concat(F.lit("v"), v.cast("string")).alias("value"))
    basis = F.when(n % 3 == 1, F.array(F.lit("a"), F.lit("b"))).when(n % 3 == 2, F.array(F.lit("a")))
    return c.select(
        F.col("conv_id").alias("session"), "turn", mode.alias("mode"), F.when(n % 2 == 0, "It went from v0 to V1.").alias("response"), F.when(n % 5 == 0, "now v2").alias("interpretation"),
        F.when(n % 5 < 3, F.lit("try it")).alias("action"), F.when(n % 5 != 0, "because").alias("why"), basis.alias("causes"),
        F.when((mode == "clarify") & (n % 6 != 0), F.concat(F.lit("k"), (n % 4).cast("string"))).alias("asks_key"), (t % 2 == 1).alias("recheck"),
        F.when(n % 7 == 0, F.array(fact(t % 4, n % 3), fact(t % 3, n % 2))).otherwise(F.array(fact(t % 4, n % 3))).alias("facts"),
    )


def _cases(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session")).distinct()
    n = F.col("session")
    mode = F.when(n % 3 == 0, "solve").when(n % 3 == 1, "clarify").otherwise("abstain")
    return c.select("session", (n % 4 == 0).alias("evidence_sufficient"), (n % 5).cast("int").alias("tool_calls"), mode.alias("expected_mode"), (n % 2 + 1).cast("int").alias("most_turns"))


_TURNS = """
WITH m AS (SELECT *, length(text) AS n, CASE WHEN role = 'user' THEN 'clarify' WHEN length(text) % 4 = 0 THEN 'solve' WHEN length(text) % 4 = 1 THEN 'advance' ELSE 'clarify' END AS mode FROM conversations
), t AS (
  SELECT conv_id AS session, turn, mode, n, CASE WHEN mode = 'clarify' AND n % 6 <> 0 THEN 'k' || (n % 4) END AS asks_key, turn % 2 = 1 AS recheck, n % 5 < 3 AS acts, n % 5 <> 0 AS why, n % 3 AS causes,
         lower(concat_ws(' ', CASE WHEN n % 2 = 0 THEN 'It went from v0 to V1.' END, CASE WHEN n % 5 = 0 THEN 'now v2' END)) AS said FROM m
), fc AS (
  SELECT session, turn, 0 AS pos, 'k' || (turn % 4) AS key, 'v' || (n % 3) AS value, said FROM t UNION ALL SELECT session, turn, 1, 'k' || (turn % 3), 'v' || (n % 2), said FROM t WHERE n % 7 = 0
), fl AS (SELECT *, lag(value) OVER (PARTITION BY session, key ORDER BY turn, pos) AS old FROM fc
), ra AS (SELECT session, asks_key AS key, min(turn) AS turn FROM t WHERE asks_key IS NOT NULL AND recheck AND acts GROUP BY 1, 2
), tr AS (
  SELECT fl.*, ra.turn IS NOT NULL AND ra.turn <= fl.turn AS rechecked, contains(said, old) AND contains(said, value) AS told FROM fl LEFT JOIN ra ON fl.session = ra.session AND fl.key = ra.key WHERE old <> value
), kn AS (SELECT session, key, min(turn) AS since FROM fc GROUP BY 1, 2
), cs AS (SELECT DISTINCT conv_id AS session, CASE conv_id % 3 WHEN 0 THEN 'solve' WHEN 1 THEN 'clarify' ELSE 'abstain' END AS expected, conv_id % 2 + 1 AS most FROM conversations
), se AS (SELECT session, arg_max(mode, turn) AS final, min(o) FILTER (mode IN ('advance', 'solve')) AS useful FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY turn) AS o FROM t) GROUP BY 1
), v AS (
  SELECT session, turn, 'advance_without_action' AS violation FROM t WHERE mode = 'advance' AND NOT acts
  UNION ALL SELECT session, turn, 'advance_without_reason' FROM t WHERE mode = 'advance' AND NOT (acts AND why)
  UNION ALL SELECT session, turn, 'advance_without_discrimination' FROM t WHERE mode = 'advance' AND causes <> 1
  UNION ALL SELECT session, turn, 'clarify_without_question' FROM t WHERE mode = 'clarify' AND asks_key IS NULL
  UNION ALL SELECT session, turn, 'clarify_with_action' FROM t WHERE mode = 'clarify' AND acts
  UNION ALL SELECT session, turn, 'clarify_without_basis' FROM t WHERE mode = 'clarify' AND causes = 0
  UNION ALL SELECT session, turn, 'solve_goes_on' FROM t WHERE mode = 'solve' AND (acts OR asks_key IS NOT NULL)
  UNION ALL SELECT session, turn, 'recheck_without_action' FROM t WHERE asks_key IS NOT NULL AND recheck AND NOT acts
  UNION ALL SELECT t.session, t.turn, 'known_fact_asked_again' FROM t JOIN kn ON t.session = kn.session AND asks_key = key AND since < turn WHERE NOT recheck
  UNION ALL SELECT session, turn, 'changed_without_recheck' FROM tr WHERE NOT rechecked
  UNION ALL SELECT session, turn, 'transition_not_acknowledged' FROM tr WHERE NOT told
  UNION ALL SELECT session, NULL, 'needless_search' FROM cs WHERE session % 4 = 0 AND session % 5 > 0
  UNION ALL SELECT session, NULL, 'terminal_mode' FROM cs JOIN se USING (session) WHERE final <> expected
  UNION ALL SELECT session, NULL, 'no_useful_turn' FROM cs JOIN se USING (session) WHERE useful IS NULL AND expected <> 'abstain'
  UNION ALL SELECT session, NULL, 'useful_turn_too_late' FROM cs JOIN se USING (session) WHERE useful > most
), i AS (
  SELECT session, mode, turn, row_number() OVER (PARTITION BY session ORDER BY turn) - sum((mode = 'clarify')::INT) OVER (PARTITION BY session ORDER BY turn) AS island FROM t
), st AS (SELECT session, max(c)::BIGINT AS longest FROM (SELECT session, island, sum((mode = 'clarify')::INT) AS c FROM i GROUP BY 1, 2) GROUP BY 1)
"""


@_query(_TURNS + "SELECT session, turn, violation, count(*) AS times FROM v GROUP BY 1, 2, 3")
def policy_violations(spark, sf_dir: str) -> DataFrame:
    """Breaches of the conversation policy by turn, and of whole sessions (null turn)."""
    return S.policy_violations(_turns(spark, sf_dir), _cases(spark, sf_dir)).groupBy("session", "turn", "violation").agg(F.count("*").alias("times"))


@_query(_TURNS + "SELECT session, longest FROM st")
def clarify_streak(spark, sf_dir: str) -> DataFrame:
    """The longest run of questions of each conversation."""
    return S.streaks(_turns(spark, sf_dir), "mode", "clarify")


@_query(_TURNS + """SELECT (SELECT count(*) FROM st) AS sessions, round((SELECT avg((session NOT IN (SELECT session FROM v))::INT) FROM st), 6) AS pass_rate, (SELECT max(longest) FROM st) AS longest_clarify, (SELECT count(*) FROM v) AS violations,
  (SELECT count(*) FROM tr) AS transitions, (SELECT round(coalesce(avg(told::INT), 1), 6) FROM tr) AS acknowledged_rate, (SELECT round(avg(useful), 6) FROM se) AS mean_first_useful""")
def policy_report(spark, sf_dir: str) -> DataFrame:
    """Sessions, pass rate, longest streak, violations and acknowledged changes of facts."""
    t = _turns(spark, sf_dir)
    return S.policy_report(t, S.policy_violations(t, _cases(spark, sf_dir)))


@_query("""
WITH t AS (SELECT conv_id, turn, CASE length(text) % 5 WHEN 0 THEN 'solve' WHEN 1 THEN 'advance' WHEN 2 THEN 'guess' WHEN 3 THEN 'clarify' ELSE 'abstain' END AS mode, length(text) AS n FROM conversations)
SELECT conv_id, turn, 'turn-' || substr(sha256(conv_id || '|' || turn || '|' || mode), 1, 16) AS turn_id, array_to_string(list_filter([
  CASE WHEN mode = 'guess' THEN 'unknown_mode' END, CASE WHEN mode <> 'abstain' AND n % 3 = 0 THEN 'no_source' END, CASE WHEN n % 3 = 1 THEN 'unknown_source' END,
  CASE WHEN n % 2 = 0 THEN 'fact_twice' END], lambda x: x IS NOT NULL), ',') AS violations FROM t
""")
def turn_gate(spark, sf_dir: str) -> DataFrame:
    """Turns as JSON, parsed and held against their contract, with stable ids."""
    c, n = table(spark, sf_dir, "conversations"), F.length("text")
    mode = F.element_at(F.array(*map(F.lit, ["solve", "advance", "guess", "clarify", "abstain"])), (n % 5 + 1).cast("int"))
    source = F.when(n % 3 == 0, "[]").when(n % 3 == 1, '["s9"]').otherwise('["s1"]')
    facts = F.concat(F.lit('[{"key":"a","value":"1"},{"key":"'), F.when(n % 2 == 0, "a").otherwise("b"), F.lit('","value":"2"}]'))
    text = F.concat(F.lit('```json\n{"mode":"'), mode, F.lit('","facts":'), facts, F.lit(',"source_ids":'), source, F.lit("}\n```"))
    raw = c.select("conv_id", "turn", text.alias("json"), F.array(F.lit("s1"), F.lit("s2")).alias("evidence_ids"), mode.alias("mode"))
    p = S.parsed_turns(raw.withColumnRenamed("turn", "n"))
    return p.select("conv_id", F.col("n").alias("turn"), S.stable_id("turn-", F.col("conv_id").cast("string"), F.col("n").cast("string"), F.col("mode")).alias("turn_id"), F.array_join("violations", ",").alias("violations"))


_PLANS = """
WITH t AS (
  SELECT conv_id AS session, turn AS seq, length(text) AS n, CASE (length(text) + turn) % 6 WHEN 0 THEN 'solve' WHEN 1 THEN 'advance' WHEN 2 THEN 'clarify' WHEN 3 THEN 'abstain' WHEN 4 THEN 'clarify' ELSE 'guess' END AS mode FROM conversations
), f AS (SELECT *, mode <> 'solve' AND n % 7 <> 0 AS asks, n % 3 = 0 AS acts, n % 5 <> 1 AS basis, 'k' || (n % 4) AS wants, n % 2 = 0 AS recheck, 'k' || (n % 5) AS a, 'k' || (n % 2) AS b FROM t
), k AS (SELECT session, key, min(seq) AS since FROM (SELECT session, a AS key, seq FROM f UNION ALL SELECT session, b, seq FROM f) GROUP BY 1, 2)
SELECT f.session, f.seq, array_to_string(list_filter([
  CASE WHEN mode = 'guess' THEN 'unknown_mode' END, CASE WHEN n % 11 = 0 THEN 'no_source' END, CASE WHEN n % 11 = 1 THEN 'unknown_source' END, CASE WHEN a = b THEN 'fact_twice' END, CASE WHEN asks AND n % 9 = 0 THEN 'option_twice' END,
  CASE WHEN asks AND since < f.seq AND NOT recheck THEN 'known_fact_asked_again' END, CASE WHEN asks AND recheck AND NOT acts THEN 'recheck_without_action' END,
  CASE WHEN mode = 'advance' AND NOT acts THEN 'advance_without_action' END, CASE WHEN mode = 'advance' AND acts AND n % 2 = 1 THEN 'advance_without_reason' END, CASE WHEN mode = 'advance' AND NOT (basis AND n % 4 > 1) THEN 'advance_without_discrimination' END,
  CASE WHEN mode = 'clarify' AND NOT asks THEN 'clarify_without_question' END, CASE WHEN mode = 'clarify' AND acts THEN 'clarify_with_action' END, CASE WHEN mode = 'clarify' AND NOT basis THEN 'clarify_without_basis' END,
  CASE WHEN mode = 'solve' AND acts THEN 'solve_goes_on' END, CASE WHEN mode = 'solve' AND basis THEN 'solve_with_basis' END,
  CASE WHEN mode = 'abstain' AND (asks OR acts) THEN 'abstain_goes_on' END, CASE WHEN mode = 'abstain' AND basis THEN 'abstain_with_basis' END], lambda x: x IS NOT NULL), ',') AS violations
FROM f LEFT JOIN k ON f.session = k.session AND k.key = wants
"""


@_query(_PLANS)
def turn_contract(spark, sf_dir: str) -> DataFrame:
    """Conversation turns as planned turns in JSON, held against the whole contract with the facts known by then."""
    n = F.length("text")
    name = lambda prefix, k: F.concat(F.lit(prefix), (n % k).cast("string"))
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), n.alias("n"), F.element_at(F.array(*map(F.lit, ["solve", "advance", "clarify", "abstain", "clarify", "guess"])), ((n + F.col("turn")) % 6 + 1).cast("int")).alias("mode"), name("k", 4).alias("wants"), name("k", 5).alias("a"), name("k", 2).alias("b"))
    m, fact = F.col("n"), lambda k: F.struct(k.alias("key"), F.lit("v").alias("value"))
    options = F.array(F.struct(F.lit("x").alias("id")), F.struct(F.when(m % 9 == 0, "x").otherwise("y").alias("id")))
    turn = F.struct(
        "mode", F.when(m % 3 == 0, F.struct(F.lit("do").alias("instruction"), F.when(m % 2 == 0, "since").alias("why"))).alias("next_action"),
        F.when((F.col("mode") != "solve") & (m % 7 != 0), F.struct(F.col("wants").alias("fact_key"), (m % 2 == 0).alias("recheck_after_action"), options.alias("options"))).alias("observation_request"),
        F.when(m % 5 != 1, F.struct(F.when(m % 4 > 1, F.array(F.lit("p"), F.lit("q"))).otherwise(F.array(F.lit("p"))).alias("discriminates_between"))).alias("decision_basis"),
        F.array(fact(F.col("a")), fact(F.col("b"))).alias("facts_learned"), F.when(m % 11 == 1, F.array(F.lit("s9"))).when(m % 11 != 0, F.array(F.lit(" [source:s1]"))).alias("source_ids"),
    )
    raw = t.select("session", "seq", F.concat(F.lit("```json\n"), F.to_json(turn), F.lit("\n```")).alias("json"), F.array(F.lit("s1"), F.lit("s2")).alias("evidence_ids"))
    return S.contract_violations(S.planned_turns(raw)).select("session", "seq", F.array_join("violations", ",").alias("violations"))


@_query("""
WITH r AS (SELECT s_name, n_name AS manufacturer FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 10 <> 0), f AS (SELECT s_name, s_acctbal FROM supplier WHERE s_suppkey % 9 <> 0)
SELECT coalesce(r.s_name, f.s_name) AS relative_path, manufacturer, s_acctbal AS size, CASE WHEN r.s_name IS NULL THEN 'unregistered_file' WHEN f.s_name IS NULL THEN 'missing_file' ELSE 'matched' END AS status FROM r FULL JOIN f ON r.s_name = f.s_name
""")
def registry_reconcile(spark, sf_dir: str) -> DataFrame:
    """Suppliers as a registry against suppliers as files."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    entries = s.where("s_suppkey % 10 <> 0").join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_name").alias("relative_path"), F.col("n_name").alias("manufacturer"))  # 25 nations
    return X.reconcile(entries, s.where("s_suppkey % 9 <> 0").select(F.col("s_name").alias("relative_path"), F.col("s_acctbal").alias("size")))


@_query("SELECT DISTINCT lower(p_type) AS category, p_brand AS manufacturer, p_name AS model FROM part WHERE p_type IN ('ECONOMY', 'SMALL', 'STANDARD')")
def device_catalog(spark, sf_dir: str) -> DataFrame:
    """Parts as devices of three known categories."""
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("data/raw/"), F.lower("p_type"), F.lit("/x.pdf")).alias("source_file"), F.concat(F.col("p_brand"), F.lit(" ")).alias("manufacturer"), F.col("p_name").alias("model"))
    return X.device_catalog(p, ["economy", "small", "standard"])


@_query("""
WITH u AS (SELECT vec_id, label, 0 AS seq FROM embeddings UNION ALL SELECT vec_id, label + 100, 1 FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id + 1000000, label, 1 FROM embeddings WHERE vec_id % 5 = 0)
SELECT vec_id, label::INT AS label, seq FROM u QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY seq DESC) = 1
""")
def vector_merge(spark, sf_dir: str) -> DataFrame:
    """Vectors with a batch of replacements and additions merged by id."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.lit(0).alias("seq"))
    new = v.where("vec_id % 3 = 0").withColumns({"label": F.col("label") + 100, "seq": F.lit(1)}).unionByName(v.where("vec_id % 5 = 0").withColumns({"vec_id": F.col("vec_id") + 1000000, "seq": F.lit(1)}))
    return X.upsert(v, new, "vec_id", "seq").select("vec_id", "label", "seq")


@_query(ORACLES["vector_merge"])
def keyed_store(spark, sf_dir: str) -> DataFrame:
    """The same merge through a keyed store on disk: three epochs, the second one written twice."""
    path = f"{shared_folder(spark)}/stores/{uuid.uuid4().hex}"
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int").alias("label"), F.lit(0).alias("seq"))
    replaced = v.where("vec_id % 3 = 0").withColumns({"label": F.col("label") + 100, "seq": F.lit(1)})
    added = v.where("vec_id % 5 = 0").withColumns({"vec_id": F.col("vec_id") + 1000000, "seq": F.lit(1)})
    for epoch, batch in ((0, v), (1, replaced), (1, v.withColumn("seq", F.lit(9))), (2, added)):
        store.merge(batch, epoch, path, "vec_id", "seq", buckets=8)
    return store.read(spark, path, v.schema)


@_query("SELECT vec_id, label FROM embeddings WHERE NOT (label = 3)")
def scoped_delete(spark, sf_dir: str) -> DataFrame:
    """Vectors without those of one label."""
    return X.scoped_delete(table(spark, sf_dir, "embeddings"), label=3).select("vec_id", "label")


_FEATURES = """
WITH f0 AS (SELECT p_partkey, p_name, p_size * 20 + 40 AS width, (p_partkey % 37) * 12 + 30 AS height, (p_partkey % 50) / 10.0 AS entropy, (p_partkey % 11) / 100.0 AS edge_density, (p_partkey % 7) / 100.0 AS border_edge_density,
  (p_partkey % 5) / 500.0 AS center_edge_density, 0.8 + (p_partkey % 20) / 100.0 AS near_uniform_fraction, p_partkey % 9 AS component_count, (p_partkey % 25) / 25.0 AS alpha_coverage, p_partkey % 4 = 0 AS blank_center, p_partkey % 3 = 0 AS strong_border,
  p_partkey % 800 AS perceptual_hash, p_partkey % 5 AS n_occurrences FROM {part})"""


def _features(spark, sf_dir) -> DataFrame:
    f = spark.sql(_FEATURES + " SELECT * FROM f0", part=table(spark, sf_dir, "part"))
    return f.withColumn("asset_id", F.col("p_partkey"))


_POINTS = " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for _, p, c in A.RULES)
_WHY = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{r}' END" for r, _, c in A.RULES) + "], lambda x: x IS NOT NULL), ',')"
_SCORED = _FEATURES.replace("{part}", "part") + f", s AS (SELECT *, p_partkey AS asset_id, {_POINTS} AS q, {_WHY} AS reasons FROM f0), c AS (SELECT *, CASE WHEN q >= 2 THEN 'valid' WHEN q >= 0 THEN 'uncertain' ELSE 'reject' END AS cl FROM s)"


@_query(_SCORED + "SELECT asset_id, q::INT AS quality_score, cl AS classification, reasons FROM c")
def asset_scores(spark, sf_dir: str) -> DataFrame:
    """Rule scores of image features made of the parts."""
    return A.scored(_features(spark, sf_dir)).select("asset_id", "quality_score", "classification", F.array_join("reasons", ",").alias("reasons"))


_DEMOTED = _SCORED + """, d AS (SELECT *, min(asset_id) OVER (PARTITION BY perceptual_hash) AS keeper, n_occurrences >= 3 AND width * height < 50000 AS small FROM c
), z AS (SELECT asset_id, q - CASE WHEN small THEN 4 ELSE 0 END - CASE WHEN asset_id <> keeper THEN 2 ELSE 0 END AS q, CASE WHEN small OR asset_id <> keeper THEN 'reject' ELSE cl END AS cl, CASE WHEN asset_id <> keeper THEN keeper END AS duplicate_of FROM d)"""


@_query(_DEMOTED + "SELECT asset_id, q::INT AS quality_score, cl AS classification, duplicate_of FROM z")
def perceptual_dupes(spark, sf_dir: str) -> DataFrame:
    """Scores after repeated small assets and perceptual duplicates are demoted."""
    return A.demote(A.scored(_features(spark, sf_dir))).select("asset_id", "quality_score", "classification", "duplicate_of")


@_query(_DEMOTED + "SELECT asset_id, cl AS classification, q::INT AS quality_score, CASE WHEN cl = 'reject' THEN p_partkey % 5 END AS occurrence_count FROM z JOIN part ON asset_id = p_partkey")
def image_manifest(spark, sf_dir: str) -> DataFrame:
    """Both lists of the images' manifest; only rejected ones have a count of occurrences."""
    kept, rejected = A.manifest(A.demote(A.scored(_features(spark, sf_dir))))
    columns = ["asset_id", "classification", "quality_score", "occurrence_count"]
    return kept.withColumn("occurrence_count", F.lit(None).cast("long")).select(*columns).unionByName(rejected.select(*columns))


@_query("SELECT sha256(p_name || p_type) AS asset_id, count(DISTINCT p_brand || '/' || p_size) AS n_occurrences, min(p_brand) AS first_document FROM part GROUP BY 1")
def asset_groups(spark, sf_dir: str) -> DataFrame:
    """Parts' names as image bytes, grouped by content."""
    p = table(spark, sf_dir, "part").select(F.concat("p_name", "p_type").cast("binary").alias("content"), F.col("p_brand").alias("document_id"), F.col("p_size").alias("page"), F.lit("x.pdf").alias("source_file"))
    g = A.grouped(p)
    return g.select("asset_id", F.col("n_occurrences").cast("long").alias("n_occurrences"), F.element_at("occurrences", 1)["document_id"].alias("first_document"))


@_query(_DEMOTED + ", h AS (SELECT l_orderkey AS query_id, l_partkey % 500 AS chunk_id FROM lineitem), k AS (SELECT p_partkey AS asset_id, p_partkey % 500 AS chunk_id, p_size AS page, p_brand AS title FROM part), g AS (SELECT query_id, k.asset_id, min({'p': page, 't': title}) AS a FROM k JOIN z ON k.asset_id = z.asset_id AND cl = 'valid' JOIN h USING (chunk_id) GROUP BY 1, 2) SELECT query_id, asset_id, a.t AS document_title, a.p AS page FROM g QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY a.t, a.p, asset_id) = 1")
def image_for_hits(spark, sf_dir: str) -> DataFrame:
    """The first valid image of each query's hits."""
    assets = A.demote(A.scored(_features(spark, sf_dir)))
    links = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asset_id"), (F.col("p_partkey") % 500).alias("chunk_id"), F.col("p_brand").alias("document_title"), F.col("p_size").alias("page"))
    hits = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), (F.col("l_partkey") % 500).alias("chunk_id"))
    return A.for_hits(assets, links, hits)


#: The search set: each part whose key is divisible by 20.
WHOLE = "p_partkey % 20 = 0"


def _part_queries(spark, sf_dir, asked=WHOLE) -> DataFrame:
    """Questions about parts, some with an error code or part number."""
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("which unit needs spare part M"), F.lpad(k.cast("string"), 5, "0"), F.lit("-001"))).when(k % 3 == 1, F.concat(F.lit("How do I check the "), F.col("p_name"))).otherwise(F.concat(F.lit("warning for "), F.col("p_name"), F.lit(" will not print")))
    return table(spark, sf_dir, "part").where(asked).select(k.alias("query_id"), text.alias("text"), F.col("p_brand").alias("identity"))


_PQ = """pq AS (SELECT p_partkey AS query_id, CASE p_partkey % 3 WHEN 0 THEN 'which unit needs spare part M' || lpad(p_partkey::VARCHAR, 5, '0') || '-001' WHEN 1 THEN 'How do I check the ' || p_name ELSE 'warning for ' || p_name || ' will not print' END AS text FROM part WHERE p_partkey % 20 = 0)"""


_SYNONYMS = """('topic', ['topics']), ('chapter', ['topics']), ('required', ['requirements', 'requirement']), ('setting', ['setup']), ('lcd', ['control', 'panel', 'overview', 'liquid', 'display']), ('toner', ['led']), ('paper', ['led']),
  ('warning', ['caution', 'safety']), ('caution', ['warning', 'safety']), ('button', ['power']), ('buttons', ['power']), ('plus', ['buttons']), ('minus', ['buttons'])"""


def _holds(text: str, *terms: str) -> str:
    return "(" + " OR ".join(f"contains({text}, '{t}')" for t in terms) + ")"


_REWRITTEN = Q.EVERY + f""", bc AS (SELECT chunk_id, any_value(document_id) AS document_id, any_value(section) AS section, any_value(page) AS page, any_value(regexp_extract(evidence, '^([0-9]+):', 1)::INT) AS first_page, any_value(content) AS content FROM every WHERE retrieval_profiles LIKE '%bm25%' GROUP BY 1
), bx AS (SELECT chunk_id, 'body' AS field, regexp_extract_all(lower(content), '[a-z0-9]+(?:[-_][a-z0-9]+)*') AS t FROM bc UNION ALL SELECT chunk_id, 'section', regexp_extract_all(lower(string_split(section, ' > ')[-1]), '[a-z0-9]+(?:[-_][a-z0-9]+)*') FROM bc
), {_PQ}, qw AS (
  SELECT query_id, lower(text) AS q, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+(?:[-_][a-z0-9]+)*'), lambda w: NOT list_contains(regexp_extract_all(lower(p_brand), '[a-z0-9]+(?:[-_][a-z0-9]+)*'), w)) AS words FROM pq JOIN part ON query_id = p_partkey
), syn AS (SELECT * FROM (VALUES {_SYNONYMS}) AS y(word, more)
), qt AS (
  SELECT query_id, words, unnest(words) AS token FROM qw UNION ALL SELECT query_id, words, unnest(more) FROM (SELECT query_id, words, unnest(words) AS word FROM qw) JOIN syn USING (word)
  UNION ALL SELECT query_id, words, unnest(['power', 'button']) FROM qw WHERE list_has_all(words, ['turn', 'off'])
  UNION ALL SELECT query_id, words, unnest(['printer', 'does', 'not', 'print', 'troubleshoot', 'problem', 'solve']) FROM qw WHERE list_contains(words, 'print') AND list_has_any(words, ['not', 'cannot', 'unable', 'wont', 'fails', 'failure', 'offline'])
), qn AS (SELECT query_id, token, count(*) AS times FROM qt WHERE NOT list_has_any(words, ['topic', 'topics']) OR token IN ('topic', 'topics', 'chapter', 'section') GROUP BY 1, 2
), qf AS (
  SELECT query_id, CASE WHEN topic THEN 0.35::DOUBLE ELSE 1.0::DOUBLE END AS body, greatest(CASE WHEN topic THEN 6.0::DOUBLE WHEN plain THEN 2.5::DOUBLE ELSE 1.0::DOUBLE END, CASE WHEN failing THEN 4.0::DOUBLE ELSE 0.0::DOUBLE END) AS section
  FROM (SELECT query_id, {_holds("q", "chapter", "topic", "section", "where is")} AS topic,
    {_holds("q", "how do i", "how can i", "steps", "set up", "setup", "connect", "remove", "warning", "caution", "safety", "hot surface", "led", "light", "blink", "beep", "lcd", "button")} AS plain,
    contains(q, 'print') AND {_holds("q", "not", "cannot", "unable", "won''t", "wont", "offline")} AS failing FROM qw)
), bs AS (SELECT field, count(*) AS n, greatest(avg(len(t)), 1.0) AS mean FROM bx GROUP BY 1
), bh AS (SELECT field, chunk_id, len, token, count(*) AS tf FROM (SELECT field, chunk_id, len(t) AS len, unnest(t) AS token FROM bx) WHERE token IN (SELECT token FROM qn) GROUP BY 1, 2, 3, 4
), bf AS (SELECT field, token, count(*) AS df FROM bh GROUP BY 1, 2
), bt AS (
  SELECT query_id, chunk_id, round(sum(times * CASE field WHEN 'body' THEN qf.body ELSE qf.section END * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score
  FROM bh JOIN bf USING (field, token) JOIN bs USING (field) JOIN qn USING (token) JOIN qf USING (query_id) GROUP BY 1, 2
), bq AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM bt QUALIFY rank <= 5)
"""
_EVIDENCE = _REWRITTEN + ", ev AS (SELECT query_id, rank, chunk_id, content, document_id, page, first_page, section FROM bq JOIN bc USING (chunk_id) WHERE trim(content) <> '')"


@_query(_REWRITTEN + "SELECT query_id, chunk_id, score, rank FROM bq")
def bm25_query_rewrite(spark, sf_dir: str) -> DataFrame:
    """BM25 over table rows and identifiers of the parts' manuals with rewritten queries and weighted fields."""
    with held(Q._lines(spark, sf_dir)) as line:  # chunks are read once and are no table
        return _rewritten_hits(spark, sf_dir, Q.strategies(line))


def _rewritten_hits(spark, sf_dir, every: DataFrame) -> DataFrame:
    c = every.where(F.array_contains("retrieval_profiles", "bm25"))
    chunks = c.select("chunk_id", F.col("content").alias("body"), F.substring_index("section", " > ", -1).alias("section"))
    q = _part_queries(spark, sf_dir)
    body, section = field_weights(F.col("text"))
    q = q.withColumn("terms", rewritten(F.col("text"), F.col("identity"))).withColumns({"body_weight": body, "section_weight": section})
    return bm25(chunks, q, 5, fields=("body", "section"), copies=True)  # an identifier's chunk may come by two kinds


_EXACT = ", x AS (" + Q._IDENTS + "SELECT * FROM idn" + """), h AS (
  SELECT DISTINCT query_id, 'exact:' || substr(sha256(document_id || '|exact|' || section || '|' || page || '|' || context), 1, 24) AS chunk_id FROM x JOIN pq ON list_contains(list_transform(regexp_extract_all(lower(pq.text), '[a-z0-9]+(?:[-_][a-z0-9]+)+|[a-z]+\\d+|\\d+[a-z]+|\\b\\d{2,}\\b'), lambda v: regexp_replace(v, '[^a-z0-9]', '', 'g')), regexp_replace(lower(normalized_value), '[^a-z0-9]', '', 'g'))
) """
_EXACT_HITS = "SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id)::INT AS rank, 1.0::DOUBLE AS score FROM h QUALIFY rank <= 5"


@_query("WITH " + _PQ + _EXACT + _EXACT_HITS)
def exact_identifier_hits(spark, sf_dir: str) -> DataFrame:
    """Identifier chunks that hold an identifier of the query."""
    return exact_hits(K_identifier_chunks(spark, sf_dir), _part_queries(spark, sf_dir), 5)


def K_identifier_chunks(spark, sf_dir) -> DataFrame:
    from ..operators import chunking, structure

    return chunking.identifier_chunks(structure.identifiers(Q._lines(spark, sf_dir)))


@_query(_REWRITTEN + _EXACT + f", eh AS ({_EXACT_HITS}) SELECT query_id, chunk_id, rank, score, 'exact' AS route FROM eh UNION ALL SELECT query_id, chunk_id, rank, score, 'hybrid' FROM bq WHERE query_id NOT IN (SELECT query_id FROM eh)")
def exact_identifier_route(spark, sf_dir: str) -> DataFrame:
    """Exact hits where the query names an identifier, BM25 hits elsewhere."""
    q = _part_queries(spark, sf_dir)
    with held(Q._lines(spark, sf_dir)) as line:  # identifiers are read by both routes, the other chunks by one
        every = Q.strategies(line)
        exact, other = cut_to_table(exact_hits(every, q, 5)), _rewritten_hits(spark, sf_dir, every)
    return routed(exact, other.select("query_id", "chunk_id", "rank", "score"), q)


def _evidence(spark, sf_dir) -> DataFrame:
    """Evidence of the rewritten queries; every third query's hits come with a payload that can be cited as it is."""
    # what a hit is cited by: its first evidence; ordinals are not asked for, so nothing is sorted
    every = Q.every_chunk(spark, sf_dir, 1).select("chunk_id", "document_id", "section", "page", "pages", "content", "parent_chunk_id", "retrieval_profiles", "evidence")
    found = _rewritten_hits(spark, sf_dir, every)
    # the chunks that are hit and their parents are all that is looked up
    own = cut_to_table(looked_up(every, found, "chunk_id").dropDuplicates(["chunk_id"]))
    up = looked_up(every, own.select(F.col("parent_chunk_id").alias("chunk_id")).dropna(), "chunk_id")
    chunks = cut_to_table(own.unionByName(up).dropDuplicates(["chunk_id"]))
    documents = small(cut_to_table(M.manual_documents(spark, sf_dir)))
    hits = found.join(chunks.select("chunk_id", "document_id", "page", "section", "parent_chunk_id"), "chunk_id").join(documents, "document_id")
    payload = hits.withColumns({"document_title": F.upper("title"), "document_version": F.when(F.col("query_id") % 3 == 0, F.col("version"))})
    return E.assembled(payload, chunks, documents)


@_query(_EVIDENCE + f""", dd AS ({M.MANUAL_DOCUMENTS.replace('{part}', 'part')})
SELECT query_id, rank, document_id, CASE WHEN query_id % 3 = 0 THEN upper(title) ELSE title END AS document_title, manufacturer, model, version AS document_version, page, section, source_url
FROM (SELECT query_id, rank, document_id, section, CASE WHEN query_id % 3 = 0 THEN page ELSE first_page END AS page FROM ev) JOIN dd USING (document_id)
QUALIFY row_number() OVER (PARTITION BY query_id, document_id, page, section ORDER BY rank) = 1""")
def citations(spark, sf_dir: str) -> DataFrame:
    """Citations of the rewritten queries' evidence, one a place."""
    return E.citations(_evidence(spark, sf_dir))


@_query(_EVIDENCE + "SELECT query_id, string_agg('[source:' || chunk_id || '] ' || document_id || ' p. ' || CASE WHEN query_id % 3 = 0 THEN page ELSE first_page END || ' ' || section || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS context FROM ev GROUP BY 1")
def context_blocks(spark, sf_dir: str) -> DataFrame:
    """The evidence of each query as one text."""
    return E.contexts(_evidence(spark, sf_dir))


_SAID = ["The printer will not print", "How do I print", "Print fails on wifi", "It cannot print, toner is new"]
_HEADS = ["The printer does not print", "Solve problems", "It cannot print after setup", "Cannot print"]
_TEXTS = ["Check the WLAN of the ", "Restart the ", "Open the firewall for the ", "Clear a misfeed of the ", "Change the toner of the ", "Delete a stored job of the ", "A usb cable fits the "]


def _picked(k: str, values: list[str]) -> str:
    return f"CASE {k} % {len(values)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(values)) + " END"


_HITS = f"""h AS (SELECT p_partkey AS id, {_picked('p_partkey', _SAID)} AS query, {_picked('p_size', _HEADS)} AS section, {_picked('p_partkey', _TEXTS)} || p_name AS content FROM part)"""
_GROUPS = [
    ["wireless", "wi-fi", "wifi", "wlan"], ["firewall"], ["multiple sheets", "misfeed", "pick up paper", "paper feed"],
    ["print quality", "image defect", "toner", "streak", "blur", "blank page"], ["job storage", "stored job", "private print", "delayed print"],
]


def _has(column: str, terms: list[str]) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(column, t.replace("'", "''")) for t in terms) + ")"


_FOREIGN = " OR ".join(f"({_has('body', g)} AND NOT {_has('q', g)})" for g in _GROUPS)
_BROAD = "(contains(q, 'print') AND " + _has("q", ["not", "cannot", "unable", "won't", "wont", "fails", "offline"]) + ")"


@_query(f"""WITH {_HITS}, x AS (SELECT id, lower(query) AS q, lower(section) AS s, lower(section || chr(10) || content) AS body FROM h)
SELECT id FROM x WHERE NOT {_BROAD} OR ({_has('s', ['does not print', 'cannot print'])} AND NOT ({_FOREIGN}) AND NOT contains(s, 'after '))""")
def evidence_filter(spark, sf_dir: str) -> DataFrame:
    """Evidence that fits a broad failure report, over hits made of the parts."""
    pick = lambda k, values: F.element_at(F.array(*map(F.lit, values)), (F.col(k) % len(values) + 1).cast("int"))
    h = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), pick("p_partkey", _SAID).alias("query"), pick("p_size", _HEADS).alias("section"), F.concat(pick("p_partkey", _TEXTS), F.col("p_name")).alias("content"))
    return E.specific_evidence(h).select("id")


def _work(spark, name) -> tuple[str, str]:
    base = f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"
    return f"{base}/checkpoint", f"{base}/out"


@_query(_EVENTS + " SELECT session, seq, key, value, CASE WHEN lag(value) OVER f <> value THEN lag(value) OVER f END AS previous_value FROM e WINDOW f AS (PARTITION BY session, key ORDER BY seq)")
def fact_stream(spark, sf_dir: str) -> DataFrame:
    """The fact history as a stateful stream over the events, run to the end of the input."""
    raw = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")
    facts = raw.select(F.col("user_id").cast("long").alias("session"), F.col("event_id").alias("seq"), F.col("event_type").alias("key"), F.round("value").cast("long").cast("string").alias("value"), F.lit(False).alias("deleted"))
    return Z.collected(spark, Z.fact_history_stream(facts), *_work(spark, "facts"))


@_query(ORACLES["repeat_query_collapse"].replace("SELECT query_id, reused FROM r", "SELECT query_id, c AS canonical FROM r WHERE NOT reused"))
def repeat_query_stream(spark, sf_dir: str) -> DataFrame:
    """User turns' whole texts as a stream at the times of ``repeat_query_collapse``: those that retrieve.

    The times begin at a date, as the first watermark is the epoch and what isn't after it is late.
    """
    raw = spark.readStream.schema(table(spark, sf_dir, "conversations").schema).parquet(f"{sf_dir}/conversation[s].parquet")
    asked = _asked(raw, F.col("text")).withColumn("at", F.timestamp_seconds(F.col("at") + 1_700_000_000))
    return Z.collected(spark, Z.first_queries_stream(asked), *_work(spark, "queries")).select("query_id", "canonical")


@_query("""
SELECT event_id, 'turn-' || substr(sha256('{"event":"' || event_type || '","id":' || event_id || ',"props":' || replace(props, ' ', '') || ',"user":{"id":' || user_id || ',"name":"\\u00fc"}}'), 1, 16) AS turn_id FROM events
""")
def canonical_turn_ids(spark, sf_dir: str) -> DataFrame:
    """Ids of events as JSON payloads whose keys are in another order."""
    text = lambda c: F.col(c).cast("string")
    payload = F.concat(F.lit('{"user": {"name": "ü", "id": '), text("user_id"), F.lit('},\n "props": '), F.col("props"), F.lit(', "id": '), text("event_id"), F.lit(', "event": "'), F.col("event_type"), F.lit('"}'))
    return table(spark, sf_dir, "events").select("event_id", turn_id(payload).alias("turn_id"))
