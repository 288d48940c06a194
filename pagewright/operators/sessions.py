"""Diagnostic sessions as batch jobs: facts, history, progress, policy checks and turn contracts."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..functions import text as T
from ..runtime import cut_lineage, partitions, python_ready
from .asof import asof_join


def latest_facts(events: DataFrame) -> DataFrame:
    """session, key, value: the last value of each fact (by seq)."""
    return events.groupBy("session", "key").agg(F.max_by("value", "seq").alias("value"))


def fact_history(events: DataFrame) -> DataFrame:
    """Each observation with the value before (only if it changed) and the action it was observed after.

    ``events`` may have recheck_of: the key whose recheck the turn before asked for.
    """
    fact = Window.partitionBy("session", "key").orderBy("seq")
    turn = Window.partitionBy("session").orderBy("seq")
    before = F.lag("value").over(fact)
    out = events.withColumn("previous_value", F.when(before != F.col("value"), before))
    asked = F.lag("recheck_of").over(turn)
    return out.withColumn("observed_after", F.when(asked == F.col("key"), F.concat(F.lag("turn_id").over(turn), F.lit(":action"))))


def progress(turns: DataFrame) -> DataFrame:
    """session, turn, acknowledged, completed: completed steps after each user turn.

    A user turn that doesn't merely acknowledge completes the request of the assistant turn before.
    """
    w = Window.partitionBy("session").orderBy("turn")
    x = turns.withColumn("acknowledged", (F.col("role") == "user") & T.acknowledgement(F.col("text")))
    x = x.withColumn("answers", (F.col("role") == "user") & ~F.col("acknowledged") & F.coalesce(F.lag("role").over(w) == "assistant", F.lit(False)))
    done = F.sum(F.col("answers").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return x.withColumn("completed", done).where("role = 'user'").select("session", "turn", "acknowledged", "completed")


#: What happens in a session, in order of ``seq``: requests (observation, option, query), turns of the planner and deletions.
EVENT = (
    "session long, seq long, kind string, observation string, selected_option string, query string, turn_id string, acts boolean, "
    "facts array<struct<key:string,value:string,label:string>>, ruled_out array<string>, "
    "asks struct<request_id:string,fact_key:string,recheck:boolean,options:array<struct<id:string,label:string,value:string>>>"
)
#: A session's state after an event; lists are in the order in which their members first came.
STATE = (
    "session long, seq long, deleted boolean, acknowledged boolean, pending string, completed array<string>, ruled_out array<string>, "
    "observations array<struct<id:string,text:string>>, facts array<struct<key:string,value:string,after:string>>"
)


def submitted(observation: Column, option: Column, query: Column, options: Column) -> Column:
    """What a request reports: the chosen option's value (else label), else its observation, its option or its query."""
    some = lambda c: F.nullif(c, F.lit(""))
    hit = F.try_element_at(F.filter(options, lambda o: o["id"] == option), F.lit(1))
    chosen = F.when(hit.isNotNull(), F.coalesce(some(hit["value"]), hit["label"], F.lit("")))
    return F.coalesce(chosen, some(observation), some(option), query)


def session_states(events: DataFrame) -> DataFrame:
    """The state of each session (STATE) after all its ``events`` (EVENT); deleted sessions have none, and start anew.

    A report completes the request of the turn before, unless it only acknowledges it in words; facts complete
    it too where they answer it.  Steps and causes count once, observations and facts keep their place and take
    the last text; a fact says the action it was observed after, if a recheck was asked for.
    """
    whole, order = Window.partitionBy("session"), Window.partitionBy("session").orderBy("seq")
    upto, before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, -1)
    x = events.withColumn("_life", F.sum((F.col("kind") == "delete").cast("int")).over(upto)).withColumn("_last", F.max("_life").over(whole))
    x = x.where((F.col("_life") == F.col("_last")) & (F.col("kind") != "delete"))
    x = x.withColumn("_turn", F.last(F.when(F.col("kind") == "turn", F.struct("turn_id", "acts", "asks")), True).over(before))
    request, now = F.col("_turn.asks"), F.col("kind") == "request"
    said = submitted(F.col("observation"), F.col("selected_option"), F.col("query"), request["options"])
    x = x.withColumn("_said", F.when(now, F.nullif(said, F.lit(""))))
    x = x.withColumn("_ack", now & F.col("_said").isNotNull() & request.isNotNull() & F.coalesce(F.col("selected_option"), F.lit("")).isin("") & T.acknowledgement(F.col("_said")))
    reports = now & F.col("_said").isNotNull() & request.isNotNull() & ~F.col("_ack")
    answered = F.exists("facts", lambda f: f["key"] == request["fact_key"])
    after = F.when(request["recheck"] & F.col("_turn.acts"), F.concat("_turn.turn_id", F.lit(":action")))
    none = F.array().cast("array<struct<kind:string,id:string,text:string,after:string>>")
    item = lambda kind, id, text, then=F.lit(None).cast("string"): F.struct(F.lit(kind).alias("kind"), id.alias("id"), text.alias("text"), then.alias("after"))
    empty, fact = F.lit(None).cast("string"), F.coalesce("facts", F.array().cast("array<struct<key:string,value:string,label:string>>"))
    parts = [
        F.when(reports | F.coalesce(answered & ~now, F.lit(False)), F.array(item("step", request["request_id"], empty))), F.when(reports, F.array(item("observation", request["request_id"], F.col("_said")))),
        F.when(~now, F.transform(fact, lambda f: item("observation", f["key"], F.concat(f["label"], F.lit(": "), f["value"])))),
        F.when(~now, F.transform(fact, lambda f: item("fact", f["key"], f["value"], F.when(f["key"] == request["fact_key"], after)))),
        F.when(~now, F.transform(F.coalesce("ruled_out", F.array().cast("array<string>")), lambda c: item("cause", c, empty))),
    ]
    x = x.select("session", "seq", "kind", "_said", "_ack", F.flatten(F.array(*[F.coalesce(p, none) for p in parts])).alias("_items"))
    last = x.groupBy("session").agg(F.max("seq").alias("seq"), F.max_by(F.struct(F.col("_ack").alias("ack"), F.when(~F.col("_ack"), F.col("_said")).alias("pending")), "seq").alias("end"))
    items = x.select("session", "seq", F.posexplode("_items").alias("pos", "i")).groupBy("session", "i.kind", "i.id")
    items = items.agg(F.min(F.struct("seq", "pos")).alias("place"), F.max_by(F.struct("i.text", "i.after"), F.struct("seq", "pos")).alias("now"))
    lists = items.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("place", "kind", "id", "now"))).alias("all"))
    of = lambda kind: F.filter(F.coalesce("all", F.array().cast("array<struct<place:struct<seq:bigint,pos:int>,kind:string,id:string,now:struct<text:string,after:string>>>")), lambda v: v["kind"] == kind)
    ids = lambda kind: F.transform(of(kind), lambda v: v["id"])
    return last.join(lists, "session", "left").select(
        "session", "seq", F.lit(False).alias("deleted"), F.col("end.ack").alias("acknowledged"), F.col("end.pending").alias("pending"), ids("step").alias("completed"), ids("cause").alias("ruled_out"),
        F.transform(of("observation"), lambda v: F.struct(v["id"].alias("id"), v["now"]["text"].alias("text"))).alias("observations"),
        F.transform(of("fact"), lambda v: F.struct(v["id"].alias("key"), v["now"]["text"].alias("value"), v["now"]["after"].alias("after"))).alias("facts"),
    )


def latest_sessions(snapshots: DataFrame) -> DataFrame:
    """The last snapshot (by seq) of each session; sessions whose last one says deleted have none."""
    held = snapshots.groupBy("session").agg(F.max_by(F.struct(*snapshots.columns), "seq").alias("s"))
    return held.select("s.*").where("NOT deleted")


def streaks(turns: DataFrame, mode: str, value: str) -> DataFrame:
    """session, longest: the longest run of turns whose ``mode`` is ``value``."""
    w = Window.partitionBy("session").orderBy("turn")
    hit = (F.col(mode) == value).cast("int")
    island = F.row_number().over(w) - F.sum(hit).over(w)
    runs = turns.select("session", hit.alias("hit"), island.alias("island")).groupBy("session", "island").agg(F.sum("hit").alias("n"))
    return runs.groupBy("session").agg(F.max("n").alias("longest"))


def collapse_repeats(asked: DataFrame, ttl: float, keys: list[str]) -> DataFrame:
    """``asked`` with ``canonical`` and ``reused``: whether an equal query was retrieved within ``ttl`` before.

    Times are seconds.  A retrieval serves equal queries until ``ttl`` after it began, so the next one
    after that retrieves again.  Ranges of (query, time) go to tasks, so a frequent query has several.
    Each range first says where its last retrieval is for any retrieval before the range, then streams its rows.
    """
    spark = asked.sparkSession
    python_ready(spark)
    canonical = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    x = asked.withColumn("canonical", F.sha2(F.concat_ws("|", canonical, *keys), 256))
    order = ["canonical", "at", "query_id"]
    x = cut_lineage(x.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)).withColumn("_part", F.spark_partition_id())

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last, start, times = None, None, None, None, []
        for b in batches:
            for part, text, at in zip(*(b.column(c).to_pylist() for c in ("_part", "canonical", "at")), strict=True):
                first = text if first is None else first
                if text == first:
                    if at is not None and not (times and times[-1] == at):
                        times.append(float(at))
                    continue
                start = None if text != last else start
                last = text
                if at is None or start is None or at >= start + ttl:
                    start = at
        if first is None:
            return
        final = times[:]
        for i in range(len(times) - 1, -1, -1):
            then = bisect_left(times, times[i] + ttl)
            final[i] = final[then] if then < len(times) else times[i]
        steps = [i for i in range(len(times)) if i + 1 == len(times) or final[i] != final[i + 1]]
        # a retrieval from before the range serves until ttl after the range's first time at most
        steps = steps[: bisect_left([times[i] for i in steps], times[0] + ttl) + 1] if times else steps
        row = {"part": part, "first": first, "upto": [times[i] for i in steps], "final": [final[i] for i in steps], "last": last, "start": None if start is None else float(start)}
        yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("first", pa.string()), ("upto", pa.list_(pa.float64())), ("final", pa.list_(pa.float64())), ("last", pa.string()), ("start", pa.float64())]))

    before, text, start = {}, None, None
    for r in sorted(x.select("_part", "canonical", "at").mapInArrow(ends, "part int, first string, upto array<double>, final array<double>, last string, start double").collect(), key=lambda r: r.part):
        start = start if text == r.first else None
        before[r.part] = (r.first, start)
        at = 0 if start is None else bisect_left(r.upto, start + ttl)
        text, start = (r.last, r.start) if r.last is not None else (r.first, r.final[at] if at < len(r.final) else start)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = start = None
        fresh = True
        for b in batches:
            if fresh and b.num_rows:
                text, start = before[b.column("_part")[0].as_py()]
                fresh = False
            reused = []
            for said, at in zip(b.column("canonical").to_pylist(), b.column("at").to_pylist(), strict=True):
                start = start if said == text else None
                text = said
                reused.append(start is not None and at is not None and at < start + ttl)
                start = start if reused[-1] else at
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(reused, pa.bool_())], names=[*b.schema.names, "reused"])

    return x.mapInArrow(judged, StructType([*x.schema.fields, StructField("reused", BooleanType())])).drop("_part")


def transitions(turns: DataFrame) -> DataFrame:
    """session, turn, key, old, value, rechecked, told: each change of a known fact.

    ``rechecked``: a turn up to this one asked to recheck the fact and had an action; ``told``: response and
    interpretation name the old and the new value.  Facts of one turn are learned in their order.
    """
    said = F.lower(F.concat_ws(" ", "response", "interpretation"))
    facts = turns.select("session", "turn", said.alias("said"), F.posexplode("facts").alias("pos", "f")).select("session", "turn", "said", "pos", "f.*")
    facts = facts.withColumn("old", F.lag("value").over(Window.partitionBy("session", "key").orderBy("turn", "pos"))).where(F.col("old") != F.col("value"))
    asked = turns.where(F.col("asks_key").isNotNull() & F.col("recheck") & F.col("action").isNotNull()).groupBy("session", F.col("asks_key").alias("key")).agg(F.min("turn").alias("since"))
    told = F.contains("said", F.lower("old")) & F.contains("said", F.lower("value"))
    return facts.join(asked, ["session", "key"], "left").select("session", "turn", "key", "old", "value", F.coalesce(F.col("since") <= F.col("turn"), F.lit(False)).alias("rechecked"), told.alias("told"))


def _ends(turns: DataFrame) -> DataFrame:
    """session, final (the last mode), useful (the place of the first turn that advances or solves)."""
    place = F.row_number().over(Window.partitionBy("session").orderBy("turn"))
    useful = F.when(F.col("mode").isin("advance", "solve"), F.col("place"))
    return turns.select("session", "turn", "mode", place.alias("place")).groupBy("session").agg(F.max_by("mode", "turn").alias("final"), F.min(useful).alias("useful"))


def policy_violations(turns: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """session, turn, violation: what breaks the conversation policy; the turn is null for a whole session.

    ``turns``: session, turn, mode, response, interpretation, action (null: none), why, causes (those the
    turn tells apart; null: no basis), asks_key (the fact it asks for; null: none), recheck (after the
    action), facts (array of key, value: learned).  ``cases``: session, evidence_sufficient, tool_calls,
    expected_mode, most_turns (to the first useful one).  A turn may break a rule for each of its facts.
    """
    mode, asks, acts = F.col("mode"), F.col("asks_key").isNotNull(), F.col("action").isNotNull()
    causes = F.coalesce(F.size("causes"), F.lit(0))
    rules = [
        ((mode == "advance") & ~acts, "advance_without_action"),
        ((mode == "advance") & (~acts | (F.coalesce("why", F.lit("")) == "")), "advance_without_reason"),
        ((mode == "advance") & (causes < 2), "advance_without_discrimination"),
        ((mode == "clarify") & ~asks, "clarify_without_question"),
        ((mode == "clarify") & acts, "clarify_with_action"),
        ((mode == "clarify") & F.col("causes").isNull(), "clarify_without_basis"),
        ((mode == "solve") & (acts | asks), "solve_goes_on"),
        ((mode == "abstain") & (acts | asks), "abstain_goes_on"),
        (asks & F.col("recheck") & ~acts, "recheck_without_action"),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for c, r in rules]))
    out = turns.select("session", "turn", F.explode(found).alias("violation"))
    known = turns.select("session", "turn", F.explode("facts").alias("f")).groupBy("session", F.col("f.key").alias("asks_key")).agg(F.min("turn").alias("since"))
    again = turns.where(asks & ~F.col("recheck")).join(known, ["session", "asks_key"]).where("since < turn")
    out = out.unionByName(again.select("session", "turn", F.lit("known_fact_asked_again").alias("violation")))
    changed = transitions(turns)
    why = F.array_compact(F.array(F.when(~F.col("rechecked"), F.lit("changed_without_recheck")), F.when(~F.col("told"), F.lit("transition_not_acknowledged"))))
    out = out.unionByName(changed.select("session", "turn", F.explode(why).alias("violation")))
    if cases is None:
        return out
    late = [
        (F.col("evidence_sufficient") & (F.col("tool_calls") > 0), "needless_search"), (F.col("final") != F.col("expected_mode"), "terminal_mode"),
        (F.col("useful").isNull() & (F.col("expected_mode") != "abstain"), "no_useful_turn"), (F.col("useful") > F.col("most_turns"), "useful_turn_too_late"),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for c, r in late]))
    whole = cases.join(_ends(turns), "session").select("session", F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"), F.explode(found).alias("violation"))
    return out.unionByName(whole)


def policy_report(turns: DataFrame, violations: DataFrame) -> DataFrame:
    """One row: sessions, the share without violations, the longest streak of questions, and the share of changed facts that are told."""
    per = _ends(turns).join(violations.groupBy("session").agg(F.count("*").alias("n")), "session", "left").join(streaks(turns, "mode", "clarify"), "session")
    whole = per.agg(
        F.count("*").alias("sessions"), F.round(F.avg(F.col("n").isNull().cast("int")), 6).alias("pass_rate"), F.max("longest").alias("longest_clarify"), F.coalesce(F.sum("n"), F.lit(0)).alias("violations"),
        F.round(F.avg("useful"), 6).alias("mean_first_useful"),
    )
    told = transitions(turns).agg(F.count("*").alias("transitions"), F.round(F.coalesce(F.avg(F.col("told").cast("int")), F.lit(1.0)), 6).alias("acknowledged_rate"))
    return whole.crossJoin(F.broadcast(told))  # one row each


TURN = "mode string, response string, facts array<struct<key:string,value:string>>, options array<struct<id:string,label:string,value:string>>, source_ids array<string>"


def parsed_turns(raw: DataFrame) -> DataFrame:
    """``raw`` (turn_id, json, evidence_ids) with the parsed turn and the ``violations`` of its contract.

    Code fences around the JSON are stripped; text is trimmed; an option without a value gets its label.
    """
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim("json"), r"^```(?:json)?\s*", ""), r"\s*```$", ""))
    x = raw.withColumn("turn", F.from_json(bare, TURN))
    options = F.transform("turn.options", lambda o: F.struct(F.trim(o["id"]).alias("id"), F.trim(o["label"]).alias("label"), F.coalesce(o["value"], o["label"]).alias("value")))
    keys, ids = F.transform("turn.facts", lambda f: f["key"]), F.transform("turn.options", lambda o: o["id"])
    sources = F.coalesce("turn.source_ids", F.array().cast("array<string>"))
    checks = [
        (F.col("turn.mode").isNull(), "unreadable"), (~F.col("turn.mode").isin("solve", "advance", "clarify", "abstain"), "unknown_mode"),
        ((F.col("turn.mode") != "abstain") & (F.size(sources) == 0), "no_source"), (F.size(F.array_except(sources, "evidence_ids")) > 0, "unknown_source"),
        (F.size(F.array_distinct(keys)) < F.size(keys), "fact_twice"), (F.size(F.array_distinct(ids)) < F.size(ids), "option_twice"),
    ]
    bad = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for c, r in checks]))
    return x.withColumn("options", options).withColumn("violations", bad)


#: A turn as its planner writes it, in JSON.
PLANNED = (
    "mode string, response string, interpretation string, next_action struct<instruction:string,why:string>, "
    "observation_request struct<request_id:string,fact_key:string,question:string,recheck_after_action:boolean,options:array<struct<id:string,label:string,value:string>>>, "
    "decision_basis struct<why_not_solved:string,discriminates_between:array<string>>, facts_learned array<struct<key:string,value:string,label:string>>, source_ids array<string>"
)


def canonical_source(id: Column) -> Column:
    """A cited source's bare id: without white space around it, ``[source:`` or ``source:`` before it and ``]`` after it."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(id), r"^\[source:", ""), "^source:", "")
    return F.trim(F.regexp_replace(bare, r"\]$", ""))


def contract_violations(turns: DataFrame) -> DataFrame:
    """``turns`` with ``violations``: what breaks the contract of a turn, in the order of the rules.

    ``turns``: session, seq, evidence_ids and the fields of PLANNED.  A fact is known to a turn if an earlier
    turn of its session learned it (an as-of join); to ask for it again takes a recheck, and that an action.
    """
    sources = F.transform(F.coalesce("source_ids", F.array().cast("array<string>")), canonical_source)
    keys, ids = F.transform("facts_learned", lambda f: f["key"]), F.transform("observation_request.options", lambda o: o["id"])
    learned = turns.select("session", "seq", F.explode("facts_learned").alias("f")).where("f.key IS NOT NULL").select("session", F.col("f.key").alias("fact_key"), "seq", F.col("f.value").alias("value"))
    x = asof_join(turns.withColumn("fact_key", F.col("observation_request.fact_key")), learned, ["session", "fact_key"], "seq", "_known")
    mode, asks, acts, basis = F.col("mode"), F.col("observation_request").isNotNull(), F.col("next_action").isNotNull(), F.col("decision_basis")
    recheck = F.coalesce("observation_request.recheck_after_action", F.lit(False))
    rules = [
        (mode.isNull(), "unreadable"), (~mode.isin("solve", "advance", "clarify", "abstain"), "unknown_mode"),
        (F.size(sources) == 0, "no_source"), (F.size(F.array_except(sources, "evidence_ids")) > 0, "unknown_source"),
        (F.size(F.array_distinct(keys)) < F.size(keys), "fact_twice"), (F.size(F.array_distinct(ids)) < F.size(ids), "option_twice"),
        (F.col("_known").isNotNull() & ~recheck, "known_fact_asked_again"), (asks & recheck & ~acts, "recheck_without_action"),
        ((mode == "advance") & ~acts, "advance_without_action"), ((mode == "advance") & acts & (F.coalesce("next_action.why", F.lit("")) == ""), "advance_without_reason"),
        ((mode == "advance") & (F.coalesce(F.size("decision_basis.discriminates_between"), F.lit(0)) < 2), "advance_without_discrimination"),
        ((mode == "clarify") & ~asks, "clarify_without_question"), ((mode == "clarify") & acts, "clarify_with_action"), ((mode == "clarify") & basis.isNull(), "clarify_without_basis"),
        ((mode == "solve") & (asks | acts), "solve_goes_on"), ((mode == "solve") & basis.isNotNull(), "solve_with_basis"),
        ((mode == "abstain") & (asks | acts), "abstain_goes_on"), ((mode == "abstain") & basis.isNotNull(), "abstain_with_basis"),
    ]
    return x.withColumn("violations", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for c, r in rules]))).drop("_known", "fact_key")


def planned_turns(raw: DataFrame) -> DataFrame:
    """``raw`` (json and more) with the fields of PLANNED, read from the JSON without the code fences around it."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim("json"), r"^```(?:json)?\s*", ""), r"\s*```$", ""))
    return raw.withColumn("_turn", F.from_json(bare, PLANNED)).select(*raw.columns, "_turn.*")


def stable_id(prefix: str, *parts: Column) -> Column:
    """An id from the SHA-256 of the parts."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16))


def resolved_option(options: Column, chosen: Column) -> Column:
    """The value (else the label) of the chosen option; null if there is none."""
    hit = F.try_element_at(F.filter(options, lambda o: o["id"] == chosen), F.lit(1))
    return F.coalesce(hit["value"], hit["label"])
