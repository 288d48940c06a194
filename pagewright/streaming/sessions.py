"""Streams: fact ledgers, repeated queries, and keyed upserts."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import ACKNOWLEDGED, ACKNOWLEDGING
from ..operators.sessions import STATE
from ..runtime import python_ready

PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Hash buckets of query texts, each a row of state; a running stream's checkpoint holds them, so it is fixed.
TEXT_BUCKETS = 1024
HISTORY = "session long, seq long, key string, value string, previous_value string"


def fact_history_stream(events: DataFrame) -> DataFrame:
    """The fact history as a keyed stateful stream; ``events``: session, seq, key, value, deleted.

    State is the last sequence and value of each key of a session.  Events of a micro-batch are taken in
    order of seq; a late one is still recorded but doesn't replace a later value; a deletion clears the
    session.
    """
    python_ready(events.sparkSession)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        out = []
        for r in rows.itertuples(index=False):
            if r.deleted:
                known = {}
                continue
            seq, last = known.get(r.key, (-1, None))
            out.append((key[0], r.seq, r.key, r.value, last if last is not None and last != r.value else None))
            if r.seq >= seq:
                known[r.key] = (int(r.seq), r.value)
        state.update((json.dumps(known),)) if known else state.remove()
        yield pd.DataFrame(out, columns=["session", "seq", "key", "value", "previous_value"])

    return events.groupBy("session").applyInPandasWithState(step, HISTORY, "facts string", "append", GroupStateTimeout.NoTimeout)


def _snapshot(*values) -> Row:
    names = ["session", "seq", "deleted", "acknowledged", "pending", "completed", "ruled_out", "observations", "facts"]
    return Row(**dict(zip(names, values, strict=True)))


class SessionProcessor(StatefulProcessor):
    """A session's state as typed state: the open turn as a value, facts and observations as maps, steps and causes as lists.

    Each micro-batch yields one snapshot of each session that it touches.  Events are taken in order of ``seq``;
    those up to the last one seen are replays and change nothing.  A deletion clears the state and leaves a
    tombstone: a snapshot that says ``deleted``.  With ``idle_ms`` a session without an event for so long (by the
    watermark, over the events' ``at``) is deleted by a timer in the same way.
    """

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ask = "request_id string, fact_key string, recheck boolean, option_ids array<string>, option_values array<string>"
        self.open = handle.getValueState("open", f"seq long, count long, turn_id string, acts boolean, acknowledged boolean, pending string, {ask}")
        self.facts = handle.getMapState("facts", "key string", "place long, value string, after string")
        self.observations = handle.getMapState("observations", "id string", "place long, text string")
        self.completed, self.ruled_out = handle.getListState("completed", "id string"), handle.getListState("ruled_out", "id string")

    def _clear(self) -> None:
        for state in (self.facts, self.observations, self.completed, self.ruled_out):
            state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.open.get() if self.open.exists() else None
        seen, count, turn_id, acts, acknowledged, pending, request_id, fact_key, recheck, option_ids, option_values = held or (-1, 0, None, None, False, None, None, None, None, None, None)
        completed, ruled_out = ([r[0] for r in x.get()] if x.exists() else [] for x in (self.completed, self.ruled_out))
        observations = {k[0]: v for k, v in self.observations.iterator()} if self.observations.exists() else {}
        facts = {k[0]: v for k, v in self.facts.iterator()} if self.facts.exists() else {}
        deleted, latest = False, None
        for r in sorted(rows, key=lambda r: r.seq):
            if r.seq <= seen:
                continue
            seen, deleted = r.seq, r.kind == "delete"
            latest = max(latest or r.at, r.at) if self.idle_ms else None
            if deleted:
                count, turn_id, acts, acknowledged, pending, request_id, fact_key, recheck, option_ids, option_values = 0, None, None, False, None, None, None, None, None, None
                completed, ruled_out, observations, facts = [], [], {}, {}
            elif r.kind == "request":
                chosen = option_ids.index(r.selected_option) if r.selected_option and r.selected_option in (option_ids or []) else None
                said = option_values[chosen] if chosen is not None else r.observation or r.selected_option or r.query
                acknowledged = bool(said) and request_id is not None and not r.selected_option and acknowledges(said)
                pending = None if acknowledged else said or None
                if pending and request_id is not None:
                    if request_id not in completed:
                        completed.append(request_id)
                    observations[request_id] = (observations[request_id][0] if request_id in observations else count, pending)
                    count += 1
            else:
                answers = False
                for f in r.facts or []:
                    answers = answers or (request_id is not None and f["key"] == fact_key)
                    after = f"{turn_id}:action" if recheck and acts and f["key"] == fact_key else None
                    facts[f["key"]] = (facts[f["key"]][0] if f["key"] in facts else count, f["value"], after)
                    observations[f["key"]] = (observations[f["key"]][0] if f["key"] in observations else count, f"{f['label']}: {f['value']}")
                    count += 1
                if answers and request_id not in completed:
                    completed.append(request_id)
                ruled_out += [c for c in dict.fromkeys(r.ruled_out or []) if c not in ruled_out]
                turn_id, acts, acknowledged, pending = r.turn_id, r.acts, False, None
                ask = r.asks
                request_id, fact_key, recheck = (ask["request_id"], ask["fact_key"], ask["recheck"]) if ask else (None, None, None)
                option_ids, option_values = ([o["id"] for o in ask["options"] or []], [o["value"] or o["label"] or "" for o in ask["options"] or []]) if ask else (None, None)
        self._clear()
        self.open.update((seen, count, turn_id, acts, acknowledged, pending, request_id, fact_key, recheck, option_ids, option_values))
        for k, v in facts.items():
            self.facts.updateValue((k,), v)
        for k, v in observations.items():
            self.observations.updateValue((k,), v)
        for state, ids in ((self.completed, completed), (self.ruled_out, ruled_out)):
            if ids:
                state.put([(x,) for x in ids])
        if self.idle_ms and latest is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if not deleted:
                self.handle.registerTimer(int(latest.timestamp() * 1000) + self.idle_ms)
        in_order = lambda d: sorted(d.items(), key=lambda kv: kv[1][0])
        yield _snapshot(key[0], seen, deleted, acknowledged, pending, completed, ruled_out, [{"id": k, "text": v[1]} for k, v in in_order(observations)], [{"key": k, "value": v[1], "after": v[2]} for k, v in in_order(facts)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        seen = self.open.get()[0]
        self._clear()
        self.open.update((seen, 0, None, None, False, None, None, None, None, None, None))
        yield _snapshot(key[0], seen, True, False, None, [], [], [], [])

    def close(self) -> None:
        pass


def acknowledges(text: str) -> bool:
    """The rule of ``functions.text.acknowledgement`` for one text."""
    said = re.sub("[^a-z0-9]+", " ", text.lower()).strip()
    return said in ACKNOWLEDGED or (len(said.split(" ")) <= 12 and any(p in said for p in ACKNOWLEDGING))


def session_states_stream(events: DataFrame, idle_seconds: int | None = None) -> DataFrame:
    """Snapshots (``operators.sessions.STATE``) of a stream of sessions' ``events`` (EVENT), a row for each session and micro-batch.

    With ``idle_seconds`` the events need a time ``at`` with a watermark.
    """
    python_ready(events.sparkSession)
    processor = SessionProcessor(idle_seconds * 1000 if idle_seconds else None)
    return events.groupBy("session").transformWithState(statefulProcessor=processor, outputStructType=STATE, outputMode="Append" if not idle_seconds else "Update", timeMode="EventTime" if idle_seconds else "None")


def first_queries_stream(asked: DataFrame, ttl: int = 900) -> DataFrame:
    """``asked`` with ``canonical``: the queries that no equal one of the last ``ttl`` seconds serves; ``asked``: at (timestamp), text.

    State are the texts of a hash bucket with the times of their last retrievals, each dropped ``ttl`` after it.
    The queries of a micro-batch are taken in order of time; the watermark drops queries that come later than ``ttl``.
    """
    python_ready(asked.sparkSession)
    canonical = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    x = asked.withColumn("canonical", canonical).withWatermark("at", f"{ttl} seconds")
    order = ["_us", *[c for c in ("query_id",) if c in asked.columns]]
    kind = x.schema
    x = x.withColumns({"_us": F.coalesce(F.unix_micros("at"), F.lit(0)), "_bucket": F.pmod(F.xxhash64("canonical"), F.lit(TEXT_BUCKETS)).cast("int")})

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = dict(json.loads(state.get[0])) if state.exists else {}
        if not state.hasTimedOut:
            rows = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable", ignore_index=True)
            kept = []
            for i, (text, at) in enumerate(zip(rows["canonical"].tolist(), rows["_us"].tolist(), strict=True)):
                if text not in known or at >= known[text] + ttl * 1_000_000:
                    known[text] = at
                    kept.append(i)
            yield rows.iloc[kept].reset_index(drop=True)[kind.names]
        now = state.getCurrentWatermarkMs()
        known = {text: at for text, at in known.items() if at // 1000 + ttl * 1000 >= now}
        if known:
            state.update((json.dumps(list(known.items())),))
            state.setTimeoutTimestamp(max(min(known.values()) // 1000 + ttl * 1000, now) + 1)
        else:
            state.remove()

    return x.groupBy("_bucket").applyInPandasWithState(step, kind, "known string", "append", GroupStateTimeout.EventTimeTimeout)


@contextmanager
def column_families(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which typed state (``transformWithState``) needs; the session's setting comes back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def collected(spark: SparkSession, stream: DataFrame, checkpoint: str, path: str, typed: bool = False) -> DataFrame:
    """All that a stream yields from the input that is there now, through a Parquet sink; ``typed``: it has typed state."""
    with column_families(spark) if typed else nullcontext():
        query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def upsert_each_batch(stream: DataFrame, path: str, key: str, seq: str, checkpoint: str):
    """Keep the latest row of each key in a keyed store (``sources.store``): a micro-batch rewrites only the buckets it touches."""
    from ..sources import store

    def merge(batch: DataFrame, epoch: int) -> None:
        store.merge(batch.persist(), epoch, path, key, seq)
        batch.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
