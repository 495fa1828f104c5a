"""Keyed state of streams: a sliding log of requests, leases, the last turns of sessions, deliveries to acknowledge.

State lies in the state store by key and by part (a slot of time, a turn), so a batch reads and writes only the parts it
touches, however much a key has. What is not written for a time to live goes by itself; deliveries have timers.
transformWithState needs the RocksDB state store, which keyed_state() asks for while a stream is started.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession, empty_batches: bool = False) -> Iterator[None]:
    """Streams started within have the state store that keyed state needs; the session's own settings come back after.

    Without empty batches a stream that runs until its source is used up ends; timers and times to live are then looked at
    when data comes.
    """
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": str(empty_batches).lower()}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class _Keyed(StatefulProcessor):
    def close(self) -> None:
        pass


class SlidingLog(_Keyed):
    """Requests of a key in slots as wide as the window: a window touches two, and older ones are removed."""

    def __init__(self, limit: int, seconds: int, idle: int) -> None:
        self.limit, self.width, self.idle = limit, seconds * 1_000_000, idle * 1000

    def init(self, handle) -> None:  # noqa: ANN001
        self.slots = handle.getMapState("slots", "slot long", "times array<long>", ttlDurationMs=self.idle)
        self.last = handle.getValueState("last", "t long", ttlDurationMs=self.idle)

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803
        rows = pd.concat(list(rows)).sort_values(["t", "event_id"], kind="stable")
        last = self.last.get()[0] if self.last.exists() else None
        held: dict[int, list[int]] = {}

        def slot(n: int) -> list[int]:
            if n not in held:
                held[n] = list(self.slots.getValue((n,))[0]) if self.slots.exists() and self.slots.containsKey((n,)) else []
            return held[n]

        used, touched = [], set()
        for t in rows["t"].tolist():
            now = t if last is None else max(t, last)
            last, at = now, now // self.width
            before = slot(at - 1)
            used.append(len(before) - bisect_right(before, now - self.width) + len(slot(at)))
            slot(at).append(now)
            touched.add(at)
        newest = last // self.width
        for n in sorted(touched):
            if n >= newest - 1:
                self.slots.updateValue((n,), (held[n],))
        for (n,) in list(self.slots.keys()):
            if n < newest - 1:
                self.slots.removeKey((n,))
        self.last.update((last,))
        yield pd.DataFrame({"event_id": rows["event_id"], "user_id": key[0], "used": used, "allowed": [u < self.limit for u in used]})


def limited(events: DataFrame, limit: int = 60, seconds: int = 60, idle: int = 3600) -> DataFrame:
    """event_id, user_id, used, allowed: a sliding log per user; denied requests are logged too.

    A user not heard of for `idle` seconds is forgotten. Within a batch events count in order of time; an event older
    than the last one seen counts at that one's time.
    """
    timed = events.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return timed.groupBy("user_id").transformWithStateInPandas(SlidingLog(limit, seconds, idle), "event_id long, user_id long, used long, allowed boolean", "append", "processingTime")


class Lease(_Keyed):
    """Who holds a node, and until when; forgotten once the lease is long over."""

    def __init__(self, seconds: int) -> None:
        self.seconds = seconds

    def init(self, handle) -> None:  # noqa: ANN001
        self.lease = handle.getValueState("lease", "holder string, until long", ttlDurationMs=10 * self.seconds * 1000)

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803
        rows = pd.concat(list(rows)).sort_values(["t", "claim_id"], kind="stable")
        holder, until = self.lease.get() if self.lease.exists() else (None, 0)
        granted = []
        for agent, t in zip(rows["agent_id"], rows["t"].tolist(), strict=True):
            free = holder is None or until <= t or holder == agent
            granted.append(free)
            if free:
                holder, until = agent, t + self.seconds * 1_000_000
        if any(granted):
            self.lease.update((holder, until))
        yield pd.DataFrame({"claim_id": rows["claim_id"], "node_id": key[0], "agent_id": rows["agent_id"], "granted": granted})


def leases(claims: DataFrame, seconds: int = 60) -> DataFrame:
    """claim_id, node_id, agent_id, granted: an exclusive lease of a node for so many seconds of event time; its holder may renew it.

    claims (claim_id, node_id, agent_id, ts).
    """
    timed = claims.select("claim_id", "node_id", "agent_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return timed.groupBy("node_id").transformWithStateInPandas(Lease(seconds), "claim_id long, node_id long, agent_id string, granted boolean", "append", "processingTime")


class LastTurns(_Keyed):
    """The last turns of a session by their number; all go a time to live after the last one came."""

    def __init__(self, most: int, ttl: int) -> None:
        self.most, self.ttl = most, ttl * 1000

    def init(self, handle) -> None:  # noqa: ANN001
        self.turns = handle.getMapState("turns", "turn long", "text string", ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803
        had = {n: text for (n,), (text,) in self.turns.iterator()} if self.turns.exists() else {}
        rows = pd.concat(list(rows)).sort_values("turn", kind="stable")
        now = dict(sorted((had | dict(zip(rows["turn"].tolist(), (rows["role"] + ": " + rows["text"]).tolist(), strict=True))).items())[-self.most :])
        for n in had:
            if n not in now:
                self.turns.removeKey((n,))
        for n, text in now.items():  # written again, so that all live as long as the last
            self.turns.updateValue((n,), (text,))
        yield pd.DataFrame({"session_id": [key[0]], "turns": ["\n".join(now.values())]})


def sessions_memory(turns: DataFrame, most: int = 6, ttl: int = 3600) -> DataFrame:
    """session_id, turns: the last turns of each session after a batch, kept for so many seconds after the last one.

    turns (session_id, turn, role, text). A session that has run out begins anew.
    """
    return turns.groupBy("session_id").transformWithStateInPandas(LastTurns(most, ttl), "session_id long, turns string", "update", "processingTime")


class Delivery(_Keyed):
    """An entry's status, and a timer while it waits for its acknowledgement."""

    def __init__(self, idle: int) -> None:
        self.idle = idle * 1000

    def init(self, handle) -> None:  # noqa: ANN001
        self.handle = handle
        self.status = handle.getValueState("status", "status string")

    def _wait(self, timer_values) -> None:  # noqa: ANN001
        self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.idle)

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803
        status, out = (self.status.get()[0] if self.status.exists() else None), []
        rows = pd.concat(list(rows)).sort_values("kind", ascending=False, kind="stable", key=lambda k: k == "added")  # both may come in one batch
        before = status
        for kind, body in zip(rows["kind"], rows["body"], strict=True):
            if kind == "acked" and status == "pending":
                status, _ = "done", out.append("done")
            elif kind == "added" and status is None:
                good = isinstance(body, str) and body.lstrip().startswith("{")
                status = "pending" if good else "done"
                out.append("deliver" if good else "dropped")
        if status != before:
            self.status.update((status,))
            if status == "pending":
                self._wait(timerValues)
            else:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
        yield pd.DataFrame({"entry_id": [key[0]] * len(out), "action": out})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: ANN001, ANN201, N802, N803
        if self.status.exists() and self.status.get()[0] == "pending":
            self._wait(timerValues)
            yield pd.DataFrame({"entry_id": [key[0]], "action": ["redeliver"]})


def consumer_log(entries: DataFrame, idle: int = 60) -> DataFrame:
    """entry_id, action: deliver for a new entry, done for its acknowledgement, redeliver when none came for `idle` seconds, dropped if it is malformed.

    entries (entry_id, kind: added or acked, body) are a log; an entry that is delivered twice is delivered once.
    """
    rows = entries.select("entry_id", "kind", "body")
    return rows.groupBy("entry_id").transformWithStateInPandas(Delivery(idle), "entry_id long, action string", "append", "processingTime")
