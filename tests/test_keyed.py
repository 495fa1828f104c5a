"""Keyed state: what is kept, what is removed, timers and times to live, and streams that are started again."""

import datetime as dt
import random
import time
from collections import deque

import pandas as pd
from pyspark.sql import functions as F

from loomspark.streaming import keyed


class Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v


class Map:
    def __init__(self):
        self.d, self.read, self.written = {}, 0, 0

    def exists(self):
        return bool(self.d)

    def containsKey(self, k):  # noqa: N802
        return k in self.d

    def getValue(self, k):  # noqa: N802
        self.read += 1
        return self.d[k]

    def updateValue(self, k, v):  # noqa: N802
        self.written += 1
        self.d[k] = v

    def removeKey(self, k):  # noqa: N802
        del self.d[k]

    def keys(self):
        return list(self.d)

    def iterator(self):
        return list(self.d.items())


class Handle:
    """A state store of one key, without time."""

    def __init__(self):
        self.ttl, self.timers = {}, set()

    def getValueState(self, name, schema, ttlDurationMs=None):  # noqa: N802, N803
        self.ttl[name] = ttlDurationMs
        return Value()

    def getMapState(self, name, key, value, ttlDurationMs=None):  # noqa: N802, N803
        self.ttl[name] = ttlDurationMs
        return Map()

    def registerTimer(self, t):  # noqa: N802
        self.timers.add(t)

    def deleteTimer(self, t):  # noqa: N802
        self.timers.discard(t)

    def listTimers(self):  # noqa: N802
        return iter(self.timers)


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.now


def fed(processor, key, frame, now=0):
    return pd.concat(list(processor.handleInputRows((key,), iter([frame]), Clock(now))))


def test_sliding_log_counts_and_does_not_grow():
    rng = random.Random(1)
    p = keyed.SlidingLog(4, 10, 60)
    p.init(h := Handle())
    log, t, n = deque(), 0, 0
    for _ in range(60):
        times = []
        for _ in range(rng.randrange(1, 9)):
            t += rng.randrange(0, 4_000_000)
            times.append(t - rng.randrange(3) * 500_000)  # some come late
        frame = pd.DataFrame({"t": times, "event_id": range(n, n + len(times))}).sort_values(["t", "event_id"])
        n += len(times)
        want = []
        for x in frame["t"]:
            now = max(x, log[-1]) if log else x
            while log and log[0] <= now - 10_000_000:
                log.popleft()
            want.append(len(log))
            log.append(now)
        assert fed(p, 7, frame)["used"].tolist() == want
        assert len(p.slots.d) <= 2 and p.last.v == (log[-1],)
    assert h.ttl == {"slots": 60_000, "last": 60_000}
    before = p.slots.written
    fed(p, 7, pd.DataFrame({"t": [t + 1], "event_id": [n]}))
    assert p.slots.written == before + 1  # one slot, however long the log


def test_turns_go_with_the_last():
    p = keyed.LastTurns(3, 100)
    p.init(h := Handle())
    turn = lambda *ns: pd.DataFrame({"turn": ns, "role": ["user"] * len(ns), "text": [f"t{n}" for n in ns]})
    assert fed(p, 1, turn(2, 1))["turns"][0] == "user: t1\nuser: t2"
    assert fed(p, 1, turn(5, 3, 4))["turns"][0] == "user: t3\nuser: t4\nuser: t5" and sorted(p.turns.d) == [(3,), (4,), (5,)]
    assert h.ttl == {"turns": 100_000}
    p.turns.d.clear()  # as the time to live does
    assert fed(p, 1, turn(9))["turns"][0] == "user: t9"


def test_leases_and_deliveries():
    p = keyed.Lease(60)
    p.init(h := Handle())
    claims = lambda *xs: pd.DataFrame([(i, a, t * 1_000_000) for i, a, t in xs], columns=["claim_id", "agent_id", "t"])
    assert fed(p, 1, claims((1, "a", 0), (2, "b", 30), (3, "a", 50), (4, "b", 100), (5, "b", 110)))["granted"].tolist() == [True, False, True, False, True]
    assert h.ttl == {"lease": 600_000}

    d = keyed.Delivery(60)
    d.init(h := Handle())
    rows = lambda *xs: pd.DataFrame(xs, columns=["kind", "body"])
    assert fed(d, 1, rows(("added", "{}"), ("added", "{}")), 1000)["action"].tolist() == ["deliver"] and h.timers == {61_000}
    assert [r["action"].tolist() for r in d.handleExpiredTimer((1,), Clock(61_000), None)] == [["redeliver"]] and 121_000 in h.timers
    assert fed(d, 1, rows(("acked", None)), 70_000)["action"].tolist() == ["done"] and not h.timers
    assert list(d.handleExpiredTimer((1,), Clock(121_000), None)) == []
    assert fed(d, 1, rows(("added", "{}")))["action"].tolist() == []
    d2 = keyed.Delivery(60)
    d2.init(Handle())
    assert fed(d2, 2, rows(("acked", None), ("added", "{}")))["action"].tolist() == ["deliver", "done"] and not d2.handle.timers


def _run(spark, out, folder, name):
    with keyed.keyed_state(spark):
        query = out.writeStream.outputMode("append").foreachBatch(lambda rows, epoch: rows.write.mode("append").parquet(f"{folder}/{name}")).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    assert query.awaitTermination(120)


def test_state_lives_over_restarts_and_runs_out(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    schema = "event_id long, ts timestamp, user_id long"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    at = dt.datetime(2024, 1, 1)
    put([(i, at + dt.timedelta(seconds=i), i % 2) for i in range(6)])
    stream = lambda: keyed.limited(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 5, 60, idle=15)
    _run(spark, stream(), tmp_path, "out")
    put([(10, at + dt.timedelta(seconds=10), 0)])
    _run(spark, stream(), tmp_path, "out")
    used = lambda: {r.event_id: r.used for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert used() == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 5: 2, 10: 3}
    time.sleep(16)  # longer than a user is remembered
    put([(11, at + dt.timedelta(seconds=11), 0)])
    _run(spark, stream(), tmp_path, "out")
    assert used()[11] == 0
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    assert spark.read.parquet(f"{tmp_path}/out").where(F.col("used") > 3).count() == 0
