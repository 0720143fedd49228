"""The stream gate of many networks: against a walk in plain Python with its calls counted, and end to end."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from datetime import UTC, datetime, timedelta
from types import SimpleNamespace

import pandas as pd
import pyarrow as pa

from folioscope.plans.usage import run
from folioscope.streaming.usage import BucketGate, shares, usage_stream_gate

KEY = ("2026-01-02", 0)
START = 1_767_283_200_000_000  # 2026-01-01 16:00 UTC, midnight at +8 hours
DAY = 86_400_000


class Handle:
    """One key's states and timers; every call to them is a message to the JVM in a job."""

    def __init__(self):
        self.calls, self.timers, self.used, self.held = Counter(), set(), [], {}

    def state(self, **calls):
        def counted(name, f):
            def call(*args):
                self.calls[name] += 1
                return f(*args)

            return call

        return SimpleNamespace(**{name: counted(name, f) for name, f in calls.items()})

    def getValueState(self, name, schema):
        return self.state(get=lambda: self.used[0] if self.used else None, update=lambda v: self.used.__setitem__(slice(None), [v]), clear=self.used.clear)

    def getMapState(self, name, key, value):
        return self.state(getValue=self.held.get, updateValue=self.held.__setitem__, keys=lambda: list(self.held), removeKey=self.held.pop)

    def registerTimer(self, at):
        self.calls["registerTimer"] += 1
        self.timers.add(at)


def walk(entries, limit):
    """Rows of (request_id, action, network, granted, used)."""
    used, rows = defaultdict(int), []
    for network, at, i, action in sorted(entries):
        free = used[network] < limit
        used[network] = used[network] + free if action == "reserve" else max(0, used[network] - 1)
        rows.append((i, action, network, free if action == "reserve" else None, used[network]))
    return sorted(rows)


def through_gate(networks: int):
    """Six hours of entries, ten minutes out of order in three batches; the rows that come, those that should, and the handle."""
    dice = random.Random(7)
    entries = [(f"n{dice.randrange(networks)}", START + dice.randrange(6 * 3_600_000_000), i, dice.choice(["reserve", "reserve", "release"])) for i in range(3000)]
    handle, got = Handle(), []
    gate = BucketGate(2)
    gate.init(handle)

    def fire(now):
        values = SimpleNamespace(getCurrentWatermarkInMs=lambda: now)
        for timer in sorted(t for t in handle.timers if t < now):
            for frame in gate.handleExpiredTimer(KEY, values, None):
                assert set(frame["day"]) == {KEY[0]}
                granted = [None if g is pd.NA else bool(g) for g in frame["granted"]]
                got.extend(zip(frame["request_id"], frame["action"], frame["network"], granted, frame["used"], strict=True))
            handle.timers.remove(timer)
        return values

    late = sorted(entries, key=lambda e: e[1] + dice.randrange(600_000_000))
    now = 0
    for at in range(0, len(late), 1000):
        network, times, ids, actions = zip(*late[at : at + 1000], strict=True)
        table = pa.table({"day": [KEY[0]] * len(ids), "bucket": pa.array([0] * len(ids), pa.int32()), "network": network, "at": times, "request_id": ids, "action": actions})
        packed = shares(table).to_pandas()
        assert len(packed) == 1
        assert list(gate.handleInputRows(KEY, iter([packed]), SimpleNamespace(getCurrentWatermarkInMs=lambda now=now: now))) == []
        now = min((t for _, t, _, _ in late[at + 1000 :]), default=START + 6 * 3_600_000_000 + 60_000_000) // 1000 - 1
        fire(now)
    assert not handle.held and handle.timers == {START // 1000 + DAY}  # nothing waits but for the day's end
    assert bool(handle.used)
    fire(START // 1000 + DAY + 1)
    assert not handle.timers and not handle.used
    return got, walk(entries, 2), handle


def test_calls_to_state_do_not_grow_with_networks():
    calls = []
    for networks in (1, 1000):
        got, want, handle = through_gate(networks)
        assert sorted(got) == want
        calls.append(sum(handle.calls.values()))
    assert max(calls) < 80 and max(calls) < 1.2 * min(calls)  # of 3,000 entries


def test_shares_hold_a_day_and_bucket_each():
    rows = [("d1", 1, "a", 5, 1, "reserve"), ("d2", 1, "a", 9, 2, "release"), ("d1", 0, "b", 7, None, "reserve"), ("d1", 1, "c", 3, 4, None)]
    table = pa.Table.from_pylist([dict(zip(("day", "bucket", "network", "at", "request_id", "action"), r, strict=True)) for r in rows], pa.schema([("day", pa.string()), ("bucket", pa.int32()), ("network", pa.string()), ("at", pa.int64()), ("request_id", pa.int64()), ("action", pa.string())]))
    told = {(r["day"], r["bucket"]): (r["ts"], pa.ipc.open_stream(r["rows"]).read_all().to_pylist()) for r in shares(table).to_pylist()}
    epoch = datetime(1970, 1, 1, tzinfo=UTC)
    assert {k: (t - epoch) / timedelta(microseconds=1) for k, (t, _) in told.items()} == {("d1", 0): 7, ("d1", 1): 5, ("d2", 1): 9}
    assert sorted(r["at"] for r in told["d1", 1][1]) == [3, 5] and told["d1", 0][1] == [{"network": "b", "at": 7, "request_id": None, "action": "reserve"}]


def test_stream_judges_up_to_the_watermark_itself(spark, tmp_path):
    """A minute that ends just at the watermark is judged, late entries and those without an id or action come as they are."""
    base = datetime(2026, 1, 2, 1, 0, tzinfo=UTC)
    entries = [(1, 0, "reserve"), (None, 0, "reserve"), (2, 30, "reserve"), (3, 40, None), (4, 59, "reserve"), (5, 60, "reserve"), (6, 3660, "reserve")]
    schema = "request_id long, ts timestamp, client_ip string, action string"
    was = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        for part in (entries, [(7, 30, "reserve"), (8, 90, "release")]):  # 7 is late: its minute has been judged
            spark.createDataFrame([(i, base + timedelta(seconds=s), "9.9.9.9", a) for i, s, a in part], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            out = usage_stream_gate(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 2)
            run(out, str(tmp_path))
        rows = spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    assert {(r["request_id"], r["granted"], r["used"]) for r in rows} == {(None, True, 1), (1, True, 2), (2, False, 2), (3, None, 1), (4, True, 2)}
    assert {(r["network"], r["day"]) for r in rows} == {("9.9.9.9", "2026-01-02")}
