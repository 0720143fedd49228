"""Structured Streaming counters: hour and day windows with a watermark, and a stateful gate."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import UTC, datetime, timedelta
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folioscope.operators.usage import client_network, quota_day


def usage_stream_hour(stream: DataFrame, late: str = "1 hour", digits: int = 4) -> DataFrame:
    """Requests per network and clock hour; what comes later than ``late`` is dropped."""
    keyed = stream.withWatermark("ts", late).withColumn("network", client_network(F.col("client_ip"), digits))
    out = keyed.groupBy("network", F.window("ts", "1 hour")).agg(F.count("*").alias("n"))
    return out.select("network", F.col("window.start").alias("hour_start"), "n")


def usage_stream_day(stream: DataFrame, late: str = "1 hour", digits: int = 4) -> DataFrame:
    """Successful requests per network and day at +8 hours (16:00 to 16:00 UTC)."""
    keyed = stream.withWatermark("ts", late).where("succeeded").withColumn("network", client_network(F.col("client_ip"), digits))
    out = keyed.groupBy("network", F.window("ts", "1 day", "1 day", "16 hours")).agg(F.count("*").alias("n"))
    return out.select("network", F.col("window.start").alias("day_start"), "n")


class Gate(StatefulProcessor):
    """Slots of one network's day: entries wait until the watermark has passed their minute, then are judged in order.

    State is the number of slots taken and, by minute, the entries that wait. One timer stands at the
    end of the earliest such minute; it judges all that are due, a minute at a time, and sets the next.
    After the last of them it stands at the day's end, which clears what is left.
    """

    OUT = "request_id long, action string, network string, day string, granted boolean, used int"
    MINUTE = 60_000

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getValueState("used", "n int")
        self.waiting = handle.getMapState("waiting", "minute long", "at array<long>, ids array<long>, actions array<string>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new: dict[int, tuple[list, list, list]] = {}
        for row in rows:
            mine = new.setdefault(row["at"] // 1000 // self.MINUTE, ([], [], []))
            for column, value in zip(mine, (row["at"], row["request_id"], row["action"]), strict=True):
                column.append(value)
        for minute, mine in new.items():
            held = self.waiting.getValue((minute,))
            self.waiting.updateValue((minute,), tuple(list(old) + more for old, more in zip(held, mine, strict=True)) if held else mine)
        if new:
            self.handle.registerTimer((min(new) + 1) * self.MINUTE)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        minutes = sorted(minute for (minute,) in self.waiting.keys())
        due = [minute for minute in minutes if (minute + 1) * self.MINUTE <= now]
        was = self.used.get()
        used = was[0] if was else 0
        for minute in due:
            for _, request_id, action in sorted(zip(*self.waiting.getValue((minute,)), strict=True)):
                free = used < self.limit
                used = used + int(free) if action == "reserve" else max(0, used - 1)
                yield Row(request_id=request_id, action=action, network=key[0], day=key[1], granted=free if action == "reserve" else None, used=used)
            self.waiting.removeKey((minute,))
        reset = day_end(key[1])
        if reset < now:
            if was:
                self.used.clear()
            return
        if due:
            self.used.update((used,))
        self.handle.registerTimer((minutes[len(due)] + 1) * self.MINUTE if len(due) < len(minutes) else reset + 1)

    def close(self) -> None:
        pass


def day_end(day: str) -> int:
    """The next midnight at +8 hours, in milliseconds of UTC."""
    return int((datetime.fromisoformat(day).replace(tzinfo=UTC) + timedelta(hours=16)).timestamp() * 1000)


def to_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def from_bytes(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


ENTRY = ["network", "at", "request_id", "action"]
SHARE = pa.schema([("day", pa.string()), ("bucket", pa.int32()), ("ts", pa.timestamp("us", tz="UTC")), ("rows", pa.binary())])


def shares(table: pa.Table) -> pa.RecordBatch:
    """One row for each day and bucket: its entries as an Arrow stream, and the latest of their times."""
    table = table.sort_by([("day", "ascending"), ("bucket", "ascending")]).combine_chunks()
    days, buckets = table["day"].combine_chunks().dictionary_encode().indices.to_numpy(), table["bucket"].to_numpy()
    edges = [0, *(np.flatnonzero(np.diff(days) | np.diff(buckets)) + 1).tolist(), table.num_rows]
    parts = [table.slice(a, z - a) for a, z in pairwise(edges)]
    columns = ([p["day"][0].as_py() for p in parts], [p["bucket"][0].as_py() for p in parts], [pc.max(p["at"]).as_py() for p in parts], [to_bytes(p.select(ENTRY)) for p in parts])
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if f.name == "ts" else f.type).cast(f.type) for c, f in zip(columns, SHARE, strict=True)], schema=SHARE)


def packed(entries: DataFrame, rows: int = 1 << 18) -> DataFrame:
    """(day, bucket, ts, rows): the entries of a day and bucket, up to ``rows`` of a task at a time, in one row."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield shares(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield shares(pa.Table.from_batches(held))

    return entries.select("day", "bucket", *ENTRY).mapInArrow(pack, "day string, bucket int, ts timestamp, rows binary")


class BucketGate(StatefulProcessor):
    """``Gate`` for many networks: a key is a day and a bucket of its networks, its rows are ``packed``.

    State is, by block of ``block`` seconds, the entries that wait, and the slots that each network has taken.
    So calls to the state and timers grow with the blocks that have entries, and not with entries and networks.
    Entries that the watermark has passed as they come are dropped.
    """

    MINUTE = 60_000

    def __init__(self, limit: int, block: int = 21_600):
        self.limit, self.block = limit, block * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getValueState("used", "networks binary")
        self.waiting = handle.getMapState("waiting", "block long", "rows binary")

    def handleInputRows(self, key, rows: Iterable[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pa.concat_tables([from_bytes(data) for frame in rows for data in frame["rows"]])
        new = new.filter(pc.greater(new["at"], timerValues.getCurrentWatermarkInMs() * 1000)).sort_by("at")
        if new.num_rows:
            at = new["at"].to_numpy() // 1000
            blocks = at // self.block
            for a, z in pairwise([0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]):
                block, mine = int(blocks[a]), new.slice(a, z - a)
                held = self.waiting.getValue((block,))
                self.waiting.updateValue((block,), (to_bytes(pa.concat_tables([from_bytes(held[0]), mine]) if held else mine),))
            self.wake((int(at[0]) // self.MINUTE + 1) * self.MINUTE)
        return iter(())

    def wake(self, at: int) -> None:
        """A timer that goes off once the watermark is ``at``: Spark's go off when it is beyond theirs."""
        self.handle.registerTimer(at - 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, reset = timerValues.getCurrentWatermarkInMs(), day_end(key[0])
        was = self.used.get()
        used = dict(zip(*(c.to_pylist() for c in from_bytes(was[0]).columns), strict=True)) if was else {}
        judged, later = False, None
        for block in sorted(block for (block,) in self.waiting.keys()):
            later = block * self.block + self.MINUTE
            if later > now:
                break
            held = from_bytes(self.waiting.getValue((block,))[0])
            ends = (held["at"].to_numpy() // 1000 // self.MINUTE + 1) * self.MINUTE
            due = ends <= now
            if due.any():
                judged = True
                yield self.judge(key[0], held.filter(pa.array(due)), used)
            if not due.all():
                later = int(ends[~due].min())
                if due.any():
                    self.waiting.updateValue((block,), (to_bytes(held.filter(pa.array(~due))),))
                break
            self.waiting.removeKey((block,))
            later = None
        if later is None and reset < now:
            if was:
                self.used.clear()
            return
        if judged:
            taken = {network: n for network, n in used.items() if n}
            self.used.update((to_bytes(pa.table({"network": pa.array(taken, pa.string()), "used": pa.array(taken.values(), pa.int64())})),))
        self.wake(reset + 1 if later is None else later)

    def judge(self, day: str, entries: pa.Table, used: dict[str, int]) -> pd.DataFrame:
        """The entries in their order, with the slots that ``used`` has for their networks, and has anew."""
        order = pc.sort_indices(entries, sort_keys=[(c, "ascending") for c in ENTRY], null_placement="at_start")
        entries = entries.take(order)
        granted, counts, last, taken = [], [], None, 0
        for network, action in zip(entries["network"].to_pylist(), entries["action"].to_pylist(), strict=True):
            if network != last:
                last, taken = network, used.get(network, 0)
            free = taken < self.limit
            granted.append(free if action == "reserve" else None)
            taken = taken + free if action == "reserve" else max(0, taken - 1)
            counts.append(taken)
            used[network] = taken
        told = entries.select(["request_id", "action", "network"]).append_column("day", pa.array([day] * len(counts), pa.string()))
        told = told.append_column("granted", pa.array(granted, pa.bool_())).append_column("used", pa.array(counts, pa.int32()))
        return told.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype(), pa.bool_(): pd.BooleanDtype()}.get)

    def close(self) -> None:
        pass


def usage_stream_gate(stream: DataFrame, limit: int, late: str = "1 hour", digits: int = 4, buckets: int = 64) -> DataFrame:
    """``reservations`` as a stream of (request_id, ts, client_ip, action): the same rows, whatever order entries come in.

    An entry is judged when the watermark has passed its minute; what comes later than ``late`` is
    dropped. Needs the RocksDB state store. Entries without a time or an address are dropped.
    A day's networks share ``buckets`` keys of the state; with 0 buckets each has its own, which is for few networks.
    """
    told = stream.where("ts IS NOT NULL AND client_ip IS NOT NULL")
    told = told.withColumn("network", client_network(F.col("client_ip"), digits)).withColumn("day", quota_day(F.col("ts"))).withColumn("at", F.unix_micros("ts"))
    if not buckets:
        keyed = told.withWatermark("ts", late).select("network", "day", "request_id", "ts", "at", "action")
        return keyed.groupBy("network", "day").transformWithState(Gate(limit), Gate.OUT, "Append", "EventTime")
    rows = packed(told.withColumn("bucket", F.pmod(F.hash("network"), F.lit(buckets))))
    return rows.withWatermark("ts", late).groupBy("day", "bucket").transformWithStateInPandas(BucketGate(limit), Gate.OUT, "Append", "EventTime")
