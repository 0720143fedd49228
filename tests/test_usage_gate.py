"""The stream gate against a walk in plain Python, with its calls to the state counted."""

from __future__ import annotations

import random
from collections import Counter
from types import SimpleNamespace

from pyspark.sql import Row

from folioscope.streaming.usage import Gate

KEY = ("1.1.1.1", "2026-01-02")
START = 1_767_283_200_000_000  # 2026-01-01 16:00 UTC, midnight at +8 hours
DAY = 86_400_000


class Handle:
    """One key's states and timers; every call to them is a message to the JVM in a job."""

    def __init__(self):
        self.calls, self.timers = Counter(), set()

    def state(self, **calls):
        def counted(name, f):
            def call(*args):
                self.calls[name] += 1
                return f(*args)

            return call

        return SimpleNamespace(**{name: counted(name, f) for name, f in calls.items()})

    def getValueState(self, name, schema):
        held = []
        return self.state(get=lambda: held[0] if held else None, exists=lambda: bool(held), update=lambda v: held.__setitem__(slice(None), [v]), clear=held.clear)

    def getMapState(self, name, key, value):
        self.held = held = {}
        return self.state(getValue=held.get, containsKey=held.__contains__, updateValue=held.__setitem__, keys=lambda: list(held), removeKey=held.pop)

    def registerTimer(self, at):
        self.calls["registerTimer"] += 1
        self.timers.add(at)


def test_gate_equals_a_walk_with_few_calls():
    dice = random.Random(5)
    entries = [(START + dice.randrange(3_600_000_000), i, dice.choice(["reserve", "reserve", "release"])) for i in range(600)]
    handle = Handle()
    gate = Gate(3)
    gate.init(handle)
    got = []

    def fire(now):
        for timer in sorted(t for t in handle.timers if t < now):
            got.extend(gate.handleExpiredTimer(KEY, SimpleNamespace(getCurrentWatermarkInMs=lambda: now), SimpleNamespace(getExpiryTimeInMs=lambda t=timer: t)))
            handle.timers.remove(timer)

    late = sorted(entries, key=lambda e: e[0] + dice.randrange(600_000_000))  # up to ten minutes out of order
    for at in range(0, len(late), 200):
        part = late[at : at + 200]
        assert list(gate.handleInputRows(KEY, iter([Row(at=t, request_id=i, action=a) for t, i, a in part]), None)) == []
        fire(min((t for t, _, _ in late[at + 200 :]), default=START + DAY * 1000) // 1000 - 1)
    fire(START // 1000 + DAY - 60_000)
    assert handle.timers == {START // 1000 + DAY + 1}  # nothing waits but for the day's end
    calls = sum(handle.calls.values())
    fire(START // 1000 + DAY + 2)
    assert not handle.timers and not handle.held
    used, want = 0, []
    for _, i, action in sorted(entries):
        free = used < 3
        used = used + int(free) if action == "reserve" else max(0, used - 1)
        want.append((i, action, *KEY, free if action == "reserve" else None, used))
    assert [tuple(r) for r in got] == want
    assert calls < 400  # some four for a minute with entries, and not a timer and a look at all minutes for each
