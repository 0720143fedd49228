"""Prefix scans over time blocks and the reservation walk, against folds in plain Python."""

from __future__ import annotations

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioscope.operators import usage as U
from folioscope.operators.prefix import running_total

START = datetime(2026, 1, 1, 15, 0, tzinfo=UTC)
ROWS = "request_id long, ts timestamp, client_ip string, succeeded boolean, action string, change int"


def requests(seed: int, n: int = 400):
    dice = random.Random(seed)
    at = [START + timedelta(seconds=dice.choice([0, 60, 899, 900, 901, dice.randrange(7200)])) for _ in range(n)]
    return [(i, at[i], dice.choice(["1.1.1.1"] * 5 + ["2.2.2.2"]), dice.random() < 0.6, dice.choice(["reserve", "reserve", "release"]), dice.choice([1, 1, -1, -2, None])) for i in range(n)]


@pytest.mark.parametrize("block", [1, 900, 10**6])
def test_scans_equal_a_fold(spark, block):
    rows = requests(block % 7)
    table = spark.createDataFrame(rows, ROWS)
    got = {r["request_id"]: (r["total"], r["least"]) for r in running_total(table, ["client_ip"], "ts", "request_id", F.col("change"), block, "total", "least").collect()}
    want, sums, lows = {}, {}, {}
    for i, _, ip, _, _, change in sorted(rows, key=lambda r: (r[1], r[0])):
        sums[ip] = sums.get(ip, 0) + (change or 0)
        lows[ip] = min(lows.get(ip, sums[ip]), sums[ip])
        want[i] = (sums[ip], lows[ip])
    assert got == want
    quota = {r["request_id"]: (r["granted"], r["used"]) for r in U.daily_quota(table, 3, block).collect()}
    won = {}
    for i, ts, ip, ok, _, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        key = (ip, (ts + timedelta(hours=8)).date())
        before = won.get(key, 0)
        assert quota[i] == (before < 3, min(3, before + int(ok and before < 3)))
        won[key] = before + int(ok)


@pytest.mark.parametrize("block", [1, 900, 10**6])
def test_reservations_equal_a_walk(spark, block):
    rows = requests(11)
    got = {(r["request_id"], r["action"]): (r["granted"], r["used"]) for r in U.reservations(spark.createDataFrame(rows, ROWS), 4, block).collect()}
    used, want = {}, {}
    for i, ts, ip, _, action, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        key = (ip, (ts + timedelta(hours=8)).date())
        n = used.get(key, 0)
        used[key] = min(4, n + 1) if action == "reserve" else max(0, n - 1)
        want[i, action] = (n < 4 if action == "reserve" else None, used[key])
    assert got == want


def test_no_block_holds_a_whole_hot_key(spark):
    """The window of a scan is dealt by key and block, so a key of many blocks is many tasks."""
    table = spark.createDataFrame(requests(3), ROWS)
    plan = running_total(table, ["client_ip"], "ts", "request_id", F.lit(1), 900, "n")._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "hashpartitioning(" in line]
    assert any("client_ip" in line and "__block" in line for line in dealt)


def test_scans_of_nothing_and_of_nulls(spark):
    assert U.daily_quota(spark.createDataFrame([], ROWS), 2).collect() == []
    odd = spark.createDataFrame([(1, None, None, None, None, None), (2, START, None, True, "reserve", 1), (2, START, None, True, "reserve", 1)], ROWS)
    assert sorted(r["total"] for r in running_total(odd, ["client_ip"], "ts", "request_id", F.col("change"), 60, "total").collect()) == [0, 1, 2]


def test_networks_of_made_up_addresses_with_wide_groups(spark):
    table = spark.createDataFrame([("2001:db8:15f90::3",), ("2001:db8:ffff::3",)], "ip string")
    network = lambda *digits: [r[0] for r in table.select(U.client_network(F.col("ip"), *digits)).collect()]
    assert network() == ["2001:db8:15f90::3", "2001:db8:ffff:0::/64"]  # no address of the network has such a group
    assert network(16) == ["2001:db8:15f90:0::/64", "2001:db8:ffff:0::/64"]


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """A folder of events with user numbers round and above 65535 (the largest of four hex digits), some at equal times."""
    folder = str(tmp_path_factory.mktemp("wide"))
    dice = random.Random(5)
    kinds = ["view", "error", "click"]
    rows = [(i, START.replace(tzinfo=None) + timedelta(minutes=dice.randrange(2000)), dice.choice([65532, 65535, 65536, 65538, 66000, 89997, 89999, 3]), dice.choice(kinds)) for i in range(600)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ["counter_ledger", "daily_quota", "hashed_key", "hourly_limit", "reservations"])
def test_queries_equal_their_sql_with_wide_user_numbers(spark, wide, name):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{wide}/events.parquet/*.parquet')")
    rows = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in rows.description]
    got = entry.queries()[name](spark, wide)
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, rows.fetchall()))
