import datetime as dt
import random

import pandas as pd
import pytest

from cohortry.operators.requests import admission
from cohortry.sources.tables import TableSet
from cohortry.streaming import decisions

START = dt.datetime(2024, 1, 1)
LIMITS = {"bucket": "1 hour", "per_client": 2, "global_cap": 5}


def batch_decisions(spark, rows):
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz, client string")
    return {r["id"]: (r.bucket, r.admitted) for r in admission(df, "ts", "id", "client", **LIMITS).collect()}


@pytest.fixture()
def stream(spark, tmp_path):
    """Feeds rows, one file and one run of the stream at a time, and reads all decisions so far."""
    tables, source = TableSet(spark, f"{tmp_path}/tables"), f"{tmp_path}/in"
    schema = "id long, ts timestamp_ntz, client string"

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        requests = spark.readStream.schema(schema).parquet(source)
        decisions.run_decisions(requests, tables, "d", "ts", "id", "client", lateness="30 minutes", parts=3, **LIMITS)
        found = decisions.read_decisions(spark, tables, "d").collect()
        assert len({r.request for r in found}) == len(found)  # each once
        return {r.request: (r.bucket, r.admitted) for r in found}

    return feed


def test_decisions_equal_the_batch_over_restarts(spark, stream):
    rng = random.Random(2)
    rows = [(k, START + dt.timedelta(seconds=rng.randrange(6 * 3600)), rng.choice([None, "", "a", "b", "c", "d"])) for k in range(400)]
    rows.sort(key=lambda r: r[1] + dt.timedelta(seconds=rng.randrange(1700)))  # late, but within the watermark
    rows += [(900, None, "a"), (None, START, "a")]
    for part in (rows[:150], rows[150:300], rows[300:]):
        got = stream(part)
    want = {k: v for k, v in batch_decisions(spark, rows[:400]).items()}
    closing = max(r[1] for r in rows[:400]) - dt.timedelta(minutes=30)
    closed = {k: v for k, v in want.items() if v[0] + dt.timedelta(hours=1) <= closing}
    assert len(closed) > 250 and {k: v for k, v in got.items() if k in closed} == closed
    assert {k for k, v in got.items() if v[0] in {b for b, _ in closed.values()}} == set(closed)
    assert not any(admitted for k, (_, admitted) in got.items() if k not in closed)  # only sure refusals of open buckets
    done = stream([(1000, START + dt.timedelta(days=1), "z")])
    assert {k: v for k, v in done.items() if k < 900} == want


def test_late_requests_are_refused_and_state_goes(spark, stream, tmp_path):
    stream([(1, START, "a"), (2, START + dt.timedelta(hours=5), "a")])
    got = stream([(3, START + dt.timedelta(minutes=1), "b")])
    assert got == {1: (START, True), 3: (START, False)}
    state = spark.read.format("statestore").option("stateVarName", "clients").load(f"{tmp_path}/tables/d_checkpoint")
    assert state.count() == 1  # the open bucket alone


class _State:
    """A map state that counts its calls."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def _call(self):
        self.calls += 1

    def containsKey(self, key):
        self._call()
        return key in self.held

    def getValue(self, key):
        self._call()
        return self.held[key]

    def updateValue(self, key, value):
        self._call()
        self.held[key] = value


def test_state_calls_grow_with_chunks_not_with_clients():
    rng = random.Random(5)
    rows = [(rng.randrange(10**6), k, f"={rng.randrange(3000)}") for k in range(9000)]
    earliest = decisions._Earliest(2, 1000)
    earliest.clients = _State()
    refused = []
    for begin in (0, 3000, 6000):
        frame = pd.DataFrame(rows[begin : begin + 3000], columns=["at", "request", "client_key"])
        refused += earliest._merge(frame.assign(chunk=frame["client_key"].str.slice(1).astype(int) % 7))["request"].tolist()
    assert earliest.clients.calls <= 3 * 3 * 7
    by_client = {}
    for at, request, client in sorted(rows):
        by_client.setdefault(client, []).append(request)
    assert sorted(refused) == sorted(r for requests in by_client.values() for r in requests[2:])
    held = pd.concat([decisions._unpacked(value[0]) for value in earliest.clients.held.values()])
    assert sorted(held["request"]) == sorted(r for requests in by_client.values() for r in requests[:2])
