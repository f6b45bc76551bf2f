"""Decisions on a stream of requests: who is let through, each request decided once.

State is kept per time bucket and part; rows go to parts by a hash of the request, so neither a hot bucket nor a hot
client is one group. A part holds, per client, the earliest requests that may still be let through. One that has
enough earlier ones of its client in its own part can never be, so it is refused at once; what remains is decided when the
watermark has passed the bucket's end, and its state goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cohortry.operators.requests import bucket_start, first_of_each
from cohortry.operators.windows import interval_micros
from cohortry.sources.tables import TableSet, settle

PARTS = 16
# values that a part's clients are held in
CHUNKS = 32
# rows of a group that meet the state at a time
GATHERED = 1 << 17
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "bucket timestamp, ts timestamp, request long, client string, is_open boolean"
_COLUMNS = ["bucket", "ts", "request", "client", "is_open"]
_STATE = ["at", "request", "client_key", "chunk"]


class _Earliest(StatefulProcessor):
    """Per client the first ``per_client`` requests of one bucket's part.

    Clients are held by chunk, each chunk one Arrow value: a state call per chunk and batch, not per client.
    """

    def __init__(self, per_client: int, length_ms: int) -> None:
        self.per_client, self.length_ms = per_client, length_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clients = handle.getMapState("clients", T.StructType([T.StructField("chunk", T.IntegerType())]), T.StructType([T.StructField("held", T.BinaryType())]))

    def _rows(self, bucket, found: pd.DataFrame, is_open: bool) -> Iterator[pd.DataFrame]:
        if found.empty:
            return
        client = found["client_key"].str.slice(1).where(found["client_key"] != "", None)
        yield pd.DataFrame({"bucket": bucket, "ts": pd.to_datetime(found["at"], unit="us"), "request": found["request"], "client": client, "is_open": is_open}, columns=_COLUMNS)

    def _merge(self, new: pd.DataFrame) -> pd.DataFrame:
        """Into the state of the chunks of these rows; returns the requests that have enough earlier ones."""
        held = [new]
        for chunk in new["chunk"].unique().tolist():
            if self.clients.containsKey((chunk,)):
                held.append(_unpacked(self.clients.getValue((chunk,))[0]).assign(chunk=chunk))
        rows = pd.concat(held, ignore_index=True)
        first = place_of_each(rows) < self.per_client
        for chunk, kept in rows[first].groupby("chunk"):
            self.clients.updateValue((int(chunk),), (_packed(kept),))
        return rows[~first]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bucket = pd.Timestamp(key[0])
        end = int(bucket.timestamp() * 1000) + self.length_ms
        late = end <= timerValues.getCurrentWatermarkInMs()
        for frame in _gathered(rows):
            yield from self._rows(bucket, frame if late else self._merge(frame), False)
        if not late and end not in set(self.handle.listTimers()):
            self.handle.registerTimer(end)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [value[0] for _, value in self.clients.iterator()]
        self.clients.clear()
        for packed in held:
            yield from self._rows(pd.Timestamp(key[0]), _unpacked(packed), True)

    def close(self) -> None:
        pass


def place_of_each(rows: pd.DataFrame) -> np.ndarray:
    """The place of each row among those of its client by time and request, from 0."""
    client = pd.factorize(rows["client_key"])[0]
    order = np.lexsort((rows["request"].to_numpy(), rows["at"].to_numpy(), client))
    sorted_client = client[order]
    number = np.arange(len(rows))
    fresh = np.append(True, sorted_client[1:] != sorted_client[:-1])[: len(rows)]
    place = np.empty(len(rows), np.int64)
    place[order] = number - np.maximum.accumulate(np.where(fresh, number, 0))
    return place


def _gathered(frames: Iterator[pd.DataFrame], rows: int = GATHERED) -> Iterator[pd.DataFrame]:
    """The frames of a group, joined to about ``rows`` rows each."""
    held, n = [], 0
    for frame in frames:
        held.append(frame[_STATE])
        n += len(frame)
        if n >= rows:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def _packed(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows[_STATE].drop(columns="chunk"), preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(held: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(held)).read_all().to_pandas()


def run_decisions(
    requests: DataFrame, tables: TableSet, name: str, ts: str, request: str, client: str, bucket: str, per_client: int,
    global_cap: int, lateness: str = "1 hour", parts: int = PARTS,
) -> None:
    """Decide what has arrived since the last run, into table ``name``; state lives in its checkpoint.

    Buckets are aligned to the epoch. A request more than ``lateness`` behind the newest is refused if its bucket has
    been decided. Requests without a time or id get no row. Each batch overwrites its own part of the table,
    so a repeated batch counts once. Buckets that the watermark has not passed stay open until a later run.
    """
    spark = requests.sparkSession
    length_ms = interval_micros(requests, bucket) // 1000
    # the watermark needs an instant; a time without zone is taken as UTC
    stamped = requests.filter(F.col(ts).isNotNull() & F.col(request).isNotNull())
    at = F.expr(f"timestampdiff(MICROSECOND, {'timestamp_ntz' if isinstance(requests.schema[ts].dataType, T.TimestampNTZType) else 'timestamp_ltz'}'1970-01-01 00:00:00', `{ts}`)")
    client_key = F.when(F.col(client).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(client).cast("string")))
    rows = stamped.select(
        bucket_start(requests, ts, bucket).cast("timestamp").alias("bucket"), F.pmod(F.xxhash64(request), F.lit(parts)).cast("int").alias("part"),
        F.timestamp_micros(at).alias("event_time"), at.alias("at"), F.col(request).cast("long").alias("request"), client_key.alias("client_key"),
        F.pmod(F.xxhash64(client_key), F.lit(CHUNKS)).cast("int").alias("chunk"),
    ).withWatermark("event_time", lateness).drop("event_time")
    # without its column the watermark still moves, but late requests are not left out: they are refused
    decided = rows.groupBy("bucket", "part").transformWithStateInPandas(_Earliest(per_client, length_ms), _OUT, "Append", "EventTime")

    def write(batch: DataFrame, number: int) -> None:
        batch = settle(batch)  # the state is worked on once
        # all parts of a bucket close in one batch, so their requests meet here
        remaining = batch.filter("is_open").select("bucket", "ts", "request", "client")
        within = first_of_each(remaining, ["bucket", "client"], ["ts", "request"], per_client)
        passed = first_of_each(within, ["bucket"], ["ts", "request"], global_cap).select("request", F.lit(True).alias("admitted"))
        rows = batch.join(passed, "request", "left")
        admitted = F.coalesce("admitted", F.lit(False)).alias("admitted")
        decisions = rows.select("bucket", "ts", "request", "client", admitted, F.col("is_open").alias("closes"))
        decisions.write.mode("overwrite").parquet(tables.path(f"{name}/batch={number}"))

    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        query = (
            decided.writeStream.foreachBatch(write).outputMode("append")
            .option("checkpointLocation", tables.path(f"{name}_checkpoint")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)


def read_decisions(spark: SparkSession, tables: TableSet, name: str, closed_only: bool = False) -> DataFrame:
    """bucket, ts, request, client, admitted of all requests decided so far, or of those buckets alone that are closed."""
    schema = "bucket timestamp, ts timestamp, request long, client string, admitted boolean, closes boolean, batch long"
    rows = spark.read.schema(schema).parquet(tables.path(name))
    if closed_only:
        rows = rows.join(rows.filter("closes").select("bucket").distinct(), "bucket", "left_semi")
    return rows.select("bucket", "ts", "request", "client", "admitted")
