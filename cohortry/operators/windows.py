"""Request windows that begin with a request: a new one starts with the first request after the last has ended.

Each start depends on the one before, over the whole log and all clients. The chain is found by a parallel prefix over
sorted ranges of times. What a range does to the chain is a function: a threshold (the end of the last window) goes in,
the end of the last window begun in the range comes out. It is a step function with a step per time in its first
window, so ranges compose, a few at a time, in a tree; on the way back each range is told the threshold that enters it,
and follows its own windows. Ranges hold equal numbers of distinct times, however dense the log is anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.operators.requests import first_of_each
from cohortry.sources.tables import settle

# distinct times in one range, and ranges composed by one task at a time
RANGE_TIMES = 1 << 20
FAN = 16

_NODE = pa.schema([("node", pa.int64()), ("first", pa.int64()), ("upto", pa.list_(pa.int64())), ("leaves", pa.list_(pa.int64()))])
_NODE_DDL = "node long, first long, upto array<long>, leaves array<long>"


def leaving(times: np.ndarray, length: int) -> np.ndarray:
    """For each of the sorted distinct times, if a window begins there: the end of the last window begun among them."""
    after = np.searchsorted(times, times + length)
    last = np.where(after == len(times), np.arange(len(times)), after)
    while True:  # pointers double, so a few rounds reach the end
        further = last[last]
        if np.array_equal(further, last):
            return times[last] + length
        last = further


def enter(upto: np.ndarray, leaves: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """The thresholds behind a range. One beyond all its steps goes through."""
    at = np.searchsorted(upto, threshold)
    return np.where(at < len(upto), np.append(leaves, 0)[at], threshold)


def steps(upto: np.ndarray, leaves: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The steps that can be entered: thresholds end less than a window behind the first time. Equal neighbours are one."""
    kept = int(np.searchsorted(upto, upto[0] + length)) + 1
    upto, leaves = upto[:kept], leaves[:kept]
    ends = np.append(leaves[1:] != leaves[:-1], True)
    return upto[ends], leaves[ends]


def compose(parts: list[tuple[np.ndarray, np.ndarray]], length: int) -> tuple[np.ndarray, np.ndarray]:
    """The steps of neighbouring ranges as one. A range shorter than a window lets later thresholds through."""
    upto, leaves = parts[0]
    for more, out in parts[1:]:
        leaves = np.append(enter(more, out, leaves), out)
        upto = np.append(upto, more)
    return steps(upto, leaves, length)


def _range_rows(batches: Iterator[pa.RecordBatch], length: int, size: int) -> Iterator[pa.RecordBatch]:
    """Sorted times of a task as ranges of at most ``size``, each with its steps."""
    schema = pa.schema([("piece", pa.int64()), *_NODE, ("times", pa.list_(pa.int64()))])
    held, piece = np.zeros(0, np.int64), 0

    def row(times: np.ndarray) -> pa.RecordBatch:
        upto, leaves = steps(times, leaving(times, length), length)
        found = {"piece": piece, "node": 0, "first": int(times[0]), "upto": upto, "leaves": leaves, "times": times}
        return pa.RecordBatch.from_pylist([found], schema)

    for batch in batches:
        held = np.append(held, batch.column("time").to_numpy())
        while len(held) > size:
            yield row(held[:size])
            held, piece = held[size:], piece + 1
    if len(held):
        yield row(held)


def _composed(table: pa.Table, length: int) -> pa.Table:
    table = table.sort_by("first")
    parts = [(np.array(u), np.array(v)) for u, v in zip(table.column("upto").to_pylist(), table.column("leaves").to_pylist(), strict=True)]
    upto, leaves = compose(parts, length)
    return pa.Table.from_pylist([{"node": table.column("parent")[0].as_py(), "first": table.column("first")[0].as_py(), "upto": upto, "leaves": leaves}], _NODE)


def _told(table: pa.Table) -> pa.Table:
    """The threshold that enters each of some neighbouring ranges, from the one that enters the first."""
    table = table.sort_by("first")
    threshold, out = np.array([table.column("threshold")[0].as_py()]), []
    for upto, leaves in zip(table.column("upto").to_pylist(), table.column("leaves").to_pylist(), strict=True):
        out.append(int(threshold[0]))
        threshold = enter(np.array(upto), np.array(leaves), threshold)
    return pa.table({"node": table.column("node"), "threshold": pa.array(out, pa.int64())})


def _starts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for times, threshold in zip(batch.column("times").to_pylist(), batch.column("threshold").to_pylist(), strict=True):
            times, out = np.array(times), []
            at = int(np.searchsorted(times, threshold))
            while at < len(times):
                out.append(times[at])
                at = int(np.searchsorted(times, times[at] + length))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["start"])


def window_starts(times: DataFrame, length: int, size: int = RANGE_TIMES, fan: int = FAN) -> DataFrame:
    """start of every window, of ``length``, over the column ``time`` (whole numbers; nulls do not count)."""
    ordered = times.select(F.col("time").cast("long").alias("time")).filter("time IS NOT NULL").distinct()
    ordered = ordered.repartitionByRange("time").sortWithinPartitions("time")
    ranges = ordered.mapInArrow(lambda it: _range_rows(it, length, size), f"piece long, {_NODE_DDL}, times array<long>")
    # ranges of a task first, then of neighbouring tasks
    ranges = settle(ranges.withColumn("parent", F.spark_partition_id().cast("long")))
    ranges = ranges.withColumn("node", F.col("parent") * (1 << 32) + F.col("piece")).drop("piece")
    levels = [ranges.drop("times")]
    while True:
        level = settle(levels[-1].groupBy("parent").applyInArrow(lambda t: _composed(t, length), _NODE_DDL))
        if level.count() <= 1:
            break
        levels.append(level.withColumn("parent", F.floor(F.col("node") / fan)))
    # before the first time no window is open
    told = level.select(F.col("node").alias("parent"), F.col("first").alias("threshold"))
    for level in reversed(levels):
        told = level.join(told, "parent").groupBy("parent").applyInArrow(_told, "node long, threshold long").withColumnRenamed("node", "parent")
    entered = ranges.drop("parent").join(told.withColumnRenamed("parent", "node"), "node").select("times", "threshold")
    return entered.mapInArrow(lambda it: _starts(it, length), "start long")


def _micros(df: DataFrame, ts: str) -> Column:
    epoch = "timestamp_ntz'1970-01-01'" if isinstance(df.schema[ts].dataType, T.TimestampNTZType) else "timestamp_seconds(0)"
    return F.expr(f"timestampdiff(MICROSECOND, {epoch}, `{ts}`)")


def interval_micros(df: DataFrame, interval: str) -> int:
    spark = df.sparkSession
    return spark.sql(f"SELECT timestampdiff(MICROSECOND, timestamp_seconds(0), timestamp_seconds(0) + interval {interval})").first()[0]


def with_window(df: DataFrame, ts: str, window: str, size: int = RANGE_TIMES, fan: int = FAN) -> DataFrame:
    """Adds ``window_start``, of the window each request falls into; null without a time.

    Starts are at least a window apart, so a stretch of that length holds at most one: a request finds its own by
    its stretch, as the start in it or else the one in the stretch before.
    """
    length = interval_micros(df, window)
    at = _micros(df, ts)
    starts = window_starts(df.select(at.alias("time")), length, size, fan)
    stretch = F.floor(F.col("start") / length)
    each = starts.select(F.explode(F.array(F.struct(stretch.alias("_stretch"), F.col("start").alias("_own"), F.lit(None).cast("long").alias("_before")),
                                           F.struct((stretch + 1).alias("_stretch"), F.lit(None).cast("long").alias("_own"), F.col("start").alias("_before")))).alias("s"))
    known = each.select("s.*").groupBy("_stretch").agg(F.max("_own").alias("_own"), F.max("_before").alias("_before"))
    timed = df.withColumn("_time", at).withColumn("_stretch", F.floor(F.col("_time") / length))
    own = F.when(F.col("_own") <= F.col("_time"), F.col("_own")).otherwise(F.col("_before"))
    begun = F.expr(f"`{ts}`") - F.expr("make_dt_interval(0, 0, 0, cast((_time - _window) / 1000000d as decimal(18, 6)))")
    return timed.join(known, "_stretch", "left").withColumn("_window", own).select(*df.columns, begun.alias("window_start"))


def window_admission(
    df: DataFrame, ts: str, request: str, client: str, window: str, per_client: int, global_cap: int,
    size: int = RANGE_TIMES, fan: int = FAN,
) -> DataFrame:
    """The whole log with the ``window_start`` of each request and whether it was ``admitted``.

    A request is let through while its client has had fewer than ``per_client`` and all clients together fewer than
    ``global_cap`` in its window; a refused one uses up nothing. Requests at one time come in the order of
    ``request``, which identifies a row. Requests without a time are in no window and not admitted; a null client is
    a client like any other. An empty log gives no rows.
    """
    windowed = with_window(df.select(ts, request, client), ts, window, size, fan).filter("window_start IS NOT NULL")
    windowed = settle(windowed)
    within = first_of_each(windowed, ["window_start", client], [ts, request], per_client)
    passed = first_of_each(within, ["window_start"], [ts, request], global_cap).select(request, F.lit(True).alias("_passed"))
    marks = windowed.select(request, "window_start").join(passed, request, "left")
    return df.join(marks, request, "left").select(*df.columns, "window_start", F.col("_passed").isNotNull().alias("admitted"))
