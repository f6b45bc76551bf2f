"""Exact duplicates by counting quotient filters.

Every partition counts the fingerprints of its texts in counting quotient filters, one for each range
of fingerprints. Filters of one range are merged without loss: their fingerprints come out in order
(quotient, then sorted remainders), and equal ones add their counts. Only texts whose fingerprint counts
more than one are compared byte by byte.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.storage import stored

# a merged filter holds about so many fingerprints
RANGE_SIZE = 1 << 17
_FILTER = "range long, quotient_bits int, occupied binary, run_end binary, remainder binary, count binary"


class QuotientFilter(NamedTuple):
    """Fingerprints of ``width`` bits, their upper ``quotient_bits`` given by place, the rest stored.

    ``occupied`` marks quotients that have a run, ``run_end`` the slot in which each run ends;
    runs follow in order of their quotients, remainders within a run ascend.
    """

    width: int
    quotient_bits: int
    occupied: np.ndarray
    run_end: np.ndarray
    remainder: np.ndarray
    count: np.ndarray


def build_filter(prints: np.ndarray, counts: np.ndarray, width: int) -> QuotientFilter:
    """A filter of ascending, distinct fingerprints below ``2**width``."""
    bits = min(width, max(1, math.ceil(math.log2(max(len(prints), 1) / 0.75 + 1))))
    low = np.uint64(width - bits)
    quotient = (prints >> low).astype(np.int64)
    order = np.arange(len(prints))
    slot = order + np.maximum.accumulate(quotient - order) if len(prints) else order
    slots = max(1 << bits, int(slot[-1]) + 1 if len(slot) else 0)
    occupied, run_end = np.zeros(1 << bits, bool), np.zeros(slots, bool)
    occupied[quotient] = True
    run_end[slot[np.append(np.diff(quotient) > 0, True)] if len(slot) else slot] = True
    remainder, count = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
    remainder[slot] = prints & ((np.uint64(1) << low) - np.uint64(1))
    count[slot] = counts
    return QuotientFilter(width, bits, occupied, run_end, remainder, count)


def filter_entries(held: QuotientFilter) -> tuple[np.ndarray, np.ndarray]:
    """All fingerprints in order, and their counts."""
    quotient, end = np.flatnonzero(held.occupied), np.flatnonzero(held.run_end)
    begin = np.maximum(quotient, np.append(-1, end[:-1]) + 1) if len(end) else end
    length = end - begin + 1
    slot = np.repeat(begin - np.append(0, np.cumsum(length)[:-1]), length) + np.arange(length.sum())
    upper = np.repeat(quotient, length).astype(np.uint64) << np.uint64(held.width - held.quotient_bits)
    return upper | held.remainder[slot], held.count[slot]


def merge_filters(filters: list[QuotientFilter]) -> QuotientFilter:
    """One filter with the summed counts; quotients and remainders of all parts stay exact."""
    prints, counts = (np.concatenate(x) for x in zip(*map(filter_entries, filters), strict=True))
    prints, counts = _summed(prints, counts)
    return build_filter(prints, counts, filters[0].width)


def _summed(prints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(prints, kind="stable")
    prints, counts = prints[order], counts[order]
    begin = np.flatnonzero(np.append(True, prints[1:] != prints[:-1])) if len(prints) else np.zeros(0, np.int64)
    return prints[begin], np.add.reduceat(counts, begin) if len(begin) else counts


def _pack(part: int, held: QuotientFilter) -> dict:
    return {
        "range": part, "quotient_bits": held.quotient_bits,
        "occupied": np.packbits(held.occupied).tobytes(), "run_end": np.packbits(held.run_end).tobytes(),
        "remainder": held.remainder.tobytes(), "count": held.count.tobytes(),
    }


def _unpack(row: dict, width: int) -> QuotientFilter:
    remainder = np.frombuffer(row["remainder"], np.uint64)
    bits = lambda name, n: np.unpackbits(np.frombuffer(row[name], np.uint8), count=n).astype(bool)
    return QuotientFilter(
        width, row["quotient_bits"], bits("occupied", 1 << row["quotient_bits"]), bits("run_end", len(remainder)),
        remainder, np.frombuffer(row["count"], np.uint64),
    )


def repeated_fingerprints(keys: DataFrame, fingerprint: str) -> DataFrame:
    """Fingerprints (64-bit, signed) that occur in more than one row, with their counts.

    One filter per partition and range is shuffled, however often a fingerprint occurs, so a
    fingerprint held by a third of all rows is a single counted slot.
    """
    rows = keys.count()
    range_bits = max(4, math.ceil(math.log2(max(rows, 1) / RANGE_SIZE))) if rows > RANGE_SIZE else 4
    width = 64 - range_bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, counts = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for batch in batches:
            new = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            prints = np.concatenate([prints, new])
            counts = np.concatenate([counts, np.ones(len(new), np.uint64)])
            prints, counts = _summed(prints, counts)
        part = (prints >> np.uint64(width)).astype(np.int64)
        bounds = np.searchsorted(part, np.arange((1 << range_bits) + 1))
        low = (np.uint64(1) << np.uint64(width)) - np.uint64(1)
        packed = [
            _pack(k, build_filter(prints[a:b] & low, counts[a:b], width))
            for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))
            if b > a
        ]
        if packed:
            yield pa.RecordBatch.from_pylist(packed, _FILTER_ARROW)

    def merge(pieces: pa.Table) -> pa.Table:
        part = pieces.column("range")[0].as_py()
        merged = merge_filters([_unpack(row, width) for row in pieces.to_pylist()])
        prints, counts = filter_entries(merged)
        more = counts > 1
        whole = (prints[more] | (np.uint64(part) << np.uint64(width))).view(np.int64)
        return pa.table({fingerprint: whole, "copies": counts[more].astype(np.int64)})

    filters = keys.select(fingerprint).mapInArrow(count, _FILTER)
    return filters.groupBy("range").applyInArrow(merge, f"{fingerprint} long, copies long")


_FILTER_ARROW = pa.schema(
    [("range", pa.int64()), ("quotient_bits", pa.int32()), ("occupied", pa.binary()), ("run_end", pa.binary()),
     ("remainder", pa.binary()), ("count", pa.binary())]
)


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``.

    Texts are equal when they agree after each run of white space becomes one space; null counts as
    empty, so null and empty texts form one group. keep_id is the smallest doc_id of the group (null
    only if the group has no other). Rows that repeat a doc_id are one document: they all count in
    group_size and share ``kept``. Other columns of ``docs`` are ignored. An empty table gives no rows.
    """
    texts = docs.select("doc_id", normalised(F.col("text")).alias("body")).withColumn("print", F.xxhash64("body"))
    keys = stored(texts.select("doc_id", "print", F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256")))
    repeated = stored(repeated_fingerprints(keys, "print"))
    routed = texts.join(repeated.select("print"), "print", "left_semi")
    # whole texts are the key; partial sums leave one row per text and task before the exchange
    verified = routed.groupBy("body").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = verified.filter("group_size > 1").select(
        F.xxhash64("body").alias("print"), F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size"
    )
    found = keys.join(stored(groups), ["print", "text_sha256"], "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep_id.eqNullSafe(F.col("doc_id")).alias("kept"),
        "text_sha256",
    )
