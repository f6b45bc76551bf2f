"""Repeated passages: windows of consecutive words that also start in an earlier document.

Two passes. The first sketches the corpus: every window is filed under its anchor, the shingle of ten words
with the smallest hash inside it, so equal windows have equal anchors and about one anchor serves twenty
windows. Each document counts each of its anchors once. Partition sketches (count-min: a few rows of
counters, addressed by hashes of the anchor) add up to the corpus sketch, whose counts are never too low.
The second pass takes only windows whose anchor is estimated in two documents or more, groups them exactly,
and finds the smallest document of each. A window in two documents always passes, so none is lost.

The sketch grows with the corpus and is never gathered: its counters are rows, added up and looked up by
joins on their place, so a common anchor is a partial sum per task, and never a group in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.llm.storage import stored
from cohortry.llm.words import carried, hash_sequences, hash_windows, hash_words, mix, slices, split_words, window_starts, with_text

WINDOW = 50
ANCHOR = 10
SKETCH_ROWS = 2
# counters per anchor: an anchor of one document shares all its counters with others once in hundreds
COUNTERS_PER_ANCHOR = 16
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _anchors(hashed: np.ndarray, first: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window (by its first word's index) the hash of its anchor."""
    starts = window_starts(first, window)
    shingle = hash_windows(hashed, anchor, 0xD6E8FEB86659FD93)
    span = window - anchor + 1
    # sliding minimum by doubling: the minimum over 2^k entries, then two of them overlap to the span
    least, width = shingle, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return starts, np.minimum(least[starts], least[starts + span - width]) if len(starts) else np.zeros(0, np.uint64)


def _owners(first: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.searchsorted(first, starts, "right") - 1


def _distinct(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs. Neighbours are mostly equal, so they go first and sorting has less to do."""
    for ordered in (False, True):
        if ordered:
            order = np.lexsort((value, owner))
            owner, value = owner[order], value[order]
        new = np.append(True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1]))[: len(value)]
        owner, value = owner[new], value[new]
    return owner, value


def _anchor_rows(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """Per text the number of its words, two hashes of them in order, and its distinct anchors."""
    for batch in slices(batches):
        words = split_words(batch.column("text"))
        starts, least = _anchors(hash_words(words), words.first, window, anchor)
        owner, least = _distinct(_owners(words.first, starts), least)
        bounds = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)), pa.int32())
        same = [pa.array(hash_sequences(words, seed).view(np.int64)) for seed in (2, 3)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("version"), pa.array(words.per_text()), *same,
             pa.ListArray.from_arrays(bounds, pa.array(least.view(np.int64)))],
            names=["doc_id", "version", "n_words", "same_a", "same_b", "anchors"],
        )


def _window_rows(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """Windows whose anchor is among those wanted of their document, with 96 bits of hash."""
    for batch in slices(batches, limit=2 << 20):
        words = split_words(batch.column("text"))
        hashed = hash_words(words)
        starts, least = _anchors(hashed, words.first, window, anchor)
        owner = _owners(words.first, starts)
        wanted = batch.column("anchors")
        listed = np.repeat(np.arange(batch.num_rows), wanted.value_lengths().to_numpy())
        pair = lambda row, value: mix(value + mix(row.astype(np.uint64)))
        # equal pairs are always found; a chance match only adds a window to the exact pass
        take = np.isin(pair(owner, least), pair(listed, wanted.flatten().to_numpy().view(np.uint64)))
        starts, owner = starts[take], owner[take]
        high = hash_windows(hashed, window, _BASES[0])
        low = hash_windows(hash_words(words, 1), window, _BASES[1])
        high, low = high[starts], low[starts]
        # one word over and over is one window at many places in a row: a single entry
        ahead = (high[1:] != high[:-1]) | (low[1:] != low[:-1]) | (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1)
        begin = np.flatnonzero(np.append(True, ahead)[: len(starts)])
        run = np.diff(np.append(begin, len(starts)))
        starts, owner = starts[begin], owner[begin]
        keys = [batch.column(k).take(pa.array(owner)) for k in ("doc_id", "version")]
        place = pa.array((starts - words.first[owner]).astype(np.int32))
        high, low = high[begin].view(np.int64), (low[begin] >> np.uint64(32)).astype(np.uint32).view(np.int32)
        yield pa.RecordBatch.from_arrays(
            [*keys, place, pa.array(run.astype(np.int32)), pa.array(high), pa.array(low)],
            names=["doc_id", "version", "place", "run", "high", "low"],
        )


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Texts without the words that the listed windows cover."""
    for batch in slices(with_text(batches), limit=1 << 20):
        totals, removed, kept = [], [], []
        columns = (batch.column(c).to_pylist() for c in ("text", "version", "copies", "versions", "places", "runs"))
        for text, version, copies, versions, places, runs in zip(*columns, strict=True):
            words = (text or "").encode().split()  # bytes are split at exactly these six characters
            totals.append(len(words))
            if copies and version in copies:
                words = []
            elif places:
                own = np.array(versions) == version
                places, runs = np.array(places, np.int64)[own], np.array(runs, np.int64)[own]
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, places, 1)
                np.add.at(change, places + runs - 1 + window, -1)
                stays = np.cumsum(change)[:-1] == 0
                words = [word for word, stay in zip(words, stays.tolist(), strict=True) if stay]
            removed.append(totals[-1] - len(words))
            kept.append(b" ".join(words).decode())
        out = [batch.column("doc_id"), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_text"]
        if "row" in batch.schema.names:
            out, names = [*out, batch.column("row")], [*names, "row"]
        yield pa.RecordBatch.from_arrays(out, names=names)


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, carry: Sequence[str] = ()
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (words joined by one space), and ``row``: the columns to carry.

    A word goes when a window of ``window`` words over it also starts in a document with a smaller doc_id;
    windows are judged on the input. Texts shorter than a window lose nothing; null texts have no words.
    Rows of one doc_id are one document: they take nothing from each other. A null doc_id is neither
    smaller nor larger than another, so such rows stay whole. Other columns than ``carry`` are ignored.
    """
    version = F.xxhash64("text").alias("version")  # tells rows of one doc_id apart
    keys = [F.col("doc_id").cast("long").alias("doc_id"), version]
    base = docs.select(*keys, "text")
    whole = docs.select(*keys, *carried(carry)) if carry else base
    key = "doc_id long, version long"
    held = base.filter("doc_id IS NOT NULL").select("doc_id", "version", "text")
    read = stored(
        held.mapInArrow(
            lambda it: _anchor_rows(it, window, anchor), f"{key}, n_words long, same_a long, same_b long, anchors array<long>"
        )
    )
    # a text whose words are those of an earlier document loses them all; its windows need no look
    groups = read.groupBy("same_a", "same_b").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    read = read.join(groups, ["same_a", "same_b"], "left").withColumn("copy", F.coalesce(F.expr("doc_id > first"), F.lit(False)))
    copies = read.filter(F.col("copy") & (F.col("n_words") >= window)).groupBy("doc_id").agg(F.collect_set("version").alias("copies"))
    likely = stored(read.filter("NOT copy").select("doc_id", F.explode("anchors").alias("anchor")))

    # count-min, row after row: of anchors that an earlier row has let through, the counters that reach two
    counters = 1 << max(10, math.ceil(math.log2(max(likely.count(), 1) * COUNTERS_PER_ANCHOR)))
    for row in range(SKETCH_ROWS):
        counter = F.pmod(F.xxhash64("anchor", F.lit(row)), F.lit(counters)).alias("counter")
        busy = likely.groupBy(counter).count().filter("count >= 2").select("counter")
        likely = stored(likely.withColumn("counter", counter).join(busy, "counter", "left_semi").drop("counter"))
    wanted = likely.groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"))

    # one exchange of the texts serves this join and the last one
    windows = whole.join(wanted, "doc_id").mapInArrow(
        lambda it: _window_rows(with_text(it), window, anchor), f"{key}, place int, run int, high long, low int"
    )
    first = windows.groupBy("high", "low").agg(F.min("doc_id").alias("first"))
    later = windows.join(first, ["high", "low"]).filter("doc_id > first")
    # the lists follow the same rows
    lists = {"version": "versions", "place": "places", "run": "runs"}
    repeats = later.groupBy("doc_id").agg(*[F.collect_list(c).alias(name) for c, name in lists.items()])
    changes = repeats.join(copies, "doc_id", "full")
    out = T.StructType().add("doc_id", "long").add("n_words", "long").add("n_removed", "long").add("kept_text", "string")
    if carry:
        out = out.add(whole.schema["row"])
    return whole.join(changes, "doc_id", "left").mapInArrow(lambda it: _cut(it, window), out)
