"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

Pieces are packed by their lengths alone, so the plan is made on the histogram of lengths (one entry per
possible length, whatever the corpus): a bin is filled greedily with the largest length that fits, then
its smallest document is replaced by two unpacked ones that fill the grown gap more tightly; the bin is
repeated as often as the histogram allows. Ranks of pieces among those of equal length then say, without
any communication, which copy of which bin each piece goes to.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cohortry.llm.encoding import encoder
from cohortry.llm.storage import stored
from cohortry.llm.words import slices
from cohortry.llm.worker_memory import let_go

CAPACITY = 2048
# rows of one length are ranked in groups of about this many
RANK_GROUP = 1 << 10


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian 32-bit): every whole text and ``end_id``, cut to size.

    Only documents longer than ``capacity`` are cut; all their pieces are full but the first, which has
    what remains. A null or empty text is its end id alone. Each row is a document of its own, also when
    it repeats a doc_id; other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, limit=1 << 20):
            rows = []
            texts = batch.column("text").fill_null("").to_pylist()
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode.encode_all(texts), strict=True):
                ids += end
                n = len(ids) // 4
                bounds = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for piece, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    rows.append((doc_id, piece, a, b - a, ids[4 * a : 4 * b]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids binary"
    )


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Bins as (lengths in descending order, number of such bins); every counted length is used up."""
    left = np.zeros(capacity + 1, np.int64)
    for length, count in histogram.items():
        left[length] = count
    sizes = np.arange(capacity + 1)
    bins = []

    def largest() -> np.ndarray:
        """For each room, the largest length still there that fits (0: none)."""
        return np.maximum.accumulate(np.where(left > 0, sizes, 0))

    while left.any():
        fits = largest()
        room, held = capacity, []
        while fits[room]:
            length = int(fits[room])
            take = min(int(left[length]), room // length)
            held += [length] * take
            room -= take * length
            left[length] -= take
            if not left[length]:
                fits = largest()
        if room and len(held) > 1:
            smallest = held[-1]
            grown = room + smallest
            fits = largest()
            # the second of a pair: the largest that fits beside the first, if it is there twice when equal
            beside = fits[grown - sizes[: grown + 1]]
            short = (beside == sizes[: grown + 1]) & (left[: grown + 1] < 2)
            lower = np.append(0, fits[:-1])[: grown + 1]
            beside = np.where(short, lower, beside)
            total = np.where((left[: grown + 1] > 0) & (beside > 0), sizes[: grown + 1] + beside, 0)
            first = int(np.argmax(total))
            if total[first] > smallest:
                second = int(beside[first])
                left[smallest] += 1
                left[first] -= 1
                left[second] -= 1
                held = sorted([*held[:-1], first, second], reverse=True)
        more = min(int(left[length]) // n for length, n in Counter(held).items())
        for length, n in Counter(held).items():
            left[length] -= more * n
        bins.append((held, more + 1))
    return bins


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a table with a ``length`` column, 1 to ``capacity``) plus sequence_id and offset.

    All columns are carried along. Only the histogram of lengths and the plan made from it pass the
    driver: at most ``capacity`` entries and a few times as many bins. Pieces of one length, however
    many (copies have equal lengths), are ranked in groups of bounded size.
    """
    spark = pieces.sparkSession
    carried = pieces.columns
    rows = stored(pieces.withColumn("length", F.col("length").cast("long")).select(F.struct(*carried).alias("row"), "length", F.monotonically_increasing_id().alias("id")))
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    groups = spark.createDataFrame(
        [(length, -(-count // RANK_GROUP)) for length, count in counts.items()], "length long, groups long"
    )
    # one row per length: never more than the capacity
    grouped = rows.join(F.broadcast(groups), "length").withColumn("salt", F.pmod(F.xxhash64("id"), "groups")).drop("groups")
    sizes = grouped.groupBy("length", "salt").count()
    by_length = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "salt", F.coalesce(F.sum("count").over(by_length), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("id")
    ranked = grouped.withColumn("turn", F.row_number().over(within) - 1).join(before, ["length", "salt"])
    ranked = ranked.select("length", (F.col("before") + F.col("turn")).alias("rank"), "row")

    # per length the ranges of ranks, each with the bins it fills
    entries, first_bin, used = [], 0, Counter()
    for held, copies in plan_bins(counts, capacity):
        offset = 0
        for length, n in sorted(Counter(held).items(), reverse=True):
            entries.append((length, used[length], n, first_bin, offset))
            used[length] += n * copies
            offset += n * length
        first_bin += copies
    entries.sort()
    length, begin, each, bin_, offset = (np.array(c, np.int64) for c in zip(*entries, strict=True)) if entries else [np.zeros(0, np.int64)] * 5
    bounds = np.searchsorted(length, np.arange(capacity + 2))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()  # of the tokenizer that cut the pieces
        for batch in batches:
            own, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            order = np.lexsort((rank, own))
            entry = np.zeros(len(own), np.int64)
            at = np.searchsorted(own[order], np.arange(capacity + 2))
            for size in np.unique(own):
                part = order[at[size] : at[size + 1]]
                entry[part] = bounds[size] + np.searchsorted(begin[bounds[size] : bounds[size + 1]], rank[part], "right") - 1
            turn = rank - begin[entry]
            sequence = bin_[entry] + turn // each[entry]
            within = offset[entry] + turn % each[entry] * own
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(sequence), pa.array(within)], names=["row", "sequence_id", "offset"]
            )

    placed = T.StructType([rows.schema["row"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, placed).select("row.*", "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length, ids (32-bit, little-endian): packed pieces with ``ids`` laid end to end."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    # a sequence holds at most its capacity in tokens, so a group is bounded
    laid = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), ordered.alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda done, part: F.concat(done, part["ids"]))
    return laid.select("sequence_id", "length", joined.alias("ids"))
