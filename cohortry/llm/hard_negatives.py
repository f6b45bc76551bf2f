"""Hard negatives of anchor vectors, scored by Kronecker-packed products.

Components are integers, floor(scale * x). Each is biased to a number of at least zero; the components of
several candidates at one place are laid into separated fields of one wide integer. Multiplying the packed
candidates by an anchor's biased component, and adding up over the places, leaves in each field the sum of one
candidate's products: a field is wide enough that it never spills into the next. The bias is then taken off
again, so scores are exact. Wide integers are held in doubles while they stay below 2^53, where a double is
exact and the matrix product adds nothing inexact; wider ones are integers of any length.

Anchors are a stated query set that is compared with all rows. They go in blocks of bounded size, each sent to
the tasks, which pass over their rows once for the positives and once for the negatives. Every task keeps the
first few rows of each anchor; windows over those of all tasks give the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.storage import scratch_folder, stored

# numbers in one block of anchors, as it is sent to the tasks
BLOCK_NUMBERS = 2 << 20
_EXACT = 53
_LONG = (1 << 63) - 1
_TILE = 1024


def whole_numbers(flat: np.ndarray, scale: int, wide: bool) -> np.ndarray:
    """floor(scale * x) of doubles; of any length if ``wide``."""
    if not wide:
        return np.floor(flat * scale)
    return np.array([math.floor(x * scale) if math.isfinite(x * scale) else int(x) * scale for x in flat.tolist()], object)


class Packing:
    """How numbers from ``low`` to ``high`` in ``width`` places are biased and laid into fields."""

    def __init__(self, low: int, high: int, width: int) -> None:
        self.bias, self.width = -low, max(width, 1)
        self.bits = max(1, (self.width * (high - low) ** 2).bit_length())
        self.wide = self.bits > _EXACT
        # a wide integer of any length takes a few more
        self.fields = 8 if self.wide else _EXACT // self.bits
        self.kind = object if self.wide else np.float64

    def biased(self, numbers: np.ndarray) -> np.ndarray:
        return (numbers + self.bias).astype(self.kind)

    def pack(self, biased: np.ndarray) -> np.ndarray:
        """Rows of candidates, ``fields`` of them in each row of the result."""
        rows = -(-len(biased) // self.fields) * self.fields
        padded = np.zeros((rows, self.width), self.kind)
        padded[: len(biased)] = biased
        packed = np.zeros((rows // self.fields, self.width), self.kind)
        for k in range(self.fields):
            packed += padded[k :: self.fields] * self.kind_of(1 << (k * self.bits))
        return packed

    def kind_of(self, number: int):
        return number if self.wide else float(number)

    def scores(self, anchors: np.ndarray, packed: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Exact inner products, anchors by candidates, held to the range of a long.

        ``anchors`` and ``candidates`` are biased; the latter only give their sums here.
        """
        held = anchors @ packed.T
        held = held if self.wide else held.astype(np.int64)
        out = np.empty((len(anchors), len(packed) * self.fields), object if self.wide else np.int64)
        mask = (1 << self.bits) - 1
        for k in range(self.fields):
            out[:, k :: self.fields] = (held >> (k * self.bits)) & mask
        out = out[:, : len(candidates)]
        own, other = anchors.sum(1), candidates.sum(1)
        if not self.wide:
            own, other = own.astype(np.int64), other.astype(np.int64)
        out = out - self.bias * own[:, None] - self.bias * other[None, :] + self.bias * self.bias * self.width
        return out if not self.wide else np.clip(out, -_LONG, _LONG).astype(np.int64)


def _matrix(column: pa.Array, packing: Packing, scale: int) -> np.ndarray:
    """Biased components; a shorter vector goes on with zeros."""
    column = column.cast(pa.large_list(pa.float64()))
    lengths = column.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    numbers = whole_numbers(column.flatten().to_numpy(), scale, packing.wide)
    out = np.zeros((len(column), packing.width), packing.kind)
    row = np.repeat(np.arange(len(column)), lengths)
    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, place] = numbers
    return packing.biased(out)


class _First:
    """The first ``k`` rows of every slot: higher scores first, ties by smaller id."""

    def __init__(self, slots: int, k: int) -> None:
        self.k = k
        self.slot = self.score = self.vec_id = np.zeros(0, np.int64)
        self.bound = np.full(slots, -_LONG)  # a lower score can't come in

    def add(self, slot: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        if len(slot) == 0:
            return
        slot, score, vec_id = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.vec_id, vec_id)))
        order = np.lexsort((vec_id, -score, slot))
        slot = slot[order]
        begin = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        rank = np.arange(len(slot)) - np.repeat(begin, np.diff(np.append(begin, len(slot))))
        kept = order[rank < self.k]
        full = order[rank == self.k - 1]
        self.bound[slot[rank == self.k - 1]] = score[full]
        self.slot, self.score, self.vec_id = slot[rank < self.k], score[kept], vec_id[kept]


def _scan(batches: Iterator[pa.RecordBatch], block: dict, packing: Packing, scale: int, k: int) -> Iterator[pa.RecordBatch]:
    """The first ``k`` rows of this task for every slot of the block.

    Without positives an anchor is one slot that takes rows of its label; with them, each (anchor, positive)
    is one that takes rows of other labels in the positive's range.
    """
    positives = block.get("scores")
    per_anchor = 1 if positives is None else positives.shape[1]
    first = _First(len(block["label"]) * per_anchor, k)
    for batch in batches:
        for begin in range(0, batch.num_rows, _TILE):
            part = batch.slice(begin, _TILE)
            vec_id, label = part.column("vec_id").to_numpy(), part.column("label").to_numpy()
            candidates = _matrix(part.column("embedding"), packing, scale)
            packed = packing.pack(candidates)
            for at in range(0, len(block["label"]), _TILE):
                rows = slice(at, at + _TILE)
                score = packing.scores(block["vectors"][rows], packed, candidates)
                same = block["label"][rows, None] == label[None, :]
                if positives is None:
                    taken = same & (block["vec_id"][rows, None] != vec_id[None, :]) & (score >= first.bound[rows, None])
                    row, column = np.nonzero(taken)
                    first.add(at + row, score[row, column], vec_id[column])
                    continue
                other = ~same & (block["vec_id"][rows, None] != vec_id[None, :])
                for turn in range(per_anchor):
                    slots = (at + np.arange(len(same))) * per_anchor + turn
                    high = positives[rows, turn]
                    low = np.maximum(high - high // 5, first.bound[slots])
                    taken = other & block["present"][rows, turn, None] & (score <= high[:, None]) & (score >= low[:, None])
                    row, column = np.nonzero(taken)
                    first.add(slots[row], score[row, column], vec_id[column])
    anchor, turn = np.divmod(first.slot, per_anchor)
    yield pa.RecordBatch.from_arrays(
        [pa.array(anchor.astype(np.int32)), pa.array(turn.astype(np.int32)), pa.array(first.vec_id), pa.array(first.score)],
        names=["anchor", "turn", "vec_id", "score"],
    )


def _first_rows(rows: DataFrame, block: dict, packing: Packing, scale: int, k: int) -> DataFrame:
    """anchor, turn, vec_id, score, rank: the first ``k`` rows of every slot over all tasks."""
    held = rows.sparkSession.sparkContext.broadcast(block)
    found = rows.mapInArrow(
        lambda batches: _scan(batches, held.value, packing, scale, k), "anchor int, turn int, vec_id long, score long"
    )
    order = Window.partitionBy("anchor", "turn").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def taking_part(embeddings: DataFrame, shift_label) -> DataFrame:
    """vec_id, label, embedding of the rows that are compared."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    return rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").filter(sound).withColumn("label", shift_label)


def mine(
    embeddings: DataFrame,
    anchors: str = "vec_id % 100 = 0",
    n_positives: int = 5,
    n_negatives: int = 5,
    scale: int = 256,
    block_numbers: int = BLOCK_NUMBERS,
    label: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Positives are the first ``n_positives`` other rows of the anchor's label, higher scores first and ties by
    smaller vec_id. For each, the first ``n_negatives`` rows of other labels with a score from four fifths of the
    positive's up to it. ``anchors`` and ``label`` are SQL conditions on vec_id and label.

    Rows without vec_id, label or vector, or with a component that is null or not finite, take no part. Rows of
    one vec_id are neither each other's positives nor negatives; each that differs is an anchor of its own.
    Vectors of unequal length are compared in the places both have; an empty one scores 0. Scores are held to
    the range of a long. A negative positive has no negatives. Other columns are ignored; a table without rows
    or anchors gives no rows. Repeated rows of a candidate are each listed.
    """
    spark = embeddings.sparkSession
    rows = taking_part(embeddings, F.expr(label))
    edges = rows.agg(F.max(F.size("embedding")), F.min(F.array_min("embedding")), F.max(F.array_max("embedding"))).first()
    width, low, high = edges[0] or 1, *(whole_numbers(np.array([x or 0.0]), scale, True)[0] for x in edges[1:])
    packing = Packing(min(low, 0), max(high, 0), width)
    # dealt by content into blocks half full, so that none holds more than its share of numbers
    mine = stored(rows.filter(anchors).distinct())
    blocks = max(1, -(-2 * mine.count() * width // block_numbers))
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    folder = scratch_folder(spark)
    spark.createDataFrame([], out).write.parquet(f"{folder}/block=-1")
    for number in range(blocks):
        # a block of bounded size passes the driver, as every broadcast does
        own = mine.filter(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)) == number).toArrow().combine_chunks()
        if own.num_rows == 0:
            continue
        vectors = _matrix(own.column("embedding").combine_chunks(), packing, scale)
        block = {"vec_id": own.column("vec_id").to_numpy(), "label": own.column("label").to_numpy(), "vectors": vectors}
        positives = stored(_first_rows(rows, block, packing, scale, n_positives))
        near = positives.toArrow()
        at = near.column("anchor").to_numpy(), near.column("rank").to_numpy() - 1
        block["present"] = np.zeros((own.num_rows, n_positives), bool)
        block["scores"] = np.zeros((own.num_rows, n_positives), np.int64)
        block["present"][at], block["scores"][at] = True, near.column("score").to_numpy()
        negatives = _first_rows(rows, block, packing, scale, n_negatives)
        names = spark.createDataFrame(pa.table({"anchor": pa.array(range(own.num_rows), pa.int32()), "anchor_id": own.column("vec_id")}))
        pairs = positives.select("anchor", (F.col("rank") - 1).alias("turn"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        found = negatives.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(pairs, ["anchor", "turn"]).join(names, "anchor")
        found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.parquet(f"{folder}/block={number}")
    return spark.read.schema(out).parquet(folder).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
