"""Document quality: hashed word n-grams, logistic regression trained by follow-the-regularised-leader.

Features are words and pairs of words, their shapes (runs of letters, capitals and digits drawn together,
signs kept) and pairs of shapes, and a word that repeats the one before it, each hashed to one of
``DIMENSIONS`` weights with its share of the text as value. Training runs on a sample of labelled rows of
bounded size, split into shards that take one pass each from the common state; the states are averaged and
the next pass begins. Scores are sparse dot products over every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.llm.storage import stored
from cohortry.llm.words import Words, carried, hash_words, mix, slices, split_words, with_text
from cohortry.llm.worker_memory import let_go

DIMENSIONS = 1 << 17
# labelled rows that are learnt from, those with the least hash of their doc_id
MAX_ROWS = 16_000
SHARDS = 8
PASSES = 6
# text scored at a time; its features take about fifty times as much memory
SCORE_BYTES = 1 << 20
ALPHA, BETA, L1, L2 = 2.0, 1e-3, 1e-4, 1e-4

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[0x80:] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("0") : ord("9") + 1] = ord("0")


def shapes(words: Words) -> Words:
    """The words with each run of one class of characters as a single one."""
    kind = _CLASS[words.data]
    keep = np.ones(len(kind), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[words.begin] = True
    place = np.append(0, np.cumsum(keep))
    return Words(kind[keep], place[words.begin], place[words.end], words.first)


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, weight index) of all n-grams. Index 0 is the bias and belongs to no n-gram."""
    owner = words.owner()
    follows = owner[1:] == owner[:-1]
    rows, found = [], []
    for kind, own in enumerate((words, shapes(words))):
        hashed = hash_words(own, 10 + kind)
        pair = mix(hashed[:-1] ^ (hashed[1:] * np.uint64(0x9E3779B97F4A7C15)))[follows]
        rows += [owner, owner[1:][follows]]
        found += [hashed, pair]
        if kind == 0:
            again = follows & (hashed[1:] == hashed[:-1])
            rows.append(owner[1:][again])
            found.append(np.full(int(again.sum()), 1, np.uint64))
    index = (mix(np.concatenate(found)) % np.uint64(DIMENSIONS - 1)).astype(np.int64) + 1
    return np.concatenate(rows), index


def _probability(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


def solve(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The leader's weights under both penalties."""
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def learn(index: np.ndarray, value: np.ndarray, label: float, z: np.ndarray, n: np.ndarray) -> None:
    """One row's step; ``index`` are distinct."""
    weight = solve(z[index], n[index])
    gradient = (float(_probability(weight @ value)) - label) * value
    grown = n[index] + gradient**2
    z[index] += gradient - (np.sqrt(grown) - np.sqrt(n[index])) / ALPHA * weight
    n[index] = grown


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    let_go()
    for batch in slices(batches, limit=1 << 20):
        words = split_words(batch.column("text"))
        row, index = features(words)
        pair, count = np.unique(row * DIMENSIONS + index, return_counts=True)
        row, index = pair // DIMENSIONS, pair % DIMENSIONS
        value = count / np.maximum(words.per_text(), 1)[row]
        bounds = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("shard"), batch.column("turn"), batch.column("quality"),
             pa.ListArray.from_arrays(bounds, pa.array(index, pa.int32())), pa.ListArray.from_arrays(bounds, pa.array(value, pa.float32()))],
            names=["shard", "turn", "quality", "index", "value"],
        )


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> np.ndarray:
    """Weights from at most ``max_rows`` labelled rows; rows without a label or doc_id are not learnt from.

    Without any labelled row all weights are zero and every score is one half.
    """
    turn = F.xxhash64("doc_id")
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    chosen = chosen.filter("doc_id IS NOT NULL AND quality IS NOT NULL").orderBy(turn, "doc_id", "quality").limit(max_rows)
    # at most max_rows pairs of numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    sample = rows.select(F.pmod(turn, F.lit(SHARDS)).cast("int").alias("shard"), turn.alias("turn"), "quality", "text")
    vectors = stored(
        sample.mapInArrow(_vectors, "shard int, turn long, quality int, index array<int>, value array<float>").repartition(SHARDS, "shard")
    )
    z, n = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    context = docs.sparkSession.sparkContext
    for _ in range(PASSES):
        start = context.broadcast((z, n))

        def one_pass(table: pa.Table) -> pa.Table:
            own_z, own_n = (x.copy() for x in start.value)  # noqa: B023  collected before the next pass
            table = table.sort_by("turn")
            labels = table.column("quality").to_pylist()
            columns = [table.column(c).combine_chunks() for c in ("index", "value")]
            bounds = columns[0].offsets.to_numpy()
            index, value = (c.values.to_numpy() for c in columns)
            for label, a, b in zip(labels, bounds[:-1], bounds[1:], strict=True):
                learn(np.append(0, index[a:b]), np.append(1.0, value[a:b]), float(label > 0), own_z, own_n)
            return pa.table({"z": [own_z.tobytes()], "n": [own_n.tobytes()]})

        # one state per shard: a fixed number of fixed size
        states = vectors.groupBy("shard").applyInArrow(one_pass, "z binary, n binary").collect()
        if states:
            z, n = (np.mean([np.frombuffer(s[k]) for s in states], axis=0) for k in ("z", "n"))
        start.unpersist()
    return solve(z, n)


def score(docs: DataFrame, weights: np.ndarray, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, score: 0 to 1, higher for better documents; null and empty texts have the bias alone.

    One row per row of ``docs``, repeated doc_ids included. Columns to ``carry`` come along in ``row``,
    others are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in slices(with_text(batches), limit=SCORE_BYTES):
            words = split_words(batch.column("text"))
            row, index = features(words)
            margin = np.bincount(row, held.value[index], batch.num_rows) / np.maximum(words.per_text(), 1) + held.value[0]
            kept = [batch.column("row")] if carry else []
            out = [batch.column("doc_id"), pa.array(_probability(margin)), *kept]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "score", "row"][: len(out)])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carried(carry))
    out = T.StructType().add("doc_id", "long").add("score", "double")
    if carry:
        out = out.add(texts.schema["row"])
    return texts.mapInArrow(run, out)


def held_out():
    """Rows that are never learnt from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def classify(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = MAX_ROWS, carry: Sequence[str] = ()
) -> DataFrame:
    """doc_id, held_out, score, predicted, and the row's columns to carry.

    Trained on labels outside the held-out fifth, all documents scored. A null doc_id counts as held out.
    """
    weights = train(docs, labels.filter(~held_out()), max_rows)
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    scored = score(docs, weights, carry)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(True)).alias("held_out"), "score", predicted, *scored.columns[2:])
