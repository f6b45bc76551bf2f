"""Masked pseudo-likelihood: every word of a text predicted from the words on both sides of it.

Words are classes of the network: each of the most frequent words of the whole corpus is its own, all others are
one, whose probability is divided among its words by the corpus counts, a Spark table of every word. The network
looks at two words before and two behind: an embedding for each place, their sum through tanh, and a softmax in
two steps (a group of words, then the word within it), so a prediction costs tens of products, not thousands.
It is trained in numpy with Adagrad, starting at the corpus frequencies: each of ``ROUNDS`` rounds takes the texts
of one remainder of a hash, so that every text is learnt once. Blocks of about ``BLOCK`` words set out from the
round's start with its Adagrad sums, and Spark averages what they reach, weighted by words. Tasks are merged until
they hold a block, larger ones are several blocks: the model depends on the texts, not on how they are partitioned.
A document's score is the sum of the log-probabilities of its words, each given its neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.storage import stored
from cohortry.llm.words import hash_words, slices, split_words

GROUPS = 32
PER_GROUP = 32
WIDTH = 16
CONTEXT = (-2, -1, 1, 2)
BATCH = 8192
RATE = 0.1
DAMPING = 1e-3
ROUNDS = 4
BLOCK = 1 << 19
CHUNK = 1 << 13
FAN_IN = 64

Network = dict[str, np.ndarray]


def initial(groups: int = GROUPS, per_group: int = PER_GROUP, width: int = WIDTH) -> Network:
    """Embeddings for each place (the last row: outside the text), weights and biases of both steps."""
    generator, size = np.random.default_rng(0), groups * per_group
    draw = lambda *shape: (generator.standard_normal(shape) * 0.1).astype(np.float32)
    zeros = lambda *shape: np.zeros(shape, np.float32)
    return {
        "embed": draw(len(CONTEXT), size + 1, width), "hidden": zeros(width),
        "group": draw(width, groups), "group_bias": zeros(groups),
        "word": draw(groups, width, per_group), "word_bias": zeros(groups, per_group),
    }


def contexts(ids: np.ndarray, first: np.ndarray, outside: int) -> np.ndarray:
    """For each word the ids at the places around it, ``outside`` beyond its text."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    place, around = np.arange(len(ids)), np.full((len(CONTEXT), len(ids)), outside, np.int64)
    for k, step in enumerate(CONTEXT):
        there = place + step
        inside = (there >= first[owner]) & (there < first[owner + 1])
        around[k, inside] = ids[there[inside]]
    return around


def _log_softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(axis=1, keepdims=True)
    logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
    return logits


def _hidden(net: Network, around: np.ndarray) -> np.ndarray:
    total = net["hidden"] + net["embed"][0][around[0]]
    for k in range(1, len(CONTEXT)):
        total += net["embed"][k][around[k]]
    return np.tanh(total)


def _by_group(group: np.ndarray, groups: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(group, kind="stable")
    bounds = np.searchsorted(group[order], np.arange(groups + 1))
    for g in np.flatnonzero(np.diff(bounds)):
        yield int(g), order[bounds[g] : bounds[g + 1]]


def log_probabilities(net: Network, ids: np.ndarray, around: np.ndarray) -> np.ndarray:
    """log p(word | both sides) of each word."""
    groups, per_group = net["word_bias"].shape
    out = np.empty(len(ids))
    for begin in range(0, len(ids), BATCH):
        part = slice(begin, begin + BATCH)
        hidden, group, member = _hidden(net, around[:, part]), ids[part] // per_group, ids[part] % per_group
        rows = np.arange(len(hidden))
        found = _log_softmax(hidden @ net["group"] + net["group_bias"])[rows, group].astype(np.float64)
        for g, own in _by_group(group, groups):
            logits = _log_softmax(hidden[own] @ net["word"][g] + net["word_bias"][g])
            found[own] += logits[np.arange(len(own)), member[own]]
        out[part] = found
    return out


def gradients(net: Network, ids: np.ndarray, around: np.ndarray) -> Network:
    """Of the mean negative log-probability of one batch."""
    groups, per_group = net["word_bias"].shape
    n = len(ids)
    hidden, group, member = _hidden(net, around), ids // per_group, ids % per_group
    out = {name: np.zeros_like(value) for name, value in net.items()}
    error = np.exp(_log_softmax(hidden @ net["group"] + net["group_bias"]))
    error[np.arange(n), group] -= 1
    out["group"], out["group_bias"] = hidden.T @ error / n, error.sum(axis=0) / n
    back = error @ net["group"].T
    for g, own in _by_group(group, groups):
        error = np.exp(_log_softmax(hidden[own] @ net["word"][g] + net["word_bias"][g]))
        error[np.arange(len(own)), member[own]] -= 1
        out["word"][g], out["word_bias"][g] = hidden[own].T @ error / n, error.sum(axis=0) / n
        back[own] += error @ net["word"][g].T
    back *= (1 - hidden**2) / n
    out["hidden"] = back.sum(axis=0)
    for k in range(len(CONTEXT)):
        order = np.argsort(around[k], kind="stable")
        held, begin = np.unique(around[k][order], return_index=True)
        out["embed"][k][held] = np.add.reduceat(back[order], begin, axis=0)
    return out


def step(net: Network, squares: Network, ids: np.ndarray, around: np.ndarray) -> None:
    """One Adagrad step in place."""
    for name, gradient in gradients(net, ids, around).items():
        squares[name] += gradient**2
        net[name] -= RATE * gradient / (np.sqrt(squares[name]) + DAMPING)


def word_ids(hashed: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Places in the sorted vocabulary counted from 1; 0 for other words."""
    if len(vocabulary) == 0:
        return np.zeros(len(hashed), np.int64)
    place = np.minimum(np.searchsorted(vocabulary, hashed), len(vocabulary) - 1)
    return np.where(vocabulary[place] == hashed, place + 1, 0)


def word_counts(docs: DataFrame) -> DataFrame:
    """word (hash), n: how often each word occurs in all texts.

    Words are counted in every slice of a partition, then in Spark: a common word is one row per slice.
    """
    return docs.select("text").mapInArrow(_slice_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _slice_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each slice; its words are cut and hashed a small part at a time, whose arrays are many times its text."""
    for batch in slices(batches, limit=16 << 20):
        hashed = [hash_words(split_words(part.column("text"))) for part in slices(iter([batch]), limit=1 << 20)]
        word, n = np.unique(np.concatenate(hashed), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])


def frequent_words(docs: DataFrame, size: int) -> np.ndarray:
    """Hashes, in ascending order, of the ``size`` most frequent words of all texts."""
    return _most(word_counts(docs), size)


def _most(counts: DataFrame, size: int) -> np.ndarray:
    top = counts.orderBy(F.desc("n"), "word").limit(size).collect()
    return np.sort(np.array([row["word"] for row in top], np.int64).view(np.uint64))


def at_frequencies(counts: DataFrame, vocabulary: np.ndarray) -> tuple[Network, int]:
    """A network whose biases give each word its share of the corpus, and the corpus's number of words."""
    net = initial()
    held = dict(counts.filter(F.col("word").isin(vocabulary.view(np.int64).tolist())).collect())  # the vocabulary's
    words = counts.agg(F.sum("n")).first()[0] or 0
    n = np.array([0, *[held.get(int(w), 0) for w in vocabulary.view(np.int64)]], np.float64)
    n[0] = words - n.sum()
    each = np.full(GROUPS * PER_GROUP, 0.5)  # places without a word, and words that do not occur
    each[: len(n)] += n
    each = each.reshape(GROUPS, PER_GROUP)
    net["group_bias"] = np.log(each.sum(axis=1)).astype(np.float32)
    net["word_bias"] = np.log(each).astype(np.float32)
    return net, words


def _pack(net: Network) -> np.ndarray:
    return np.concatenate([value.reshape(-1) for value in net.values()]).astype(np.float32)


def _unpack(flat: np.ndarray, like: Network) -> Network:
    bounds = np.cumsum([value.size for value in like.values()])[:-1]
    return {name: part.reshape(value.shape).astype(np.float32) for (name, value), part in zip(like.items(), np.split(flat, bounds), strict=True)}


def _chunks(flat: np.ndarray, seen: int, salt: int) -> pa.RecordBatch:
    cut = [flat[begin : begin + CHUNK].tobytes() for begin in range(0, len(flat), CHUNK)]
    return pa.RecordBatch.from_pydict(
        {"chunk": pa.array(range(len(cut)), pa.int32()), "salt": pa.array([salt] * len(cut), pa.int32()), "seen": pa.array([seen] * len(cut), pa.int64()), "part": pa.array(cut, pa.binary())}
    )


_CHUNK_SCHEMA = "chunk int, salt int, seen long, part binary"


def _mean_of_chunks(table: pa.Table) -> pa.Table:
    """One row in place of those of a chunk, the mean weighted by words; its salt goes down a level."""
    total = 0.0
    seen = table.column("seen").to_numpy()
    for part, n in zip(table.column("part"), seen, strict=True):
        total = total + np.frombuffer(part.as_buffer(), np.float32).astype(np.float64) * n
    mean = (total / seen.sum()).astype(np.float32).tobytes()
    return pa.table(
        {"chunk": table.column("chunk")[:1], "salt": pa.array([table.column("salt")[0].as_py() // FAN_IN], pa.int32()), "seen": pa.array([int(seen.sum())]), "part": pa.array([mean], pa.binary())}
    )


def averaged(parts: DataFrame, tasks: int) -> np.ndarray | None:
    """The mean over all tasks, in a tree that never brings together more than ``FAN_IN`` rows of a chunk."""
    while True:
        parts = parts.groupBy("chunk", "salt").applyInArrow(_mean_of_chunks, _CHUNK_SCHEMA)
        tasks = -(-tasks // FAN_IN)
        if tasks <= 1:
            break
    rows = sorted(parts.collect(), key=lambda row: row["chunk"])
    return np.concatenate([np.frombuffer(row["part"], np.float32) for row in rows]) if rows else None


def train(docs: DataFrame, vocabulary: np.ndarray, start: Network | None = None, rounds: int = ROUNDS, counts: DataFrame | None = None) -> Network:
    """The network after every text has been learnt once, in ``rounds`` rounds that begin at the mean of the last.

    ``counts`` as of ``word_counts``, counted here where they are not given; ``start`` defaults to their
    frequencies. Only the mean, whose size is the network's, reaches the driver.
    """
    at_start, words = at_frequencies(word_counts(docs) if counts is None else counts, vocabulary)
    net = start or at_start
    squares = {name: np.zeros_like(value) for name, value in net.items()}
    context = docs.sparkSession.sparkContext
    turn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds))
    tasks = max(1, int(words) // (rounds * BLOCK))
    for number in range(rounds):
        sent = context.broadcast((net, squares, vocabulary))

        def one_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            given, sums, known = sent.value  # noqa: B023  collected before the next round
            total, seen, block = None, 0, 0
            fresh = lambda like: {name: value.copy() for name, value in like.items()}
            own, own_squares = fresh(given), fresh(sums)
            task = TaskContext.get().partitionId()

            def close() -> None:
                nonlocal total, seen, block, own, own_squares
                if block:
                    flat = np.concatenate([_pack(own), _pack(own_squares)]).astype(np.float64) * block
                    total, seen, block = flat if total is None else total + flat, seen + block, 0
                    own, own_squares = fresh(given), fresh(sums)

            for batch in slices(batches, limit=1 << 20):
                split = split_words(batch.column("text"))
                ids = word_ids(hash_words(split), known)
                around = contexts(ids, split.first, own["embed"].shape[1] - 1)
                for begin in range(0, len(ids), BATCH):
                    part = slice(begin, begin + BATCH)
                    step(own, own_squares, ids[part], around[:, part])
                    block += len(ids[part])
                    if block >= BLOCK:
                        close()
            close()
            if seen:
                yield _chunks((total / seen).astype(np.float32), seen, task // FAN_IN)

        texts = docs.filter(turn == number).select("text").coalesce(tasks)
        flat = averaged(texts.mapInArrow(one_round, _CHUNK_SCHEMA), tasks)
        sent.unpersist()
        if flat is not None:
            net, squares = (_unpack(half, net) for half in np.split(flat, 2))
    return net


def _other_words(owner: np.ndarray, hashed: np.ndarray, texts: int) -> tuple[pa.Array, pa.Array]:
    """Per text the distinct hashes and how often each occurs."""
    order = np.lexsort((hashed, owner))
    owner, hashed = owner[order], hashed[order]
    fresh = np.flatnonzero(np.append(True, (hashed[1:] != hashed[:-1]) | (owner[1:] != owner[:-1]))[: len(hashed)])
    times = np.diff(np.append(fresh, len(hashed)))
    bounds = pa.array(np.searchsorted(owner[fresh], np.arange(texts + 1)), pa.int32())
    return (
        pa.ListArray.from_arrays(bounds, pa.array(hashed[fresh].view(np.int64))),
        pa.ListArray.from_arrays(bounds, pa.array(times, pa.int32())),
    )


def score(docs: DataFrame, vocabulary: np.ndarray, net: Network, counts: DataFrame | None = None) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (sum) and mean_log_likelihood (null without words) of whole texts.

    With ``counts`` (word, n), a word outside the vocabulary has the probability of their class times its share of
    the class's words; words that ``counts`` lacks share, evenly over all hashes, what one more occurrence of each
    counted word would have. Without, they are one symbol. One row per row of ``docs``; a null text is empty, its
    sum is zero. Other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast((net, vocabulary))
    divided = counts is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = sent.value
        for batch in slices(batches, limit=2 << 20):
            split = split_words(batch.column("text"))
            hashed, owner = hash_words(split), split.owner()
            ids = word_ids(hashed, words)
            found = log_probabilities(held, ids, contexts(ids, split.first, held["embed"].shape[1] - 1))
            total = np.bincount(owner, found, batch.num_rows)
            out = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(split.per_text().astype(np.int64)), "log_likelihood": pa.array(total)}
            if divided:
                out["words"], out["times"] = _other_words(owner[ids == 0], hashed[ids == 0], batch.num_rows)
            yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, n_tokens long, log_likelihood double" + ", words array<long>, times array<int>" * divided
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
    if divided:
        scored = _with_shares(scored, vocabulary, counts)
    return scored.withColumn("mean_log_likelihood", F.col("log_likelihood") / F.nullif(F.col("n_tokens"), F.lit(0)))


def _with_shares(scored: DataFrame, vocabulary: np.ndarray, counts: DataFrame) -> DataFrame:
    """Adds the log of each other word's share of its class; only the class's two totals pass the driver."""
    others = counts.filter(~F.col("word").isin(vocabulary.view(np.int64).tolist()))
    total = others.agg(F.sum("n").alias("n"), F.count("*").alias("distinct")).first()
    n, distinct = total["n"] or 0, total["distinct"]
    unseen = (np.log(distinct / (n + distinct)) if n else 0.0) - 64 * np.log(2)
    share = F.coalesce(F.log(F.col("n") / F.lit(n + distinct)), F.lit(float(unseen)))
    rows = stored(scored.withColumn("row", F.monotonically_increasing_id()))
    each = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("of")).select("row", "of.words", "of.times")
    met = each.withColumnRenamed("words", "word").join(others, "word", "left")
    shares = met.groupBy("row").agg(F.sum(F.col("times") * share).alias("share"))
    whole = F.col("log_likelihood") + F.coalesce("share", F.lit(0.0))
    return rows.join(shares, "row", "left").select("doc_id", "n_tokens", whole.alias("log_likelihood"))


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """Counts, vocabulary and network from all of ``docs``, then the score of each; an empty table gives no rows."""
    counts = stored(word_counts(docs))
    vocabulary = _most(counts, GROUPS * PER_GROUP - 1)
    return score(docs, vocabulary, train(docs, vocabulary, counts=counts), counts)
