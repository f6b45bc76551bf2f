import math
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from cohortry.llm import pseudo_likelihood as pl
from cohortry.llm.words import hash_words, split_words
from tests.llm.conftest import ODD


def by_hand(net, ids, groups, per_group):
    """One word at a time."""
    total = 0.0
    outside = groups * per_group
    for i, word in enumerate(ids):
        hidden = net["hidden"].astype(float).copy()
        for k, step in enumerate(pl.CONTEXT):
            j = i + step
            hidden += net["embed"][k][ids[j] if 0 <= j < len(ids) else outside]
        hidden = np.tanh(hidden)
        first = hidden @ net["group"] + net["group_bias"]
        g, m = divmod(word, per_group)
        second = hidden @ net["word"][g] + net["word_bias"][g]
        total += first[g] - math.log(np.exp(first).sum()) + second[m] - math.log(np.exp(second).sum())
    return total


def test_odd_texts_and_repeated_rows(spark, table):
    rows = [*ODD, (4, "one"), (None, "no key"), (40, "one one two one two three one two " * 5)]
    docs = table(rows)
    vocabulary = pl.frequent_words(docs, 1023)
    net = pl.train(docs, vocabulary)
    got = pl.score(docs, vocabulary, net).collect()
    place = {int(h): k + 1 for k, h in enumerate(vocabulary)}
    want = []
    for doc_id, text in rows:
        if text is not None and len(text) > 3000:
            continue
        hashed = hash_words(split_words(pa.array([text or ""])))
        ids = [place.get(int(h), 0) for h in hashed]
        want.append((doc_id, len(ids), round(by_hand(net, ids, pl.GROUPS, pl.PER_GROUP), 2)))
    short = {d for d, t in rows if t is None or len(t) <= 3000}
    assert sorted(((r.doc_id, r.n_tokens, round(r.log_likelihood, 2)) for r in got if r.doc_id in short), key=str) == sorted(want, key=str)
    assert all((r.mean_log_likelihood is None) == (r.n_tokens == 0) for r in got)
    assert pl.pseudo_likelihood(table([])).collect() == []


def test_vocabulary_counts_the_whole_corpus(documents):
    words = Counter(w for r in documents.collect() for w in r.text.encode().split())
    least = sorted(words.values(), reverse=True)[99]
    got = set(pl.frequent_words(documents, 100).tolist())
    hashed = {int(h): w for w, h in zip(words, hash_words(split_words(pa.array([b" ".join(words).decode()]))), strict=True)}
    assert len(got) == 100 and all(words[hashed[h]] >= least for h in got)


def test_a_slice_is_counted_in_a_few_times_its_bytes():
    """Counts of 12 MB of words, by numpy arrays of less than seven times as much at once (twelve before)."""
    texts = [" ".join(f"w{(i * j) % 9973:05}" for j in range(500)) for i in range(1, 3500)] + [None, ""]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    size = sum(len(t or "") for t in texts)
    tracemalloc.start()
    (got,) = pl._slice_counts(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = Counter(w for t in texts for w in (t or "").split())
    assert sorted(got.column("n").to_pylist()) == sorted(want.values())
    assert peak < 7 * size


def test_every_word_has_its_own_probability(table):
    common = " ".join(f"c{i}" for i in range(1023)) + " " + " ".join(f"c{i}" for i in range(1023))
    rows = [(1, common), (2, common), (3, common), (4, "rare seldom rare"), (5, "odd1 odd2 odd3"), (6, "rare seldom rare"), (None, "c1 odd4"), (7, None)]
    docs = table(rows)
    got = sorted((str(r.doc_id), r.n_tokens, r.log_likelihood) for r in pl.pseudo_likelihood(docs).collect())
    vocabulary = pl.frequent_words(docs, 1023)
    plain = sorted((str(r.doc_id), r.n_tokens, r.log_likelihood) for r in pl.score(docs, vocabulary, pl.train(docs, vocabulary)).collect())
    n = Counter({"rare": 4, "seldom": 2, "odd1": 1, "odd2": 1, "odd3": 1, "odd4": 1})
    texts = {str(d): t or "" for d, t in rows}
    # the classes' probabilities and the shares of ten words, six of them different
    for (doc_id, n_tokens, whole), (_, _, classes) in zip(got, plain, strict=True):
        words = texts[doc_id].split()
        assert n_tokens == len(words)
        share = sum(math.log(n[w] / 16) for w in words if w in n)
        assert abs(whole - classes - share) < 1e-2
    sums = {d: s for d, _, s in got}
    assert sums["5"] < sums["4"] - 1
    held_out = table([(1, "never"), (2, "rare")])
    net, counts = pl.initial(), pl.word_counts(docs)
    split = {r.doc_id: r.log_likelihood for r in pl.score(held_out, vocabulary, net, counts).collect()}
    assert abs(split[2] - split[1] - (math.log(4 / 6) + 64 * math.log(2))) < 1e-6


def test_gradients_are_those_of_the_loss():
    generator = np.random.default_rng(4)
    net = {k: v.astype(np.float64) for k, v in pl.initial(3, 4, 5).items()}
    ids = generator.integers(0, 12, 30)
    around = pl.contexts(ids, np.array([0, 7, 7, 30]), 12)
    found = pl.gradients(net, ids, around)
    for name, value in net.items():
        for at in generator.integers(0, value.size, 6):
            flat, losses = value.reshape(-1), []
            for change in (1e-5, -2e-5):
                flat[at] += change
                losses.append(-pl.log_probabilities(net, ids, around).mean())
            flat[at] += 1e-5
            assert abs((losses[0] - losses[1]) / 2e-5 - found[name].reshape(-1)[at]) < 1e-6


def test_training_helps_on_texts_it_has_not_seen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    seen, other = docs.filter("doc_id % 5 != 0"), docs.filter("doc_id % 5 = 0")
    vocabulary = pl.frequent_words(seen, 1023)

    def mean(net):
        total = pl.score(other, vocabulary, net).agg({"log_likelihood": "sum", "n_tokens": "sum"}).first()
        return total["sum(log_likelihood)"] / total["sum(n_tokens)"]

    trained = pl.train(seen, vocabulary)
    assert mean(trained) > mean(pl.initial()) + 2
    # neighbours tell more than frequencies alone
    alone = {k: np.zeros_like(v) if k == "embed" else v for k, v in trained.items()}
    assert mean(trained) > mean(alone) + 0.02


def test_model_does_not_depend_on_partitions_and_beats_frequencies(spark):
    """Held-out mean log-probability of a word, learnt from 1, 16 and 211 partitions."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    seen, other = docs.filter("doc_id % 5 != 0"), docs.filter("doc_id % 5 = 0").cache()
    counts = pl.word_counts(seen).cache()
    vocabulary = pl.frequent_words(seen, 1023)

    def mean(net):
        total = pl.score(other, vocabulary, net, counts).agg({"log_likelihood": "sum", "n_tokens": "sum"}).first()
        return total["sum(log_likelihood)"] / total["sum(n_tokens)"]

    start, words = pl.at_frequencies(counts, vocabulary)
    assert words == counts.agg({"n": "sum"}).first()[0]
    frequencies = mean({k: np.zeros_like(v) if k == "embed" else v for k, v in start.items()})
    learnt = [mean(pl.train(seen.repartition(n), vocabulary, counts=counts)) for n in (1, 16, 211)]
    assert min(learnt) > frequencies + 0.15
    assert max(learnt) - min(learnt) < 0.05


def test_means_of_many_tasks_and_blocks(spark, monkeypatch):
    """Of 200 tasks, over two levels; the weighted mean is that of all at once."""
    generator = np.random.default_rng(1)
    flats, seen = generator.standard_normal((200, 20000)).astype(np.float32), generator.integers(1, 9, 200)
    rows = [r for i in range(200) for r in pl._chunks(flats[i], int(seen[i]), i // pl.FAN_IN).to_pylist()]
    frame = spark.createDataFrame([(r["chunk"], r["salt"], r["seen"], bytearray(r["part"])) for r in rows], pl._CHUNK_SCHEMA)
    assert np.abs(pl.averaged(frame, 200) - np.average(flats, axis=0, weights=seen)).max() < 1e-5
    assert pl.averaged(frame.limit(0), 1) is None
