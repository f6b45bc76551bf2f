import zlib

import numpy as np
import pyarrow as pa

from cohortry.llm import quality_classifier as qc
from cohortry.llm import queries
from cohortry.llm.words import split_words
from tests.llm.conftest import ODD


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    scored = queries.op4_quality_classifier(spark, folder)
    rows = scored.filter("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    good = np.array([r.score for r in rows if r.quality == 1])
    bad = np.array([r.score for r in rows if r.quality == 0])
    # chance that a good row scores higher than a bad one
    assert (good[:, None] > bad[None, :]).mean() > 0.995
    assert (good >= 0.3).mean() > 0.99 and (bad < 0.3).mean() > 0.9
    assert all(r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_features_by_hand():
    texts = ["The the the!! x1", "", "one", "a b"]
    words = split_words(pa.array(texts))
    row, index = qc.features(words)
    assert np.bincount(row, minlength=4).tolist() == [4 + 3 + 4 + 3, 0, 1 + 1, 2 + 1 + 2 + 1]
    shape = qc.shapes(words)
    got = [bytes(shape.data[a:b]).decode() for a, b in zip(shape.begin, shape.end, strict=True)]
    assert got == ["Aa", "a", "a!", "a0", "a", "a", "a"]
    again = split_words(pa.array(["w w w"]))
    assert len(qc.features(again)[1]) == 3 + 2 + 3 + 2 + 2
    assert index.min() >= 1 and index.max() < qc.DIMENSIONS


def test_steps_follow_the_leader():
    """Against the textbook loop with one weight at a time."""
    generator = np.random.default_rng(2)
    z, n = np.zeros(50), np.zeros(50)
    own_z, own_n = [0.0] * 50, [0.0] * 50
    for _ in range(200):
        index = generator.choice(50, 6, replace=False)
        value = generator.random(6)
        label = float(generator.random() < 0.5)
        qc.learn(index, value, label, z, n)
        weight = {}
        for i in index:
            sign = int(own_z[i] > 0) - int(own_z[i] < 0)
            slow = (qc.BETA + own_n[i] ** 0.5) / qc.ALPHA + qc.L2
            weight[i] = 0.0 if abs(own_z[i]) <= qc.L1 else -(own_z[i] - sign * qc.L1) / slow
        chance = 1 / (1 + np.exp(-sum(weight[i] * v for i, v in zip(index, value, strict=True))))
        for i, v in zip(index, value, strict=True):
            g = (chance - label) * v
            own_z[i] += g - ((own_n[i] + g * g) ** 0.5 - own_n[i] ** 0.5) / qc.ALPHA * weight[i]
            own_n[i] += g * g
    assert np.allclose(z, own_z) and np.allclose(n, own_n)


def test_odd_texts_and_repeated_rows(spark, table):
    rows = [*ODD, (4, "one"), (None, "no key")]
    labels = spark.createDataFrame([(1, 0), (4, 1), (6, 1), (7, None), (None, 1), (99, 0)], "doc_id long, quality int")
    got = qc.classify(table(rows), labels).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    scores = {r.doc_id: r.score for r in got}
    assert scores[1] == scores[2] == scores[3]
    assert qc.classify(table([]), labels).collect() == []


def test_no_labels(spark, table):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in qc.classify(table(ODD[:5]), none).collect()} == {0.5}
