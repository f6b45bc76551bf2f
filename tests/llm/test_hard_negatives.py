import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.llm import hard_negatives
from cohortry.llm.hard_negatives import Packing

LABEL = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"
SCHEMA = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType()),
     T.StructField("score", T.StringType()), T.StructField("anchor", T.StringType())]
)


def brute(rows, anchors=lambda v: v % 100 == 0, shift=True):
    kept = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if shift and vec_id % 7 == 0 else label
        kept.append((vec_id, [math.floor(256 * x) if math.isfinite(256 * x) else int(x) * 256 for x in vector], label))
    limit = 2**63 - 1
    score = lambda a, b: max(-limit, min(limit, sum(x * y for x, y in zip(a[1], b[1]))))  # noqa: E731, B905
    out = []
    for a in {(v, tuple(q), c) for v, q, c in kept if anchors(v)}:
        scored = sorted(((score(a, r), r) for r in kept if r[0] != a[0]), key=lambda x: (-x[0], x[1][0]))
        for p, positive in [x for x in scored if x[1][2] == a[2]][:5]:
            near = [(n, r[0]) for n, r in scored if r[2] != a[2] and 80 * p <= 100 * n <= 100 * p][:5]
            out += [(a[0], positive[0], k, vec_id, p, n) for k, (n, vec_id) in enumerate(near, 1)]
    return sorted(out)


def mined(df, **options):
    return sorted(tuple(r) for r in hard_negatives.mine(df, label=LABEL, **options).collect())


def table(spark, rows):
    return spark.createDataFrame([(v, None if e is None else [None if x is None else float(x) for x in e], c, "x", "y") for v, e, c in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("low,high,width", [(-159, 159, 64), (0, 1, 3), (-5, -1, 7), (-(2**20), 2**20, 5), (-(2**40), 2**41, 9)])
def test_packed_products_are_exact(low, high, width):
    packing = Packing(low, high, width)
    rng = random.Random(1)
    draw = lambda n: [[rng.choice([low, high, rng.randint(low, high)]) for _ in range(width)] for _ in range(n)]
    a, c = draw(4), draw(23)
    kind = object if packing.wide else np.int64
    anchors, candidates = packing.biased(np.array(a, kind)), packing.biased(np.array(c, kind))
    got = packing.scores(anchors, packing.pack(candidates), candidates)
    limit = 2**63 - 1
    assert got.tolist() == [[max(-limit, min(limit, sum(x * y for x, y in zip(u, v, strict=True)))) for v in c] for u in a]
    assert packing.fields > 1 or packing.bits > 26


def test_whole_table_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    want = brute(rows)
    assert want and mined(df) == want
    assert mined(df.repartition(7), block_numbers=128) == want  # several blocks of anchors


def test_ties_repeated_rows_and_odd_vectors(spark):
    rng = random.Random(3)
    common = [0.5, -0.25, 0.125]
    rows = [(i, common if i % 3 else [rng.uniform(-1, 1) for _ in range(3)], i % 4) for i in range(1, 700)]
    rows += [(100, [0.5, 0.5, 0.5], 1), (100, [0.5, 0.5, 0.5], 1), (200, None, 1), (300, [0.1, None, 0.2], 2), (400, [float("nan"), 0, 0], 2)]
    rows += [(500, [float("inf"), 0, 0], 3), (None, common, 1), (800, common, None), (900, [], 2), (901, [], 3), (1000, [0.5], 1), (1001, [1, 1, 1, 1], 2)]
    rows += [(1100, [-1, -1, -1], 8), (1101, [1, 1, 1], 8), (1103, [-0.5, 0, 0], 9)]
    got = mined(table(spark, rows))
    assert got == brute(rows)
    assert {r[0] for r in got} >= {100, 600}


def test_components_beyond_long(spark):
    rows = [(100, [1e30, -1e30], 1), (101, [1e30, 1.0], 1), (102, [1.0, 1.0], 1), (103, [1e30, 1e29], 2), (104, [2.0, 0.5], 2), (205, [1e307, 0.0], 2)]
    got = mined(table(spark, rows))
    assert got == brute(rows)


def test_empty_tables(spark):
    assert mined(table(spark, [])) == []
    assert mined(table(spark, [(1, [1.0], 1), (2, [1.0], 2)])) == []


def test_a_hot_vector_leaves_few_rows_per_task(spark):
    """A third of all rows are one vector; what leaves the scan is bounded by anchors, not by their number."""
    df = spark.range(30_000, numPartitions=6).select(
        F.col("id").alias("vec_id"), (F.col("id") % 10).cast("int").alias("label"),
        F.when(F.col("id") % 3 == 0, F.expr("array(1.5D, 1.5D)")).otherwise(F.array(F.sin("id"), F.cos("id"))).alias("embedding"),
    )
    got = hard_negatives.mine(df, anchors="vec_id IN (300, 600)").collect()
    assert len(got) == 50
    assert {r.positive_score for r in got} == {r.negative_score for r in got} == {2 * 384 * 384}
    assert {r.negative_id for r in got} == {3, 6, 9, 12, 15}
