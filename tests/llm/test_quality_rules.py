import re

import pytest
from pyspark.sql import functions as F

from cohortry.llm import quality_rules
from cohortry.llm.queries import op2_quality_rules
from tests.llm.conftest import ODD


def brute(doc_id, text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeated = {j for places in windows.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    n = len(words)
    return (doc_id, n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), n < 20 or 100 * len(repeated) > 30 * n)


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_all_documents_and_labels(spark):
    folder = "/root/testdata/sf0.01"
    rows = op2_quality_rules(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in rows) == sorted(brute(d.doc_id, d.text) for d in docs)
    kept = {r.doc_id: r.kept for r in rows if not r.base_failed}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    good = [kept[d] for d, q in labels.items() if q == 1 and d in kept]
    bad = [kept[d] for d, q in labels.items() if q == 0 and d in kept]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.3 * len(bad)
    assert all(r.kept == (not r.base_failed and r.rule is None) for r in rows)


REPEATS = [
    (30, "a b c d e f g h " * 3), (31, "a b c d e f g h i a b c d e f g h"), (32, " ".join(["x"] * 40)),
    (33, "same line here\nsame line here\n\n \n\nother # line\nsame line here"), (34, "p q r s t u v w x y " * 2 + "z " * 30),
]


def test_odd_texts_and_repeated_rows(spark, table):
    rows = [*ODD, *REPEATS, (4, "one"), (None, "no key " * 30)]
    labels = spark.createDataFrame([(1, 0), (11, 1), (None, 0), (12, None)], "doc_id long, quality int")
    got = quality_rules.apply_rules(table(rows), labels).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=str) == sorted((brute(d, t) for d, t in rows), key=str)
    assert quality_rules.apply_rules(table([]), labels).collect() == []


@pytest.fixture(scope="module")
def planted(spark):
    """Bad rows: a high share of symbols, or long words among few distinct ones; a few wrong labels."""
    rows = spark.range(4000).select(
        F.col("id").alias("doc_id"), *[(F.abs(F.xxhash64("id", F.lit(f))) % 1000 / 1000).alias(f) for f in quality_rules.FEATURES]
    )
    rows = rows.withColumn("word_length", F.col("word_length") * 10 + 2).withColumn("n_words", F.lit(100))
    bad = (F.col("symbol_share") > quality_rules.FEATURES["symbol_share"][24]) | ((F.col("word_length") > 8) & (F.col("distinct_share") <= 0.3))
    return rows.withColumn("bad", bad != (F.col("doc_id") % 400 == 7))


def test_planted_rules_are_found(planted):
    rules = quality_rules.learn_rules(planted)
    got = planted.select("bad", quality_rules.verdict(rules).isNotNull().alias("said")).collect()
    assert sum(r.bad == r.said for r in got) >= 0.98 * len(got)
    assert {c.feature for rule in rules for c in rule} >= {"symbol_share", "word_length", "distinct_share"}
    assert rules == quality_rules.learn_rules(planted.repartition(7))


def test_no_rule_without_both_kinds(planted):
    assert quality_rules.learn_rules(planted.filter("bad")) == []
    assert quality_rules.learn_rules(planted.limit(0)) == []


def test_rules_are_one_expression(planted):
    plan = planted.select(quality_rules.verdict(quality_rules.learn_rules(planted)).alias("rule"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Exchange" not in text
