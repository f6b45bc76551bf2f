"""Quality rules: text statistics in Spark expressions, and a decision list learnt from labelled ones.

The list is learnt by sequential covering. A rule grows condition by condition on two thirds of the labelled
rows, each time the threshold with the largest information gain; it is pruned on the other third to the
prefix with the best precision, and kept if that is high enough. Rows it covers leave, and the next rule
begins. Every count is a Spark aggregate over the labelled rows; the driver sees a histogram per feature.
The result is an ordered CASE expression, which scores all documents in the scan that computes them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.storage import stored

SPACE = r"[\x20\x09-\x0D]"
REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

MAX_RULES = 12
MAX_CONDITIONS = 4
MIN_PRECISION = 0.9
MIN_COVERED = 5

_SHARES = [0.002 * 1.25**k for k in range(28)]
_COUNTS = [float(2**k) for k in range(15)]
# features and the thresholds that conditions may take
FEATURES: dict[str, list[float]] = {
    "n_words": _COUNTS,
    "word_length": [2 + 0.25 * k for k in range(41)],
    "symbol_share": _SHARES,
    "upper_share": _SHARES,
    "digit_share": _SHARES,
    "shout_share": _SHARES,
    "repeat_share": _SHARES,
    "dup_line_share": _SHARES,
    "distinct_share": [0.025 * k for k in range(1, 40)],
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # larger than the threshold, or else at most
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and further counts of whole texts.

    A null text has no words and all its counts are zero; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    blank = F.regexp_count("body", F.lit(SPACE))
    counts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("body")).select(
        "doc_id",
        (F.char_length("body") - blank).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("body", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("body", F.lit(r"[0-9]")).cast("long").alias("n_digits"),
        F.regexp_count("body", F.lit(r"[!?]")).cast("long").alias("n_shouts"),
        F.filter(F.split("body", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.array_remove(F.split("body", f"{SPACE}+"), "").alias("words"),
    )
    n_words, n_lines = F.size("words").cast("long"), F.size("lines").cast("long")
    windows = F.when(
        F.size("words") >= REPEAT_WINDOW,
        F.transform(
            F.sequence(F.lit(1), F.size("words") - REPEAT_WINDOW + 1),
            lambda i: F.xxhash64(F.slice("words", i, F.lit(REPEAT_WINDOW))),
        ),
    )
    held = counts.select(
        "doc_id", n_words.alias("n_words"), "word_chars", "n_symbols", "n_upper", "n_digits", "n_shouts",
        n_lines.alias("n_lines"), (n_lines - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"), windows.alias("windows"),
    )
    # only texts that repeat a window have their windows sorted
    repeats = F.col("windows").isNotNull() & (F.size(F.array_distinct("windows")) < F.size("windows"))
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("hash"), i.alias("place"))))
    ordered = held.withColumn("ordered", F.when(repeats, placed)).drop("windows")
    n = F.size("ordered")
    nothing = F.array(F.lit(None).cast("long"))
    hashes = F.col("ordered.hash")
    beside = ordered.withColumn(
        "beside",
        F.when(
            F.col("ordered").isNotNull(),
            F.arrays_zip(
                F.col("ordered.place").alias("place"), hashes.alias("own"),
                F.concat(nothing, F.slice(hashes, F.lit(1), n - 1)).alias("before"), F.concat(F.slice(hashes, F.lit(2), n - 1), nothing).alias("after"),
            ),
        ),
    ).drop("ordered")
    twice = F.filter("beside", lambda w: w["own"].eqNullSafe(w["before"]) | w["own"].eqNullSafe(w["after"]))
    starts = beside.withColumn("starts", F.sort_array(F.transform(twice, lambda w: w["place"]))).drop("beside")
    # each start covers the words up to the next start, at most a window
    gaps = F.zip_with(
        F.slice("starts", F.lit(2), F.size("starts") - 1), F.slice("starts", F.lit(1), F.size("starts") - 1),
        lambda later, earlier: F.least(later - earlier, F.lit(REPEAT_WINDOW)),
    )
    covered = F.when(F.size("starts") > 0, F.aggregate(gaps, F.lit(REPEAT_WINDOW), lambda total, gap: total + gap))
    return starts.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("starts")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def with_features(counts: DataFrame) -> DataFrame:
    """The counts and the features that rules may use; shares of nothing are zero."""
    share = lambda part, whole: F.coalesce(F.col(part) / F.nullif(F.col(whole), F.lit(0)), F.lit(0.0))
    return counts.withColumns(
        {
            "word_length": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "word_chars"),
            "upper_share": share("n_upper", "word_chars"), "digit_share": share("n_digits", "word_chars"),
            "shout_share": share("n_shouts", "n_words"), "repeat_share": share("n_repeat_words", "n_words"),
            "dup_line_share": share("n_dup_lines", "n_lines"), "distinct_share": share("n_distinct", "n_words"),
        }
    )


def _counting(value: Column):
    return lambda n, cut: n + (value > cut).cast("int")


def _bins(labelled: DataFrame) -> DataFrame:
    """bad, grow, bins: per feature how many of its thresholds lie below the row's value."""
    below = [
        F.aggregate(F.array(*map(F.lit, cuts)), F.lit(0), _counting(F.col(feature)))
        for feature, cuts in FEATURES.items()
    ]
    grow = F.pmod(F.xxhash64("doc_id", F.lit("grow")), F.lit(3)) > 0
    return stored(labelled.select("bad", grow.alias("grow"), F.array(*below).alias("bins")))


def _covered(conditions: list[tuple[int, bool, int]]) -> Column:
    """Conditions as (feature number, above, threshold number) on binned rows."""
    tests = [F.get("bins", F.lit(f)) > k if above else F.get("bins", F.lit(f)) <= k for f, above, k in conditions]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _best_condition(rows: DataFrame) -> tuple[int, bool, int] | None:
    """The condition with the largest information gain for bad rows, from one histogram per feature."""
    histogram = rows.select("bad", F.posexplode("bins").alias("feature", "bin")).groupBy("feature", "bin")
    counts = histogram.agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")).collect()
    sizes = list(map(len, FEATURES.values()))
    bad, good = ([[0] * (n + 1) for n in sizes] for _ in range(2))
    for row in counts:
        bad[row["feature"]][row["bin"]], good[row["feature"]][row["bin"]] = row["bad"], row["good"]
    all_bad, all_good = sum(bad[0]), sum(good[0])
    if not all_bad or not all_good:
        return None
    start, best = math.log2(all_bad / (all_bad + all_good)), (0.0, None)
    for feature, n in enumerate(sizes):
        low_bad = low_good = 0
        for k in range(n):
            low_bad, low_good = low_bad + bad[feature][k], low_good + good[feature][k]
            for above, p, q in ((False, low_bad, low_good), (True, all_bad - low_bad, all_good - low_good)):
                gain = p * (math.log2(p / (p + q)) - start) if p else 0.0
                if gain > best[0] + 1e-9:
                    best = (gain, (feature, above, k))
    return best[1]


def learn_rules(labelled: DataFrame) -> list[Rule]:
    """Ordered rules for bad rows, from a table with the feature columns, doc_id and a boolean ``bad``.

    Without bad rows, or good ones, there are no rules.
    """
    rows = _bins(labelled.filter("bad IS NOT NULL"))
    names, rules = list(FEATURES), []
    for _ in range(MAX_RULES):
        grown: list[tuple[int, bool, int]] = []
        while len(grown) < MAX_CONDITIONS:
            found = _best_condition(rows.filter(F.col("grow") & _covered(grown)))
            if found is None:
                break
            grown.append(found)
        prefixes = [grown[: k + 1] for k in range(len(grown))]
        if not prefixes:
            break
        counts = [F.count_if(_covered(p) & t).alias(f"{n}{k}") for k, p in enumerate(prefixes) for n, t in (("bad", F.col("bad")), ("good", ~F.col("bad")))]
        seen = rows.filter("NOT grow").agg(*counts).first()
        worth = [((seen[f"bad{k}"] - seen[f"good{k}"]) / max(seen[f"bad{k}"] + seen[f"good{k}"], 1), -k) for k in range(len(prefixes))]
        k = -max(worth)[1]
        bad, good = seen[f"bad{k}"], seen[f"good{k}"]
        if bad + good < MIN_COVERED or bad < MIN_PRECISION * (bad + good):
            break
        rules.append(tuple(Condition(names[f], above, FEATURES[names[f]][t]) for f, above, t in prefixes[k]))
        rows = rows.filter(~_covered(prefixes[k]))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, counted from 1; null where none does."""
    chosen = F.lit(None).cast("int")
    for number, rule in reversed(list(enumerate(rules, 1))):
        chosen = F.when(reduce(lambda a, b: a & b, [c.column() for c in rule]), F.lit(number)).otherwise(chosen)
    return chosen


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of every whole text, base_failed, rule (the first that rejects it) and kept.

    Rules are learnt from labelled documents (``quality`` 0 is bad) that pass the base conditions; labels
    without a doc_id or quality are left out, a doc_id with several labels counts with each. One row per row
    of ``docs``, repeated doc_ids included; null and empty texts fail the base.
    """
    held = with_features(stored(statistics(docs))).withColumn("base_failed", base_failed())
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 0).alias("bad"))
    rules = learn_rules(held.filter("NOT base_failed").join(marked, "doc_id"))
    return held.withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
