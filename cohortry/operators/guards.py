"""Guards on metric series, and the findings that survive them.

Series and cells are mart-sized: (window, cohort, value) and (window, cohort, segment, value, n).
All cohorts of all windows are judged in one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortry.functions.rounding import round_rate
from cohortry.functions.text import SHOWN, with_display_text

MIN_N = 50
MATERIAL_DELTA = 0.02
MATERIAL_SPREAD = 1.5
SPREAD_LENGTH = 3
GAP_LIMIT = 0.05
SHORT_HISTORY_NOTE = "fewer than three earlier changes: judged by size alone"

BLENDED, SEGMENT = "blended_delta", "segment_delta"


def observed_gate(cohorts: DataFrame, flags: DataFrame) -> DataFrame:
    """Adds ``is_observed``; a cohort without a flag counts as not observed.

    ``flags`` holds (window, cohort, fully_observed).
    """
    known = flags.select("window", "cohort", F.col("fully_observed").alias("_flag"))
    return cohorts.join(known, ["window", "cohort"], "left").select(
        *cohorts.columns, F.coalesce("_flag", F.lit(False)).alias("is_observed")
    )


def split_min_n(cells: DataFrame, min_n: int = MIN_N) -> tuple[DataFrame, DataFrame]:
    """Cells large enough to show, and records of the others without their value."""
    kept = cells.filter(F.col("n") >= min_n)
    small = cells.filter(F.col("n") < min_n)
    return kept, small.select("window", "cohort", F.lit("min_n").alias("reason"), "segment", "n")


def consecutive_deltas(series: DataFrame) -> DataFrame:
    """Change against the previous cohort that is present, rounded to six decimals."""
    order = W.partitionBy("window").orderBy("cohort")
    return (
        series.withColumns(
            {"prior_cohort": F.lag("cohort").over(order), "prior_value": F.lag("value").over(order)}
        )
        .filter(F.col("prior_cohort").isNotNull())
        .withColumn("delta", round_rate("(value - prior_value)"))
    )


def _verdict(delta: Column, spread: Column, enough: Column) -> list[Column]:
    size = F.abs(delta)
    limit = F.when(enough, spread * MATERIAL_SPREAD)
    large = size >= MATERIAL_DELTA
    return [
        F.when(enough, large & (size > limit)).otherwise(large).alias("material"),
        size.alias("abs_delta"),
        F.lit(MATERIAL_DELTA).alias("threshold_abs"),
        F.when(enough, spread).alias("sd"),
        limit.alias("threshold_sd"),
        (~enough).alias("insufficient_history"),
        F.when(~enough, F.lit(SHORT_HISTORY_NOTE)).alias("note"),
    ]


def assess_materiality(deltas: DataFrame) -> DataFrame:
    """Large enough, and outside the usual spread of the three changes before it."""
    before = W.partitionBy("window").orderBy("cohort").rowsBetween(-SPREAD_LENGTH, -1)
    measured = deltas.withColumns(
        {"_spread": F.stddev_samp("delta").over(before), "_earlier": F.count("delta").over(before)}
    )
    enough = F.col("_earlier") >= SPREAD_LENGTH
    return measured.select(*deltas.columns, *_verdict(F.col("delta"), F.col("_spread"), enough))


def assess_by_size(deltas: DataFrame) -> DataFrame:
    """The rule for changes without a history."""
    return deltas.select("*", *_verdict(F.col("delta"), F.lit(None).cast("double"), F.lit(False)))


def latest_targets(series: DataFrame) -> DataFrame:
    """Per window the last cohort of the series and the one before it; none if there is only one."""
    newest = W.partitionBy("window").orderBy(F.desc("cohort"))
    return (
        series.select(
            "window",
            "cohort",
            F.lead("cohort").over(newest).alias("prior_cohort"),
            F.row_number().over(newest).alias("_place"),
        )
        .filter((F.col("_place") == 1) & F.col("prior_cohort").isNotNull())
        .drop("_place")
    )


def all_targets(cohorts: DataFrame) -> DataFrame:
    """Every cohort with its predecessor (NULL for the first)."""
    order = W.partitionBy("window").orderBy("cohort")
    return cohorts.select("window", "cohort", F.lag("cohort").over(order).alias("prior_cohort"))


def segment_deltas(cells: DataFrame, targets: DataFrame, min_n: int = MIN_N) -> DataFrame:
    """Change per segment where target and prior cohort both keep it."""
    kept, _ = split_min_n(cells, min_n)
    prior = kept.select(
        "window", F.col("cohort").alias("prior_cohort"), "segment", F.col("value").alias("prior_value")
    )
    return (
        targets.join(kept, ["window", "cohort"])
        .join(prior, ["window", "prior_cohort", "segment"])
        .withColumn("delta", round_rate("(value - prior_value)"))
    )


def findings(
    series: DataFrame, cells: DataFrame, targets: DataFrame, metric: str = "adoption_rate", min_n: int = MIN_N
) -> DataFrame:
    """All findings of the targets, material or not: one blended change, and one per kept segment."""
    wanted = targets.select("window", "cohort")
    blended = assess_materiality(consecutive_deltas(series)).join(wanted, ["window", "cohort"], "left_semi")
    by_segment = assess_by_size(segment_deltas(cells, targets, min_n))
    columns = [
        "kind", "metric", "window", "segment", "cohort", "prior_cohort", "value", "prior_value", "n", "delta",
        "material", "abs_delta", "threshold_abs", "sd", "threshold_sd", "insufficient_history", "note",
    ]
    blended = blended.withColumns(
        {"kind": F.lit(BLENDED), "segment": F.lit(None).cast("string"), "n": F.lit(None).cast("bigint")}
    )
    by_segment = by_segment.withColumn("kind", F.lit(SEGMENT))
    named = [part.withColumn("metric", F.lit(metric)).select(columns) for part in (blended, by_segment)]
    return named[0].unionByName(named[1])


def suppressions(cells: DataFrame, targets: DataFrame, min_n: int = MIN_N) -> DataFrame:
    """Small cells behind each target: ``side`` 0 its own, 1 those of the prior cohort."""
    _, small = split_min_n(cells, min_n)
    sides = targets.select(
        "window", "cohort", F.posexplode(F.array("cohort", "prior_cohort")).alias("side", "cell_cohort")
    )
    small = small.withColumnRenamed("cohort", "cell_cohort")
    return sides.join(small, ["window", "cell_cohort"]).select(
        "window", "cohort", "side", "reason", "segment", "n"
    )


def critique(
    series: DataFrame,
    cells: DataFrame,
    targets: DataFrame,
    flags: DataFrame | None = None,
    metric: str = "adoption_rate",
    min_n: int = MIN_N,
) -> DataFrame:
    """One record per target: findings, suppressed records, notes and whether the gate passed.

    A target that is not fully observed keeps nothing but the reason. Without ``flags`` the
    cohorts of the series are the observed ones. A record gathers at most two entries per segment.
    Findings carry their figures as display text too.
    """
    if flags is None:
        flags = series.select("window", "cohort", F.lit(True).alias("fully_observed"))
    gated = observed_gate(targets, flags)
    passed = gated.filter("is_observed").select("window", "cohort", "prior_cohort")

    found = with_display_text(findings(series, cells, passed, metric, min_n))
    verdict = F.struct(
        "material", "abs_delta", "threshold_abs", "sd", "threshold_sd", "insufficient_history", "note"
    ).alias("materiality")
    finding = F.struct(
        "kind", "metric", "window", "segment", "cohort", "prior_cohort", "value", "prior_value", "n", "delta",
        "material", verdict, *SHOWN,
    )
    # blended first, then segments by name
    ranked = F.struct((F.col("kind") == SEGMENT).alias("rank"), F.col("segment").alias("name"), finding.alias("f"))
    grouped_findings = found.groupBy("window", "cohort").agg(
        F.transform(F.array_sort(F.collect_list(ranked)), lambda r: r["f"]).alias("findings"),
        F.array_compact(F.collect_list(F.when(F.col("kind") == BLENDED, F.col("note")))).alias("notes"),
    )

    record = F.struct("reason", "segment", "n", F.lit(None).cast("string").alias("cohort"))
    placed = F.struct("side", F.col("segment").alias("name"), record.alias("s"))
    grouped_small = suppressions(cells, passed, min_n).groupBy("window", "cohort").agg(
        F.transform(F.array_sort(F.collect_list(placed)), lambda r: r["s"]).alias("small")
    )
    censored = F.array(
        F.struct(
            F.lit("right_censored").alias("reason"),
            F.lit(None).cast("string").alias("segment"),
            F.lit(None).cast("bigint").alias("n"),
            F.col("cohort"),
        )
    )
    joined = gated.join(grouped_findings, ["window", "cohort"], "left").join(
        grouped_small, ["window", "cohort"], "left"
    )
    return joined.select(
        F.col("cohort").alias("cohort_month"),
        "window",
        F.coalesce("findings", F.array()).alias("findings"),
        F.when(~F.col("is_observed"), censored).otherwise(F.coalesce("small", F.array())).alias("suppressed"),
        F.coalesce("notes", F.array()).alias("notes"),
        F.col("is_observed").alias("critic_passed"),
    )


def panel_gap_warnings(cohort_adoption: DataFrame, limit: float = GAP_LIMIT) -> DataFrame:
    """Cells whose share of customers with missing snapshots makes their timing unreliable."""
    return cohort_adoption.filter(F.col("share_with_panel_gaps") > limit).select(
        "acq_month", "segmento", "cohort_size", "share_with_panel_gaps"
    )
