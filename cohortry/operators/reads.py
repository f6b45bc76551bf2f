"""Reads behind the dashboards: curves, funnel, heatmap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.calendar import month_label


def curve_points(curves: DataFrame) -> DataFrame:
    """Curve cells with a cohort label, in reading order."""
    return curves.withColumn("acq_month_label", month_label(F.col("acq_month"))).orderBy("acq_month", "msa")


def filter_curves(
    points: DataFrame,
    cohorts: Sequence[str] | None = None,
    max_age: int | None = None,
    observed: bool | None = None,
) -> DataFrame:
    """Chosen cohorts and ages. ``observed`` True keeps complete cells, False the censored tails."""
    if cohorts is not None:
        points = points.filter(F.col("acq_month_label").isin(*cohorts))
    if max_age is not None:
        points = points.filter(F.col("msa") <= max_age)
    if observed is not None:
        points = points.filter(F.col("fully_observed_n") == observed)
    return points


def funnel_counts(fct_customer: DataFrame) -> DataFrame:
    """Acquired, adopted and retained customers in one row."""
    acquired = F.col("is_within_panel_cohort")
    adopted = acquired & F.col("is_adopted_clean")
    return fct_customer.agg(
        F.count_if(acquired).alias("acquired"),
        F.count_if(adopted).alias("adopted"),
        F.count_if(adopted & F.col("retained_3m")).alias("retained_3m"),
    )


def funnel_ratios(counts: DataFrame) -> DataFrame:
    """Stage ratios; NULL where a stage is empty."""
    return counts.select(
        "*",
        F.try_divide("adopted", "acquired").alias("adopted_of_acquired"),
        F.try_divide("retained_3m", "adopted").alias("retained_of_adopted"),
        F.try_divide("retained_3m", "acquired").alias("retained_of_acquired"),
    )


def heatmap_cells(cohort_adoption: DataFrame) -> DataFrame:
    """Cohort and segment cells observed for at least six months, in reading order."""
    return _observed_cells(cohort_adoption).orderBy("acq_month", "segmento")


def _observed_cells(cohort_adoption: DataFrame) -> DataFrame:
    return cohort_adoption.filter("fully_observed_6").select(
        "acq_month",
        "segmento",
        "cohort_size",
        "n_adopted",
        "adoption_rate",
        "fully_observed_6",
        "fully_observed_12",
        "n_right_censored",
        month_label(F.col("acq_month")).alias("acq_month_label"),
    )


def heatmap_pivot(cohort_adoption: DataFrame, segments: Sequence[str] | None = None) -> DataFrame:
    """One row per cohort, one column per segment.

    Naming the segments saves a pass to find them; a cell of a segment that is not named is an error.
    """
    cells = _observed_cells(cohort_adoption)
    if segments is None:
        segments = [row[0] for row in cells.select("segmento").distinct().orderBy("segmento").collect()]
    else:
        unlisted = F.raise_error(F.concat(F.lit("segment not listed: "), "segmento")).cast("string")
        cells = cells.withColumn("segmento", F.when(F.col("segmento").isin(*segments), F.col("segmento")).otherwise(unlisted))
    pivoted = cells.groupBy("acq_month_label").pivot("segmento", list(segments))
    return pivoted.agg(F.avg("adoption_rate")).orderBy("acq_month_label")
