"""Vintage curves and the cohort summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.spec import PanelSpec

SEGMENT_UNKNOWN = "unknown"


def _members(fct_customer: DataFrame) -> DataFrame:
    """Customers acquired inside the panel window, segment never NULL."""
    return fct_customer.filter("is_within_panel_cohort").withColumn(
        "segmento", F.coalesce("segmento", F.lit(SEGMENT_UNKNOWN))
    )


def adoption_counts(fct_customer: DataFrame, spec: PanelSpec) -> DataFrame:
    """Customers by cohort, segment and age at adoption (NULL: not within ``max_age``).

    The only step of the curves that sees customers; everything after it is mart-sized.
    """
    adopted_at = F.when(
        F.col("is_adopted_clean") & (F.col("months_to_adoption") <= spec.max_age),
        F.greatest("months_to_adoption", F.lit(0).cast("bigint")),
    )
    keys = ["acq_month", "segmento", adopted_at.alias("adopted_at")]
    return _members(fct_customer).groupBy(*keys).agg(F.count("*").alias("n"))


def adoption_curves(fct_customer: DataFrame, spec: PanelSpec, keys: Sequence[str] = ()) -> DataFrame:
    """Cumulative adoption by cohort, optionally by ``segmento``, and age 0..max_age.

    The age spine is laid out per cell, after counting: customers are never multiplied by ages.
    Curves with and without segment start from the same counts, which Spark computes once when
    both are used.
    """
    return curves_of_counts(adoption_counts(fct_customer, spec), spec, keys)


def curves_of_counts(counts: DataFrame, spec: PanelSpec, keys: Sequence[str] = ()) -> DataFrame:
    """The curves from counted customers, see ``adoption_counts``."""
    cell = ["acq_month", *keys]
    cells = counts.groupBy(*cell).agg(
        F.sum("n").alias("n_observed"),
        F.collect_list(F.when(F.col("adopted_at").isNotNull(), F.struct("adopted_at", "n"))).alias("adopted"),
    )
    spread = cells.withColumn("msa", F.explode(F.sequence(F.lit(0), F.lit(spec.max_age))))
    reached = F.filter("adopted", lambda a: a["adopted_at"] <= F.col("msa"))
    as_of = F.expr("add_months(acq_month, msa)")
    counted = spread.select(
        *cell,
        F.col("msa").cast("bigint").alias("msa"),
        as_of.alias("as_of_month"),
        "n_observed",
        F.aggregate(reached, F.lit(0).cast("bigint"), lambda total, a: total + a["n"]).alias("n_adopted_clean"),
    )
    censored = F.col("as_of_month") > F.lit(spec.panel_end)
    return counted.select(
        "*",
        F.try_divide("n_adopted_clean", "n_observed").alias("adoption_rate"),
        censored.alias("is_cell_right_censored"),
        (~censored).alias("fully_observed_n"),
    )


def cohort_adoption(fct_customer: DataFrame, spec: PanelSpec) -> DataFrame:
    """Size, adoption, timing, retention and gap share per cohort and segment."""
    clean = F.col("is_adopted_clean")
    timing = F.when(clean, F.col("months_to_adoption"))
    totals = _members(fct_customer).groupBy("acq_month", "segmento").agg(
        F.count("*").alias("cohort_size"),
        F.count_if(clean).alias("n_adopted"),
        F.count_if("is_right_censored").alias("n_right_censored"),
        F.avg(timing).alias("avg_months_to_adoption"),
        F.min(timing).alias("min_months_to_adoption"),
        F.max(timing).alias("max_months_to_adoption"),
        F.count_if("retained_1m").alias("n_retained_1m"),
        F.count_if("retained_2m").alias("n_retained_2m"),
        F.count_if("retained_3m").alias("n_retained_3m"),
        F.count_if("has_panel_gaps").alias("n_with_gaps"),
    )
    return _cohort_rates(totals, spec)


def _cohort_rates(totals: DataFrame, spec: PanelSpec) -> DataFrame:
    def observed(months: int):
        return F.add_months("acq_month", months) <= F.lit(spec.panel_end)

    return totals.select(
        "acq_month",
        "segmento",
        "cohort_size",
        "n_adopted",
        F.try_divide("n_adopted", "cohort_size").alias("adoption_rate"),
        "n_right_censored",
        observed(6).alias("fully_observed_6"),
        observed(12).alias("fully_observed_12"),
        "avg_months_to_adoption",
        "min_months_to_adoption",
        "max_months_to_adoption",
        F.try_divide("n_retained_1m", "n_adopted").alias("retention_rate_1m"),
        F.try_divide("n_retained_2m", "n_adopted").alias("retention_rate_2m"),
        F.try_divide("n_retained_3m", "n_adopted").alias("retention_rate_3m"),
        F.try_divide("n_with_gaps", "cohort_size").alias("share_with_panel_gaps"),
    )


CELL = ("acq_month", "segmento", "months_to_adoption")
CELL_COUNTS = ("n", "n_retained_1m", "n_retained_2m", "n_retained_3m", "n_with_gaps")


def cell_counts(resolved: DataFrame, *keys: str) -> DataFrame:
    """Customers of every cohort by segment and age at adoption (NULL: not adopted), with what the marts sum of them.

    Nothing in a cell depends on the panel's end, so cells of disjoint customers add up and stay right when months
    arrive: the panel window and censoring are decided by cohort, in the marts. ``keys`` are kept apart.
    """
    return resolved.groupBy(*keys, "acq_month", F.coalesce("segmento", F.lit(SEGMENT_UNKNOWN)).alias("segmento"), "months_to_adoption").agg(
        F.count("*").alias("n"),
        *[F.count_if(f"retained_{k}m").alias(f"n_retained_{k}m") for k in (1, 2, 3)],
        F.count_if("has_panel_gaps").alias("n_with_gaps"),
        F.max("last_obs_month").alias("last_obs_month"),
    )


def _cells_within(cells: DataFrame, spec: PanelSpec) -> DataFrame:
    within = cells.filter(F.col("acq_month").between(F.lit(spec.panel_start), F.lit(spec.panel_end)))
    return within.groupBy(*CELL).agg(*[F.sum(c).alias(c) for c in CELL_COUNTS])


def curves_of_cells(cells: DataFrame, spec: PanelSpec, keys: Sequence[str] = ()) -> DataFrame:
    """``adoption_curves`` from cells."""
    months = F.col("months_to_adoption")
    adopted_at = F.when(months <= spec.max_age, F.greatest(months, F.lit(0).cast("bigint")))
    counts = _cells_within(cells, spec).groupBy("acq_month", "segmento", adopted_at.alias("adopted_at")).agg(F.sum("n").alias("n"))
    return curves_of_counts(counts, spec, keys)


def cohorts_of_cells(cells: DataFrame, spec: PanelSpec) -> DataFrame:
    """``cohort_adoption`` from cells."""
    months = F.col("months_to_adoption")
    adopted = F.sum(F.when(months.isNotNull(), F.col("n")))
    late = F.col("acq_month") > F.add_months(F.lit(spec.panel_end), -spec.observe_months)
    totals = _cells_within(cells, spec).groupBy("acq_month", "segmento").agg(
        F.sum("n").alias("cohort_size"),
        F.coalesce(adopted, F.lit(0)).alias("n_adopted"),
        F.sum(F.when(late, F.col("n")).otherwise(0)).alias("n_right_censored"),
        F.try_divide(F.sum(months * F.col("n")), adopted).alias("avg_months_to_adoption"),
        F.min(months).alias("min_months_to_adoption"),
        F.max(months).alias("max_months_to_adoption"),
        *[F.sum(c).alias(c) for c in CELL_COUNTS[1:]],
    )
    return _cohort_rates(totals, spec)
