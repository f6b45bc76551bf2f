"""Dimensions and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.calendar import month_gap, month_key
from cohortry.functions.keys import surrogate_key

CUSTOMER_KEY_PARTS = ("segmento", "income_band", "age_band", "nomprov")
CHANNEL_UNKNOWN = "unknown"


def calendar_months(bounds: DataFrame) -> DataFrame:
    """Month calendar between two first-of-month dates, both included.

    ``bounds`` is one row (start, end): literals, or measured on a table.
    """
    month = F.col("date_month")
    months = bounds.select(F.explode(F.expr("sequence(start, end, interval 1 month)")).alias("date_month"))
    return months.select(
        month_key(month).alias("date_key"),
        month,
        F.year(month).cast("bigint").alias("year"),
        F.quarter(month).cast("bigint").alias("quarter"),
        F.month(month).cast("bigint").alias("month"),
        F.concat(F.year(month).cast("string"), F.lit("-Q"), F.quarter(month).cast("string")).alias("year_quarter"),
        F.date_format(month, "MMM-yyyy").alias("month_label"),
    )


def dim_date(panel: DataFrame) -> DataFrame:
    """Calendar over all months of a panel, those of its snapshots and those of its cohorts."""
    return calendar_months(
        panel.agg(
            F.trunc(F.least(F.min("snapshot_month"), F.min("acq_month")), "MM").alias("start"),
            F.trunc(F.greatest(F.max("snapshot_month"), F.max("acq_month")), "MM").alias("end"),
        )
    )


def dim_customer(resolved: DataFrame) -> DataFrame:
    """Attribute combinations that occur, one row each (not one row per customer)."""
    return resolved.select(*CUSTOMER_KEY_PARTS).distinct().select(
        surrogate_key(*CUSTOMER_KEY_PARTS).alias("customer_key"),
        "segmento",
        "income_band",
        "age_band",
        F.col("nomprov").alias("province"),
    )


def dim_channel(panel: DataFrame) -> DataFrame:
    """Channel codes that occur. Codes are labelled by themselves, never given a meaning."""
    code = F.col("canal_entrada")
    return panel.select(code).distinct().select(
        surrogate_key(code).alias("channel_key"),
        F.coalesce(code, F.lit(CHANNEL_UNKNOWN)).alias("channel_code"),
        F.concat(F.lit("channel_"), F.lower(F.coalesce(code, F.lit(CHANNEL_UNKNOWN)))).alias("channel_label"),
    )


def fct_customer(resolved: DataFrame) -> DataFrame:
    """Resolved entities with their dimension keys. A projection."""
    return resolved.select(
        "customer_id",
        month_key(F.col("acq_month")).alias("acq_date_key"),
        surrogate_key(*CUSTOMER_KEY_PARTS).alias("customer_key"),
        surrogate_key("canal_entrada").alias("channel_key"),
        "acq_month",
        "first_obs_month",
        "last_obs_month",
        "first_card_month",
        "is_within_panel_cohort",
        "is_left_censored_card",
        "is_adopted_observed",
        "is_adopted_clean",
        "is_right_censored",
        "has_panel_gaps",
        "months_to_adoption",
        "n_snapshots_observed",
        "retained_1m",
        "retained_2m",
        "retained_3m",
        "segmento",
        "income_band",
        "age_band",
    )


def fct_customer_month(panel: DataFrame, resolved: DataFrame) -> DataFrame:
    """The panel with its age in months and the resolved flags of its entity.

    ``acq_month`` and ``msa`` come from the panel row itself. A panel that passes its tests has at
    most one row per entity and snapshot, so no entity is hot. Should one be all the same, adaptive
    execution splits its panel rows, provided that ``resolved`` is a stored table, as in ``build``:
    a freshly aggregated one shares its shuffle with the join and cannot be replicated.
    """
    return with_month_key(customer_months(panel, resolved))


def with_month_key(months: DataFrame) -> DataFrame:
    return months.select(surrogate_key("customer_id", "snapshot_month").alias("customer_month_key"), "*")


def customer_months(panel: DataFrame, resolved: DataFrame) -> DataFrame:
    """The monthly fact but for its key, which is longer than a row's other columns together."""
    flags = resolved.select(
        "customer_id", "is_within_panel_cohort", "is_adopted_clean", "is_right_censored", "has_panel_gaps"
    )
    return panel.join(flags, "customer_id", "left").select(
        "customer_id",
        "snapshot_month",
        "acq_month",
        month_gap(F.col("snapshot_month"), F.col("acq_month")).alias("msa"),
        "card_flag",
        "segmento",
        "canal_entrada",
        "income_band",
        "age_band",
        "nomprov",
        "is_within_panel_cohort",
        "is_adopted_clean",
        "is_right_censored",
        "has_panel_gaps",
    )
