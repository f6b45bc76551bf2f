"""Adoption resolution: one row per entity out of the monthly panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.calendar import month_gap
from cohortry.spec import PanelSpec

ATTRIBUTES = ("segmento", "canal_entrada", "cod_prov", "nomprov", "income_band", "age_band")
RETENTION_MONTHS = (1, 2, 3)


def entity_profile(panel: DataFrame) -> DataFrame:
    """Panel facts per entity: cohort, span, flagged snapshots, attributes. One shuffle.

    Rows combine on the map side, so an entity holding a large share of all rows shrinks to one
    row per task before it is shuffled; its flagged snapshots are at most the panel's snapshots.
    """
    flagged = F.when(F.col("card_flag") == 1, F.col("snapshot_month"))
    return panel.groupBy("customer_id").agg(
        F.max("acq_month").alias("acq_month"),
        F.min("snapshot_month").alias("first_obs_month"),
        F.max("snapshot_month").alias("last_obs_month"),
        F.count("snapshot_month").alias("n_snapshots_observed"),
        F.min(flagged).alias("first_card_month"),
        F.collect_set(flagged).alias("flagged_months"),
        *[F.max(c).alias(c) for c in ATTRIBUTES],
        F.max("income").alias("income_max"),
        F.max("age").alias("age_max"),
    )


def _retained(adopted: Column, months: int) -> Column:
    """Flag still set exactly ``months`` later; no such snapshot counts as not retained."""
    due = F.add_months("first_card_month", months)
    return F.when(adopted, F.array_contains("flagged_months", due))


def merge_profiles(profiles: DataFrame) -> DataFrame:
    """One profile per entity from profiles of parts of its history that share no snapshot."""
    largest = ["acq_month", "last_obs_month", *ATTRIBUTES, "income_max", "age_max"]
    merged = profiles.groupBy("customer_id").agg(
        *[F.max(c).alias(c) for c in largest],
        *[F.min(c).alias(c) for c in ("first_obs_month", "first_card_month")],
        F.sum("n_snapshots_observed").alias("n_snapshots_observed"),
        # a profile per load and entity, each with at most the panel's snapshots
        F.array_distinct(F.flatten(F.collect_list("flagged_months"))).alias("flagged_months"),
    )
    return merged.select(*profiles.columns)


def resolve_adoption(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """Cohort, adoption timing, censoring, gaps and retention per entity.

    Expects one panel row per entity and snapshot (see the ``unique`` rules in the contracts).
    """
    return resolve_profiles(entity_profile(panel), spec)


def resolve_profiles(profiles: DataFrame, spec: PanelSpec, *keys: str) -> DataFrame:
    """The same from profiles. A projection: whatever depends on the panel's end is decided here. ``keys`` are kept."""
    first, acquired = F.col("first_card_month"), F.col("acq_month")
    start, end = F.lit(spec.panel_start), F.lit(spec.panel_end)
    adopted = F.coalesce(first > F.col("first_obs_month"), F.lit(False))
    span = month_gap(F.col("last_obs_month"), F.col("first_obs_month")) + 1
    return profiles.select(
        *keys,
        "customer_id",
        "acq_month",
        "first_obs_month",
        "last_obs_month",
        "n_snapshots_observed",
        (F.col("n_snapshots_observed") < span).alias("has_panel_gaps"),
        F.coalesce(acquired.between(start, end), F.lit(False)).alias("is_within_panel_cohort"),
        "first_card_month",
        # the flag was up at the first snapshot exactly when the first flagged snapshot is that one
        F.coalesce(first == F.col("first_obs_month"), F.lit(False)).alias("is_left_censored_card"),
        adopted.alias("is_adopted_observed"),
        adopted.alias("is_adopted_clean"),
        F.when(adopted, month_gap(first, acquired)).alias("months_to_adoption"),
        (acquired > F.add_months(end, -spec.observe_months)).alias("is_right_censored"),
        *[_retained(adopted, n).alias(f"retained_{n}m") for n in RETENTION_MONTHS],
        *ATTRIBUTES,
        "income_max",
        "age_max",
    )
