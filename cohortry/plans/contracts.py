"""Data tests of every table, by table name."""

from __future__ import annotations

from cohortry.operators.quality import (
    Rule,
    accepted_range,
    accepted_values,
    not_null,
    relationship,
    unique,
    unique_combination,
)
from cohortry.operators.staging import (
    AGE_BAND_LAST,
    AGE_BANDS,
    BAND_UNKNOWN,
    INCOME_BAND_LAST,
    INCOME_BANDS,
)

AGE_LABELS = [label for _, label in AGE_BANDS] + [AGE_BAND_LAST, BAND_UNKNOWN]
INCOME_LABELS = [label for _, label in INCOME_BANDS] + [INCOME_BAND_LAST, BAND_UNKNOWN]
CURVE_COLUMNS = (
    "msa", "as_of_month", "n_observed", "n_adopted_clean", "adoption_rate", "is_cell_right_censored", "fully_observed_n",
)

CONTRACTS: dict[str, list[Rule]] = {
    "stg_customer_month": [
        *not_null("customer_id", "snapshot_month", "card_flag"),
        accepted_values("age_band", *AGE_LABELS),
        accepted_values("income_band", *INCOME_LABELS),
        accepted_values("card_flag", 0, 1),
        # resolution counts on it
        unique_combination("customer_id", "snapshot_month"),
    ],
    "dim_date": [*not_null("date_key", "date_month"), unique("date_key")],
    "dim_customer": [*not_null("customer_key"), unique("customer_key")],
    "dim_channel": [*not_null("channel_key"), unique("channel_key")],
    "fct_customer": [
        *not_null(
            "customer_id", "customer_key", "channel_key", "is_within_panel_cohort", "is_left_censored_card",
            "is_adopted_observed", "is_adopted_clean", "has_panel_gaps",
        ),
        unique("customer_id"),
        relationship("customer_key", "dim_customer", "customer_key"),
        relationship("channel_key", "dim_channel", "channel_key"),
        relationship("acq_date_key", "dim_date", "date_key"),
    ],
    "fct_customer_month": [
        *not_null(
            "customer_month_key", "customer_id", "snapshot_month", "card_flag", "is_within_panel_cohort",
            "is_adopted_clean", "has_panel_gaps",
        ),
        unique("customer_month_key"),
        accepted_values("card_flag", 0, 1),
        relationship("customer_id", "fct_customer", "customer_id"),
    ],
    "mart_adoption_curves": [
        *not_null("acq_month", *CURVE_COLUMNS),
        accepted_range("adoption_rate"),
        unique_combination("acq_month", "msa"),
    ],
    "mart_adoption_curves_by_segment": [
        *not_null("acq_month", "segmento", *CURVE_COLUMNS),
        accepted_range("adoption_rate"),
        unique_combination("acq_month", "segmento", "msa"),
    ],
    "mart_cohort_adoption": [
        *not_null(
            "acq_month", "segmento", "cohort_size", "n_adopted", "adoption_rate", "n_right_censored",
            "fully_observed_6", "fully_observed_12",
        ),
        *[
            accepted_range(c)
            for c in (
                "adoption_rate", "retention_rate_1m", "retention_rate_2m", "retention_rate_3m", "share_with_panel_gaps",
            )
        ],
        unique_combination("acq_month", "segmento"),
    ],
}
