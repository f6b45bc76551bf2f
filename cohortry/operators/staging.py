"""Cleaning of the all-string panel: typed columns, bands, trimmed codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.calendar import parse_day, try_parse_day
from cohortry.functions.text import strip
from cohortry.spec import PanelSpec

# Upper edges (exclusive) and labels; values without an edge take the last label.
AGE_BANDS = ((18, "under_18"), (25, "18_24"), (35, "25_34"), (45, "35_44"), (55, "45_54"), (65, "55_64"))
AGE_BAND_LAST = "65_plus"
INCOME_BANDS = ((30000, "low"), (80000, "mid"), (150000, "high"))
INCOME_BAND_LAST = "very_high"
BAND_UNKNOWN = "unknown"
MISSING_TEXTS = ("NA", "")


def _parsed(text: Column, kind: str) -> Column:
    """Number in a text; missing markers and anything unreadable become NULL."""
    return F.when(~text.isin(*MISSING_TEXTS), text.try_cast(kind))


def _band(text: Column, number: Column, edges: tuple, last: str) -> Column:
    """Band of a number. Missing markers are ``unknown``; unreadable text takes the last band."""
    band = F.when(text.isNull() | text.isin(*MISSING_TEXTS), F.lit(BAND_UNKNOWN))
    for edge, label in edges:
        band = band.when(number < edge, F.lit(label))
    return band.otherwise(F.lit(last))


def clean_panel(raw: DataFrame, spec: PanelSpec) -> DataFrame:
    """One typed row per entity and snapshot. Projections only: no shuffle, filters reach the scan.

    Entity ids and snapshot dates must parse (an error otherwise); everything else degrades to NULL.
    The steps are separate projections so that each text is trimmed and parsed once.
    """
    col = {role: F.col(name) for role, name in spec.raw.items()}

    def trimmed(text: Column) -> Column:
        return strip(text, spec.white_space)

    present = raw.filter(col["entity"].isNotNull() & col["snapshot"].isNotNull())
    texts = present.select(
        col["entity"].cast("bigint").alias("customer_id"),
        parse_day(col["snapshot"]).alias("snapshot_month"),
        try_parse_day(col["acquired"]).alias("fecha_alta"),
        trimmed(col["seniority"]).alias("seniority_text"),
        col["is_new"].try_cast("bigint").alias("is_new_customer"),
        trimmed(col["age"]).alias("age_text"),
        trimmed(col["income"]).alias("income_text"),
        trimmed(col["segment"]).alias("segmento"),
        trimmed(col["channel"]).alias("canal_entrada"),
        trimmed(col["province_code"]).alias("cod_prov"),
        trimmed(col["province"]).alias("nomprov"),
        trimmed(col["country"]).alias("pais_residencia"),
        trimmed(col["resident"]).alias("indresi"),
        trimmed(col["foreign"]).alias("indext"),
        col["is_active"].try_cast("bigint").alias("is_active"),
        trimmed(col["employee"]).alias("ind_empleado"),
        trimmed(col["relation"]).alias("indrel"),
        trimmed(col["relation_type"]).alias("tiprel_1mes"),
        col["flag"].try_cast("bigint").alias("card_flag"),
        col["flag"].alias("card_flag_raw"),
    )
    numbers = texts.select(
        "*",
        _parsed(F.col("age_text"), "bigint").alias("age"),
        _parsed(F.col("income_text"), "double").alias("income"),
        _parsed(F.col("seniority_text"), "bigint").alias("seniority"),
    )
    return numbers.select(
        "customer_id",
        "snapshot_month",
        "fecha_alta",
        F.trunc("fecha_alta", "MM").alias("acq_month"),
        F.when(F.col("seniority") >= 0, F.col("seniority")).alias("seniority_months"),
        "is_new_customer",
        "age",
        _band(F.col("age_text"), F.col("age"), AGE_BANDS, AGE_BAND_LAST).alias("age_band"),
        "income",
        _band(F.col("income_text"), F.col("income"), INCOME_BANDS, INCOME_BAND_LAST).alias("income_band"),
        "segmento",
        "canal_entrada",
        "cod_prov",
        "nomprov",
        "pais_residencia",
        "indresi",
        "indext",
        "is_active",
        "ind_empleado",
        "indrel",
        "tiprel_1mes",
        "card_flag",
        "card_flag_raw",
    )
