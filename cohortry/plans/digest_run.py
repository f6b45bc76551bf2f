"""From marts to checked digest rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.functions.calendar import month_label
from cohortry.operators import digest, guards
from cohortry.operators.metrics import AGE_WINDOWS, Marts
from cohortry.sources.tables import settle
from cohortry.spec import Window


def _at_windows(curves: DataFrame, windows: Sequence[Window]) -> DataFrame:
    """Curve cells at the ages of the windows, one scan for all of them."""
    return curves.filter(F.col("msa").isin([w.age for w in windows])).select(
        F.concat(F.lit("msa_"), F.col("msa").cast("string")).alias("window"),
        month_label(F.col("acq_month")).alias("cohort"),
        "*",
    )


def rate_series(marts: Marts, windows: Sequence[Window] = AGE_WINDOWS) -> DataFrame:
    """(window, cohort, value) over fully observed cohorts."""
    return _at_windows(marts.curves, windows).filter("fully_observed_n").select(
        "window", "cohort", F.col("adoption_rate").alias("value")
    )


def rate_cells(marts: Marts, windows: Sequence[Window] = AGE_WINDOWS) -> DataFrame:
    """(window, cohort, segment, value, n) over fully observed cells."""
    return _at_windows(marts.curves_by_segment, windows).filter("fully_observed_n").select(
        "window",
        "cohort",
        F.col("segmento").alias("segment"),
        F.col("adoption_rate").alias("value"),
        F.col("n_observed").alias("n"),
    )


def observed_flags(marts: Marts, windows: Sequence[Window] = AGE_WINDOWS) -> DataFrame:
    """(window, cohort, fully_observed) for every cohort, young ones included."""
    return _at_windows(marts.curves, windows).select(
        "window", "cohort", F.col("fully_observed_n").alias("fully_observed")
    )


def review_all(marts: Marts, windows: Sequence[Window] = AGE_WINDOWS) -> DataFrame:
    """Critique records of every cohort at every window."""
    flags = observed_flags(marts, windows)
    return guards.critique(
        rate_series(marts, windows), rate_cells(marts, windows), guards.all_targets(flags), flags
    )


def review(
    marts: Marts, window: str | Window = Window.MSA_6, cohort: str | None = None, prior_cohort: str | None = None
) -> DataFrame:
    """Critique record of one cohort: the latest fully observed one unless named.

    A named cohort is compared with ``prior_cohort``, or else with the one before it in the series.
    """
    at = Window(window)
    series, cells = rate_series(marts, [at]), rate_cells(marts, [at])
    if cohort is None:
        targets = guards.latest_targets(series)
        if targets.isEmpty():
            raise ValueError("a digest needs two fully observed cohorts")
    else:
        before = series.filter(F.col("cohort") < cohort).agg(F.max("cohort").alias("prior_cohort"))
        if prior_cohort is not None:
            before = series.sparkSession.range(1).select(F.lit(prior_cohort).alias("prior_cohort"))
        targets = before.select(F.lit(at.value).alias("window"), F.lit(cohort).alias("cohort"), "prior_cohort")
    return guards.critique(series, cells, targets)


def run_digest(marts: Marts, window: str | Window = Window.MSA_6, prose: Column | None = None, **cohorts) -> DataFrame:
    """A reviewed cohort with its text and the verdict on the text's figures.

    ``prose`` is any text column over the review; without it the fixed sentences are used.
    """
    return digest.write_digests(review(marts, window, **cohorts), prose)


def run_and_store(
    spark: SparkSession, marts: Marts, path: str, run_id: str, window: str | Window = Window.MSA_6, **cohorts
) -> str:
    """Run one digest and merge it into the table. Returns what happened, for a log."""
    digests = settle(run_digest(marts, window, **cohorts))
    row = digests.select("cohort_month", "critic_passed", "faithful", "violations").first()
    if row is None or not row["critic_passed"]:
        return "not stored: the cohort is not fully observed"
    if not row["faithful"]:
        return f"not stored: the text states other figures {row['violations']}"
    digest.upsert_digests(spark, path, digest.digest_rows(digests, run_id))
    return f"stored {row['cohort_month']} at {Window(window).value} for run {run_id}"
