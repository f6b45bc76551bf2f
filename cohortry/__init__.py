"""Cohort, vintage and funnel analytics on Spark DataFrames."""

from cohortry.spec import MetricError, PanelSpec, Window

__all__ = ["MetricError", "PanelSpec", "Window"]
