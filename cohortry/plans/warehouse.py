"""From a raw panel to the full set of tables, lazily or written to a folder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.operators import marts, model
from cohortry.operators.quality import check
from cohortry.operators.resolve import resolve_adoption
from cohortry.operators.staging import clean_panel
from cohortry.plans.contracts import CONTRACTS
from cohortry.sources.tables import TableSet
from cohortry.spec import PanelSpec


@dataclass(eq=False, repr=False)
class Warehouse:
    """All tables as lazy DataFrames over one raw panel. Nothing runs until a table is used."""

    raw: DataFrame
    spec: PanelSpec

    @property
    def spark(self) -> SparkSession:
        return self.raw.sparkSession

    @cached_property
    def panel(self) -> DataFrame:
        return clean_panel(self.raw, self.spec)

    @cached_property
    def resolved(self) -> DataFrame:
        return resolve_adoption(self.panel, self.spec)

    @cached_property
    def fct_customer(self) -> DataFrame:
        return model.fct_customer(self.resolved)

    @cached_property
    def fct_customer_month(self) -> DataFrame:
        return model.fct_customer_month(self.panel, self.resolved)

    @cached_property
    def dim_date(self) -> DataFrame:
        return model.dim_date(self.panel)

    @cached_property
    def dim_customer(self) -> DataFrame:
        return model.dim_customer(self.resolved)

    @cached_property
    def dim_channel(self) -> DataFrame:
        return model.dim_channel(self.panel)

    @cached_property
    def curves(self) -> DataFrame:
        return marts.adoption_curves(self.fct_customer, self.spec)

    @cached_property
    def curves_by_segment(self) -> DataFrame:
        return marts.adoption_curves(self.fct_customer, self.spec, ["segmento"])

    @cached_property
    def cohort_adoption(self) -> DataFrame:
        return marts.cohort_adoption(self.fct_customer, self.spec)

    def tables(self) -> dict[str, DataFrame]:
        return {
            "stg_customer_month": self.panel,
            "dim_date": self.dim_date,
            "dim_customer": self.dim_customer,
            "dim_channel": self.dim_channel,
            "fct_customer": self.fct_customer,
            "fct_customer_month": self.fct_customer_month,
            "mart_adoption_curves": self.curves,
            "mart_adoption_curves_by_segment": self.curves_by_segment,
            "mart_cohort_adoption": self.cohort_adoption,
        }


class StoredWarehouse(Warehouse):
    """The same tables read back from a folder that ``build`` has written."""

    def __init__(self, tables: TableSet, spec: PanelSpec) -> None:
        self.stored = tables
        self.spec = spec

    @property
    def spark(self) -> SparkSession:
        return self.stored.spark

    panel = cached_property(lambda self: self.stored.read("stg_customer_month"))
    resolved = cached_property(lambda self: self.stored.read("int_customer_adoption_resolved"))
    fct_customer = cached_property(lambda self: self.stored.read("fct_customer"))
    fct_customer_month = cached_property(lambda self: self.stored.read("fct_customer_month"))
    dim_date = cached_property(lambda self: self.stored.read("dim_date"))
    dim_customer = cached_property(lambda self: self.stored.read("dim_customer"))
    dim_channel = cached_property(lambda self: self.stored.read("dim_channel"))
    curves = cached_property(lambda self: self.stored.read("mart_adoption_curves"))
    curves_by_segment = cached_property(lambda self: self.stored.read("mart_adoption_curves_by_segment"))
    cohort_adoption = cached_property(lambda self: self.stored.read("mart_cohort_adoption"))


class QualityError(Exception):
    """Data tests failed; ``failures`` lists (table, rule, columns, failures)."""

    def __init__(self, failures: list[tuple]) -> None:
        super().__init__(f"{len(failures)} data tests failed: {failures}")
        self.failures = failures


def require_quality(results: DataFrame) -> None:
    """Raises when a rule has failures. One result row per rule reaches the driver."""
    failed = [tuple(row) for row in results.filter(F.col("failures") > 0).collect()]
    if failed:
        raise QualityError(failed)


def build(
    raw: DataFrame, spec: PanelSpec, tables: TableSet, after_staging: Callable[[], None] | None = None
) -> StoredWarehouse:
    """Write every table once, each from the stored one before it, and test it before the next.

    The big panel is scanned for staging, resolution, the channel codes and the monthly fact; all
    marts come from the much smaller customer fact. ``after_staging`` may inspect what was observed
    while the raw panel was read, and stop the build by raising.
    """
    lazy = Warehouse(raw, spec)
    stored = StoredWarehouse(tables, spec)

    def parents(name: str) -> dict[str, DataFrame]:
        return {r.parent: tables.read(r.parent) for r in CONTRACTS[name] if r.parent}

    def store(name: str, df: DataFrame, **layout) -> None:
        tables.write(name, df, **layout)
        if name in CONTRACTS:
            results = check(tables.read(name), CONTRACTS[name], parents(name)).select(
                F.lit(name).alias("table"), "rule", "columns", "failures"
            )
            require_quality(results)

    store("stg_customer_month", lazy.panel)
    if after_staging is not None:
        after_staging()
    store("int_customer_adoption_resolved", resolve_adoption(stored.panel, spec))
    store("dim_date", model.dim_date(stored.panel))
    store("dim_customer", model.dim_customer(stored.resolved))
    store("dim_channel", model.dim_channel(stored.panel))
    store("fct_customer", model.fct_customer(stored.resolved))
    store(
        "fct_customer_month",
        model.customer_months(stored.panel, stored.resolved),
        partition="snapshot_month",
        sort=("acq_month", "segmento", "customer_id"),
        derived=model.with_month_key,
    )
    store("mart_adoption_curves", marts.adoption_curves(stored.fct_customer, spec))
    store("mart_adoption_curves_by_segment", marts.adoption_curves(stored.fct_customer, spec, ["segmento"]))
    store("mart_cohort_adoption", marts.cohort_adoption(stored.fct_customer, spec))
    return stored
