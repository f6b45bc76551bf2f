"""Monthly loads: new raw files are merged into the panel and the marts follow."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.operators import marts, model
from cohortry.operators.resolve import entity_profile, merge_profiles, resolve_profiles
from cohortry.operators.staging import clean_panel
from cohortry.sources.delimited import read_all_string
from cohortry.sources.tables import TableSet, read_or_none, replace_partitions
from cohortry.spec import PanelSpec

PANEL, PROFILES, CELLS = "stg_customer_month", "customer_profile", "customer_cells"
INCREMENT, CLAIMED, LAYOUT = "increment", "claimed", "layout"
PANEL_KEY = ("customer_id", "snapshot_month")
BUCKET = "customer_bucket"
DEFAULT_BUCKETS = 64


def one_per_key(panel: DataFrame) -> DataFrame:
    """One row per entity and snapshot, the greatest of those that claim it."""
    values = [c for c in panel.columns if c not in PANEL_KEY]
    return panel.groupBy(*PANEL_KEY).agg(F.max(F.struct(*values)).alias("row")).select(*PANEL_KEY, "row.*")


def merge_panel(existing: DataFrame, increment: DataFrame) -> DataFrame:
    """Rows of ``increment`` replace rows of the same entity and snapshot."""
    kept = existing.join(increment.select(*PANEL_KEY), list(PANEL_KEY), "left_anti")
    return kept.select(*increment.columns).unionByName(increment)


class IncrementalLoad:
    """Keeps panel, customer profiles and marts of one folder up to date.

    The panel is partitioned by snapshot and hash bucket of the customer, profiles by bucket. A new month
    is merged into the profiles of its customers without a look at their history; only customers whose stored
    months are corrected are profiled anew, from the panel partitions of their buckets. What depends on the
    panel's end, which moves with every month, is a projection of the profiles and never stored by customer.
    Marts are sums of cells, counts of customers that do not depend on the panel's end. Cells are kept by bucket and
    counted anew in the buckets a batch touches, which the merge of profiles has to rewrite anyway: profiles of other
    buckets are not read. Counts are replaced, not added to, so a load that is repeated after a failure ends in the
    same state; it meets its own rows as corrections.
    """

    def __init__(self, tables: TableSet, spec: PanelSpec, buckets: int | None = None) -> None:
        """``buckets`` is fixed by the first load and kept with the tables; later loads may leave it out."""
        self.tables = tables
        self.spec = spec
        self.buckets = self._layout(buckets)

    def _layout(self, buckets: int | None) -> int:
        stored = read_or_none(self.tables.spark, self.tables.path(LAYOUT))
        if stored is None:
            chosen = buckets or DEFAULT_BUCKETS
            self.tables.write(LAYOUT, self.tables.spark.range(1).select(F.lit(chosen).alias("buckets")))
            return chosen
        held = stored.first()["buckets"]
        if buckets not in (None, held):
            raise ValueError(f"the tables have {held} buckets, not {buckets}")
        return held

    def apply(self, raw: DataFrame, batch: int) -> None:
        """Merge one batch of raw rows."""
        tables, spark = self.tables, raw.sparkSession
        bucket = F.pmod(F.hash("customer_id"), F.lit(self.buckets)).alias(BUCKET)
        # written once and read back: the batch is used several times below
        increment = self._settle_claims(tables.write(INCREMENT, clean_panel(raw, self.spec).select("*", bucket)))
        # one value per snapshot date, known to be few
        snapshots = [row[0] for row in increment.select("snapshot_month").distinct().collect()]
        if snapshots:
            existing = read_or_none(spark, tables.path(PANEL))
            corrected = None
            if existing is not None:
                existing = existing.filter(F.col("snapshot_month").isin(snapshots))
                if existing.isEmpty():  # new months only: nothing to compare the batch with
                    existing = None
            if existing is not None:
                met = existing.join(increment.select(*PANEL_KEY), list(PANEL_KEY), "left_semi")
                corrected = tables.write("corrected", met.select("customer_id", BUCKET).distinct())
            merged = increment if existing is None else merge_panel(existing, increment)
            replace_partitions(merged, tables.path(PANEL), "snapshot_month", BUCKET)
            self._refresh_profiles(increment, corrected)
            self._refresh_cells(increment)
            self._refresh_marts()
            tables.remove("corrected")
        tables.remove(CLAIMED)
        tables.remove(INCREMENT)

    def _settle_claims(self, increment: DataFrame) -> DataFrame:
        """The batch with one row per entity and snapshot (``one_per_key``).

        Keys claimed by several rows are found by counts of keys alone; whole rows are compared for such keys only.
        """
        claims = increment.groupBy(*PANEL_KEY).count().filter("count > 1").select(*PANEL_KEY)
        claimed = self.tables.write(CLAIMED, claims)
        if claimed.isEmpty():
            return increment
        single = increment.join(claimed, list(PANEL_KEY), "left_anti")
        chosen = one_per_key(increment.join(claimed, list(PANEL_KEY), "left_semi"))
        return self.tables.write(INCREMENT, single.select(*increment.columns).unionByName(chosen))

    def _buckets_of(self, rows: DataFrame) -> list[int]:
        """At most ``buckets`` values."""
        return [row[0] for row in rows.select(BUCKET).distinct().collect()]

    def _refresh_profiles(self, increment: DataFrame, corrected: DataFrame | None) -> None:
        tables, spark = self.tables, increment.sparkSession
        stored = read_or_none(spark, tables.path(PROFILES))
        fresh = increment
        if corrected is not None:
            fresh = increment.join(corrected, "customer_id", "left_anti")
        parts = entity_profile(fresh)
        if stored is not None:
            held = stored.filter(F.col(BUCKET).isin(self._buckets_of(increment))).drop(BUCKET)
            if corrected is not None:
                held = held.join(corrected, "customer_id", "left_anti")
            parts = merge_profiles(parts.unionByName(held))
        if corrected is not None and not corrected.isEmpty():
            history = tables.read(PANEL).filter(F.col(BUCKET).isin(self._buckets_of(corrected)))
            parts = parts.unionByName(entity_profile(history.join(corrected, "customer_id", "left_semi")))
        bucket = F.pmod(F.hash("customer_id"), F.lit(self.buckets)).alias(BUCKET)
        replace_partitions(parts.select("*", bucket), tables.path(PROFILES), BUCKET)

    def _refresh_cells(self, increment: DataFrame) -> None:
        """Counts of the touched buckets; of all where none are stored yet (a folder of an earlier version)."""
        tables = self.tables
        profiles = tables.read(PROFILES)
        if tables.exists(CELLS):
            profiles = profiles.filter(F.col(BUCKET).isin(self._buckets_of(increment)))
        resolved = resolve_profiles(profiles, self.spec, BUCKET)
        replace_partitions(marts.cell_counts(resolved, BUCKET), tables.path(CELLS), BUCKET)

    def current_spec(self) -> PanelSpec:
        """The spec with the panel's end at the last month that has arrived."""
        last = self.tables.read(CELLS).agg(F.trunc(F.max("last_obs_month"), "MM")).first()[0]
        return replace(self.spec, panel_end=last)

    def customers(self) -> DataFrame:
        """The customer fact as of the last month that has arrived."""
        profiles = self.tables.read(PROFILES).drop(BUCKET)
        return model.fct_customer(resolve_profiles(profiles, self.current_spec()))

    def _refresh_marts(self) -> None:
        tables, spec, cells = self.tables, self.current_spec(), self.tables.read(CELLS)
        tables.write("mart_adoption_curves", marts.curves_of_cells(cells, spec))
        tables.write("mart_adoption_curves_by_segment", marts.curves_of_cells(cells, spec, ["segmento"]))
        tables.write("mart_cohort_adoption", marts.cohorts_of_cells(cells, spec))

    def run(
        self,
        spark: SparkSession,
        source: str,
        checkpoint: str,
        file_format: str = "parquet",
        files_per_batch: int = 1,
        max_bad: int = 100,
        quoted_newlines: bool = True,
    ) -> None:
        """Load every file below ``source`` that has not been loaded yet, then stop.

        The stream carries the names of new files; each batch reads its files with their own headers, so
        columns are bound by name, whatever their order, and others than the spec's are ignored. More
        than ``max_bad`` malformed rows in a batch of delimited files stop the load.
        """
        names = list(self.spec.raw.values())

        def load(arrived: DataFrame, batch: int) -> None:
            paths = [row["path"] for row in arrived.select("path").collect()]  # files_per_batch at most
            if not paths:
                return
            if file_format == "csv":
                raw = read_all_string(spark, paths, max_bad, quoted_newlines)
            else:
                raw = spark.read.format(file_format).load(paths)
            self.apply(raw.select([F.col(name).cast("string").alias(name) for name in names]), batch)

        arrivals = (
            spark.readStream.format("binaryFile")
            .schema("path string, modificationTime timestamp, length long, content binary")
            .option("maxFilesPerTrigger", files_per_batch)
            .load(source)
        )
        query = (
            arrivals.select("path")
            .writeStream.foreachBatch(load)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
