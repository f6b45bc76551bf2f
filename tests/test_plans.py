"""Plan shapes that have to hold when tables are large."""

import tempfile

import pytest
from pyspark.sql import functions as F

from cohortry.operators import metrics, model, reads, requests
from cohortry.operators.marts import adoption_curves
from cohortry.plans import digest_run
from cohortry.plans.catalog import Catalog
from cohortry.plans.jobs import main
from cohortry.plans.warehouse import StoredWarehouse
from cohortry.sources.orders_panel import ORDERS_SPEC, raw_panel
from cohortry.sources.tables import TableSet
from cohortry.spec import PanelSpec
import datetime as dt


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark):
    """Tables of the whole order history at sf0.001, through the command line."""
    root = tempfile.mkdtemp(prefix="run-")
    raw_panel(spark, "/root/testdata/sf0.001").write.parquet(root + "/raw")
    span = ["--root", root + "/tables", "--panel-start", "1995-01-01", "--panel-end", "2001-08-01"]
    assert main([*span, "build", "--source", root + "/raw", "--format", "parquet"]).startswith("built")
    assert main([*span, "digest", "--run-id", "r1", "--window", "msa_3"]).startswith("stored")
    return StoredWarehouse(TableSet(spark, root + "/tables"), ORDERS_SPEC)


def test_metric_reads_are_pruned_and_pushed_down(stored):
    text = plan(Catalog(stored).query_metric("adoption_rate", "msa_6"))
    pushed = text.split("PushedFilters: ")[1].split("]")[0]
    assert "EqualTo(msa,6)" in pushed and "EqualTo(is_cell_right_censored" in pushed, pushed
    assert "ReadSchema: struct<acq_month:date,msa:bigint,n_observed:bigint,n_adopted_clean:bigint,is_cell_right_censored:boolean>" in text
    text = plan(reads.funnel_counts(stored.fct_customer))
    assert "ReadSchema: struct<is_within_panel_cohort:boolean,is_adopted_clean:boolean,retained_3m:boolean>" in text


def test_a_named_cohort_reaches_the_files(stored):
    text = plan(Catalog(stored).query_metric("funnel_conversion", "acquired_to_adopted", "1995-02"))
    assert "EqualTo(acq_month,1995-02-01)" in text
    whole = {r["cohort"]: r["value"] for r in Catalog(stored).query_metric("adoption_rate_segment_adjusted", "msa_6").collect()}
    one = Catalog(stored).query_metric("adoption_rate_segment_adjusted", "msa_6", "1995-02").first()
    assert one["value"] == pytest.approx(whole["1995-02"])


def test_resolution_reads_the_panel_once(stored):
    from cohortry.operators.resolve import resolve_adoption

    text = plan(resolve_adoption(stored.panel, ORDERS_SPEC))
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1 and "Join" not in text
    assert "age_band" in text and "fecha_alta" not in text.split("ReadSchema")[1]


def test_both_curves_share_one_pass_over_customers(spark, stored):
    blended = adoption_curves(stored.fct_customer, ORDERS_SPEC)
    split = adoption_curves(stored.fct_customer, ORDERS_SPEC, ["segmento"])
    both = blended.select("n_observed").unionByName(split.select("n_observed"))
    both.collect()
    assert "ReusedExchange" in plan(both)


def test_standardised_rate_has_no_global_window(stored):
    text = plan(metrics.adoption_rate_adjusted(stored, digest_run.AGE_WINDOWS[1]))
    assert "Window" not in text and "SinglePartition" not in text


def test_no_step_of_the_model_multiplies_rows_or_crosses(spark, stored):
    for df in (stored.curves, model.fct_customer_month(stored.panel, stored.resolved), digest_run.review_all(stored)):
        assert "CartesianProduct" not in plan(df) and "BroadcastNestedLoopJoin" not in plan(df)


def test_hot_entity_is_split_in_the_monthly_fact(spark):
    """One entity holds most rows: adaptive execution splits it, and nothing is lost."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        names = ("segmento", "canal_entrada", "income_band", "age_band", "nomprov")
        panel = spark.range(300_000, numPartitions=8).selectExpr(
            "if(id % 3 > 0, 7L, id) as customer_id", "date_add(date'2015-01-28', cast(id % 400 as int)) as snapshot_month",
            "date'2015-01-01' as acq_month", "0L as card_flag", *[f"md5(cast(id as string)) as {c}" for c in names],
        )
        resolved = panel.select("customer_id").distinct().selectExpr(
            "customer_id", "true as is_within_panel_cohort", "false as is_adopted_clean", "false as is_right_censored",
            "false as has_panel_gaps",
        )
        table = TableSet(spark, tempfile.mkdtemp(prefix="run-")).write("resolved", resolved)
        fact = model.fct_customer_month(panel, table)
        assert fact.filter("is_within_panel_cohort").count() == 300_000
        counted = fact.agg(F.max("customer_month_key"), F.count_if("is_within_panel_cohort"))
        counted.collect()
        assert "skew=true" in plan(counted)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_hot_question_is_not_a_join_key(spark):
    asked = spark.range(9000).selectExpr("id", "if(id % 3 = 0, 'Same  question', concat('q ', id % 2000)) as text")
    marked = requests.mark_repeats(asked, "text", ["id"])
    first = {}
    for row in asked.orderBy("id").collect():
        first.setdefault(row["text"], row["id"])
    repeats = {r["id"] for r in marked.filter("is_repeat").collect()}
    assert len(repeats) == 9000 - len(first) and not repeats & set(first.values())
    joins = [line for line in plan(marked).splitlines() if "Join" in line]
    assert joins and all("question_key" not in line.split("LeftOuter")[0] for line in joins)


def test_load_job(spark):
    root = tempfile.mkdtemp(prefix="run-")
    raw = raw_panel(spark, "/root/testdata/sf0.001", dt.date(1995, 4, 1))
    raw.coalesce(1).write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(root + "/landing")
    span = ["--root", root + "/t", "--panel-start", "1995-01-01", "--panel-end", "1995-03-01"]
    assert main([*span, "load", "--source", root + "/landing", "--checkpoint", root + "/c"]).startswith("loaded")
    from cohortry.plans.warehouse import Warehouse

    want = Warehouse(raw, PanelSpec(dt.date(1995, 1, 1), dt.date(1995, 3, 1))).curves
    got = TableSet(spark, root + "/t").read("mart_adoption_curves").select(*want.columns)
    assert got.exceptAll(want).isEmpty() and got.count() == want.count()
