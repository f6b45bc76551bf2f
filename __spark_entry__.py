
from __future__ import annotations

import atexit
import os
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracles  # noqa: E402
from cohortry.operators import digest, guards, model, reads, requests  # noqa: E402
from cohortry.operators.quality import check_tables  # noqa: E402
from cohortry.operators.windows import window_admission  # noqa: E402
from cohortry.plans import digest_run  # noqa: E402
from cohortry.plans.catalog import Catalog  # noqa: E402
from cohortry.plans.contracts import CONTRACTS  # noqa: E402
from cohortry.plans.warehouse import StoredWarehouse, Warehouse, build  # noqa: E402
from cohortry.sources.delimited import read_all_string  # noqa: E402
from cohortry.sources.orders_panel import ORDERS_SPEC, raw_panel  # noqa: E402
from cohortry.sources.tables import TableSet, remove_folder, shared_folder  # noqa: E402
from cohortry.spec import Window  # noqa: E402
from cohortry.streaming.admission import read_admission_counts, run_admission_counts  # noqa: E402
from cohortry.streaming.decisions import read_decisions, run_decisions  # noqa: E402
from cohortry.streaming.incremental import IncrementalLoad  # noqa: E402

try:  # the training-data operators may be absent
    import corpus_pipeline
    from cohortry.llm import queries as llm
except ModuleNotFoundError as absent:
    if absent.name not in ("corpus_pipeline", "cohortry.llm"):
        raise
    llm = None

Query = Callable[[SparkSession, str], DataFrame]

# audit caps for the event log: both bind on the given tables
ADMISSION = {"ts": "ts", "client": "user_id", "bucket": "1 day", "per_client": 5, "global_cap": 300}

_defined: dict[tuple[str, str], Warehouse] = {}
_built: dict[tuple[str, str], StoredWarehouse] = {}
_loads: dict[tuple[str, str], IncrementalLoad] = {}
_shipped: set[str] = set()


def _lazy(spark: SparkSession, folder: str) -> Warehouse:
    """The unexecuted tables; queries share their definitions, not their data."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _defined:
        _defined[key] = Warehouse(raw_panel(spark, folder), ORDERS_SPEC)
    return _defined[key]


def _run_folder(spark: SparkSession, name: str) -> TableSet:
    """A folder of this run's own, where every executor can reach it; it goes when the program ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return TableSet(spark, path)


def _forget(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:  # else the session has been stopped
        remove_folder(spark, path)


def _stored(spark: SparkSession, folder: str) -> StoredWarehouse:
    """The written tables, built once per session and input."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _built:
        _built[key] = build(raw_panel(spark, folder), ORDERS_SPEC, _run_folder(spark, "warehouse"))
    return _built[key]


def _table(name: str) -> Query:
    return lambda spark, folder: getattr(_lazy(spark, folder), name)


def _metric(metric: str, window: Window = Window.LIFETIME, digits: int | None = None, **options) -> Query:
    """A catalogue call. Weighted sums are rounded: engines add floats in different orders."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        values = Catalog(_lazy(spark, folder)).query_metric(metric, window, **options)
        return values if digits is None else values.withColumn("value", F.round("value", digits))

    return run


def staging_bands(spark: SparkSession, folder: str) -> DataFrame:
    filled = {"n_age": "age", "n_income": "income", "n_seniority": "seniority_months", "n_cohort": "acq_month"}
    return (
        _lazy(spark, folder)
        .panel.groupBy("age_band", "income_band")
        .agg(F.count("*").alias("n"), *[F.count(column).alias(name) for name, column in filled.items()])
    )


def ingest_strings(spark: SparkSession, folder: str) -> DataFrame:
    """The raw panel through delimited files and back, as text.

    Half of the files have their columns in another order, and one holds only malformed lines.
    """
    tables, raw = _run_folder(spark, "ingest"), raw_panel(spark, folder)
    plain = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    even = F.col("ncodpers").cast("bigint") % 2 == 0
    raw.filter(even).write.options(**plain).csv(tables.path("files/a"))
    raw.filter(~even).select(*reversed(raw.columns)).write.options(**plain).csv(tables.path("files/b"))
    lines = spark.createDataFrame([(0, ",".join(raw.columns)), (1, "too,few,fields"), (2, ",".join("x" * 99))], "n int, line string")
    lines.coalesce(1).sortWithinPartitions("n").select("line").write.text(tables.path("files/c"))
    return read_all_string(spark, tables.path("files/*"), max_bad=2)


def fct_customer_month(spark: SparkSession, folder: str) -> DataFrame:
    """From the stored staging and resolution, so that the panel is computed once."""
    stored = _stored(spark, folder)
    return model.fct_customer_month(stored.panel, stored.resolved)


def warehouse_build(spark: SparkSession, folder: str) -> DataFrame:
    return _stored(spark, folder).fct_customer_month


def m_segment_mix(spark: SparkSession, folder: str) -> DataFrame:
    mix = Catalog(_lazy(spark, folder)).query_metric("segment_mix")
    return mix.select("cohort", F.inline("breakdown"))


def m_compare_cohorts(spark: SparkSession, folder: str) -> DataFrame:
    return Catalog(_lazy(spark, folder)).compare_cohorts("1995-05", "1995-01", "adoption_rate", "msa_6")


def guard_target(spark: SparkSession, folder: str) -> DataFrame:
    return guards.latest_targets(digest_run.rate_series(_lazy(spark, folder)))


def guard_censoring(spark: SparkSession, folder: str) -> DataFrame:
    flags = digest_run.observed_flags(_lazy(spark, folder))
    return guards.observed_gate(guards.all_targets(flags), flags)


def guard_min_n(spark: SparkSession, folder: str) -> DataFrame:
    kept, small = guards.split_min_n(digest_run.rate_cells(_lazy(spark, folder)))
    return kept.unionByName(small, allowMissingColumns=True)


def guard_deltas(spark: SparkSession, folder: str) -> DataFrame:
    return guards.consecutive_deltas(digest_run.rate_series(_lazy(spark, folder)))


def guard_materiality(spark: SparkSession, folder: str) -> DataFrame:
    deltas = guards.consecutive_deltas(digest_run.rate_series(_lazy(spark, folder)))
    return guards.assess_materiality(deltas).select(
        "window", "cohort", "delta", "material", "abs_delta", F.round("sd", 9).alias("sd"),
        F.round("threshold_sd", 9).alias("threshold_sd"), "insufficient_history",
    )


def _observed_targets(marts) -> DataFrame:
    flags = digest_run.observed_flags(marts)
    return guards.observed_gate(guards.all_targets(flags), flags).filter("is_observed").drop("is_observed")


def guard_findings(spark: SparkSession, folder: str) -> DataFrame:
    marts = _stored(spark, folder)
    found = guards.findings(digest_run.rate_series(marts), digest_run.rate_cells(marts), _observed_targets(marts))
    return found.drop("threshold_abs", "note").withColumns(
        {"sd": F.round("sd", 9), "threshold_sd": F.round("threshold_sd", 9)}
    )


def guard_suppressed(spark: SparkSession, folder: str) -> DataFrame:
    marts = _stored(spark, folder)
    return guards.suppressions(digest_run.rate_cells(marts), _observed_targets(marts))


def guard_critique(spark: SparkSession, folder: str) -> DataFrame:
    records = digest_run.review_all(_stored(spark, folder))
    sizes = {"n_findings": "findings", "n_suppressed": "suppressed", "n_notes": "notes"}
    return records.select(
        "cohort_month", "window", "critic_passed", *[F.size(c).cast("bigint").alias(n) for n, c in sizes.items()]
    )


def guard_panel_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return guards.panel_gap_warnings(_lazy(spark, folder).cohort_adoption)


def digest_tokens(spark: SparkSession, folder: str) -> DataFrame:
    tokens = digest.figure_tokens(F.col("text"))
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", tokens.alias("t"))
    return documents.select("doc_id", F.array_join("t", "|").alias("tokens"), F.size("t").alias("n_tokens"))


def _allowed() -> Column:
    return digest.allowed_figures(F.col("cohort_month"), F.col("window"), F.col("findings"))


def digest_allowed(spark: SparkSession, folder: str) -> DataFrame:
    records = digest_run.review_all(_stored(spark, folder)).filter("critic_passed")
    return records.select("window", "cohort_month", F.array_join(F.array_sort(_allowed()), "|").alias("allowed"))


def digest_faithfulness(spark: SparkSession, folder: str) -> DataFrame:
    """Every digest text, and a copy of it with a figure nobody has approved."""
    digests = digest.write_digests(digest_run.review_all(_stored(spark, folder))).filter("critic_passed")
    texts = digests.select("window", "cohort_month", _allowed().alias("allowed"), "prose")
    altered = F.concat("prose", F.lit(" That is 99.99% more, and 99.99% again."))
    variants = texts.select("*", F.explode(F.create_map(F.lit("written"), "prose", F.lit("altered"), altered)))
    checked = variants.select(
        "window",
        "cohort_month",
        F.col("key").alias("variant"),
        F.col("value").alias("prose"),
        digest.check_figures(F.col("value"), F.col("allowed")).alias("check"),
    )
    return checked.select(
        "window", "cohort_month", "variant", "prose", "check.faithful",
        F.array_join("check.violations", "|").alias("violations"),
    )


def _digest_table(records: DataFrame, run="run_1", window: str | None = None) -> DataFrame:
    """Digest rows of all cohorts, stamped with their month so that the result is repeatable."""
    digests = digest.write_digests(records)
    if window is not None:
        digests = digests.filter(F.col("window") == window)
    stamp = F.to_timestamp_ntz(F.concat("cohort_month", F.lit("-01")), F.lit("yyyy-MM-dd"))
    return digest.digest_rows(digests, run, stamp)


def _without_json(rows: DataFrame) -> DataFrame:
    plain = rows.drop("findings_json", "suppressed_json", "notes_json")
    return plain.withColumn("generated_at", F.col("generated_at").cast("timestamp_ntz"))


def digest_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _without_json(_digest_table(digest_run.review_all(_stored(spark, folder))))


FINDING = "kind string, segment string, cohort string, prior_cohort string, value double, prior_value double, n bigint, delta double, material boolean"
SHOWN = (
    "change_type string, material boolean, segment string, cohort string, prior_cohort string, adoption_rate string, "
    "prior_adoption_rate string, change_pp string, cohort_cell_size bigint"
)


def _parsed(spark: SparkSession, folder: str, column: str, fields: str) -> DataFrame:
    """The rows inside one JSON column of the digest table."""
    rows = _digest_table(digest_run.review_all(_stored(spark, folder)))
    items = F.from_json(column, f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in fields.split(', '))}>>")
    return rows.select("cohort_month", "metric_window", F.inline(items))


def digest_json(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed(spark, folder, "findings_json", FINDING)


def digest_json_suppressed(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed(spark, folder, "suppressed_json", "suppressed boolean, reason string, segment string, n bigint")


def digest_json_notes(spark: SparkSession, folder: str) -> DataFrame:
    rows = _digest_table(digest_run.review_all(_stored(spark, folder)))
    return rows.select("cohort_month", "metric_window", F.size(F.from_json("notes_json", "array<string>")).cast("bigint").alias("n_notes"))


def digest_payload(spark: SparkSession, folder: str) -> DataFrame:
    """The findings inside the display payload."""
    shown = digest.display_payload(digest_run.review_all(_stored(spark, folder)))
    fields = ", ".join(f.replace(" ", ":", 1) for f in SHOWN.split(", "))
    held = F.from_json("payload", f"observation_window string, findings array<struct<{fields}>>")
    return shown.select(held.alias("held")).select("held.observation_window", F.inline("held.findings"))


def digest_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """One run stored, then another window merged in: some of its rows replace, the rest are new."""
    path = _run_folder(spark, "digests").path("mart_digest_cache")
    stored = digest_run.review_all(_stored(spark, folder))
    digest.upsert_digests(spark, path, _digest_table(stored, "run_1", "msa_12"))
    run = F.when(F.substring("cohort_month", 6, 2) <= "06", F.lit("run_1")).otherwise(F.lit("run_2"))
    digest.upsert_digests(spark, path, _digest_table(stored, run, "msa_6"))
    return _without_json(digest.read_digests(spark, path))


def digest_latest(spark: SparkSession, folder: str) -> DataFrame:
    return _without_json(digest.latest_digest(_digest_table(digest_run.review_all(_stored(spark, folder))), "msa_6"))


def bi_curves(spark: SparkSession, folder: str) -> DataFrame:
    return reads.curve_points(_lazy(spark, folder).curves)


def bi_curves_censored(spark: SparkSession, folder: str) -> DataFrame:
    return reads.filter_curves(bi_curves(spark, folder), max_age=12, observed=False)


def bi_funnel(spark: SparkSession, folder: str) -> DataFrame:
    return reads.funnel_ratios(reads.funnel_counts(_lazy(spark, folder).fct_customer))


def bi_heatmap(spark: SparkSession, folder: str) -> DataFrame:
    return reads.heatmap_cells(_lazy(spark, folder).cohort_adoption)


def bi_heatmap_pivot(spark: SparkSession, folder: str) -> DataFrame:
    return reads.heatmap_pivot(_stored(spark, folder).cohort_adoption)


def dq_panel(spark: SparkSession, folder: str) -> DataFrame:
    """All data tests of all written tables."""
    return check_tables(_stored(spark, folder).tables(), CONTRACTS)


def table_if_absent(spark: SparkSession, folder: str) -> DataFrame:
    """A table that is there already is left as it is."""
    tables, customers = _run_folder(spark, "absent"), _stored(spark, folder).dim_customer
    tables.write_if_absent("dim_customer", customers)
    return tables.write_if_absent("dim_customer", customers.limit(1))


def view_of_table(spark: SparkSession, folder: str) -> DataFrame:
    """A named view, read in SQL."""
    stored = _stored(spark, folder)
    stored.stored.view("channels", stored.dim_channel)
    return spark.sql("SELECT channel_label, channel_code FROM channels WHERE channel_code <> 'unknown'")


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/conversations.parquet").filter(F.col("role") == "user")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def text_screen(spark: SparkSession, folder: str) -> DataFrame:
    return requests.screen_text(_questions(spark, folder), "text").select("conv_id", "turn", "screen")


def text_screen_documents(spark: SparkSession, folder: str) -> DataFrame:
    return requests.screen_text(_documents(spark, folder), "text").select("doc_id", "screen")


def text_repeats(spark: SparkSession, folder: str) -> DataFrame:
    marked = requests.mark_repeats(_questions(spark, folder).select("conv_id", "turn", "text"), "text", ["conv_id", "turn"])
    return marked.drop("text")


def text_repeats_documents(spark: SparkSession, folder: str) -> DataFrame:
    return requests.mark_repeats(_documents(spark, folder).select("doc_id", "text"), "text", ["doc_id"]).drop("text")


def request_admission(spark: SparkSession, folder: str) -> DataFrame:
    events = spark.read.parquet(f"{folder}/events.parquet").select("event_id", "user_id", "ts")
    return requests.admission(events, request="event_id", **ADMISSION)


def request_admission_counts(spark: SparkSession, folder: str) -> DataFrame:
    return requests.admission_counts(spark.read.parquet(f"{folder}/events.parquet"), **ADMISSION)


def request_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of a day that each begin with a request, over the whole event log."""
    _ship(spark)
    events = spark.read.parquet(f"{folder}/events.parquet").select("event_id", "user_id", "ts")
    limits = {k: ADMISSION[k] for k in ("ts", "client", "per_client", "global_cap")}
    return window_admission(events, request="event_id", window="1 day", **limits)


def stream_admission(spark: SparkSession, folder: str) -> DataFrame:
    """The event log as a stream, every bucket of it."""
    tables = _run_folder(spark, "admission")
    schema = spark.read.parquet(f"{folder}/events.parquet").select("event_id", "user_id", "ts").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/events.parquet*")
    run_admission_counts(events, tables, "counts", **{k: ADMISSION[k] for k in ("ts", "client", "bucket")})
    return read_admission_counts(tables, "counts", ADMISSION["per_client"], ADMISSION["global_cap"])


def stream_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """The event log as a stream: the decisions of all buckets that its watermark has closed."""
    _ship(spark)
    tables = _run_folder(spark, "decisions")
    schema = spark.read.parquet(f"{folder}/events.parquet").select("event_id", "user_id", "ts").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/events.parquet*")
    run_decisions(events, tables, "decisions", request="event_id", lateness="1 hour", **ADMISSION)
    decided = read_decisions(spark, tables, "decisions", closed_only=True)
    return decided.select(
        F.col("request").alias("event_id"), F.col("client").cast("long").alias("user_id"), F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("bucket").cast("timestamp_ntz").alias("bucket"), "admitted",
    )


def _loaded(spark: SparkSession, folder: str) -> IncrementalLoad:
    """The panel delivered as one file per month, loaded in several batches; its end moves with each."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _loads:
        _loads[key] = _load(spark, folder)
    return _loads[key]


def _load(spark: SparkSession, folder: str) -> IncrementalLoad:
    tables = _run_folder(spark, "incremental")
    source = tables.path("landing")
    raw = raw_panel(spark, folder).withColumn("load_month", F.substring("fecha_dato", 1, 7))
    raw.repartition("load_month").write.partitionBy("load_month").parquet(source)
    load = IncrementalLoad(tables, ORDERS_SPEC, buckets=2)
    load.run(spark, source, tables.path("checkpoint"), files_per_batch=27)
    return load


def stream_incremental(spark: SparkSession, folder: str) -> DataFrame:
    return _loaded(spark, folder).tables.read("mart_adoption_curves")


def stream_incremental_cohorts(spark: SparkSession, folder: str) -> DataFrame:
    return _loaded(spark, folder).tables.read("mart_cohort_adoption")


def stream_incremental_customers(spark: SparkSession, folder: str) -> DataFrame:
    return _loaded(spark, folder).customers()


def _ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, wherever the program was started."""
    if spark.sparkContext.applicationId not in _shipped:
        _shipped.add(spark.sparkContext.applicationId)
        root = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="code-")), "cohortry")
        spark.sparkContext.addPyFile(shutil.make_archive(target, "zip", root, "cohortry"))


def _with_package(query: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        _ship(spark)
        return query(spark, folder)

    return run


def _llm_queries() -> dict[str, Query]:
    if llm is None:
        return {}
    return {name: _with_package(query) for name, query in {**llm.queries(), "pipeline": corpus_pipeline.run}.items()}


def queries() -> dict[str, Query]:
    return _llm_queries() | {
        "staging_clean": _table("panel"),
        "staging_bands": staging_bands,
        "ingest_strings": ingest_strings,
        "adoption_resolved": _table("resolved"),
        "dim_date": lambda spark, folder: _stored(spark, folder).dim_date,
        "dim_customer": _table("dim_customer"),
        "dim_channel": _table("dim_channel"),
        "fct_customer": _table("fct_customer"),
        "fct_customer_month": fct_customer_month,
        "warehouse_build": warehouse_build,
        "adoption_curves": _table("curves"),
        "adoption_curves_by_segment": _table("curves_by_segment"),
        "cohort_adoption": _table("cohort_adoption"),
        "m_cohort_size": _metric("cohort_size"),
        "m_adoption_rate_3": _metric("adoption_rate", Window.MSA_3),
        "m_adoption_rate_6": _metric("adoption_rate", Window.MSA_6),
        "m_adoption_rate_cohort": _metric("adoption_rate", Window.MSA_6, cohort="1995-05"),
        "m_adoption_rate_12": _metric("adoption_rate", Window.MSA_12),
        "m_adoption_rate_by_segment": _metric("adoption_rate", Window.MSA_6, dimension="segmento"),
        "m_adoption_rate_adjusted": _metric("adoption_rate_segment_adjusted", Window.MSA_6, 9),
        "m_adoption_rate_adjusted_3": _metric("adoption_rate_segment_adjusted", Window.MSA_3, 9),
        "m_adoption_rate_adjusted_12": _metric("adoption_rate_segment_adjusted", Window.MSA_12, 9),
        "m_time_to_adoption": _metric("time_to_adoption", Window.LIFETIME, 9),
        "m_retention_1m": _metric("retention_rate", Window.RET_1M, 9),
        "m_retention_2m": _metric("retention_rate", Window.RET_2M, 9),
        "m_retention_3m": _metric("retention_rate", Window.RET_3M, 9),
        "m_funnel_adopted": _metric("funnel_conversion", Window.ACQUIRED_TO_ADOPTED),
        "m_funnel_retained": _metric("funnel_conversion", Window.ADOPTED_TO_RETAINED),
        "m_segment_mix": m_segment_mix,
        "m_compare_cohorts": m_compare_cohorts,
        "guard_target": guard_target,
        "guard_censoring": guard_censoring,
        "guard_min_n": guard_min_n,
        "guard_deltas": guard_deltas,
        "guard_materiality": guard_materiality,
        "guard_findings": guard_findings,
        "guard_suppressed": guard_suppressed,
        "guard_critique": guard_critique,
        "guard_panel_gaps": guard_panel_gaps,
        "digest_tokens": digest_tokens,
        "digest_allowed": digest_allowed,
        "digest_faithfulness": digest_faithfulness,
        "digest_rows": digest_rows,
        "digest_json": digest_json,
        "digest_json_suppressed": digest_json_suppressed,
        "digest_json_notes": digest_json_notes,
        "digest_payload": digest_payload,
        "digest_upsert": digest_upsert,
        "digest_latest": digest_latest,
        "bi_curves": bi_curves,
        "bi_curves_censored": bi_curves_censored,
        "bi_funnel": bi_funnel,
        "bi_heatmap": bi_heatmap,
        "bi_heatmap_pivot": bi_heatmap_pivot,
        "dq_panel": dq_panel,
        "table_if_absent": table_if_absent,
        "view_of_table": view_of_table,
        "text_screen": text_screen,
        "text_screen_documents": text_screen_documents,
        "text_repeats": text_repeats,
        "text_repeats_documents": text_repeats_documents,
        "request_admission": request_admission,
        "request_admission_counts": request_admission_counts,
        "request_windows": request_windows,
        "stream_admission": stream_admission,
        "stream_decisions": stream_decisions,
        "stream_incremental": stream_incremental,
        "stream_incremental_cohorts": stream_incremental_cohorts,
        "stream_incremental_customers": stream_incremental_customers,
    }


def oracle_sql() -> dict[str, str]:
    own = oracles.oracle_sql()
    if llm is not None:
        own |= llm.oracle_sql()
        if corpus_pipeline.ORACLE_SQL is not None:
            own["pipeline"] = corpus_pipeline.ORACLE_SQL
    return own


def entry(spark: SparkSession) -> DataFrame:
    """Adoption six months after acquisition, per cohort, from the raw panel."""
    return _metric("adoption_rate", Window.MSA_6)(spark, "/root/testdata/sf0.001")
