"""Digest rows: figures a text may use, the check that it uses no others, and the table of digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.functions.text import SHOWN, figure_tokens, plain_token, segment_name
from cohortry.sources.tables import publish, read_or_none

# The layout of the digest table.
DIGEST_SCHEMA = T.StructType(
    [
        T.StructField("cohort_month", T.StringType()),
        T.StructField("metric_window", T.StringType()),
        T.StructField("dbt_run_id", T.StringType()),
        T.StructField("generated_at", T.TimestampType()),
        T.StructField("prose", T.StringType()),
        T.StructField("faithful", T.BooleanType()),
        T.StructField("material_findings", T.LongType()),
        T.StructField("findings_json", T.StringType()),
        T.StructField("suppressed_json", T.StringType()),
        T.StructField("notes_json", T.StringType()),
    ]
)
DIGEST_KEY = ("cohort_month", "dbt_run_id")


def _figures_of(finding: Column) -> Column:
    """Figures that one finding allows; entries may be NULL."""
    return F.array(
        plain_token(finding["cohort"]),
        plain_token(finding["prior_cohort"]),
        *[finding[name] for name in SHOWN],
        finding["n"].cast("string"),
    )


def allowed_figures(cohort: Column, window: Column, findings: Column) -> Column:
    """Every figure a text about the findings may state, in plain form."""
    from_window = F.regexp_extract_all(window, F.lit(r"(?U)\d+"), F.lit(0))
    from_findings = F.flatten(F.transform(findings, _figures_of))
    listed = F.concat(F.array(plain_token(cohort)), from_window, from_findings)
    return F.array_distinct(F.array_compact(listed))


def check_figures(text: Column, allowed: Column) -> Column:
    """Struct (faithful, violations): figures of the text that are not allowed, first seen first."""
    wrong = F.array_except(figure_tokens(text), F.transform(allowed, plain_token))
    return F.struct((F.size(wrong) == 0).alias("faithful"), wrong.alias("violations"))


def _shown_finding(finding: Column) -> Column:
    """A finding as display text; raw numbers other than the cell size do not get out."""
    return F.struct(
        finding["kind"].alias("change_type"),
        finding["material"].alias("material"),
        segment_name(finding["segment"]).alias("segment"),
        finding["cohort"].alias("cohort"),
        finding["prior_cohort"].alias("prior_cohort"),
        finding["shown_value"].alias("adoption_rate"),
        finding["shown_prior"].alias("prior_adoption_rate"),
        finding["shown_delta"].alias("change_pp"),
        finding["n"].alias("cohort_cell_size"),
    )


def _shown_suppressed(record: Column) -> Column:
    return F.struct(
        record["reason"].alias("reason"),
        segment_name(record["segment"]).alias("segment"),
        record["cohort"].alias("cohort"),
    )


def display_payload(records: DataFrame) -> DataFrame:
    """Per critique record the JSON a writer may see. Absent values are left out of the JSON."""
    payload = F.struct(
        "cohort_month",
        F.col("window").alias("observation_window"),
        F.transform("findings", _shown_finding).alias("findings"),
        F.transform("suppressed", _shown_suppressed).alias("suppressed"),
        "notes",
    )
    return records.select("cohort_month", "window", F.to_json(payload).alias("payload"))


def _sentence(finding: Column) -> Column:
    subject = F.coalesce(F.concat(F.lit("Segment "), segment_name(finding["segment"])), F.lit("The whole cohort"))
    return F.concat(
        subject,
        F.lit(" stands at "),
        finding["shown_value"],
        F.lit(" against "),
        finding["shown_prior"],
        F.lit(" for "),
        finding["prior_cohort"],
        F.lit(", a change of "),
        finding["shown_delta"],
        F.lit("."),
    )


def template_prose(cohort: Column, findings: Column) -> Column:
    """A fixed sentence per material finding. Says what changed and by how much, never why."""
    material = F.filter(findings, lambda f: f["material"])
    sentences = F.when(F.size(material) > 0, F.array_join(F.transform(material, _sentence), " ")).otherwise(
        F.lit("No change is material.")
    )
    return F.concat(F.lit("Cohort "), cohort, F.lit(": "), sentences)


def write_digests(records: DataFrame, prose: Column | None = None) -> DataFrame:
    """Adds prose and its figure check to critique records that passed their gate; others get none."""
    text = template_prose(F.col("cohort_month"), F.col("findings")) if prose is None else prose
    allowed = allowed_figures(F.col("cohort_month"), F.col("window"), F.col("findings"))
    written = records.select("*", F.when(F.col("critic_passed"), text).alias("prose"))
    checked = written.withColumn("_check", F.when(F.col("critic_passed"), check_figures(F.col("prose"), allowed)))
    return checked.select("*", F.col("_check.faithful").alias("faithful"), F.col("_check.violations").alias("violations")).drop(
        "_check"
    )


def _fields(item: Column, names: list[str]) -> Column:
    return F.struct(*[item[n].alias(n) for n in names])


BLENDED_FIELDS = ["kind", "metric", "window", "cohort", "prior_cohort", "value", "prior_value", "delta", "material", "materiality"]
SEGMENT_FIELDS = [
    "kind", "metric", "window", "segment", "cohort", "prior_cohort", "value", "prior_value", "n", "delta",
    "material", "materiality",
]


def _findings_json(findings: Column) -> Column:
    """JSON list; the keys depend on the kind of a finding, and NULLs are written out."""
    keep = {"ignoreNullFields": "false"}
    texts = F.transform(
        findings,
        lambda f: F.when(f["segment"].isNull(), F.to_json(_fields(f, BLENDED_FIELDS), keep)).otherwise(
            F.to_json(_fields(f, SEGMENT_FIELDS), keep)
        ),
    )
    return F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))


def _suppressed_json(records: Column) -> Column:
    keep = {"ignoreNullFields": "false"}
    texts = F.transform(
        records,
        lambda s: F.when(
            s["reason"] == "min_n",
            F.to_json(
                F.struct(
                    F.lit(True).alias("suppressed"),
                    s["reason"].alias("reason"),
                    s["segment"].alias("segment"),
                    s["n"].alias("n"),
                ),
                keep,
            ),
        ).otherwise(F.to_json(F.struct(s["reason"].alias("reason"), s["cohort"].alias("cohort")), keep)),
    )
    return F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))


def digest_rows(digests: DataFrame, run_id: Column | str, generated_at: Column | None = None) -> DataFrame:
    """Rows for the digest table. Refused cohorts and texts with wrong figures never become rows."""
    run = F.lit(run_id) if isinstance(run_id, str) else run_id
    stamp = F.current_timestamp() if generated_at is None else generated_at
    return digests.filter(F.col("critic_passed") & F.col("faithful")).select(
        "cohort_month",
        F.col("window").alias("metric_window"),
        run.alias("dbt_run_id"),
        stamp.cast("timestamp").alias("generated_at"),
        "prose",
        "faithful",
        F.size(F.filter("findings", lambda f: f["material"])).cast("bigint").alias("material_findings"),
        _findings_json(F.col("findings")).alias("findings_json"),
        _suppressed_json(F.col("suppressed")).alias("suppressed_json"),
        F.to_json("notes").alias("notes_json"),
    )


def newest_per_key(rows: DataFrame, *first: str) -> DataFrame:
    """One row per key: the greatest by ``first``, then the one written last (by window name if written together)."""
    values = [c for c in rows.columns if c not in DIGEST_KEY]
    latest = F.max_by(F.struct(*values), F.struct(*first, "generated_at", "metric_window")).alias("row")
    return rows.groupBy(*DIGEST_KEY).agg(latest).select(*DIGEST_KEY, "row.*").select(*rows.columns)


def merge_digests(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` replace rows of the same cohort and run, whatever their window and time."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return newest_per_key(both, "_new").drop("_new")


def upsert_digests(spark: SparkSession, path: str, new: DataFrame) -> None:
    """Merge into the table at ``path``, created when absent.

    A digest is a few hundred rows a run, so the table is replaced as a whole, by one aggregate of old and new rows:
    readers see the rows before or the rows after, and of two runs at once the second fails and is repeated.
    """
    existing = read_or_none(spark, path, DIGEST_SCHEMA)
    rows = new.select(*DIGEST_SCHEMA.names)
    publish(newest_per_key(rows) if existing is None else merge_digests(existing.select(*DIGEST_SCHEMA.names), rows), path)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """The digest table; empty when it has not been written yet."""
    table = read_or_none(spark, path, DIGEST_SCHEMA)
    if table is None:
        return spark.createDataFrame([], DIGEST_SCHEMA)
    return table.select(*DIGEST_SCHEMA.names)


def latest_digest(digests: DataFrame, window: str = "msa_6") -> DataFrame:
    """The newest faithful digest of a window: one row, or none."""
    return (
        digests.filter((F.col("metric_window") == window) & F.col("faithful"))
        .orderBy(F.desc("generated_at"), F.desc("cohort_month"))
        .limit(1)
    )
