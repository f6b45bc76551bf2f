import datetime as dt
import glob
import json
import tempfile

import pytest
from pyspark.sql import functions as F

from cohortry.operators import digest, guards
from cohortry.plans import digest_run
from tests.test_guards import cells, series, targets

SEEN = [("1997-08", "02 - RETAIL", 0.0725, 1358), ("1997-07", "02 - RETAIL", 0.0211, 1290), ("1997-08", "01 - TOP", 0.4, 7)]


@pytest.fixture(scope="module")
def records(spark):
    values = [("1997-07", 0.0211), ("1997-08", 0.0725)]
    return guards.critique(
        series(spark, values), cells(spark, SEEN), targets(spark, ("1997-08", "1997-07"))
    ).cache()


def allowed(records):
    column = digest.allowed_figures(F.col("cohort_month"), F.col("window"), F.col("findings"))
    return set(records.select(column.alias("a")).first()["a"])


def check(spark, text, figures):
    frame = spark.createDataFrame([(text, figures)], "t string, a array<string>")
    return frame.select(digest.check_figures(F.col("t"), F.col("a")).alias("c")).first()["c"]


def test_allowed_figures(records):
    assert allowed(records) == {"1997-08", "1997-07", "6", "7.25%", "2.11%", "5.14pp", "1358"}


def test_figures_must_be_allowed(spark):
    assert check(spark, "7.25% of 13,580 in 1997-08, up by 1.5 pp", ["1997-08", "7.25%", "13580", "1.5pp"])["faithful"]
    wrong = check(spark, "In 1997-08 it was 8.01%, then 7.2%, then 8.01% again", ["1997-08", "7.25%"])
    assert not wrong["faithful"] and wrong["violations"] == ["8.01%", "7.2%"]
    assert check(spark, "words alone", [])["faithful"]


def test_template_is_faithful_and_an_altered_figure_is_not(records):
    good = digest.write_digests(records).first()
    assert good["faithful"] and good["violations"] == []
    assert "7.25% against 2.11% for 1997-07, a change of 5.14pp" in good["prose"] and "Segment RETAIL" in good["prose"]
    bad = digest.write_digests(records, F.concat(F.lit("It is 3.3% in "), F.col("cohort_month"))).first()
    assert not bad["faithful"] and bad["violations"] == ["3.3%"]


def test_rows_and_their_json(records):
    row = digest.digest_rows(digest.write_digests(records), "r1").first()
    assert (row["cohort_month"], row["metric_window"], row["dbt_run_id"], row["material_findings"]) == (
        "1997-08", "msa_6", "r1", 2,
    )
    blended, segment = json.loads(row["findings_json"])
    assert blended["kind"] == "blended_delta" and "segment" not in blended and blended["materiality"]["sd"] is None
    assert segment["segment"] == "02 - RETAIL" and segment["n"] == 1358
    assert json.loads(row["suppressed_json"]) == [{"suppressed": True, "reason": "min_n", "segment": "01 - TOP", "n": 7}]
    assert json.loads(row["notes_json"]) == [guards.SHORT_HISTORY_NOTE]


def test_refused_and_unfaithful_digests_are_not_stored(spark, records):
    young = guards.critique(series(spark, [("2016-02", 0.1)]), cells(spark, SEEN), targets(spark, ("2016-03", "2016-02")))
    assert digest.digest_rows(digest.write_digests(young), "r1").isEmpty()
    assert digest.digest_rows(digest.write_digests(records, F.lit("It is 77% now.")), "r1").isEmpty()


def test_payload_shows_no_raw_numbers(records):
    payload = json.loads(digest.display_payload(records).first()["payload"])
    assert payload["suppressed"] == [{"reason": "min_n", "segment": "TOP"}]
    assert payload["findings"][1] == {
        "change_type": "segment_delta", "material": True, "segment": "RETAIL", "cohort": "1997-08", "prior_cohort": "1997-07",
        "adoption_rate": "7.25%", "prior_adoption_rate": "2.11%", "change_pp": "5.14pp", "cohort_cell_size": 1358,
    }


def rows_for(spark, *keys):
    rows = [(c, w, run, dt.datetime(2020, 1, day), text, True, 0, "[]", "[]", "[]") for c, w, run, day, text in keys]
    return spark.createDataFrame(rows, digest.DIGEST_SCHEMA)


def test_upsert_key_leaves_out_the_window(spark):
    path = tempfile.mkdtemp(prefix="run-") + "/digests"
    assert digest.read_digests(spark, path).isEmpty()
    digest.upsert_digests(spark, path, rows_for(spark, ("2015-10", "msa_6", "r1", 1, "a"), ("2015-11", "msa_6", "r1", 2, "b")))
    digest.upsert_digests(spark, path, rows_for(spark, ("2015-11", "msa_3", "r1", 3, "c"), ("2015-11", "msa_6", "r2", 4, "d")))
    got = {(r["cohort_month"], r["dbt_run_id"]): (r["metric_window"], r["prose"]) for r in digest.read_digests(spark, path).collect()}
    assert got == {("2015-10", "r1"): ("msa_6", "a"), ("2015-11", "r1"): ("msa_3", "c"), ("2015-11", "r2"): ("msa_6", "d")}
    assert digest.latest_digest(digest.read_digests(spark, path)).first()["prose"] == "d"
    assert digest.latest_digest(digest.read_digests(spark, path), "msa_12").isEmpty()


def test_an_upsert_that_fails_leaves_the_digests_and_writes_no_folder_per_cohort(spark):
    path = tempfile.mkdtemp(prefix="run-") + "/digests"
    digest.upsert_digests(spark, path, rows_for(spark, *[(f"2015-{m:02d}", "msa_6", "r1", 1, "a") for m in range(1, 13)]))
    broken = rows_for(spark, ("2015-10", "msa_6", "r1", 5, "b")).withColumn("prose", F.expr("raise_error('half-way')"))
    with pytest.raises(Exception, match="half-way"):
        digest.upsert_digests(spark, path, broken)
    assert {r["prose"] for r in digest.read_digests(spark, path).collect()} == {"a"}
    digest.upsert_digests(spark, path, rows_for(spark, ("2015-10", "msa_3", "r1", 1, "c")))
    rows = {r["cohort_month"]: r["prose"] for r in digest.read_digests(spark, path).collect()}
    assert len(rows) == 12 and rows["2015-10"] == "c"
    assert not glob.glob(f"{path}/**/cohort_month=*", recursive=True)


def test_run_and_store(spark, launch):
    path = tempfile.mkdtemp(prefix="run-") + "/digests"
    assert digest_run.run_and_store(spark, launch, path, "r1").startswith("stored 1995-11")
    assert digest_run.run_and_store(spark, launch, path, "r1", cohort="1996-03").startswith("not stored")
    assert digest_run.run_and_store(spark, launch, path, "r1", cohort="1995-05").startswith("stored 1995-05")
    stored = {r["cohort_month"]: r["material_findings"] for r in digest.read_digests(spark, path).collect()}
    assert stored == {"1995-11": 0, "1995-05": 2}
    named = digest_run.review(launch, cohort="1995-05", prior_cohort="1995-01").first()
    assert [f["prior_cohort"] for f in named["findings"]] == ["1995-04", "1995-01"]
