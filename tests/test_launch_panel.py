"""The seventeen-month panel against its published profile."""

import pytest

from cohortry.plans.catalog import Catalog, explain_metric, list_metrics
from cohortry.spec import MetricError, Window


def test_profile(launch):
    assert launch.panel.count() == 3023
    profile = launch.fct_customer.selectExpr(
        "count(*)", "count_if(is_within_panel_cohort)", "count_if(acq_month is null)",
        "count_if(acq_month < date'1995-01-01')", "count_if(has_panel_gaps)", "count_if(is_adopted_clean)",
        "count_if(is_left_censored_card)", "min(months_to_adoption)", "max(months_to_adoption)",
    ).first()
    assert tuple(profile) == (1333, 1161, 15, 157, 859, 321, 545, 1, 17)


def test_blended_rates(launch):
    rows = Catalog(launch).query_metric("adoption_rate", "msa_6").collect()
    assert [(r["cohort"], round(r["value"], 4)) for r in rows] == [
        ("1995-01", 0.1346), ("1995-02", 0.1385), ("1995-03", 0.1181), ("1995-04", 0.0792), ("1995-05", 0.2043),
        ("1995-06", 0.1354), ("1995-07", 0.1176), ("1995-08", 0.2000), ("1995-09", 0.1692), ("1995-10", 0.1277),
        ("1995-11", 0.1538),
    ]


def test_curves_rise_and_stay_within_bounds(launch):
    by_cohort = {}
    for r in launch.curves.orderBy("acq_month", "msa").collect():
        by_cohort.setdefault(r["acq_month"], []).append(r)
    for rows in by_cohort.values():
        assert [r["msa"] for r in rows] == list(range(18))
        assert len({r["n_observed"] for r in rows}) == 1
        rates = [r["adoption_rate"] for r in rows]
        assert rates == sorted(rates) and 0 <= rates[0] and rates[-1] <= 1


def test_shares_add_up(launch):
    for r in Catalog(launch).query_metric("segment_mix").collect():
        assert sum(part["share"] for part in r["breakdown"]) == pytest.approx(1)
        assert [p["dimension"] for p in r["breakdown"]] == sorted(p["dimension"] for p in r["breakdown"])


def test_adjusted_rate_equals_blended_rate_for_the_pooled_mix(spark, launch):
    """Every cohort given the same mix: standardising changes nothing."""
    from types import SimpleNamespace

    cells = launch.curves_by_segment.selectExpr(
        "acq_month", "segmento", "msa", "100L as n_observed", "n_adopted_clean", "is_cell_right_censored",
        "n_adopted_clean / 100D as adoption_rate",
    )
    marts = SimpleNamespace(
        curves_by_segment=cells,
        curves=cells.groupBy("acq_month", "msa", "is_cell_right_censored").agg(
            {"n_observed": "sum", "n_adopted_clean": "sum"}
        ).withColumnsRenamed({"sum(n_observed)": "n_observed", "sum(n_adopted_clean)": "n_adopted_clean"}),
    )
    catalog = Catalog(marts)
    plain = {r["cohort"]: r["value"] for r in catalog.query_metric("adoption_rate", "msa_6").collect()}
    adjusted = {r["cohort"]: r["value"] for r in catalog.query_metric("adoption_rate_segment_adjusted", "msa_6").collect()}
    assert adjusted == pytest.approx(plain)


@pytest.mark.parametrize(
    "call, code",
    [
        (("churn",), "metric_unknown"),
        (("adoption_rate", "msa_7"), "window_unknown"),
        (("adoption_rate",), "window_unsupported"),
        (("cohort_size", "msa_6"), "window_unsupported"),
        (("adoption_rate", "msa_6", None, "canal"), "dimension_unknown"),
        (("cohort_size", "lifetime", None, "segmento"), "dimension_unsupported"),
        (("adoption_rate", "msa_6", "1989-12"), "cohort_unknown"),
        (("adoption_rate", "msa_12", "1995-11"), "cohort_unknown"),
        (("adoption_rate", "msa_7", "1989-12", "canal"), "window_unknown"),
    ],
)
def test_refused_calls(launch, call, code):
    with pytest.raises(MetricError) as error:
        Catalog(launch).query_metric(*call)
    assert error.value.code == code and error.value.as_dict()["error"]["code"] == code


def test_compare(launch):
    catalog = Catalog(launch)
    row = catalog.compare_cohorts("1995-05", "1995-04", "adoption_rate", Window.MSA_6).first()
    assert row["difference"] == pytest.approx(row["value_a"] - row["value_b"]) and round(row["value_a"], 4) == 0.2043
    same = catalog.compare_cohorts("1995-05", "1995-05", "cohort_size").first()
    assert same["difference"] == 0
    for call, code in [
        (("1995-05", "1995-04", "segment_mix", "msa_7"), "metric_not_comparable"),
        (("1995-05", "1989-12", "adoption_rate", "msa_6"), "cohort_unknown"),
        (("1995-05", "1995-04", "adoption_rate", "ret_1m"), "window_unsupported"),
    ]:
        with pytest.raises(MetricError) as error:
            catalog.compare_cohorts(*call)
        assert error.value.code == code


def test_catalogue():
    assert [m["id"] for m in list_metrics()] == [
        "cohort_size", "adoption_rate", "adoption_rate_segment_adjusted", "time_to_adoption", "retention_rate",
        "funnel_conversion", "segment_mix",
    ]
    assert explain_metric("adoption_rate")["caveats"] and "caveats" not in list_metrics()[0]
    assert explain_metric("retention_rate")["valid_windows"] == ["ret_1m", "ret_2m", "ret_3m"]
    with pytest.raises(MetricError):
        explain_metric("revenue")
