import datetime as dt
import random

from cohortry.operators.marts import adoption_curves, cohort_adoption
from cohortry.operators.model import fct_customer, fct_customer_month
from cohortry.operators.resolve import ATTRIBUTES, resolve_adoption
from cohortry.spec import PanelSpec

SPEC = PanelSpec(dt.date(2015, 1, 1), dt.date(2016, 5, 1))
SCHEMA = (
    "customer_id long, snapshot_month date, acq_month date, card_flag long, income double, age long, "
    + ", ".join(f"{c} string" for c in ATTRIBUTES)
)


def day(year, month, day_=28):
    return dt.date(year, month, day_)


def row(customer, snapshot, flag, acquired=dt.date(2015, 1, 1), segment="01 - TOP", income_band="mid"):
    return (customer, snapshot, acquired, flag, 1.0, 30, segment, "KAT", "1", "LUGO", income_band, "25_34")


def resolve(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    return {r["customer_id"]: r for r in resolve_adoption(frame, SPEC).collect()}


def test_observed_flip_and_retention(spark):
    r = resolve(spark, [row(1, day(2015, m), f) for m, f in [(1, 0), (2, 0), (3, 1), (4, 1), (5, 0), (6, 1)]])[1]
    assert r["first_card_month"] == day(2015, 3)
    assert r["is_adopted_clean"] and r["is_adopted_observed"] and not r["is_left_censored_card"]
    assert r["months_to_adoption"] == 2
    assert (r["retained_1m"], r["retained_2m"], r["retained_3m"]) == (True, False, True)
    assert not r["has_panel_gaps"] and r["is_within_panel_cohort"] and not r["is_right_censored"]


def test_missing_later_snapshot_is_not_retained(spark):
    r = resolve(spark, [row(1, day(2015, 1), 0), row(1, day(2015, 2), 1)])[1]
    assert (r["retained_1m"], r["retained_2m"], r["retained_3m"]) == (False, False, False)


def test_holder_at_first_sight_is_left_censored(spark):
    r = resolve(spark, [row(1, day(2015, 1), 1), row(1, day(2015, 2), 1)])[1]
    assert r["is_left_censored_card"] and not r["is_adopted_clean"]
    assert r["months_to_adoption"] is None and r["retained_1m"] is None


def test_never_flagged(spark):
    r = resolve(spark, [row(1, day(2015, 1), 0), row(1, day(2015, 2), None)])[1]
    assert r["first_card_month"] is None
    assert r["is_adopted_clean"] is False and r["is_left_censored_card"] is False and r["retained_1m"] is None


def test_retention_needs_the_exact_day(spark):
    r = resolve(spark, [row(1, day(2015, 1), 0), row(1, day(2015, 2), 1), row(1, day(2015, 3, 27), 1)])[1]
    assert r["retained_1m"] is False
    r = resolve(spark, [row(1, day(2014, 12, 31), 0), row(1, day(2015, 1, 31), 1), row(1, day(2015, 2, 28), 1)])[1]
    assert r["retained_1m"] is True


def test_gap_counts_calendar_months(spark):
    assert resolve(spark, [row(1, day(2015, 1), 0), row(1, day(2015, 3), 0)])[1]["has_panel_gaps"]
    assert not resolve(spark, [row(1, day(2015, 1), 0), row(1, dt.date(2015, 2, 1), 0)])[1]["has_panel_gaps"]


def test_cohort_bounds(spark):
    months = [dt.date(2014, 12, 1), dt.date(2015, 1, 1), dt.date(2015, 11, 1), dt.date(2015, 12, 1), dt.date(2016, 6, 1), None]
    got = resolve(spark, [row(i, day(2015, 5), 0, acquired=m) for i, m in enumerate(months)])
    assert [got[i]["is_within_panel_cohort"] for i in range(6)] == [False, True, True, True, False, False]
    assert [got[i]["is_right_censored"] for i in range(6)] == [False, False, False, True, True, None]


def test_attributes_collapse_to_the_alphabetical_maximum(spark):
    rows = [row(1, day(2015, m), 0, income_band=b) for m, b in [(1, "mid"), (2, "unknown"), (3, "high")]]
    assert resolve(spark, rows)[1]["income_band"] == "unknown"


def test_against_plain_python(spark):
    draw = random.Random(3)
    months = [dt.date(2015 + i // 12, i % 12 + 1, 28) for i in range(17)]
    rows, seen = [], {}
    for customer in range(300):
        snapshots = sorted(draw.sample(range(17), draw.randint(1, 17)))
        acquired = draw.choice([None, dt.date(2014, 11, 1), *[dt.date(m.year, m.month, 1) for m in months]])
        segment = draw.choice([None, "01 - TOP", "02 - RETAIL"])
        flags = {i: int(draw.random() < 0.2) for i in snapshots}
        seen[customer] = (acquired, segment, flags)
        rows += [row(customer, months[i], flags[i], acquired, segment) for i in snapshots]
    frame = spark.createDataFrame(rows, SCHEMA)
    resolved = resolve_adoption(frame, SPEC).cache()
    got = {r["customer_id"]: r for r in resolved.collect()}
    number = lambda d: (d.year - 2015) * 12 + d.month - 1
    curve, summary = {}, {}
    for customer, (acquired, segment, flags) in seen.items():
        r = got[customer]
        first = min((i for i, f in flags.items() if f), default=None)
        start = min(flags)
        clean = first is not None and first > start
        assert r["is_adopted_clean"] == clean
        assert r["is_left_censored_card"] == (first == start)
        assert r["has_panel_gaps"] == (len(flags) < max(flags) - start + 1)
        for n in (1, 2, 3):
            assert r[f"retained_{n}m"] == ((flags.get(first + n) == 1) if clean else None)
        wait = first - number(acquired) if clean and acquired else None
        assert r["months_to_adoption"] == wait
        if acquired is None or acquired < SPEC.panel_start:
            continue
        key = (acquired, segment or "unknown")
        summary.setdefault(key, []).append(wait if clean else None)
        for age in range(18):
            cell = curve.setdefault((*key, age), [0, 0])
            cell[0] += 1
            cell[1] += int(clean and wait <= age)
    facts = fct_customer(resolved)
    by_segment = {
        (r["acq_month"], r["segmento"], r["msa"]): [r["n_observed"], r["n_adopted_clean"]]
        for r in adoption_curves(facts, SPEC, ["segmento"]).collect()
    }
    assert by_segment == curve
    blended = adoption_curves(facts, SPEC).collect()
    for r in blended:
        parts = [v for (m, _, age), v in curve.items() if (m, age) == (r["acq_month"], r["msa"])]
        assert [r["n_observed"], r["n_adopted_clean"]] == [sum(p[0] for p in parts), sum(p[1] for p in parts)]
        assert r["is_cell_right_censored"] == (number(r["acq_month"]) + r["msa"] > 16) != r["fully_observed_n"]
    for r in cohort_adoption(facts, SPEC).collect():
        waits = summary[(r["acq_month"], r["segmento"])]
        adopted = [w for w in waits if w is not None]
        assert (r["cohort_size"], r["n_adopted"]) == (len(waits), len(adopted))
        assert r["min_months_to_adoption"] == min(adopted, default=None)


def test_one_entity_with_most_rows_stays_small(spark):
    """A hot entity is combined before the shuffle: one row per map task leaves for it."""
    hot = spark.range(200_000, numPartitions=8).selectExpr(
        "7L as customer_id", "date_add(date'2015-01-28', cast(id % 400 as int)) as snapshot_month",
        "date'2015-01-01' as acq_month", "cast(id % 400 = 40 as long) as card_flag", "1D as income", "30L as age",
        *[f"'x' as {c}" for c in ATTRIBUTES],
    )
    resolved = resolve_adoption(hot, SPEC)
    row_ = resolved.first()
    assert row_["n_snapshots_observed"] == 200_000 and row_["is_adopted_clean"]
    plan = resolved._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and plan.count("Exchange hashpartitioning") == 1


def test_row_age_uses_the_row_not_the_entity(spark):
    rows = [row(1, day(2015, 3), 0, dt.date(2015, 4, 1)), row(1, day(2015, 4), 0, dt.date(2015, 1, 1)), row(2, day(2015, 4), 0, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    facts = {(r["customer_id"], r["snapshot_month"]): r for r in fct_customer_month(frame, resolve_adoption(frame, SPEC)).collect()}
    assert facts[1, day(2015, 3)]["msa"] == -1 and facts[1, day(2015, 4)]["msa"] == 3
    assert facts[2, day(2015, 4)]["msa"] is None and facts[2, day(2015, 4)]["acq_month"] is None
