import datetime as dt

import pytest

from cohortry.operators.staging import clean_panel
from cohortry.spec import RAW_COLUMNS, PanelSpec

SPEC = PanelSpec(dt.date(2015, 1, 1), dt.date(2016, 5, 1))
BASE = {name: "1" for name in RAW_COLUMNS.values()} | {
    "fecha_dato": "2015-01-28", "fecha_alta": "2014-12-09", "antiguedad": "6", "age": "35", "renta": "50000",
}


def clean(spark, *changes):
    schema = ", ".join(f"{name} string" for name in BASE)
    rows = [tuple((BASE | change).values()) for change in changes]
    return clean_panel(spark.createDataFrame(rows, schema), SPEC).collect()


@pytest.mark.parametrize(
    "text, value, band",
    [
        ("  35", 35, "35_44"), ("NA", None, "unknown"), (" NA ", None, "unknown"), ("", None, "unknown"), (None, None, "unknown"),
        ("abc", None, "65_plus"), ("35.0", None, "65_plus"), ("17", 17, "under_18"), ("18", 18, "18_24"), ("24", 24, "18_24"),
        ("25", 25, "25_34"), ("44", 44, "35_44"), ("45", 45, "45_54"), ("55", 55, "55_64"), ("65", 65, "65_plus"), ("\t35", 35, "35_44"),
    ],
)
def test_age(spark, text, value, band):
    row = clean(spark, {"age": text})[0]
    assert (row["age"], row["age_band"]) == (value, band)


@pytest.mark.parametrize(
    "text, value, band",
    [
        ("  29999.99", 29999.99, "low"), ("30000", 30000.0, "mid"), ("80000", 80000.0, "high"), ("150000", 150000.0, "very_high"),
        ("NA", None, "unknown"), ("", None, "unknown"), ("n/a", None, "very_high"), ("-5", -5.0, "low"), (None, None, "unknown"),
    ],
)
def test_income(spark, text, value, band):
    row = clean(spark, {"renta": text})[0]
    assert (row["income"], row["income_band"]) == (value, band)


def test_seniority_and_flags(spark):
    texts = ["     6", "-999999", "NA", "", "x", None, "0"]
    rows = clean(spark, *[{"antiguedad": t, "ind_tjcr_fin_ult1": t} for t in texts])
    assert [r["seniority_months"] for r in rows] == [6, None, None, None, None, None, 0]
    assert [r["card_flag"] for r in rows] == [6, -999999, None, None, None, None, 0]
    assert [r["card_flag_raw"] for r in rows] == texts


def test_dates(spark):
    rows = clean(spark, *[{"fecha_alta": t} for t in ("2015-02-17", "2015-13-01", "", None)])
    assert [r["acq_month"] for r in rows] == [dt.date(2015, 2, 1), None, None, None]
    assert rows[0]["fecha_alta"] == dt.date(2015, 2, 17)
    assert rows[0]["snapshot_month"] == dt.date(2015, 1, 28)


def test_rows_without_entity_or_snapshot_are_left_out(spark):
    assert len(clean(spark, {"ncodpers": None}, {"fecha_dato": None}, {})) == 1


@pytest.mark.parametrize("change", [{"ncodpers": "x7"}, {"fecha_dato": "28/01/2015"}])
def test_keys_must_parse(spark, change):
    with pytest.raises(Exception):
        clean(spark, change)


def test_schema(spark):
    frame = clean_panel(spark.createDataFrame([tuple(BASE.values())], ", ".join(f"{n} string" for n in BASE)), SPEC)
    types = {f.name: f.dataType.simpleString() for f in frame.schema}
    assert len(types) == 23
    assert types["customer_id"] == types["card_flag"] == "bigint"
    assert types["income"] == "double" and types["acq_month"] == "date"


def test_codes_are_trimmed(spark):
    row = clean(spark, {"segmento": " 01 - TOP ", "nomprov": "\tLUGO\n", "canal_entrada": None})[0]
    assert (row["segmento"], row["nomprov"], row["canal_entrada"]) == ("01 - TOP", "LUGO", None)
