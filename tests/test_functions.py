import random

from pyspark.sql import functions as F

from cohortry.functions.calendar import month_gap, month_key, month_label, parse_day, try_parse_day
from cohortry.functions.keys import surrogate_key
from cohortry.functions.rounding import round_rate, with_two_decimals
from cohortry.functions.text import figure_tokens, question_key, segment_name, strip
import pytest


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("r")).first()["r"]


def test_months_are_calendar_boundaries(spark):
    day = lambda name: F.col(name).cast("date")
    gap = month_gap(day("b"), day("a"))
    assert one(spark, gap, a="2015-01-28", b="2015-02-01") == 1
    assert one(spark, gap, a="2015-01-01", b="2015-01-31") == 0
    assert one(spark, gap, a="2016-02-29", b="2015-12-01") == -2
    assert one(spark, month_key(day("a")), a="2015-03-28") == 201503
    assert one(spark, month_label(day("a")), a="2015-03-28") == "2015-03"


@pytest.mark.parametrize("bad", ["2015-13-01", "2015-02", "2015-02-30", "20150201", "2015-02-01 x", "n/a", ""])
def test_unreadable_days(spark, bad):
    assert one(spark, try_parse_day(F.col("a")), a=bad) is None
    with pytest.raises(Exception):
        one(spark, parse_day(F.col("a")), a=bad)


def test_readable_days(spark):
    for text in ("2015-01-28", "2015-1-28"):
        assert str(one(spark, parse_day(F.col("a")), a=text)) == "2015-01-28"


def test_surrogate_key_marks_nulls(spark):
    import hashlib

    frame = spark.createDataFrame([("x", None), ("", "x")], "a string, b string")
    keys = [r[0] for r in frame.select(surrogate_key("a", "b")).collect()]
    assert keys == [hashlib.md5(t.encode()).hexdigest() for t in ("x|_null_", "|x")]


def test_rounding_agrees_with_the_exact_binary_value(spark):
    draw = random.Random(7)
    values = [0.125, 0.375, 1.005, 2.675, 0.285 * 100, 0.0, -0.004, -1.005, 100.0, 99.995, 1 / 3]
    values += [draw.uniform(-100, 100) for _ in range(2000)]
    values += [draw.randint(-100000, 100000) / 1000 for _ in range(4000)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    got = with_two_decimals(frame, {"t": "v"}).collect()
    assert [r["t"] for r in got] == [f"{v:.2f}" for v in values]


def test_rates_round_to_six_decimals(spark):
    draw = random.Random(8)
    values = [1 / 128, 3 / 128, -1 / 128, 0.0000005, 0.1234565] + [draw.uniform(-1, 1) for _ in range(2000)]
    values += [draw.randint(-10**7, 10**7) / 10**7 for _ in range(4000)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in frame.select(round_rate("v")).collect()] == [round(v, 6) for v in values]


def test_figures_of_a_sentence(spark):
    text = "Of 13,580 joining in 1997-08, some 7.25% took a card: 1.5 pp more than before."
    assert one(spark, figure_tokens(F.col("a")), a=text) == ["13580", "1997-08", "7.25%", "1.5pp"]
    assert one(spark, figure_tokens(F.col("a")), a="no figures") == []
    assert one(spark, figure_tokens(F.col("a")), a="Up 3 X from -1.5 BP and ٣%") == ["3x", "-1.5bp", "٣%"]


def test_text_helpers(spark):
    assert one(spark, strip(F.col("a")), a="\t  x y  \n") == "x y"
    assert one(spark, strip(F.col("a"), " "), a="  x ") == "x"
    assert one(spark, segment_name(F.col("a")), a=" 01 - TOP") == "TOP"
    assert one(spark, segment_name(F.col("a")), a="unknown") == "unknown"
    same = {one(spark, question_key(F.col("a")), a=t) for t in ("What is  the rate?", " what IS the\n rate? ")}
    assert same == {"what is the rate?"}
