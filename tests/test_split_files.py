import random
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.sources.delimited import BAD_RECORD, count_bad_records, read_all_string
from cohortry.sources.records import headers_of, names_in, quoted_records, states_after

COLUMNS = ["a", "b", "c"]


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="run-")


@pytest.fixture()
def small_splits(spark):
    """Files of a few hundred bytes become many splits."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "61")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def by_one_task(spark, path):
    """(rows, malformed) as Spark reads a file that it does not split."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*COLUMNS, BAD_RECORD]])
    rows = (
        spark.read.schema(schema).option("header", True).option("multiLine", True).option("columnNameOfCorruptRecord", BAD_RECORD)
        .option("columnPruning", False).option("quote", '"').option("escape", '"').option("nullValue", "\x00").csv(path).collect()
    )
    good = [tuple(r)[:3] for r in rows if r[BAD_RECORD] is None]
    return good, len(rows) - len(good)


def by_many_tasks(spark, path):
    rows = [tuple(r) for r in read_all_string(spark, path, max_bad=10**6).collect()]
    return rows, count_bad_records(spark, path)


def in_order(rows):
    return sorted(rows, key=str)


def random_file(rng, end):
    plain = ["", "x", " 7 ", "NA", 'st"ray', "ñandú", "12.5", " led"]
    wrapped = ["", "a,b", 'say ""no""', f"one{end}two", f"{end}", f'"",{end}""x', f"long {end}{end}" + "y" * 90, "q"]
    rows = ["a,b,c"]
    for _ in range(rng.randrange(1, 60)):
        n = rng.choice([3] * 12 + [1, 2, 4])
        fields = [rng.choice(plain) if rng.random() < 0.5 else f'"{rng.choice(wrapped)}"' for _ in range(n)]
        if rng.random() < 0.1:
            fields[0] = f'"{rng.choice(["shut", "a,b"])}"then'
        rows.append(",".join(fields))
        if rng.random() < 0.1:
            rows.append("")
    return end.join(rows) + (end if rng.random() < 0.5 else "")


@pytest.mark.parametrize("seed", range(6))
def test_many_tasks_read_a_quoted_file_as_one_task_does(spark, folder, small_splits, seed):
    rng = random.Random(seed)
    path = f"{folder}/t.csv"
    with open(path, "w", newline="") as file:
        file.write(random_file(rng, "\r\n" if seed % 3 == 2 else "\n"))
    splits = spark.read.text(path).select("_metadata.file_block_start").distinct().count()
    got, want = by_many_tasks(spark, path), by_one_task(spark, path)
    assert in_order(got[0]) == in_order(want[0]) and got[1] == want[1] and splits > 1


def test_a_field_over_many_splits_and_one_that_is_never_closed(spark, folder, small_splits):
    long = "\n".join(f"line {k}, still inside" for k in range(60))
    text = f'a,b,c\n1,"{long}",x\n2,y,z\n3,"{long}\n4,u,"v\n5,r,s\n'
    with open(f"{folder}/t.csv", "w") as file:
        file.write(text)
    got, want = by_many_tasks(spark, f"{folder}/t.csv"), by_one_task(spark, f"{folder}/t.csv")
    assert in_order(got[0]) == in_order(want[0]) and got[1] == want[1]
    assert ("1", long, "x") in got[0] and ("2", "y", "z") in got[0]


def test_a_record_over_the_limit_is_malformed_and_the_others_stay(spark, folder, small_splits):
    text = 'a,b,c\n1,"' + "\n".join(["inside"] * 40) + '",x\n2,y,z\n' + f"3,{'w' * 300},x\n4,y,\"z\nz\"\n"
    with open(f"{folder}/t.csv", "w") as file:
        file.write(text)
    records = [r["record"] for r in quoted_records(spark, [f"{folder}/t.csv"], limit=200).collect()]
    assert {r for r in records if r} == {"2,y,z", '4,y,"z\nz"'} and records.count(None) == 2


def test_a_header_over_two_lines_and_splits(spark, folder, small_splits):
    with open(f"{folder}/t.csv", "w") as file:
        file.write('"first\n' + "n" * 80 + '","b,\n' + "m" * 80 + '",c\n1,"2\n2",3\n')
    assert [tuple(r) for r in read_all_string(spark, f"{folder}/t.csv").collect()] == [("1", "2\n2", "3")]
    assert names_in('"x, y" , "z",w\r') == ["x, y", "z", "w"]


def test_headers_of_all_files_by_one_job(spark, folder):
    for k in range(40):
        with open(f"{folder}/{k}.csv", "w") as file:
            file.write(('"a, of all",b\n' if k % 2 else 'b,"a, of all"\n') + f"{k},{k}\n" * 50)
    group = "headers of one test"
    spark.sparkContext.setJobGroup(group, group)
    headers = headers_of(spark, folder + "/*.csv")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(headers) == 40 and len(jobs) <= 2
    assert {tuple(names_in(h)) for h in headers.values()} == {("a, of all", "b"), ("b", "a, of all")}
    frame = read_all_string(spark, folder + "/*.csv")
    assert set(frame.columns) == {"a, of all", "b"} and frame.count() == 2000


def test_files_are_read_in_groups_where_they_have_many_splits(spark, folder, small_splits):
    for k in range(5):
        with open(f"{folder}/{k}.csv", "w") as file:
            file.write("a,b,c\n" + f'{k},"x\n{k}",y\n' * 20)
    files = list(headers_of(spark, folder + "/*.csv"))
    whole = [r["record"] for r in quoted_records(spark, files).collect()]
    parts = [r["record"] for r in quoted_records(spark, files, most_splits=8).collect()]
    assert sorted(parts) == sorted(whole) and len(whole) == 100


def test_splits_that_changed_between_the_passes_are_noticed(spark, folder, small_splits):
    with open(f"{folder}/t.csv", "w") as file:
        file.write("a,b,c\n" + '1,"x\ny",y\n' * 60)
    records = quoted_records(spark, [f"{folder}/t.csv"])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    with pytest.raises(Exception, match="split otherwise"):
        records.collect()


def test_files_without_a_line_are_no_files(spark, folder):
    open(f"{folder}/t.csv", "w").close()
    with pytest.raises(ValueError, match="no files"):
        read_all_string(spark, f"{folder}/t.csv")
    with open(f"{folder}/u.csv", "w") as file:
        file.write("a,b,c\n1,2,3\n")
    assert read_all_string(spark, folder + "/*.csv").count() == 1


def test_each_record_is_parsed_once(spark, folder):
    with open(f"{folder}/t.csv", "w") as file:
        file.write("a,b,c\n1,2,3\n")
    frame = read_all_string(spark, f"{folder}/t.csv").filter(F.col("a") == "1").select("a")
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("from_csv") == 1
    assert frame.count() == 1


def test_states_of_lines_by_prefix_and_by_walk():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(200):
        outside, inside = rng.random(9) < 0.5, rng.random(9) < 0.5
        for begin in (False, True):
            state, want = begin, []
            for o, i in zip(outside, inside, strict=True):
                state = bool(i if state else o)
                want.append(state)
            assert states_after(begin, outside, inside).tolist() == want
