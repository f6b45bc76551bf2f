import datetime as dt
import glob
import os
import tempfile
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cohortry.operators.requests import admission_counts
from cohortry.plans.warehouse import QualityError, Warehouse, build
from cohortry.sources.delimited import count_bad_records, header_names, read_all_string
from cohortry.sources import tables as module
from cohortry.sources.orders_panel import raw_panel
from cohortry.sources.tables import TableSet, replace_partitions, settle, shared_folder
from cohortry.operators.staging import clean_panel
from cohortry.streaming import incremental
from cohortry.streaming.admission import read_admission_counts, run_admission_counts
from cohortry.streaming.incremental import IncrementalLoad, one_per_key

LINES = '"a" , b,c\n1,"",x\n2,,y\n3,"q ""in"" q","line1\nline2"\n 4 ,NA,  7\n5,too,many,fields\n6,few\n'


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="run-")


def test_delimited_files_stay_text(spark, folder):
    path = folder + "/t.csv"
    with open(path, "w") as file:
        file.write(LINES)
    assert header_names(spark, path) == ["a", "b", "c"]
    assert count_bad_records(spark, path) == 2
    frame = read_all_string(spark, path)
    assert [tuple(r) for r in frame.collect()] == [
        ("1", "", "x"), ("2", None, "y"), ("3", 'q "in" q', "line1\nline2"), (" 4 ", "NA", "  7"),
    ]
    assert {f.dataType.simpleString() for f in frame.schema} == {"string"}
    with pytest.raises(ValueError):
        read_all_string(spark, path, max_bad=1)


def test_malformed_rows_are_counted_while_reading(spark, folder):
    from cohortry.sources.delimited import read_and_observe, require_few

    path = folder + "/t.csv"
    with open(path, "w") as file:
        file.write(LINES)
    frame, counted = read_and_observe(spark, path)
    frame.select("a").write.parquet(folder + "/out")
    assert counted.get["bad"] == 2 and spark.read.parquet(folder + "/out").count() == 4
    require_few(2, 2)
    with pytest.raises(ValueError):
        require_few(2, 1)


def test_build_job_refuses_too_many_malformed_rows(spark, folder):
    from cohortry.plans.jobs import main

    raw = raw_panel(spark, "/root/testdata/sf0.001", dt.date(1995, 4, 1))
    raw.coalesce(1).write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(folder + "/in")
    with open(folder + "/in/zz.csv", "w") as file:
        file.write(",".join(raw.columns) + "\nfew,fields\n")
    span = ["--root", folder + "/t", "--panel-start", "1995-01-01", "--panel-end", "1995-03-01", "build", "--source", folder + "/in"]
    with pytest.raises(ValueError, match="1 malformed"):
        main([*span, "--max-bad", "0"])
    assert main([*span, "--max-bad", "1"]).startswith("built")


def test_table_modes(spark, folder):
    tables = TableSet(spark, folder)
    assert not tables.exists("t")
    assert tables.write_if_absent("t", spark.range(3)).count() == 3
    assert tables.write_if_absent("t", spark.range(9)).count() == 3
    assert tables.write("t", spark.range(5)).count() == 5
    assert tables.view("v", tables.read("t").filter("id > 2")).count() == 2 == spark.sql("select * from v").count()


def test_a_replacement_that_fails_leaves_the_table(spark, folder):
    tables = TableSet(spark, folder)
    tables.write("t", spark.range(5))
    with pytest.raises(Exception, match="half-way"):
        tables.write("t", spark.range(0, 100, 1, 4).selectExpr("if(id > 70, raise_error('half-way'), id) AS id"))
    assert tables.read("t").count() == 5 and len(glob.glob(f"{folder}/t/version-*")) == 1
    with pytest.raises(Exception, match="half-way"):
        tables.write("u", spark.range(3).selectExpr("raise_error('half-way') AS id"))
    assert not tables.exists("u")


def test_readers_keep_the_version_they_began_with(spark, folder):
    tables = TableSet(spark, folder)
    first = tables.write("t", spark.range(5))
    second = tables.write("t", tables.read("t").selectExpr("id + 10 AS id"))  # computed from the table itself
    assert first.count() == 5 == second.filter("id >= 10").count() and tables.read("t").filter("id < 10").isEmpty()
    for _ in range(3):
        tables.write("t", tables.read("t"))
    assert len(glob.glob(f"{folder}/t/version-*")) == 2 == len(glob.glob(f"{folder}/t/_current-*"))


def test_of_two_replacements_of_one_version_the_second_fails(spark, folder, monkeypatch):
    tables = TableSet(spark, folder)
    tables.write("t", spark.range(1))
    began = module._pointers(spark, tables.path("t"))
    tables.write("t", spark.range(2))
    with monkeypatch.context() as patched:
        patched.setattr(module, "_pointers", lambda *_: began)
        with pytest.raises(module.OutdatedError):
            tables.write("t", spark.range(3))
    assert tables.read("t").count() == 2 and tables.write("t", spark.range(4)).count() == 4


def test_a_folder_without_versions_is_read_and_replaced(spark, folder):
    tables = TableSet(spark, folder)
    spark.range(3).write.parquet(tables.path("t"))
    assert tables.read("t").count() == 3 and tables.write_if_absent("t", spark.range(9)).count() == 3
    assert tables.write("t", spark.range(4)).count() == 4 == tables.read("t").count()


def test_partitions_are_replaced_from_their_own_table(spark, folder):
    path = folder + "/p"
    replace_partitions(spark.range(10).selectExpr("id % 2 as part", "id"), path, "part")
    table = spark.read.parquet(path)
    replace_partitions(table.filter("part = 1").selectExpr("part", "id + 100 as id"), path, "part")
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [0, 2, 4, 6, 8, 101, 103, 105, 107, 109]


def test_checkpoint_folder_is_found(spark):
    assert shared_folder(spark)
    assert settle(spark.range(4)).count() == 4


def test_removed_tables_are_gone(spark, folder):
    tables = TableSet(spark, folder)
    tables.write("t", spark.range(3))
    tables.remove("t")
    tables.remove("never there")
    assert not tables.exists("t")


def test_built_tables_equal_the_lazy_ones(spark, spec, launch, folder):
    stored = build(raw_panel(spark, "/root/testdata/sf0.01", dt.date(1996, 6, 1)), spec, TableSet(spark, folder))
    for name in ("curves", "curves_by_segment", "cohort_adoption", "fct_customer", "fct_customer_month", "dim_channel"):
        left, right = getattr(stored, name), getattr(launch, name)
        assert left.exceptAll(right.select(*left.columns)).isEmpty() and left.count() == right.count(), name
    months = stored.panel.selectExpr("explode(array(snapshot_month, acq_month)) as day").selectExpr("trunc(day, 'MM') as date_month")
    assert months.filter("date_month is not null").join(stored.dim_date, "date_month", "left_anti").isEmpty()
    keys = stored.fct_customer.filter("acq_date_key is not null").selectExpr("acq_date_key as date_key")
    assert keys.join(stored.dim_date, "date_key", "left_anti").isEmpty()
    pruned = stored.fct_customer_month.filter("snapshot_month = date'1995-03-28'")
    assert "PartitionFilters: [isnotnull(snapshot_month" in pruned._jdf.queryExecution().executedPlan().toString()


def test_build_stops_at_broken_data(spark, spec, folder):
    raw = raw_panel(spark, "/root/testdata/sf0.001").limit(20).cache()
    with pytest.raises(QualityError) as error:
        build(raw.unionByName(raw), spec, TableSet(spark, folder))
    assert error.value.failures[0][:2] == ("stg_customer_month", "unique_combination")


def deliver(frame, path, shuffle=False):
    """One delimited file; shuffled ones have their columns in another order and one that nobody asked for."""
    if shuffle:
        frame = frame.select(F.lit("x").alias("other"), *reversed(frame.columns))
    frame.coalesce(1).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def assert_same(got, want, name=""):
    got = got.select(*want.columns)
    assert got.exceptAll(want).isEmpty() and got.count() == want.count(), name


@pytest.mark.parametrize("file_format", ["csv", "parquet"])
def test_incremental_loads_end_where_one_load_ends(spark, spec, folder, file_format):
    """Months in several batches, one of them corrected later, one delivered twice; the panel's end moves along."""
    raw = raw_panel(spark, "/root/testdata/sf0.001", dt.date(1996, 6, 1)).cache()
    tables = TableSet(spark, folder)
    load = IncrementalLoad(tables, spec, buckets=4)
    early = raw.filter("fecha_dato < '1995-09-01'")
    wrong = early.withColumn("ind_tjcr_fin_ult1", F.when(F.col("fecha_dato") < "1995-03-01", "0").otherwise(F.col("ind_tjcr_fin_ult1")))
    landing, checkpoint = tables.path("landing"), tables.path("checkpoint")

    def send(frame, number):
        if file_format == "csv":
            deliver(frame, f"{landing}/{number}", shuffle=number % 2 == 0)
        else:
            frame.select(*reversed(frame.columns)).coalesce(1).write.parquet(f"{landing}/{number}")
        load.run(spark, landing + "/*", checkpoint, file_format)

    def compare(raw, end):
        whole = Warehouse(raw, replace(spec, panel_end=end))
        for name, want in (
            ("stg_customer_month", whole.panel),
            ("mart_cohort_adoption", whole.cohort_adoption),
            ("mart_adoption_curves", whole.curves),
            ("mart_adoption_curves_by_segment", whole.curves_by_segment),
        ):
            assert_same(tables.read(name), want, name)
        assert_same(load.customers(), whole.fct_customer)

    send(wrong, 1)
    compare(wrong, dt.date(1995, 8, 1))
    send(raw.filter("fecha_dato >= '1995-09-01'"), 2)
    send(early.filter("fecha_dato < '1995-03-01'"), 3)
    load.run(spark, landing + "/*", checkpoint, file_format)
    load.apply(early.filter("fecha_dato < '1995-03-01'"), 99)
    compare(raw, spec.panel_end)
    assert not tables.exists("increment") and not tables.exists("corrected")


def test_incremental_load_keeps_its_buckets(spark, spec, folder):
    raw = raw_panel(spark, "/root/testdata/sf0.001", dt.date(1995, 4, 1)).cache()
    IncrementalLoad(TableSet(spark, folder), spec, buckets=8).apply(raw, 0)
    again = IncrementalLoad(TableSet(spark, folder), spec)
    again.apply(raw, 1)
    assert again.buckets == 8 and again.customers().count() == raw.select("ncodpers").distinct().count()
    with pytest.raises(ValueError):
        IncrementalLoad(TableSet(spark, folder), spec, buckets=64)


def test_a_new_month_reads_no_history(spark, spec, folder, monkeypatch):
    """The panel is read in the partitions of the months that arrive, and no others."""
    raw = raw_panel(spark, "/root/testdata/sf0.001", dt.date(1995, 6, 1)).cache()
    tables = TableSet(spark, folder)
    load = IncrementalLoad(tables, spec, buckets=2)
    load.apply(raw.filter("fecha_dato < '1995-05-01'"), 0)
    read = []
    monkeypatch.setattr(tables, "read", lambda name: read.append(name) or TableSet.read(tables, name))
    load.apply(raw.filter("fecha_dato >= '1995-05-01'"), 1)
    assert "stg_customer_month" not in read


def test_only_keys_claimed_twice_compare_whole_rows(spark, spec, folder, monkeypatch):
    """Every batch was once sorted whole, twice, to find rows of one entity and snapshot."""
    seen = []
    monkeypatch.setattr(incremental, "one_per_key", lambda rows: seen.append(rows.count()) or one_per_key(rows))
    raw = raw_panel(spark, "/root/testdata/sf0.001", dt.date(1995, 5, 1)).cache()
    tables = TableSet(spark, folder)
    load = IncrementalLoad(tables, spec, buckets=2)
    load.apply(raw.filter("fecha_dato < '1995-04-01'"), 0)
    assert seen == []
    late = raw.filter("fecha_dato >= '1995-04-01'")
    some = late.filter("cast(ncodpers as bigint) % 2 = 0")
    twice = late.unionByName(some.withColumn("segmento", F.lit("99 - LAST"))).unionByName(some)
    load.apply(twice, 1)
    assert some.count() > 0 and seen == [3 * some.count()]
    want = one_per_key(clean_panel(raw.filter("fecha_dato < '1995-04-01'").unionByName(twice), spec))
    assert_same(tables.read("stg_customer_month").drop("customer_bucket").select(want.columns), want)
    assert not tables.exists("claimed")


def test_a_batch_reads_profiles_of_its_own_buckets_only(spark, spec, folder):
    """Profiles of the other buckets are made unreadable before a batch of one customer comes."""
    raw = raw_panel(spark, "/root/testdata/sf0.001", dt.date(1995, 8, 1)).cache()
    tables = TableSet(spark, folder)
    load = IncrementalLoad(tables, spec, buckets=8)
    late = raw.filter("fecha_dato >= '1995-07-01'")
    one = late.orderBy("ncodpers").select("ncodpers").first()[0]
    last = late.filter(F.col("ncodpers") == one)
    first = raw.exceptAll(last)
    load.apply(first, 0)
    profiles = spark.read.parquet(f"{folder}/customer_profile")
    own = profiles.filter(F.col("customer_id") == int(one)).select("customer_bucket").first()[0]
    files = [f for f in glob.glob(f"{folder}/customer_profile/customer_bucket=*/*.parquet") if f"customer_bucket={own}/" not in f]
    assert files
    for file in files:
        with open(file, "rb") as held:
            data = held.read()
        body = len(data) - 8 - int.from_bytes(data[-8:-4], "little")  # the footer, read for the schema, stays
        with open(file, "wb") as out:
            out.write(data[:4] + bytes(body - 4) + data[body:])
        os.remove(os.path.join(os.path.dirname(file), f".{os.path.basename(file)}.crc"))
    with pytest.raises(Exception):
        tables.read("customer_profile").agg(F.max("first_obs_month")).collect()
    load.apply(last, 1)
    whole = Warehouse(raw, replace(spec, panel_end=dt.date(1995, 7, 1)))
    assert_same(tables.read("mart_cohort_adoption"), whole.cohort_adoption)
    assert_same(tables.read("mart_adoption_curves_by_segment"), whole.curves_by_segment)


def test_a_load_that_stopped_between_profiles_and_marts_is_repeated(spark, spec, folder, monkeypatch):
    raw = raw_panel(spark, "/root/testdata/sf0.001", dt.date(1995, 6, 1)).cache()
    tables = TableSet(spark, folder)
    load = IncrementalLoad(tables, spec, buckets=4)
    load.apply(raw.filter("fecha_dato < '1995-05-01'"), 0)
    rest = raw.filter("fecha_dato >= '1995-05-01'")
    with monkeypatch.context() as patched:
        patched.setattr(load, "_refresh_cells", lambda increment: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            load.apply(rest, 1)
    load.apply(rest, 1)
    whole = Warehouse(raw, replace(spec, panel_end=dt.date(1995, 5, 1)))
    assert_same(tables.read("mart_cohort_adoption"), whole.cohort_adoption)
    assert_same(tables.read("mart_adoption_curves"), whole.curves)


def test_malformed_lines_stop_a_load(spark, spec, folder):
    tables = TableSet(spark, folder)
    raw = raw_panel(spark, "/root/testdata/sf0.001", dt.date(1995, 2, 1))
    deliver(raw, folder + "/in/1")
    with open(folder + "/in/1/zz.csv", "w") as file:
        file.write(",".join(raw.columns) + "\nfew,fields\n")
    with pytest.raises(Exception, match="1 malformed"):
        IncrementalLoad(tables, spec).run(spark, folder + "/in/*", folder + "/checkpoint", "csv", files_per_batch=9, max_bad=0)


def test_files_are_read_by_their_own_headers(spark, folder):
    for name, text in (("1", "a,b\n1,x\n"), ("2", "b,a\ny,2\n\"z\nz\",3\n"), ("3", "a,b\n4,w\n5\n")):
        with open(f"{folder}/{name}.csv", "w") as file:
            file.write(text)
    got = read_all_string(spark, folder + "/*.csv", max_bad=1)
    assert sorted(map(tuple, got.collect())) == [("1", "x"), ("2", "y"), ("3", "z\nz"), ("4", "w")]
    with open(folder + "/4.csv", "w") as file:
        file.write("a,c\n1,2\n")
    with pytest.raises(ValueError, match="columns of"):
        read_all_string(spark, folder + "/*.csv")


def test_streamed_admission_counts(spark, folder):
    """In two deliveries, the second with rows of every earlier bucket; nothing is lost."""
    rows = [(dt.datetime(2024, 1, d, h), c) for d in (1, 2, 3) for h in range(6) for c in (1, 1, 2)] + [(None, 5)]
    frame = spark.createDataFrame(rows, "ts timestamp, client long")
    tables = TableSet(spark, folder)
    for part in (0, 1):
        frame.filter(F.coalesce(F.hour("ts"), F.lit(0)) % 2 == part).coalesce(1).write.mode("append").parquet(folder + "/in")
        stream = spark.readStream.schema(frame.schema).parquet(folder + "/in")
        run_admission_counts(stream, tables, "counts", "ts", "client", "1 day")
    got = {tuple(r) for r in read_admission_counts(tables, "counts", 4, 7).collect()}
    want = {tuple(r) for r in admission_counts(frame, "ts", "client", "1 day", 4, 7).collect()}
    assert got == want and {r[1:] for r in got} == {(18, 8, 7)} and len(got) == 3


def test_partitioned_table_computes_its_rows_once(spark, tmp_path):
    """Range partitioning had computed them a first time for its sample."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(100).selectExpr("id % 3 AS part", "100 - id AS n").mapInArrow(count, "part long, n long")
    table = TableSet(spark, str(tmp_path / "set")).write("t", rows, partition="part", sort=("n",), derived=lambda df: df.withColumn("m", F.col("n") + 1))
    assert seen.value == 100
    assert {tuple(r) for r in table.select("part", "n", "m").collect()} == {(i % 3, 100 - i, 101 - i) for i in range(100)}
    for file in table.inputFiles():
        own = [r.n for r in spark.read.parquet(file).collect()]
        assert own == sorted(own)
