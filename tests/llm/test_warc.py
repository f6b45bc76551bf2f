import contextlib
import gzip
import hashlib
import os

import pyarrow.fs
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.llm import warc

SCHEMA = T.StructType(
    [T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
     T.StructField("payload", T.StringType()), T.StructField("n", T.StringType()), T.StructField("key", T.LongType())]
)
BIG, LIMIT = "<p>é" + "x" * 1500, "y" * 1000


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(3)


@contextlib.contextmanager
def uncoalesced(spark):
    """Small partitions stay apart, so that they can be counted."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def expected(rows):
    last = {}
    for page_id, _, html in rows:
        if html and len(html.encode()) >= 1000 and page_id is not None:
            last[html] = max(page_id, last.get(html, page_id))
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        later = html in last and last[html] != page_id
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if later else "response", last[html] if later else None))
    return sorted(out, key=str)


def read(spark, rows, **options):
    archives = warc.write_archives(table(spark, rows), **options)
    found = warc.fetch(archives, warc.lookup(archives, table(spark, rows)), payload=False)
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return archives, sorted((tuple(r[c] for c in columns) for r in found.collect()), key=str)


ODD = [
    (1, "http://a.example.com/x", BIG), (2, "https://user@A.Example.com:443/x#top", BIG), (3, "http://b.example.com", BIG), (4, None, None), (5, None, ""),
    (6, "not a url\r\nWARC-Type: metadata", "small"), (7, "http://a.example.com:8080/x?q=\t\n é", "small"), (8, "", LIMIT), (9, "", LIMIT[:-1]), (10, "//h", LIMIT[:-1]),
    (11, "http://[::1]:80/", "\r\n\r\nWARC/1.1\r\n\r\n"), (12, "http://a.example.com/x", "\x00\x1f " * 400), (None, "http://n.example.com/", BIG),
    (13, "http://z.example.com/", LIMIT), (13, "http://z.example.com/2", LIMIT), (13, "http://z.example.com/2", LIMIT), (14, "http://c.example.com/" + "p" * 9000, "z" * 3_000_000),
]


def test_odd_pages(spark):
    archives, got = read(spark, ODD, block_lines=4, file_bytes=2000, shards=5)
    assert got == expected(ODD)


def test_only_null_ids_and_empty_table(spark):
    rows = [(None, "http://a.com/", BIG), (None, "http://b.com/", BIG)]
    assert read(spark, rows)[1] == expected(rows)
    assert read(spark, [])[1] == []


def test_files_are_warc(spark):
    archives, _ = read(spark, ODD)
    store, folder = pyarrow.fs.FileSystem.from_uri(archives.folder)
    files = [f.path for f in store.get_file_info(pyarrow.fs.FileSelector(folder))]
    data = b"".join(gzip.decompress(open(f, "rb").read()) for f in files)
    assert data.count(b"WARC/1.1\r\nWARC-Type: ") == len(ODD)
    assert b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n" in data
    assert all(os.path.basename(f).endswith(".warc.gz") for f in files)


def test_keys(spark):
    urls = ["http://www.Example.com:80/a/B?x=1#f", "https://example.com", "http://h:8080", "mailto:x", None, "http://u:p@h.org/"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select(warc.url_key(F.col("url"))).collect()
    assert [r[0] for r in rows] == ["com,example,www)/a/B?x=1", "com,example)/", "h:8080)/", "mailto:x", "", "org,h)/"]


def test_lookup_reads_only_named_blocks_and_resolves_revisits(spark):
    rows = [(k, f"http://s{k % 50}.example.com/{k}", f"page {k % 300} " * 200) for k in range(900)]
    archives, got = read(spark, rows, block_lines=20, shards=6)
    assert got == expected(rows)
    urls = spark.createDataFrame([("http://s7.example.com/57",), ("https://s7.example.com/57#x",), ("http://nowhere.example.com/",)], "url string")
    captures = warc.lookup(archives, urls)
    assert [(r.urlkey, r.page_id) for r in captures.collect()] == [("com,example,s7)/57", 57)]
    found = warc.payloads(archives, urls).collect()
    assert [(r.page_id, r.payload.decode()) for r in found] == [(57, "page 57 " * 200)]


def test_many_captures_of_one_url_span_blocks_and_shards(spark):
    rows = [(k, "http://hot.example.com/" if k % 3 else f"http://c{k}.example.com/", f"{k}") for k in range(600)]
    archives, got = read(spark, rows, block_lines=10, shards=7)
    assert got == expected(rows)
    captures = warc.lookup(archives, spark.createDataFrame([("http://hot.example.com/",)], "url string"))
    assert sorted(r.page_id for r in captures.collect()) == [k for k in range(600) if k % 3]
    with uncoalesced(spark):
        tasks = warc.lookup(archives, spark.createDataFrame([("http://hot.example.com/",)], "url string")).select(F.spark_partition_id())
        assert tasks.distinct().count() > 1


def test_damage_is_an_error():
    page = {"page_id": 1, "url": "http://a.com/", "html": "abc", "sha1": hashlib.sha1(b"abc").hexdigest(), "refers_to": None, "refers_url": None}
    record = warc.make_record(page, "2000-01-01T00:00:00Z")
    assert warc.parse_record(record)["payload"] == b"abc"
    for bad in (record.replace(b"abc", b"abd"), record[:-1], record[:-8]):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


def test_hot_payload_is_joined_by_a_small_broadcast(spark):
    """Two thirds of the pages are one payload; the rest of the plan never gathers them."""
    pages = spark.range(3000).select(
        F.col("id").alias("page_id"), F.format_string("http://h%d.com/", "id").alias("url"),
        F.when(F.col("id") % 3 > 0, F.repeat(F.lit("hot "), 300)).otherwise(F.repeat(F.col("id").cast("string"), 1000)).alias("html"),
    )
    planned = warc.with_originals(pages)
    assert planned.filter("refers_to = 2999").count() == 1999
    with uncoalesced(spark):
        tasks = [r["count"] for r in warc.with_originals(pages).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 3000 and max(tasks) < 1500
