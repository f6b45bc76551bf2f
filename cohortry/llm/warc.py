"""WARC archives of web pages, and a two-level index of their captures.

Archives: gzip files in which every record is a member of its own. A page is a ``response`` record, or a ``revisit``
that names the response with the same payload and holds no payload. Index: one line per record, sorted by its URL
key (host labels reversed, so that a domain's pages lie together), cut into compressed blocks; every shard of the
index ends with a sparse directory of its blocks' first and last keys. A look-up searches the shards' key ranges,
then the directory of a shard, then reads and searches the blocks it names, and reads records as byte ranges.

Files are written by the tasks, each attempt under names of its own, and count only when Spark has committed the rows
that name them: a lost executor leaves files that nothing refers to. They lie in the folder that the cluster shares,
which the tasks reach through ``pyarrow.fs`` (local paths, HDFS, object stores).
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.storage import scratch_folder, shuffle_width, stored
from cohortry.llm.words import slices

FILE_BYTES = 256 << 20
BLOCK_LINES = 3000
# payloads from this size on are stored once
REVISIT_BYTES = 1000
_LEVEL = 3
# groups with more than this share of all rows are fewer than its inverse
_HOT_SHARE = 1000
_DIGEST = re.compile(rb"^sha1:([A-Z2-7]{32})$")

_LINES = pa.schema(
    [("urlkey", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
)
_LINES_DDL = "urlkey string, page_id long, record_type string, file string, offset long, length long"


@dataclass(frozen=True)
class Archives:
    folder: str  # of the record files
    captures: str  # table of all records' places
    index: str  # folder of the index shards
    shards: str  # table of the shards


def url_key(url: Column) -> Column:
    """Reversed host, port unless 80 or 443, path and query; scheme, user and fragment do not count.

    What does not look like a URL with a host is its own key; null has the empty key.
    """
    parts = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?([^#]*)"
    host, port, rest = (F.regexp_extract(url, parts, k) for k in (1, 2, 3))
    reversed_host = F.array_join(F.reverse(F.split(F.lower(host), r"\.")), ",")
    port = F.when(port.isin("", "80", "443"), F.lit("")).otherwise(F.concat(F.lit(":"), port))
    rest = F.when(rest == "", F.lit("/")).otherwise(rest)
    return F.coalesce(F.when(host != "", F.concat(reversed_host, port, F.lit(")"), rest)).otherwise(url), F.lit(""))


def _store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri)


class _Files:
    """Files written one after another in a folder, none much larger than ``limit``."""

    def __init__(self, folder: str, ending: str, limit: int) -> None:
        self.store, self.folder = _store(folder)
        self.store.create_dir(self.folder, recursive=True)
        self.ending, self.limit, self.file, self.name, self.place = ending, limit, None, "", 0

    def add(self, data: bytes) -> tuple[str, int]:
        """The file and offset at which ``data`` now lies."""
        if self.file is None or self.place >= self.limit:
            self.close()
            self.name, self.place = f"{uuid.uuid4().hex}{self.ending}", 0
            self.file = self.store.open_output_stream(f"{self.folder}/{self.name}", compression=None)
        at = self.place
        self.file.write(data)
        self.place += len(data)
        return self.name, at

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None


def _uri(url: str) -> str:
    """A URL without blanks and control characters, which a header line cannot hold."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url)


def _record_id(page_id: int | None, sha1: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id} {sha1}'.encode()).digest())}>"


def make_record(page: dict, date: str) -> bytes:
    """One record, uncompressed. A page with ``refers_to`` is a revisit."""
    payload = page["html"].encode()
    revisit = page["refers_to"] is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    digest = base64.b32encode(bytes.fromhex(page["sha1"])).decode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page['page_id'], page['sha1'])}", f"WARC-Date: {date}"]
    if page["url"] is not None:
        head.append(f"WARC-Target-URI: {_uri(page['url'])}")
    if page["page_id"] is not None:
        head.append(f"Page-ID: {page['page_id']}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head += [f"WARC-Refers-To: {_record_id(page['refers_to'], page['sha1'])}", f"Refers-To-Page-ID: {page['refers_to']}"]
        if page["refers_url"] is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_uri(page['refers_url'])}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of one uncompressed record; a payload that is not what its digest says is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    fields = dict(line.split(b": ", 1) for line in lines)
    block = rest[: int(fields[b"Content-Length"])]
    if not version.startswith(b"WARC/1.") or len(block) != int(fields[b"Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = int(re.search(rb"(?mi)^Content-Length: (\d+)\r?$", http).group(1))
    sha1 = base64.b32decode(_DIGEST.match(fields[b"WARC-Payload-Digest"]).group(1)).hex()
    kind = fields[b"WARC-Type"].decode()
    if kind == "response" and (len(payload) != declared or hashlib.sha1(payload).hexdigest() != sha1):
        raise ValueError("the payload is not what its record says")
    number = lambda name: int(fields[name]) if name in fields else None
    text = lambda name: fields[name].decode() if name in fields else None
    return {
        "page_id": number(b"Page-ID"), "url": text(b"WARC-Target-URI"), "payload_bytes": declared, "payload_digest": sha1, "record_type": kind,
        "refers_to": number(b"Refers-To-Page-ID"), "refers_url": text(b"WARC-Refers-To-Target-URI"), "payload": payload if kind == "response" else None,
    }


def with_originals(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, sha1, urlkey, refers_to, refers_url: for later copies of a payload, its response.

    Digests are counted before they meet, so a payload under a third of all pages is a row per task. Its pages then
    find the response by a broadcast of the hot payloads alone, which are fewer than a thousand whatever the size;
    pages that need no partner are spread.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"))
    payload = F.when(F.octet_length("html") >= least, F.sha2(F.col("html").cast("binary"), 256))
    own = rows.withColumn("payload", payload)
    groups = own.filter("payload IS NOT NULL").groupBy("payload").agg(
        F.count("*").alias("n"), F.max("page_id").alias("last"), F.max_by("url", "page_id").alias("last_url")
    )
    groups = stored(groups.filter("n > 1 AND last IS NOT NULL"))
    total = pages.count()
    hot = groups.filter(F.col("n") * _HOT_SHARE > total).select("payload", F.col("last").alias("hot_last"), F.col("last_url").alias("hot_url"))
    cold = groups.filter(F.col("n") * _HOT_SHARE <= total).select(F.col("payload").alias("key"), "last", "last_url")
    found = own.join(F.broadcast(hot), "payload", "left")
    alone = F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))
    found = found.withColumn("key", F.when(F.col("payload").isNull() | F.col("hot_last").isNotNull(), alone).otherwise(F.col("payload")))
    found = found.join(cold, "key", "left").withColumns({"last": F.coalesce("hot_last", "last"), "last_url": F.coalesce("hot_url", "last_url")})
    later = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return found.select(
        "page_id", "url", "html", F.sha1(F.col("html").cast("binary")).alias("sha1"), url_key(F.col("url")).alias("urlkey"),
        F.when(later, F.col("last")).alias("refers_to"), F.when(later, F.col("last_url")).alias("refers_url"),
    )


def write_archives(
    pages: DataFrame, folder: str | None = None, date: str = "2000-01-01T00:00:00Z", least: int = REVISIT_BYTES,
    file_bytes: int = FILE_BYTES, block_lines: int = BLOCK_LINES, shards: int | None = None,
) -> Archives:
    """Write a record per row of ``pages`` (page_id, url, html) and index them.

    Of equal payloads of at least ``least`` bytes the row with the largest page_id is the response and others
    revisit it; rows that share that page_id are all responses, and a null page_id is smaller than any. A null html
    is an empty payload; a null url is filed under the empty key. Other columns are ignored. An empty table gives
    archives without records.
    """
    spark = pages.sparkSession
    folder = folder or scratch_folder(spark)
    where = Archives(f"{folder}/warc", f"{folder}/captures", f"{folder}/index", f"{folder}/shards")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = None
        for batch in slices(batches, "html"):
            files = files or _Files(where.folder, ".warc.gz", file_bytes)
            lines = []
            for page in batch.to_pylist():
                deflate = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
                data = deflate.compress(make_record(page, date)) + deflate.flush()
                kind = "response" if page["refers_to"] is None else "revisit"
                lines.append((page["urlkey"], page["page_id"], kind, *files.add(data), len(data)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*lines), _LINES, strict=True)], schema=_LINES)
        if files:
            files.close()

    with_originals(pages, least).mapInArrow(write, _LINES_DDL).write.parquet(where.captures)
    _write_index(spark, where, block_lines, shards or shuffle_width(spark))
    return where


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _write_index(spark: SparkSession, where: Archives, block_lines: int, shards: int) -> None:
    """Sorted lines over all shards; equal keys are told apart by their places, so no key must fit one shard."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, held, directory = None, [], []

        def close(table: pa.Table) -> None:
            keys = table.column("urlkey")
            data = _packed(table.combine_chunks())
            directory.append((keys[0].as_py(), keys[-1].as_py(), files.add(data)[1], len(data)))

        for batch in batches:
            if batch.num_rows:
                files = files or _Files(where.index, ".cdx", 1 << 62)
                held.append(batch)
                while sum(b.num_rows for b in held) >= block_lines:
                    table = pa.Table.from_batches(held)
                    close(table.slice(0, block_lines))
                    held = table.slice(block_lines).to_batches()
        if files is None:
            return
        if sum(b.num_rows for b in held):
            close(pa.Table.from_batches(held))
        table = pa.table(dict(zip(("first", "last", "offset", "length"), map(list, zip(*directory)), strict=True)))
        data = _packed(table)
        name, at = files.add(data)
        files.close()
        yield pa.RecordBatch.from_pylist(
            [{"first": directory[0][0], "last": directory[-1][1], "file": name, "offset": at, "length": len(data)}],
            pa.schema([("first", pa.string()), ("last", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]),
        )

    order = ["urlkey", "page_id", "file", "offset"]
    lines = spark.read.schema(_LINES_DDL).parquet(where.captures).repartitionByRange(shards, *order).sortWithinPartitions(*order)
    lines.mapInArrow(write, "first string, last string, file string, offset long, length long").write.parquet(where.shards)


def _range(store: pa.fs.FileSystem, path: str, offset: int, length: int) -> bytes:
    with store.open_input_file(path) as file:
        return file.read_at(length, offset)


def _spans(first: list[bytes], last: list[bytes], key: bytes) -> range:
    """Which of the sorted ranges may hold ``key``, by binary search."""
    return range(bisect.bisect_left(last, key), bisect.bisect_right(first, key))


def lookup(archives: Archives, urls: DataFrame) -> DataFrame:
    """urlkey, page_id, record_type, file, offset, length of all captures of the given ``url``s.

    URLs of equal keys are one; those that no record has give no row. The shards' key ranges, a row per shard, are
    sent to the tasks. A key with many captures is answered block by block, by many tasks.
    """
    spark = urls.sparkSession
    shards = spark.read.schema("first string, last string, file string, offset long, length long").parquet(archives.shards)
    held = sorted((r["first"].encode(), r["last"].encode(), r["file"], r["offset"], r["length"]) for r in shards.collect())
    keys = urls.select(url_key(F.col("url")).alias("urlkey")).distinct()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last = [s[0] for s in held], [s[1] for s in held]
        store, folder = _store(archives.index)
        read: dict[int, tuple] = {}
        for batch in batches:
            out = []
            for key in batch.column("urlkey").to_pylist():
                for shard in _spans(first, last, key.encode()):
                    if shard not in read:
                        if len(read) >= 8:  # keys come in order, so directories are needed once
                            read.clear()
                        name, *place = held[shard][2:]
                        table = _unpacked(_range(store, f"{folder}/{name}", *place)).to_pydict()
                        read[shard] = (*([k.encode() for k in table[c]] for c in ("first", "last")), table["offset"], table["length"])
                    firsts, lasts, offsets, lengths = read[shard]
                    out += [(key, held[shard][2], offsets[k], lengths[k]) for k in _spans(firsts, lasts, key.encode())]
            names = ("urlkey", "shard", "place", "size")
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)) if out else [[]] * 4, strict=True)), wanted)

    wanted = pa.schema([("urlkey", pa.string()), ("shard", pa.string()), ("place", pa.int64()), ("size", pa.int64())])
    blocks = keys.sortWithinPartitions("urlkey").mapInArrow(find, "urlkey string, shard string, place long, size long")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(archives.index)
        at, lines, line_keys = None, None, []
        for batch in batches:
            for key, *place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place != at:
                    at, lines = place, _unpacked(_range(store, f"{folder}/{place[0]}", *place[1:]))
                    line_keys = [k.encode() for k in lines.column("urlkey").to_pylist()]
                begin, end = bisect.bisect_left(line_keys, key.encode()), bisect.bisect_right(line_keys, key.encode())
                yield from lines.slice(begin, end - begin).to_batches()

    dealt = blocks.repartition(shuffle_width(spark), "shard", "place").sortWithinPartitions("shard", "place", "urlkey")
    return dealt.mapInArrow(search, _LINES_DDL)


_FETCHED = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, refers_url string"
)


def fetch(archives: Archives, captures: DataFrame, payload: bool = True) -> DataFrame:
    """The records at some places: page_id, url, payload_bytes, payload_digest, record_type, refers_to, refers_url, payload.

    Each is a range read of its file; neighbours are read together. Size and digest are those of the full payload,
    which is null for revisits. Every record is parsed and checked, whether or not its payload is asked for.
    """
    schema = _FETCHED + ", payload binary" * payload
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(archives.folder)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("file", "offset", "length")]
            rows = list(zip(*columns, strict=True))
            begin = 0
            while begin < len(rows):
                name, offset, _ = rows[begin]
                end = begin + 1
                while end < len(rows) and rows[end][0] == name and 0 <= rows[end][1] - sum(rows[end - 1][1:]) < 1 << 16 and sum(rows[end][1:]) - offset < 4 << 20:
                    end += 1
                data = _range(store, f"{folder}/{name}", offset, sum(rows[end - 1][1:]) - offset)
                found = [parse_record(zlib.decompress(data[o - offset : o - offset + n], 31)) for _, o, n in rows[begin:end]]
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in names} for r in found], arrow)
                begin = end

    # a range of a file to each group, however many records it holds; places are small, what they name is not
    part = (F.col("offset") / (16 << 20)).cast("long")
    places = captures.select("file", "offset", "length").repartition(shuffle_width(captures.sparkSession), "file", part).sortWithinPartitions("file", "offset")
    return places.mapInArrow(read, schema)


def payloads(archives: Archives, urls: DataFrame) -> DataFrame:
    """page_id, url, payload_digest, payload of all captures of the given URLs, those of revisits from their responses."""
    found = stored(fetch(archives, lookup(archives, urls)))
    names = ["page_id", "url", "payload_digest", "payload"]
    later = found.filter("record_type = 'revisit'")
    responses = fetch(archives, lookup(archives, later.select(F.col("refers_url").alias("url"))).filter("record_type = 'response'"))
    whole = responses.select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload").alias("original")).dropDuplicates(["refers_to", "payload_digest"])
    resolved = later.drop("payload").join(whole, ["refers_to", "payload_digest"]).withColumnRenamed("original", "payload")
    return found.filter("record_type = 'response'").select(names).union(resolved.select(names))
