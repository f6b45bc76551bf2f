"""Records of delimited files whose fields may hold line breaks, put together by many tasks per file.

A line alone does not say whether it begins inside a quoted field. It is a function of two states, though: from
outside and from inside quotes to the one or the other. Such functions compose, so a first pass over the splits
gives one small row each (its function, and the open ends under both beginnings), a prefix over these rows says
where each split really begins, and a second pass cuts records. Records over a boundary come from the open ends.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortry.sources.tables import settle

MAX_RECORD = 1 << 20  # bytes; a longer record is malformed and its text is not kept
MAX_SPLITS = 1_000_000  # splits whose states are sent to all tasks at once; more are read in groups of files

# A quoted field ends at a quote that is not doubled; what follows up to the comma is plain text, quotes included.
_FIELD = '(?:[^",][^,]*|"(?:[^"]|"")*"(?:[^",][^,]*)?)?'
_ENDS_FROM_OUTSIDE = f"^{_FIELD}(?:,{_FIELD})*$"
_ENDS_FROM_INSIDE = f'^(?:[^"]|"")*"(?:[^",][^,]*)?(?:,{_FIELD})*$'


def line_functions(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whether each line (binary) ends inside quotes: begun outside, begun inside."""
    outside, inside = np.zeros(len(lines), bool), np.ones(len(lines), bool)
    quoted = pc.match_substring(lines, '"')
    where = quoted.to_numpy(zero_copy_only=False)
    if where.any():
        some = lines.filter(quoted)
        outside[where] = ~pc.match_substring_regex(some, _ENDS_FROM_OUTSIDE).to_numpy(zero_copy_only=False)
        inside[where] = ~pc.match_substring_regex(some, _ENDS_FROM_INSIDE).to_numpy(zero_copy_only=False)
    return outside, inside


def states_after(begins_inside: bool, outside: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """State after each line: that of the last line that sets it, turned by the lines since that swap it."""
    swaps = np.cumsum(outside & ~inside) % 2 == 1
    setters = np.where(outside == inside, np.arange(len(outside)), -1)
    last = np.maximum.accumulate(setters)
    return np.where(last >= 0, outside[last] ^ swaps[last], begins_inside) ^ swaps


class _Walk:
    """Records of one split under one beginning."""

    def __init__(self, begins_inside: bool, limit: int) -> None:
        self.inside, self.started, self.limit = begins_inside, not begins_inside, limit
        self.held: list[bytes] = []
        self.n_held = self.size = self.done = 0
        self.head: bytes | None = None
        self.head_size = 0

    def _hold(self, lines: pa.Array) -> None:
        if not len(lines):
            return
        self.size += pc.sum(pc.binary_length(lines)).as_py() + len(lines)
        self.n_held += len(lines)
        self.held = [*self.held, *lines.to_pylist()] if self.size <= self.limit else []

    def _release(self) -> bytes | None:
        """The held lines as one text, None when it is too long."""
        text = b"\n".join(self.held) if self.size <= self.limit else None
        self.held, self.n_held, self.size = [], 0, 0
        return text

    def feed(self, lines: pa.Array, outside: np.ndarray, inside: np.ndarray) -> pa.Array:
        """Records that end in these lines."""
        after = states_after(self.inside, outside, inside)
        self.inside = bool(after[-1])
        ends = np.flatnonzero(~after)
        if not len(ends):
            self._hold(lines)
            return lines.slice(0, 0)
        self._hold(lines.slice(0, ends[0] + 1))
        size, text = self.size, self._release()
        firsts = ends[:-1] + 1
        records = lines.take(pa.array(ends))
        if pc.max(pc.binary_length(records)).as_py() > self.limit:
            records = pc.if_else(pc.less_equal(pc.binary_length(records), self.limit), records, pa.scalar(None, records.type))
        several = np.flatnonzero(ends[1:] > firsts) + 1
        listed = {0: text}
        for k in several.tolist():
            self._hold(lines.slice(firsts[k - 1], ends[k] - firsts[k - 1] + 1))
            listed[k] = self._release()
        if len(several) or text is None or text != records[0].as_py():
            values = records.to_pylist()
            for k, value in listed.items():
                values[k] = value
            records = pa.array(values, lines.type)
        if not self.started:
            self.started, self.head, self.head_size = True, text, size
            records = records.slice(1)
        self.done += len(records)
        self._hold(lines.slice(ends[-1] + 1))
        return records


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Parts of batches that belong to one split. A task reads each of its splits whole and in order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        place = batch.column("file").to_numpy(), batch.column("block").to_numpy()
        change = np.flatnonzero((place[0][1:] != place[0][:-1]) | (place[1][1:] != place[1][:-1])) + 1
        bounds = [0, *change.tolist(), batch.num_rows]
        for start, stop in zip(bounds, bounds[1:], strict=False):
            yield (int(place[0][start]), int(place[1][start])), batch.slice(start, stop - start)


def _lines(spark: SparkSession, files: list[str]) -> DataFrame:
    # Only \n ends a line, so that \r\n inside quotes stays as it is
    return spark.read.option("lineSep", "\n").text(files).select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("line"),
    )


_ENDS = "done boolean, begun boolean, open boolean, head binary, head_size long, tail binary, tail_size long"
_SPLIT_DDL = f"file long, block long, from_outside struct<{_ENDS}>, from_inside struct<{_ENDS}>"


def _split_rows(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    key, walks = None, []
    end = pa.struct([(n, t) for n, t in zip(
        ("done", "begun", "open", "head", "head_size", "tail", "tail_size"),
        (pa.bool_(), pa.bool_(), pa.bool_(), pa.binary(), pa.int64(), pa.binary(), pa.int64()), strict=True,
    )])
    schema = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("from_outside", end), ("from_inside", end)])

    def row() -> pa.RecordBatch:
        ends = []
        for walk in walks:
            size, tail = walk.size, walk._release()
            ends.append(
                {"done": walk.done > 0, "begun": walk.started, "open": walk.inside, "head": walk.head,
                 "head_size": walk.head_size, "tail": tail, "tail_size": size}
            )
        values = {"file": key[0], "block": key[1], "from_outside": ends[0], "from_inside": ends[1]}
        return pa.RecordBatch.from_pylist([values], schema=schema)

    for at, part in _splits(batches):
        if at != key:
            if key is not None:
                yield row()
            key, walks = at, [_Walk(False, limit), _Walk(True, limit)]
        lines = part.column("line")
        functions = line_functions(lines)
        for walk in walks:
            walk.feed(lines, *functions)
    if key is not None:
        yield row()


def _with_beginnings(splits: DataFrame) -> DataFrame:
    """``inside``: whether the split begins inside quotes, by the same rule as for lines, over splits of a file."""
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    outside, inside = F.col("from_outside.open"), F.col("from_inside.open")
    turned = splits.withColumn("_swaps", F.sum((outside & ~inside).cast("int")).over(so_far) % 2)
    setter = F.when(outside == inside, outside.cast("int").bitwiseXOR(F.col("_swaps").cast("int")))
    turned = turned.withColumn("_set", setter)
    state = F.coalesce(F.last("_set", ignorenulls=True).over(earlier), F.lit(0)).bitwiseXOR(
        F.coalesce(F.last("_swaps").over(earlier), F.lit(0)).cast("int")
    )
    return turned.withColumn("inside", state == 1).drop("_swaps", "_set")


def _over_boundaries(splits: DataFrame, limit: int) -> DataFrame:
    """Records that begin in one split and end in a later one, or at the end of the file. Column ``record``."""
    own = splits.select("file", "block", F.when(F.col("inside"), F.col("from_inside")).otherwise(F.col("from_outside")).alias("own"))
    begun, header = F.col("own.begun"), (F.col("block") == 0) & ~F.col("own.done")
    closing = F.struct(
        F.lit(0).alias("part"), F.lit(0).alias("begins"), F.lit(False).alias("header"),
        F.col("own.head").alias("text"), F.col("own.head_size").alias("size"),
    )
    last = F.struct(
        F.lit(1).alias("part"), begun.cast("int").alias("begins"), header.alias("header"),
        F.col("own.tail").alias("text"), F.col("own.tail_size").alias("size"),
    )
    pieces = F.filter(F.array(closing, last), lambda piece: piece["size"] > 0)
    pieces = own.select("file", "block", F.inline(pieces))
    order = Window.partitionBy("file").orderBy("block", "part")
    pieces = pieces.withColumn("owner", F.sum("begins").over(order))
    # a text over the limit is not gathered
    total = F.sum("size").over(Window.partitionBy("file", "owner"))
    text = F.when(total <= limit, F.col("text").cast("string"))
    pieces = pieces.withColumn("total", total).withColumn("text", text)
    gathered = pieces.groupBy("file", "owner").agg(
        F.array_sort(F.collect_list(F.struct("block", "part", "text"))).alias("texts"),
        F.max("total").alias("total"),
        F.bool_or("header").alias("header"),
    )
    whole = F.when(F.col("total") <= limit, F.array_join(F.col("texts.text"), "\n"))
    return gathered.filter(~F.col("header")).select(whole.alias("record"))


def _in_splits(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    key, walk, header = None, None, False
    for at, part in _splits(batches):
        if at != key:
            inside = part.column("inside")[0].as_py()
            if inside is None:
                raise ValueError("the files are split otherwise than before: set spark.sql.files.minPartitionNum")
            key, walk, header = at, _Walk(inside, limit), at[1] == 0
        records = walk.feed(part.column("line"), *line_functions(part.column("line")))
        while header and len(records):
            header = (records[0].as_py() or b"x").strip() == b""
            records = records.slice(1)
        if len(records):
            try:
                texts = records.cast(pa.string())
            except pa.ArrowInvalid:
                texts = pa.array([r and r.decode(errors="replace") for r in records.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts], names=["record"])


def _groups(splits: DataFrame, files: list[str], most: int) -> list[list[str]]:
    """Files in groups of at most ``most`` splits; a file with more is a group of its own."""
    if splits.count() <= most:
        return [files]
    names = splits.sparkSession.createDataFrame([(f,) for f in files], "name string")
    counted = splits.groupBy("file").count().join(names.withColumn("file", F.xxhash64("name")), "file")
    groups, size = [[]], 0
    for row in counted.orderBy("name").select("name", "count").collect():
        if groups[-1] and size + row["count"] > most:
            groups.append([])
            size = 0
        groups[-1].append(row["name"])
        size += row["count"]
    return groups


def quoted_records(
    spark: SparkSession, files: list[str], returns: bool = False, limit: int = MAX_RECORD, most_splits: int = MAX_SPLITS
) -> DataFrame:
    """Column ``record``: every record of the files but their headers, in any order; null for one over ``limit`` bytes.

    Quotes are doubled inside quoted fields, fields are separated by commas and lines end with \\n, or with \\r\\n
    where ``returns``: these are \\n in the result. Blank lines between records are no records. A quoted field that is never closed takes the rest of its file, as
    in a single reader. The first pass runs here, the second where the result is used; both have
    to see the same splits, which Spark derives from the files and, unless ``spark.sql.files.minPartitionNum`` is
    set, the number of cores; the second pass fails if they changed.
    """
    splits = settle(_lines(spark, files).mapInArrow(lambda it: _split_rows(it, limit), _SPLIT_DDL))
    splits = _with_beginnings(splits)
    found = _over_boundaries(splits, limit)
    states = splits.select("file", "block", "inside")
    for group in _groups(splits, files, most_splits):
        lines, own = _lines(spark, group), states
        if len(group) < len(files):
            names = spark.createDataFrame([(f,) for f in group], "name string")
            own = states.join(names.select(F.xxhash64("name").alias("file")), "file", "left_semi")
        # a broadcast side leaves the order of lines alone; its rows are counted above
        held = lines.join(F.broadcast(own), ["file", "block"], "left")
        found = found.unionAll(held.mapInArrow(lambda it: _in_splits(it, limit), "record string"))
    if returns:
        found = found.select(F.expr("regexp_replace(replace(record, '\\r\\n', '\\n'), '\\r$', '')").alias("record"))
    return found.filter("record IS NULL OR record <> ''")


def _first_records(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The first record that is not blank, of the one file that a task reads; the rest is not read."""
    walk, name, found = _Walk(False, limit), None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        name, lines = batch.column("name")[0].as_py(), batch.column("line")
        records = walk.feed(lines, *line_functions(lines)).to_pylist()
        found = next((r or b"" for r in records if r is None or r.strip()), None)
        if found is not None or walk.size > limit:
            break
    if name is not None:
        text = (found or b"").decode(errors="replace")
        yield pa.RecordBatch.from_pydict({"name": [name], "header": [text]}, pa.schema([("name", pa.string()), ("header", pa.string())]))


def headers_of(spark: SparkSession, paths: str | list[str], limit: int = MAX_RECORD) -> dict[str, str]:
    """The first record of every file, by one job. A task per file reads until that record ends and no further."""
    apart = spark.newSession()  # its settings stay its own: no file is split, none shares a task
    for setting in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        apart.conf.set(setting, str(1 << 50))
    apart.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    lines = apart.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("name"), F.col("value").cast("binary").alias("line")
    )
    rows = lines.mapInArrow(lambda it: _first_records(it, limit), "name string, header string").collect()
    return {row["name"]: row["header"] for row in sorted(rows)}


def names_in(header: str) -> list[str]:
    """Column names of a header, trimmed and unquoted; commas inside quotes are part of a name."""
    text = header.lstrip("\ufeff").rstrip("\r")
    return [name.strip().strip('"') for name in next(csv.reader(text.splitlines(keepends=True)), [])]
