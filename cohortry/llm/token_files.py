"""Token ids in sharded files, and a minimal perfect hash index from document keys to their places.

Files: shards in ascending doc_id order, each a sequence of blocks; a block holds the raw ids of whole
documents (16 or 32 bits each, little-endian) with their keys and lengths. Index: keys are dealt into
buckets of about two thousand; a bucket's hash function sends its n keys to n slots without gap or
clash (groups of keys displaced by a pilot, as in compress-hash-displace). A slot stores a 32-bit
fingerprint of its key, which turns foreign keys away, and the place of the document.

Layout for keyed access: a folder per shard with a few blocks to a row group, and the index in sections of some
sixteen buckets, a folder each. A few keys name their buckets, hence sections, and the places found name
shards and blocks: nothing else is opened.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.encoding import encoder
from cohortry.llm.storage import scratch_folder, shuffle_width
from cohortry.llm.words import mix, slices

BLOCK_BYTES = 1 << 20
BUCKET_KEYS = 2000
SECTION_BUCKETS, MAX_SECTIONS = 16, 20_000
GROUP_BLOCKS = 4  # blocks to a row group
FEW = 1000  # buckets or blocks that are named to the reader; beyond, all are read

_BLOCK = pa.schema(
    [("shard", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()),
     ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("payload", pa.binary())]
)
_BLOCK_DDL = (
    "shard int, block int, before long, n_ids long, doc_ids array<long>, lengths array<int>, payload binary"
)
_PLACE_DDL = "shard int, block int, place int, start long, n_tokens int"
_BUCKET_DDL = (
    "bucket int, pilots binary, prints binary, shard binary, block binary, place binary, start binary, n_tokens binary, section int"
)


@dataclass(frozen=True)
class TokenFiles:
    payload: str  # folder of the blocks
    index: str  # folder of the index buckets
    buckets: int
    dtype: str


def write_token_files(
    docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, shards: int | None = None
) -> TokenFiles:
    """Encode every whole text, append ``end_id``, write shards and index; null texts count as empty.

    A repeated doc_id keeps all its rows: the key is (doc_id, how many rows of it came before, by
    text). A null doc_id is a key like any other and comes first. An empty table gives empty files.
    """
    spark = docs.sparkSession
    folder = folder or scratch_folder(spark)
    dtype = _id_type(tokenizer, end_id)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        encode, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        keys, lengths, parts, size, block, before = [], [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            row = [shard, block, before, size, keys, lengths, b"".join(parts)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _BLOCK, strict=True)], schema=_BLOCK)

        for batch in slices(batches, limit=1 << 20):
            texts = batch.column("text").fill_null("").to_pylist()
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                ids = np.frombuffer(encode.encode(text) + end, "<u4")
                if parts and (size + len(ids)) * np.dtype(dtype).itemsize > BLOCK_BYTES:
                    yield close()
                    block, before = block + 1, before + size
                    keys, lengths, parts, size = [], [], [], 0
                keys.append(doc_id)
                lengths.append(len(ids))
                parts.append(ids.astype(dtype).tobytes())
                size += len(ids)
        if parts:
            yield close()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(
        shards or shuffle_width(spark), "doc_id"
    )
    ordered.sortWithinPartitions("doc_id", "text").mapInArrow(blocks, _BLOCK_DDL).write.options(
        **{"parquet.block.row.count.limit": GROUP_BLOCKS, "parquet.enable.dictionary": False}
    ).partitionBy("shard").parquet(f"{folder}/payload")
    buckets = _write_index(spark, f"{folder}/payload", f"{folder}/index")
    return TokenFiles(f"{folder}/payload", f"{folder}/index", buckets, dtype)


def _id_type(tokenizer: str, end_id: int) -> str:
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def _write_index(spark: SparkSession, payload: str, index: str) -> int:
    """One row per bucket of keys. Only the shards' sizes pass the driver."""
    blocks = _read_payload(spark, payload)
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"), F.sum(F.size("doc_ids")).alias("docs")).collect()
    sizes.sort(key=lambda row: row["shard"])
    starts = np.append(0, np.cumsum([row["n"] for row in sizes])).tolist()
    shards = spark.createDataFrame(
        [(row["shard"], start) for row, start in zip(sizes, starts, strict=False)], "shard int, shard_start long"
    )
    buckets = max(1, -(-sum(row["docs"] for row in sizes) // BUCKET_KEYS))
    held = blocks.join(shards, "shard").select(
        "shard", "block", (F.col("shard_start") + F.col("before")).alias("start"), "doc_ids", "lengths"
    )
    rows = held.mapInArrow(_places, f"doc_id long, {_PLACE_DDL}")
    # how many rows of the same key came before; equal keys lie in one shard, next to each other
    rows = rows.withColumn("bucket", _bucket(buckets)).withColumn("section", _section(buckets))
    built = rows.repartition(_sections(buckets), "section").groupBy("section", "bucket").applyInArrow(_build_bucket, _BUCKET_DDL)
    built.write.option("parquet.block.row.count.limit", SECTION_BUCKETS).partitionBy("section").parquet(index)
    return buckets


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")


def _sections(buckets: int) -> int:
    return min(-(-buckets // SECTION_BUCKETS), MAX_SECTIONS)


def _section(buckets: int):
    return F.col("bucket") % _sections(buckets)


def _read_payload(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_BLOCK_DDL).parquet(path)


def _few(rows: DataFrame, *columns: str) -> list | None:
    """Distinct values, or None when they are more than ``FEW``."""
    found = rows.select(*columns).distinct().limit(FEW + 1).collect()
    return found if len(found) <= FEW else None


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = batch.column("lengths")
        each = [np.asarray(x, np.int64) for x in lengths.to_pylist()]
        if not each:
            continue
        n = np.array([len(x) for x in each])
        place = np.concatenate([np.cumsum(x) - x for x in each])
        wide = lambda name: np.repeat(batch.column(name).to_numpy(zero_copy_only=False), n)
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_ids").flatten(), "shard": pa.array(wide("shard"), pa.int32()),
                "block": pa.array(wide("block"), pa.int32()), "place": pa.array(place, pa.int32()),
                "start": pa.array(wide("start") + place, pa.int64()), "n_tokens": pa.array(np.concatenate(each), pa.int32()),
            }
        )


def _key_hash(doc_id: np.ndarray, turn: np.ndarray, pilot) -> np.ndarray:
    """Hash of (doc_id, turn) under a pilot, which may be an array to broadcast against."""
    pilot = np.asarray(pilot, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(mix(doc_id + pilot) ^ (turn * np.uint64(0xD6E8FEB86659FD93) + pilot))


_GROUP, _PRINT = 1 << 40, 1 << 41  # pilots never tried for slots


def perfect_hash(doc_id: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pilots by group, and the slot of each key; keys are distinct pairs of 64-bit numbers.

    Groups take their pilots largest first; a group of one takes a free slot outright (-1 - slot).
    """
    n = len(doc_id)
    groups = max(1, -(-n // 4))
    group = (_key_hash(doc_id, turn, _GROUP) % np.uint64(groups)).astype(np.int64)
    members = np.split(np.argsort(group, kind="stable"), np.cumsum(np.bincount(group, minlength=groups))[:-1])
    free, pilots, slots = np.ones(n, bool), np.zeros(groups, np.int64), np.zeros(n, np.int64)
    sizes = np.array([len(own) for own in members])
    for size in np.unique(sizes[sizes > 1])[::-1].tolist():
        for alike in np.array_split(np.flatnonzero(sizes == size), -(-int((sizes == size).sum()) // 256)):
            _place_groups(alike, np.stack([members[g] for g in alike]), doc_id, turn, free, pilots, slots)
    single = np.flatnonzero(sizes == 1)
    left = np.flatnonzero(free)[: len(single)]
    slots[[members[g][0] for g in single]] = left
    pilots[single] = -1 - left
    return pilots, slots


def _place_groups(group, own, doc_id, turn, free, pilots, slots, trials: int = 256) -> None:
    """The first pilot that sends a group's keys (a row of ``own``) to different free slots, group after group.

    Slots under the first pilots are computed for all groups at once; a group that fits none of them goes on alone.
    """
    n = np.uint64(len(free))
    trial = np.arange(trials)[:, None, None]
    tried = (_key_hash(doc_id[own], turn[own], trial) % n).astype(np.int64).transpose(1, 0, 2)
    ordered = np.sort(tried, axis=2)
    apart = (ordered[:, :, 1:] != ordered[:, :, :-1]).all(axis=2)
    for g, keys, options, good in zip(group.tolist(), own, tried, apart, strict=True):
        base, good = 0, good & free[options].all(axis=1)
        while not good.any():
            base += trials
            options = (_key_hash(doc_id[keys], turn[keys], base + trial[:, 0]) % n).astype(np.int64)
            ordered = np.sort(options, axis=1)
            good = free[options].all(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
        pick = int(good.argmax())
        slots[keys], pilots[g] = options[pick], base + pick
        free[options[pick]] = False


def find_slots(pilots: np.ndarray, n: int, doc_id: np.ndarray, turn: np.ndarray) -> np.ndarray:
    pilot = pilots[(_key_hash(doc_id, turn, _GROUP) % np.uint64(len(pilots))).astype(np.int64)]
    tried = _key_hash(doc_id, turn, np.maximum(pilot, 0)) % np.uint64(n)
    return np.where(pilot < 0, -1 - pilot, tried.astype(np.int64))


def _key_columns(table: pa.Table) -> np.ndarray:
    """doc_id as 64 bits; null has a value of its own that the turn tells apart from a like doc_id."""
    return table.column("doc_id").fill_null(-(1 << 63)).to_numpy().view(np.uint64)


def _null_turn(table: pa.Table, turn: np.ndarray) -> np.ndarray:
    missing = table.column("doc_id").is_null().to_numpy()
    return turn.astype(np.uint64) | (missing.astype(np.uint64) << np.uint64(63))


def _build_bucket(table: pa.Table) -> pa.Table:
    table = table.sort_by([("doc_id", "ascending"), ("start", "ascending")])
    key, missing = _key_columns(table), table.column("doc_id").is_null().to_numpy()
    fresh = np.append(True, (key[1:] != key[:-1]) | (missing[1:] != missing[:-1]))
    order = np.arange(len(key))
    turn = _null_turn(table, order - np.maximum.accumulate(np.where(fresh, order, 0)))
    pilots, slots = perfect_hash(key, turn)
    to_key = np.argsort(slots)
    prints = (_key_hash(key, turn, _PRINT) >> np.uint64(32)).astype(np.uint32)[to_key]
    place = {name: table.column(name)[0].as_py() for name in ("section", "bucket")}
    row = {"bucket": place["bucket"], "pilots": pilots.tobytes(), "prints": prints.tobytes()}
    for name in ("shard", "block", "place", "start", "n_tokens"):
        row[name] = table.column(name).to_numpy()[to_key].tobytes()
    schema = [("bucket", pa.int32()), *[(k, pa.binary()) for k in list(row)[1:]], ("section", pa.int32())]
    return pa.Table.from_pylist([{**row, "section": place["section"]}], schema=pa.schema(schema))


def locate(files: TokenFiles, keys: DataFrame, few: bool = False) -> DataFrame:
    """Places of keys (doc_id, turn: 0 for the first row of a doc_id): one probe of the index per key.

    Keys that the files do not hold give no row (a foreign key passes its fingerprint once in 2^32). With ``few``
    the keys are looked at first, and only their buckets are read where these are at most ``FEW``.
    """

    def probe(wanted: pa.Table, held: pa.Table) -> pa.Table:
        names = ("shard", "block", "place", "start", "n_tokens")
        kinds = (np.int32, np.int32, np.int32, np.int64, np.int32)
        schema = [("doc_id", pa.int64()), ("turn", pa.int32()), *[(k, pa.from_numpy_dtype(t)) for k, t in zip(names, kinds, strict=True)]]
        if not (wanted.num_rows and held.num_rows):
            return pa.schema(schema).empty_table()
        row = held.to_pylist()[0]
        key, turn = _key_columns(wanted), _null_turn(wanted, wanted.column("turn").to_numpy())
        prints = np.frombuffer(row["prints"], np.uint32)
        slot = find_slots(np.frombuffer(row["pilots"], np.int64), len(prints), key, turn)
        own = prints[slot] == (_key_hash(key, turn, _PRINT) >> np.uint64(32)).astype(np.uint32)
        found = {k: np.frombuffer(row[k], t)[slot[own]] for k, t in zip(names, kinds, strict=True)}
        mask = pa.array(own)
        return pa.table({"doc_id": wanted.column("doc_id").filter(mask), "turn": wanted.column("turn").filter(mask), **found}, schema=pa.schema(schema))

    index = keys.sparkSession.read.schema(_BUCKET_DDL).parquet(files.index)
    wanted = keys.select("doc_id", F.col("turn").cast("int").alias("turn")).withColumn("bucket", _bucket(files.buckets))
    named = _few(wanted.withColumn("section", _section(files.buckets)), "section", "bucket") if few else None
    if named is not None:
        in_place = F.col("section").isin(sorted({r["section"] for r in named}))
        index = index.filter(in_place & F.col("bucket").isin(sorted({r["bucket"] for r in named})))
    index = index.drop("section")
    return wanted.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(probe, f"doc_id long, turn int, {_PLACE_DDL}")


def fetch(files: TokenFiles, keys: DataFrame) -> DataFrame:
    """doc_id, turn, start, ids (array) of some keys.

    Where the keys lie in at most ``FEW`` buckets and blocks, only these are opened: folders of their sections and
    shards by partition, row groups by bucket and block. More keys are joined to one scan.
    """
    dtype = files.dtype

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["payload"], dtype)
                yield pa.RecordBatch.from_pylist(
                    [{"doc_id": d["doc_id"], "turn": d["turn"], "start": d["start"], "ids": ids[d["place"] : d["place"] + d["n_tokens"]].tolist()} for d in row["wanted"]],
                    pa.schema([("doc_id", pa.int64()), ("turn", pa.int32()), ("start", pa.int64()), ("ids", pa.list_(pa.int32()))]),
                )

    places = locate(files, keys, few=True)
    payload = _read_payload(keys.sparkSession, files.payload).select("shard", "block", "payload")
    named = _few(places, "shard", "block")
    if named is not None:
        in_place = F.col("shard").isin(sorted({r["shard"] for r in named}))
        payload = payload.filter(in_place & F.col("block").isin(sorted({r["block"] for r in named})))
    wanted = places.groupBy("shard", "block").agg(
        F.collect_list(F.struct("doc_id", "turn", "place", "n_tokens", "start")).alias("wanted")
    )
    return payload.join(wanted, ["shard", "block"]).select("payload", "wanted").mapInArrow(
        cut, "doc_id long, turn int, start long, ids array<int>"
    )


def read_all(files: TokenFiles, keys: DataFrame) -> DataFrame:
    """doc_id, turn, start, n_tokens, ids_crc32 of all keys: index probes joined to one scan of the blocks.

    Only checksums leave the scan, so no payload is shuffled.
    """
    dtype = files.dtype

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["payload"], dtype)
                ends = np.cumsum(row["lengths"])
                sums = [zlib.crc32(ids[e - n : e].astype("<u4").tobytes()) for e, n in zip(ends, row["lengths"], strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": pa.array([row["shard"]] * len(sums), pa.int32()), "block": pa.array([row["block"]] * len(sums), pa.int32()),
                        "place": pa.array(ends - row["lengths"], pa.int32()), "ids_crc32": pa.array(sums, pa.int64()),
                    }
                )

    payload = _read_payload(keys.sparkSession, files.payload).select("shard", "block", "lengths", "payload")
    read = payload.mapInArrow(check, "shard int, block int, place int, ids_crc32 long")
    return locate(files, keys).join(read, ["shard", "block", "place"]).select(
        "doc_id", "turn", "start", F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32"
    )


def keys_of(docs: DataFrame) -> DataFrame:
    """(doc_id, turn) of every row; rows are counted per doc_id before they meet."""
    counted = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).count()
    return counted.select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("count") - 1).cast("int"))).alias("turn"))
