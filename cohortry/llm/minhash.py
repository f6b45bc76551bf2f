"""Near duplicates by DartMinHash signatures, banded joining and exact verification.

Signature: every element of a document (a shingle with a weight) throws darts. Its weight axis is split into
regions [0,1), [1,2), [2,4), ...; in each a Poisson process whose rate is the region's width places darts along
the rank axis, each with a weight inside the region and one of k coordinates. A dart counts if its weight is
below the element's. All of it is hashed from the element alone, so equal parts of two documents throw equal
darts, and the earliest dart of each coordinate agrees with probability (weighted) Jaccard similarity. A
document looks at about k ln k darts, however many elements it has.

Bands of the signature are buckets. Texts with the same words are one node. Small buckets compare all their
nodes, large ones compare every node with two pivots, which joins most of a large group; the nodes of a large bucket
that still lie in different classes are then compared with every node of another class that a prefix filter (rare
shared shingles, sizes, places) does not rule out, so no pair of a bucket is missed. Only compared pairs
of the given similarity, computed exactly from all their shingles, are links; classes are what links connect.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.components import components
from cohortry.llm.storage import stored
from cohortry.llm.words import Words, hash_sequences, hash_windows, hash_words, mix, slices, split_words, window_starts

SHINGLE = 5
THRESHOLD = 0.8
# at the threshold a pair misses all bands once in 30,000 times: (1 - 0.8^5)^26
BANDS = 26
ROWS = 5
# buckets up to this size compare all their nodes, larger ones each node with two pivots before they are closed
SMALL = 16
# nodes of one shingle that a task compares at a time
BLOCK = 256

_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each shingle; a text with fewer words than ``width`` is one shingle, if it has any."""
    hashed = hash_words(words)
    starts = window_starts(words.first, width)
    values = [hash_windows(hashed, width, _BASE)[starts]]
    owners = [np.searchsorted(words.first, starts, "right") - 1]
    count = words.per_text()
    for n in range(1, width):
        rows = np.flatnonzero(count == n)
        owners.append(rows)
        values.append(mix(hash_windows(hashed, n, _BASE)[words.first[rows]] + np.uint64(n)) if len(rows) else np.zeros(0, np.uint64))
    return np.concatenate(owners), np.concatenate(values)


def numbered(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (owner, value) with the number of equal pairs before each."""
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    fresh = np.append(True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1]))[: len(value)]
    place = np.arange(len(value))
    return owner, value, place - np.maximum.accumulate(np.where(fresh, place, 0))


def dart_signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """``n`` rows of ``k`` dart hashes; rows of owners without weight are zero.

    ``element`` are hashes, repeated (owner, element) pairs of equal weight change nothing.
    """
    signature, earliest = np.zeros((n, k), np.uint64), np.full(n * k, np.inf)
    total = np.bincount(owner, weight, n)
    # enough darts to fill nearly all coordinates; owners with a gap go on below
    reach = np.where(total > 0, (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300), -1)
    parts = []
    region, low, width = 0, 0.0, 1.0
    while True:
        held = np.flatnonzero(weight > low)
        if len(held) == 0:
            break
        parts.append((owner[held], mix(element[held] + np.uint64((int(_STEP) * (region + 1)) % 2**64)), weight[held], np.full(len(held), low), np.full(len(held), width)))
        region, low, width = region + 1, low + width, max(1.0, low + width)
    if not parts:
        return signature
    owner, seed, weight, low, width = (np.concatenate(c) for c in zip(*parts, strict=True))
    state, rank = seed, np.zeros(len(seed))

    def throw(rows: np.ndarray) -> None:
        """The next dart of these processes."""
        state[rows] = mix(state[rows] + _STEP)
        u = ((state[rows] >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53
        rank[rows] -= np.log(u) / width[rows]

    throw(np.arange(len(seed)))
    active = np.flatnonzero(rank <= reach[owner])
    while True:
        while len(active):
            dart = mix(state[active] ^ _STEP)
            above = low[active] + width[active] * (mix(dart) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            hit = above < weight[active]
            rows, dart = active[hit], dart[hit]
            slot = owner[rows] * k + (dart % np.uint64(k)).astype(np.int64)
            np.minimum.at(earliest, slot, rank[rows])
            first = rank[rows] == earliest[slot]
            signature.reshape(-1)[slot[first]] = dart[first]
            throw(active)
            active = active[rank[active] <= reach[owner[active]]]
        gap = np.isinf(earliest).reshape(n, k).any(axis=1) & (reach > 0)
        if not gap.any():
            return signature
        # darts beyond the old reach are all later than those kept, so only gaps are filled
        reach = np.where(gap, 2 * reach, -1)
        active = np.flatnonzero(rank <= reach[owner])


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows)
    hashed = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _STEP, parts.shape[:2])
    for row in range(rows):
        hashed = mix(hashed ^ parts[:, :, row]) * np.uint64(_BASE)
    return hashed


def _weights(owner: np.ndarray, value: np.ndarray, counted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not counted:
        return owner, value, np.ones(len(value))
    owner, value, turn = numbered(owner, value)
    last = np.append(turn[1:] == 0, True)[: len(turn)]
    return owner[last], value[last], turn[last] + 1.0


def _sign(batches: Iterator[pa.RecordBatch], width: int, bands: int, rows: int, counted: bool) -> Iterator[pa.RecordBatch]:
    """Per text: two hashes of its words in order, and its bands (none without words)."""
    for batch in slices(batches, limit=2 << 20):
        words = split_words(batch.column("text"))
        owner, value = shingles(words, width)
        signature = dart_signatures(*_weights(owner, value, counted), batch.num_rows, bands * rows)
        has = words.per_text() > 0
        hashed = band_hashes(signature[has], bands, rows)
        bounds = np.append(0, np.cumsum(np.where(has, bands, 0)))
        same = [pa.array(hash_sequences(words, seed).view(np.int64)) for seed in (2, 3)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *same, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(hashed.reshape(-1).view(np.int64)))],
            names=["doc_id", "same_a", "same_b", "bands"],
        )


def _shingle_sets(batches: Iterator[pa.RecordBatch], width: int, counted: bool) -> Iterator[pa.RecordBatch]:
    """Per text its distinct shingles; counted ones are numbered, so that set and multiset look alike."""
    for batch in slices(batches, limit=2 << 20):
        owner, value, turn = numbered(*shingles(split_words(batch.column("text")), width))
        value = np.where(turn > 0, mix(value ^ mix(turn.astype(np.uint64))), value)
        keep = np.ones(len(value), bool) if counted else turn == 0
        bounds = np.searchsorted(owner[keep], np.arange(batch.num_rows + 1))
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(value[keep].view(np.int64)))],
            names=["node", "shingles"],
        )


def _crowded(dealt: DataFrame) -> DataFrame:
    """(bucket, node, size) of the buckets with more than one node; most buckets hold one and go here."""
    sizes = dealt.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    return stored(dealt.join(sizes, "bucket").select("bucket", "node", "size"))


def _pairs(crowded: DataFrame, small: int) -> DataFrame:
    """(a, b) with a < b to compare.

    A small bucket is a list, each node of a large one meets two pivots: the node whose own hash is least,
    often the same in many buckets, and the one whose hash with the bucket is least, another in each. Both
    are minima, so no bucket is ever one task's list.
    """
    few = crowded.filter(F.col("size") <= small).groupBy("bucket").agg(F.collect_list("node").alias("pivot"))
    least = [F.min_by("node", F.xxhash64("node")), F.min_by("node", F.xxhash64("bucket", "node"))]
    many = crowded.filter(F.col("size") > small).groupBy("bucket").agg(F.array(*least).alias("pivot"))
    met = crowded.join(few.unionByName(many), "bucket").select("node", F.explode("pivot").alias("pivot"))
    ordered = met.filter("node != pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
    return ordered.distinct()


def _prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """(shingle, node, class, size, place) of the shingles by which nodes of different classes must meet.

    All nodes order their shingles alike: those of one class first, then by how many nodes hold them. A set of
    ``size`` that shares ``threshold`` with another has their first common shingle among its first
    size - threshold * size + 1, and shingles of one class are never common to two: they take their places but
    are not listed. ``sets`` are (node, class, shingles); only numbers per shingle are gathered.
    """
    sized = sets.withColumn("size", F.size("shingles"))
    each = sized.select("node", "class", "size", F.explode("shingles").alias("shingle"))
    held = each.groupBy("shingle").agg(F.count("*").alias("held"), F.min("class").alias("one"), F.max("class").alias("other"))
    shared = each.join(held.filter("one < other").select("shingle", "held"), "shingle")
    own = shared.groupBy("node", "class", "size").agg(F.sort_array(F.collect_list(F.struct("held", "shingle"))).alias("own"))
    # the shared ones come last, so the first of them has this many before it; a little more against rounding
    own = own.withColumn("before", F.col("size") - F.size("own"))
    length = F.floor((1 - F.lit(threshold)) * F.col("size") + 1 + 1e-6) - F.col("before")
    own = own.withColumn("own", F.slice("own", 1, F.greatest(length, F.lit(0)).cast("int")))
    listed = own.select("node", "class", "size", "before", F.posexplode("own").alias("k", "of"))
    return listed.select(F.col("of.shingle").alias("shingle"), "node", "class", "size", (F.col("before") + F.col("k")).alias("place"))


def _pairs_between(prefixes: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(a, b) of different classes that may have the similarity: all that do are among them.

    Every node of a shingle meets all nodes outside the shingle's largest class, unless their sizes or what
    follows the shingle in them rule the similarity out. A shingle of many nodes is dealt in blocks of ``block`` on
    both sides, so none is one task's list.
    """
    sides = prefixes.groupBy("shingle", "class").agg(F.count("*").alias("n"))
    groups = sides.groupBy("shingle").agg(
        F.max_by("class", F.struct("n", "class")).alias("major"), F.sum("n").alias("nodes"), F.count("*").alias("classes")
    )
    groups = groups.filter("classes > 1").select("shingle", "major", F.ceil(F.col("nodes") / block).cast("int").alias("blocks"))
    placed = prefixes.join(groups, "shingle")
    left = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    right = placed.filter("class != major").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left, right = left.alias("l"), right.alias("r")
    shared = F.least(F.col("l.size") - F.col("l.place"), F.col("r.size") - F.col("r.place"))
    needed = F.lit(threshold / (1 + threshold)) * (F.col("l.size") + F.col("r.size"))
    # two nodes outside the largest class would meet twice
    once = (F.col("l.class") == F.col("l.major")) | (F.col("l.node") < F.col("r.node"))
    met = left.join(
        right,
        (F.col("l.shingle") == F.col("r.shingle")) & (F.col("l.block") == F.col("r.block")) & (F.col("l.class") != F.col("r.class"))
        & once & (shared + 1e-6 >= needed),
    )
    return met.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame,
    width: int = SHINGLE,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
    weights: str = "set",
    small: int = SMALL,
) -> DataFrame:
    """doc_id, class_id, kept: classes of texts connected by Jaccard similarity of ``threshold`` or more.

    Similarity is that of shingles of ``width`` words (``weights="count"``: weighted by how often each
    occurs). A text with fewer words is one shingle; texts without words are in no class but their own.
    class_id is the smallest doc_id of the class, whose row is kept. Rows that repeat a doc_id are one
    document and share a class. A row without a doc_id has no class and is kept. Other columns are ignored.
    """
    counted = {"set": False, "count": True}[weights]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(
        texts.mapInArrow(lambda it: _sign(it, width, bands, rows, counted), "doc_id long, same_a long, same_b long, bands array<long>")
    )
    known = signed.filter("doc_id IS NOT NULL AND size(bands) > 0")
    nodes = stored(
        known.groupBy("same_a", "same_b").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    )
    crowded = _crowded(nodes.select(F.explode("bands").alias("bucket"), "node"))
    # texts are exchanged once, whatever number of them is named: only sets of these are kept
    named = crowded.select("node").distinct().hint("merge")
    wanted = texts.withColumnRenamed("doc_id", "node").join(named, "node", "left_semi")
    made = wanted.mapInArrow(lambda it: _shingle_sets(it, width, counted), "node long, shingles array<long>")
    # rows of one doc_id are one document: its shingles are those of all its texts
    sets = stored(made.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_set("shingles"))).alias("shingles")))
    classes = components(_verified(_pairs(crowded, small), sets, threshold))

    # the nodes of large buckets that hold more than one class meet all they may be similar to
    placed = crowded.filter(F.col("size") > small).join(classes, "node", "left")
    placed = stored(placed.select("bucket", "node", F.coalesce("class", "node").alias("class")))
    split = placed.groupBy("bucket").agg(F.min("class").alias("one"), F.max("class").alias("other")).filter("one < other")
    # a class found so far goes on as one link per node
    links = classes.select(F.col("node").alias("a"), F.col("class").alias("b"))
    if not split.isEmpty():
        again = placed.join(split.select("bucket"), "bucket").select("node", "class").distinct()
        prefixes = stored(_prefixes(stored(sets.join(again, "node")), threshold))
        links = links.unionByName(_verified(_pairs_between(prefixes, threshold), sets, threshold))

    # a copy is linked to the node of its words; a doc_id with several texts joins their classes
    copies = known.join(nodes.filter("copies > 1").select("same_a", "same_b", "node"), ["same_a", "same_b"])
    same = copies.select(F.col("node").alias("a"), F.col("doc_id").alias("b")).filter("a != b").distinct()
    found = components(links.unionByName(same))
    ids = signed.select("doc_id")
    joined = ids.join(found, ids["doc_id"] == found["node"], "left")
    class_id = F.coalesce("class", "doc_id")
    return joined.select("doc_id", class_id.alias("class_id"), class_id.eqNullSafe(F.col("doc_id")).alias("kept"))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose shingle sets have the similarity."""
    both = pairs.join(sets.toDF("a", "left"), "a").join(sets.toDF("b", "right"), "b")
    shared = F.size(F.array_intersect("left", "right"))
    alike: Column = shared >= F.lit(threshold) * (F.size("left") + F.size("right") - shared)
    return both.filter(alike).select("a", "b")
