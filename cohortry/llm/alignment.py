"""Alignment of two tokenizers over the same bytes, and corpus counts of the ids they link.

Token ends of both tokenizers cut a text's bytes into groups wherever they meet. A range of a text's bytes is a
fragment: the tokens up to the first meeting in it (open prefix), the groups behind (closed), and the tokens after
the last meeting (open suffix). Two neighbouring fragments make one: the left one's suffix and the right one's
prefix become a closed group, or stay open where there is no meeting. That is associative, so the chunks of a very
long document are aligned by many tasks, and only their open ends are composed, a few at a time, in a tree.

A byte-level BPE always breaks between a character that is not white space and a blank, and so does the piece
model, none of whose pieces has a blank behind another character (this is checked). So a text falls into segments
there; each distinct one is encoded and aligned once per worker, and texts are put together from them.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.encoding import WordEncoder, byte_letters
from cohortry.llm.storage import shuffle_width, stored
from cohortry.llm.words import slices
from cohortry.llm.worker_memory import kept

# texts of more bytes than this are aligned in chunks
CHUNK_BYTES = 1 << 16
# fragments composed by one task at a time
FAN = 16
# a count table of at most so many links goes to every task (about 50 MB); a longer one is joined
BROADCAST_LINKS = 1_000_000
_SALTS = 16

# white space as the byte-level pattern has it: without the separators U+001C to U+001F
_WHITE = re.compile(r"[^\S\x1c-\x1f]")
_WHITE_BLANK = re.compile(r"[^\S\x1c-\x1f] ")
_BREAK = re.compile(r"(?<=[\S\x1c-\x1f]) ")


class Tokens(NamedTuple):
    """Tokens of segments, one after another: ids, where each ends, and whether each segment's bytes are kept."""

    a: np.ndarray
    a_ends: np.ndarray
    b: np.ndarray
    b_ends: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    sound: np.ndarray


def split_segments(text: str) -> list[str]:
    """Segments of a blank and ``text``, each without its leading blank."""
    return _BREAK.split(text) if _WHITE_BLANK.search(f" {text}") else text.split(" ")


class Aligner:
    """Aligned segments of two tokenizer files; up to ``limit`` distinct ones are kept."""

    def __init__(self, a_path: str, b_path: str, limit: int = 300_000) -> None:
        import sentencepiece

        with open(a_path, encoding="utf-8") as file:
            held = json.load(file)
        if held["pre_tokenizer"]["type"] != "ByteLevel" or held.get("normalizer"):
            raise ValueError("the first tokenizer has to be a byte-level BPE")
        letters = {letter: byte for byte, letter in enumerate(byte_letters())}
        self.first = WordEncoder(a_path, limit, pieces=limit)
        self.first.tokenizer.encode_special_tokens = True
        special = {t["id"] for t in held["added_tokens"]}
        self.a_bytes = [b""] * self.first.tokenizer.get_vocab_size()
        for token, k in held["model"]["vocab"].items():
            self.a_bytes[k] = token.encode() if k in special else bytes(map(letters.__getitem__, token))
        self.second = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.second.id_to_piece(k) for k in range(self.second.vocab_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece of the second tokenizer goes on behind a blank")
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.second.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.blank = self.second.piece_to_id("▁")
        self.a_size, self.b_size = (np.array([len(x) for x in known], np.int64) for known in (self.a_bytes, self.b_bytes))
        self.shift = link_shift(len(pieces))
        self.digits = list(map(str, range(max(len(self.a_bytes), len(pieces)))))
        self.limit = limit
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[str] = []
        self.links, self.numbers, self.bounds = np.zeros(0, np.int64), np.zeros((0, 5), np.int64), np.zeros(1, np.int64)

    def tokens(self, segments: list[str]) -> Tokens:
        whole = [f" {s}" for s in segments]
        # words of the byte-level encoder; only a segment with further white space holds several
        cut = [[w] if s.isprintable() and " " not in s else self.first.split(w) for s, w in zip(segments, whole, strict=True)]
        packed = self.first.words(list(chain.from_iterable(cut)))
        self.first.forget()  # segments are kept here
        per_word = np.fromiter(map(len, packed), np.int64, len(packed)) >> 2
        n_words = np.fromiter(map(len, cut), np.int64, len(cut))
        n_a = np.diff(np.append(0, np.cumsum(per_word))[np.append(0, np.cumsum(n_words))])
        a = np.frombuffer(b"".join(packed), "<u4").astype(np.int64)
        b_ids = self.second.encode(segments, out_type=int, num_threads=1) if segments else []
        b_ids = [ids if s else [self.blank] for s, ids in zip(segments, b_ids, strict=True)]
        n_b = np.fromiter(map(len, b_ids), np.int64, len(b_ids))
        b = np.fromiter(chain.from_iterable(b_ids), np.int64, int(n_b.sum()))
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        return Tokens(a, a_ends, b, b_ends, n_a, n_b, self._sound([s.encode() for s in whole], a, a_ends, n_a, b, b_ends, n_b))

    def _sound(self, whole: list[bytes], a, a_ends, n_a, b, b_ends, n_b) -> np.ndarray:
        """Whether each segment's tokens give its bytes, by both tokenizers. Most do, so all are compared at once first."""
        sizes = np.fromiter(map(len, whole), np.int64, len(whole))
        sound = np.ones(len(whole), bool)
        for ids, ends, n, known in ((a, a_ends, n_a, self.a_bytes), (b, b_ends, n_b, self.b_bytes)):
            sound &= np.diff(np.append(0, ends)[np.append(0, np.cumsum(n))]) == sizes
            kept = ids[np.repeat(sound, n)].tolist()
            if b"".join(map(known.__getitem__, kept)) != b"".join(w for w, ok in zip(whole, sound.tolist(), strict=True) if ok):
                last = np.cumsum(n)
                each = zip(whole, (last - n).tolist(), last.tolist(), strict=True)
                sound &= np.array([b"".join(known[k] for k in ids[i:j]) == w for w, i, j in each], bool)
        return sound

    def groups(self, a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray, meet: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Texts, numbers of links, and links of the groups that end at ``meet``."""
        of_a, of_b = np.searchsorted(meet, a_ends), np.searchsorted(meet, b_ends)
        in_a, in_b = np.bincount(of_a, minlength=len(meet)), np.bincount(of_b, minlength=len(meet))
        first_b = np.cumsum(in_b) - in_b
        times = in_b[of_a]
        step = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        links = (np.repeat(a, times) << self.shift) | b[np.repeat(first_b[of_a], times) + step]
        a_text, b_text = (list(map(self.digits.__getitem__, ids.tolist())) for ids in (a, b))
        texts, i, j = [], 0, 0
        for m, n in zip(in_a.tolist(), in_b.tolist(), strict=True):
            texts.append(f"{a_text[i]}|{b_text[j]}" if m == n == 1 else f"{','.join(a_text[i : i + m])}|{','.join(b_text[j : j + n])}")
            i, j = i + m, j + n
        return texts, in_a * in_b, links

    def learn(self, segments: list[str]) -> None:
        t = self.tokens(segments)
        a_keep, b_keep = np.repeat(t.sound, t.n_a), np.repeat(t.sound, t.n_b)
        a, b = t.a[a_keep], t.b[b_keep]
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        meet = np.intersect1d(a_ends, b_ends, assume_unique=True)
        texts, n_links, links = self.groups(a, a_ends, b, b_ends, meet)
        sizes = np.array([len(s.encode()) + 1 if ok else 0 for s, ok in zip(segments, t.sound, strict=True)], np.int64)
        last = np.searchsorted(meet, np.cumsum(sizes), "right")
        first = np.append(0, last[:-1])
        total = np.append(0, np.cumsum(n_links))
        per_segment = total[last] - total[first]
        code = len(self.texts)
        self.known.update(zip(segments, range(code, code + len(segments)), strict=True))
        self.texts += [";".join(texts[i:j]) for i, j in zip(first.tolist(), last.tolist(), strict=True)]
        numbers = np.stack([t.n_a * t.sound, t.n_b * t.sound, last - first, per_segment, t.sound], 1)
        self.numbers = np.concatenate([self.numbers, numbers])
        self.links = np.concatenate([self.links, links])
        self.bounds = np.append(self.bounds, self.bounds[-1] + np.cumsum(per_segment))

    def codes(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(text, segment's code) of all segments."""
        flat = [s for each in texts for s in each]
        new = {s for s in flat if s not in self.known}
        if len(self.known) + len(new) > self.limit:
            self.forget()
            new = set(flat)
        if new:
            self.learn(list(new))
        owner = np.repeat(np.arange(len(texts)), [len(each) for each in texts])
        return owner, np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))


def link_shift(b_size: int) -> int:
    """An A id lies so many bits above its B id in a link."""
    return b_size.bit_length()


def aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner per Python worker and pair of files; its segments serve all later tasks."""
    return kept(("aligner", a_path, b_path), lambda: Aligner(a_path, b_path))


_NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]
_PART_DDL = "row long, doc_id long, part int, n_a long, n_b long, n_groups long, n_links long, groups string, links array<long>, times array<int>"
_ENDS_DDL = "row long, idx int, closes boolean, at int, prefix_a array<int>, prefix_b array<int>, suffix_a array<int>, suffix_b array<int>, sound boolean"


def _lists(values: np.ndarray, owner: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    bounds = pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32())
    return pa.ListArray.from_arrays(bounds, pa.array(values, kind))


def _counted(owner: np.ndarray, links: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, link), sorted, and their added weights."""
    order = np.lexsort((links, owner))
    owner, links, weight = owner[order], links[order], weight[order]
    begin = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (links[1:] != links[:-1]))[: len(owner)])
    return owner[begin], links[begin], np.add.reduceat(weight, begin) if len(begin) else weight


def _short(batches: Iterator[pa.RecordBatch], paths: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    """Whole texts, each one part."""
    own = aligner(*paths)
    for batch in slices(batches, limit=1 << 20):
        n = batch.num_rows
        texts = batch.column("text").fill_null("").to_pylist()
        owner, code = own.codes([split_segments(t) if t else [] for t in texts])
        unsound = np.bincount(owner, own.numbers[code, 4] == 0, n) > 0
        owner, code = owner[~unsound[owner]], code[~unsound[owner]]
        sums = [np.bincount(owner, own.numbers[code, k], n).astype(np.int64) for k in range(4)]
        bounds = np.searchsorted(owner, np.arange(n + 1))
        listed = list(map(own.texts.__getitem__, code.tolist()))
        groups = [";".join(listed[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
        owner, code, often = _counted(owner, code, np.ones(len(owner), np.int64))
        size = own.bounds[code + 1] - own.bounds[code]
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        owner, links, times = _counted(np.repeat(owner, size), own.links[np.repeat(own.bounds[code], size) + step], np.repeat(often, size))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("doc_id"), pa.array(np.zeros(n, np.int32)), *map(pa.array, sums), pa.array(groups, pa.string()),
             _lists(links, owner, n, pa.int64()), _lists(times, owner, n, pa.int32())],
            names=["row", "doc_id", "part", *_NUMBERS, "groups", "links", "times"],
        )


def _breaks_at(data: bytes, place: int) -> bool:
    """Whether a segment begins at ``place``, which holds a blank."""
    before = place - 1
    while before > 0 and data[before] & 0xC0 == 0x80:
        before -= 1
    return place == 0 or not _WHITE.match(data[before:place].decode())


def _segment_around(data: bytes, place: int) -> tuple[int, int]:
    """The segment that holds the byte at ``place``."""
    begin = data.rfind(b" ", 0, place + 1)
    while not _breaks_at(data, begin):
        begin = data.rfind(b" ", 0, begin)
    end = data.find(b" ", place + 1)
    while end >= 0 and not _breaks_at(data, end):
        end = data.find(b" ", end + 1)
    return begin, end if end >= 0 else len(data)


def byte_chunks(text: str, size: int) -> list[tuple[str, int, int]]:
    """(segments that touch the chunk, bytes of them before it, bytes of the chunk) for each chunk of a blank and ``text``.

    Chunks have ``size`` bytes and may begin and end inside a segment. One longer than a chunk stays in one piece.
    """
    data = b" " + text.encode()
    cuts, around = [0], [(0, 0)]
    while cuts[-1] + size < len(data):
        cut = cuts[-1] + size
        begin, end = _segment_around(data, cut)
        if end - begin > size and begin < cut:
            cut, begin, end = end, end, end
        if cut >= len(data):
            break
        cuts.append(cut)
        around.append((begin, end if begin < cut else cut))
    cuts.append(len(data))
    around.append((len(data), len(data)))
    return [
        (data[begin:end].decode(), cut - begin, after - cut)
        for cut, after, (begin, _), (_, end) in zip(cuts[:-1], cuts[1:], around[:-1], around[1:], strict=True)
    ]


def _cut(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
            bodies, leads, sizes = zip(*byte_chunks(text, size), strict=True)
            n = len(bodies)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row] * n, pa.int64()), pa.array([doc_id] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(bodies, pa.string()),
                 pa.array(leads, pa.int64()), pa.array(sizes, pa.int64())],
                names=["row", "doc_id", "idx", "text", "lead", "size"],
            )


class Fragment(NamedTuple):
    """The open ends of a byte range. Without a meeting (``closes``) all tokens are in the prefix.

    ``at`` is the chunk with the first meeting, at which the prefix will end as a group.
    """

    closes: bool
    at: int
    prefix_a: list[int]
    prefix_b: list[int]
    suffix_a: list[int]
    suffix_b: list[int]


def compose(left: Fragment, right: Fragment) -> tuple[Fragment, tuple[int, list[int], list[int]] | None]:
    """Both ranges as one, and the group that closes between them, if one does."""
    joint = left.suffix_a + right.prefix_a, left.suffix_b + right.prefix_b
    if left.closes and right.closes:
        return Fragment(True, left.at, left.prefix_a, left.prefix_b, right.suffix_a, right.suffix_b), (right.at, *joint)
    if left.closes:
        return left._replace(suffix_a=joint[0], suffix_b=joint[1]), None
    return right._replace(prefix_a=left.prefix_a + right.prefix_a, prefix_b=left.prefix_b + right.prefix_b), None


def _chunk_parts(batches: Iterator[pa.RecordBatch], paths: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    """Per chunk its closed groups as a part, and its open ends."""
    own = aligner(*paths)
    for batch in slices(batches):
        rows = []
        for chunk in batch.to_pylist():
            t = own.tokens(split_segments(chunk["text"][1:]))
            a_ends, b_ends = t.a_ends - chunk["lead"], t.b_ends - chunk["lead"]
            in_a, in_b = ((ends > 0) & (ends <= chunk["size"]) for ends in (a_ends, b_ends))
            a, a_ends, b, b_ends = t.a[in_a], a_ends[in_a], t.b[in_b], b_ends[in_b]
            sound = bool(t.sound.all())
            meet = np.intersect1d(a_ends, b_ends, assume_unique=True) if sound else np.zeros(0, np.int64)
            row = {k: chunk[k] for k in ("row", "doc_id", "idx")} | {"sound": sound, "closes": len(meet) > 0, "at": chunk["idx"], "part": 2 * chunk["idx"] + 1}
            if len(meet):
                i, j = (np.searchsorted(ends, [meet[0], meet[-1]], "right") for ends in (a_ends, b_ends))
                texts, n_links, links = own.groups(a[i[0] : i[1]], a_ends[i[0] : i[1]], b[j[0] : j[1]], b_ends[j[0] : j[1]], meet[1:])
                links, times = np.unique(links, return_counts=True)
                row |= {"prefix_a": a[: i[0]], "prefix_b": b[: j[0]], "suffix_a": a[i[1] :], "suffix_b": b[j[1] :], "groups": ";".join(texts), "links": links, "times": times}
                row |= {"n_a": i[1] - i[0], "n_b": j[1] - j[0], "n_groups": len(texts), "n_links": n_links.sum()}
            else:
                row |= {"prefix_a": a, "prefix_b": b} | dict.fromkeys(_NUMBERS, 0) | {"groups": ""} | dict.fromkeys(("suffix_a", "suffix_b", "links", "times"), [])
            rows.append(row)
        yield pa.RecordBatch.from_pylist(rows, _CHUNK)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


_CHUNK_DDL = f"{_PART_DDL}, {_ENDS_DDL.split(', ', 1)[1]}"
_CHUNK = _schema(_CHUNK_DDL)
_ROUND_DDL = f"{_ENDS_DDL}, groups_at array<int>, groups_a array<array<int>>, groups_b array<array<int>>"


def _compose_group(table: pa.Table, fan: int) -> pa.Table:
    """A few neighbouring fragments of one document as one, with the groups that close between them."""
    rows = sorted(table.to_pylist(), key=lambda r: r["idx"])
    whole, closed = None, []
    for row in rows:
        own = Fragment(*(row[k] for k in Fragment._fields))
        if whole is None:
            whole = own
        else:
            whole, group = compose(whole, own)
            closed += [group] if group else []
    at, a, b = zip(*closed, strict=True) if closed else ((), (), ())
    row = {"row": rows[0]["row"], "idx": rows[0]["idx"] // fan, **whole._asdict(), "sound": all(r["sound"] for r in rows), "groups_at": at, "groups_a": a, "groups_b": b}
    lists = pa.list_(pa.list_(pa.int32()))
    schema = pa.schema([*_schema(_ENDS_DDL), ("groups_at", pa.list_(pa.int32())), ("groups_a", lists), ("groups_b", lists)])
    return pa.Table.from_pylist([row], schema)


def _joint_parts(batches: Iterator[pa.RecordBatch], shift: int) -> Iterator[pa.RecordBatch]:
    """A part for each group that closes between chunks."""
    schema = _schema(_PART_DDL)
    for batch in batches:
        rows = []
        for row, at, a, b in zip(*(batch.column(c).to_pylist() for c in ("row", "at", "a", "b")), strict=True):
            links, times = np.unique((np.repeat(np.array(a, np.int64), len(b)) << shift) | np.tile(np.array(b, np.int64), len(a)), return_counts=True)
            text = f"{','.join(map(str, a))}|{','.join(map(str, b))}"
            rows.append({"row": row, "part": 2 * at, "n_a": len(a), "n_b": len(b), "n_groups": 1, "n_links": len(a) * len(b), "groups": text, "links": links, "times": times})
        yield pa.RecordBatch.from_pylist(rows, schema)


def _long_parts(texts: DataFrame, paths: tuple[str, str], shift: int, chunk: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """Parts of long texts in their order, and (row, doc_id) of all long texts."""
    spark = texts.sparkSession
    pieces = stored(texts.mapInArrow(lambda it: _cut(it, chunk), "row long, doc_id long, idx int, text string, lead long, size long"))
    dealt = pieces.repartition(shuffle_width(spark), "row", "idx")
    chunks = stored(dealt.mapInArrow(lambda it: _chunk_parts(it, paths), _CHUNK_DDL))
    ends = chunks.select([f.split()[0] for f in _ENDS_DDL.split(", ")])
    left = (chunks.agg(F.max("idx")).first()[0] or 0) + 1
    closed = []
    while True:  # as many rounds as the tree is deep
        group = F.floor(F.col("idx") / fan).alias("group")
        composed = stored(ends.groupBy("row", group).applyInArrow(lambda t: _compose_group(t, fan), _ROUND_DDL))
        closed.append(composed.select("row", F.inline(F.arrays_zip(F.col("groups_at").alias("at"), F.col("groups_a").alias("a"), F.col("groups_b").alias("b")))))
        ends = composed.drop("groups_at", "groups_a", "groups_b")
        left = -(-left // fan)
        if left <= 1:
            break
    # a text begins where both begin: what is still open at its front is its first group
    closed.append(ends.select("row", "at", F.col("prefix_a").alias("a"), F.col("prefix_b").alias("b")))
    joint = reduce(DataFrame.union, closed).mapInArrow(lambda it: _joint_parts(it, shift), _PART_DDL)
    parts = chunks.filter("n_groups > 0").select([f.split()[0] for f in _PART_DDL.split(", ")]).union(joint)
    return stored(parts.join(ends.filter("sound").select("row"), "row", "left_semi").select(parts.columns)), pieces.select("row", "doc_id").distinct()


def align(docs: DataFrame, a_path: str, b_path: str, chunk: int = CHUNK_BYTES, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """Alignments of short and of long texts: row, doc_id, part, n_a, n_b, n_groups, n_links, groups, links, times.

    A part is a run of groups, written ``a1,a2|b1;a3|b2,b3``; the parts of a row in order are its whole alignment.
    ``links`` are its distinct linked ids (A id, shifted by ``link_shift``, and B id), ``times`` how often each occurs.
    Short texts have one part each. Long ones, of more than ``chunk`` bytes, have one for each chunk with closed groups
    and one for each group between chunks; the second table begins with a part -1 without groups for each of them.

    The A bytes are those of a blank and the text, as the B tokens have them. Null and empty texts, and those whose
    tokens do not give these bytes back (a normal form, U+2581 in the text), have no tokens. Repeated rows and
    doc_ids are rows of their own; ``row`` tells them apart. Other columns are ignored; an empty table gives no rows.
    """
    import sentencepiece

    paths = (a_path, b_path)
    shift = link_shift(sentencepiece.SentencePieceProcessor(model_file=b_path).vocab_size())
    number = F.monotonically_increasing_id()
    texts = docs.select(number.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    is_long = F.coalesce(F.octet_length("text") > chunk, F.lit(False))
    short = texts.filter(~is_long).mapInArrow(lambda it: _short(it, paths), _PART_DDL)
    # rows of long texts are numbered below zero, apart from the others whatever the plan
    parts, rows = _long_parts(texts.filter(is_long).withColumn("row", -1 - F.col("row")), paths, shift, chunk, fan)
    zero = [F.lit(0).cast("long").alias(n) for n in _NUMBERS]
    none = [F.lit("").alias("groups"), F.array().cast("array<long>").alias("links"), F.array().cast("array<int>").alias("times")]
    return short, rows.select("row", "doc_id", F.lit(-1).alias("part"), *zero, *none).union(parts)


def _stream_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of each row's parts joined by semicolons, as they pass by in order."""
    row, held, begun, out = None, None, False, []
    for batch in batches:
        for own, text in zip(batch.column("row").to_pylist(), batch.column("groups").to_pylist(), strict=True):
            if own != row:
                out += [(row, held.hexdigest() if begun else "")] if held else []
                row, held, begun = own, hashlib.sha256(), False
            if text:
                held.update((";" * begun + text).encode())
                begun = True
    out += [(row, held.hexdigest() if begun else "")] if held else []
    rows, digests = zip(*out, strict=True) if out else ((), ())
    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(digests, pa.string())], names=["row", "groups_sha256"])


def summaries(short: DataFrame, long: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256) of all rows, and (row, links, times) of each."""
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256)).alias("groups_sha256")
    held = stored(short.select("row", "doc_id", *_NUMBERS, digest, "links", "times"))
    sums = long.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.sum(n).alias(n) for n in _NUMBERS])
    ordered = long.select("row", "part", "groups").repartition("row").sortWithinPartitions("row", "part")
    digests = ordered.mapInArrow(_stream_digests, "row long, groups_sha256 string")
    whole = held.drop("links", "times").union(sums.join(digests, "row").select(held.drop("links", "times").columns))
    # links of a long text's parts are added up one by one, so none of its tasks holds them all
    each = long.select("row", F.inline(F.arrays_zip("links", "times"))).groupBy("row", "links").agg(F.sum("times").alias("times"))
    single = each.select("row", F.array("links").alias("links"), F.array(F.col("times").cast("int")).alias("times"))
    return whole, held.select("row", "links", "times").union(stored(single))


def link_counts(links: DataFrame, shift: int) -> DataFrame:
    """link, n (rows that have it), best (n is the most of its A id, ties included)."""
    counts = links.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("n"))
    # an A id has at most as many links as there are B ids
    most = F.max("n").over(Window.partitionBy(F.shiftright("link", shift)))
    return stored(counts.withColumn("best", F.col("n") == most))


def with_counts(docs: DataFrame, a_path: str, b_path: str, chunk: int = CHUNK_BYTES, fan: int = FAN, broadcast_links: int = BROADCAST_LINKS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs``; see ``align``.

    ``n_best`` are the links whose count is the highest of their A id, ``count_sum`` is the sum of all links' counts.
    """
    import sentencepiece

    whole, links = summaries(*align(docs, a_path, b_path, chunk, fan))
    counts = link_counts(links, link_shift(sentencepiece.SentencePieceProcessor(model_file=b_path).vocab_size()))
    each = links.select("row", F.inline(F.arrays_zip(F.col("links").alias("link"), "times")))
    if counts.count() <= broadcast_links:
        looked = each.join(F.broadcast(counts), "link")
    else:  # common links are dealt over salts
        salted = counts.select("*", F.explode(F.array([F.lit(k) for k in range(_SALTS)])).alias("salt"))
        looked = each.withColumn("salt", F.pmod(F.col("row"), F.lit(_SALTS)).cast("int")).join(salted, ["link", "salt"])
    found = looked.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    )
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return whole.join(found, "row", "left").select("doc_id", *_NUMBERS, *zero, "groups_sha256")
