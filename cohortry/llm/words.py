"""Words of Arrow text columns as numpy arrays: where they lie and 64-bit hashes of their bytes.

A word is a longest run of bytes outside ``[\\x20\\x09-\\x0D]``; null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into row ranges of about ``limit`` bytes of text; a longer text comes alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = text_offsets(batch.column(column))[1]
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(ends, ends[begin] + limit, "right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end


def carried(carry: Sequence[str]) -> list[Column]:
    """The text, and the columns to carry as ``row``; a text that is carried is sent inside ``row`` alone."""
    rows = [F.struct(*carry).alias("row")] if carry else []
    return rows if "text" in carry else [F.col("text"), *rows]


def with_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with their ``text`` as a column, be it a field of ``row``."""
    for batch in batches:
        yield batch if "text" in batch.schema.names else batch.append_column("text", batch.column("row").field("text"))


def text_offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another, and where each begins (one more than texts)."""
    column = column.fill_null("").cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Words(NamedTuple):
    data: np.ndarray  # bytes of all texts
    begin: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after each word
    first: np.ndarray  # per text, index of its first word; one more than texts

    def per_text(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """For each word, the row of its text."""
        return np.repeat(np.arange(len(self.first) - 1), self.per_text())


def split_words(column: pa.Array) -> Words:
    data, offsets = text_offsets(column)
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(offsets), np.int64))
    inside = ~_SPACE[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    starts = offsets[:-1]
    before[starts[starts < len(data)]] = False
    begin = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    stops = offsets[1:]
    after[stops[stops > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, begin, end, np.searchsorted(begin, offsets))


def hash_words(words: Words, seed: int = 0) -> np.ndarray:
    """64-bit hashes, eight bytes of each word at a time; equal words hash alike everywhere."""
    size = words.end - words.begin
    padded = np.zeros(len(words.data) + 8, np.uint8)
    padded[: len(words.data)] = words.data
    eight = np.ndarray((len(words.data) + 1,), "<u8", padded, strides=(1,))
    hashed = mix(size.astype(np.uint64) * _ODD + np.uint64(seed))
    rows, step = np.arange(len(size)), 0
    while len(rows):
        left = size[rows] - step
        keep = np.where(left >= 8, 0, 8 * (8 - left)).astype(np.uint64)
        value = eight[words.begin[rows] + step] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> keep)
        hashed[rows] = mix((hashed[rows] ^ value) * _ODD)
        rows, step = rows[left > 8], step + 8
    return hashed


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse."""
    known = _POWERS.get(base)
    if known is None or len(known[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        up = np.full(size, base, np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        known = _POWERS[base] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return known[0][:n], known[1][:n]


def hash_windows(hashed: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hash of each ``width`` consecutive entries, whoever owns them: sum of hash times power of place."""
    n = len(hashed) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(base, len(hashed))
    total = np.zeros(len(hashed) + 1, np.uint64)
    np.cumsum(hashed * up, out=total[1:])
    return mix((total[width:] - total[:n]) * down[:n])


def window_starts(first: np.ndarray, width: int) -> np.ndarray:
    """Indexes of words at which a window of ``width`` words lies within one text."""
    place = np.arange(max(int(first[-1]) - width + 1, 0))
    owner = np.searchsorted(first, place, "right") - 1
    return place[place + width <= first[owner + 1]]


def hash_sequences(words: Words, seed: int) -> np.ndarray:
    """64 bits for each text's words in order."""
    own = hash_words(words, seed)
    place = np.arange(len(own)) - np.repeat(words.first[:-1], words.per_text())
    total = np.append(np.uint64(0), np.cumsum(mix(own ^ mix(place.astype(np.uint64)))))
    return total[words.first[1:]] - total[words.first[:-1]]
