"""BPE encoding by content-defined chunks, and decoding.

A rolling hash of the last bytes cuts texts into chunks wherever it hits a pattern, so a passage that many
documents share is cut alike in all of them. Each distinct chunk is encoded once (per Python worker, for as
long as it is kept). A cut may fall inside a word, where the parts' tokens are not the whole's: so every
chunk is held as its first word, the words inside and its last word, and at each join the two fragments
are encoded anew together, taking in further chunks for as long as no word ends there. What is left on
both sides of a repaired join begins and ends at white space, which no token crosses, so the result is
exact, not merely likely.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.encoding import WordEncoder
from cohortry.llm.words import mix, slices, text_offsets
from cohortry.llm.worker_memory import kept

# the rolling hash covers 16 bytes; one place in 64 is a cut
_MASK = np.uint32((1 << 6) - 1)
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def cut_places(data: np.ndarray) -> np.ndarray:
    """Places in UTF-8 bytes at which chunks begin, judged on the 16 bytes before each."""
    if len(data) == 0:
        return np.zeros(0, np.int64)
    rolling = _GEAR[data]
    for step in (1, 2, 4, 8):
        earlier = np.zeros_like(rolling)
        earlier[step:] = rolling[:-step] << np.uint32(step)
        rolling = rolling + earlier
    places = np.flatnonzero((rolling >> np.uint32(10)) & _MASK == 0) + 1
    places = places[places < len(data)]
    # never inside a character: on to where the next one begins
    inside = (data[places] & 0xC0) == 0x80
    while inside.any():
        places = places + inside
        inside = (places < len(data)) & ((data[np.minimum(places, len(data) - 1)] & 0xC0) == 0x80)
    return np.unique(places[places < len(data)])


class Chunk(NamedTuple):
    head: str  # up to the first blank or line break; the whole chunk when it has none
    inside: bytes | None  # ids of the words between, None when the chunk has no word's end
    tail: str  # behind the last blank or line break


class ChunkCodec:
    """For a word BPE file of the ``tokenizers`` library; ``limit`` bounds the chunks that are kept."""

    def __init__(self, path: str, limit: int = 100_000) -> None:
        self.words = WordEncoder(path)
        if not self.words.word_kind:
            raise ValueError("a word BPE is needed")
        if self.words.tokenizer.decoder is not None:
            raise ValueError("a decoder that joins tokens by blanks is needed")
        size = self.words.tokenizer.get_vocab_size()
        self.decimal = np.array([str(k) for k in range(size)], object)
        # the library leaves out ids it has no token for
        self.token = np.array([self.words.tokenizer.id_to_token(k) for k in range(size)], object)
        self.limit = limit
        self.chunks: dict[bytes, Chunk] = {}

    def learn(self, new: list[bytes]) -> None:
        """Encode the words inside these chunks, each chunk once."""
        if len(self.chunks) + len(new) > self.limit:
            self.chunks.clear()
        parts = [self.words.split(raw.decode()) for raw in new]
        ids = self.words.words([word for words in parts for word in words[1:-1]])
        at = 0
        for raw, words in zip(new, parts, strict=True):
            n = max(len(words) - 2, 0)
            self.chunks[raw] = Chunk(words[0], b"".join(ids[at : at + n]) if len(words) > 1 else None, words[-1])
            at += n

    def encode(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Ids of texts that are given as their chunks; fragments that meet at a join are one word."""
        needed = {raw for text in texts for raw in text}
        new = [raw for raw in needed if raw not in self.chunks]
        self.learn(new if len(self.chunks) + len(new) <= self.limit else list(needed))
        fragments, inner, sizes = [], [], []
        for text in texts:
            open_word, before = "", len(fragments)
            for raw in text:
                chunk = self.chunks[raw]
                open_word += chunk.head
                if chunk.inside is not None:
                    fragments.append(open_word)
                    inner.append(chunk.inside)
                    open_word = chunk.tail
            fragments.append(open_word)
            inner.append(b"")
            sizes.append(len(fragments) - before)
        repaired = iter(zip(self.words.words(fragments), inner, strict=True))
        return [np.frombuffer(b"".join([x for _ in range(n) for x in next(repaired)]), "<u4") for n in sizes]

    def decode(self, ids: np.ndarray) -> str:
        """As the library without a decoder: tokens joined by blanks, ids without a token left out."""
        return " ".join([t for t in self.token[ids[ids < len(self.token)]].tolist() if t is not None])


def codec(path: str) -> ChunkCodec:
    """One codec per Python worker and file; its chunks serve all later documents and tasks."""
    return kept(("codec", path), lambda: ChunkCodec(path))


def _encoded(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[tuple[pa.Array, list[np.ndarray], ChunkCodec]]:
    codes = codec(tokenizer)
    for batch in slices(batches, limit=1 << 20):
        data, offsets = text_offsets(batch.column("text"))
        whole = data.tobytes()
        texts = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            bounds = [a, *(a + cut_places(data[a:b])).tolist(), b]
            texts.append([whole[c:d] for c, d in zip(bounds[:-1], bounds[1:], strict=True)])
        ids = codes.encode(texts)
        yield batch.column("doc_id"), ids, codes


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids: the token ids of every whole text, one row per row of ``docs``.

    A null text is empty and has no ids. Repeated rows and doc_ids each give a row; other columns are
    ignored. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, ids, _ in _encoded(batches, tokenizer):
            bounds = pa.array(np.append(0, np.cumsum([len(x) for x in ids])), pa.int32())
            flat = pa.array(np.concatenate(ids).astype(np.int32))
            yield pa.RecordBatch.from_arrays([doc_id, pa.ListArray.from_arrays(bounds, flat)], names=["doc_id", "ids"])

    return _keyed(docs, "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, text: ids back to what the library's decode gives, special tokens included. Null ids: empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = codec(tokenizer)
        for batch in batches:
            texts = [codes.decode(np.array(ids or [], np.int64)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return _keyed(encoded, "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ``encode`` and ``decode`` in one pass over the texts.

    The digests are of the decimal ids joined by one blank and of the decoded text; rows as in ``encode``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, ids, codes in _encoded(batches, tokenizer):
            digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [
                    doc_id, pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([digest(" ".join(codes.decimal[x].tolist())) for x in ids], pa.string()),
                    pa.array([digest(codes.decode(x)) for x in ids], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _keyed(docs, "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _keyed(table: DataFrame, column: str) -> DataFrame:
    return table.select(F.col("doc_id").cast("long").alias("doc_id"), column)
