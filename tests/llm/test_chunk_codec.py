import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from cohortry.llm import chunk_codec
from tests.llm.conftest import ODD

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    tokenizer, out = Tokenizer.from_file(WORD_BPE), []
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        out.append((doc_id, len(ids), digest(" ".join(map(str, ids))), digest(tokenizer.decode(ids, skip_special_tokens=False))))
    return sorted(out, key=str)


def test_all_documents(documents):
    got = chunk_codec.round_trip(documents, WORD_BPE).collect()
    assert sorted(map(tuple, got), key=str) == brute([(r.doc_id, r.text) for r in documents.collect()])


def test_odd_texts_and_repeated_rows(table):
    rows = [*ODD, (4, "one"), (None, "one <|endoftext|>two")]
    assert sorted(map(tuple, chunk_codec.round_trip(table(rows), WORD_BPE).collect()), key=str) == brute(rows)


def test_encode_then_decode(table):
    encoded = chunk_codec.encode(table(ODD), WORD_BPE)
    tokenizer = Tokenizer.from_file(WORD_BPE)
    want = {d: tokenizer.encode(t or "", add_special_tokens=False).ids for d, t in ODD}
    assert {r.doc_id: r.ids for r in encoded.collect()} == want
    decoded = {r.doc_id: r.text for r in chunk_codec.decode(encoded, WORD_BPE).collect()}
    assert decoded == {d: tokenizer.decode(ids, skip_special_tokens=False) for d, ids in want.items()}


def test_empty_table(table):
    assert chunk_codec.round_trip(table([]), WORD_BPE).collect() == []


def test_shared_passages_are_cut_alike():
    passage = ("a passage that occurs in two texts and is long enough to hold some cuts of its own " * 4).encode()
    chunks = []
    for before in (b"one text ", b"quite another beginning, "):
        raw = before + passage
        places = chunk_codec.cut_places(np.frombuffer(raw, np.uint8)).tolist()
        chunks.append({raw[a:b] for a, b in zip([0, *places], [*places, len(raw)], strict=True)})
    assert len(chunks[0] & chunks[1]) >= max(map(len, chunks)) - 2


def test_no_bound_on_chunks_in_use():
    codec = chunk_codec.ChunkCodec(WORD_BPE, limit=3)
    tokenizer = Tokenizer.from_file(WORD_BPE)
    texts = [f"text {i} with words of its own" for i in range(20)]
    got = codec.encode([[t[:7].encode(), t[7:].encode()] for t in texts])
    assert [x.tolist() for x in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
