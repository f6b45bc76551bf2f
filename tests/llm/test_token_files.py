import glob
import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortry.llm import token_files, worker_memory
from cohortry.llm.encoding import WordEncoder
from tests.llm.conftest import ODD

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_encode_as_whole_texts(documents, name):
    tokenizer, encoder = Tokenizer.from_file(public_tokenizers.path(name)), WordEncoder(public_tokenizers.path(name), limit=500)
    texts = [t or "" for _, t in ODD] + [r.text for r in documents.select("text").collect()]
    for text in texts:
        assert encoder.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def expected(rows):
    tokenizer, start, out = Tokenizer.from_file(WORD_BPE), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def read(docs):
    files = token_files.write_token_files(docs, WORD_BPE, 2, shards=4)
    rows = token_files.read_all(files, token_files.keys_of(docs)).collect()
    return files, sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows if r.doc_id is not None), rows


def test_all_documents_read_back(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert read(documents)[1] == sorted(expected(rows))


def test_odd_texts_repeated_and_null_keys(table):
    rows = [*ODD, (4, "again"), (4, "and again"), (None, "no key"), (None, "no key either")]
    _, got, all_rows = read(table(rows))
    want = expected(rows)
    assert got == sorted(w for w in want if w[0] is not None)
    assert sorted(r.start for r in all_rows if r.doc_id is None) == [w[1] for w in want if w[0] is None]


def test_keyed_access_and_foreign_keys(spark, documents):
    files, _, _ = read(documents)
    keys = spark.createDataFrame([(7, 0), (199, 0), (7, 1), (10**12, 0)], "doc_id long, turn int")
    got = {r.doc_id: r.ids for r in token_files.fetch(files, keys).collect()}
    texts = {r.doc_id: r.text for r in documents.filter(F.col("doc_id").isin(7, 199)).collect()}
    tokenizer = Tokenizer.from_file(WORD_BPE)
    assert got == {k: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for k, t in texts.items()}


def spoil(folder, keep):
    """Files of other folders than ``keep`` become unreadable."""
    spoilt = 0
    for file in glob.glob(f"{folder}/*/*.parquet"):
        if os.path.basename(os.path.dirname(file)) != keep:
            with open(file, "wb") as out:
                out.write(b"spoilt")
            os.remove(os.path.join(os.path.dirname(file), f".{os.path.basename(file)}.crc"))
            spoilt += 1
    return spoilt


def test_one_key_opens_one_section_one_shard_and_its_row_groups(spark, documents, monkeypatch):
    monkeypatch.setattr(token_files, "BUCKET_KEYS", 4)
    monkeypatch.setattr(token_files, "BLOCK_BYTES", 4000)
    files = token_files.write_token_files(documents, WORD_BPE, 2, shards=4)
    key = spark.createDataFrame([(77, 0)], "doc_id long, turn int")
    place = token_files.locate(files, key).withColumn("bucket", token_files._bucket(files.buckets)).first()
    assert token_files._sections(files.buckets) > 1
    section, shard = place.bucket % token_files._sections(files.buckets), place.shard
    (part,) = glob.glob(f"{files.payload}/shard={shard}/*.parquet")
    groups = pq.ParquetFile(part).metadata
    assert groups.num_row_groups > 1 and groups.row_group(0).num_rows <= token_files.GROUP_BLOCKS
    assert spoil(files.index, f"section={section}") and spoil(files.payload, f"shard={shard}")
    fetched = token_files.fetch(files, key)
    text = documents.filter("doc_id = 77").first().text
    assert [r.ids for r in fetched.collect()] == [[*Tokenizer.from_file(WORD_BPE).encode(text, add_special_tokens=False).ids, 2]]
    assert f"In(block, [{place.block}])" in (plan := fetched._jdf.queryExecution().toString()) or f"EqualTo(block,{place.block})" in plan
    with pytest.raises(Exception):
        token_files.read_all(files, key).collect()


def test_many_keys_are_read_by_one_scan(documents, monkeypatch):
    monkeypatch.setattr(token_files, "FEW", 0)
    files, _, _ = read(documents)
    assert token_files.fetch(files, token_files.keys_of(documents)).count() == documents.count()


def test_empty_table(table):
    assert read(table([]))[1] == []


def test_perfect_hash_is_minimal():
    keys = np.arange(3001, dtype=np.uint64) * np.uint64(7)
    pilots, slots = token_files.perfect_hash(keys, np.zeros_like(keys))
    assert sorted(slots.tolist()) == list(range(3001))
    assert (token_files.find_slots(pilots, 3001, keys, np.zeros_like(keys)) == slots).all()


def test_words_of_every_text_outlive_words_seen_once():
    """A full cache once forgot all words; those of every text were encoded again and again."""
    encoder = WordEncoder(public_tokenizers.path("byte_bpe_50k.json"), limit=80)
    asked, model = [], encoder.model

    class Counted:
        def tokenize(self, letters):
            asked.append(letters)
            return model.tokenize(letters)

    encoder.model = Counted()
    for i in range(60):
        letters = "".join(chr(97 + int(d)) for d in str(1000 + i))
        text = "first common " + " ".join(letters + chr(97 + k) for k in range(10))
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.ids(text).tolist() == want
        assert len(encoder.known) + len(encoder.older) <= 80
    assert asked.count("\u0120common") == 1


def test_words_forgotten_between_batches_keep_their_pieces():
    encoder = WordEncoder(public_tokenizers.path("byte_bpe_50k.json"), limit=80, pieces=80)
    first = encoder.encode("one two three")
    encoder.forget()
    encoder.model = None
    assert encoder.encode("one two three") == first


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_that_differ_in_signs_share_their_letters(name):
    """Each of these was a word of its own, encoded again."""
    encoder = WordEncoder(public_tokenizers.path(name))
    asked, tokenized = [], encoder._tokenized
    encoder._tokenized = lambda pieces: asked.extend(pieces) or tokenized(pieces)
    text = "a thonel b thonel, c thonel!! d thonel.\n\n Édenñ's  we'll  12² x½y ''s \n" + " ".join(f"w{i}q" for i in range(99))
    want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder.ids(text).tolist() == want
    assert encoder.ids(text).tolist() == want
    assert [p.strip() for p in asked].count("thonel") == 1 and len(asked) == len(set(asked))


def test_freed_memory_goes_back_to_the_system():
    """A worker kept what its encoder had held, on top of what the next stage took."""
    resident = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096  # noqa: E731, SIM115
    worker_memory.let_go()
    held = [bytes(2000) for _ in range(60_000)]
    pinned = held[::500]
    full = resident()
    del held
    worker_memory.let_go()
    assert full - resident() > 60_000_000 and pinned
