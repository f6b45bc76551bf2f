import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortry.llm import packing
from cohortry.llm.encoding import WordEncoder
from tests.llm.conftest import ODD

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def check_layout(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins)


def brute(rows, capacity=2048):
    tokenizer, out = Tokenizer.from_file(BYTE_BPE), []
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for piece, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            out.append((doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return sorted(out)


def digest(pieces):
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def test_all_documents_are_packed(documents):
    packed = packing.pack(digest(packing.cut_pieces(documents, BYTE_BPE, 0))).collect()
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == brute(rows)
    least = -(-sum(r.length for r in packed) // 2048)
    assert check_layout(packed, 2048) <= 1.02 * least + 1


def test_odd_texts_ties_and_repeated_rows(table):
    rows = [*ODD, (4, "one"), (None, "one")]
    packed = packing.pack(digest(packing.cut_pieces(table(rows), BYTE_BPE, 0))).collect()
    key = lambda r: (r[0] is None, *map(str, r))
    want = brute([(d if d is not None else -1, t) for d, t in rows])
    got = [(r.doc_id if r.doc_id is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for r in packed]
    assert sorted(got, key=key) == sorted(want, key=key)
    check_layout(packed, 2048)


def test_new_pieces_of_many_texts_are_one_library_call():
    """Ids are the library's, of plain and other texts side by side; there was a call for each plain text before."""
    generator = np.random.default_rng(7)
    signs = [*"abcxyzABC'stremvld0189 \n  ,.!-_(){}|<>é", "'s", "'ll ", " '", "\u024f", "ß", "\xa0", "\t", "日", "\u2019", "<|endoftext|>"]
    texts = ["".join(generator.choice(signs, int(n))) for n in generator.integers(0, 60, 3000)]
    texts += [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(60)] + [t or "" for _, t in ODD]
    encode, tokenizer = WordEncoder(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encode.encode_all(texts) == [encode.encode(t) for t in texts] == want
    assert encode.encode_all([]) == []

    class Counted:
        calls, held = 0, encode.model_alone

        def encode_batch_fast(self, *given, **named):
            self.calls += 1
            return self.held.encode_batch_fast(*given, **named)

    encode.model_alone = Counted()
    encode.encode_all([" ".join(f"v{i}y{'ab' * i}{j}q" + chr(97 + j) * 3 for j in range(20)) for i in range(1, 30)])
    assert encode.model_alone.calls == 1


def test_sequences_hold_their_pieces_in_order(table):
    packed = packing.pack(packing.cut_pieces(table(ODD[:10]), BYTE_BPE, 0, capacity=16), capacity=16).cache()
    laid = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert laid[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)


def test_empty_table(table):
    assert packing.pack(digest(packing.cut_pieces(table([]), BYTE_BPE, 0))).collect() == []


def test_two_documents_take_the_place_of_one():
    # greedy takes 60 and 30; the last gives way to 21 + 19, which fill the bin
    assert packing.plan_bins({60: 1, 30: 1, 21: 1, 19: 1}, 100)[0] == ([60, 21, 19], 1)


def test_plans_use_every_length_once():
    counts = {int(n): int(c) for n, c in zip(*np.unique(np.random.default_rng(3).integers(1, 2049, 20_000), return_counts=True), strict=True)}
    plan, used = packing.plan_bins(counts, 2048), defaultdict(int)
    for held, copies in plan:
        assert sum(held) <= 2048
        for length in held:
            used[length] += copies
    assert used == counts
    assert sum(c for _, c in plan) <= 1.01 * sum(n * c for n, c in counts.items()) / 2048
