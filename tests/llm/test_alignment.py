import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cohortry.llm import alignment
from cohortry.llm.alignment import Fragment, compose
from cohortry.llm.encoding import byte_letters
from tests.llm.conftest import ODD

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LETTERS = {letter: byte for byte, letter in enumerate(byte_letters())}


def whole_alignments(texts):
    """Groups of whole texts, encoded by the libraries in one go."""
    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    out = []
    for text in texts:
        groups = []
        if text:
            a = first.encode(f" {text}", add_special_tokens=False).ids
            b = second.encode(text)
            a_bytes = [bytes(LETTERS[c] for c in first.id_to_token(k)) for k in a]
            pieces = [second.id_to_piece(k) for k in b]
            b_bytes = [bytes([int(p[3:-1], 16)]) if second.is_byte(k) else p.replace("▁", " ").encode() for k, p in zip(b, pieces, strict=True)]
            if b"".join(a_bytes) == b"".join(b_bytes) == f" {text}".encode():
                i = j = x = y = 0
                group = ([], [])
                while i < len(a) or j < len(b):
                    if x <= y and i < len(a):
                        group[0].append(a[i])
                        x, i = x + len(a_bytes[i]), i + 1
                    else:
                        group[1].append(b[j])
                        y, j = y + len(b_bytes[j]), j + 1
                    if x == y:
                        groups.append(group)
                        group = ([], [])
        out.append(groups)
    return out


def expected(rows):
    aligned = whole_alignments([t for _, t in rows])
    links = [Counter((a, b) for x, y in groups for a in x for b in y) for groups in aligned]
    counts = Counter(pair for each in links for pair in each)
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(n, most.get(a, 0))
    out = []
    for (doc_id, _), groups, own in zip(rows, aligned, links, strict=True):
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(own.values()),
                    sum(t for p, t in own.items() if counts[p] == most[p[0]]), sum(t * counts[p] for p, t in own.items()),
                    hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=str)


def got(docs, **options):
    return sorted((tuple(r) for r in alignment.with_counts(docs, A, B, **options).collect()), key=str)


MORE = [
    (21, "a  b \n c"), (22, " "), (23, "   "), (24, "x ▁ y"), (25, "a\r b;\r\n c"), (26, "word  　 x  y"), (27, "\x1c \x1d a"), (28, "a\x00b "),
    (29, "<s> </s><unk> <|endoftext|> <0x0A>"), (30, "é " * 50 + "日本" * 40), (31, "\U0001f468‍\U0001f469 " * 9), (32, "q" * 700 + " " + "é" * 600), (5, "again"), (None, "no key"), (None, None),
]


@pytest.mark.parametrize("options", [{}, {"chunk": 40, "fan": 2}, {"chunk": 7, "fan": 3, "broadcast_links": 0}])
def test_odd_texts(table, options):
    rows = [(d, t if t is None else t[:4000]) for d, t in ODD + MORE]
    assert got(table(rows), **options) == expected(rows)


def test_all_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    want = expected(rows)
    assert got(documents) == want
    assert got(documents, chunk=1000, fan=4) == want


def test_long_document(table):
    rows = [ODD[10], (12, ODD[10][1]), (13, "x" * 300_000), (14, "ab cd" * 40_000 + "▁")]
    assert got(table(rows)) == expected(rows)


def test_composition_is_associative_and_whole():
    """Fragments of random token ends, composed in random order, give the groups of the whole."""
    rng = random.Random(5)
    for _ in range(200):
        size = rng.randint(1, 40)
        ends = [sorted({size, *rng.sample(range(1, size + 1), rng.randint(0, size))}) for _ in "ab"]
        cuts = sorted({0, size, *rng.sample(range(size + 1), rng.randint(0, min(size, 6)))})
        parts, want = [], []
        for idx, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            a, b = ([t for t in each if s < t <= e] for each in ends)
            meet = sorted(set(a) & set(b))
            own = []
            if meet:
                own = [([t for t in a if x < t <= y], [t for t in b if x < t <= y]) for x, y in zip(meet[:-1], meet[1:], strict=True)]
                fragment = Fragment(True, idx, *([t for t in x if t <= meet[0]] for x in (a, b)), *([t for t in x if t > meet[-1]] for x in (a, b)))
            else:
                fragment = Fragment(False, idx, a, b, [], [])
            parts.append((fragment, [(2 * idx + 1, own)]))
        while len(parts) > 1:
            k = rng.randrange(len(parts) - 1)
            (left, x), (right, y) = parts[k : k + 2]
            joined, group = compose(left, right)
            parts[k : k + 2] = [(joined, x + y + ([(2 * group[0], [(group[1], group[2])])] if group else []))]
        fragment, found = parts[0]
        found.append((2 * fragment.at, [(fragment.prefix_a, fragment.prefix_b)]))
        meet = [0, *sorted(set(ends[0]) & set(ends[1]))]
        want = [([t for t in ends[0] if x < t <= y], [t for t in ends[1] if x < t <= y]) for x, y in zip(meet[:-1], meet[1:], strict=True)]
        assert [g for _, own in sorted(found, key=lambda p: p[0]) for g in own] == want
        assert fragment.suffix_a == fragment.suffix_b == []


def test_empty_table(table):
    assert got(table([])) == []
    assert got(table([(1, None)])) == [(1, 0, 0, 0, 0, 0, 0, "")]
