import random
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohortry.llm import token_counts
from tests.llm.conftest import ODD

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(WORD_BPE)


def tokens(text):
    return len(TOKENIZER.encode(text, add_special_tokens=False).ids)


def totals(docs):
    rows = token_counts.prefix_counts(docs, WORD_BPE).collect()
    return sorted(((r.doc_id, r.n_bytes, r.counts[-1]) for r in rows), key=str)


def brute(rows):
    return sorted(((d, len((t or "").encode()), tokens(t or "")) for d, t in rows), key=str)


def test_all_documents(documents):
    assert totals(documents) == brute([(r.doc_id, r.text) for r in documents.collect()])


def test_odd_texts_and_repeated_rows(table):
    rows = [*ODD, (4, "one"), (None, "x")]
    assert totals(table(rows)) == brute(rows)
    assert totals(table([])) == []


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(WORD_BPE, limit=50)


def test_every_prefix(counter):
    for _, text in ODD[3:10] + ODD[13:]:
        ends, counts = counter.table(text)
        assert [counter.at(text, ends, counts, p) for p in range(len(text) + 1)] == [tokens(text[:p]) for p in range(len(text) + 1)]


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet="abcdefghinorstu éß'.,!0123 \n", max_size=60))
def test_any_text(counter, text):
    ends, counts = counter.table(text)
    assert counts[-1] == tokens(text)
    for budget in (0, 3, 10):
        place = counter.longest_prefix(text, ends, counts, budget)
        assert tokens(text[:place]) <= budget


def test_longest_prefix_goes_on_inside_a_word(counter):
    texts = ["日本語のテスト文章です" * 4, "aGVsbG8gd29ybGQ+/Zm9v1Q==" * 3, "e\u0301e\u0301cole" * 4, "don't they're''ll", "a<|endoftext|>bcd<|endoftext", "two  wordstogether\n\nx"]
    for text in texts + [t for _, t in ODD[7:10] + ODD[13:]]:
        ends, counts = counter.table(text)
        every = [tokens(text[:p]) for p in range(len(text) + 1)]
        for budget in range(0, every[-1] + 2):
            want = max(p for p, n in enumerate(every) if n <= budget)
            assert counter.longest_prefix(text, ends, counts, budget) == want, (text, budget)


def merged(rank, symbols):
    """The merges as they are defined: lowest rank first, leftmost first."""
    while len(symbols) > 1:
        ranks = [rank.get(pair, 1 << 30) for pair in zip(symbols, symbols[1:])]  # noqa: B905
        at = ranks.index(min(ranks))
        if ranks[at] == 1 << 30:
            break
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
    return symbols


def test_neighbouring_tokens_are_judged_as_the_merges_do(counter):
    rng = random.Random(7)
    inner, final = ([t for t, own in tokens.items() if own] for tokens in (counter.inner, counter.final))
    pairs = [(rng.choice(inner), rng.choice(inner), False) for _ in range(3000)] + [(rng.choice(inner), rng.choice(final), True) for _ in range(3000)]
    pairs += [("a" * i, "a" * j, end) for i in range(5) for j in range(1, 5) for end in (True, False) if not i or counter.inner.get("a" * i)]
    # halves of tokens, which the merges do join
    pairs += [(t[:k], t[k:], False) for t in rng.sample(inner, 2000) for k in range(1, len(t)) if counter.inner.get(t[:k])]
    joined = 0
    for left, right, ends in pairs:
        token = right + "</w>" * ends
        if not (counter.final if ends else counter.inner).get(right):
            continue
        symbols = [*left, *right]
        symbols[-1] += "</w>" * ends
        if left and merged(counter.rank, [*left]) != [left]:
            continue
        want = merged(counter.rank, symbols) == ([left, token] if left else [token])
        assert counter._stands(left, right, ends) == want, (left, right, ends)
        joined += not want
    assert joined > 500
