import hashlib

import numpy as np
import pytest

from cohortry.llm import substring_dedup
from tests.llm.conftest import ODD


def survivors(rows, window):
    """(doc_id, words, indexes of words that stay) of each row."""
    split = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, words in split:
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if d is not None:
                first[w] = min(d, first.get(w, d))
    for d, words in split:
        gone = set()
        for i in range(len(words) - window + 1):
            if d is not None and first[tuple(words[i : i + window])] < d:
                gone.update(range(i, i + window))
        yield d, words, [i for i in range(len(words)) if i not in gone]


def brute(rows, window):
    out = []
    for d, words, stay in survivors(rows, window):
        kept = b" ".join(words[i] for i in stay)
        out.append((d, len(words), len(words) - len(stay), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def kept_text(rows, doc_id, window):
    return next(b" ".join(words[i] for i in stay).decode() for d, words, stay in survivors(rows, window) if d == doc_id)


def got(docs, **options):
    rows = substring_dedup.remove_repeats(docs, **options).collect()
    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in rows), key=str)


def test_all_documents(documents):
    want = brute([(r.doc_id, r.text) for r in documents.collect()], 50)
    assert got(documents) == want
    assert sum(w[2] for w in want) > 0


def test_odd_texts_ties_and_repeated_rows(table):
    rows = [*ODD, (12, "other text of the same document"), (4, "one"), (None, ODD[10][1])]
    assert got(table(rows)) == brute(rows, 50)
    assert got(table([])) == []


@pytest.mark.parametrize("seed", range(4))
def test_passages_at_their_edges(table, seed):
    generator = np.random.default_rng(seed)
    passages = [[f"p{k}.{i}" for i in range(n)] for k, n in enumerate((7, 8, 9, 13, 30))]
    rows = []
    for doc_id in range(30):
        words = []
        for _ in range(4):
            words += [f"w{generator.integers(6)}" for _ in range(generator.integers(0, 6))]
            words += passages[generator.integers(len(passages))]
        rows.append((int(generator.permutation(100)[0]), " ".join(words)))
    rows = list(dict(rows).items())
    assert got(table(rows), window=8, anchor=3) == brute(rows, 8)


def test_columns_are_carried(table):
    docs = table([(2, "a b c"), (1, None)])
    carried = substring_dedup.remove_repeats(docs, carry=docs.columns).select("row.*", "n_removed").collect()
    assert sorted((r.doc_id, r.text, r.word, r.n_removed) for r in carried) == [(1, None, "y", 0), (2, "a b c", "y", 0)]
