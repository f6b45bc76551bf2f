from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cohortry.llm import minhash
from cohortry.llm.components import components
from cohortry.llm.words import split_words
from tests.llm.conftest import ODD


def shingle_bag(text):
    words = (text or "").encode().split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def similarity(a, b):
    return (a & b).total() / (a | b).total()


def brute(rows, counted=False):
    bags = {}
    for d, t in rows:
        if d is not None:
            bag = shingle_bag(t)
            bags[d] = bags.get(d, Counter()) | (bag if counted else Counter(set(bag)))
    label = {d: d for d in bags}
    ids = sorted(bags)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if bags[a] and bags[b] and similarity(bags[a], bags[b]) >= 0.8 and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {d: low if c == high else c for d, c in label.items()}
    return sorted(((d, label.get(d), d is None or label[d] == d) for d, _ in rows), key=str)


def got(docs, **options):
    return sorted(map(tuple, minhash.near_duplicates(docs, **options).collect()), key=str)


def test_all_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    want = brute(rows)
    assert got(documents) == want
    assert sum(not kept for _, _, kept in want) > 5


def test_odd_texts_and_repeated_rows(table):
    rows = [*ODD, (12, LONG_AND_OTHER), (4, "one"), (None, "one"), (None, None)]
    assert got(table(rows)) == brute(rows)
    assert got(table([])) == []


LONG_AND_OTHER = "another text of the document that is there twice"


@pytest.mark.parametrize("small", [4, minhash.SMALL])
@pytest.mark.parametrize("weights", ["set", "count"])
def test_a_crowded_group_in_large_buckets(table, weights, small):
    generator = np.random.default_rng(5)
    base, rows = [f"w{i}" for i in range(120)], []
    for doc_id in range(150):
        words = base.copy()
        for place in generator.choice(120, generator.integers(0, 4), replace=False):
            words[place] = f"x{generator.integers(10**6)}"
        if doc_id % 3 == 0:
            words += words[:20]
        rows.append((doc_id, " ".join(words)))
    rows += [(200 + i, " ".join(f"v{i}.{j}" for j in range(60))) for i in range(5)]
    assert got(table(rows), weights=weights, small=small) == brute(rows, weights == "count")


def template_family(n, planted, seed=9, length=240):
    """``n`` unlike texts on one template (about 0.7 alike), then ``planted`` pairs of one and its near copy (0.85)."""
    generator = np.random.default_rng(seed)
    fresh = iter(range(10**9))

    def change(words, places):
        words = list(words)
        for place in places:
            words[place] = f"x{next(fresh)}"
        return words

    base = [f"w{i}" for i in range(length)]
    singles = [change(base, generator.choice(48, generator.integers(3, 7), replace=False) * 5) for _ in range(n)]
    texts = singles + [change(singles[generator.integers(n)], [119 + 5 * k for k in range(4)]) for _ in range(planted)]
    return [(i, " ".join(words)) for i, words in enumerate(texts)]


def test_near_pairs_in_a_template_family(table):
    rows = template_family(240, 60)
    want = brute(rows)
    assert sum(not kept for _, _, kept in want) >= 60 and sum(kept for _, _, kept in want) > 100
    assert got(table(rows), small=2) == want


def test_pairs_between_classes_are_all_that_may_be_alike(spark):
    generator = np.random.default_rng(3)
    common, rows = generator.integers(0, 40, 25), []
    for node in range(120):
        own = {int(v) for v in common[generator.random(25) < 0.9]} | {int(v) for v in generator.integers(0, 60, generator.integers(0, 6))}
        rows.append((node, node % 90, sorted(own)))
    sets = spark.createDataFrame(rows, "node long, class long, shingles array<long>")
    pairs = minhash._pairs_between(minhash._prefixes(sets, 0.8), 0.8, block=7)
    found = {(r["a"], r["b"]) for r in minhash._verified(pairs, sets.select("node", "shingles"), 0.8).collect()}
    held = {node: set(own) for node, _, own in rows}
    alike = {(a, b) for a in held for b in held if a < b and a % 90 != b % 90 and 10 * len(held[a] & held[b]) >= 8 * len(held[a] | held[b])}
    assert found == alike and len(alike) > 50


@pytest.mark.parametrize("share", [0.3, 0.8])
def test_signatures_agree_as_often_as_weights_overlap(share):
    generator = np.random.default_rng(7)
    element = generator.integers(0, 1 << 63, 400).astype(np.uint64)
    left, right = generator.uniform(0.1, 9, (2, 400))
    right = np.where(generator.random(400) < share, left, right)
    want = np.minimum(left, right).sum() / np.maximum(left, right).sum()
    owner = np.repeat([0, 1], 400)
    signed = minhash.dart_signatures(owner, np.tile(element, 2), np.concatenate([left, right]), 3, 4000)
    assert abs((signed[0] == signed[1]).mean() - want) < 0.03
    assert (signed[:2] != 0).all() and (signed[2] == 0).all()


def test_signatures_do_not_depend_on_company():
    texts = ["a b c d e f g h", "", "one", "k l m n o p q r s t u v w"]
    alone = []
    for text in texts:
        owner, value = minhash.shingles(split_words(pa.array([text])), 5)
        alone.append(minhash.dart_signatures(owner, value, np.ones(len(value)), 1, 50)[0])
    owner, value = minhash.shingles(split_words(pa.array(texts)), 5)
    assert (minhash.dart_signatures(owner, value, np.ones(len(value)), 4, 50) == np.array(alone)).all()


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 130)] + [(5, i) for i in range(6, 40)]
    got = {r["node"]: r["class"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 131)} | {i: 5 for i in range(5, 40)}


def test_components_put_roots_in_the_place_of_links(spark, monkeypatch):
    """A dense group's links are joined once, not in every round; classes equal those of a union by hand."""
    rng = np.random.default_rng(3)
    dense = {tuple(sorted(map(int, rng.choice(200, 2, replace=False)))) for _ in range(4000)}
    chain = [(1000 - i, 1001 - i) for i in range(90)] + [(2000, 3000 + i) for i in range(50)] + [(7000 + i, 7999) for i in range(50)]
    links = [*dense, *chain, *[(b, a) for a, b in chain], (5000, 5000)]
    written = []
    keep = components.__globals__["stored"]
    monkeypatch.setitem(components.__globals__, "stored", lambda df: written.append(keep(df)) or written[-1])
    got = {r["node"]: r["class"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {n: n for pair in links for n in pair if pair[0] != pair[1]}
    for _ in range(200):
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root
    sizes = [t.count() for t in written if t.columns == ["a", "b"]]
    assert sizes[0] > 3000 and sum(sizes[1:]) < 200 and sizes[-1] == 0 and len(sizes) <= 6
