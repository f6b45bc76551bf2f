import hashlib
import re
from collections import defaultdict

import numpy as np

from cohortry.llm import exact_dedup
from tests.llm.conftest import ODD


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    return sorted(
        (d, min(g), len(g), d == min(g), hashlib.sha256(body.encode()).hexdigest()) for body, g in groups.items() for d in g
    )


def test_odd_texts_ties_and_repeated_rows(table):
    rows = [*ODD, (5, "one"), (20, "one"), (3, "one  two")]
    assert sorted(map(tuple, exact_dedup.exact_duplicates(table(rows)).collect())) == brute(rows)


def test_empty_table(table):
    assert exact_dedup.exact_duplicates(table([])).collect() == []


def test_null_keys_form_groups_too(table):
    got = exact_dedup.exact_duplicates(table([(None, "a"), (None, "a"), (3, "b"), (None, "b")])).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == sorted(
        [(None, None, 2, True), (None, None, 2, True), (3, 3, 2, True), (None, 3, 2, False)], key=str
    )


def test_filters_merge_without_loss():
    generator = np.random.default_rng(1)
    prints = generator.integers(0, 1 << 20, 5000).astype(np.uint64)
    parts = []
    for part in np.split(prints, [700, 701, 3000]):
        held, counts = np.unique(part, return_counts=True)
        parts.append(exact_dedup.build_filter(held, counts.astype(np.uint64), 20))
    got, counts = exact_dedup.filter_entries(exact_dedup.merge_filters(parts))
    want, times = np.unique(prints, return_counts=True)
    assert (got == want).all() and (counts == times).all()
