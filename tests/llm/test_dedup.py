"""Near and substring dedup against brute force; hot groups; the pipeline."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from tallyspark.llm import near_dup, substring_dup
from tests.llm.helpers import components, corpus, documents, prose, without_repeats, words


def found_components(spark, rows, shingle, **kwargs):
    got = near_dup.near_duplicates(documents(spark, rows), shingle=shingle, **kwargs)
    return Counter((r["id"], r["n_shingles"], r["component_id"]) for r in got.collect())


@pytest.mark.parametrize("shingle", [2, 5])
def test_components_equal_all_pairs(spark, shingle):
    rows = corpus(seed=shingle)
    want = Counter((i, n, c) for (i, _), (n, c) in zip(rows, components(rows, shingle, 80)))
    assert found_components(spark, rows, shingle) == want


def hot_group(n, seed=3):
    """A chain-like group of near copies around one text, and exact copies."""
    rng = random.Random(seed)
    base = prose(rng, 60, 5000).split(" ")
    rows = []
    for i in range(n):
        w = base.copy()
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"y{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    return rows


def test_a_group_that_is_dealt_in_blocks_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 20)
    rows = hot_group(260)
    want = Counter((i, n, c) for (i, _), (n, c) in zip(rows, components(rows, 2, 80)))
    assert found_components(spark, rows, 2) == want


def test_one_representative_a_group(spark):
    rows = [r for r in corpus(seed=9) if r[1] != "another text with an id that is taken"]
    got = near_dup.representatives(documents(spark, rows), shingle=5)
    assert got.columns == documents(spark, rows).columns
    kept = Counter((r["doc_id"], r["text"]) for r in got.collect())
    comp = components(rows, 5, 80)
    with_words = {c for (_, t), (n, c) in zip(rows, comp) if n}
    assert sum(v for (i, t), v in kept.items() if words(t)) == len(with_words)
    assert {i for (i, t) in kept if words(t)} == with_words
    assert sum(not words(t) for _, t in rows) == sum(v for (i, t), v in kept.items() if not words(t))


def test_near_dup_of_an_empty_table(spark):
    assert near_dup.near_duplicates(documents(spark, [])).count() == 0
    assert near_dup.representatives(documents(spark, [(1, None), (2, "")])).count() == 2


def test_posterior_bound():
    steps = near_dup.least_matches(252, 42, 0.8, 1e-5)
    assert [n for n, _ in steps] == list(range(42, 253, 42))
    rng = np.random.default_rng(0)  # pairs at the threshold pass all steps
    draws = rng.random((20000, 252)) < 0.8
    lost = sum(any(row[:n].sum() < least for n, least in steps) for row in draws)
    assert lost <= 4


@pytest.mark.parametrize("window, bits", [(35, substring_dup.FILTER_BITS), (4, 1 << 14)])
def test_substring_dedup_equals_the_plain_rule(spark, window, bits):
    """The tiny filter is full: the exact join alone must give the result."""
    rows = corpus(seed=4)
    got = substring_dup.remove_repeats(documents(spark, rows), window=window, filter_bits=bits).collect()
    want = Counter((i, n, k, " ".join(kept)) for (i, _), (n, k, kept) in zip(rows, without_repeats(rows, window)))
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], " ".join(words(r["kept_text"])))
                   for r in got) == want
    assert all(r["kept_text"] == r["text"] for r in got if not r["n_removed"])


def test_substring_dedup_of_an_empty_table(spark):
    assert substring_dup.remove_repeats(documents(spark, [])).count() == 0


def test_cut_keeps_the_rest_as_it_is():
    text = b"a  b\nc d\te f g"
    assert substring_dup.cut(text, np.array([1, 2]), 2) == (b"a\te f g", 3)
    assert substring_dup.cut(text, np.array([0]), 2) == (b"c d\te f g", 2)
    assert substring_dup.cut(text, np.array([0, 5]), 2) == (b"c d\te", 4)
    assert substring_dup.cut(text, np.array([0, 2, 4, 5]), 2) == (b"", 7)
