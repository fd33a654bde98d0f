"""Ranked search against scoring every document, and the trees' bounds."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from tallyspark.llm import lexical_search as L

from .helpers import alnum_words, corpus, documents, prose


def plain(rows, items, k):
    """Every document scored for every item."""
    each = [(i, Counter(w)) for i, w in ((i, alnum_words(t)) for i, t in rows) if w]
    n_docs, n_words = len(each), sum(sum(c.values()) for _, c in each)
    df = Counter(t for _, c in each for t in c)
    out = []
    for item_id, text in set(items):
        scored = []
        for doc_id, c in each:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in alnum_words(text) if c[t])
            if s > 0:
                scored.append((-s, doc_id is None, doc_id))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item_id, r + 1, x[2], -x[0]) for r, x in enumerate(scored[:k])]
    return Counter(out)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def found(df):
    return Counter(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


@pytest.fixture(scope="module")
def tables():
    rows = corpus(3, 80)
    rng = random.Random(5)
    asked = [(k, prose(rng, rng.randrange(2, 30))) for k in range(12)]
    asked += [(20, rows[0][1]), (20, rows[0][1]), (20, rows[5][1]), (21, "W1 w1 w1, w2"), (22, None), (23, ""),
              (24, " !? "), (25, "nobody hasthis"), (26, "é 😀"), (None, "w3 w4 w5"), (27, rows[0][1])]
    return rows, asked


@pytest.mark.parametrize("block_words", [10**6, 200])
def test_equals_scoring_everything(spark, tables, block_words):
    rows, asked = tables
    got = L.search(documents(spark, rows), items(spark, asked), k=5, block_words=block_words)
    assert got.schema.simpleString() == "struct<item_id:bigint,rank:int,doc_id:bigint,score:bigint>"
    assert found(got) == plain(rows, [x for x in asked if x[1]], 5)


def test_small_trees_give_the_same(spark, tables, monkeypatch):
    rows, asked = tables
    for name, n in (("TREE_DOCS", 16), ("TREE_WEIGHTS", 300), ("LEAF_DOCS", 2)):
        monkeypatch.setattr(L, name, n)
    assert found(L.search(documents(spark, rows), items(spark, asked), k=3)) == plain(
        rows, [x for x in asked if x[1]], 3)


def test_clashing_columns_and_empty_tables(spark, tables):
    rows, asked = tables
    docs, wanted = documents(spark, rows), items(spark, asked)
    clash = docs.selectExpr("*", "1 as n", "'x' as terms", "2 as rank", "3 as item", "4 as _salt", "5 as score")
    more = wanted.selectExpr("*", "1 as item", "2 as doc_id", "3 as rank")
    assert found(L.search(clash, more, k=4)) == found(L.search(docs, wanted, k=4))
    assert L.search(docs.limit(0), wanted).count() == 0
    assert L.search(docs, wanted.limit(0)).count() == 0
    assert L.search(documents(spark, [(1, None), (2, " ")]), wanted).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(7)
    n, dims = 600, 50
    kinds = rng.integers(0, 1000, (6, dims)) * (rng.random((6, dims)) < 0.3)
    x = kinds[rng.integers(0, 6, n)] + rng.integers(0, 30, (n, dims)) * (rng.random((n, dims)) < 0.1)
    x[:, 0] += 1
    row, cols = np.nonzero(x)
    starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))[:-1]])
    scale = np.sqrt(rng.integers(1, 9000, dims).astype(float))
    tree = L.BallTree(np.arange(n), starts, cols, x[row, cols].astype(np.int64), scale)
    leaves = len(tree.leaves) - 1
    opened = 0
    for kind in kinds:
        terms = np.flatnonzero(kind)
        q = kind[terms].astype(np.int64)
        dense = np.zeros(dims, np.int64)
        dense[terms] = q
        exact = x @ dense
        bound = tree.bounds(terms, q / scale[terms])
        for k in range(leaves):
            inside = tree.ids[tree.leaves[k]:tree.leaves[k + 1]]
            node = tree.first_leaf + k
            while True:
                assert bound[node] >= exact[inside].max()
                if node == 0:
                    break
                node = (node - 1) // 2
        best = L.Best(10)
        tree.search(best, terms, q / scale[terms], dense)
        want = np.lexsort((np.arange(n), -exact))[:10]
        assert best.ids.tolist() == want.tolist() and best.scores.tolist() == exact[want].tolist()
        opened += int((bound[tree.first_leaf:] >= best.least).sum())
    assert opened < 6 * leaves * 0.8  # whole subtrees are left out
