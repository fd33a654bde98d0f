"""Ranked lexical search: exact inner products by sparse ball trees.

A document's weight for a term and an item's weight for it are whole numbers,
and a document's score for an item is the inner product of the two sparse
vectors.  Documents are read in blocks; each block becomes a ball tree, whose
nodes keep the centroid ``c`` and the radius ``r`` of their documents.  No
document of a node can score more than ``q . c + |q| r``.  That bound is
computed in doubles and widened by more than any rounding error, so the
best-first search of an item may leave out a node whose bound is below the
item's k-th best score so far and still be exact.  At the leaves scores are
64-bit integers.

The vectors hold the items' terms alone; they are computed once and written to
the checkpoint folder.  A task keeps the k best documents of each item over
all its blocks and passes on these; they are merged in two steps, so that no
group grows with the number of tasks alone.  What is broadcast is a block of
items of at most ``block_words`` words with the counts of their terms; more
items come in several blocks, each a pass over the documents.  Items with
equal texts are searched once.

Defined results: null and empty texts have no terms, a document without terms
does not count; an item without terms, or whose terms no document has, gets no
rows; equal (id, text) items are one item, other items of the same id are
ranked apart; repeated documents are ranked each; documents with a null id
come last among equal scores; empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .batches import alnum_words, binary_column, column_slices
from .tables import fixed, share

BLOCK_WORDS = 200_000
#: Documents, and weights, of one tree; documents of a leaf; numbers in the
#: centroids of one tree.  They trade memory for time and change no result.
TREE_DOCS, TREE_WEIGHTS, LEAF_DOCS, MOST_CENTROIDS = 4096, 1 << 21, 32, 1 << 23
MERGE_SALTS = 64


def vectors(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(``doc_id``, ``n``, ``terms``, ``tfs``) of the documents with a term:
    all its terms counted, those of the vocabulary listed."""
    shared, _ = share(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared().get
        for whole in batches:
            for batch in column_slices(whole, "text"):
                rows, sizes, ends, terms, tfs = [], [], [0], [], []
                for k, text in enumerate(binary_column(batch, "text")):
                    words = alnum_words(text)
                    if not words:
                        continue
                    found = Counter(map(known, words))
                    found.pop(None, None)
                    rows.append(k)
                    sizes.append(len(words))
                    terms.extend(found)
                    tfs.extend(found.values())
                    ends.append(len(terms))
                if rows:
                    lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int64()))
                             for x in (terms, tfs)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(rows)), pa.array(sizes, pa.int64()), *lists],
                        names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<long>, tfs array<long>")


def document_frequencies(rows: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(np.asarray(batch.column("terms").flatten()), minlength=size)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "df"])

    out = np.zeros(size, np.int64)
    counted = rows.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    for r in counted.collect():  # at most the vocabulary of a block of items
        out[r["term"]] = r["df"]
    return out


class BallTree:
    """A ball tree over a block of sparse vectors of whole numbers.

    Distances are taken after scaling each dimension by ``scale``; dividing
    an item's weights by it leaves the inner products as they are.
    """

    def __init__(self, ids: np.ndarray, starts: np.ndarray, cols: np.ndarray, vals: np.ndarray, scale: np.ndarray):
        n, dims = len(ids), len(scale)
        length = np.diff(np.append(starts, len(cols)))
        row = np.repeat(np.arange(n), length)
        y = vals * scale[cols]
        # More than the rounding of any sum or product below, relative to its terms.
        self.slack = 8 * (dims + 64) * np.finfo(float).eps
        squares = np.bincount(row, y * y, n)
        depth = 0
        while n >> depth > LEAF_DOCS and (4 << depth) * dims <= MOST_CENTROIDS:
            depth += 1
        order, bounds = np.arange(n), [0, n]
        centres, radii, self.spans = [], [], []
        for level in range(depth + 1):
            k, sizes = len(bounds) - 1, np.diff(bounds)
            node = np.empty(n, np.int64)
            node[order] = np.repeat(np.arange(k), sizes)
            at = node[row]
            c = np.bincount(at * dims + cols, y, k * dims).reshape(k, dims) / sizes[:, None]

            def gap(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                """Squared distances to each row's point, and the size of the terms."""
                own = np.einsum("ij,ij->i", points, points)[node]
                return squares - 2 * np.bincount(row, y * points[at, cols], n) + own, squares + own

            far, terms = gap(c)
            safe = np.sqrt(np.maximum(far, 0) + self.slack * terms)
            centres.append(c)
            radii.append(np.maximum.reduceat(safe[order], bounds[:-1]) * (1 + self.slack))
            if level == depth:
                break

            def rows_of(picked: list[int]) -> np.ndarray:
                points = np.zeros((k, dims))
                for j, r in enumerate(picked):
                    s = slice(starts[r], starts[r] + length[r])
                    points[j, cols[s]] = y[s]
                return points

            spans = [order[a:b] for a, b in zip(bounds, bounds[1:])]
            one, _ = gap(rows_of([s[np.argmax(far[s])] for s in spans]))
            two, _ = gap(rows_of([s[np.argmax(one[s])] for s in spans]))
            lean, parts, bounds = one - two, [], [0]
            for s in spans:
                s = s[np.argsort(lean[s], kind="stable")]
                parts.append(s)
                bounds += [bounds[-1] + len(s) // 2, bounds[-1] + len(s)]
            order = np.concatenate(parts)
        self.centres = np.ascontiguousarray(np.concatenate(centres).T)
        self.radii, self.first_leaf = np.concatenate(radii), (1 << depth) - 1
        # The documents in the order of the leaves.
        new = length[order]
        ends = np.cumsum(new)
        source = np.repeat(starts[order] - (ends - new), new) + np.arange(len(cols))
        self.ids, self.cols, self.vals, self.starts = ids[order], cols[source], vals[source], ends - new
        self.leaves, self.end = bounds, len(cols)

    def bounds(self, terms: np.ndarray, scaled: np.ndarray) -> np.ndarray:
        """Per node, no less than the best score of its documents."""
        norm = math.sqrt(float(scaled @ scaled))
        return (scaled @ self.centres[terms] + norm * self.radii) * (1 + 4 * self.slack)

    def search(self, best: "Best", terms: np.ndarray, scaled: np.ndarray, dense: np.ndarray) -> None:
        """Puts the block's documents into the item's best ones; ``dense``
        holds the item's weights by term."""
        bound = self.bounds(terms, scaled)
        queue = [(-bound[0], 0)]
        while queue and -queue[0][0] >= best.least:
            k = heapq.heappop(queue)[1]
            if k < self.first_leaf:
                for child in (2 * k + 1, 2 * k + 2):
                    if bound[child] >= best.least:
                        heapq.heappush(queue, (-bound[child], child))
                continue
            a, b = self.leaves[k - self.first_leaf], self.leaves[k - self.first_leaf + 1]
            lo, hi = self.starts[a], self.starts[b] if b < len(self.starts) else self.end
            scores = np.add.reduceat(dense[self.cols[lo:hi]] * self.vals[lo:hi], self.starts[a:b] - lo)
            best.add(scores, self.ids[a:b])


class Best:
    """The ``k`` best (score, id) of an item; equal scores by id, and the
    stand-in of a null id last."""

    NO_ID = np.iinfo(np.int64).max

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.scores = self.ids = np.empty(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        some = scores >= self.least
        if not some.any():
            return
        scores, ids = np.concatenate([self.scores, scores[some]]), np.concatenate([self.ids, ids[some]])
        top = np.lexsort((ids, -scores))[:self.k]
        self.scores, self.ids = scores[top], ids[top]
        if len(top) == self.k:
            self.least = int(self.scores[-1])


class ItemBlock:
    """Weights of a block of items over the terms that documents hold."""

    def __init__(self, texts: list[Counter], df: np.ndarray, n_docs: int, n_words: int):
        self.n_docs, self.n_words = n_docs, n_words
        weight = [int(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1)))) if d else 0 for d in df]
        # Terms without weight, or in no document, add nothing to any score.
        used = [t for t, w in enumerate(weight) if w]
        self.place = np.full(len(df), -1, np.int64)
        self.place[used] = np.arange(len(used))
        self.scale = np.sqrt(np.array([weight[t] for t in used], float))
        self.items = []
        for found in texts:
            terms = [t for t in sorted(found) if weight[t]]
            at = self.place[terms]
            q = np.array([weight[t] * found[t] for t in terms], np.int64)
            self.items.append((at, q, q / self.scale[at]))

    def weights(self, n: np.ndarray, tf: np.ndarray) -> np.ndarray:
        m = 100 - 25 + 25 * n * self.n_docs // self.n_words
        return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def trees(batches: Iterator[pa.RecordBatch], block: ItemBlock) -> Iterator[BallTree]:
    """Ball trees over the documents of a task, a bounded number in each."""
    held: list[tuple] = []
    docs = weights = 0

    def tree() -> BallTree:
        ids, length, cols, vals = (np.concatenate(x) for x in zip(*held))
        return BallTree(ids, np.cumsum(length) - length, cols, vals, block.scale)

    for batch in batches:
        ids = np.asarray(batch.column("doc_id").fill_null(int(Best.NO_ID)))
        length = np.diff(np.asarray(batch.column("terms").offsets))
        cols = block.place[np.asarray(batch.column("terms").flatten())]
        vals = block.weights(np.repeat(np.asarray(batch.column("n")), length),
                             np.asarray(batch.column("tfs").flatten()))
        row = np.repeat(np.arange(len(ids)), length)[cols >= 0]
        vals, cols = vals[cols >= 0], cols[cols >= 0]
        length = np.bincount(row, minlength=len(ids))
        ends = np.concatenate([[0], np.cumsum(length)])
        a = 0
        while a < len(ids):
            room = min(a + TREE_DOCS - docs, int(np.searchsorted(ends, ends[a] + TREE_WEIGHTS - weights, "right")))
            b = min(len(ids), max(a + 1, room))
            some = length[a:b] > 0
            if some.any():
                held.append((ids[a:b][some], length[a:b][some], cols[ends[a]:ends[b]], vals[ends[a]:ends[b]]))
            docs, weights, a = docs + int(some.sum()), weights + int(ends[b] - ends[a]), b
            if docs >= TREE_DOCS or weights >= TREE_WEIGHTS:
                yield tree()
                held, docs, weights = [], 0, 0
    if held:
        yield tree()


def _best_of(rows: DataFrame, k: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for keys in (["item", "_salt"], ["item"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(
            F.col("rank") <= k)
    return rows.drop("_salt")


def _search_block(docs: DataFrame, texts: list[tuple[str, bytes]], k: int, id_col: str, text_col: str) -> DataFrame:
    vocabulary: dict[bytes, int] = {}
    counts = [Counter(vocabulary.setdefault(w, len(vocabulary)) for w in alnum_words(t)) for _, t in texts]
    rows = fixed(vectors(docs, vocabulary, id_col, text_col))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("words")).first()
    block = ItemBlock(counts, document_frequencies(rows, len(vocabulary)), total["n"], total["words"] or 1)
    shared, _ = share(docs.sparkSession, (block, [key for key, _ in texts]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, keys = shared()
        best, dense = [Best(k) for _ in keys], np.zeros(len(block.scale), np.int64)
        for tree in trees(batches, block):
            for (terms, q, scaled), own in zip(block.items, best):
                if len(terms):
                    dense[terms] = q
                    tree.search(own, terms, scaled, dense)
                    dense[terms] = 0
        size = [len(b.ids) for b in best]
        if any(size):
            ids = pa.array(np.concatenate([b.ids for b in best]))
            ids = pa.compute.if_else(pa.compute.equal(ids, int(Best.NO_ID)), None, ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key for key, n in zip(keys, size) for _ in range(n)], pa.string()), ids,
                 pa.array(np.concatenate([b.scores for b in best]))], names=["item", "doc_id", "score"])

    found = rows.mapInArrow(run, "item string, doc_id long, score long")
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(MERGE_SALTS)))
    return _best_of(salted, k)


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
           item_id_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(``item_id``, ``rank``, ``doc_id``, ``score``): the ``k`` documents
    that score highest for each item, among those that score above 0."""
    wanted = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).alias("text")).where(
        F.col("text").isNotNull()).distinct().withColumn("item", F.sha2("text", 256))
    distinct = wanted.select("item", "text").dropDuplicates(["item"])
    # Bytes / 2 is at least the number of words.
    size = distinct.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0
    n = int(size // block_words) + 1
    out = None
    for b in range(n):
        # Bounded by block_words; more items come in several blocks.
        part = distinct.where(F.pmod(F.xxhash64("item"), F.lit(n)) == b).collect()
        found = _search_block(docs, [(r["item"], r["text"].encode()) for r in part], k, id_col, text_col)
        found = fixed(found) if n > 1 else found
        out = found if out is None else out.unionByName(found)
    return wanted.drop("text").join(out, "item").select("item_id", "rank", "doc_id", "score")
