"""Benchmark decontamination by size-partitioned MinHash containment search.

An item leaks into a document if at least ``percent`` % of the item's distinct
word shingles are in the document (words are runs of letters and digits with
A-Z lower-cased; an item with fewer words than a shingle is one shingle).

Items are partitioned by size, and each size class has an index of its own.
The items of a class that ends at ``size`` shingles are each sketched by their
``size * (100 - percent) // 100 + 1`` smallest MinHash values.  A document that holds ``percent`` % of an item lacks
fewer shingles than that, so it holds one value of the sketch: the candidate
search looks up every shingle of a document in the sketches and misses
nothing.  Each candidate is verified by its exact shingle containment, on the
words themselves.

Documents are read once, in place: nothing is shuffled, and a long document or
a passage that a third of all documents hold is just one more row.  Items with
equal texts are indexed once, and their ids joined to what is found.  What is
broadcast is a block of different items of at most ``block_words`` words (more
only if a single item has more); a larger benchmark is dealt into several
blocks, each one more pass over the documents, with its pairs fixed in the
checkpoint folder.

Defined results: null, empty or word-less items and documents match nothing;
repeated items are reported each, repeated documents each; an item of fewer
words than a shingle is found as a run of these words; empty tables give an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import RollingHash, alnum_words, binary_column, column_slices
from .tables import fixed, numbered, renamed, row_key, share

BLOCK_WORDS = 2_000_000
#: Ends of the size classes of items, in shingles; beyond, each doubles.
FIRST_CLASS = 8


def class_end(n: int) -> int:
    end = FIRST_CLASS
    while end < n:
        end *= 2
    return end


class ItemIndex:
    """A block of benchmark items: vocabulary, shingle sets, and per shingle
    width and size class the sketches."""

    def __init__(self, items: list[tuple[str, bytes]], shingle: int, percent: int):
        self.shingle, self.percent = shingle, percent
        self.word_id: dict[bytes, int] = {}
        self.ids: list[str] = []
        self.sets: list[frozenset] = []
        classes: dict[tuple[int, int], dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            words = [self.word_id.setdefault(w, len(self.word_id) + 1) for w in alnum_words(text)]
            if not words:
                continue
            width = min(shingle, len(words))
            ids = np.array(words, np.uint64)
            at: dict[tuple, int] = {}
            for k, h in enumerate(RollingHash(width).windows(ids).tolist()):
                at[tuple(words[k:k + width])] = h
            end = class_end(len(at))
            for h in sorted(at.values())[:end * (100 - percent) // 100 + 1]:
                classes[width, end][h].append(len(self.ids))
            self.ids.append(item_id)
            self.sets.append(frozenset(at))
        self.sketches: dict[int, list[tuple[np.ndarray, dict[int, list[int]]]]] = defaultdict(list)
        for (width, _), held in sorted(classes.items()):
            self.sketches[width].append((np.array(sorted(held), np.uint64), dict(held)))

    def search(self, text: bytes | None, rolling: dict[int, RollingHash]) -> list[tuple[str, int, int]]:
        """(item, shared shingles, shingles of the item) of the leaked items."""
        known = self.word_id
        words = [known.get(w, 0) for w in alnum_words(text)]
        ids = np.array(words, np.uint64)
        inside = np.concatenate([[0], np.cumsum(ids == 0)])
        found = []
        for width, classes in self.sketches.items():
            if len(ids) < width:
                continue
            whole = np.flatnonzero(inside[width:] == inside[:-width])  # windows of benchmark words
            h = rolling[width].windows(ids)[whole]
            candidates = set()
            for values, items in classes:
                place = np.minimum(np.searchsorted(values, h), len(values) - 1)
                candidates.update(k for x in np.unique(h[values[place] == h]).tolist() for k in items[x])
            if not candidates:
                continue
            there = {tuple(words[k:k + width]) for k in whole.tolist()}
            for k in candidates:
                shared = len(self.sets[k] & there)
                if 100 * shared >= self.percent * len(self.sets[k]):
                    found.append((self.ids[k], shared, len(self.sets[k])))
        return sorted(found)


def _blocks(items: DataFrame, key_col: str, text_col: str, block_words: int) -> list:
    """Conditions that split the items, one row a text, into blocks: as many
    as hold the bound when dealt by hash, with room for unevenness."""
    # Bytes / 2 is at least the number of words.
    size = items.agg(F.sum(F.octet_length(text_col) / 2 + 1)).first()[0] or 0
    n = 1 if size <= block_words else 2 * int(size // block_words) + 1
    block = F.pmod(F.xxhash64(key_col), F.lit(n))
    return [block == k for k in range(n)]


def leaks(docs: DataFrame, items: DataFrame, shingle: int = 5, percent: int = 80,
          id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
          item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The pairs (``doc_id``, ``item_id``, ``n_shared``, ``n_item``,
    ``containment``) of documents and items leaked into them, and ``_th``,
    the hash that ``row_key`` gives the document's text."""
    spark = docs.sparkSession
    th = row_key(id_col, text_col)[1]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), th, F.col(text_col).alias("text"))
    wanted = items.select(F.col(item_id_col).cast("long").alias("item_id"),
                          F.col(item_text_col).alias("text")).where("text IS NOT NULL").withColumn(
        "item", F.sha2("text", 256))
    distinct = wanted.select("item", "text").dropDuplicates(["item"])
    conditions = _blocks(distinct, "item", "text", block_words)
    out = None
    for condition in conditions:
        # Bounded by block_words; larger benchmarks come in several blocks.
        block = [(r["item"], r["text"].encode()) for r in distinct.where(condition).collect()]
        shared, sent = share(spark, ItemIndex(block, shingle, percent))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared()
            rolling = {width: RollingHash(width) for width in index.sketches}
            for whole in batches:
                for batch in column_slices(whole, "text"):
                    found = [(k, *hit) for k, text in enumerate(binary_column(batch, "text"))
                             for hit in index.search(text, rolling)]
                    if not found:
                        continue
                    at = pa.array([f[0] for f in found], pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(at), batch.column("_th").take(at),
                         pa.array([f[1] for f in found], pa.string())]
                        + [pa.array([f[k] for f in found], pa.int64()) for k in (2, 3)],
                        names=["doc_id", "_th", "item", "n_shared", "n_item"])

        pairs = rows.mapInArrow(run, "doc_id long, _th long, item string, n_shared long, n_item long")
        if len(conditions) > 1:
            pairs = fixed(pairs)
            sent.destroy()
        out = pairs if out is None else out.unionByName(pairs)
    named = out.join(wanted.select("item_id", "item"), "item").drop("item")
    return named.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def clean(docs: DataFrame, items: DataFrame, shingle: int = 5, percent: int = 80,
          id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """``docs`` without the rows into which an item has leaked."""
    columns = docs.columns
    docs, new = numbered(docs)
    id_col, text_col = new(id_col), new(text_col)
    found = leaks(docs, items, shingle, percent, id_col, text_col, **kwargs).select(
        F.coalesce("doc_id", F.lit(0)).alias("_id"), "_th").distinct()
    keyed = docs.withColumns(dict(zip(("_id", "_th"), row_key(id_col, text_col))))
    return keyed.join(found, ["_id", "_th"], "left_anti").select(renamed(keyed, columns, new))
