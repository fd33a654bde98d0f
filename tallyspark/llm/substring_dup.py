"""Substring dedup: removes every word covered by a window of ``window``
consecutive words that also starts anywhere else, in any document.

1. Every window of every text gets a 64-bit Rabin-Karp hash; Spark counts the
   hashes.  A task first removes repeats inside its own share (a hash seen
   more than once is sent twice), so a window that a third of all rows hold
   costs two rows per task.  The hashes counted more than once are put into a
   bit filter of a fixed size (``filter_bits``), which is all that is
   broadcast.
2. Windows that hit the filter get a second Rabin-Karp hash with another base
   over other word hashes, 128 bits in all: windows of equal 64-bit hashes
   that differ go apart here.  A task knows the keys that repeat within
   its own share at once.  It sends one row for each key: a window with its
   place if the key is there once, else a mark without one.
3. Spark counts the rows of each key -- one a task at most, however often the
   window occurs -- and windows whose key has several are repeated too.  The
   filter only saves shuffle: when the repeated windows outgrow it more
   windows are sent, and the result stays the same.
4. The window starts come back per document and merge into maximal intervals,
   which are cut from the text.

Defined results: null, empty and short texts (fewer words than a window) lose
nothing; a text that is wholly covered becomes empty; repeated rows are
documents of their own, so their windows count as repeated; rows are told
apart by id and text, null ids included; an empty table gives an empty table;
extra columns pass through, and one called like an output column is replaced.
Two different windows are taken for equal only if their 128-bit keys are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .batches import RollingHash, binary_column, column_slices, mix, space_words, word_hashes_128
from .filters import FILTER_BITS, bit_filter, hits
from .tables import fixed, free_shuffles, numbered, renamed, row_key

FLUSH = 3_000_000
_OTHER_BASE = 0xD6E8FEB86659FD93
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class Windows:
    """Two independent 64-bit hashes of each window of a text.  The first is
    what the filter holds, both together are the window's key."""

    def __init__(self, window: int):
        self.rolling = RollingHash(window), RollingHash(window, _OTHER_BASE)

    def words(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        return word_hashes_128(space_words(text))

    def first(self, words: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return self.rolling[0].windows(words[0])

    def second(self, words: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return self.rolling[1].windows(words[1])


def alone(g: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are the only ones with their (g, k), and the first row of
    each (g, k) that has several."""
    order = np.lexsort((k, g))
    g, k = g[order], k[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
    last = np.append(new[1:], True)
    single = np.zeros(len(g), bool)
    single[order] = new & last
    return single, order[new & ~last]


def count_windows(docs: DataFrame, window: int, text_col: str = "text") -> DataFrame:
    """The hashes (``h``) of the windows that start more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(window)
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                h, c = np.unique(np.concatenate(held), return_counts=True)
                held.clear()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([h, h[c > 1]]).view(np.int64))], names=["h"])

        for whole in batches:
            for batch in column_slices(whole, text_col):
                for text in binary_column(batch, text_col):
                    h = windows.first(windows.words(text))
                    held.append(h)
                    n += len(h)
                    if n >= FLUSH:
                        n = 0
                        yield from flush()
        yield from flush()

    # Tasks have already combined their own repeats, so the rows are dealt by
    # hash before Spark counts them: a second map-side pass would find little
    # and spill much.
    hashes = docs.select(text_col).mapInArrow(run, "h long").repartition("h")
    return hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")


def repeated_starts(docs: DataFrame, window: int, id_col: str, text_col: str,
                    filter_bits: int = FILTER_BITS) -> DataFrame:
    """``_id``, ``_th`` (see ``row_key``) and ``starts``: per document, the
    word places where a repeated window starts."""
    spark = docs.sparkSession
    repeated = fixed(count_windows(docs, window, text_col))
    free_shuffles(spark)
    shared = spark.sparkContext.broadcast(bit_filter(repeated, filter_bits))
    names = ["_id", "_th", "start", "starts", "g", "k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, filled = Windows(window), shared.value
        held, docs_held, n = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            doc, at, g, k = (np.concatenate(x) for x in zip(*held))
            ids, ths = (np.array(x, np.int64) for x in zip(*docs_held))
            held.clear(), docs_held.clear()
            single, mark = alone(g, k)
            yield batch_of(ids[doc[single]], ths[doc[single]], at[single], None, g[single], k[single])
            none = np.zeros(len(mark), np.int64)
            yield batch_of(none, none, np.full(len(mark), -1), None, g[mark], k[mark])
            # Known to repeat: a row for each document, under a key of its own.
            doc, at = doc[~single], at[~single]
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            ends = np.append(first, len(doc)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(at.astype(np.int32)))
            own = doc[first]
            yield batch_of(ids[own], ths[own], np.full(len(own), -1), lists, mix(ids[own].view(np.uint64)),
                           ths[own].view(np.uint64))

        def batch_of(ids, ths, at, lists, g, k) -> pa.RecordBatch:
            lists = pa.nulls(len(ids), pa.list_(pa.int32())) if lists is None else lists
            return pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(ths), pa.array(at.astype(np.int32)), lists,
                 pa.array(g.view(np.int64)), pa.array(k.view(np.int64))], names=names)

        for whole in batches:
            for batch in column_slices(whole, text_col, 4 << 20):
                ids, ths = (np.asarray(batch.column(c)) for c in ("_id", "_th"))
                for row, text in enumerate(binary_column(batch, text_col)):
                    words = windows.words(text)
                    h = windows.first(words)
                    at = np.flatnonzero(hits(h, filled, filter_bits)) if len(h) else h
                    if len(at):
                        held.append((np.full(len(at), len(docs_held)), at, h[at], windows.second(words)[at]))
                        docs_held.append((ids[row], ths[row]))
                        n += len(at)
                if n >= FLUSH // 2:
                    n = 0
                    yield from flush()
        yield from flush()

    rows = docs.select(*row_key(id_col, text_col), text_col)
    sent = rows.mapInArrow(run, "_id long, _th long, start int, starts array<int>, g long, k long")
    several = F.count(F.lit(1)).over(Window.partitionBy("g", "k")) > 1
    known = F.col("starts").isNotNull()
    found = sent.withColumn("several", several).where(known | (F.col("several") & (F.col("start") >= 0)))
    return found.groupBy("_id", "_th").agg(F.array_distinct(F.concat(
        F.collect_set(F.when(~known, F.col("start"))), F.flatten(F.collect_list("starts")))).alias("starts"))


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id",
                   text_col: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """``docs`` with ``kept_text`` (the text without the covered words; an
    untouched text stays as it is), ``n_words`` and ``n_removed``."""
    made = ("kept_text", "n_words", "n_removed")
    columns = [c for c in docs.columns if c not in made or c == text_col]
    docs, new = numbered(docs)
    id_col, text_col = new(id_col), new(text_col)
    docs = docs.select(*(new_name for new_name in docs.columns if new_name in {new(c) for c in columns} | {id_col}))
    starts = repeated_starts(docs, window, id_col, text_col, filter_bits)
    key = row_key(id_col, text_col)
    joined = docs.withColumns({"_id": key[0], "_th": key[1]}).join(starts, ["_id", "_th"], "left")
    fields = [docs.schema[c] for c in docs.columns]
    schema = T.StructType(fields + [T.StructField("kept_text", T.StringType()),
                                    T.StructField("n_words", T.LongType()),
                                    T.StructField("n_removed", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in column_slices(whole, text_col):
                kept, words, removed = [], [], []
                lists = batch.column("starts").to_pylist()
                for text, at in zip(binary_column(batch, text_col), lists):
                    n = len(space_words(text))
                    if at:
                        text, gone = cut(text, np.sort(np.array(at, np.int64)), window)
                    else:
                        gone = 0
                    kept.append(text)
                    words.append(n)
                    removed.append(gone)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(f.name) for f in fields]
                    + [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(words, pa.int64()),
                       pa.array(removed, pa.int64())], names=schema.fieldNames())

    done = joined.mapInArrow(run, schema)
    return done.select(*renamed(done, [c for c in columns if c not in made], new), *made)


def cut(text: bytes, starts: np.ndarray, window: int) -> tuple[bytes, int]:
    """The text without the words of the windows at ``starts`` (sorted), and
    their number.  White space before a removed word goes with it."""
    spans = [m.span() for m in _WORD.finditer(text)]
    breaks = np.flatnonzero(np.diff(starts) > window) + 1
    firsts = starts[np.concatenate([[0], breaks])]
    lasts = starts[np.concatenate([breaks - 1, [len(starts) - 1]])] + window - 1
    out, pos = [], 0
    for first, last in zip(firsts.tolist(), lasts.tolist()):
        out.append(text[pos:spans[first - 1][1] if first else 0])
        pos = spans[last][1]
    out.append(text[pos:])
    kept = b"".join(out)
    return (kept.lstrip(b" \t\n\r\x0b\x0c") if firsts[0] == 0 else kept), int((lasts - firsts + 1).sum())
