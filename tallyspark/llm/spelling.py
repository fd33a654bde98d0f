"""Spelling variant grouping by PartEnum signatures.

Two words are near if one inserted, deleted or replaced code point turns one
into the other.  A word is seen as the multiset of its letters, each segment
of the word having its own, that is as a binary vector with one dimension for
each (segment, letter, occurrence).  A replaced letter changes two of these
dimensions, an inserted one changes one.  The dimensions are partitioned into
cells by a hash, and one signature is enumerated for every choice of cells
that leaves out as many as may have changed: two near words agree on one of
them at least, so an equi-join on the signatures finds every near pair.  Each
candidate is then verified by its edit distance.

Words of equal length are cut into the same ``SAME_SEGMENTS``.  For words one
letter apart, the shorter one is cut into ``GROWN_SEGMENTS`` and the longer
one once for each segment that may hold the added letter.

A word's form is its near word that occurs most often, if it does so at least
``ratio`` times as often as the word itself.  Counts grow by that factor from
form to form, so the way to the root is short and is followed by doubling.

Only distinct words are joined: however often a word occurs, it is one row,
counted per batch before the shuffle.  Nothing is collected.

Defined results: null and empty texts have no words; a run in a document with
a null id is read as in a document whose id is empty; repeated rows count
each; equal counts go to the smallest word in code-point order; an empty table
gives no rows; other columns of the documents are ignored.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import binary_column, column_slices, mix
from .tables import fixed

RUN = re.compile("[A-Za-zÀ-ÿ]+")
SAME_SEGMENTS, GROWN_SEGMENTS = 3, 2
#: Cells for words of one length (two dimensions may differ) and for words one
#: letter apart (one may).
SAME_CELLS, GROWN_CELLS = 5, 4
#: Distinct words that a task holds before it passes their counts on.
MOST_HELD = 500_000


def slipped(run: str, doc: int, every: int) -> str:
    """The run without one of its code points, if its checksum says so."""
    h = zlib.crc32(run.encode(), doc)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                least_chars: int = 7, slips_every: int | None = None) -> DataFrame:
    """(``word``, ``n``) of the runs of letters with A-Z lower-cased.  With
    ``slips_every`` = k, every run of a document whose CRC-32 of
    ``<id>:<run>`` k divides loses one code point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()),
                                               pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for whole in batches:
            for batch in column_slices(whole, "text"):
                ids = batch.column("id").to_pylist()
                for i, text in zip(ids, binary_column(batch, "text")):
                    if not text:
                        continue
                    found = Counter(RUN.findall(text.lower().decode()))  # bytes.lower is ASCII only
                    if slips_every:
                        doc = zlib.crc32(b":" if i is None else b"%d:" % i)
                        for w, n in found.items():
                            w = slipped(w, doc, slips_every)
                            if len(w) >= least_chars:
                                counts[w] += n
                    else:
                        for w, n in found.items():
                            if len(w) >= least_chars:
                                counts[w] += n
                    if len(counts) >= MOST_HELD:
                        yield out()
                        counts.clear()
        if counts:
            yield out()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Letters:
    """The code points of a batch of words, flat, with their places."""

    def __init__(self, words: list[str]):
        self.n = np.fromiter(map(len, words), np.int64, len(words))
        self.code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        self.word = np.repeat(np.arange(len(words)), self.n)
        self.at = np.arange(len(self.code)) - np.repeat(np.cumsum(self.n) - self.n, self.n)

    def cells(self, cells: int, segments: int, grown: int | None = None) -> np.ndarray:
        """Per word and cell, the sum of the hashes of its dimensions; with
        ``grown``, that segment is one letter longer than the others say."""
        short = self.n - (grown is not None)
        segment = np.zeros(len(self.code), np.int64)
        for k in range(1, segments):
            cut = short * k // segments + (grown is not None and k > grown)
            segment += self.at >= cut[self.word]
        dim = segment << 32 | self.code
        order = np.lexsort((dim, self.word))
        w, d = self.word[order], dim[order]
        new = np.ones(len(d), bool)
        new[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1])
        start = np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))
        occurrence = np.arange(len(d)) - start
        with np.errstate(over="ignore"):
            h = mix((d | (occurrence + 1) << 40).astype(np.uint64))
            sums = np.zeros((len(self.n), cells), np.uint64)
            np.add.at(sums, (w, ((h >> np.uint64(32)) % np.uint64(cells)).astype(np.int64)), h)
        return sums


def enumerated(sums: np.ndarray, length: np.ndarray, left_out: int, family: int) -> Iterator[np.ndarray]:
    """The signature of every choice of cells without ``left_out`` of them."""
    cells = sums.shape[1]
    with np.errstate(over="ignore"):
        for k, chosen in enumerate(itertools.combinations(range(cells), cells - left_out)):
            salt = mix((length << np.int64(16) | np.int64(family << 8 | k)).astype(np.uint64))
            yield mix(sums[:, list(chosen)].sum(axis=1, dtype=np.uint64) + salt).view(np.int64)


def signed(words: DataFrame, longer: bool) -> DataFrame:
    """(``sig``, ``word``, ``n``): the signatures that a word shares with near
    words of its length, and those it has as the shorter (or ``longer``) one
    of a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            letters = Letters(batch.column("word").to_pylist())
            sigs = list(enumerated(letters.cells(SAME_CELLS, SAME_SEGMENTS), letters.n, 2, 0))
            if longer:
                for grown in range(GROWN_SEGMENTS):
                    sigs += enumerated(letters.cells(GROWN_CELLS, GROWN_SEGMENTS, grown), letters.n - 1, 1, 1 + grown)
            else:
                sums = letters.cells(GROWN_CELLS, GROWN_SEGMENTS)
                for grown in range(GROWN_SEGMENTS):
                    sigs += enumerated(sums, letters.n, 1, 1 + grown)
            for sig in sigs:
                yield pa.RecordBatch.from_arrays([pa.array(sig), batch.column("word"), batch.column("n")],
                                                 names=["sig", "word", "n"])

    return words.mapInArrow(run, "sig long, word string, n long")


def near_pairs(words: DataFrame) -> DataFrame:
    """Every pair of near words once: (``a``, ``n_a``, ``b``, ``n_b``)."""
    left = signed(words, longer=False).toDF("sig", "a", "n_a")
    right = signed(words, longer=True).toDF("sig", "b", "n_b")
    more = F.length("b") - F.length("a")
    met = left.join(right, "sig").where(((more == 1) | ((more == 0) & (F.col("a") < F.col("b"))))
                                        & (F.levenshtein("a", "b", 1) == 1))
    return met.groupBy("a", "b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))


def _roots(links: DataFrame, steps: int) -> DataFrame:
    """(``word``, ``root``): the links followed to their last word."""
    roots = links.toDF("word", "root")
    for _ in range(steps):
        onward = roots.toDF("root", "_next")
        roots = fixed(roots.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root")))
    return roots


def spelling_forms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 7,
                   least_n: int = 2, ratio: int = 10, slips_every: int | None = None) -> DataFrame:
    """Per word: ``word``, ``n``, ``n_near``, ``form`` and ``form_n`` (null
    without one), ``root``."""
    if ratio <= 1:
        raise ValueError("a form must occur more often than its word")
    counted = word_counts(docs, id_col, text_col, least_chars, slips_every)
    words = fixed(counted.where(F.col("n") >= least_n))
    sides = F.inline(F.array(*(F.struct(F.col(w).alias("word"), F.col(o).alias("near"), F.col(f"n_{o}").alias("m"))
                               for w, o in (("a", "b"), ("b", "a")))))
    near = near_pairs(words).select(sides).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    has = -F.col("best.m") >= ratio * F.col("n")
    found = fixed(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.m")).alias("form_n")))
    # From word to form the count grows ``ratio`` times: so long is the longest way.
    top = found.agg(F.max("n")).first()[0] or 1
    way = int(math.log(max(top, 1), ratio)) + 1
    links = found.where(F.col("form").isNotNull()).select("word", "form")
    roots = _roots(links, max(way - 1, 0).bit_length())
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
