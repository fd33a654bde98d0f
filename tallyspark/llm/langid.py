"""Language identification with language-bitmask n-gram filters.

Training.  Character n-grams (``NGRAMS`` sizes) of the lower-cased words of
labelled texts are counted per language in Spark.  A language keeps the
n-grams that make up at least ``LEAST_FREQUENCY`` of its own n-grams -- at
most ``1 / LEAST_FREQUENCY`` per size by arithmetic, whatever the input -- and
that are at least ``LEAST_RATIO`` as frequent in it as in any language.

Filter.  One bit-sliced Bloom filter holds all languages: slot ``s`` is one
64-bit word for each 64 languages, and bit ``l % 64`` of its word ``l // 64``
belongs to language ``l``.  An n-gram is probed in
``PROBES`` slots, and the AND of these words is the mask of all languages that
contain it.

Decision.  The n-grams of a text are looked up in vector operations and each
language's hits are counted bit by bit.  A bit is set by chance with a known
probability (the product of the language's slot fill rates), so the counts are
corrected by it, divided by the share of its own text that a language's
n-grams cover in training, and the largest wins.  ``score`` is the winner's
share of these counts; ties go to the language with more training rows, then to
the smaller name.

Every labelled language is learnt.  A filter (``SLOTS`` slots, 4 MB for each 64
languages, and a few numbers) is broadcast; it holds about ``BLOCK`` languages
at most.  More are dealt into blocks by a hash of their name: each block's
filter is made, broadcast and asked in turn, the rows carry the best language
and the sum of all counts from block to block, and the result is that of one
filter for all.  Training reads a sample of at most ``TRAIN_ROWS`` labelled rows
per language, chosen by a hash of id and text; a language's row of the smallest
hash is always in it, so none is lost.

Defined results: null texts and texts without a letter give ``und`` and score
0; a text whose n-grams are all unknown gives the language with most training
rows and score 0; the whole text counts; repeated rows are judged alike; with
no labelled row at all every text is ``und``; extra columns pass through, and
one called like an output column is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .batches import column_slices, mix, with_arrow_columns
from .tables import fixed, numbered, renamed, share

NGRAMS = (2, 3, 4)
TRAIN_ROWS = 2_000
LEAST_FREQUENCY = 2e-4
LEAST_RATIO = 0.5
SLOTS = 1 << 19
#: Languages in one filter, and rows of a broadcast table of languages.
BLOCK = 512
DICE = 1 << 40
PROBES = 2
_CHUNK = 1 << 19
#: Which byte values have a bit.
_BITS = (np.arange(256)[None, :] >> np.arange(8)[:, None]) & 1


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


class Letters:
    """Which code points are letters, as a table filled on first use."""

    def __init__(self):
        self.known = np.full(0x110000, -1, np.int8)

    def mask(self, codes: np.ndarray) -> np.ndarray:
        got = self.known[codes]
        if (got < 0).any():
            new = np.unique(codes[got < 0])
            self.known[new] = [chr(c).isalpha() for c in new.tolist()]
            got = self.known[codes]
        return got > 0


def ngram_hashes(codes: np.ndarray, letter: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the n-grams of the padded words.  Everything that
    is no letter is one blank; an n-gram holds no blank but at its ends."""
    c = np.where(letter, codes, 0).astype(np.uint64)
    m = len(c) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.full(m, n, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x100000001B3) + c[k:k + m]
    inner = letter[1:1 + m].copy() if n > 2 else letter[:m] | letter[1:1 + m]
    for k in range(2, n - 1):
        inner &= letter[k:k + m]
    at = np.flatnonzero(inner)
    return mix(h[at]), at


def _pieces(text: str) -> Iterator[np.ndarray]:
    """Code points with a blank at both ends, in overlapping pieces."""
    codes = np.concatenate([[0], _codes(text), [0]]).astype(np.uint32)
    for k in range(0, max(1, len(codes) - 1), _CHUNK):
        yield codes[k:k + _CHUNK + max(NGRAMS) - 1]


class Found(NamedTuple):
    """What some languages' counts of a text come to."""
    language: str
    count: float
    rows: int
    total: float

    def merged(self, other: Found) -> Found:
        first, second = sorted((self, other), key=lambda f: (-f.count, -f.rows, f.language))
        return first._replace(total=first.total + second.total)

    @property
    def score(self) -> float:
        return self.count / self.total if self.total else 0.0


class Filter:
    """The trained model of one block of languages."""

    def __init__(self, languages: list[str], rows: list[int], grams: dict[int, list[int]],
                 cover: list[float] | None = None, slots: int = SLOTS):
        self.languages, self.rows, self.slots = languages, rows, slots
        self.cover = np.maximum(cover or [1.0] * len(languages), 1e-9)
        self.rank = np.lexsort((languages, [-r for r in rows]))  # tie order
        self.words = np.zeros((slots, max(1, -(-len(languages) // 64))), np.uint64)
        for bit in range(len(languages)):
            h = np.array(grams.get(bit, []), np.int64).view(np.uint64)
            for at in self.probes(h):
                self.words[at, bit // 64] |= np.uint64(1 << bit % 64)
        fill = np.array([np.count_nonzero(self.words[:, b // 64] & np.uint64(1 << b % 64)) / slots
                         for b in range(len(languages))])
        self.chance = fill ** PROBES

    def probes(self, h: np.ndarray) -> list[np.ndarray]:
        mask = np.uint64(self.slots - 1)
        return [((h >> np.uint64(24 * k)) & mask).astype(np.int64) for k in range(PROBES)]

    def counts(self, h: np.ndarray) -> np.ndarray:
        """Hits of each language among the n-gram hashes."""
        first, *rest = self.probes(h)
        mask = self.words[first]
        for at in rest:
            mask &= self.words[at]
        slices = mask.view(np.uint8)
        per_byte = [_BITS @ np.bincount(slices[:, k], minlength=256)
                    for k in range((len(self.languages) + 7) // 8)]
        return np.concatenate(per_byte)[:len(self.languages)].astype(float)

    def find(self, text: str | None, letters: Letters) -> Found | None:
        """The best language; None without a letter or a language."""
        total, hits, any_letter = 0, np.zeros(len(self.languages)), False
        for codes in _pieces(text or "") if self.languages else ():
            letter = letters.mask(codes)
            any_letter |= bool(letter.any())
            for n in NGRAMS:
                h, at = ngram_hashes(codes, letter, n)
                h = h[at < _CHUNK]
                total += len(h)
                hits += self.counts(h)
        if not any_letter:
            return None
        corrected = np.maximum(hits - total * self.chance, 0) / (1 - self.chance) / self.cover
        best = max(self.rank.tolist(), key=lambda b: corrected[b])
        return Found(self.languages[best], float(corrected[best]), self.rows[best], float(corrected.sum()))

    def decide(self, text: str | None, letters: Letters) -> tuple[str, float]:
        found = self.find(text, letters)
        return (found.language, found.score) if found else ("und", 0.0)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          train_rows: int = TRAIN_ROWS) -> Filter:
    """One filter of all languages of ``labelled``, 4 MB for each 64 of them."""
    return next(filters(labelled, id_col, text_col, lang_col, train_rows, block=None))


def filters(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
            train_rows: int = TRAIN_ROWS, block: int | None = BLOCK) -> Iterator[Filter]:
    """The filters learnt from ``labelled`` (rows with a null text or language
    are left out), each of about ``block`` languages at most, made one by one;
    one empty filter without any."""
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.pmod(
            F.xxhash64(F.lit("langid"), F.col(id_col), F.col(text_col)), F.lit(DICE)).alias("dice"))
    sizes = fixed(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.min("dice").alias("least")))
    n = sizes.count()
    blocks = -(-n // block) if block and n > block else 1
    number = F.pmod(F.xxhash64(F.lit("block"), "lang"), F.lit(blocks))
    chosen = _chosen(rows, sizes, train_rows, few=n <= BLOCK)
    if blocks > 1:
        chosen = fixed(chosen)
    for k in range(blocks):
        languages = sizes.where(number == k).orderBy(F.desc("rows"), "lang").collect()
        if not languages:
            if blocks == 1:
                yield Filter([], [], {})
            continue
        bits = {r["lang"]: bit for bit, r in enumerate(languages)}
        grams: dict[int, list[int]] = {}
        cover = [0.0] * len(languages)
        # Of a language 1 / LEAST_FREQUENCY n-grams of each size at most.
        for r in chosen.where(number == k).collect():
            bit = bits[r["lang"]]
            grams.setdefault(bit, []).append(r["h"])
            cover[bit] += r["f"] / len(NGRAMS)
        yield Filter(list(bits), [r["rows"] for r in languages], grams, cover)


def _chosen(rows: DataFrame, sizes: DataFrame, train_rows: int, few: bool) -> DataFrame:
    """``lang``, ``h``, ``f``: the n-grams that each language keeps, and their
    share of its n-grams of that size.  ``few``: at most ``BLOCK`` languages."""
    # Languages with fewer rows than wanted need no draw, so few are listed.
    large = sizes.where(F.col("rows") > train_rows).select("lang", F.greatest(
        "least", (F.lit(DICE) * (F.lit(float(train_rows)) / F.col("rows"))).cast("long")).alias("share"))
    if few or large.limit(BLOCK + 1).count() <= BLOCK:
        large = F.broadcast(large)
    drawn = rows.join(large, "lang", "left").where("share is null or dice <= share")
    # Equal rows are drawn together: the bound is kept by a cut after it.
    order = Window.partitionBy("lang").orderBy("dice")
    sample = drawn.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= train_rows).select(
        "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters()
        counts: dict[tuple[str, int], Counter] = {}

        def flush() -> pa.RecordBatch:
            rows = [(lang, n, h, c) for (lang, n), found in counts.items() for h, c in found.items()]
            counts.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()),
                 pa.array(np.array([r[2] for r in rows], np.uint64).view(np.int64)),
                 pa.array([r[3] for r in rows], pa.int64())], names=["lang", "size", "h", "n"])

        for whole in batches:
            for batch in column_slices(whole, "text"):
                for lang, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "text"))):
                    for codes in _pieces(text):
                        letter = letters.mask(codes)
                        for n in NGRAMS:
                            h, at = ngram_hashes(codes, letter, n)
                            values, c = np.unique(h[at < _CHUNK], return_counts=True)
                            counts.setdefault((lang, n), Counter()).update(
                                dict(zip(values.tolist(), c.tolist())))
                if sum(map(len, counts.values())) > 500_000:
                    yield flush()
        if counts:
            yield flush()

    counted = sample.mapInArrow(run, "lang string, size int, h long, n long").groupBy("lang", "size", "h").agg(
        F.sum("n").alias("n"))
    totals = counted.groupBy("lang", "size").agg(F.sum("n").alias("total"))
    frequent = counted.join(F.broadcast(totals) if few else totals, ["lang", "size"])  # a row per language and size
    frequent = frequent.withColumn("f", F.col("n") / F.col("total"))
    most = frequent.groupBy("size", "h").agg(F.max("f").alias("most"))
    return frequent.where(F.col("f") >= LEAST_FREQUENCY).join(most, ["size", "h"]).where(
        F.col("f") >= LEAST_RATIO * F.col("most")).select("lang", "h", "f")


def predict(docs: DataFrame, model: Filter | Iterable[Filter], text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, by one filter or by several
    that hold different languages."""
    several = iter([model] if isinstance(model, Filter) else model)
    first = next(several, None) or Filter([], [], {})
    second = next(several, None)
    if second is None:
        return _predict_at_once(docs, first, text_col)
    columns = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows, new = numbered(docs)
    for one in chain([first, second], several):
        # Written after each block, so that a task holds one filter only.
        rows = fixed(_with_found(rows, one, new(text_col)))
    score = F.when(F.col("total") > 0, F.col("count") / F.col("total")).otherwise(F.lit(0.0))
    return rows.select(*renamed(rows, columns, new), F.coalesce("language", F.lit("und")).alias("lang_pred"),
                       score.alias("score"))


def _with_found(rows: DataFrame, one: Filter, text_col: str) -> DataFrame:
    """``rows`` with the fields of ``Found`` for the languages of ``one`` and of
    the filters that the rows have met before."""
    shared, _ = share(rows.sparkSession, one)
    schema = [T.StructField("language", T.StringType()), T.StructField("count", T.DoubleType()),
              T.StructField("rows", T.LongType()), T.StructField("total", T.DoubleType())]
    met = "language" in rows.columns

    def make():
        letters, filled = Letters(), shared()

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            found = [filled.find(t, letters) for t in batch.column(text_col).to_pylist()]
            if met:
                before = zip(*(batch.column(f).to_pylist() for f in Found._fields))
                found = [f and f.merged(Found(*b)) for f, b in zip(found, before)]
            return [pa.array([f and f[k] for f in found], t) for k, t in enumerate(
                (pa.string(), pa.float64(), pa.int64(), pa.float64()))]

        return compute

    return with_arrow_columns(rows, schema, text_col, make)


def _predict_at_once(docs: DataFrame, model: Filter, text_col: str) -> DataFrame:
    shared, _ = share(docs.sparkSession, model)

    def make():
        letters, filled = Letters(), shared()

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            found = [filled.decide(t, letters) for t in batch.column(text_col).to_pylist()]
            return [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]

        return compute

    return with_arrow_columns(docs, [T.StructField("lang_pred", T.StringType()),
                                     T.StructField("score", T.DoubleType())], text_col, make)
