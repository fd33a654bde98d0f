"""Plumbing shared by the operators that work on Arrow batches: byte-level
word splitting, word and shingle hashes, and column helpers.

All functions here look at one row or one batch at a time and keep no state
that grows with the data.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

LOWER_ASCII = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit into
#: a blank, so that ``split`` yields runs of [0-9a-z] and non-ASCII bytes.
ALNUM_ASCII = bytes(
    c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
).translate(LOWER_ASCII)

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15


def space_words(text: bytes | None, lower: bool = False) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``; ``lower`` lower-cases A-Z only."""
    if not text:
        return []
    return (text.translate(LOWER_ASCII) if lower else text).split()


def alnum_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.translate(ALNUM_ASCII).split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def word_hashes_128(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of a 128-bit hash of each word."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads the bits of a polynomial hash."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


class RollingHash:
    """Rabin-Karp hashes modulo 2**64 of every ``width``-word window.

    With ``S`` the running sum of ``w[t] * base**-t`` the window that starts
    at ``i`` is ``(S[i + width] - S[i]) * base**i``: five vector operations
    per text whatever the width.  Word hashes are already random 64-bit
    numbers, and the result goes through a finalizer.
    """

    def __init__(self, width: int, base: int = _BASE):
        self.width, self.base = width, base  # an odd number
        self._up = np.ones(1, np.uint64)
        self._down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self._up) >= n:
            return
        with np.errstate(over="ignore"):
            n = max(n, 1 << 15)
            up, down = np.full(n, self.base, np.uint64), np.full(n, pow(self.base, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self._up, self._down = np.multiply.accumulate(up), np.multiply.accumulate(down)

    def windows(self, hashes: np.ndarray) -> np.ndarray:
        n = len(hashes) - self.width + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        self._powers(len(hashes))
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * self._down[:len(hashes)], out=sums[1:])
        return mix((sums[self.width:] - sums[:n]) * self._up[:n])


def shingle_set(words: list[bytes], rolling: RollingHash) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a text with fewer words
    than a shingle is one shingle, a text without words has none."""
    h = word_hashes(words)
    if 0 < len(h) < rolling.width:
        h = np.concatenate([h, np.full(rolling.width - len(h), len(h), np.uint64)])
    return np.unique(rolling.windows(h))


def binary_column(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding it."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def give_back() -> None:
    """Returns freed memory, of Arrow and of the C library, to the system:
    Spark keeps the worker process for later tasks, of whatever operator."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def column_slices(batch: pa.RecordBatch, name: str, most_bytes: int = 16 << 20
                  ) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most_bytes`` of that column (one row at least)."""
    sizes = np.cumsum(np.nan_to_num(np.asarray(
        pc.binary_length(batch.column(name)).to_pandas(), dtype=float)))
    start, n = 0, batch.num_rows
    while start < n:
        before = sizes[start - 1] if start else 0.0
        stop = max(start + 1, int(np.searchsorted(sizes, before + most_bytes, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def with_arrow_columns(df: DataFrame, fields: list[T.StructField], text_col: str,
                       make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
                       most_bytes: int = 16 << 20, end: Callable[[], None] | None = None) -> DataFrame:
    """``df`` with new columns computed by batches of about ``most_bytes`` of text.

    ``make`` runs once per task and returns the function that computes the
    new columns of a batch; ``end`` runs when the task has no more.  A column of ``df`` that has the name of a new
    one is replaced.
    """
    new = {f.name for f in fields}
    keep = [c for c in df.columns if c not in new]
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    read = text_col
    while read not in keep and (read in new or read == text_col or read in df.columns):
        read = f"_{read}"
    src = df if read == text_col else df.withColumnRenamed(text_col, read)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for whole in batches:
            for batch in column_slices(whole, read, most_bytes):
                columns = compute(batch.rename_columns(
                    [text_col if c == read else c for c in batch.schema.names]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in keep] + columns, names=[f.name for f in schema.fields])
            whole = batch = columns = None  # gone before the next batch comes
            pa.default_memory_pool().release_unused()
        if end:
            end()
        give_back()

    return src.mapInArrow(run, schema)
