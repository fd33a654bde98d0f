"""A bit filter of fixed size over 64-bit hashes, filled by Spark.

It answers "surely not in" or "maybe in".  Its size is a parameter and does
not depend on the number of hashes, so it may always be broadcast; the more it
holds, the more it says "maybe", and whoever uses it must check by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 1 << 27
SHARDS = 256
PROBES = 4


def _slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and the bit places inside it of each hash."""
    size = np.uint64(bits // SHARDS)
    shard = (h >> np.uint64(56)).astype(np.int64) * SHARDS >> 8
    step = (h >> np.uint64(28)) | np.uint64(1)
    places = [((h + np.uint64(k) * step) % size).astype(np.int64) for k in range(PROBES)]
    return shard, np.stack(places)


def bit_filter(hashes: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit filter of the hashes: ``bits / 8`` bytes whatever their number.
    Each shard is filled by one stream of rows and only its bits come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[int, np.ndarray] = {}
        for batch in batches:
            h = np.asarray(batch.column("h")).view(np.uint64)
            shard, places = _slots(h, bits)
            for s in np.unique(shard):
                mine = shards.setdefault(int(s), np.zeros(bits // SHARDS // 8, np.uint8))
                at = places[:, shard == s].ravel()
                np.bitwise_or.at(mine, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        for s, mine in shards.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([s]), pa.array([mine.tobytes()], pa.binary())], names=["shard", "bits"])

    top = F.shiftrightunsigned("h", 56)
    parts = hashes.repartition(64, top).mapInArrow(run, "shard long, bits binary")
    out = np.zeros((SHARDS, bits // SHARDS // 8), np.uint8)
    for row in parts.collect():  # at most SHARDS rows of bits / SHARDS bits
        out[row["shard"]] |= np.frombuffer(row["bits"], np.uint8)
    return out


def hits(h: np.ndarray, filled: np.ndarray, bits: int) -> np.ndarray:
    """Which of the hashes may be in the filter."""
    shard, places = _slots(h, bits)
    flat = filled.reshape(-1)
    base = shard * (bits // SHARDS // 8)
    hit = np.ones(len(h), bool)
    for at in places:
        hit &= (flat[base + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 == 1
    return hit
