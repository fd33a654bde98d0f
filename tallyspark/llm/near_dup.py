"""MinHash near-dedup with sequential Bayesian verification.

Two documents are linked if their sets of word shingles have a Jaccard
similarity of at least ``percent`` / 100; a component is what links reach.

1. Documents with equal sets form a class (found by a 128-bit digest); from
   here on one row stands for a class, so copies cost nothing.
2. Each class gets ``bands * rows`` MinHash values.  Classes that agree in a
   whole band are candidates.  With the defaults a pair at the threshold
   shares no band with a probability of 3e-6.
3. Candidates are compared batch by batch: after each batch of values the
   posterior probability (uniform prior) that the similarity reaches the
   threshold is bounded, and the pair is dropped once it falls below
   ``miss``.  Pairs that last are verified exactly on their full sets.
4. First each member of a band's bucket meets only the bucket's smallest
   class, so a group of m copies costs m comparisons.  Links give components.
   Then, only in buckets whose members still lie in several components, the
   members outside the largest one meet the members of other components.
   Such buckets are dealt in blocks of bounded size; nothing is left out, and
   pairs that are already connected are not looked at again.

Components come from alternating large-star / small-star steps on the edges,
each step fixed in the checkpoint folder.  Nothing is collected.

Defined results: a text without words (null, empty, blank) has an empty set,
is linked with nothing and is its own component; a text with fewer words than
a shingle is one shingle; repeated rows have equal sets and so one component;
the component id is the smallest document id in it (null if all are null);
empty tables give empty tables; whole texts of any length; extra columns pass
through ``representatives`` and a clash with an internal name is no matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import RollingHash, binary_column, column_slices, shingle_set, space_words
from .filters import bit_filter, hits
from .tables import fixed, free_shuffles, numbered, renamed, row_key

BANDS = 42
ROWS = 6
MISS = 1e-5
BATCH = 42
BLOCK_ROWS = 2048
BLOCK_BYTES = 64 << 20
SET_FILTER_BITS = 1 << 26


def least_matches(values: int, batch: int, threshold: float, miss: float) -> list[tuple[int, int]]:
    """After so many compared values, at least so many must match.

    With a uniform prior the posterior after m matches in n is Beta(m + 1,
    n - m + 1), whose mass above t is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(batch, values + 1, batch):
        mass, m = 0.0, -1
        while mass < miss and m < n:
            m += 1
            mass += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


class Plan:
    """The parameters of a run; travels to the tasks."""

    def __init__(self, shingle: int, percent: int, bands: int = BANDS, rows: int = ROWS,
                 miss: float = MISS):
        self.shingle, self.percent, self.bands, self.rows = shingle, percent, bands, rows
        self.values = bands * rows
        self.steps = least_matches(self.values, BATCH, percent / 100, miss)

    def multipliers(self) -> np.ndarray:
        return np.random.default_rng(7).integers(1, 1 << 63, self.values, dtype=np.uint64) | np.uint64(1)

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= self.percent * (len(a) + len(b) - both)

    def lasting(self, sig: np.ndarray, sizes: np.ndarray, one: np.ndarray, size: int) -> np.ndarray:
        """Rows of ``sig`` that may still be linked with ``one``."""
        low, high = np.minimum(sizes, size), np.maximum(sizes, size)
        at = np.flatnonzero(100 * low >= self.percent * high)
        matches, done = np.zeros(len(at), np.int32), 0
        for n, least in self.steps:
            if not len(at):
                break
            matches = matches + (sig[at, done:n] == one[done:n]).sum(1)
            keep = matches >= least
            at, matches, done = at[keep], matches[keep], n
        return at


def minhash(values: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    out = np.full(len(multipliers), np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(values), 2048):  # a long text in pieces
        part = (values[k:k + 2048, None] * multipliers[None, :]) >> np.uint64(32)
        np.minimum(out, part.min(0).astype(np.uint32), out=out)
    return out


def _digest(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())


def signatures(docs: DataFrame, plan: Plan, id_col: str, text_col: str) -> DataFrame:
    """Per document: ``_id``, ``_th`` (``row_key``), ``id``, ``n`` (set size),
    ``set_key`` (digest; null without words), ``keys`` (band hashes) and
    ``sig`` (the low 16 bits of the MinHash values)."""
    rows = docs.select(*row_key(id_col, text_col), F.col(id_col).cast("long").alias("id"),
                       F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, multipliers = RollingHash(plan.shingle), plan.multipliers()
        for whole in batches:
            for batch in column_slices(whole, "text"):
                n, set_key, keys, sig = [], [], [], []
                for text in binary_column(batch, "text"):
                    values = shingle_set(space_words(text, lower=True), rolling)
                    n.append(len(values))
                    if not len(values):
                        set_key.append(None), keys.append(None), sig.append(None)
                        continue
                    mins = minhash(values, multipliers)
                    set_key.append(_digest(values))
                    keys.append([xxhash.xxh3_64_intdigest(band.tobytes(), seed=k) - (1 << 63)
                                 for k, band in enumerate(mins.reshape(plan.bands, plan.rows))])
                    sig.append(mins.astype(np.uint16).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in ("_id", "_th", "id")]
                    + [pa.array(n, pa.int32()), pa.array(set_key, pa.binary()),
                       pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                    names=["_id", "_th", "id", "n", "set_key", "keys", "sig"])

    return rows.mapInArrow(run, "_id long, _th long, id long, n int, set_key binary, "
                                "keys array<long>, sig binary")


def _sets(docs: DataFrame, wanted: DataFrame, plan: Plan, id_col: str, text_col: str) -> DataFrame:
    """``node``, ``values`` (the sorted set as bytes) for ``wanted``'s rows
    (``node``, ``_id``, ``_th`` of one document of the class).  A bit filter
    keeps most other texts out of the join's shuffle."""
    wanted = fixed(wanted)
    shared = docs.sparkSession.sparkContext.broadcast(
        bit_filter(wanted.select(F.col("_th").alias("h")), SET_FILTER_BITS))
    rows = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, filled = RollingHash(plan.shingle), shared.value
        for whole in batches:
            for batch in column_slices(whole, "text"):
                th = np.asarray(batch.column("_th")).view(np.uint64)
                batch = batch.filter(pa.array(hits(th, filled, SET_FILTER_BITS)))
                values = [shingle_set(space_words(t, lower=True), rolling).tobytes()
                          for t in binary_column(batch, "text")]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id"), batch.column("_th"), pa.array(values, pa.binary())],
                    names=["_id", "_th", "values"])

    # Repeated rows give the same set again.
    sets = rows.mapInArrow(run, "_id long, _th long, values binary")
    return sets.join(wanted, ["_id", "_th"]).groupBy("node").agg(F.first("values").alias("values"))


def _pairs_map(pairs: DataFrame, test: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                good = pa.array(test(part), pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [part.column(c).filter(good) for c in ("a", "b")], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def _with_both(pairs: DataFrame, facts: DataFrame, cols: list[str]) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(facts.select(F.col("node").alias(side),
                                        *[F.col(c).alias(f"{c}_{side}") for c in cols]), side)
    return pairs


def _bytes_matrix(column: list[bytes], dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype).reshape(len(column), -1)


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``comp``: the smallest node each node of ``edges`` (``a``,
    ``b``) reaches, by alternating large-star and small-star steps."""
    edges = fixed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                  .where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")),
            F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = fixed(small.where("u <> v").distinct())
        after = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before or after[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        before = after


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, plan: Plan,
              id_col: str, text_col: str) -> DataFrame:
    """The candidate pairs that pass the Bayesian test and the exact one."""

    def bayes(part: pa.RecordBatch) -> np.ndarray:
        a, b = (_bytes_matrix(part.column(f"sig_{s}").to_pylist(), np.uint16) for s in "ab")
        na, nb = (np.asarray(part.column(f"n_{s}")) for s in "ab")
        good = 100 * np.minimum(na, nb).astype(np.int64) >= plan.percent * np.maximum(na, nb).astype(np.int64)
        matches, done = np.zeros(len(good), np.int32), 0
        for n, least in plan.steps:
            at = np.flatnonzero(good)
            matches[at] += (a[at, done:n] == b[at, done:n]).sum(1)
            good[at] &= matches[at] >= least
            done = n
        return good

    def exact(part: pa.RecordBatch) -> np.ndarray:
        sides = [part.column(f"values_{s}").to_pylist() for s in "ab"]
        return np.array([plan.linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))
                         for x, y in zip(*sides)], bool)

    lasting = fixed(_pairs_map(_with_both(pairs, classes, ["n", "sig"]), bayes))
    nodes = lasting.select(F.col("a").alias("node")).union(lasting.select("b")).distinct()
    wanted = classes.select("node", "_id", "_th").join(nodes, "node", "left_semi")
    sets = _sets(docs, wanted, plan, id_col, text_col)
    return _pairs_map(_with_both(lasting, sets, ["values"]), exact)


def dealt_members(rows: DataFrame) -> DataFrame:
    """The members (``key``, ``node``, ``comp``, ``n``) of buckets of several
    components, dealt to blocks of bounded size: every member has one home;
    those outside the bucket's largest component go to every block besides,
    so m members with k outsiders make m + k * (blocks - 1) rows."""
    parts = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"),
                                            F.sum(F.col("n").cast("long") * 8).alias("bytes"))
    mixed = parts.groupBy("key").agg(
        F.count(F.lit(1)).alias("comps"), F.max(F.struct("m", "comp")).alias("top"),
        F.sum("m").alias("m"), F.sum("bytes").alias("bytes")).where("comps > 1").select(
        "key", F.col("top.comp").alias("top"),
        F.ceil(F.greatest(F.col("m") / BLOCK_ROWS, F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    held = rows.join(mixed, "key").withColumn("outside", F.col("comp") != F.col("top")).withColumn(
        "mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    to = F.when(F.col("outside"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("mine"))
    return held.withColumn("block", F.explode(to)).select(
        "key", "node", "comp", "outside", "block", (F.col("block") == F.col("mine")).alias("home"))


def _cross_links(members: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame,
                 plan: Plan, id_col: str, text_col: str) -> DataFrame:
    """Links between components inside one bucket (see step 4)."""
    rows = members.where("m > 2").join(labels, "node", "left").select(
        "key", "node", F.coalesce("comp", "node").alias("comp"))
    rows = fixed(dealt_members(rows.join(classes.select("node", "n"), "node")))
    nodes = rows.select("node").distinct()
    wanted = classes.select("node", "_id", "_th").join(nodes, "node", "left_semi")
    facts = classes.select("node", "sig", "keys").join(
        _sets(docs, wanted, plan, id_col, text_col), "node")
    dealt = rows.join(facts, "node")

    def block(table: pa.Table) -> pa.Table:
        nodes, comps, outside, home = (np.asarray(table.column(c)) for c in ("node", "comp", "outside", "home"))
        sig = _bytes_matrix(table.column("sig").to_pylist(), np.uint16)
        bands, key = np.array(table.column("keys").to_pylist(), np.int64), table.column("key")[0].as_py()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("values").to_pylist()]
        sizes = np.array([len(s) for s in sets], np.int64)
        found = {c: c for c in comps.tolist()}

        def root(c: int) -> int:
            while found[c] != c:
                found[c] = c = found[found[c]]
            return c

        links = []
        for x in np.flatnonzero(outside).tolist():
            # Every outsider meets the members that are at home here; two
            # outsiders meet at the home of the later one, and a pair meets in
            # the first of the buckets that it shares.
            there = np.flatnonzero(home & (comps != comps[x]) & (~outside | (nodes > nodes[x])))
            same = bands[there] == bands[x]
            there = there[bands[x][same.argmax(1)] == key] if len(there) else there
            for y in there[plan.lasting(sig[there], sizes[there], sig[x], sizes[x])].tolist():
                a, b = root(int(comps[x])), root(int(comps[y]))
                if a != b and plan.linked(sets[x], sets[y]):
                    found[max(a, b)] = min(a, b)
                    links.append((int(nodes[x]), int(nodes[y])))
        return pa.table({"a": pa.array([p[0] for p in links], pa.int64()),
                         "b": pa.array([p[1] for p in links], pa.int64())})

    return dealt.groupBy("key", "block").applyInArrow(block, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text", bands: int = BANDS, rows: int = ROWS,
                    miss: float = MISS) -> DataFrame:
    """Per row of ``docs``: ``_id``, ``_th`` (``row_key``), ``id``, ``n_shingles``,
    ``component_id``, and ``first`` (it is the row of its component that has
    the smallest id; among equal ids the one class chosen)."""
    plan = Plan(shingle, percent, bands, rows, miss)
    signed = fixed(signatures(docs, plan, id_col, text_col))
    best = F.struct(F.col("id").isNull().alias("z"), "id", "_id", "_th")
    classes = fixed(signed.where("set_key IS NOT NULL").groupBy("set_key").agg(
        F.min(best).alias("doc"), F.first("n").alias("n"), F.first("keys").alias("keys"),
        F.first("sig").alias("sig")).select(
        F.monotonically_increasing_id().alias("node"), "set_key", "doc.id", "doc._id", "doc._th",
        "n", "keys", "sig"))
    # From here on only the classes carry signatures.
    signed = fixed(signed.select("_id", "_th", "id", F.col("n").cast("long").alias("n_shingles"), "set_key"))
    free_shuffles(docs.sparkSession)
    banded = classes.select("node", F.explode("keys").alias("key"))
    buckets = fixed(banded.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("first"))
                    .where("m > 1"))
    members = fixed(banded.join(buckets, "key"))
    stars = members.where("node <> first").select(
        F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    links = fixed(_verified(stars, classes, docs, plan, id_col, text_col))
    free_shuffles(docs.sparkSession)
    labels = components(links)
    more = fixed(_cross_links(members, labels, classes, docs, plan, id_col, text_col))
    free_shuffles(docs.sparkSession)
    labels = components(links.union(more))

    named = classes.join(labels, "node", "left").select(
        "set_key", "id", "_id", "_th", F.coalesce("comp", "node").alias("comp"))
    best = F.struct(F.col("id").isNull().alias("z"), "id", "_id", "_th")
    chosen = named.groupBy("comp").agg(F.min(best).alias("best"))
    named = named.join(chosen, "comp").select("set_key", F.col("best.id").alias("component_id"),
                                              F.col("best._th").alias("best_th"))
    return (signed.join(named, "set_key", "left")
            .select("_id", "_th", "id", "n_shingles",
                    F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component_id"))
                    .alias("component_id"),
                    ((F.col("n_shingles") == 0)
                     | F.col("component_id").eqNullSafe(F.col("id")) & (F.col("best_th") == F.col("_th")))
                    .alias("first")))


def representatives(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text", **kwargs) -> DataFrame:
    """``docs`` with one row of each component (rows without words all stay;
    of repeated equal rows one stays)."""
    columns = docs.columns
    docs, new = numbered(docs)
    id_col, text_col = new(id_col), new(text_col)
    found = near_duplicates(docs, shingle, percent, id_col, text_col, **kwargs)
    keep = found.where("first").select("_id", "_th").distinct()
    keyed = docs.withColumns(dict(zip(("_id", "_th"), row_key(id_col, text_col))))
    kept = keyed.join(keep, ["_id", "_th"], "left_semi")
    words = F.coalesce(F.col(text_col), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    # Only rows that repeat id and text are still several; rows without words
    # are linked with nothing and get a number of their own.
    spread = F.when(words, F.lit(0)).otherwise(F.monotonically_increasing_id())
    kept = kept.withColumn("_n", spread).dropDuplicates(["_id", "_th", "_n"])
    return kept.select(renamed(kept, columns, new))
