"""Relational building blocks: SQL's NULL rules made explicit, and a
skew-tolerant keyed join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS_CONF = "tallyspark.skew.salts"
DEFAULT_SALTS = 8
#: Values that the rows of hot keys are dealt by in a ``lookup_join``: many more than tasks.
SEATS = 1 << 16
ENTRY_NUMBER = "ac_entry_sr_no"


def salts_of(df: DataFrame) -> int:
    """Number of salts for keyed joins: session setting ``tallyspark.skew.salts``."""
    return int(df.sparkSession.conf.get(SALTS_CONF, str(DEFAULT_SALTS)))


def salted_join(big: DataFrame, keyed: DataFrame, on: list[str], how: str = "inner",
                salts: int | None = None, reduce_keyed: bool = False,
                reduce_by: DataFrame | None = None,
                spread: list[str] | None = None, hot: DataFrame | None = None) -> DataFrame:
    """``big.join(keyed, on, how)`` that survives a hot key.

    ``hot`` is the ``hot_key`` side table of the rows' days: the keys that the
    ingest has counted very many entries for, of the kind named like the first
    of ``on``.  Only their rows are spread and only their ``keyed`` rows are
    replicated; every other key is joined once, as in a plain join.  Which keys
    ``hot`` names changes no result.  It holds a bounded number of keys a day,
    so it is broadcast.  A NULL key matches nothing, so its rows are spread
    without a counterpart.

    Without such counts (``hot`` is None) every key is spread: ``keyed`` is
    the small side -- in this library always an aggregate with one row per
    key.  Each of its rows is replicated once per salt value,
    and every ``big`` row carries one salt computed from a hash of its
    own columns, so the rows of a key that holds a third of the data are spread over
    ``salts`` reducers instead of one.  Every ``big`` row still meets every
    ``keyed`` row of its key exactly once, so inner, left, semi and anti
    joins give exactly the unsalted result.  The salt is a hash, not a
    random number: a retried task after an executor loss reproduces the
    same partitioning.  When AQE measures the replicated side as small it
    broadcasts it and the salt costs nothing.

    ``reduce_keyed`` first cuts ``keyed`` down to the keys that occur in
    ``big`` (a semi join against ``big``'s de-duplicated keys, which cannot
    be skewed): used when ``keyed`` spans all history and is larger than the
    rows it filters, so that only the relevant keys are replicated.
    ``reduce_by`` names a cheaper relation whose keys are a superset of
    ``big``'s (e.g. the raw scan ``big`` was filtered from), so the keys are
    not taken from ``big``'s whole lineage.  A semi or anti join needs each
    key once: repeats are removed after that cut, on the few keys left.

    ``spread`` names the columns whose hash is the salt.  They should tell the
    rows of one key apart and be read anyway, so that the salt adds no column
    to the scan; by default the entry number, or the whole row without one.
    """
    n = salts or salts_of(big)
    if hot is not None:
        if how in ("left_semi", "left_anti"):
            keyed = keyed.select(*on).distinct()
        if n <= 1:
            return big.join(keyed, on, how)
        left, right = split_sides(big, keyed, on[0], n, spread, hot)
        return left.join(right, [*on, "_salt"], how).drop("_salt")
    if reduce_keyed or reduce_by is not None:
        source = big if reduce_by is None else reduce_by
        keyed = keyed.join(source.select(*on).distinct(), on, "left_semi")
    if how in ("left_semi", "left_anti"):
        keyed = keyed.select(*on).distinct()
    if n <= 1:
        return big.join(keyed, on, how)
    salted_big = big.withColumn("_salt", _salt(big, spread, n))
    salted_keyed = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return salted_big.join(salted_keyed, [*on, "_salt"], how).drop("_salt")


def _salt(df: DataFrame, spread: list[str] | None, n: int) -> Column:
    default = [ENTRY_NUMBER] if ENTRY_NUMBER in df.columns else df.columns
    return F.pmod(F.xxhash64(*(spread or default)), F.lit(n)).cast("int")


def split_sides(big: DataFrame, keyed: DataFrame, by: str, n: int, spread: list[str] | None,
                hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``_salt``: hot keys have ``n`` of them, others 0."""
    picked = F.broadcast(hot.where(F.col("kind") == by).select(F.col("key").alias(by)).distinct()
                         .withColumn("_hot", F.lit(True)))
    salt, none = _salt(big, spread, n), F.lit(0)
    apart = F.col("_hot") | F.col(by).isNull()
    left = big.join(picked, by, "left").withColumn("_salt", F.when(apart, salt).otherwise(none)).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(none, F.lit(n - 1))).otherwise(F.array(none))
    return left, keyed.join(picked, by, "left").withColumn("_salt", F.explode(copies)).drop("_hot")


def lookup_join(big: DataFrame, lookup: DataFrame, few: DataFrame, on: str,
                spread: list[str]) -> DataFrame:
    """``big.join(lookup, on, "left")`` for a lookup with hot keys, whatever
    share of ``big`` they hold.

    ``few`` has for each hot key its rows of ``lookup`` (one of NULLs where it
    has none); they are broadcast.  The rows of hot keys (and of NULL) go
    through the shuffle of the others without a key, dealt evenly over all
    tasks by the columns ``spread``, so none of them grows with a key.  Which
    keys are hot changes no result.  The columns of ``few`` come out with
    ``_hot_`` in front, those of ``lookup`` are NULL for hot keys; ``_hot`` tells
    these rows, ``_key`` is the key of all others.
    """
    values = [c for c in lookup.columns if c != on]
    known = few.select(on, F.lit(True).alias("_hot"), *(F.col(c).alias(f"_hot_{c}") for c in values))
    met = big.join(F.broadcast(known), on, "left")
    cold = F.col("_hot").isNull() & F.col(on).isNotNull()
    met = met.withColumns({"_key": F.when(cold, F.col(on)),
                           "_at": F.when(cold, _salt(big, [on], SEATS)).otherwise(_salt(big, spread, SEATS))})
    keyed = lookup.select(F.col(on).alias("_key"), _salt(lookup, [on], SEATS).alias("_at"), *values)
    return met.join(keyed, ["_key", "_at"], "left").drop("_at")


def not_in(rows: DataFrame, col: str, values: DataFrame, value_col: str) -> DataFrame:
    """``rows WHERE col NOT IN (SELECT value_col FROM values)``.

    Null-aware, as in SQL: a NULL among the values empties the result, and a
    row whose ``col`` is NULL survives only when ``values`` is empty.  The
    two facts come from one scalar aggregate over ``values``; the removal is
    an ordinary anti equi-join on de-duplicated values, so it can run as a
    shuffle join when the value set is large (Spark's own null-aware anti
    join is always a broadcast).
    """
    v = values.select(F.col(value_col).alias(col))
    stats = v.agg(F.struct(F.count(F.lit(1)).alias("n"),
                           F.count_if(F.col(col).isNull()).alias("n_null")).alias("s")).scalar()
    guarded = rows.where((stats["n_null"] == 0) & (F.col(col).isNotNull() | (stats["n"] == 0)))
    return guarded.join(v.where(F.col(col).isNotNull()).distinct(), col, "left_anti")
