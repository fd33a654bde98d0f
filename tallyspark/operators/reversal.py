"""Reversal removal: three scopes, kept apart on purpose.

All three look for reversal rows over the *whole* ledger history, not only
the report window: a reversal may be posted on a later day than the
original.  ``reversals`` is therefore the ``reversal_entry`` side table (the
REVR rows of all history, see ``sources.derived``) -- or the ledger itself,
which gives the same result at the cost of a full scan.  Each scope builds
the set of reversed keys with map-side de-duplication, cuts it down to the
keys present in the rows, and removes matches with a salted ``left_anti``
equi-join on the reference: a shuffle join when the set is large, a
broadcast when AQE measures it small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark import fixed
from tallyspark.operators.relational import salted_join


def reversed_refs(reversals: DataFrame, scope: str = "ref") -> DataFrame:
    """Keys of reversed transactions.

    ``ref``       every ``REVR`` row, key ``trn_ref_no``
    ``customer``  customer-side ``REVR`` rows only, key ``trn_ref_no``
    ``ref_code``  authorised ``REVR`` rows, key ``(trn_ref_no, trn_code)``
    """
    rev = reversals.where(F.col("event") == fixed.REVERSAL_EVENT)
    if scope == "ref":
        return rev.select("trn_ref_no")
    if scope == "customer":
        return rev.where(F.col("cust_gl") == fixed.CUSTOMER_LEG).select("trn_ref_no")
    if scope == "ref_code":
        return rev.where(F.col("auth_stat") == fixed.AUTHORISED).select("trn_ref_no", "trn_code")
    raise ValueError(f"unknown reversal scope {scope!r}")


def exclude_reversed(rows: DataFrame, reversals: DataFrame, scope: str = "ref",
                     candidates: DataFrame | None = None, hot: DataFrame | None = None,
                     counts: DataFrame | None = None) -> DataFrame:
    """Drop rows of reversed transactions.

    ``ref`` (C1a) is ``trn_ref_no NOT IN (reversed refs)`` with SQL's
    null-aware meaning: one NULL reference among the reversals empties the
    result, and a row with a NULL reference survives only when there are no
    reversals at all.  Both facts come from one scalar aggregate over the
    reversal rows, evaluated once; the anti join itself stays an equi-join.

    ``customer`` (C1b) also drops the row's own ``REVR`` events and uses
    NOT EXISTS, under which a NULL reference never matches and is kept.

    ``ref_code`` (C1c) is NOT EXISTS on ``(trn_ref_no, trn_code)``.

    ``candidates`` (optional) is a cheap relation holding at least the keys
    of ``rows`` -- typically the raw window scan -- used to cut the reversal
    keys down before the salted join (default: ``rows`` itself).  With ``hot``
    (the ``hot_key`` side table) only hot references are salted, and nothing
    needs to be cut down.  ``counts`` is the ``reversal_count`` side table: the
    facts of the NULL rule without another read of the reversals.
    """
    keys = reversed_refs(reversals, scope)
    if scope == "ref":
        if counts is None:
            counts = keys.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("trn_ref_no").isNull()).alias("n_null"))
        stats = counts.agg(F.struct(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "n_null"))).alias("s")).scalar()
        guarded = rows.where((stats["n_null"] == 0)
                             & (F.col("trn_ref_no").isNotNull() | (stats["n"] == 0)))
        return salted_join(guarded, keys, ["trn_ref_no"], "left_anti",
                           reduce_keyed=True, reduce_by=candidates, hot=hot)
    if scope == "customer":
        kept = rows.where(~F.col("event").isin(fixed.REVERSAL_EVENT))
        return salted_join(kept, keys, ["trn_ref_no"], "left_anti",
                           reduce_keyed=True, reduce_by=candidates, hot=hot)
    return salted_join(rows, keys, ["trn_ref_no", "trn_code"], "left_anti",
                       reduce_keyed=True, reduce_by=candidates, hot=hot)
