"""Ledger-entry operators: filters, cash legs, GL codes and payment mode.

Covers C2 (cash/transfer mode), C3 (cash legs), C4a/C4b (tenor-qualified
GL codes), C14 (amount in currency units) and C25 (postable entries).
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark import fixed
from tallyspark.functions.oracle import oracle_concat
from tallyspark.operators.relational import lookup_join, salted_join


def in_window(ledger: DataFrame, date_from: date, date_to: date | None = None) -> DataFrame:
    """Entries posted in ``[date_from, date_to]`` (one day when ``date_to`` is
    omitted).  On a day-partitioned ledger this prunes partitions."""
    d = F.col("trn_dt")
    if date_to is None:
        return ledger.where(d == F.lit(date_from))
    return ledger.where(d.between(F.lit(date_from), F.lit(date_to)))


def postable(ledger: DataFrame) -> DataFrame:
    """Authorised movement only (SQL three-valued logic kept: a NULL in
    any tested column drops the row)."""
    code, ac = F.col("trn_code"), F.col("ac_no")
    return ledger.where(
        (F.col("auth_stat") == fixed.AUTHORISED)
        & ~code.isin(fixed.MIGRATION_CODE)
        & ~((ac == fixed.INTERBANK_GL) & code.isin(fixed.SWEEP_CODE))
        & ~F.col("event").isin(fixed.REVERSAL_EVENT, fixed.YEAR_END_EVENT))


def cash_legs(ledger: DataFrame, gl_master: DataFrame) -> DataFrame:
    """Entries posted on a cash GL (``type = '5'``), sweeps removed.

    ``gl_master`` is a dimension (one row per GL code); only its cash codes
    are joined, so the build side is a handful of rows.
    """
    cash_gls = gl_master.where(F.col("type") == fixed.CASH_GL_TYPE).select(
        F.col("gl_code").alias("ac_no"))
    return (ledger.where(~F.col("trn_code").isin(fixed.SWEEP_CODE))
            .join(cash_gls, "ac_no"))


def unit_amount(ccy="ac_ccy", lcy="lcy_amount", fcy="fcy_amount",
                base: str = fixed.BASE_CCY) -> Column:
    """C14: the amount in the account's own currency: local amount for the
    base currency, foreign amount otherwise (a NULL currency takes fcy)."""
    return F.when(F.col(ccy) == base, F.col(lcy)).otherwise(F.col(fcy))


# ---------------------------------------------------------------- GL codes
#: Columns that tell the entries of one account apart.
ENTRY_COLUMNS = ("trn_ref_no", "ac_entry_sr_no", "lcy_amount")


def tenor_gl_bucket(gl="gl_code", days="orig_tenor_days") -> Column:
    """The turnover report's GL code.

    ``21050010001`` is bucketed (<= 40 days -> 30, (40, 60] -> 60); that GL and
    the three fixed-deposit GLs otherwise carry the raw day count, and a
    missing count gives an empty suffix, e.g. ``21030010001()``.
    """
    g, d = F.col(gl), F.col(days)
    return (F.when((g == fixed.BUCKETED_DEPOSIT_GL) & (d <= 40), F.concat(g, F.lit("(30)")))
             .when((g == fixed.BUCKETED_DEPOSIT_GL) & (d > 40) & (d <= 60),
                   F.concat(g, F.lit("(60)")))
             .when(g.isin(*fixed.TENOR_GLS), oracle_concat(g, F.lit("("), d, F.lit(")")))
             .otherwise(g))


def tenor_gl_first(cust_gl="cust_gl", natural="ac_natural_gl", ac_no="ac_no",
                   days="orig_tenor_days", months="orig_tenor_months",
                   years="orig_tenor_years") -> Column:
    """The liquidity report's GL code.

    Customer legs on a fixed-deposit GL get the first non-NULL of days,
    months, years as suffix (the unit is not shown, so 12 days and 12 months
    collide); other customer legs map to their natural GL, GL legs keep their
    own account, anything else is NULL.
    """
    cust = F.col(cust_gl) == fixed.CUSTOMER_LEG
    nat = F.col(natural)
    fd = cust & nat.isin(*fixed.FIXED_DEPOSIT_GLS)

    def suffix(c):
        return oracle_concat(nat, F.lit("("), F.col(c), F.lit(")"))

    return (F.when(fd & F.col(days).isNotNull(), suffix(days))
             .when(fd & F.col(months).isNotNull(), suffix(months))
             .when(fd & F.col(years).isNotNull(), suffix(years))
             .when(cust, nat)
             .when(F.col(cust_gl) == fixed.GL_LEG, F.col(ac_no)))


def with_natural_gl(ledger: DataFrame, account_gl_map: DataFrame,
                    deposit_term: DataFrame, hot: DataFrame | None = None,
                    gl_codes: DataFrame | None = None) -> DataFrame:
    """Add ``gl_code = nvl(natural GL, ac_no)`` and the deposit's tenor days.

    Both lookups are left joins on the account number, so an entry without
    a mapping keeps its own account as GL code.  They are put together by
    account first, so the ledger is joined once.  Every contra leg sits on one
    of a few GL accounts, half the ledger on a handful of keys: ``gl_codes``
    (column ``gl_code``, a chart of accounts) and ``hot`` name the accounts
    whose entries are looked up in a broadcast and dealt evenly
    (``lookup_join``).  Without either the lookup is cut down to the accounts
    in hand and salted as a whole.
    """
    m = account_gl_map.select(F.col("ac_gl_no").alias("ac_no"), "ac_natural_gl")
    t = deposit_term.select(F.col("acc").alias("ac_no"), "orig_tenor_days")
    lookup = m.join(t, "ac_no", "full")
    named = [] if hot is None else [hot.where(F.col("kind") == "ac_no").select(F.col("key").alias("ac_no"))]
    named += [] if gl_codes is None else [gl_codes.select(F.col("gl_code").alias("ac_no"))]
    if not named:
        joined = salted_join(ledger, lookup, ["ac_no"], "left", reduce_keyed=True)
        return joined.withColumn("gl_code", F.coalesce("ac_natural_gl", "ac_no")).drop("ac_natural_gl")
    keys = F.broadcast(reduce(DataFrame.unionByName, named).where(F.col("ac_no").isNotNull()).distinct())
    few = (keys.join(m.join(keys, "ac_no", "left_semi"), "ac_no", "left")
           .join(t.join(keys, "ac_no", "left_semi"), "ac_no", "left"))
    spread = [c for c in ENTRY_COLUMNS if c in ledger.columns] or ledger.columns
    joined = lookup_join(ledger, lookup, few, "ac_no", spread)
    hot_gl = F.when(F.col("_hot"), F.coalesce("_hot_ac_natural_gl", "ac_no"))
    return joined.withColumns({
        "gl_code": F.coalesce(hot_gl, "ac_natural_gl", "_key"),
        "orig_tenor_days": F.coalesce("_hot_orig_tenor_days", "orig_tenor_days"),
    }).select(*ledger.columns, "orig_tenor_days", "gl_code")


# ------------------------------------------------------------ payment mode
MODE_KEYS = ("trn_ref_no", "lcy_amount", "ac_ccy", "ac_branch")
#: Columns that tell the entries of one such key apart.
MODE_SPREAD = ("gl_code", "drcr_ind", "fcy_amount", "ac_entry_sr_no")


def _modes(own_cash: Column, has_cash: Column) -> Column:
    """The modes of an entry: it may be cash by itself and transfer at once."""
    return F.array_compact(F.array(F.when(own_cash | has_cash, F.lit("cash")), F.when(~has_cash, F.lit("transfer"))))


def _mode_keys_known() -> Column:
    known = F.lit(True)
    for k in MODE_KEYS:
        known = known & F.col(k).isNotNull()
    return known


def _own_cash(type_col: str) -> Column:
    return F.coalesce(F.col(type_col) == fixed.CASH_GL_TYPE, F.lit(False))


def net_by_mode(ds: DataFrame, type_col: str = "type", run: tuple[str, ...] = ()) -> DataFrame:
    """The entries' sums per (``gl_code``, ``ac_ccy``, ``drcr_ind``,
    ``trn_mode``): what summing the rows of ``classify_mode`` gives, without
    the rows and without a join of the day with itself.  ``run`` names columns
    that tell the entries of several runs apart (never NULL); each run is
    netted by itself.

    The entries are first summed per transaction key, GL code and side, map
    side too, so a key that holds a third of the day comes down to a row for
    each GL code.  One exchange by the key then tells which of these sums have
    a cash leg beside them.
    """
    own = _own_cash(type_col)
    per = ds.groupBy(*run, *MODE_KEYS, "gl_code", "drcr_ind", own.alias("_cash")).agg(
        F.sum("lcy_amount").alias("_lcy"), F.sum("fcy_amount").alias("_fcy"))
    has = F.max(F.col("_cash") & _mode_keys_known()).over(Window.partitionBy(*run, *MODE_KEYS))
    moded = per.withColumn("_has", has).withColumn("trn_mode", F.explode(_modes(F.col("_cash"), F.col("_has"))))
    return moded.groupBy(*run, "gl_code", "ac_ccy", "drcr_ind", "trn_mode").agg(
        F.sum("_lcy").alias("lcy_amount"), F.sum("_fcy").alias("fcy_amount"))


def classify_mode(ds: DataFrame, type_col: str = "type") -> DataFrame:
    """Tag each entry ``cash`` or ``transfer``.

    An entry is cash when it sits on a cash GL itself or when an entry of the
    same transaction, amount, currency and branch does; otherwise transfer.
    With any of those four keys NULL, the match can never succeed, so the
    entry is transfer, and if it is itself on a cash GL it is emitted as cash
    too (the two report branches are independent).

    Plan: the keys that have a cash leg are found with a de-duplicating
    aggregate (map-side combine, so a hot key costs one row per task) and
    attached with a many-to-one left join (salted, so a hot transaction key
    is spread over several reducers) -- no self-join that pairs every entry
    with every other entry of its group.  Rows that need two modes are
    emitted by one ``explode`` over a one- or two-element array.
    """
    keys, own_cash = list(MODE_KEYS), _own_cash(type_col)
    with_cash = (ds.where(own_cash & _mode_keys_known()).select(*keys).distinct()
                 .withColumn("_has_cash", F.lit(True)))
    tagged = salted_join(ds, with_cash, keys, "left", spread=[c for c in MODE_SPREAD if c in ds.columns])
    has = F.coalesce(F.col("_has_cash"), F.lit(False))
    return tagged.withColumn("trn_mode", F.explode(_modes(own_cash, has))).drop("_has_cash")
