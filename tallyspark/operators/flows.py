"""Aggregated money flows: turnover (C16), deposit flows (C15), net
position (C20).

All three end in a small group-by (GL code or currency), so the heavy part
is the per-entry work before it.  Wherever a join only multiplies rows
(fan-out that the reports count on purpose), the right side is first
aggregated to one row per key with a multiplicity, and the measures are
weighted -- identical sums, but the join is many-to-one and cannot explode
on a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark import fixed
from tallyspark.functions.oracle import MONEY
from tallyspark.operators.ledger import tenor_gl_first
from tallyspark.operators.relational import salted_join


def _zero() -> Column:
    return F.lit(0).cast(MONEY)


def _sum0(cond: Column, value: Column) -> Column:
    """``sum(case when cond then value else 0 end)``."""
    return F.sum(F.when(cond, value).otherwise(_zero()))


# ------------------------------------------------------------------ C16
TURNOVER_COLUMNS = [
    f"{mode}{side}_{unit}"
    for unit in ("equivalentmmk", "currencyunit", "equivalentusd")
    for side in ("debit", "credit")
    for mode in ("cash", "transfer", "clear")
]


def turnover(moded: DataFrame, base: str = fixed.BASE_CCY) -> DataFrame:
    """GL debit/credit turnover by mode.

    Level 1 nets the entries per (gl, ccy, side, mode); level 2 classifies
    each net by its sign -- a negative net debit is reported as credit and
    vice versa -- so the two levels cannot be merged into one aggregate.
    Both levels are partial-aggregated before their shuffles.
    """
    return turnover_of_nets(moded.groupBy("gl_code", "ac_ccy", "drcr_ind", "trn_mode")
                            .agg(F.sum("lcy_amount").alias("lcy_amount"),
                                 F.sum("fcy_amount").alias("fcy_amount")), base)


def turnover_of_nets(net: DataFrame, base: str = fixed.BASE_CCY, run: tuple[str, ...] = ()) -> DataFrame:
    """The second level of C16, from the nets of the first (for each ``run``)."""
    drcr, mode, ccy = F.col("drcr_ind"), F.col("trn_mode"), F.col("ac_ccy")

    def is_debit(a):
        return ((drcr == fixed.DEBIT) & (a >= 0)) | ((drcr == fixed.CREDIT) & (a < 0))

    def is_credit(a):
        return ((drcr == fixed.CREDIT) & (a >= 0)) | ((drcr == fixed.DEBIT) & (a < 0))

    lcy, fcy = F.col("lcy_amount"), F.col("fcy_amount")
    foreign = ccy != base
    m = {}
    for side, test in (("debit", is_debit), ("credit", is_credit)):
        for md in ("cash", "transfer"):
            m[f"{md}{side}_equivalentmmk"] = _sum0((mode == md) & test(lcy), F.abs(lcy))
            m[f"{md}{side}_currencyunit"] = _sum0(foreign & (mode == md) & test(fcy), F.abs(fcy))
    aggs = [m[c].alias(c) for c in TURNOVER_COLUMNS if c in m]
    out = net.groupBy(*run, "gl_code", "ac_ccy").agg(*aggs)
    return out.select(*run, "gl_code", "ac_ccy",
                      *[(F.col(c) if c in m else _zero()).alias(c) for c in TURNOVER_COLUMNS])


# ------------------------------------------------------------------ C15
FLOW_COLUMNS = [
    f"deposit{d}{mode}_{unit}"
    for d in ("in", "out")
    for unit in ("equivalentmmk", "currencyunit")
    for mode in ("cash", "transfer", "clearing")
]


def deposit_flows(entries: DataFrame, cash: DataFrame, account_gl_map: DataFrame,
                  base: str = fixed.BASE_CCY, hot: DataFrame | None = None) -> DataFrame:
    """Customer deposits in/out by currency, split cash vs transfer.

    ``entries`` are the customer legs of the day; ``cash`` the cash legs
    (C3).  An entry is CASH when a cash leg has the same reference, branch,
    currency and amount, and counts once per such leg; an entry matching
    none is TRANSFER.  The unused account-map join of the report still
    multiplies entries by the number of map rows of their account.  ``hot``
    names the hot references and accounts of the day (``salted_join``).
    """
    keys = ["trn_ref_no", "ac_branch", "ac_ccy", "lcy_amount"]
    n_cash = cash.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n_cash"))
    n_map = (account_gl_map.groupBy(F.col("ac_gl_no").alias("ac_no"))
             .agg(F.count(F.lit(1)).alias("_n_map")))
    e = (salted_join(salted_join(entries, n_cash, keys, "left", hot=hot), n_map, ["ac_no"], "left", hot=hot)
         .withColumn("_w", F.coalesce("_n_cash", F.lit(1)) * F.coalesce("_n_map", F.lit(1)))
         .withColumn("_mode", F.when(F.col("_n_cash").isNotNull(), "CASH").otherwise("TRANSFER")))
    drcr, mode, w = F.col("drcr_ind"), F.col("_mode"), F.col("_w")
    foreign = F.col("ac_ccy") != base
    lcy, fcy = F.col("lcy_amount"), F.col("fcy_amount")
    m = {}
    for d, side in (("in", fixed.CREDIT), ("out", fixed.DEBIT)):
        for md, label in (("cash", "CASH"), ("transfer", "TRANSFER")):
            hit = (drcr == side) & (mode == label)
            m[f"deposit{d}{md}_equivalentmmk"] = _sum0(hit, lcy * w)
            m[f"deposit{d}{md}_currencyunit"] = _sum0(hit & foreign, fcy * w)
    out = e.groupBy("ac_ccy").agg(*[v.alias(k) for k, v in m.items()])
    return out.select(F.col("ac_ccy").alias("currency"),
                      *[(F.col(c) if c in m else _zero()).alias(c) for c in FLOW_COLUMNS])


# ------------------------------------------------------------------ C20
def _carriers(account_gl_map: DataFrame, deposit_term: DataFrame, codes) -> DataFrame:
    """(``cust_gl``, ``ac_no``, ``code``): the accounts that carry one of the
    codes -- customer accounts that map to it and, as GL legs, the codes
    themselves -- as often as the two dimensions repeat them."""
    acc = account_gl_map.select(F.col("ac_gl_no").alias("ac_no"), "ac_natural_gl")
    term = deposit_term.select(F.col("acc").alias("ac_no"), "orig_tenor_days", "orig_tenor_months",
                               "orig_tenor_years")
    known = acc.join(term, "ac_no", "left")
    customers = known.withColumn("cust_gl", F.lit(fixed.CUSTOMER_LEG)).withColumn("code", tenor_gl_first())
    own = account_gl_map.sparkSession.range(1).select(
        F.explode(F.array(*map(F.lit, sorted(set(codes))))).alias("ac_no"))
    legs = own.join(known, "ac_no", "left").withColumn("cust_gl", F.lit(fixed.GL_LEG)).withColumn(
        "code", F.col("ac_no"))
    keys = ["cust_gl", "ac_no", "code"]
    return customers.where(F.col("code").isin(*codes)).select(*keys).unionByName(legs.select(*keys))


def net_position(daily: DataFrame, account_gl_map: DataFrame, deposit_term: DataFrame,
                 codes=None, base: str = fixed.BASE_CCY) -> DataFrame:
    """C20: |credits - debits| per tenor-qualified GL code and currency.

    ``daily`` is the ``authorised_daily`` rollup (debit/credit sums per day,
    account, leg and currency) restricted to the days wanted, or a stored
    balance with the days since (then ``n_days`` counts the daily rows in each
    row, and what sums up to none is left out).  It is reduced per (account,
    leg, currency) -- combined map-side -- and only that result meets the
    account and deposit dimensions.  Summing partial sums is exact for
    decimals, and any fan-out of the account map multiplies a partial sum
    exactly as it would multiply each entry.  With ``codes``, one join with
    the accounts that carry one of them both cuts the rollup down and gives
    the code, so the rest is neither aggregated nor shuffled.
    """
    if codes is not None:
        carriers = _carriers(account_gl_map, deposit_term, codes)
        own = (F.col("cust_gl") == fixed.GL_LEG) & F.col("ac_no").isin(*codes)
        daily = daily.where(own | (F.col("cust_gl") == fixed.CUSTOMER_LEG)).join(
            carriers, ["cust_gl", "ac_no"], "left_semi")
    sums = [F.sum(c).alias(c) for c in ("d_lcy", "c_lcy", "d_fcy", "c_fcy", "n_days") if c in daily.columns]
    per_acct = daily.groupBy("ac_no", "cust_gl", "ac_ccy").agg(*sums)
    if "n_days" in daily.columns:
        per_acct = per_acct.where(F.col("n_days") != 0)
    if codes is not None:
        coded = per_acct.join(carriers, ["cust_gl", "ac_no"])
    else:
        acc = account_gl_map.select(F.col("ac_gl_no").alias("ac_no"), F.col("ac_gl_no").alias("_mapped"),
                                    "ac_natural_gl")
        term = deposit_term.select(F.col("acc").alias("_mapped"), "orig_tenor_days", "orig_tenor_months",
                                   "orig_tenor_years")
        # The term hangs on the mapped account, so an unmapped one has none.
        j = per_acct.join(acc, "ac_no", "left").join(term, "_mapped", "left")
        coded = j.withColumn("code", tenor_gl_first())
    ccy = F.col("ac_ccy")
    g = coded.groupBy("code", "ac_ccy").agg(
        F.when(ccy == base, F.coalesce(F.sum("d_lcy"), _zero()))
         .otherwise(F.coalesce(F.sum("d_fcy"), _zero())).alias("debit"),
        F.when(ccy == base, F.coalesce(F.sum("c_lcy"), _zero()))
         .otherwise(F.coalesce(F.sum("c_fcy"), _zero())).alias("credit"),
        F.coalesce(F.sum("d_lcy"), _zero()).alias("debit_mmk"),
        F.coalesce(F.sum("c_lcy"), _zero()).alias("credit_mmk"))
    return g.select("code", F.col("ac_ccy").alias("currency"),
                    F.abs(F.col("credit") - F.col("debit")).alias("amount"),
                    F.abs(F.col("credit_mmk") - F.col("debit_mmk")).alias("amount_equivalentmmk"))
