"""Cash position and deposit operators of the cash monitor.

Sizes: the business-day lists are at most ``n`` rows by construction
(``limit(n)``).  Consumers filter the day-partitioned tables with
``on_days`` -- ``array_contains`` over the list as one scalar array -- which
Spark evaluates as a runtime partition filter, so only the listed days'
partitions of the ledger and of the snapshots are read.  Every
other input is aggregated to (branch, day) grain before it is joined, so
the joins of the final report run on a few rows per branch and day.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark import fixed
from tallyspark.functions.oracle import (MONEY, char_at, dd_mon_yy, is_weekday,
                                         round_ratio, substr)
from tallyspark.operators.relational import not_in, salted_join
from tallyspark.operators.reversal import exclude_reversed


# ------------------------------------------------------------------ C7
def business_days(calendar: DataFrame, before: date, n: int = 5,
                  holidays: DataFrame | None = None, skip=(),
                  distinct: bool = True) -> DataFrame:
    """The latest ``n`` calendar days before ``before`` that are not
    weekends, not in ``skip`` and (when given) not holidays.

    The holiday test is SQL ``NOT IN``: a NULL holiday date empties the
    list.  With ``distinct=False`` duplicated calendar rows stay, so they
    take several of the ``n`` places (the 6-day list of the cash monitor).
    """
    d = F.col("loop_date")
    days = calendar.select(F.col("value_date").alias("loop_date")).where(
        (d < F.lit(before)) & is_weekday(d))
    for s in skip:
        days = days.where(d != F.lit(s))
    if holidays is not None:
        days = not_in(days, "loop_date", holidays, "holiday_date")
    if distinct:
        days = days.distinct()
    return days.orderBy(F.col("loop_date").desc_nulls_first()).limit(n)


def day_list(days: DataFrame) -> Column:
    """The dates of a (bounded, at most ``n`` rows) business-day list as one
    sorted array -- a scalar subquery."""
    return days.agg(F.sort_array(F.collect_list("loop_date")).alias("d")).scalar()


def on_days(c, days: DataFrame) -> Column:
    """``c IN (day list)`` as a partition-prunable filter."""
    return F.array_contains(day_list(days), F.col(c) if isinstance(c, str) else c)


# ------------------------------------------------------------------ C5
def _snapshot_scope(history: DataFrame) -> DataFrame:
    acct = F.col("account")
    return history.where(
        (acct == fixed.CASH_GL)
        | (acct.startswith(fixed.DEPOSIT_ACCOUNT_PREFIX) & (substr(acct, 9, 3) != "000")))


def asof_snapshots(history: DataFrame, days: DataFrame, n: int) -> DataFrame:
    """For each business day, account and branch, the latest snapshot
    date on or before the day (deposit accounts ``21...``) or strictly before
    it (GL accounts ``11...``).  Days without any snapshot appear once with
    NULL account and branch (the left join of the report).

    No row-by-day pairs are formed: the at most ``n`` days travel as one
    array (a scalar subquery), each snapshot contributes to ``n`` conditional
    maxima in a single aggregate, and the result is unpivoted ``n`` ways.
    """
    arr = day_list(days)
    acct, bkg = F.col("account"), F.col("bkg_date")
    inclusive = acct.startswith("21")
    strict = acct.startswith("11")
    h = _snapshot_scope(history).select("account", "branch_code", "bkg_date")
    maxima = []
    for j in range(n):
        dj = F.get(arr, j)
        hit = F.when(inclusive, bkg <= dj).when(strict, bkg < dj)
        maxima.append(F.max(F.when(hit, bkg)).alias(f"m{j}"))
    g = h.groupBy("account", "branch_code").agg(*maxima)
    slots = F.array(*[F.struct(F.get(arr, j).alias("loop_date"), F.col(f"m{j}").alias("max_bkg_date"))
                      for j in range(n)])
    found = (g.select("account", "branch_code", F.inline(slots))
             .where(F.col("max_bkg_date").isNotNull()))
    # A day is missing when no (account, branch) has a snapshot for it: the
    # per-day maxima over the same aggregate (whose exchange is shared), so
    # the history is not aggregated a second time.
    per_day = g.agg(F.array(*[F.struct(F.get(arr, j).alias("loop_date"),
                                        F.max(f"m{j}").alias("m")) for j in range(n)]).alias("s"))
    missing = (per_day.select(F.inline("s"))
               .where(F.col("loop_date").isNotNull() & F.col("m").isNull())
               .select("loop_date").distinct())
    return found.select("loop_date", "max_bkg_date", "account", "branch_code").unionByName(
        missing.select("loop_date", F.lit(None).cast("date").alias("max_bkg_date"),
                       F.lit(None).cast("string").alias("account"),
                       F.lit(None).cast("string").alias("branch_code")))


# ------------------------------------------------------------------ C8
def opening_cash(history: DataFrame, days: DataFrame, firsts: DataFrame) -> DataFrame:
    """``abs(sum(lcy_opening_bal))`` of the cash GL per business day and
    branch, kept only when the branch has an earlier cash-GL snapshot.

    That condition is what the as-of lookup (C5) contributes for the cash GL
    (strictly-before rule).  ``firsts`` is the ``first_snapshot`` side table
    (one row per branch), so only the days' partitions are read.
    """
    cash = history.where(F.col("account") == fixed.CASH_GL)
    first = firsts.select("branch_code", F.col("first_dt").alias("_first"))
    today = cash.where(on_days("bkg_date", days)).withColumn("loop_date", F.col("bkg_date"))
    kept = today.join(first, "branch_code").where(F.col("_first") < F.col("loop_date"))
    return (kept.groupBy("loop_date", "branch_code")
            .agg(F.abs(F.sum("lcy_opening_bal")).alias("lcy_opening_bal")))


# ------------------------------------------------------------------ C9
def cash_in_out(ledger: DataFrame, gl_account: DataFrame, branch: DataFrame,
                days: DataFrame, reversals: DataFrame, cash_refs: DataFrame,
                hot: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Cash in (credits) and cash out (negated debits) per day and branch
    from the legs of transactions that touch branch cash.

    A leg counts when its transaction is not reversed (C1a, null-aware,
    ``reversals`` = reversal rows of all history), the same transaction has a
    ``1101...`` leg in the same branch (``cash_refs`` = the ``cash_touch``
    side table), and its natural GL is one of the cash-movement families.
    """
    window = ledger.where(on_days("trn_dt", days))
    led = window.withColumn("loop_date", F.col("trn_dt"))
    # The selective tests first (semi and anti joins on the reference), so
    # only legs of cash transactions meet the large account dimension.
    # Without ``hot``, ``cash_refs`` and ``reversals``, which cover all history,
    # are cut down to the window's keys (read from the pruned window scan)
    # before they are replicated per salt.
    keys = ["trn_ref_no", "ac_branch"]
    hot = None if hot is None else hot.where(on_days("trn_dt", days)).drop("trn_dt")
    led = salted_join(led, cash_refs.select(*keys), keys, "left_semi",
                      reduce_by=window, hot=hot)
    led = exclude_reversed(led, reversals, "ref", candidates=window, hot=hot, counts=counts)
    acc = gl_account.select(F.col("ac_gl_no").alias("ac_no"), "ac_natural_gl")
    br = branch.select(F.col("branch_code").alias("ac_branch"), "branch_name")
    # Contra legs sit on a few GL accounts: a hot key, hence salted.
    j = salted_join(led, acc, ["ac_no"], reduce_by=window, hot=hot).join(br, "ac_branch")
    natural = F.coalesce(F.col("ac_natural_gl"), F.col("ac_no"))
    j = j.where(substr(natural, 1, 4).isin(*fixed.CASH_MOVEMENT_GL_FAMILIES)
                | substr(natural, 1, 1).isin(*fixed.CASH_MOVEMENT_GL_CLASSES))
    drcr, lcy = F.col("drcr_ind"), F.col("lcy_amount")
    zero = F.lit(0).cast(MONEY)
    return (j.groupBy("loop_date", "trn_dt", "ac_branch", "branch_name")
            .agg(F.sum(F.coalesce(F.when(drcr == fixed.CREDIT, lcy), zero)).alias("cashin"),
                 F.sum(F.coalesce(F.when(drcr == fixed.DEBIT, -lcy), zero)).alias("cashout")))


# ------------------------------------------------------------------ C10
def deposit_mix(history: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """Deposit balances per day and branch by the account's type digit
    (4th character): 2 current, 1 saving, 4 call, 3 fixed; the total covers
    every type but 0 (a missing digit drops the account, a letter stays in
    the total only).  Balances are the *closing* balances of the snapshot.

    One aggregate at (day, branch) grain; the report's per-account
    pre-aggregation is a sum of sums and folds into it.
    """
    h = history.where(F.col("account").startswith(fixed.DEPOSIT_ACCOUNT_PREFIX))
    if days is not None:
        h = h.where(on_days("bkg_date", days))
    t = char_at("account", 4)
    bal = F.col("lcy_closing_bal")
    zero = F.lit(0).cast("decimal(32,3)")

    def part(code):
        return F.sum(F.coalesce(F.when(t == code, bal), zero))

    return (h.where(t != fixed.DEPOSIT_TYPE_EXCLUDED)
            .groupBy(F.col("bkg_date").alias("trn_dt"), "branch_code")
            .agg(part(fixed.DEPOSIT_TYPE_CURRENT).alias("current_bal"),
                 part(fixed.DEPOSIT_TYPE_SAVING).alias("saving_bal"),
                 part(fixed.DEPOSIT_TYPE_CALL).alias("call_bal"),
                 part(fixed.DEPOSIT_TYPE_FIXED).alias("fixed_bal"),
                 F.sum(bal).alias("total_dep")))


# ------------------------------------------------------------------ C6
def net_deposit(deposits: DataFrame, days: DataFrame, prior_days: DataFrame) -> DataFrame:
    """Day-over-day net deposit per branch.

    Each report day is compared with ONE earlier day: the latest day of
    ``prior_days`` that precedes it for *some* branch.  A branch without a
    row on that globally chosen day drops out for the report day.

    One pass, no self-join: the deposit rows of both lists are tagged (a day
    in both lists yields two rows), a window per branch gives each report
    row its latest earlier comparison day and the branch's comparison totals
    as a map (at most ``|prior_days|`` entries -- the deposits are one row
    per day and branch), a window per day picks the global comparison day,
    and the map lookup fetches the branch's total on it.
    """
    lists = (days.select(F.col("loop_date").alias("trn_dt"), F.lit(0).alias("_side"))
             .unionByName(prior_days.select(F.col("loop_date").alias("trn_dt"),
                                            F.lit(1).alias("_side")))
             .distinct())
    # Branches are compared by equality, so rows without one match nothing.
    both = deposits.where(F.col("branch_code").isNotNull()).join(F.broadcast(lists), "trn_dt")
    side = F.col("_side")
    branch = Window.partitionBy("branch_code")
    earlier = branch.orderBy("trn_dt", "_side").rowsBetween(Window.unboundedPreceding, -1)
    tagged = both.select(
        "*",
        F.max(F.when(side == 1, F.col("trn_dt"))).over(earlier).alias("_prev"),
        F.map_from_entries(F.collect_list(F.when(side == 1, F.struct("trn_dt", "total_dep")))
                           .over(branch)).alias("_prior"))
    report = (tagged.where(side == 0)
              .withColumn("_chosen", F.max("_prev").over(Window.partitionBy("trn_dt")))
              .where(F.col("_chosen").isNotNull()
                     & F.map_contains_key(F.col("_prior"), F.col("_chosen"))))
    prior_total = F.try_element_at(F.col("_prior"), F.col("_chosen"))
    return report.select(
        "trn_dt", F.col("branch_code").alias("branch"), "current_bal", "saving_bal",
        "call_bal", "fixed_bal", "total_dep",
        (F.col("total_dep") - prior_total).alias("daily_net_deposit_amt"))


# ------------------------------------------------------------------ C11
RATIO_COLUMNS = ("cdr", "cur_deposit_ratio", "sav_deposit_ratio", "call_deposit_ratio",
                 "fixed_deposit_ratio", "ccdr")


def with_ratios(df: DataFrame) -> DataFrame:
    """C11: deposit ratios; 0 when the denominator is 0 or NULL."""
    tot = F.col("total_dep")
    return df.select(
        "*",
        round_ratio("lcy_closing_bal", tot).alias("cdr"),
        round_ratio("current_bal", tot).alias("cur_deposit_ratio"),
        round_ratio("saving_bal", tot).alias("sav_deposit_ratio"),
        round_ratio("call_bal", tot).alias("call_deposit_ratio"),
        round_ratio("fixed_bal", tot).alias("fixed_deposit_ratio"),
        round_ratio("lcy_closing_bal", "call_bal").alias("ccdr"))


# ------------------------------------------------------------------ C26
CASH_COLUMNS = ("lcy_opening_bal", "cashin", "cashout", "net_amount", "lcy_closing_bal")
DEPOSIT_COLUMNS = ("current_bal", "saving_bal", "call_bal", "fixed_bal", "total_dep",
                   "daily_net_deposit_amt")


def head_office_rows(net: DataFrame, label: str,
                     head_office: str = fixed.HEAD_OFFICE_BRANCH) -> DataFrame:
    """The head office has deposits but no vault: its rows carry a fixed
    label and zero cash figures."""
    zero = F.lit(0).cast(MONEY)
    return net.where(F.col("branch") == head_office).select(
        F.col("trn_dt").alias("loop_date"), F.col("branch").alias("branch_code"),
        F.lit(label).alias("branch_name"), *[zero.alias(c) for c in CASH_COLUMNS],
        *DEPOSIT_COLUMNS)


def date_label(loop_date: Column, branch_code: Column,
               label_branch: str = fixed.LABEL_BRANCH) -> Column:
    """the day is printed only on the first branch's rows
    (``case when branch <> '001' then '' else ...``: '' is NULL, and a NULL
    branch falls to the ELSE branch)."""
    return (F.when(branch_code != label_branch, F.lit(None).cast("string"))
            .otherwise(dd_mon_yy(loop_date)))
