"""The seven reports (R1-R7) and the lookup dump.

Each report is ``report_x(source, ...params) -> DataFrame``: ``source`` is
anything with ``table(name)`` (see ``tallyspark.sources``).  Parameters that
the original scripts hard-coded (dates, GL codes, the head-office label,
the exception day) are arguments.  Nothing is collected; the caller takes
the action.  Money stays ``decimal``; ordering follows Oracle (ASC NULLS
LAST) where a report orders its rows.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark import fixed
from tallyspark.session import checkpoint_dir
from tallyspark.functions.oracle import MONEY, nvl
from tallyspark.operators import accounts as acc
from tallyspark.operators import deposits as dep
from tallyspark.operators.channels import channel, with_zone
from tallyspark.operators.flows import deposit_flows, net_position, turnover_of_nets
from tallyspark.operators.ledger import (cash_legs, in_window, net_by_mode, postable,
                                         tenor_gl_bucket, unit_amount, with_natural_gl)
from tallyspark.operators.relational import salted_join
from tallyspark.operators.reversal import exclude_reversed

DEFAULT_HEAD_OFFICE_LABEL = "HEAD OFFICE"


def fix(df: DataFrame) -> DataFrame:
    """Materialise a relation that several consumers read, once.

    ``checkpoint`` writes it from the executors to ``spark.checkpoint.dir``
    -- the cluster's shared folder -- and cuts its lineage: the consumers
    read the written rows instead of each re-running the subtree (Spark does
    not share a subtree between differently-pruned consumers, and under
    adaptive execution a repeated subquery re-runs per stage), and a lost
    executor does not force a recomputation from the sources.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


# ------------------------------------------------------------------ R2
def cash_in_out_by_zone(src, date_from: date, date_to: date,
                        base: str = fixed.BASE_CCY) -> DataFrame:
    """R2: cash in/out by zone, currency, type and channel, reversals removed.

    Output: zone, currency, type, source, amount_unit, equivalent_mmk,
    equivalent_usd (always 0).
    """
    led = src.table("ledger_entry")
    window = in_window(led, date_from, date_to)
    hot = in_window(src.table("hot_key"), date_from, date_to)
    cash = exclude_reversed(cash_legs(window, src.table("gl_master")),
                            src.table("reversal_entry"), "customer", hot=hot)
    keys = ["trn_ref_no", "external_ref_no", "ac_branch", "ac_ccy", "lcy_amount"]
    # Each customer row joins every cash leg with the same five keys (fan-out is
    # the report's rule); counting the legs per key first keeps the join
    # many-to-one and weights the sums instead of duplicating rows.
    n_cash = cash.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rows = salted_join(window.where(F.col("cust_gl") == fixed.CUSTOMER_LEG), n_cash, keys, hot=hot)
    rows = with_zone(rows, src.table("branch_group_member"), src.table("branch_group"))
    drcr = F.col("drcr_ind")
    typ = F.when(drcr == fixed.CREDIT, "Cash_In").when(drcr == fixed.DEBIT, "Cash_Out")
    n = F.col("_n")
    g = (rows.groupBy("zone", F.col("ac_ccy").alias("currency"), typ.alias("type"),
                      channel().alias("source"))
         .agg(F.sum(unit_amount(base=base) * n).alias("amount_unit"),
              F.sum(F.col("lcy_amount") * n).alias("equivalent_mmk")))
    return g.select("zone", "currency", "type", "source", "amount_unit", "equivalent_mmk",
                    F.lit(0).cast(MONEY).alias("equivalent_usd"))


# ------------------------------------------------------------------ R7
def turnover_working_set(src, on: date) -> DataFrame:
    """The postable, unreversed entries of one day with their tenor-coded
    GL and the GL type."""
    return turnover_entries(src, in_window(src.table("ledger_entry"), on), in_window(src.table("hot_key"), on))


def turnover_entries(src, entries: DataFrame, hot: DataFrame) -> DataFrame:
    """The working set of R7 for the entries of any days."""
    day = postable(entries)
    day = exclude_reversed(day, src.table("reversal_entry"), "ref_code", hot=hot)
    gl = src.table("gl_master").select("gl_code", "type")
    enriched = with_natural_gl(day, src.table("account_gl_map"), src.table("deposit_term"), hot=hot, gl_codes=gl)
    ds = (enriched.join(gl, "gl_code")
          .withColumn("gl_code", tenor_gl_bucket("gl_code", "orig_tenor_days"))
          .select("trn_ref_no", "ac_branch", "gl_code", "drcr_ind", "trn_code", "ac_ccy",
                  "fcy_amount", "lcy_amount", "trn_dt", "type"))
    return ds


def gl_turnover(src, on: date, base: str = fixed.BASE_CCY) -> DataFrame:
    """GL debit/credit turnover of one day by cash/transfer mode."""
    out = turnover_of_nets(net_by_mode(turnover_working_set(src, on)), base=base)
    return out.orderBy(F.col("gl_code").asc_nulls_last(), F.col("ac_ccy").asc_nulls_last())


# ------------------------------------------------------------------ R4
def liquidity(src, as_of: date, codes=None, base: str = fixed.BASE_CCY) -> DataFrame:
    """Net ledger position per tenor-qualified GL code and currency as of
    a day (inclusive), optionally restricted to ``codes``.

    A catalog keeps the balances at the end of each closed period; of these
    the last one before is read, and the days since."""
    daily = src.table("authorised_daily").where(F.col("trn_dt") <= F.lit(as_of))
    closed = src.last_period_end(as_of) if hasattr(src, "last_period_end") else None
    if closed is not None:
        since = daily.where(F.col("trn_dt") > F.lit(closed)).drop("trn_dt").withColumn("n_days", F.lit(1))
        balances = src.table("period_balance").where(F.col("period_end") == F.lit(closed)).drop("period_end")
        daily = balances.unionByName(since)
    return net_position(daily, src.table("account_gl_map"), src.table("deposit_term"),
                        codes=codes, base=base)


# ------------------------------------------------------------------ R5
def new_deposit(src, on: date, base: str = fixed.BASE_CCY) -> DataFrame:
    """Deposits in/out of one day by currency and mode, with the
    bank-wide net number of new accounts repeated on every row."""
    led = src.table("ledger_entry")
    day = in_window(led, on)
    cash = cash_legs(day, src.table("gl_master"))
    customer_rows = day.where(F.col("cust_gl") == fixed.CUSTOMER_LEG)
    flows = deposit_flows(customer_rows, cash, src.table("account_gl_map"), base=base,
                          hot=in_window(src.table("hot_key"), on))
    opened = acc.new_accounts(src.table("account"), src.table("account_balance"),
                              src.table("first_entry"), on, None, keys=("cust_ac_no",))
    closed = acc.closures(src.table("account_closure"), src.table("account"), on, None)
    n_open = opened.agg(F.count("acc_no")).scalar()
    n_close = closed.agg(F.count("ac_no")).scalar()
    cols = flows.columns
    return flows.select("currency", (n_open - n_close).alias("numberofaccount"), *cols[1:])


# ------------------------------------------------------------------ R6
def open_close_counts(src, date_from: date, date_to: date) -> DataFrame:
    """Accounts opened/closed per branch, opening date and product."""
    opened = acc.new_accounts(src.table("account"), src.table("account_balance"),
                              src.table("first_entry"), date_from, date_to)
    closed = acc.closures(src.table("account_closure"), src.table("account"), date_from, date_to)
    out = acc.open_close(opened, closed, src.table("account_class"), date_from, date_to)
    return (out.orderBy(F.col("branch_code").asc_nulls_last())
            .select("branch_code", "openingdate", "description", "totalopened", "totalclosed"))


# ------------------------------------------------------------------ R3
EKYC_COLUMNS = ("Type", "Open Date", "Account No", "CIF No", "Prefix", "Name", "DOB",
                "DESIGNATION", "ID Card Type", "ID Card No", "Phone No", "Address",
                "Branch Code", "Branch Name")


def ekyc(src, date_from: date, date_to: date) -> DataFrame:
    """One row per account holder (joint holders included) of accounts
    opened in the window, internal accounts excluded."""
    accounts = acc.exclude_internal(src.table("account").where(
        F.col("ac_open_date").between(F.lit(date_from), F.lit(date_to))))
    holders = acc.account_holders(accounts, src.table("joint_holder"))
    cust = src.table("customer").select(*acc.CUSTOMER_COLUMNS)
    # Holders of the window's accounts first, then their details: the large
    # customer tables are probed for these customers only.
    named = holders.join(cust, holders.cust_no == cust.customer_no)
    j = acc.with_customer_details(named, src.table("customer_personal"),
                                  src.table("customer_corporate"),
                                  src.table("customer_professional"))
    br = src.table("branch").select("branch_code", "branch_name")
    j = j.join(br, "branch_code")
    out = j.select(
        acc.holder_type().alias("Type"),
        F.col("ac_open_date").alias("Open Date"),
        F.col("cust_ac_no").alias("Account No"),
        F.col("cust_no").alias("CIF No"),
        F.col("customer_prefix").alias("Prefix"),
        F.col("full_name").alias("Name"),
        F.col("date_of_birth").alias("DOB"),
        F.col("designation").alias("DESIGNATION"),
        F.col("unique_id_name").alias("ID Card Type"),
        F.col("unique_id_value").alias("ID Card No"),
        nvl("telephone", "mobile_number").alias("Phone No"),
        acc.format_address().alias("Address"),
        F.col("branch_code").alias("Branch Code"),
        F.col("branch_name").alias("Branch Name"))
    return out.orderBy(F.col("Open Date").asc_nulls_last(), F.col("Account No").asc_nulls_last())


def field_labels(src) -> DataFrame:
    """The field-label lookup table as it is."""
    return src.table("field_label")


# ------------------------------------------------------------------ R1
R1_COLUMNS = ("loop_date", "branch_code", "branch_name", "lcy_opening_bal", "cashin",
              "cashout", "net_amount", "lcy_closing_bal", "cdr", "daily_net_deposit_amt",
              "total_dep", "current_bal", "cur_deposit_ratio", "saving_bal",
              "sav_deposit_ratio", "call_bal", "call_deposit_ratio", "fixed_bal",
              "fixed_deposit_ratio", "ccdr")


def monitor_days(src, before: date, exception_days=(), n_days: int = 5):
    """The report days (business days, holidays excluded) and the comparison
    list (one day longer, holidays not excluded, not de-duplicated)."""
    cal = src.table("calendar")
    days = dep.business_days(cal, before, n=n_days, holidays=src.table("holiday"),
                             skip=exception_days)
    prior = dep.business_days(cal, before, n=n_days + 1, holidays=None,
                              skip=exception_days, distinct=False)
    # Both lists are bounded by n_days + 1 rows and feed five consumers each.
    # Fixing them once (written to the shared checkpoint folder) keeps every
    # consumer from re-running the calendar scan and top-n.
    return fix(days), fix(prior)


def deposits_with_prior(src, before: date, exception_days=(), n_days: int = 5) -> DataFrame:
    """DepBKG of the cash monitor: deposits of the report days with the
    day-over-day net against the comparison day."""
    days, prior = monitor_days(src, before, exception_days, n_days)
    mix = dep.deposit_mix(src.table("balance_history"), days.unionByName(prior))
    return dep.net_deposit(mix, days, prior)


def cash_monitor(src, before: date, exception_days=(), n_days: int = 5,
                 head_office_label: str = DEFAULT_HEAD_OFFICE_LABEL,
                 head_office: str = fixed.HEAD_OFFICE_BRANCH) -> DataFrame:
    """Last-``n_days``-business-day cash position and deposit mix per branch.

    A branch-day is reported when it has opening cash, cash movement and
    deposits with a comparison day; the head office is appended with its
    deposits and zero cash.
    """
    hist = src.table("balance_history")
    days, prior = monitor_days(src, before, exception_days, n_days)
    opening = dep.opening_cash(hist, days, src.table("first_snapshot"))
    cio = dep.cash_in_out(src.table("ledger_entry"), src.table("gl_account"),
                          src.table("branch"), days, src.table("reversal_entry"),
                          src.table("cash_touch"), src.table("hot_key"), src.table("reversal_count"))
    br = src.table("branch").select(F.col("branch_code").alias("ac_branch"),
                                    F.col("branch_name").alias("brn_name"))
    limit = (opening.join(cio.select("trn_dt", "ac_branch", "cashin", "cashout"),
                          (opening.loop_date == cio.trn_dt)
                          & (opening.branch_code == cio.ac_branch))
             .join(br, "ac_branch")
             .select("loop_date", "branch_code", F.col("brn_name").alias("branch_name"),
                     "lcy_opening_bal", "cashin", "cashout",
                     (F.col("cashin") + F.col("cashout")).alias("net_amount"),
                     (F.col("lcy_opening_bal") + F.col("cashin") + F.col("cashout"))
                     .alias("lcy_closing_bal")))
    mix = dep.deposit_mix(hist, days.unionByName(prior))
    net = dep.net_deposit(mix, days, prior)
    branches = (limit.join(net, (limit.loop_date == net.trn_dt)
                           & (limit.branch_code == net.branch))
                .where(F.col("branch") != head_office)
                .select("loop_date", "branch_code", "branch_name", *dep.CASH_COLUMNS,
                        *dep.DEPOSIT_COLUMNS))
    rows = branches.unionByName(dep.head_office_rows(net, head_office_label, head_office))
    rated = dep.with_ratios(rows)
    out = rated.select(
        dep.date_label(F.col("loop_date"), F.col("branch_code")).alias("loop_date"),
        *R1_COLUMNS[1:], F.col("loop_date").alias("_day"))
    return (out.orderBy(F.col("_day").asc_nulls_last(), F.col("branch_code").asc_nulls_last())
            .drop("_day"))
