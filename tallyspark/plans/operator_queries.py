"""
is not already exercised on its own by a report query.

Each query runs one library operator (or a short composition) over the
whole derived relations of ``sf_dir``; the row-level ones return every row
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark import fixed
from tallyspark.functions.oracle import MONEY, dd_mon_yy, is_weekday, nvl, round_ratio, substr
from tallyspark.operators import accounts as acc
from tallyspark.operators import deposits as dep
from tallyspark.operators.channels import channel, open_branch_groups, zone_of
from tallyspark.operators.flows import deposit_flows, net_position, turnover
from tallyspark.operators.ledger import (cash_legs, classify_mode, in_window, postable,
                                         tenor_gl_bucket, tenor_gl_first, unit_amount,
                                         with_natural_gl)
from tallyspark.operators.relational import not_in
from tallyspark.operators.reversal import exclude_reversed
from tallyspark.plans import params as P
from tallyspark.plans import reports as R
from tallyspark.plans.registry import _q
from tallyspark.sources import TestdataSource

S = TestdataSource
LED_COLS = ["trn_ref_no", "ac_entry_sr_no", "ac_no", "cust_gl", "drcr_ind", "lcy_amount", "trn_dt"]
TURNOVER_DAY_2 = P.TURNOVER_DAY.replace(day=11)


def _led(s: S) -> DataFrame:
    return s.table("ledger_entry")


def _zone_window(s: S) -> DataFrame:
    return in_window(_led(s), P.ZONE_FROM, P.ZONE_TO)


# ----------------------------------------------------------- C1 reversals
def reversal_ref(s: S) -> DataFrame:
    """Window entries whose reference is NOT IN the reversed
    references (null-aware)."""
    return exclude_reversed(_zone_window(s), s.table("reversal_entry"), "ref").select(*LED_COLS)


def reversal_customer(s: S) -> DataFrame:
    """C1b / P20 (1 key): cash legs of the window, customer-side reversals
    removed (R2's cash-leg finder)."""
    legs = cash_legs(_zone_window(s), s.table("gl_master"))
    return exclude_reversed(legs, s.table("reversal_entry"), "customer").select(
        "trn_ref_no", "external_ref_no", "ac_branch", "ac_no", "ac_ccy", "trn_code", "lcy_amount")


def reversal_ref_code(s: S) -> DataFrame:
    """C1c / P20 (2 keys): postable entries of a day without an authorised
    reversal of the same reference and transaction code."""
    day = postable(in_window(_led(s), P.TURNOVER_DAY))
    return exclude_reversed(day, s.table("reversal_entry"), "ref_code").select(*LED_COLS, "trn_code")


def postable_q(s: S) -> DataFrame:
    """Authorised movement entries of a day."""
    return postable(in_window(_led(s), P.TURNOVER_DAY)).select(*LED_COLS, "trn_code", "event")


# ------------------------------------------------------ C2, C3, C4, C14
def mode_window(s: S) -> DataFrame:
    """Cash-or-transfer mode of every entry of the turnover
    working set (EXISTS under OR, rewritten as a keyed aggregate + join)."""
    return classify_mode(R.turnover_working_set(s, P.TURNOVER_DAY)).select(
        "trn_ref_no", "gl_code", "drcr_ind", "ac_ccy", "lcy_amount", "trn_mode")


def cash_legs_q(s: S) -> DataFrame:
    """Cash-GL legs of the window, sweeps removed."""
    return cash_legs(_zone_window(s), s.table("gl_master")).select(
        "trn_ref_no", "ac_branch", "ac_no", "ac_ccy", "trn_code", "lcy_amount", "trn_dt")


def _ledger_accounts(s: S) -> DataFrame:
    return _led(s).select("ac_no", "cust_gl").distinct()


def tenor_first(s: S) -> DataFrame:
    """Liquidity GL code of every (account, leg) of the ledger,
    through the chained left joins account -> map -> deposit term."""
    a = _ledger_accounts(s)
    m = s.table("account_gl_map").select("ac_gl_no", "ac_natural_gl")
    t = s.table("deposit_term")
    j = a.join(m, a.ac_no == m.ac_gl_no, "left").join(t, m.ac_gl_no == t.acc, "left")
    return j.select("ac_no", "cust_gl", tenor_gl_first().alias("code"))


def tenor_bucket(s: S) -> DataFrame:
    """Turnover GL code of every account of the ledger."""
    a = _led(s).select("ac_no").distinct()
    e = with_natural_gl(a, s.table("account_gl_map"), s.table("deposit_term"))
    return e.select("ac_no", "gl_code", "orig_tenor_days",
                    tenor_gl_bucket("gl_code", "orig_tenor_days").alias("tenor_code"))


def join_left_chain(s: S) -> DataFrame:
    """Entry -> account map -> deposit term, the second join keyed on
    the nullable side (a NULL map key never matches)."""
    a = _ledger_accounts(s)
    m = s.table("account_gl_map").select("ac_gl_no", "ac_natural_gl")
    t = s.table("deposit_term")
    j = a.join(m, a.ac_no == m.ac_gl_no, "left").join(t, m.ac_gl_no == t.acc, "left")
    return j.select("ac_no", "cust_gl", "ac_natural_gl", "orig_tenor_days",
                    "orig_tenor_months", "orig_tenor_years")


def unit_amount_q(s: S) -> DataFrame:
    """C14: customer amounts of the window in currency units and in base
    currency, per currency and side."""
    w = _zone_window(s).where(F.col("cust_gl") == fixed.CUSTOMER_LEG)
    return w.groupBy("ac_ccy", "drcr_ind").agg(
        F.sum(unit_amount()).alias("amount_unit"), F.sum("lcy_amount").alias("amount_mmk"))


# ------------------------------------------------------------- zones
def case_zone(s: S) -> DataFrame:
    """Branch -> zone through open branch groups."""
    g = open_branch_groups(s.table("branch_group_member"), s.table("branch_group"))
    return g.select("branch_code", "branch_group_code", zone_of().alias("zone"))


def channel_split(s: S) -> DataFrame:
    """Entries and amounts per transaction code and channel."""
    return _led(s).groupBy("trn_code", channel().alias("source")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("lcy_amount").alias("amount"))


# ------------------------------------------------------------- R1 parts
def business_days_q(s: S) -> DataFrame:
    """The report days and the comparison days."""
    days, prior = R.monitor_days(s, P.CASH_MONITOR_BEFORE)
    return (days.select(F.lit("report").alias("list"), "loop_date")
            .unionByName(prior.select(F.lit("prior").alias("list"), "loop_date")))


def asof_max(s: S) -> DataFrame:
    """Latest snapshot on/before (21...) or before (11...) each
    report day, per account and branch."""
    days, _ = R.monitor_days(s, P.CASH_MONITOR_BEFORE)
    return dep.asof_snapshots(s.table("balance_history"), days, 5)


def semi_tuple(s: S) -> DataFrame:
    """Snapshot rows whose (day, account, branch) is IN the as-of
    table (three-column semi join)."""
    days, _ = R.monitor_days(s, P.CASH_MONITOR_BEFORE)
    keys = dep.asof_snapshots(s.table("balance_history"), days, 5).select(
        F.col("loop_date").alias("bkg_date"), "account", "branch_code")
    h = s.table("balance_history")
    return h.join(keys, ["bkg_date", "account", "branch_code"], "left_semi").select(
        "account", "branch_code", "bkg_date", "lcy_opening_bal")


def opening_cash_q(s: S) -> DataFrame:
    """Opening vault cash per report day and branch."""
    days, _ = R.monitor_days(s, P.CASH_MONITOR_BEFORE)
    return dep.opening_cash(s.table("balance_history"), days, s.table("first_snapshot"))


def cash_in_out_q(s: S) -> DataFrame:
    """Cash in/out per report day and branch."""
    days, _ = R.monitor_days(s, P.CASH_MONITOR_BEFORE)
    return dep.cash_in_out(_led(s), s.table("gl_account"), s.table("branch"), days,
                           s.table("reversal_entry"), s.table("cash_touch"))


def deposit_mix_q(s: S) -> DataFrame:
    """Deposit mix of every snapshot day and branch."""
    return dep.deposit_mix(s.table("balance_history"))


def top6_in(s: S) -> DataFrame:
    """Deposit mix of the days IN the 6-day comparison list."""
    _, prior = R.monitor_days(s, P.CASH_MONITOR_BEFORE)
    return dep.deposit_mix(s.table("balance_history"), prior)


def net_deposit_q(s: S) -> DataFrame:
    """Day-over-day net deposit."""
    return R.deposits_with_prior(s, P.CASH_MONITOR_BEFORE)


def union_head_office(s: S) -> DataFrame:
    """The head-office rows of the cash monitor."""
    net = R.deposits_with_prior(s, P.CASH_MONITOR_BEFORE)
    return dep.head_office_rows(net, P.HEAD_OFFICE_LABEL)


def guarded_ratio(s: S) -> DataFrame:
    """Deposit ratios of every snapshot day and branch."""
    mix = dep.deposit_mix(s.table("balance_history"))
    tot = F.col("total_dep")
    return mix.select(
        "trn_dt", "branch_code",
        round_ratio("current_bal", tot).alias("cur_deposit_ratio"),
        round_ratio("saving_bal", tot).alias("sav_deposit_ratio"),
        round_ratio("call_bal", tot).alias("call_deposit_ratio"),
        round_ratio("fixed_bal", tot).alias("fixed_deposit_ratio"),
        round_ratio("saving_bal", "call_bal").alias("saving_call_ratio"))


def window_max_partition(s: S) -> DataFrame:
    """Per posting day, the branch(es) with the largest customer
    credit total -- ``max() over (partition by day)`` on the day x branch
    aggregate, then a filter on the window result."""
    per = (_led(s).where((F.col("cust_gl") == fixed.CUSTOMER_LEG)
                         & (F.col("drcr_ind") == fixed.CREDIT))
           .groupBy("trn_dt", "ac_branch").agg(F.sum("lcy_amount").alias("total")))
    w = Window.partitionBy("trn_dt")
    return (per.withColumn("day_max", F.max("total").over(w))
            .where(F.col("total") == F.col("day_max")).drop("day_max"))


# ------------------------------------------------------------- flows
def deposit_flows_q(s: S) -> DataFrame:
    """Deposit flows of another day (cash legs by left join)."""
    day = in_window(_led(s), P.TURNOVER_DAY)
    cash = cash_legs(day, s.table("gl_master"))
    rows = day.where(F.col("cust_gl") == fixed.CUSTOMER_LEG)
    return deposit_flows(rows, cash, s.table("account_gl_map"))


def join_left_default(s: S) -> DataFrame:
    """Every customer entry of a day with its mode: a left join on four
    keys to the cash legs (each match one row), 'TRANSFER' on a miss."""
    day = in_window(_led(s), P.NEW_DEPOSIT_DAY)
    cash = cash_legs(day, s.table("gl_master")).select(
        "trn_ref_no", "ac_branch", "ac_ccy", "lcy_amount", F.lit("CASH").alias("mode"))
    rows = day.where(F.col("cust_gl") == fixed.CUSTOMER_LEG)
    j = rows.join(cash, ["trn_ref_no", "ac_branch", "ac_ccy", "lcy_amount"], "left")
    return j.select("trn_ref_no", "ac_no", "drcr_ind", "lcy_amount",
                    F.coalesce("mode", F.lit("TRANSFER")).alias("mode"))


def turnover_q(s: S) -> DataFrame:
    """GL turnover of a second day."""
    return turnover(classify_mode(R.turnover_working_set(s, TURNOVER_DAY_2)))


def net_position_q(s: S) -> DataFrame:
    """Net position of every GL code (no code filter)."""
    daily = s.table("authorised_daily").where(F.col("trn_dt") <= F.lit(P.LIQUIDITY_AS_OF))
    return net_position(daily, s.table("account_gl_map"), s.table("deposit_term"))


def join_multikey_fanout(s: S) -> DataFrame:
    """Rows produced per branch and currency by the five-key join of
    customer entries with cash legs (duplicate legs multiply rows)."""
    w = _zone_window(s)
    cash = exclude_reversed(cash_legs(w, s.table("gl_master")), s.table("reversal_entry"),
                            "customer")
    keys = ["trn_ref_no", "external_ref_no", "ac_branch", "ac_ccy", "lcy_amount"]
    n = cash.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    j = w.where(F.col("cust_gl") == fixed.CUSTOMER_LEG).join(n, keys)
    return j.groupBy("ac_branch", "ac_ccy").agg(F.sum("_n").alias("n_rows"))


# ------------------------------------------------------------- accounts
def new_accounts_q(s: S) -> DataFrame:
    """Newly active accounts of the open/close window."""
    return acc.new_accounts(s.table("account"), s.table("account_balance"),
                            s.table("first_entry"), P.OPEN_CLOSE_FROM, P.OPEN_CLOSE_TO)


def agg_of_union(s: S) -> DataFrame:
    """A10: newly active accounts per branch (aggregate over the union)."""
    return new_accounts_q(s).groupBy("branch_code").agg(F.count("acc_no").alias("n"))


def closures_q(s: S) -> DataFrame:
    """Closures of the window, same-day open-and-close excluded."""
    return acc.closures(s.table("account_closure"), s.table("account"),
                        P.OPEN_CLOSE_FROM, P.OPEN_CLOSE_TO)


def join_full_open_close(s: S) -> DataFrame:
    """Rows of the full outer join of openings and closures."""
    o = new_accounts_q(s)
    c = closures_q(s)
    oo = o.select(F.col("branch_code").alias("o_branch"), F.col("open_date").alias("o_open"),
                  F.col("acc_no").alias("o_acc"), F.col("account_class").alias("o_class"))
    j = oo.join(c, oo.o_acc == c.ac_no, "full")
    return j.select(F.coalesce("o_branch", "branch_code").alias("branch_code"),
                    F.coalesce("o_open", "ac_open_date").alias("openingdate"),
                    F.col("closing_date").alias("closingdate"),
                    F.coalesce("o_acc", "ac_no").alias("acc_no"),
                    F.coalesce("o_class", "account_class").alias("account_class"))


def scalar_cross(s: S) -> DataFrame:
    """Bank-wide opened, closed and net counts of a day, each an
    uncorrelated scalar subquery."""
    d = P.NEW_DEPOSIT_DAY
    opened = acc.new_accounts(s.table("account"), s.table("account_balance"),
                              s.table("first_entry"), d, None, keys=("cust_ac_no",))
    closed = acc.closures(s.table("account_closure"), s.table("account"), d, None)
    n_open = opened.agg(F.count("acc_no")).scalar()
    n_close = closed.agg(F.count("ac_no")).scalar()
    return s.table("calendar").where(F.col("value_date") == F.lit(d)).select(
        n_open.alias("opened"), n_close.alias("closed"), (n_open - n_close).alias("net"))


def account_holders_q(s: S) -> DataFrame:
    """Primary and joint holders of every account."""
    return acc.account_holders(s.table("account"), s.table("joint_holder"))


def internal_accounts(s: S) -> DataFrame:
    """Accounts left after removing internal accounts."""
    return acc.exclude_internal(s.table("account")).select("cust_ac_no", "branch_code")


def customer_profile_q(s: S) -> DataFrame:
    """Customer master with personal/corporate/professional data."""
    p = acc.customer_profile(s.table("customer"), s.table("customer_personal"),
                             s.table("customer_corporate"), s.table("customer_professional"))
    return p.select("customer_no", "customer_type", "full_name", "customer_prefix",
                    "date_of_birth", "designation", "telephone", "mobile_number")


def address(s: S) -> DataFrame:
    """Formatted address of every customer."""
    return s.table("customer").select("customer_no", acc.format_address().alias("address"))


def fn_nvl(s: S) -> DataFrame:
    """phone = nvl(telephone, mobile) of every personal record."""
    return s.table("customer_personal").select(
        "customer_no", nvl("telephone", "mobile_number").alias("phone"))


def quoted_alias(s: S) -> DataFrame:
    """Mixed-case aliases with spaces."""
    return s.table("account").select(
        F.col("ac_open_date").alias("Open Date"), F.col("cust_ac_no").alias("Account No"),
        F.col("cust_no").alias("CIF No"), F.col("branch_code").alias("Branch Code"))


# ------------------------------------------------------------- generic
def scan_ledger(s: S) -> DataFrame:
    """Projected ledger scan of a date window."""
    return _zone_window(s).select(*LED_COLS)


def const_columns(s: S) -> DataFrame:
    """Constant tag and zero-amount columns next to scanned ones."""
    return in_window(_led(s), P.TURNOVER_DAY).select(
        "trn_ref_no", "ac_entry_sr_no", F.lit("CASH").alias("mode"),
        F.lit(0).cast(MONEY).alias("clearing_amount"))


def between_dates(s: S) -> DataFrame:
    """Accounts opened inside a window but NOT closed inside it."""
    a = s.table("account").where(
        F.col("ac_open_date").between(F.lit(P.EKYC_FROM), F.lit(P.EKYC_TO)))
    c = s.table("account_closure").select(F.col("ac_no").alias("cust_ac_no"), "closing_date")
    j = a.join(c, "cust_ac_no", "left")
    keep = F.col("closing_date").isNull() | ~F.col("closing_date").between(
        F.lit(P.EKYC_FROM), F.lit(P.EKYC_TO))
    return j.where(keep).select("cust_ac_no", "ac_open_date", "closing_date")


def prefix_filter(s: S) -> DataFrame:
    """Snapshot rows in the as-of scope (cash GL, or 21... not
    ending in a 000 product) per branch."""
    h = dep._snapshot_scope(s.table("balance_history"))
    return h.groupBy("branch_code").agg(F.count(F.lit(1)).alias("n"),
                                        F.sum("lcy_closing_bal").alias("closing"))


def substr_type(s: S) -> DataFrame:
    """Deposit snapshots by type digit (4th character)."""
    h = s.table("balance_history").where(F.col("account").startswith("21"))
    return h.groupBy(substr("account", 4, 1).alias("type")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("lcy_closing_bal").alias("closing"))


def signed_side(s: S) -> DataFrame:
    """Effective side from indicator and sign (a negative debit is a
    credit), per indicator."""
    drcr, a = F.col("drcr_ind"), F.col("lcy_amount")
    side = (F.when(((drcr == "D") & (a >= 0)) | ((drcr == "C") & (a < 0)), "debit")
             .when(((drcr == "C") & (a >= 0)) | ((drcr == "D") & (a < 0)), "credit"))
    return _zone_window(s).groupBy("drcr_ind", side.alias("side")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.abs(a)).alias("amount"))


def anti_notin(s: S) -> DataFrame:
    """Weekday calendar days NOT IN the holidays (null-aware)."""
    d = s.table("calendar").select(F.col("value_date").alias("loop_date")).where(
        is_weekday("loop_date"))
    return not_in(d, "loop_date", s.table("holiday"), "holiday_date")


def join_inner_dims(s: S) -> DataFrame:
    """Window entries joined to GL master and branch."""
    w = _zone_window(s)
    gl = s.table("gl_master").select(F.col("gl_code").alias("ac_no"), "type")
    br = s.table("branch").select(F.col("branch_code").alias("ac_branch"), "branch_name")
    return (w.join(gl, "ac_no").join(br, "ac_branch")
            .groupBy("branch_name", "type").agg(F.count(F.lit(1)).alias("n"),
                                                F.sum("lcy_amount").alias("amount")))


def agg_sum(s: S) -> DataFrame:
    """A1: amount and entries per posting day and branch."""
    return _led(s).groupBy("trn_dt", "ac_branch").agg(
        F.sum("lcy_amount").alias("amount"), F.count(F.lit(1)).alias("n"))


def agg_minmax_count(s: S) -> DataFrame:
    """A3 / A4: first and last posting day and entry count per account."""
    return (_led(s).where(F.col("cust_gl") == fixed.CUSTOMER_LEG).groupBy("ac_no")
            .agg(F.min("trn_dt").alias("first_dt"), F.max("trn_dt").alias("last_dt"),
                 F.count("trn_ref_no").alias("n")))


def distinct_dates(s: S) -> DataFrame:
    """Distinct posting days that carry a reversal."""
    return (_led(s).where(F.col("event") == fixed.REVERSAL_EVENT)
            .select("trn_dt").distinct())


def fn_dates(s: S) -> DataFrame:
    """Weekday test and DD-MON-YY label of every day."""
    d = F.col("value_date")
    return s.table("calendar").select(
        "value_date", is_weekday(d).alias("weekday"), dd_mon_yy(d).alias("label"))


OPERATOR_QUERIES = {
    "reversal_ref": _q(reversal_ref),
    "reversal_customer": _q(reversal_customer),
    "reversal_ref_code": _q(reversal_ref_code),
    "postable": _q(postable_q),
    "mode_window": _q(mode_window),
    "cash_legs": _q(cash_legs_q),
    "tenor_first": _q(tenor_first),
    "tenor_bucket": _q(tenor_bucket),
    "join_left_chain": _q(join_left_chain),
    "unit_amount": _q(unit_amount_q),
    "case_zone": _q(case_zone),
    "channel_split": _q(channel_split),
    "business_days": _q(business_days_q),
    "asof_max": _q(asof_max),
    "semi_tuple": _q(semi_tuple),
    "opening_cash": _q(opening_cash_q),
    "cash_in_out": _q(cash_in_out_q),
    "deposit_mix": _q(deposit_mix_q),
    "top6_in": _q(top6_in),
    "net_deposit": _q(net_deposit_q),
    "union_head_office": _q(union_head_office),
    "guarded_ratio": _q(guarded_ratio),
    "window_max_partition": _q(window_max_partition),
    "deposit_flows": _q(deposit_flows_q),
    "join_left_default": _q(join_left_default),
    "turnover": _q(turnover_q),
    "net_position": _q(net_position_q),
    "join_multikey_fanout": _q(join_multikey_fanout),
    "new_accounts": _q(new_accounts_q),
    "agg_of_union": _q(agg_of_union),
    "closures": _q(closures_q),
    "join_full_open_close": _q(join_full_open_close),
    "scalar_cross": _q(scalar_cross),
    "account_holders": _q(account_holders_q),
    "internal_accounts": _q(internal_accounts),
    "customer_profile": _q(customer_profile_q),
    "address": _q(address),
    "fn_nvl": _q(fn_nvl),
    "quoted_alias": _q(quoted_alias),
    "scan_ledger": _q(scan_ledger),
    "const_columns": _q(const_columns),
    "between_dates": _q(between_dates),
    "prefix_filter": _q(prefix_filter),
    "substr_type": _q(substr_type),
    "signed_side": _q(signed_side),
    "anti_notin": _q(anti_notin),
    "join_inner_dims": _q(join_inner_dims),
    "agg_sum": _q(agg_sum),
    "agg_minmax_count": _q(agg_minmax_count),
    "distinct_dates": _q(distinct_dates),
    "fn_dates": _q(fn_dates),
}
