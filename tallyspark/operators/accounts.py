"""Account and customer operators."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark import fixed
from tallyspark.functions.oracle import char_at, oracle_concat


def _window(c: Column, date_from: date, date_to: date | None) -> Column:
    if date_to is None:
        return c == F.lit(date_from)
    return c.between(F.lit(date_from), F.lit(date_to))


def funded(account: DataFrame, balance: DataFrame) -> DataFrame:
    """Accounts with a positive withdrawable + blocked balance (inner join:
    several balance rows of one account each count)."""
    b = balance.where((F.col("acy_withdrawable_bal") + F.col("acy_blocked_amt")) > 0)
    return account.join(b.select("cust_ac_no"), "cust_ac_no")


def new_accounts(account: DataFrame, balance: DataFrame, first_entry: DataFrame,
                 date_from: date, date_to: date | None = None,
                 keys=("cust_ac_no", "account_class", "branch_code")) -> DataFrame:
    """C17: accounts newly active in the window, as (open_date, acc_no,
    account_class, branch_code).

    Part 1: opened in the window with a positive balance.  Part 2: opened
    outside it (a balance row is required, no amount test) with the first
    ledger entry ever inside it; its ``open_date`` is that entry's date.
    ``keys`` is the grouping of part 2 (the one-day report groups by the
    account number only).  ``first_entry`` holds each account's first
    posting day over all history (the ``first_entry`` side table), so the
    ledger history is not re-aggregated per run.
    """
    opened = _window(F.col("ac_open_date"), date_from, date_to)
    part1 = funded(account.where(opened), balance).select(
        F.col("ac_open_date").alias("open_date"), F.col("cust_ac_no").alias("acc_no"),
        "account_class", "branch_code")
    # Part 2 is driven by the few accounts whose first entry falls in the
    # window; the account and balance tables are only probed for them.
    first = (first_entry.where(_window(F.col("first_dt"), date_from, date_to))
             .select(F.col("ac_no").alias("cust_ac_no"), "first_dt"))
    candidates = account.where(~opened).join(first.select("cust_ac_no"), "cust_ac_no",
                                             "left_semi")
    with_bal = candidates.join(balance.select("cust_ac_no"), "cust_ac_no", "left_semi")
    part2 = with_bal.select(*keys).distinct().join(first, "cust_ac_no")
    cols = [F.col("first_dt").alias("open_date"), F.col("cust_ac_no").alias("acc_no")]
    cols += [F.col(k) if k in keys else F.lit(None).cast("string").alias(k)
             for k in ("account_class", "branch_code")]
    return part1.unionByName(part2.select(*cols))


def closures(closure: DataFrame, account: DataFrame, date_from: date,
             date_to: date | None = None) -> DataFrame:
    """Accounts closed in the window, except same-day open-and-close."""
    c = closure.where(_window(F.col("closing_date"), date_from, date_to))
    a = account.select("cust_ac_no", "ac_open_date", "branch_code", "account_class")
    return (c.join(a, c.ac_no == a.cust_ac_no)
            .where(F.col("closing_date") != F.col("ac_open_date"))
            .select("ac_open_date", "ac_no", "closing_date", "branch_code", "account_class"))


def open_close(opened: DataFrame, closed: DataFrame, account_class: DataFrame,
               date_from: date, date_to: date) -> DataFrame:
    """opened/closed counts per branch, opening date, closing date and
    product, from a full outer join of openings and closures by account
    (the opening side wins).  An account opened and closed in the window
    counts as closed only."""
    o = opened.select(F.col("branch_code").alias("o_branch"), F.col("open_date").alias("o_open"),
                      F.col("acc_no").alias("o_acc"), F.col("account_class").alias("o_class"))
    c = closed.select(F.col("branch_code").alias("c_branch"), F.col("ac_open_date").alias("c_open"),
                      F.col("ac_no").alias("c_acc"), F.col("account_class").alias("c_class"),
                      "closing_date")
    j = o.join(c, o.o_acc == c.c_acc, "full").select(
        F.coalesce("o_branch", "c_branch").alias("branch_code"),
        F.coalesce("o_open", "c_open").alias("openingdate"),
        F.col("closing_date").alias("closingdate"),
        F.coalesce("o_acc", "c_acc").alias("acc_no"),
        F.coalesce("o_class", "c_class").alias("account_class"))
    j = j.join(account_class.select("account_class", "description"), "account_class")
    g = j.groupBy("branch_code", "openingdate", "closingdate", "description").agg(
        F.count("acc_no").alias("n"))
    in_win_open = F.col("openingdate").between(F.lit(date_from), F.lit(date_to))
    in_win_close = F.col("closingdate").between(F.lit(date_from), F.lit(date_to))
    zero = F.lit(0).cast("bigint")
    return g.select(
        "branch_code", "openingdate", "description",
        F.when(in_win_open & F.col("closingdate").isNull(), F.col("n")).otherwise(zero)
         .alias("totalopened"),
        F.when(in_win_close, F.col("n")).otherwise(zero).alias("totalclosed"),
        "closingdate")


# ------------------------------------------------------------------ eKYC
def account_holders(account: DataFrame, joint: DataFrame) -> DataFrame:
    """One row per (account, holder): the primary holder of every
    account plus each joint holder of a joint account."""
    cols = ["branch_code", "cust_ac_no", "cust_no", "ac_open_date", "joint_ac_indicator"]
    primary = account.select(*cols)
    j = (account.where(F.col("joint_ac_indicator") == fixed.JOINT_ACCOUNT)
         .select("branch_code", "cust_ac_no", "ac_open_date", "joint_ac_indicator")
         .join(joint.select("cust_ac_no", F.col("joint_holder_code").alias("cust_no")),
               "cust_ac_no"))
    return primary.unionByName(j.select(*cols))


def exclude_internal(df: DataFrame, col: str = "cust_ac_no") -> DataFrame:
    """Drop internal (nostro) accounts, 6th character '5'.  An account
    too short to have one is dropped too (the test is NULL)."""
    return df.where(char_at(col, 6) != fixed.INTERNAL_ACCOUNT_DIGIT)


def with_customer_details(rows: DataFrame, personal: DataFrame, corporate: DataFrame,
                          professional: DataFrame) -> DataFrame:
    """Attach personal, corporate and professional details to rows that
    carry ``customer_no`` and ``customer_type`` (left joins on the customer
    number); the birth date is the incorporation date for non-individuals.

    Called on the rows actually needed (e.g. the holders of the report's
    accounts), so the large detail tables are only probed for those
    customers -- runtime bloom filters prune their scans -- instead of being
    joined in full first.
    """
    p = personal.select("customer_no", "customer_prefix", "date_of_birth", "telephone",
                        "mobile_number")
    k = corporate.select("customer_no", "incorp_date")
    d = professional.select("customer_no", "designation")
    j = rows.join(p, "customer_no", "left").join(k, "customer_no", "left").join(
        d, "customer_no", "left")
    dob = (F.when(F.col("customer_type") == fixed.CUSTOMER_INDIVIDUAL, F.col("date_of_birth"))
            .otherwise(F.col("incorp_date")))
    return j.withColumn("date_of_birth", dob).drop("incorp_date")


CUSTOMER_COLUMNS = ("customer_no", "customer_type", "full_name", "unique_id_name",
                    "unique_id_value", "address_line1", "address_line2", "address_line3",
                    "address_line4")


def customer_profile(customer: DataFrame, personal: DataFrame, corporate: DataFrame,
                     professional: DataFrame) -> DataFrame:
    """The customer master with its personal, corporate and professional
    details (every customer)."""
    return with_customer_details(customer.select(*CUSTOMER_COLUMNS), personal, corporate,
                                 professional)


def format_address(l1="address_line1", l2="address_line2", l3="address_line3",
                   l4="address_line4") -> Column:
    """``l1, l2, l3, l4`` with Oracle concatenation (NULL lines vanish,
    their separators stay; the separator after line 2 only when it is
    present), then ``',,'`` collapsed to ``','``."""
    c2 = F.col(l2)
    sep2 = F.when(c2.isNotNull(), F.lit(", "))
    joined = oracle_concat(F.col(l1), F.lit(", "), c2, sep2, F.col(l3), F.lit(", "), F.col(l4))
    return F.replace(joined, F.lit(",,"), F.lit(","))


def holder_type(customer_type="customer_type", joint="joint_ac_indicator") -> Column:
    t, j = F.col(customer_type), F.col(joint)
    return (F.when((t == fixed.CUSTOMER_INDIVIDUAL) & (j == fixed.SINGLE_ACCOUNT), "Individual")
             .when((t == fixed.CUSTOMER_INDIVIDUAL) & (j == fixed.JOINT_ACCOUNT), "Joint")
             .when(t == fixed.CUSTOMER_CORPORATE, "Corporate"))
