"""One run of a report for many parameter values (a backfill).

The parameters are a small relation of their own; the ledger days that any of
them wants are read once, each entry is told which runs it belongs to, and the
run is a grouping key from there on.  The rows are those of one report run for
each value, with the value in front.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark import fixed
from tallyspark.functions.oracle import MONEY
from tallyspark.operators.channels import channel, with_zone
from tallyspark.operators.flows import turnover_of_nets
from tallyspark.operators.ledger import net_by_mode, unit_amount
from tallyspark.operators.relational import salted_join
from tallyspark.operators.reversal import reversed_refs
from tallyspark.plans.reports import turnover_entries

RUN = ("date_from", "date_to")
FAN_OUT_KEYS = ("trn_ref_no", "external_ref_no", "ac_branch", "ac_ccy", "lcy_amount")


def on_days(rows: DataFrame, days: Iterable[date]) -> DataFrame:
    """Rows posted on one of the days; a partition filter on a stored ledger."""
    return rows.where(F.col("trn_dt").isin([F.lit(d) for d in sorted(set(days))]))


def days_of(windows: Iterable[tuple[date, date]]) -> set[date]:
    return {a + timedelta(n) for a, b in windows for n in range((b - a).days + 1)}


def run_days(spark: SparkSession, windows: Iterable[tuple[date, date]]) -> DataFrame:
    """(``date_from``, ``date_to``, ``trn_dt``): the days of each window.
    A window given twice is one run; one that ends before it starts has no day."""
    wanted = sorted({w for w in windows if w[0] <= w[1]})
    runs = F.array(*(F.struct(F.lit(a).alias("date_from"), F.lit(b).alias("date_to")) for a, b in wanted))
    named = spark.range(1).select(F.inline(runs.cast("array<struct<date_from:date,date_to:date>>")))
    return named.withColumn("trn_dt", F.explode(F.sequence("date_from", "date_to")))


# ------------------------------------------------------------------ R7
def gl_turnover_of_days(src, days: Iterable[date], base: str = fixed.BASE_CCY) -> DataFrame:
    """R7 for many days: ``trn_dt`` and the report's columns, in its order for
    each day.  A day without rows gives none; an empty list gives no rows."""
    days = list(days)
    entries = on_days(src.table("ledger_entry"), days)
    rows = turnover_entries(src, entries, on_days(src.table("hot_key"), days))
    out = turnover_of_nets(net_by_mode(rows, run=("trn_dt",)), base=base, run=("trn_dt",))
    return out.orderBy("trn_dt", F.col("gl_code").asc_nulls_last(), F.col("ac_ccy").asc_nulls_last())


# ------------------------------------------------------------------ R2
def _per_key(src, windows, base: str) -> DataFrame:
    """Per run, fan-out key, side and channel: the customer rows' sums
    (``_unit``, ``_lcy``, ``_rows``) and the cash legs (``_legs``)."""
    led = on_days(src.table("ledger_entry"), days_of(windows))
    for k in FAN_OUT_KEYS:
        led = led.where(F.col(k).isNotNull())  # as a join on the keys has it
    vault = (src.table("gl_master").where(F.col("type") == fixed.CASH_GL_TYPE).groupBy(F.col("gl_code").alias("ac_no"))
             .agg(F.count(F.lit(1)).alias("_vault")))
    rows = led.join(vault, "ac_no", "left")
    customer = F.col("cust_gl") == fixed.CUSTOMER_LEG
    counted = ~F.col("trn_code").isin(fixed.SWEEP_CODE) & ~F.col("event").isin(fixed.REVERSAL_EVENT)
    legs = F.when(F.col("_vault").isNotNull() & counted, F.col("_vault")).otherwise(0)
    rows = rows.where(customer | (legs > 0))
    per_day = rows.groupBy("trn_dt", *FAN_OUT_KEYS, "drcr_ind", channel().alias("source")).agg(
        F.sum(F.when(customer, unit_amount(base=base))).alias("_unit"),
        F.sum(F.when(customer, F.col("lcy_amount"))).alias("_lcy"),
        F.count_if(customer).alias("_rows"), F.sum(legs).alias("_legs"))
    # The list has a row for each day of each window that the caller names.
    in_runs = per_day.join(F.broadcast(run_days(src.spark, windows)), "trn_dt")
    return in_runs.groupBy(*RUN, *FAN_OUT_KEYS, "drcr_ind", "source").agg(
        *(F.sum(c).alias(c) for c in ("_unit", "_lcy", "_rows", "_legs")))


def cash_in_out_of_windows(src, windows: Iterable[tuple[date, date]],
                           base: str = fixed.BASE_CCY) -> DataFrame:
    """R2 for many windows, which may overlap: ``date_from``, ``date_to`` and
    the report's columns.

    The days are summed per key, side and channel before any is counted to a
    window, so overlapping windows share the scan and the first aggregate and
    only sums are repeated.  A key's cash legs meet its customer rows of the
    same window by the key, in place of a join of the ledger with itself; a
    reversed reference takes all its keys away.
    """
    windows = list(windows)
    per_key = _per_key(src, windows, base)
    together = Window.partitionBy(*RUN, *FAN_OUT_KEYS)
    met = per_key.withColumn("_n", F.sum("_legs").over(together)).where((F.col("_n") > 0) & (F.col("_rows") > 0))
    refs = reversed_refs(src.table("reversal_entry"), "customer")
    kept = salted_join(met, refs, ["trn_ref_no"], "left_anti", hot=on_days(src.table("hot_key"), days_of(windows)),
                       spread=["ac_branch", "ac_ccy", "lcy_amount", "date_from"])
    placed = with_zone(kept, src.table("branch_group_member"), src.table("branch_group"))
    drcr, n = F.col("drcr_ind"), F.col("_n")
    kind = F.when(drcr == fixed.CREDIT, "Cash_In").when(drcr == fixed.DEBIT, "Cash_Out")
    sums = placed.groupBy(*RUN, "zone", F.col("ac_ccy").alias("currency"), kind.alias("type"), "source").agg(
        F.sum(F.col("_unit") * n).alias("amount_unit"), F.sum(F.col("_lcy") * n).alias("equivalent_mmk"))
    return sums.withColumn("equivalent_usd", F.lit(0).cast(MONEY))
