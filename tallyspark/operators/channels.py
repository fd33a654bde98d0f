"""Branch zones and transaction channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark import fixed


def open_branch_groups(member: DataFrame, group: DataFrame) -> DataFrame:
    """(branch_code, branch_group_code) for groups that are open.

    A branch in several open groups appears several times, and rows joined
    to it fan out accordingly -- that is the reports' rule, kept.
    """
    open_groups = group.where(F.col("record_stat") == fixed.OPEN_RECORD).select(
        "branch_group_code")
    return member.select("branch_code", "branch_group_code").join(
        open_groups, "branch_group_code")


def zone_of(group_code="branch_group_code") -> Column:
    g = F.col(group_code)
    out = None
    for code, label in fixed.ZONES:
        out = F.when(g == code, label) if out is None else out.when(g == code, label)
    return out.otherwise(fixed.OTHER_ZONE)


def with_zone(df: DataFrame, member: DataFrame, group: DataFrame,
              branch_col: str = "ac_branch") -> DataFrame:
    """Attach ``zone`` through the branch's open groups (inner join:
    rows of a branch without an open group drop out)."""
    groups = open_branch_groups(member, group).withColumnRenamed("branch_code", branch_col)
    return df.join(groups, branch_col).withColumn("zone", zone_of()).drop("branch_group_code")


def channel(trn_code="trn_code") -> Column:
    """ATM for the ten ATM/POS transaction codes, Branch otherwise."""
    return F.when(F.col(trn_code).isin(*fixed.ATM_TRN_CODES), "ATM").otherwise("Branch")
