"""Side tables of the ledger.

Three report rules look at the WHOLE ledger history, not at the report
window: reversal removal (a reversal can be posted days later), the
"transaction touches branch cash" test and the "first entry ever" date of an
account.  Scanning a multi-year ledger for each report run is the dominant
cost at scale, so these small relations are derived once at ingest (and
appended day by day) next to the day-partitioned ledger:

``reversal_entry``   the reversal rows (event REVR), narrow projection
``cash_touch``       distinct (reference, branch) having a vault-cash leg
``first_entry``      first posting day per account
``authorised_daily`` authorised debit/credit sums per day, account, leg and
                     currency -- the as-of position (liquidity report) sums
                     these instead of every entry of the history
``first_snapshot``   first vault-cash snapshot day per branch (of the balance
                     history, not of the ledger)
``entry_key``, ``snapshot_key``  the accounts (branches) of each day, from which
                     a correction finds an account's next first day
``reversal_count``   rows and NULL references among a day's reversals: the
                     NULL rule of NOT IN without reading the reversals again
``hot_key``          references and accounts with very many entries on a day

``period_balance`` is kept beside them by the ingest: running sums per account,
leg and currency at the end of each closed period.

Each is a few percent of the ledger or smaller (one row per account for
``first_entry``, one per active account and day for ``authorised_daily``).
``TestdataSource`` derives them on the fly from its ledger;
``ParquetSource`` reads the stored copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyspark import fixed
from tallyspark.sources.manifest import no_rows

DERIVED = ("reversal_entry", "reversal_count", "cash_touch", "entry_key", "first_entry", "hot_key",
           "authorised_daily", "snapshot_key", "first_snapshot")
#: Side tables whose rows of a day come from that day's rows alone.
PER_DAY = ("reversal_entry", "reversal_count", "cash_touch", "entry_key", "hot_key", "authorised_daily")
#: Relation that each side table is derived from, where it is not the ledger.
DERIVED_FROM = {"first_snapshot": "balance_history", "snapshot_key": "balance_history"}
#: The keys of each day that a first-day table is the minimum of.
KEYS_OF = {"first_entry": "entry_key", "first_snapshot": "snapshot_key"}
#: Grain and sums of a position.
POSITION = ("ac_no", "cust_gl", "ac_ccy")
SIDES = ("d_lcy", "c_lcy", "d_fcy", "c_fcy")
#: Entries of a day from which on a key counts as hot, and the most such keys
#: that are kept for a day and kind (which keys are picked changes no result).
HOT_ROWS, MOST_HOT = 100_000, 1000
#: Stored columns, so that a table without any row yet can be read.
SCHEMAS = {
    "reversal_entry": "trn_ref_no string, trn_code string, cust_gl string, auth_stat string, "
                      "event string, ac_branch string, trn_dt date",
    "cash_touch": "trn_ref_no string, ac_branch string, trn_dt date",
    "first_entry": "ac_no string, first_dt date",
    "authorised_daily": "ac_no string, cust_gl string, ac_ccy string, d_lcy decimal(32,3), "
                        "c_lcy decimal(32,3), d_fcy decimal(32,3), c_fcy decimal(32,3), trn_dt date",
    "first_snapshot": "branch_code string, first_dt date",
    "entry_key": "ac_no string, trn_dt date",
    "snapshot_key": "branch_code string, bkg_date date",
    "reversal_count": "trn_dt date, n long, n_null long",
    "hot_key": "kind string, key string, n long, trn_dt date",
    "period_balance": "ac_no string, cust_gl string, ac_ccy string, d_lcy decimal(38,3), c_lcy decimal(38,3), "
                      "d_fcy decimal(38,3), c_fcy decimal(38,3), n_days long, period_end date",
}
# Stored layout: every day-grained relation is partitioned by its day, so a
# day's ingest rewrites only its own partitions and readers prune by date.
PARTITION_COLUMN = {"ledger_entry": "trn_dt", "reversal_entry": "trn_dt",
                    "cash_touch": "trn_dt", "authorised_daily": "trn_dt",
                    "reversal_count": "trn_dt", "entry_key": "trn_dt", "hot_key": "trn_dt",
                    "first_entry": "first_dt", "first_snapshot": "first_dt",
                    "snapshot_key": "bkg_date", "period_balance": "period_end",
                    "balance_history": "bkg_date"}


def reversal_entry(ledger: DataFrame) -> DataFrame:
    return (ledger.where(F.col("event") == fixed.REVERSAL_EVENT)
            .select("trn_ref_no", "trn_code", "cust_gl", "auth_stat", "event", "ac_branch",
                    "trn_dt"))


def cash_touch(ledger: DataFrame) -> DataFrame:
    """(reference, branch, day) with a vault-cash leg; readers use it as a
    semi-join key set, for which repeats across days are harmless."""
    return (ledger.where(F.col("ac_no").startswith(fixed.CASH_GL_PREFIX))
            .select("trn_ref_no", "ac_branch", "trn_dt").distinct())


def reversal_count(ledger: DataFrame) -> DataFrame:
    """Per day with reversals: their number, and how many have no reference."""
    return reversal_entry(ledger).groupBy("trn_dt").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("trn_ref_no").isNull()).alias("n_null"))


def entry_key(ledger: DataFrame) -> DataFrame:
    """The accounts with an entry on each day."""
    return (ledger.where(F.col("ac_no").isNotNull() & F.col("trn_dt").isNotNull())
            .select("ac_no", "trn_dt").distinct())


def first_entry(ledger: DataFrame) -> DataFrame:
    """min(trn_dt) per account that has a dated entry."""
    return (ledger.where(F.col("ac_no").isNotNull() & F.col("trn_dt").isNotNull())
            .groupBy("ac_no").agg(F.min("trn_dt").alias("first_dt")))


def hot_key(ledger: DataFrame) -> DataFrame:
    """The references and accounts with ``HOT_ROWS`` entries or more on a day,
    the ``MOST_HOT`` most frequent of each kind and day."""
    found = None
    for kind in ("trn_ref_no", "ac_no"):
        counts = (ledger.where(F.col(kind).isNotNull()).groupBy("trn_dt", F.col(kind).alias("key"))
                  .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT_ROWS)
                  .select(F.lit(kind).alias("kind"), "key", "n", "trn_dt"))
        found = counts if found is None else found.unionByName(counts)
    most = Window.partitionBy("trn_dt", "kind").orderBy(F.col("n").desc(), "key")
    return found.withColumn("_r", F.row_number().over(most)).where(F.col("_r") <= MOST_HOT).drop("_r")


def snapshot_key(history: DataFrame) -> DataFrame:
    """The branches with a vault-cash snapshot on each day."""
    return (history.where((F.col("account") == fixed.CASH_GL) & F.col("branch_code").isNotNull()
                          & F.col("bkg_date").isNotNull()).select("branch_code", "bkg_date").distinct())


def first_snapshot(history: DataFrame) -> DataFrame:
    """min(bkg_date) of the vault-cash GL per branch."""
    cash = history.where((F.col("account") == fixed.CASH_GL) & F.col("branch_code").isNotNull()
                         & F.col("bkg_date").isNotNull())
    return cash.groupBy("branch_code").agg(F.min("bkg_date").alias("first_dt"))


def authorised_daily(ledger: DataFrame) -> DataFrame:
    """Sums of authorised entries per (day, account, leg, currency), debit
    and credit apart, local and foreign amount apart.  A sum over no
    non-NULL amount stays NULL, exactly as a sum over the entries would."""
    drcr = F.col("drcr_ind")

    def part(side, amount):
        return F.sum(F.when(drcr == side, F.col(amount)))

    return (ledger.where(F.col("auth_stat") == fixed.AUTHORISED)
            .groupBy("trn_dt", "ac_no", "cust_gl", "ac_ccy")
            .agg(part(fixed.DEBIT, "lcy_amount").alias("d_lcy"),
                 part(fixed.CREDIT, "lcy_amount").alias("c_lcy"),
                 part(fixed.DEBIT, "fcy_amount").alias("d_fcy"),
                 part(fixed.CREDIT, "fcy_amount").alias("c_fcy")))


def empty(spark: SparkSession, name: str) -> DataFrame:
    """A side table without rows."""
    return no_rows(spark, T.StructType.fromDDL(SCHEMAS[name]))


def derive(name: str, rows: DataFrame) -> DataFrame:
    """The side table ``name`` of the ledger (or of the relation that
    ``DERIVED_FROM`` names)."""
    return {"reversal_entry": reversal_entry, "reversal_count": reversal_count, "cash_touch": cash_touch,
            "entry_key": entry_key, "first_entry": first_entry, "hot_key": hot_key,
            "authorised_daily": authorised_daily, "snapshot_key": snapshot_key,
            "first_snapshot": first_snapshot}[name](rows)
