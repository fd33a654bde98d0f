"""Plan properties that matter at scale, and the stored-catalog path."""

from __future__ import annotations

import io
import re
from contextlib import redirect_stdout

import pytest

import __spark_entry__ as entry
from tallyspark.plans import params as P
from tallyspark.plans import reports as R
from tallyspark.sources import ParquetSource, materialize
from tests.conftest import SMALL
from tests.test_skew import conf
from tools.compare import _norm

QUERIES = {k: f for k, f in entry.queries().items() if k not in entry._corpus_queries()}


def plan_of(df, mode="formatted") -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairwise_or_python_operators(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL), "extended")
    for bad in ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython",
                "ArrowEvalPython", "FlatMapGroupsInPandas"):
        assert bad not in plan, f"{name}: {bad}"


@pytest.fixture(scope="module")
def stored(spark, small_source, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("catalog"))
    return materialize(small_source, root)


REPORTS = {
    "cash_monitor": lambda s: R.cash_monitor(s, P.CASH_MONITOR_BEFORE,
                                             head_office_label=P.HEAD_OFFICE_LABEL),
    "cash_in_out": lambda s: R.cash_in_out_by_zone(s, P.ZONE_FROM, P.ZONE_TO),
    "ekyc": lambda s: R.ekyc(s, P.EKYC_FROM, P.EKYC_TO),
    "liquidity": lambda s: R.liquidity(s, P.LIQUIDITY_AS_OF, P.LIQUIDITY_CODES),
    "new_deposit": lambda s: R.new_deposit(s, P.NEW_DEPOSIT_DAY),
    "open_close": lambda s: R.open_close_counts(s, P.OPEN_CLOSE_FROM, P.OPEN_CLOSE_TO),
    "turnover": lambda s: R.gl_turnover(s, P.TURNOVER_DAY),
}


def rows(df):
    return sorted((tuple(_norm(v) for v in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_stored_catalog_gives_the_same_reports(small_source, stored, name):
    build = REPORTS[name]
    assert rows(build(stored)) == rows(build(small_source))


def test_daily_report_prunes_ledger_partitions(stored):
    plan = plan_of(R.turnover_working_set(stored, P.TURNOVER_DAY))
    assert "PartitionFilters: [isnotnull(trn_dt" in plan and "= 2024-01-10" in plan


def test_filters_reach_the_scan(stored):
    plan = plan_of(R.cash_in_out_by_zone(stored, P.ZONE_FROM, P.ZONE_TO))
    assert "Not(EqualTo(trn_code,SWP))" in plan


#: The columns that the widest ledger scan of each report may read.
LEDGER_COLUMNS = {
    "cash_monitor": {"trn_ref_no", "ac_entry_sr_no", "ac_branch", "ac_no", "drcr_ind", "lcy_amount"},
    "cash_in_out": {"trn_ref_no", "ac_entry_sr_no", "external_ref_no", "ac_branch", "cust_gl", "drcr_ind",
                    "ac_ccy", "trn_code", "lcy_amount", "fcy_amount"},
    "new_deposit": {"trn_ref_no", "ac_entry_sr_no", "ac_branch", "ac_no", "cust_gl", "drcr_ind", "ac_ccy",
                    "lcy_amount", "fcy_amount"},
    "turnover": {"trn_ref_no", "ac_entry_sr_no", "event", "ac_branch", "ac_no", "drcr_ind", "ac_ccy",
                 "trn_code", "lcy_amount", "fcy_amount", "auth_stat"},
}


@pytest.mark.parametrize("name", sorted(LEDGER_COLUMNS))
def test_main_ledger_scan_reads_only_what_it_needs(stored, name):
    plan = plan_of(REPORTS[name](stored))
    scans = re.findall(r"Location: InMemoryFileIndex\S* ?\[[^\]]*/ledger_entry/[^\]]*\].*?ReadSchema: struct<([^>]*)>",
                       plan, re.S)
    assert scans
    widest = max((set(re.findall(r"(\w+):", s)) for s in scans), key=len)
    assert widest == LEDGER_COLUMNS[name]


def test_turnover_is_lazy(stored):
    tracker = stored.spark.sparkContext.statusTracker()
    stored.spark.sparkContext.setJobGroup("build", "build")
    try:
        plan = plan_of(R.gl_turnover(stored, P.TURNOVER_DAY))
        assert not tracker.getJobIdsForGroup("build")
    finally:
        stored.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert "ExistingRDD" not in plan


def test_reversal_keys_are_cut_down_before_they_are_made_distinct(spark, stored):
    from tallyspark.operators.reversal import exclude_reversed
    from tallyspark.operators.ledger import in_window
    with conf(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        window = in_window(stored.table("ledger_entry"), P.ZONE_FROM, P.ZONE_TO)
        plan = plan_of(exclude_reversed(window, stored.table("reversal_entry"), "customer"), "extended")
    optimized = plan[plan.index("== Optimized Logical Plan =="):plan.index("== Physical Plan ==")]
    semi = next(line for line in optimized.splitlines() if "LeftSemi" in line)
    above = optimized[:optimized.index(semi)]
    assert "Aggregate" in above or "Distinct" in above


def test_parquet_source_reads_remote_root(spark, stored):
    src = ParquetSource(spark, "/nonexistent-local-root", remote_root=stored.root)
    assert src.table("ledger_entry").count() > 0


def test_snapshot_scan_is_pruned_to_the_report_days(stored):
    from tallyspark.operators import deposits as dep
    days, prior = R.monitor_days(stored, P.CASH_MONITOR_BEFORE)
    plan = plan_of(dep.deposit_mix(stored.table("balance_history"), days))
    assert "PartitionFilters: [isnotnull(bkg_date" in plan and "array_contains(Subquery" in plan
    plan = plan_of(dep.cash_in_out(stored.table("ledger_entry"), stored.table("gl_account"),
                                   stored.table("branch"), days,
                                   stored.table("reversal_entry"), stored.table("cash_touch")))
    assert "PartitionFilters: [isnotnull(trn_dt" in plan and "array_contains(Subquery" in plan


def scans(plan, relation):
    """(folders, partition filters) of the plan's scans of a relation."""
    found = re.findall(r"Location: InMemoryFileIndex\S* ?\[([^\]]*/" + relation + r"/[^\]]*)\]\n(PartitionFilters: .*)?",
                       plan)
    return found


@pytest.mark.parametrize("build, ledger, reversals", [
    (lambda s: R.gl_turnover(s, P.TURNOVER_DAY), 1, 1),
    (lambda s: R.cash_in_out_by_zone(s, P.ZONE_FROM, P.ZONE_TO), 2, 1),
    (lambda s: R.new_deposit(s, P.NEW_DEPOSIT_DAY), 2, 0)], ids=["turnover", "cash_in_out", "new_deposit"])
def test_a_report_reads_its_days_once_for_each_side(stored, build, ledger, reversals):
    """Hot keys by their stored counts: no scan to find or cut down keys."""
    plan = plan_of(build(stored))
    assert len(scans(plan, "ledger_entry")) == ledger
    assert len(scans(plan, "reversal_entry")) == reversals
    assert all("trn_dt" in f for _, f in scans(plan, "ledger_entry"))


def test_cash_monitor_reads_the_reversals_once(stored):
    plan = plan_of(R.cash_monitor(stored, P.CASH_MONITOR_BEFORE, head_office_label=P.HEAD_OFFICE_LABEL))
    plan = plan.split("===== Subqueries")[0]  # below, dynamic pruning names the joins it takes its days from
    assert len(scans(plan, "reversal_entry")) == len(scans(plan, "ledger_entry")) == 1


def test_liquidity_reads_one_period_and_the_days_since(small_source, tmp_path):
    src = materialize(small_source, str(tmp_path), period="week")
    assert src.last_period_end(P.LIQUIDITY_AS_OF) == P.LIQUIDITY_AS_OF.replace(day=28)
    for as_of in (P.LIQUIDITY_AS_OF, P.LIQUIDITY_AS_OF.replace(day=24), P.LIQUIDITY_AS_OF.replace(day=3)):
        for codes in (P.LIQUIDITY_CODES, None):
            assert rows(R.liquidity(src, as_of, codes)) == rows(R.liquidity(small_source, as_of, codes))
    plan = plan_of(R.liquidity(src, P.LIQUIDITY_AS_OF.replace(day=24), P.LIQUIDITY_CODES))
    (_, days), (_, period) = *scans(plan, "authorised_daily"), *scans(plan, "period_balance")
    assert "trn_dt" in days and "> 2024-01-21" in days and "<= 2024-01-24" in days
    assert "= 2024-01-21" in period
    assert "DynamicPruning" not in days and len(scans(plan, "ledger_entry")) == 0


def test_liquidity_reads_the_rollup_once(small_source, stored):
    plan = plan_of(R.liquidity(stored, P.LIQUIDITY_AS_OF, P.LIQUIDITY_CODES))
    assert len(scans(plan, "authorised_daily")) == 1
    raw = plan_of(R.liquidity(small_source, P.LIQUIDITY_AS_OF, P.LIQUIDITY_CODES))
    assert len(re.findall(r"Location: .*lineitem", raw)) == 1
