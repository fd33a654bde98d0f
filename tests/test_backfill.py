"""One run for many parameter values equals a run for each."""

from __future__ import annotations

from datetime import date, timedelta

import pytest

from tallyspark.plans import backfill as B
from tallyspark.plans import params as P
from tallyspark.plans import reports as R
from tallyspark.sources import materialize
from tests.conftest import nullable
from tests.test_plans import plan_of, rows, scans
from tools.compare import _norm


@pytest.fixture(scope="module")
def stored(spark, small_source, tmp_path_factory):
    return materialize(small_source, str(tmp_path_factory.mktemp("backfill")))


def single(build, values):
    """The rows of one run for each value, with the value's text in front."""
    found = []
    for v in values:
        front = tuple(_norm(x) for x in (v if isinstance(v, tuple) else (v,)))
        found += [front + r for r in rows(build(v))]
    return sorted(found, key=repr)


def test_twenty_days_of_turnover_equal_twenty_runs(stored):
    got = B.gl_turnover_of_days(stored, P.BACKFILL_DAYS)
    want = single(lambda d: R.gl_turnover(stored, d), P.BACKFILL_DAYS)
    assert len(P.BACKFILL_DAYS) == 20 and want
    assert rows(got) == want


def test_windows_of_cash_in_out_equal_a_run_for_each(stored):
    days = [(d, d) for d in P.BACKFILL_DAYS]
    windows = [*days, *P.BACKFILL_WINDOWS]
    got = rows(B.cash_in_out_of_windows(stored, windows))
    assert got == single(lambda w: R.cash_in_out_by_zone(stored, *w), sorted(set(windows)))


@pytest.mark.parametrize("build", [
    lambda s: B.gl_turnover_of_days(s, P.BACKFILL_DAYS),
    lambda s: B.cash_in_out_of_windows(s, P.BACKFILL_WINDOWS)], ids=["turnover", "cash_in_out"])
def test_each_ledger_day_is_read_once(stored, build):
    plan = plan_of(build(stored)).split("===== Subqueries")[0]
    found = scans(plan, "ledger_entry")
    assert len(found) == len(scans(plan, "reversal_entry")) == 1
    assert "trn_dt" in found[0][1] and "2024-01-14" in found[0][1]


def test_no_values_no_rows(stored):
    none = (date(2024, 1, 5), date(2024, 1, 4))
    assert rows(B.gl_turnover_of_days(stored, [])) == []
    assert rows(B.cash_in_out_of_windows(stored, [none])) == []
    assert rows(B.cash_in_out_of_windows(stored, [])) == []
    assert rows(B.gl_turnover_of_days(stored, [date(1999, 1, 1)])) == []


def entry(**over):
    base = dict(trn_ref_no="T1", external_ref_no="E1", ac_entry_sr_no=1, event="INIT", ac_branch="001",
                ac_no="2100", cust_gl="A", drcr_ind="C", ac_ccy="MMK", trn_code="CDP", lcy_amount=10,
                fcy_amount=None, trn_dt=date(2024, 1, 10), auth_stat="A")
    return base | over


def test_legs_meet_across_days_of_a_window_only(spark, small_source, fixture_source):
    """Cash leg and customer row on two days meet where one window has both;
    NULL keys meet nothing; a customer leg on a vault counts as both sides; a
    reversal outside the windows takes the reference away."""
    from decimal import Decimal
    schema = nullable(small_source.table("ledger_entry").schema)
    d = date(2024, 1, 10)
    made = [
        entry(), entry(ac_no="9000", cust_gl="G", drcr_ind="D", trn_dt=d + timedelta(1)),
        entry(ac_no="9000", cust_gl="G", drcr_ind="D", trn_dt=d + timedelta(1), ac_entry_sr_no=2),
        entry(trn_ref_no="T2", external_ref_no=None), entry(trn_ref_no="T2", external_ref_no=None, ac_no="9000", cust_gl="G"),
        entry(trn_ref_no="T3", ac_no="9000"),
        entry(trn_ref_no="T4"), entry(trn_ref_no="T4", ac_no="9000", cust_gl="G"),
        entry(trn_ref_no="T4", event="REVR", trn_dt=d + timedelta(30)),
        entry(trn_ref_no="T5", ac_ccy="USD"), entry(trn_ref_no="T5", ac_ccy="USD", ac_no="9000", cust_gl="G", trn_code="SWP"),
        entry(trn_ref_no="T6", ac_ccy="USD"), entry(trn_ref_no="T6", ac_ccy="USD", ac_no="9000", cust_gl="G"),
    ]
    led = [tuple(Decimal(v) if isinstance(v := r.get(f.name), int) and "decimal" in f.dataType.simpleString()
                 else v for f in schema.fields) for r in made]
    src = fixture_source(
        ledger_entry=led, gl_master=spark.createDataFrame([("9000", "5")], "gl_code string, type string"),
        branch_group_member=spark.createDataFrame([("001", "YGN"), ("001", "MDY")], "branch_code string, branch_group_code string"),
        branch_group=spark.createDataFrame([("YGN", "O"), ("MDY", "O")], "branch_group_code string, record_stat string"))
    windows = [(d, d), (d, d + timedelta(1)), (d + timedelta(1), d + timedelta(1))]
    got = rows(B.cash_in_out_of_windows(src, windows))
    assert got == single(lambda w: R.cash_in_out_by_zone(src, *w), windows)
    assert {r[:2] for r in got} == {tuple(_norm(x) for x in w) for w in windows[:2]}
