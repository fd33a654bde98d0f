"""Daily ingest: corrections, late days, empty side tables, broken runs."""

from __future__ import annotations

import datetime as dt
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.sources import (ParquetSource, derived, ingest_day, ingest_snapshot_day, manifest,
                                normalise, parquet, sweep, write_relation)
from tallyspark.operators.flows import net_position
from tallyspark.plans import reports
from tests.test_plans import rows
from tests.test_semantics import ledger

DAYS = [date(2024, 1, 1) + timedelta(d) for d in range(4)]


def check_sides(spark, root, names=(*derived.PER_DAY, "first_entry")):
    src = ParquetSource(spark, root)
    led = src.table("ledger_entry")
    for name in names:
        got, want = src.table(name), derived.derive(name, led)
        cols = sorted(want.columns)
        assert rows(got.select(*cols)) == rows(want.select(*cols)), name
    return src


def entries(spark, small_source, *rows_):
    return ledger(spark, small_source, *rows_)


def test_days_once_and_again(spark, small_source, tmp_path):
    led = small_source.table("ledger_entry")
    for d in DAYS[:3] + DAYS[2:3]:
        ingest_day(led.where(F.col("trn_dt") == F.lit(d)), str(tmp_path), d)
    src = check_sides(spark, str(tmp_path))
    part = led.where(F.col("trn_dt") <= F.lit(DAYS[2]))
    cols = sorted(part.columns)
    assert rows(src.table("ledger_entry").select(*cols)) == rows(part.select(*cols))


def test_a_correction_takes_reversals_away(spark, small_source, tmp_path):
    d = DAYS[0]
    ingest_day(entries(spark, small_source, dict(trn_dt=d, event="REVR"), dict(trn_dt=d, trn_ref_no="T2")),
               str(tmp_path), d)
    assert ParquetSource(spark, str(tmp_path)).table("reversal_entry").count() == 1
    ingest_day(entries(spark, small_source, dict(trn_dt=d)), str(tmp_path), d)
    assert ParquetSource(spark, str(tmp_path)).table("reversal_entry").count() == 0
    check_sides(spark, str(tmp_path))


def test_first_day_without_reversals_can_be_read(spark, small_source, tmp_path):
    d = DAYS[0]
    ingest_day(entries(spark, small_source, dict(trn_dt=d)), str(tmp_path), d)
    src = check_sides(spark, str(tmp_path))
    assert src.table("reversal_entry").columns


def test_a_late_day_moves_first_entries(spark, small_source, tmp_path):
    early, late = DAYS[0], DAYS[1]
    for d in (late, early):
        ingest_day(entries(spark, small_source, dict(trn_dt=d, ac_no="A"),
                           dict(trn_dt=d, ac_no=f"only-{d}")), str(tmp_path), d)
    src = check_sides(spark, str(tmp_path))
    assert [r["first_dt"] for r in src.table("first_entry").where("ac_no = 'A'").collect()] == [early]


def test_an_account_leaves_its_first_day(spark, small_source, tmp_path):
    for d in DAYS[:2]:
        ingest_day(entries(spark, small_source, dict(trn_dt=d, ac_no="A"), dict(trn_dt=d, ac_no="B")),
                   str(tmp_path), d)
    ingest_day(entries(spark, small_source, dict(trn_dt=DAYS[0], ac_no="B")), str(tmp_path), DAYS[0])
    src = check_sides(spark, str(tmp_path))
    assert [r["first_dt"] for r in src.table("first_entry").where("ac_no = 'A'").collect()] == [DAYS[1]]


def state(spark, root):
    """Every relation's rows as readers see them, and the liquidity report."""
    src = ParquetSource(spark, root)
    names = ("ledger_entry", *derived.PER_DAY, "first_entry")
    seen = {n: rows(src.table(n).select(*sorted(src.table(n).columns))) for n in names}
    return seen | {"position": position(src)}


def position(src, as_of=date(2024, 12, 31)):
    return rows(reports.liquidity(Named(src), as_of))


class Named:
    """A catalog with small dimensions, for the reports that need them."""

    def __init__(self, src):
        self.src, self.spark = src, src.spark
        self.last_period_end = src.last_period_end

    def table(self, name):
        dims = {"account_gl_map": ([("A", "21010010001")], "ac_gl_no string, ac_natural_gl string"),
                "deposit_term": ([("A", 30, None, None)], "acc string, orig_tenor_days int, "
                                                          "orig_tenor_months int, orig_tenor_years int")}
        return self.spark.createDataFrame(*dims[name]) if name in dims else self.src.table(name)


def plain_position(src, as_of):
    named = Named(src)
    daily = derived.authorised_daily(src.table("ledger_entry")).where(F.col("trn_dt") <= F.lit(as_of))
    return rows(net_position(daily, named.table("account_gl_map"), named.table("deposit_term")))


def test_a_run_may_break_off_at_every_write(spark, small_source, tmp_path, monkeypatch):
    root, d = str(tmp_path), date(2024, 1, 1)
    for k, day in enumerate((d, date(2024, 1, 9), date(2024, 1, 17))):
        ingest_day(entries(spark, small_source, dict(trn_dt=day, ac_no="A"), dict(trn_dt=day, ac_no=f"only-{k}")),
                   root, day, period="week")
    new = entries(spark, small_source, dict(trn_dt=d, event="REVR"), dict(trn_dt=d, trn_ref_no="T9", ac_no="C"))
    old, listed = state(spark, root), manifest.Manifest.latest(spark, root).relations
    real, places = manifest.write_rows, []

    def counted(writer, path):
        places.append(path)
        if len(places) == broken:
            raise OSError("no space")
        real(writer, path)

    monkeypatch.setattr(manifest, "write_rows", counted)
    for broken in range(1, 40):
        places.clear()
        try:
            ingest_day(new, root, d, period="week")
        except OSError:
            assert manifest.Manifest.latest(spark, root).relations == listed, places[-1]
            if broken % 4 == 1:
                assert state(spark, root) == old, places[-1]
            continue
        break
    written = {p.removeprefix(root).split("/")[1] for p in places}
    assert broken == len(places) + 1
    assert written == {"ledger_entry", "first_entry", "period_balance", *derived.PER_DAY}
    src = check_sides(spark, root)
    assert [r["first_dt"] for r in src.table("first_entry").where("ac_no = 'A'").collect()] == [date(2024, 1, 9)]
    for as_of in (d, date(2024, 1, 8), date(2024, 1, 9), date(2024, 1, 30)):
        assert position(src, as_of) == plain_position(src, as_of)


def test_the_manifest_is_the_commit(spark, small_source, tmp_path, monkeypatch):
    root, d = str(tmp_path), DAYS[0]
    ingest_day(entries(spark, small_source, dict(trn_dt=d)), root, d)
    old, new = state(spark, root), entries(spark, small_source, dict(trn_dt=d, ac_no="Z"))
    monkeypatch.setattr(manifest.Manifest, "publish", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        ingest_day(new, root, d)
    monkeypatch.undo()
    assert state(spark, root) == old
    # Two changes of one state: the second must not hide the first.
    one, two = manifest.Change(spark, root), manifest.Change(spark, root)
    for change in (one, two):
        change.put_all(spark.range(3).toDF("x"), "branch", None)
    one.publish()
    with pytest.raises(Exception, match="(?i)exist"):
        two.publish()
    assert ParquetSource(spark, root).table("branch").count() == 3


def test_a_reader_keeps_its_state_and_sweep_takes_the_rest(spark, small_source, tmp_path):
    root, d = str(tmp_path), DAYS[0]
    ingest_day(entries(spark, small_source, dict(trn_dt=d, ac_no="A")), root, d)
    before = ParquetSource(spark, root)
    first = before.table("ledger_entry")
    ingest_day(entries(spark, small_source, dict(trn_dt=d, ac_no="B")), root, d)
    assert [r["ac_no"] for r in first.collect()] == ["A"]
    assert [r["ac_no"] for r in before.table("first_entry").collect()] == ["A"]
    assert sweep(spark, root, keep=2, older_than_hours=0) == 0
    now = state(spark, root)
    assert sweep(spark, root, keep=1, older_than_hours=24) == 0
    assert sweep(spark, root, keep=1, older_than_hours=0) > 0
    assert state(spark, root) == now
    assert not [p for p in (tmp_path / "ledger_entry").rglob("*.parquet") if "trn_dt" in str(p)][1:]


@pytest.mark.parametrize("other", [DAYS[1], None])
def test_rows_of_other_days_are_an_error(spark, small_source, tmp_path, other):
    rows_ = entries(spark, small_source, dict(trn_dt=DAYS[0]), dict(trn_dt=other), dict(trn_dt=other))
    with pytest.raises(ValueError, match="2 rows"):
        ingest_day(rows_, str(tmp_path), DAYS[0])
    hist = small_source.table("balance_history")
    with pytest.raises(ValueError, match="rows of balance_history"):
        ingest_snapshot_day(hist, str(tmp_path), DAYS[0])


def test_balances_of_closed_periods(spark, small_source, tmp_path, monkeypatch):
    """Late days, corrections, a day that becomes empty, and many corrections
    of one period: R4 stays what the days give."""
    root = str(tmp_path)
    monkeypatch.setattr(parquet, "MOST_CORRECTIONS", 2)

    def store(day, *accounts):
        ingest_day(entries(spark, small_source, *(dict(trn_dt=day, ac_no=a, lcy_amount=Decimal(k + 1))
                                                  for k, a in enumerate(accounts))), root, day, period="month")

    days = [date(2024, 1, 5), date(2024, 1, 20), date(2024, 2, 3), date(2024, 4, 1)]
    for k, day in enumerate(days):
        store(day, "A", "21010010001", f"x{k}")
    assert [ParquetSource(spark, root).last_period_end(d) for d in (date(2024, 1, 30), date(2024, 1, 31),
                                                                    date(2024, 3, 31), date(2024, 5, 1))] == [
        None, date(2024, 1, 31), date(2024, 2, 29), date(2024, 2, 29)]
    changes = [(date(2023, 12, 7), "A", "late"), (days[0], "A"), (days[0], "B", "B"), (days[0], "C"),
               (date(2024, 3, 9), "A", "new month"), (days[1], "A", "A", "A")]
    for day, *accounts in changes:
        store(day, *accounts)
        src = ParquetSource(spark, root)
        for as_of in (days[0], date(2024, 2, 2), date(2024, 5, 1)):
            assert position(src, as_of) == plain_position(src, as_of), (day, as_of)
    check_sides(spark, root)
    held = manifest.Manifest.latest(spark, root).relations["period_balance"]["folders"]
    assert max(map(len, held.values())) <= 3 and sorted(held) == ["2023-12-31", "2024-01-31", "2024-02-29",
                                                                   "2024-03-31"]


def test_hot_keys_of_a_day(spark, small_source, monkeypatch):
    monkeypatch.setattr(derived, "HOT_ROWS", 3)
    monkeypatch.setattr(derived, "MOST_HOT", 1)
    d = DAYS[0]
    led = entries(spark, small_source, *(dict(trn_dt=d, trn_ref_no=f"T{k % 2}", ac_no="G" if k < 4 else "H")
                                         for k in range(7)))
    got = {(r["kind"], r["key"], r["n"]) for r in derived.hot_key(led).collect()}
    assert got == {("trn_ref_no", "T0", 4), ("ac_no", "G", 4)}


def test_normalised_dates_and_money(spark, tmp_path):
    raw = spark.createDataFrame(
        [("T1", "22-MAY-24", dt.datetime(2024, 5, 22, 13, 5), 1.5, ""), ("T2", "2024-05-23", None, 2.0, "x"),
         ("T3", "", None, None, None)],
        "trn_ref_no string, trn_dt string, closing_date timestamp, lcy_amount double, event string")
    got = {r["trn_ref_no"]: r for r in normalise(raw).collect()}
    assert [got[k]["trn_dt"] for k in ("T1", "T2", "T3")] == [date(2024, 5, 22), date(2024, 5, 23), None]
    assert got["T1"]["closing_date"] == date(2024, 5, 22)
    assert got["T1"]["lcy_amount"] == Decimal("1.500") and got["T1"]["event"] is None
    write_relation(raw.where("trn_ref_no <> 'T3'"), str(tmp_path), "ledger_entry")
    back = spark.read.parquet(f"{tmp_path}/ledger_entry").where(F.col("trn_dt") == F.lit(date(2024, 5, 22)))
    assert [r["trn_ref_no"] for r in back.collect()] == ["T1"]


def test_snapshots_by_day(spark, small_source, tmp_path):
    hist = small_source.table("balance_history")
    days = [r[0] for r in hist.select("bkg_date").distinct().orderBy("bkg_date").limit(3).collect()]
    for d in reversed(days):
        ingest_snapshot_day(hist.where(F.col("bkg_date") == F.lit(d)), str(tmp_path), d)
    src = ParquetSource(spark, str(tmp_path))
    part = hist.where(F.col("bkg_date").isin(days))
    assert rows(src.table("first_snapshot").select("branch_code", "first_dt")) == rows(
        derived.first_snapshot(part))
    assert src.table("balance_history").count() == part.count()
