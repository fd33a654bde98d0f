"""The remote reader: pruned columns and days, pushed filters and keys, and
reports that read through it."""

from __future__ import annotations

import base64

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.operators.channels import open_branch_groups
from tallyspark.operators.ledger import in_window
from tallyspark.plans import params as P
from tallyspark.plans import reports as R
from tallyspark.sources import materialize
from tallyspark.sources.remote import FILTER_BITS, RemoteCatalog, RemoteReader, key_filter, may_hold
from tests.test_plans import rows

COLUMNS = ["trn_ref_no", "external_ref_no", "event", "ac_branch", "ac_no", "cust_gl", "drcr_ind", "ac_ccy", "trn_code",
           "lcy_amount", "fcy_amount", "trn_dt", "ac_entry_sr_no"]


@pytest.fixture(scope="module")
def stored(small_source, tmp_path_factory):
    return materialize(small_source, str(tmp_path_factory.mktemp("remote")))


@pytest.fixture(scope="module")
def catalog(spark, stored):
    return RemoteCatalog(spark, stored.root)


def reader_of(catalog, where):
    scan = catalog.scan("ledger_entry", ["ac_no", "trn_dt"])
    entry = catalog.manifest.relations["ledger_entry"]
    folders = [(f"{catalog.root}/ledger_entry/commit={c}/trn_dt={d}", d)
               for d, cs in sorted(entry["folders"].items()) for c in cs]
    return RemoteReader(scan.schema, folders, "trn_dt", where)


def test_rows_equal_the_plain_scan(stored, catalog):
    assert rows(catalog.scan("ledger_entry", COLUMNS)) == rows(stored.table("ledger_entry").select(*COLUMNS))
    assert rows(catalog.scan("gl_master", ["gl_code", "type"])) == rows(
        stored.table("gl_master").select("gl_code", "type"))


def test_the_day_filter_works_inside_the_reader(catalog):
    day, never = P.ZONE_FROM.isoformat(), P.ZONE_FROM.replace(year=2090).isoformat()
    one = reader_of(catalog, [("trn_dt", "=", [day])]).partitions()
    assert {p.part for p in one} == {day} and len(one) < len(reader_of(catalog, []).partitions())
    none = reader_of(catalog, [("trn_dt", ">", [never])])
    assert [list(none.read(p)) for p in none.partitions()] == [[]]


WHERE = [("trn_dt", ">=", P.ZONE_FROM), ("trn_dt", "<=", P.ZONE_TO), ("drcr_ind", "=", "C"), ("lcy_amount", ">", 100),
         ("ac_ccy", "in", ["MMK", "USD", None]), ("trn_code", "<>", "SWP"), ("fcy_amount", "<", 10**9)]


def test_filters_give_the_rows_that_spark_would(stored, catalog):
    plain = stored.table("ledger_entry").select(*COLUMNS)
    for column, op, value in WHERE:
        c = F.col(column)
        plain = plain.where(c.isin("MMK", "USD") if op == "in" else F.expr(
            f"{column} {op} " + (str(value) if isinstance(value, int) else f"'{value}'")))
    assert rows(catalog.scan("ledger_entry", COLUMNS, WHERE)) == rows(plain) != []


def test_one_scan_read_twice_with_two_filters(stored, catalog):
    def both(df):
        return df.where("cust_gl = 'A'").unionByName(df.where("cust_gl = 'G'"))
    window = [("trn_dt", "=", P.ZONE_FROM)]
    got = rows(both(catalog.scan("ledger_entry", COLUMNS, window)))
    assert got == rows(both(in_window(stored.table("ledger_entry").select(*COLUMNS), P.ZONE_FROM))) != []


@pytest.mark.parametrize("where", [[("auth_stat", "=", "A")], [("ac_no", "like", "2%")], [("ac_no", "=", None)]])
def test_filters_that_cannot_go_along_are_errors(catalog, where):
    with pytest.raises(ValueError):
        catalog.scan("ledger_entry", COLUMNS, where)


def test_keys_go_along_to_the_reader(stored, catalog):
    wanted = stored.spark.createDataFrame([("B001",), (None,)], "ac_branch string")
    some = stored.table("ledger_entry").select("ac_branch").distinct().orderBy("ac_branch").limit(2)
    got = catalog.scan("ledger_entry", COLUMNS, keys=("ac_branch", some))
    plain = stored.table("ledger_entry").select(*COLUMNS)
    assert got.count() < plain.count()
    assert rows(got.join(some, "ac_branch")) == rows(plain.join(some, "ac_branch"))
    assert catalog.scan("ledger_entry", COLUMNS, keys=("ac_branch", wanted.where("false"))).count() == 0


def test_a_full_filter_lets_all_pass(spark, stored, catalog, monkeypatch):
    from tallyspark.sources import remote
    full = base64.b64encode(np.full(FILTER_BITS // 8, 255, np.uint8).tobytes()).decode()
    many = spark.range(200_000).select(F.col("id").cast("string").alias("ac_branch"))
    assert key_filter(many, "ac_branch") == full
    monkeypatch.setattr(remote, "key_filter", lambda keys, column: full)
    rest = stored.table("ledger_entry").where("ac_branch is not null").count()
    assert catalog.scan("ledger_entry", COLUMNS, keys=("ac_branch", many)).count() == rest


def test_no_key_is_missed(spark):
    keys = ["", "é", "001", "x" * 1000, "\U0001f600"]
    text = key_filter(spark.createDataFrame([(k,) for k in keys], "k string"), "k")
    bits = np.unpackbits(np.frombuffer(base64.b64decode(text), np.uint8)).astype(bool)
    assert all(may_hold(bits, k) for k in keys) and not may_hold(bits, None) and not may_hold(bits, "other")


class RemoteLedger:
    """A local catalog whose ledger comes through the reader, cut to the
    branches of open groups."""

    def __init__(self, near, catalog):
        self.near, self.spark = near, near.spark
        groups = open_branch_groups(near.table("branch_group_member"), near.table("branch_group"))
        window = [("trn_dt", ">=", P.ZONE_FROM), ("trn_dt", "<=", P.ZONE_TO)]
        self.led = catalog.scan("ledger_entry", COLUMNS, window, keys=(
            "ac_branch", groups.select(F.col("branch_code").alias("ac_branch"))))

    def table(self, name):
        return self.led if name == "ledger_entry" else self.near.table(name)


def test_cash_in_out_reads_through_it(stored, catalog):
    got = R.cash_in_out_by_zone(RemoteLedger(stored, catalog), P.ZONE_FROM, P.ZONE_TO)
    assert rows(got) == rows(R.cash_in_out_by_zone(stored, P.ZONE_FROM, P.ZONE_TO)) != []
