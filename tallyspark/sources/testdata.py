"""Banking relations derived from the generated TPC-H-style test tables.

The generated tables have no banking schema, so each of the 21 relations the
reports read is derived from them with plain DataFrame expressions (see
FIXTURES.md section 2 for the same rules written as SQL).  Everything here is
lazy: a relation is a logical plan over the parquet scans, so filters and
column pruning of the reports reach the scans.

Scale notes
-----------
* ``ledger_entry`` is built from ONE ``lineitem x orders`` join.  Both legs
  (customer side and contra side) come out of a single ``inline`` over a
  two-element array, so the join runs once, not once per leg.  Columns that
  are shared by both legs (``trn_dt``, ``ac_branch``, amounts ...) are
  computed before the generator, which lets Catalyst push report filters on
  them below the generator and the join.
* ``balance_history`` aggregates ``events`` once per (account, branch, day);
  the cash-GL rows are a second, tiny aggregate of that result rather than a
  second pass over ``events``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark import fixed
from tallyspark.functions.oracle import MONEY
from tallyspark.sources import derived

BAL = "decimal(32,3)"


def _acct(k: Column) -> Column:
    """Customer account number built from a numeric key (five digits of it,
    more where the key has more)."""
    digits = k.cast("string")
    return F.concat(F.lit("210"), (k % 5).cast("string"), F.lit("0"), (k % 10).cast("string"),
                    F.repeat(F.lit("0"), F.greatest(5 - F.length(digits), F.lit(0))), digits)


def _code3(x: Column) -> Column:
    return F.lpad(x.cast("string"), 3, "0")


def _day(base: str, offset: Column) -> Column:
    return F.date_add(F.lit(base).cast("date"), offset.cast("int"))


def _values(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A literal table as a local relation, whose size the optimizer knows."""
    cols = [c.split()[0] for c in schema.split(",")]
    values = ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(cols)})")


class TestdataSource:
    """``table(name)`` returns the banking relation ``name`` over ``sf_dir``."""

    RELATIONS = (
        "ledger_entry", "gl_account", "account_gl_map", "gl_master", "deposit_term",
        "balance_history", "calendar", "holiday", "branch", "branch_group_member",
        "branch_group", "account", "joint_holder", "account_balance",
        "account_closure", "account_class", "customer", "customer_personal",
        "customer_corporate", "customer_professional", "field_label",
    ) + derived.DERIVED

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._memo: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def table(self, name: str) -> DataFrame:
        if name not in self._memo:
            if name not in self.RELATIONS:
                raise KeyError(f"unknown relation {name!r}")
            if name == "hot_key":  # the generated tables are small: nothing is hot
                self._memo[name] = derived.empty(self.spark, name)
            elif name in derived.DERIVED:
                self._memo[name] = derived.derive(
                    name, self.table(derived.DERIVED_FROM.get(name, "ledger_entry")))
            else:
                self._memo[name] = getattr(self, f"_{name}")()
        return self._memo[name]

    __call__ = table

    # ------------------------------------------------------------------ ledger
    def _ledger_entry(self) -> DataFrame:
        li = self.raw("lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
            "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
        od = self.raw("orders").select("o_orderkey", "o_custkey")
        j = li.join(od, F.col("l_orderkey") == F.col("o_orderkey"))

        key, cust = F.col("l_orderkey"), F.col("o_custkey")
        price, rflag = F.col("l_extendedprice"), F.col("l_returnflag")
        reversed_sign = (cust % 5 == 4) & (rflag == "R")
        lcy = (F.when((F.col("l_discount") == 0.1) | reversed_sign, -price)
                .when(F.col("l_linenumber") >= 5, F.floor(price / 10000) * 10000)
                .otherwise(price)).cast(MONEY)
        qty = F.col("l_quantity")
        fcy = F.when(F.col("l_suppkey") % 4 == 0,
                     F.when(reversed_sign, -qty).otherwise(qty).cast(MONEY))
        is_r = rflag == "R"
        customer_leg = F.struct(
            _acct(cust).alias("ac_no"), F.lit(fixed.CUSTOMER_LEG).alias("cust_gl"),
            F.when(is_r, "D").otherwise("C").alias("drcr_ind"))
        contra_leg = F.struct(
            F.when(F.col("l_linestatus") == "F", fixed.CASH_GL)
             .when(F.col("l_partkey") % 2 == 0, fixed.INTERBANK_GL)
             .otherwise("91000010001").alias("ac_no"),
            F.lit(fixed.GL_LEG).alias("cust_gl"),
            F.when(is_r, "C").otherwise("D").alias("drcr_ind"))
        ln = F.col("l_linenumber")
        shared = j.select(
            F.concat(F.lit("T"), key.cast("string")).alias("trn_ref_no"),
            ln.alias("ac_entry_sr_no"),
            F.concat(F.lit("X"), key.cast("string")).alias("external_ref_no"),
            F.when(qty == 50, fixed.REVERSAL_EVENT).when(qty == 49, fixed.YEAR_END_EVENT)
             .otherwise("INIT").alias("event"),
            _code3(cust % 8 + 1).alias("ac_branch"),
            F.when(F.col("l_suppkey") % 4 == 0, "USD").otherwise(fixed.BASE_CCY).alias("ac_ccy"),
            F.when(ln == 1, "CDO").when(ln == 2, "SWP").when(ln == 3, "MRG")
             .when(ln == 4, "POS").otherwise("CSD").alias("trn_code"),
            lcy.alias("lcy_amount"),
            fcy.alias("fcy_amount"),
            _day("2024-01-01", key % 30).alias("trn_dt"),
            F.when(F.col("l_tax") == 0.08, "U").otherwise(fixed.AUTHORISED).alias("auth_stat"),
            F.array(customer_leg, contra_leg).alias("legs"))
        out = shared.select("*", F.inline("legs")).drop("legs")
        return out.select(
            "trn_ref_no", "ac_entry_sr_no", "external_ref_no", "event", "ac_branch",
            "ac_no", "cust_gl", "drcr_ind", "ac_ccy", "trn_code", "lcy_amount",
            "fcy_amount", "trn_dt", "auth_stat")

    # --------------------------------------------------------- GL dimensions
    def _gl_account(self) -> DataFrame:
        c = self.raw("customer").select("c_custkey")
        k = F.col("c_custkey")
        natural = (F.when(k % 5 == 1, "21020010001").when(k % 5 == 2, "21010010001")
                   .when(k % 5 == 3, F.when(k % 2 == 0, "21030010001").otherwise("21050010001"))
                   .when(k % 5 == 4, "21110010001").otherwise("21220010001"))
        customers = c.select(_acct(k).alias("ac_gl_no"), natural.alias("ac_natural_gl"))
        gls = _values(self.spark, [(fixed.CASH_GL,), (fixed.INTERBANK_GL,), ("91000010001",)],
                      "code string").select(F.col("code").alias("ac_gl_no"),
                                            F.col("code").alias("ac_natural_gl"))
        return customers.unionByName(gls)

    def _account_gl_map(self) -> DataFrame:
        return self._gl_account()

    def _gl_master(self) -> DataFrame:
        codes = [fixed.CASH_GL, fixed.INTERBANK_GL, "91000010001", "21010010001",
                 "21020010001", "21030010001", "21050010001", "21110010001", "21220010001"]
        g = _values(self.spark, [(c,) for c in codes], "code string")
        return g.select(F.col("code").alias("gl_code"),
                        F.when(F.col("code") == fixed.CASH_GL, fixed.CASH_GL_TYPE)
                         .when(F.col("code").startswith("2"), "2").otherwise("1").alias("type"))

    def _deposit_term(self) -> DataFrame:
        k = F.col("c_custkey")
        return (self.raw("customer").select("c_custkey").where(k % 5 == 3).select(
            _acct(k).alias("acc"),
            F.when(k % 4 == 0, 30).when(k % 4 == 1, 50).when(k % 4 == 2, 90).alias("orig_tenor_days"),
            F.when((k % 4 == 3) & (k % 3 == 0), 12).alias("orig_tenor_months"),
            F.when((k % 4 == 3) & (k % 3 == 1), 1).alias("orig_tenor_years")))

    # ------------------------------------------------------------- balances
    def _balance_history(self) -> DataFrame:
        ev = self.raw("events").select("ts", "user_id", "value")
        u = F.col("user_id")
        branch = F.when(u % 9 == 8, fixed.HEAD_OFFICE_BRANCH).otherwise(_code3(u % 9 + 1))
        per_account = (ev.groupBy(_acct(u).alias("account"), branch.alias("branch_code"),
                                  F.col("ts").cast("date").alias("bkg_date"))
                       .agg(F.sum(F.col("value").cast(MONEY)).alias("opening"),
                            F.sum((F.col("value") * 2).cast(MONEY)).alias("closing")))
        customers = per_account.select(
            "account", "branch_code", "bkg_date",
            F.col("opening").alias("acy_opening_bal"), F.col("opening").alias("lcy_opening_bal"),
            F.col("closing").alias("acy_closing_bal"), F.col("closing").alias("lcy_closing_bal"))
        cash = (per_account.groupBy("branch_code", "bkg_date")
                .agg((-F.sum("opening")).cast(BAL).alias("opening"),
                     (-F.sum("closing")).cast(BAL).alias("closing"))
                .select(F.lit(fixed.CASH_GL).alias("account"), "branch_code", "bkg_date",
                        F.col("opening").alias("acy_opening_bal"),
                        F.col("opening").alias("lcy_opening_bal"),
                        F.col("closing").alias("acy_closing_bal"),
                        F.col("closing").alias("lcy_closing_bal")))
        return customers.unionByName(cash)

    def _calendar(self) -> DataFrame:
        return (self.raw("events").select(F.col("ts").cast("date").alias("value_date"))
                .distinct())

    def _holiday(self) -> DataFrame:
        return _values(self.spark, [("2024-01-19",)], "d string").select(
            F.col("d").cast("date").alias("holiday_date"))

    # ------------------------------------------------------------- branches
    def _branch(self) -> DataFrame:
        n = self.raw("nation").select(_code3(F.col("n_nationkey") + 1).alias("branch_code"),
                                     F.col("n_name").alias("branch_name"))
        ho = _values(self.spark, [(fixed.HEAD_OFFICE_BRANCH, "HEAD_OFFICE")],
                     "branch_code string, branch_name string")
        return n.unionByName(ho)

    def _branch_group_member(self) -> DataFrame:
        k = F.col("n_nationkey")
        grp = (F.when(k % 5 == 0, "YGN").when(k % 5 == 1, "MDY").when(k % 5 == 2, "NPT")
               .when(k % 5 == 3, "TGI").otherwise("BGO"))
        return self.raw("nation").select(_code3(k + 1).alias("branch_code"),
                                        grp.alias("branch_group_code"))

    def _branch_group(self) -> DataFrame:
        return _values(self.spark, [("YGN", "O"), ("MDY", "O"), ("NPT", "O"), ("TGI", "O"),
                                    ("BGO", "C")],
                       "branch_group_code string, record_stat string")

    # ------------------------------------------------------------- accounts
    def _cust(self) -> DataFrame:
        return self.raw("customer")

    def _account(self) -> DataFrame:
        k = F.col("c_custkey")
        return self._cust().select(
            _code3(k % 8 + 1).alias("branch_code"), _acct(k).alias("cust_ac_no"),
            k.alias("cust_no"), _day("2024-01-01", k % 60).alias("ac_open_date"),
            F.when(k % 7 == 0, fixed.JOINT_ACCOUNT).otherwise(fixed.SINGLE_ACCOUNT)
             .alias("joint_ac_indicator"),
            F.col("c_mktsegment").alias("account_class"))

    def _joint_holder(self) -> DataFrame:
        k = F.col("c_custkey")
        return self._cust().where((k % 7 == 0) & (k > 0)).select(
            _acct(k).alias("cust_ac_no"), (k - 1).alias("joint_holder_code"))

    def _account_balance(self) -> DataFrame:
        k = F.col("c_custkey")
        return self._cust().where(k % 13 != 0).select(
            _acct(k).alias("cust_ac_no"),
            F.col("c_acctbal").cast(MONEY).alias("acy_withdrawable_bal"),
            F.lit(0).cast(MONEY).alias("acy_blocked_amt"))

    def _account_closure(self) -> DataFrame:
        k = F.col("c_custkey")
        off = F.when(k % 2 == 0, k % 45).otherwise((k + 3) % 45)
        return self._cust().where(k % 11 == 0).select(
            _acct(k).alias("ac_no"), _day("2024-01-01", off).alias("closing_date"))

    def _account_class(self) -> DataFrame:
        seg = F.col("c_mktsegment")
        return (self._cust().where(seg != "FURNITURE")
                .select(seg.alias("account_class"), F.lower(seg).alias("description"))
                .distinct())

    # ------------------------------------------------------------- customers
    def _customer(self) -> DataFrame:
        k = F.col("c_custkey")
        return self._cust().select(
            k.alias("customer_no"),
            F.when(k % 6 == 0, fixed.CUSTOMER_CORPORATE).otherwise(fixed.CUSTOMER_INDIVIDUAL)
             .alias("customer_type"),
            F.col("c_name").alias("full_name"),
            F.lit("NRC").alias("unique_id_name"),
            (k * 7).cast("string").alias("unique_id_value"),
            F.concat(F.lit("No "), F.col("c_name")).alias("address_line1"),
            F.when(k % 3 == 0, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("Ward "), F.col("c_mktsegment"), F.lit(",")))
             .alias("address_line2"),
            F.concat(F.lit("Zone "), F.col("c_nationkey").cast("string")).alias("address_line3"),
            F.when(k % 4 == 0, F.lit(None).cast("string")).otherwise(F.lit("City"))
             .alias("address_line4"))

    def _customer_personal(self) -> DataFrame:
        k = F.col("c_custkey")
        return self._cust().where(k % 6 != 0).select(
            k.alias("customer_no"),
            F.when(k % 2 == 0, "U").alias("customer_prefix"),
            _day("1970-01-01", k % 9000).alias("date_of_birth"),
            F.when(k % 5 != 0, k.cast("string")).alias("telephone"),
            F.concat(F.lit("09"), k.cast("string")).alias("mobile_number"))

    def _customer_corporate(self) -> DataFrame:
        k = F.col("c_custkey")
        return self._cust().where(k % 6 == 0).select(
            k.alias("customer_no"), _day("1990-01-01", k % 9000).alias("incorp_date"))

    def _customer_professional(self) -> DataFrame:
        k = F.col("c_custkey")
        return self._cust().where(k % 2 == 0).select(
            k.alias("customer_no"),
            F.concat(F.lit("job "), F.col("c_mktsegment")).alias("designation"))

    def _field_label(self) -> DataFrame:
        return self.raw("region").select(F.col("r_name").alias("field_name"),
                                         F.col("r_regionkey").alias("label_code"))
