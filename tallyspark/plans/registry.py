"""Query registry: name -> ``fn(spark, sf_dir) -> DataFrame``.

Every query reads the generated tables of ``sf_dir`` through
``TestdataSource`` and runs on all of their rows.  The result is passed
through ``comparable``: money (decimal) becomes DOUBLE and dates become ISO
text, so that the Spark result and the SQL oracle's result compare value by
value.  The reports themselves keep decimals and dates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.plans import backfill as B
from tallyspark.plans import params as P
from tallyspark.plans import reports as R
from tallyspark.sources import TestdataSource

Query = Callable[[SparkSession, str], DataFrame]


def comparable(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _src(spark: SparkSession, sf_dir: str) -> TestdataSource:
    return TestdataSource(spark, sf_dir)


def _q(build: Callable[[TestdataSource], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return comparable(build(_src(spark, sf_dir)))
    run.__doc__ = build.__doc__
    return run


REPORT_QUERIES: dict[str, Query] = {
    "report_cash_monitor": _q(lambda s: R.cash_monitor(
        s, P.CASH_MONITOR_BEFORE, head_office_label=P.HEAD_OFFICE_LABEL)),
    "report_cash_in_out": _q(lambda s: R.cash_in_out_by_zone(s, P.ZONE_FROM, P.ZONE_TO)),
    "report_ekyc": _q(lambda s: R.ekyc(s, P.EKYC_FROM, P.EKYC_TO)),
    "report_liquidity": _q(lambda s: R.liquidity(s, P.LIQUIDITY_AS_OF, P.LIQUIDITY_CODES)),
    "report_new_deposit": _q(lambda s: R.new_deposit(s, P.NEW_DEPOSIT_DAY)),
    "report_open_close": _q(lambda s: R.open_close_counts(s, P.OPEN_CLOSE_FROM, P.OPEN_CLOSE_TO)),
    "report_turnover": _q(lambda s: R.gl_turnover(s, P.TURNOVER_DAY)),
    "dump_lookup": _q(R.field_labels),
    "backfill_turnover": _q(lambda s: B.gl_turnover_of_days(s, P.BACKFILL_DAYS)),
    "backfill_cash_in_out": _q(lambda s: B.cash_in_out_of_windows(s, P.BACKFILL_WINDOWS)),
}


def all_queries() -> dict[str, Query]:
    from tallyspark.plans.operator_queries import OPERATOR_QUERIES
    out = dict(REPORT_QUERIES)
    out.update(OPERATOR_QUERIES)
    return out
