"""Column helpers that reproduce the Oracle behaviour the reports rely on.

All helpers return ``Column`` expressions built from built-in functions, so
they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(22, 3)
RATIO = T.DecimalType(22, 2)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c) -> Column:
    """Oracle stores '' as NULL: map empty strings to NULL."""
    return F.nullif(_c(c), F.lit(""))


def nvl(a, b) -> Column:
    return F.coalesce(_c(a), _c(b) if not isinstance(b, (int, float)) else F.lit(b))


def oracle_concat(*parts) -> Column:
    """``a || b || ...`` with Oracle rules: NULL parts count as '', and an
    all-empty result is NULL."""
    cols = [(_c(p) if not isinstance(p, (int, float)) else F.lit(p)).cast("string")
            for p in parts]
    return F.nullif(F.concat_ws("", *cols), F.lit(""))


def char_at(c, pos: int) -> Column:
    """``substr(c, pos, 1)``; NULL when the string is too short (Oracle)."""
    return blank_to_null(F.substring(_c(c), pos, 1))


def substr(c, pos: int, length: int) -> Column:
    return blank_to_null(F.substring(_c(c), pos, length))


def is_weekday(d) -> Column:
    """``to_char(d, 'Day') not like 'S%'`` in an English session: not Sat/Sun."""
    return ~F.dayofweek(_c(d)).isin(1, 7)


def dd_mon_yy(d) -> Column:
    """``to_char(d, 'DD-MON-YY')`` -> '25-JAN-24'."""
    return F.upper(F.date_format(_c(d), "dd-MMM-yy"))


def round_ratio(num, den, places: int = 2) -> Column:
    """``case when den <> 0 then round(num / den, places) else 0 end``.

    Oracle NUMBER division is exact and ``round`` is half away from zero.
    Decimal division in Spark first rounds the quotient to a bounded scale,
    which can round twice, so the rounding is done on exact integers:
    ``(2|n|*10^p + |d|) div 2|d|`` carries the sign of ``n*d``.  A NULL or
    zero denominator gives 0.
    """
    n, d = _c(num), _c(den)
    an, ad = F.abs(n), F.abs(d)
    scale = 10 ** places
    whole = F.call_function("div", an * (2 * scale) + ad, ad * 2)
    signed = F.when((n < 0) != (d < 0), -whole).otherwise(whole)
    value = (signed.cast("decimal(20,0)") / F.lit(scale).cast("decimal(20,0)")).cast(RATIO)
    return F.when(d != 0, value).otherwise(F.lit(0).cast(RATIO))
