"""Column-level helpers (Oracle semantics on Spark built-ins)."""

from tallyspark.functions.oracle import (  # noqa: F401
    MONEY, RATIO, blank_to_null, char_at, dd_mon_yy, is_weekday, nvl,
    oracle_concat, round_ratio, substr,
)
