"""Parameters the checked queries run with (chosen so that every report
returns rows on the generated data and hits its edge cases: reversals,
sweeps, a closed zone, a weekday holiday inside the cash-monitor window,
tenor suffixes, same-window open-and-close)."""

from datetime import date, timedelta

CASH_MONITOR_BEFORE = date(2024, 1, 25)
ZONE_FROM, ZONE_TO = date(2024, 1, 10), date(2024, 1, 16)
EKYC_FROM, EKYC_TO = date(2024, 1, 10), date(2024, 1, 16)
LIQUIDITY_AS_OF = date(2024, 1, 28)
LIQUIDITY_CODES = ("91000010001", "21030010001(30)")
NEW_DEPOSIT_DAY = date(2024, 1, 3)
OPEN_CLOSE_FROM, OPEN_CLOSE_TO = date(2024, 1, 3), date(2024, 1, 16)
TURNOVER_DAY = date(2024, 1, 10)
#: Several runs at once: twenty days in a row, and windows that overlap, lie
#: apart and repeat a day.
BACKFILL_DAYS = tuple(date(2024, 1, 1) + timedelta(n) for n in range(20))
BACKFILL_WINDOWS = ((ZONE_FROM, ZONE_TO), (date(2024, 1, 14), date(2024, 1, 20)), (ZONE_TO, ZONE_TO),
                    (date(2024, 2, 5), date(2024, 2, 6)))
HEAD_OFFICE_LABEL = "HEAD OFFICE"


def sql_date(d: date) -> str:
    return f"DATE '{d.isoformat()}'"
