"""Status-bearing sentinel dates and date helpers.

Sentinel dates are business codes stored in date columns.  Each KPI names the
set it tests; NULL never matches either ``IN`` or ``NOT IN`` (SQL rules).
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(*isos: str) -> tuple[date, ...]:
    return tuple(date.fromisoformat(s) for s in isos)


# --- fixed values: sentinel date sets used by the KPIs --------------------
UNKNOWN_DELIVERY = _d("2081-12-25")
RECEIVED_NOT_BOOKED = _d("2008-08-08")
SHIPPED = _d("2008-08-08", "2009-09-09", "2010-10-10")
PENDING_APPROVAL = _d("2081-04-01")
MATERIAL_ONLY_START = _d("2012-12-12")
D1A1_LATEST_EXCLUDED = _d("2001-01-01", "2008-08-08", "2009-09-09", "2010-10-10")
D1A2_LATEST_EXCLUDED = _d("2001-01-01", "2008-08-08", "2009-09-09", "2010-10-10",
                          "2002-02-02", "2018-12-31")
D1A2_PROMISED_EXCLUDED = _d("2081-12-31", "2002-02-02")
P6_PROMISED_EXCLUDED = _d("2081-01-04", "2081-12-25")
D8_MIN_PROMISED_EXCLUDED = _d("2001-01-01", "2081-04-01", "2002-01-01")
D3_PROMISED_EXCLUDED = _d("2008-08-08", "2018-12-25", "2018-12-31", "2018-04-01",
                          "2001-01-01")
D9_EXCLUDED = _d("2001-01-01", "2018-12-31", "2081-12-25", "2111-01-01", "2081-01-04",
                 "2010-10-10", "2009-09-09", "2008-08-08", "2002-02-02")

# --- fixed values: literal cut-off dates (metric parameter defaults) ------
PROMISED_CUTOFF = date(2019, 1, 1)
ENQUIRY_CUTOFF = date(2020, 1, 1)
QUERY_RAISED_CUTOFF = date(2023, 7, 31)


def sentinel_in(c: Column, dates: Iterable[date]) -> Column:
    return F.to_date(c).isin(list(dates))


def sentinel_not_in(c: Column, dates: Iterable[date]) -> Column:
    return ~sentinel_in(c, dates)


def sentinel_free(c: Column, dates: Iterable[date]) -> Column:
    """NULL allowed, otherwise not a sentinel."""
    return c.isNull() | sentinel_not_in(c, dates)


def earliest_of(a: Column, b: Column) -> Column:
    """Earlier of two dates, ignoring a NULL side (NULL only if both are)."""
    return F.least(a, b)


def month_differs(a: Column, b: Column) -> Column:
    """Different calendar month (year or month differ); NULL if either is NULL."""
    return F.trunc(a, "MM") != F.trunc(b, "MM")
