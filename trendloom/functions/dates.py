"""Period and date functions (P4, P7, P8, P12, P13) and time-zone-free epochs.

Time is text in the product: the period key is the first seven characters of
an ISO-8601 UTC string and ordering is lexicographic.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def period(iso_text: Column | str) -> Column:
    """``year_month`` = first seven characters of an ISO date text."""
    return F.substring(_col(iso_text), 1, 7)


def to_day(iso_text: Column | str) -> Column:
    """ISO text -> DATE.  Malformed text is an error (ANSI cast)."""
    return _col(iso_text).cast("date")


def current_period(as_of: str | _dt.date | None = None) -> Column:
    """``YYYY-MM`` of ``as_of`` (default: today's date in the session)."""
    day = F.current_date() if as_of is None else F.lit(str(as_of)[:10]).cast("date")
    return F.date_format(day, "yyyy-MM")


def period_label(year_month: Column | str) -> Column:
    """``YYYY-MM`` -> ``YYYY-MM-01`` (zone-free)."""
    return F.date_format(F.to_date(F.concat(_col(year_month), F.lit("-01"))), "yyyy-MM-dd")


def item_url(objectid: Column | str, prefix: str) -> Column:
    """Fixed prefix + id."""
    return F.concat(F.lit(prefix), _col(objectid))


def iso_utc(ts: Column | str) -> Column:
    """Timestamp (without zone) -> ``YYYY-MM-DDTHH:MM:SS.000Z`` text."""
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def epoch_seconds(ts_ntz: Column | str) -> Column:
    """Seconds since 1970-01-01 of a TIMESTAMP_NTZ, independent of the session zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("SECOND", epoch, _col(ts_ntz))
