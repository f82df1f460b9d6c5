"""Predicates of the ingest and query layers (I3, F1-F3, F9) as Columns."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_RANGE_OPS = {"lt": lambda c, v: c < v, "gt": lambda c, v: c > v}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(column: Column | str, op: str, value) -> Column | None:
    """One open bound; only ``lt`` / ``gt``.  ``None`` value -> no predicate."""
    if op not in _RANGE_OPS:
        raise ValueError(f"unsupported range operator {op!r} (only 'lt' and 'gt')")
    if value is None:
        return None
    return _RANGE_OPS[op](_col(column), F.lit(value))


def range_filter(column: Column | str, gt=None, lt=None) -> Column:
    """Open interval ``gt < column < lt``; missing bounds are dropped."""
    preds = [p for p in (bound(column, "gt", gt), bound(column, "lt", lt)) if p is not None]
    out = F.lit(True)
    for p in preds:
        out = out & p
    return out


def author_in(authors: Iterable[str], column: Column | str = "author") -> Column:
    """author in a list; NULL authors are excluded."""
    return _col(column).isin(list(authors))


def title_prefix(prefix: str, column: Column | str = "title") -> Column:
    """case-insensitive literal prefix (``?``, ``:``, ``%``, ``_`` are literal)."""
    return F.lower(_col(column)).startswith(prefix.lower())


def not_excluded(ids: Iterable[str], column: Column | str = "objectid") -> Column:
    """id not in an exclusion list."""
    ids = list(ids)
    return F.lit(True) if not ids else ~_col(column).isin(ids)


def settled(day: Column | str, days: int = 5, as_of: str | _dt.date | None = None) -> Column:
    """submission day strictly older than ``days`` days before ``as_of``."""
    ref = F.current_date() if as_of is None else F.lit(str(as_of)[:10]).cast("date")
    return _col(day).cast("date") < F.date_sub(ref, days)
