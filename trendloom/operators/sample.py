"""Sorts, limits and sampling (O2, O3).

Both are top-k: ``orderBy(...).limit(k)`` plans as TakeOrderedAndProject —
each task keeps its own k best rows and only k rows per task reach the final
merge, so no task ever holds more than k rows of the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample_rows(df: DataFrame, n: int = 5, seed: int | None = None,
                order: Column | None = None) -> DataFrame:
    """O2: exactly ``min(n, rows)`` rows, without replacement.

    Random by default (``rand(seed)``); pass ``order`` (e.g. a hash of the id)
    for a reproducible sample.  Not ``df.sample(fraction)``, whose size varies.
    """
    key = order if order is not None else F.rand(seed)
    return df.orderBy(key).limit(n)


def top_newest(df: DataFrame, n: int, ts_col: str = "created_at_i",
               tiebreak: str = "objectid") -> DataFrame:
    """O3: the ``n`` newest rows (ties broken by id, descending)."""
    return df.orderBy(F.col(ts_col).desc(), F.col(tiebreak).desc()).limit(n)
