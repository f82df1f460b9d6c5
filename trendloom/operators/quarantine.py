"""Constraints at load (A8, S9): rows that break one are set aside with a reason.

A single pass marks every row with the first constraint that it breaks; the good
rows go on, the others are written to a quarantine table, and ``observe`` counts
both while that pass runs, so that no second job is needed for the numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import schema

REASON = "reason"


def broken_constraint(table: str) -> Column:
    """The first constraint that a row of ``table`` breaks, as ``null:<column>``,
    ``empty:<column>`` (a key) or ``date:<column>``; null for a good row."""
    tests = [(F.col(c).isNull(), f"null:{c}") for c in schema.REQUIRED.get(table, [])]
    tests += [(F.col(c) == "", f"empty:{c}") for c in schema.KEYS.get(table, [])]
    tests += [(~F.col(c).rlike(schema.ISO_DATE), f"date:{c}") for c in schema.DATES.get(table, [])]
    if not tests:
        return F.lit(None).cast("string")
    return F.coalesce(*(F.when(broken, F.lit(reason)) for broken, reason in tests))


def checked(rows: DataFrame, table: str, name: str | None = None) -> tuple[DataFrame, Observation]:
    """The rows with their ``reason`` (null: good), and an observation that gives
    ``good`` and ``bad`` once they have been written."""
    seen = Observation(name or f"checked_{table}")
    marked = rows.withColumn(REASON, broken_constraint(table))
    return marked.observe(seen, F.count_if(F.col(REASON).isNull()).alias("good"),
                          F.count_if(F.col(REASON).isNotNull()).alias("bad")), seen


def good(marked: DataFrame) -> DataFrame:
    return marked.where(F.col(REASON).isNull()).drop(REASON)


def bad(marked: DataFrame) -> DataFrame:
    """(reason, record): the rows set aside, as JSON."""
    columns = [c for c in marked.columns if c != REASON]
    return marked.where(F.col(REASON).isNotNull()).select(
        REASON, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("record"))
