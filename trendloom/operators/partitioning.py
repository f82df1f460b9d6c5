"""Parallelism helpers.

A CPU-heavy per-row stage (tokenising long text) runs one task per input
partition.  When an input arrives in fewer partitions than the cluster has
cores — a single Parquet row group, a small table — the stage would run on a
few cores while the rest idle.  :func:`spread` hash-partitions such an input
on its id first.  On a large input (many more splits than cores) it returns
the DataFrame unchanged, so at scale it adds no shuffle.

Apply it to a plain scan (read + filter/project), where the partition count is
known without running anything: on a plan with shuffles or broadcasts, asking
for the partition count makes adaptive execution run those stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TASKS_PER_CORE = 2


def target_partitions(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism * TASKS_PER_CORE


def spread(df: DataFrame, by: str | None = None, min_partitions: int | None = None) -> DataFrame:
    """Repartition only when ``df`` has fewer partitions than the cluster has cores.

    With ``by`` (a unique id) the rows are hash-partitioned on it; without,
    round-robin (Spark sorts before a round-robin repartition, so a retried
    task still reads the same rows).  Neither concentrates a hot key: never
    pass a grouping key with repeats as ``by``.  ``df`` must be a plain scan
    (see the module note).
    """
    target = min_partitions or target_partitions(df)
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= min(target, cores):
        return df
    return df.repartition(target, F.col(by)) if by else df.repartition(target)
