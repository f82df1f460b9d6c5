"""Shared helpers of the llm operators: scratch tables, folds, fixed bitmaps,
batch plumbing for ``mapInArrow``.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: log2 of the bits of a fixed bitmap: 2 MB, whatever the input's size.
BITMAP_LOG2 = 24


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Written tables of one run, in the shared folder ``spark.checkpoint.dir``
    names; a written table cuts the lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, scratch_path(spark, f"llm-{name}")

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables of this run that no later result reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fold(column: str, modulus: int):
    """crc32 of the column as text, modulo; null stays null."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def smallest(rows: DataFrame, column: str, n: int) -> DataFrame:
    """At most ``n`` rows, those with the smallest hashes in ``column``.

    The bound is found on the hashes alone, so that wide rows are not sorted.
    """
    last = rows.select(column).orderBy(column).limit(n).agg(F.max(column)).first()[0]
    return rows.limit(0) if last is None else rows.where(F.col(column) <= last).limit(n)


def per_batch(rows: Callable[[pa.RecordBatch], dict], schema: pa.Schema
              ) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function from one that turns a batch into columns."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = rows(batch)
                yield pa.RecordBatch.from_arrays(
                    [out[f.name] if isinstance(out[f.name], pa.Array)
                     else pa.array(out[f.name], type=f.type) for f in schema], schema=schema)
    return run


def texts_of(batch: pa.RecordBatch, column: str | int = "text") -> Iterator[str]:
    """The texts of a batch; null counts as empty."""
    return chain.from_iterable(in_slices(batch, column))


def in_slices(batch: pa.RecordBatch, column: str | int = "text", characters: int = 1_000_000) -> Iterator[list[str]]:
    """The texts of a batch, a few million characters at a time, so that only
    those are Python objects at once; null counts as empty."""
    some, size = [], 0
    for t in batch.column(column):
        t = t.as_py() or ""
        some.append(t)
        size += len(t)
        if size >= characters:
            yield some
            some, size = [], 0
    if some:
        yield some
    release_unused()


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc's; others have none


def release_unused() -> None:
    """Give back what Arrow and the C library keep of freed memory: workers live on."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """One list per part, without going through Python objects."""
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


# ---- fixed bitmaps ---------------------------------------------------------------

def fixed_bitmap(hashes: DataFrame, column: str, log2: int = BITMAP_LOG2) -> np.ndarray:
    """A bitmap of ``2**log2`` bits marking the top bits of 64-bit hashes.

    The size is fixed, so it may be broadcast whatever the input's size; a set
    bit may be a chance hit, so its users treat it as a screen only.  Executors
    combine the bits; the driver reads at most ``2**(log2 - 6)`` words.
    """
    cell = F.shiftrightunsigned(F.col(column), 64 - log2)
    words = (hashes.where(F.col(column).isNotNull())
             .select(F.shiftright(cell, 6).alias("w"),
                     F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - log2}) & 63 as int))")
                     .alias("b"))
             .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow())
    bits = np.zeros(1 << (log2 - 6), dtype=np.uint64)
    if words.num_rows:
        bits[words.column("w").to_numpy()] = words.column("b").to_numpy().astype(np.int64).view(np.uint64)
    return bits


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the uint64 hashes have their bit set."""
    cell = hashes >> np.uint64(64 - 6 - int(len(bits)).bit_length() + 1)
    return (bits[cell >> np.uint64(6)] >> (cell & np.uint64(63))) & np.uint64(1) == 1
