"""Which hashes occur several times, counted over all rows, as fixed bitmaps.

Tasks sort blocks of hashes and cut them into ranges of the hash space; the
blocks of a range meet in one group and are counted there.  A block's cells are
24 bits beyond the range's own, written byte plane by byte plane (the sorted
high bytes compress away), so that a hash costs two to three bytes of shuffle.
A block holds no cell more often than the highest level asked for, which leaves
every comparison with a level as it is and bounds a hot hash.  The number of
ranges follows the number of shuffle partitions.

A set bit may be a chance hit; an unset one is certain: the hash is rarer than
the level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log2 of the bits of a map unless told otherwise: 8 MB, whatever the input's size.
BITS_LOG2 = 26
_BLOCK = 1 << 20


def _planes(cells: np.ndarray) -> bytes:
    return cells.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes()


def _cells(planes: bytes) -> np.ndarray:
    p = np.frombuffer(planes, dtype=np.uint8).reshape(3, -1).astype(np.uint32)
    return p[0] | p[1] << np.uint32(8) | p[2] << np.uint32(16)


def repeat_bitmaps(rows: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]],
                   levels: tuple[int, ...], bits_log2: int = BITS_LOG2) -> dict[int, tuple[np.ndarray, int]]:
    """level -> (bitmap, marks) of the hashes that occur at least ``level`` times.

    ``hashes`` yields the uint64 hashes of a batch, part by part.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(20, max(8, (8 * partitions - 1).bit_length()))
    most = max(levels)

    def emit(parts):
        h = np.sort(np.concatenate(parts)) >> np.uint64(64 - ranges - 24)
        if len(h) > most:                                    # at most ``most`` of a cell
            h = h[np.concatenate((np.ones(most, bool), h[most:] != h[:-most]))]
        cuts = np.searchsorted(h >> np.uint64(24), np.arange((1 << ranges) + 1, dtype=np.uint64))
        cells = (h & np.uint64((1 << 24) - 1)).astype(np.uint32)
        kept = [(r, _planes(cells[cuts[r]:cuts[r + 1]])) for r in range(1 << ranges) if cuts[r] < cuts[r + 1]]
        return pa.RecordBatch.from_arrays([pa.array([r for r, _ in kept], pa.int32()),
                                           pa.array([b for _, b in kept], pa.binary())], names=["r", "cells"])

    def blocks(batches):
        parts, size = [], 0
        for batch in batches:
            for h in hashes(batch):
                parts.append(h)
                size += len(h)
                if size >= _BLOCK:
                    yield emit(parts)
                    parts, size = [], 0
        if size:
            yield emit(parts)

    def count(key, table):
        cells = np.sort(np.concatenate([_cells(b.as_py()) for b in table.column("cells")]))
        at = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
        n = np.diff(np.append(at, len(cells)))
        spot = ((np.uint64(key[0].as_py()) << np.uint64(24)) | cells[at]) >> np.uint64(ranges + 24 - bits_log2)
        out = []
        for level in levels:
            marked = spot[n >= level]
            if len(marked):
                word, first = np.unique(marked >> np.uint64(6), return_index=True)
                bits = np.bitwise_or.reduceat(np.uint64(1) << (marked & np.uint64(63)), first)
                out.append((np.full(len(word), level), word, bits, np.diff(np.append(first, len(marked)))))
        columns = [np.concatenate(c) if out else np.empty(0, np.int64) for c in (zip(*out) if out else [()] * 4)]
        return pa.table({k: pa.array(c.astype(np.uint64).view(np.int64)) for k, c in zip(("level", "w", "b", "n"), columns)})

    words = (rows.mapInArrow(blocks, "r int, cells binary").groupBy("r")
             .applyInArrow(count, "level long, w long, b long, n long")
             .groupBy("level", "w").agg(F.bit_or("b").alias("b"), F.sum("n").alias("n"))).toArrow()
    found = {}
    level, w, b, n = (words.column(c).to_numpy() for c in ("level", "w", "b", "n"))
    for k in levels:                                         # at most 2**(bits_log2 - 6) words each
        bits = np.zeros(1 << (bits_log2 - 6), dtype=np.uint64)
        bits[w[level == k]] = b[level == k].view(np.uint64)
        found[k] = bits, int(n[level == k].sum())
    return found
