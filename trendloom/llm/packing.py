"""Best-fit packing with large-item matching.

Documents become token sequences, only those longer than the capacity are cut.
How many pieces there are of each length is a histogram of at most ``capacity``
rows; the packing is decided on it:

* pieces above a third of the capacity are *large*, so that at most two share a
  sequence: the longest unmatched one is paired with the longest that still
  fits, again and again;
* smaller pieces, longest first, go into the fullest sequence that still has
  room (best fit), or open a new one.

Both steps move whole runs of equal lengths at once, so their work depends on
the capacity alone.  The result is a list of slot ranges (length, first rank,
last rank, first sequence, offset); the executors give every piece its rank
among those of its length (counts per task and length, prefix sums over the
tasks) and look its slot up.  No piece passes through the driver.

Edge cases: a null text is an empty text, whose document is the closing id
alone; an empty table gives an empty result; repeated rows are packed each on
its own; other columns are ignored; a document of any length is cut into full
pieces and a rest.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, in_slices, release_unused

CAPACITY = 4096
CLOSING_ID = 1
_CACHED_WORDS = 200_000
_KEPT_WORDS = 50_000             # after a task; those of the first texts: frequent ones are among them
_TOGETHER = 256                  # words encoded as one text, full stops between them
_LONGEST_CACHED = 48
#: Between a letter or digit and a mark after it.  Only letters that normalising
#: leaves one letter: others (a dotted capital I, say) end in a combining sign,
#: which the tokenizer joins with the mark.
_BEFORE_MARK = re.compile("(?<=[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f])(?=[.,;:!?*&%$#])")


class WordTokens(dict):
    """Word -> its ids as little-endian 32-bit bytes.

    The tokenizer never joins characters across white space, nor a Latin letter
    or digit with a mark after it, and ignores case: a text's ids are those of its
    words and marks in turn, and what was met before is not encoded again.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")      # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.stop = self.tokenizer.encode(".", add_special_tokens=False).ids[0]
        self[""] = b""

    @staticmethod
    def split(text: str) -> list[str]:
        """Parts that can be encoded apart; in lower case where that is safe."""
        if "<|" not in text and (text.isascii() or max(text) < "\u0100"):
            text = text.lower()
        return _BEFORE_MARK.sub(" ", text).replace("\n", " ").split(" ")

    def __missing__(self, word: str) -> bytes:
        """A word too long to keep."""
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def learn(self, words: set[str]) -> None:
        """Encode the new words of some texts in one call."""
        if len(self) > _CACHED_WORDS:
            self.forget()
        new = [w for w in words.difference(self) if len(w) <= _LONGEST_CACHED]
        plain = [w for w in new if w.isalnum()]                       # none holds a full stop
        groups = [plain[i:i + _TOGETHER] for i in range(0, len(plain), _TOGETHER)]
        joined = self.tokenizer.encode_batch_fast([" . ".join(g) for g in groups], add_special_tokens=False)
        for group, e in zip(groups, joined):
            ids = np.array(e.ids, dtype=np.uint32)
            ends = np.flatnonzero(ids == self.stop).tolist() + [len(ids)]
            if len(ends) == len(group):
                data, at = ids.tobytes(), 0
                for word, end in zip(group, ends):
                    self[word] = data[at:4 * end]
                    at = 4 * end + 4
        rest = [w for w in new if w not in self]
        for word, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            self[word] = array("I", e.ids).tobytes()

    def forget(self) -> None:
        """Keep the words met first."""
        while len(self) > _KEPT_WORDS:
            self.popitem()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        parts = [self.split(t) for t in texts]
        self.learn(set().union(*parts))
        for words in parts:
            yield b"".join(map(self.__getitem__, words))


@lru_cache(maxsize=1)
def _tokens(path: str) -> WordTokens:
    """One per worker process, kept from task to task, as other operators' tasks
    run beside it."""
    return WordTokens(path)


_CLOSING = np.array([CLOSING_ID], dtype="<u4").tobytes()


def _pieces(path: str, capacity: int):
    """Cut and digest the documents of a task, ranking equal lengths in it."""
    def run(batches):
        tokens = _tokens(path)
        seen = np.zeros(capacity + 1, dtype=np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            out = {n: [] for n in ("row", "piece", "start", "length", "crc", "rank")}
            for i, ids in enumerate(chain.from_iterable(map(tokens.encode, in_slices(batch)))):
                ids += _CLOSING
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    length = len(part) // 4
                    for n, v in (("row", i), ("piece", k), ("start", k * capacity), ("length", length),
                                 ("crc", zlib.crc32(part)), ("rank", int(seen[length]))):
                        out[n].append(v)
                    seen[length] += 1
            ids_of = batch.column("doc_id").take(pa.array(out["row"], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids_of, pa.array(out["piece"], pa.int32()), pa.array(out["start"], pa.int64()),
                 pa.array(out["length"], pa.int64()), pa.array(out["crc"], pa.int64()),
                 pa.array([task] * len(out["row"]), pa.int32()), pa.array(out["rank"], pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "task_rank"])
        tokens.forget()
        release_unused()
    return run


class _Runs:
    """Counts of equal things, longest run first; (size -> how many)."""

    def __init__(self, counts: dict[int, int]):
        self.left = {k: n for k, n in counts.items() if n > 0}
        self.sizes = sorted(self.left)

    def largest(self, at_most: int) -> int | None:
        i = bisect.bisect_right(self.sizes, at_most)
        return self.sizes[i - 1] if i else None

    def take(self, size: int, n: int) -> None:
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]
            del self.sizes[bisect.bisect_left(self.sizes, size)]


def plan_slots(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slot ranges (length, first rank, end rank, first sequence, offset) and
    the number of sequences.

    Rank ``r`` of a range lies in sequence ``first + r - first rank`` at the
    offset; a sequence is filled gapless from 0.
    """
    ranges: list[tuple[int, int, int, int, int]] = []
    used = dict.fromkeys(histogram, 0)                       # ranks given out by length
    gaps: dict[int, list[tuple[int, int]]] = {}              # room left -> runs of sequences
    sequences = 0

    def place(length: int, n: int, first: int, offset: int) -> None:
        ranges.append((length, used[length], used[length] + n, first, offset))
        used[length] += n

    large = _Runs({k: n for k, n in histogram.items() if 3 * k > capacity})
    while large.sizes:
        a = large.sizes[-1]
        n = large.left[a]
        b = large.largest(capacity - a)
        if b is None:
            large.take(a, n)
            place(a, n, sequences, 0)
        elif b == a and n == 1:
            large.take(a, 1)
            b = large.largest(capacity - a)                  # the next smaller one
            n = 1
            place(a, 1, sequences, 0)
            if b is not None:
                large.take(b, 1)
                place(b, 1, sequences, a)
        else:
            n = n // 2 if a == b else min(n, large.left[b])
            large.take(a, n)
            place(a, n, sequences, 0)
            large.take(b, n)
            place(b, n, sequences, a)
        filled = a + (b or 0)
        if filled < capacity:
            gaps.setdefault(capacity - filled, []).append((sequences, sequences + n))
        sequences += n

    rooms = sorted(gaps)
    for length in sorted((k for k in histogram if 3 * k <= capacity), reverse=True):
        n = histogram[length]
        while n:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):                              # open new ones, filled in layers
                opened = -(-n // (capacity // length))
                place(length, opened, sequences, 0)
                _add(gaps, rooms, capacity - length, (sequences, sequences + opened))
                sequences += opened
                n -= opened
                continue
            room = rooms[i]
            lo, hi = gaps[room].pop()
            if not gaps[room]:
                del gaps[room]
                del rooms[i]
            m = min(n, hi - lo)
            place(length, m, lo, capacity - room)
            n -= m
            if m < hi - lo:
                _add(gaps, rooms, room, (lo + m, hi))
            _add(gaps, rooms, room - length, (lo, lo + m))
    return ranges, sequences


def _add(gaps: dict, rooms: list[int], room: int, run: tuple[int, int]) -> None:
    if room:
        if room not in gaps:
            gaps[room] = []
            bisect.insort(rooms, room)
        gaps[room].append(run)


def pack(docs: DataFrame, tokenizer_path: str, *, key: str = "doc_id", text: str = "text",
         capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    scratch = Scratch(docs.sparkSession, "packing")
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    pieces = scratch.save(docs.mapInArrow(
        _pieces(tokenizer_path, capacity),
        f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, task_rank long"),
        "pieces")
    per_task = scratch.save(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "per_task")
    histogram = {r["length"]: r["n"] for r in
                 per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}   # <= capacity rows
    ranges, _ = plan_slots(histogram, capacity)
    ranges.sort()
    slots = docs.sparkSession.sparkContext.broadcast(         # their number depends on the capacity alone
        np.array(ranges, dtype=np.int64).reshape(-1, 5))

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("task_rank")).alias("rank"))

    def assign(batches):
        table = slots.value
        keys = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (batch.column("length").to_numpy() << 44) + rank, side="right") - 1
            chosen = table[at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
                + [pa.array(chosen[:, 3] + rank - chosen[:, 1]), pa.array(chosen[:, 4])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(
        assign, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, "
                "sequence_id long, offset long")
