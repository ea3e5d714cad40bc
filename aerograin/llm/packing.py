"""Best-fit packing of tokenised documents, reduced first by Martello-Toth dominance.

Bin packing needs only how many pieces have each length, and lengths run from 1 to the capacity: the corpus is reduced to
one histogram of at most `capacity` counts, whatever its size. On it

* dominance (Martello and Toth): for every length w, fix {w} where nothing fits beside it, {w, r} where r fills the bin
  exactly, and {w, r} where at most one more piece fits (r the longest that fits) or where at most two fit and no two that
  fit together are longer than r. A fixed set dominates every other filling of that bin, so an optimal packing contains it.
  A proof looks at every piece not fixed yet, and all lengths are tried again until nothing more is fixed;
* the rest goes best-fit decreasing, length by length and with multiplicities, into the fullest open bin that has room.

The plan is a list of runs (length, first rank, how many, first sequence, offset); pieces find their place by their rank
among the pieces of their length. Ranks come from counts per writer task, so no task ever sees all pieces of a length.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch, ship

CAPACITY = 2048
VOCABULARY = "byte_bpe_50k"
END_ID = 0

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"
PACKED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"

#: Texts made of these only are encoded by the rank form of the same vocabulary (same ids, three times as fast).
_PLAIN = re.compile("[^\t\n\r -~¡-ſ‐-‧€]")
_encoders: dict = {}


def encoders(json_path: str, rank_path: str | None, pattern: str | None):
    """(tokenizers' Tokenizer, tiktoken Encoding or None) of one vocabulary, made once a worker."""
    key = (json_path, rank_path)
    if key not in _encoders:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(json_path)
        t.encode_special_tokens = True
        fast = None
        if rank_path:
            import base64

            import tiktoken

            with open(rank_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _encoders[key] = (t, fast)
    return _encoders[key]


def token_ids(text: str, slow, fast) -> np.ndarray:
    if fast is not None and not _PLAIN.search(text):
        return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4")
    return np.array(slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole ones of `capacity`, the first one takes what is over."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


Run = tuple[int, int, int, int, int]


class _Fixer:
    """Martello-Toth dominance on the pieces that are not placed yet, all of them in sight of every proof."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {w: n for w, n in histogram.items() if n > 0}
        self.open = sorted(self.left)
        self.used: Counter = Counter()
        self.runs: list[Run] = []
        self.sequence = 0
        self.better: dict[int, tuple[int, int]] = {}  # a length -> two others that together beat its longest partner

    def fix(self, items: list[int]) -> None:
        """Place `items` together, as often as there are enough of them."""
        times = min(self.left[w] // k for w, k in Counter(items).items())
        offset = 0
        for w in items:
            self.runs.append((w, self.used[w], times, self.sequence, offset))
            self.used[w] += times
            self.left[w] -= times
            offset += w
        for w in set(items):
            if self.left[w] == 0:
                self.open.pop(bisect_left(self.open, w))
        self.sequence += times

    def there(self, w: int, beside: int) -> int:
        """How many pieces of length w are left beside one of length `beside`."""
        return self.left.get(w, 0) - (w == beside)

    def longest(self, room: int, beside: int) -> int | None:
        i = bisect_left(self.open, room + 1) - 1
        while i >= 0 and self.there(self.open[i], beside) <= 0:
            i -= 1
        return self.open[i] if i >= 0 else None

    def smallest(self, k: int, beside: int) -> int | None:
        """Sum of the k shortest pieces; None where there are fewer."""
        total = 0
        for w in self.open:
            n = min(k, self.there(w, beside))
            total += n * w
            k -= n
            if not k:
                return total
        return None

    def beaten(self, w: int, r: int, room: int) -> bool:
        """Whether two pieces that fit together into `room` are longer than r."""
        a, b = self.better.get(w, (0, 0))
        if a and a + b > r and self.there(a, w) > (a == b) and self.there(b, w) > 0:
            return True
        i = bisect_left(self.open, room // 2 + 1) - 1
        while i >= 0 and 2 * self.open[i] > r:  # two of one length
            if self.there(self.open[i], w) > 1:
                self.better[w] = (self.open[i], self.open[i])
                return True
            i -= 1
        others = [x for x in self.open[: bisect_left(self.open, room + 1)] if self.there(x, w) > 0]
        lo, hi = 0, len(others) - 1
        while lo < hi:
            both = others[lo] + others[hi]
            if both > room:
                hi -= 1
            elif both > r:
                self.better[w] = (others[lo], others[hi])
                return True
            else:
                lo += 1
        return False

    def settle(self, w: int) -> bool:
        """Fix a set that holds w and dominates every other one that does; False where none is proved."""
        room = self.capacity - w
        r = self.longest(room, w)
        if r is None:  # nothing fits beside it
            self.fix([w])
            return True
        two = self.smallest(2, w)
        if r < room and two is not None and two <= room:  # two may stand beside it
            three = self.smallest(3, w)
            if (three is not None and three <= room) or self.beaten(w, r, room):
                return False
        self.fix([w, r])
        return True

    def run(self) -> None:
        """From the longest length down, again and again until nothing more is proved."""
        moved = True
        while moved:
            moved = False
            for w in reversed(self.open.copy()):
                while self.left[w] and self.settle(w):
                    moved = True


def best_fit(left: dict[int, int], used: Counter, sequence: int, capacity: int) -> tuple[list[Run], int]:
    """Best fit decreasing: (runs, number of the next sequence). Bins are kept by room, as stretches of neighbouring ones."""
    used = Counter(used)
    runs: list[Run] = []
    rooms: list[int] = []
    bins: dict[int, list[list[int]]] = {}

    def put(room: int, first: int, n: int) -> None:
        if room not in bins:
            bins[room] = []
            insort(rooms, room)
        bins[room].append([first, n])

    def take(room: int, n: int) -> tuple[int, int]:
        first, have = bins[room][-1]
        k = min(n, have)
        if k == have:
            bins[room].pop()
            if not bins[room]:
                del bins[room]
                rooms.pop(bisect_left(rooms, room))
        else:
            bins[room][-1] = [first + k, have - k]
        return first, k

    for w in sorted(left, reverse=True):
        n = left[w]
        while n:
            i = bisect_left(rooms, w)
            if i < len(rooms):
                room = rooms[i]
                first, k = take(room, n)
                runs.append((w, used[w], k, first, capacity - room))
                put(room - w, first, k)
                used[w] += k
                n -= k
            else:  # new bins, each filled with as many of this length as it holds
                each = min(n, capacity // w)
                k = n // each
                for j in range(each):
                    runs.append((w, used[w], k, sequence, j * w))
                    used[w] += k
                put(capacity - each * w, sequence, k)
                sequence += k
                n -= k * each
    return runs, sequence


def plan(histogram: dict[int, int], capacity: int) -> list[Run]:
    """Runs (length, first rank, how many, first sequence, offset) that place every piece of the histogram.

    Dominance to a fixed point, then best fit decreasing for the rest; where best fit alone needs fewer sequences (taking
    pieces away can make it worse), its plan is the one returned.
    """
    fixer = _Fixer(histogram, capacity)
    fixer.run()
    rest, reduced = best_fit({w: n for w, n in fixer.left.items() if n}, fixer.used, fixer.sequence, capacity)
    plain, alone = best_fit({w: n for w, n in histogram.items() if n > 0}, Counter(), 0, capacity)
    return fixer.runs + rest if reduced <= alone else plain


def pieces(docs: DataFrame, json_path: str, rank_path: str | None = None, pattern: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every whole text: ids by the tokenizer, then id 0, cut where longer than `capacity`.

    `part` is the task that made the row and `nth` the row's rank among that task's pieces of its length.
    A null text reads as empty: one piece, its end id. Rows that repeat are documents of their own.
    """
    ship(docs.sparkSession)

    def encode(batches):
        from aerograin.llm import packing as own

        slow, fast = own.encoders(json_path, rank_path, pattern)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            out = [[] for _ in range(6)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(own.token_ids(text.as_py() or "", slow, fast), np.uint32(END_ID)).astype("<u4")
                for i, (start, length) in enumerate(own.cut(len(ids), capacity)):
                    for column, value in zip(out, (doc, i, start, length, zlib.crc32(ids[start : start + length].tobytes()), int(seen[length])), strict=True):
                        column.append(value)
                    seen[length] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            d, i, s, n, c, k = (pa.array(x, t) for x, t in zip(out, kinds, strict=True))
            yield pa.RecordBatch.from_arrays([d, i, s, n, c, pa.array(np.full(len(d), part, np.int32)), k], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(encode, PIECES)


def pack(docs: DataFrame, json_path: str, rank_path: str | None = None, pattern: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Place every piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only doc_id and text are read, so other columns may have any name. An empty table gives an empty result. Pieces of one
    length are alike to the packing: ties go by writer task, then by order in the task.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    made = scratch.keep(pieces(docs, json_path, rank_path, pattern, capacity), "pieces")
    counts = scratch.keep(made.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs = sorted(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", "length", "base")
    cols = np.array(runs, dtype=np.int64).reshape(-1, 5)
    # At most a few runs a length: the table's size depends on the capacity only.
    shared = spark.sparkContext.broadcast(cols)

    def place(batches):
        table = shared.value
        start = np.searchsorted(table[:, 0], np.arange(capacity + 2))
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for w in np.unique(length):
                mine, runs_of = np.flatnonzero(length == w), table[start[w] : start[w + 1]]
                run = runs_of[np.searchsorted(runs_of[:, 1], rank[mine], side="right") - 1]
                sequence[mine] = run[:, 3] + rank[mine] - run[:, 1]
                offset[mine] = run[:, 4]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # By merge: `base` grows with the number of writer tasks, so it is never sent to all.
    ranked = made.join(base.hint("merge"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("base")).alias("rank"))
    return ranked.mapInArrow(place, PACKED)
