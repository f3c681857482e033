"""Packing by exact complements: combinations that fill a gap exactly, then best fit."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerbeam.llm.common import map_batches, stored, text_of
from ledgerbeam.llm.words import word_encoder

CAPACITY = 2048
END_OF_TEXT = 0

PIECES = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
)


class Complements:
    """Available lengths, looked up by the sum that they must make.

    ``available[x]`` counts the items of length x. Sums of one, two and three lengths are
    found through the index; larger items are preferred, as they are harder to place.
    """

    def __init__(self, counts: np.ndarray) -> None:
        self.available = counts.copy()

    def pair(self, total: int, most: int) -> tuple[int, int] | None:
        """Lengths ``a >= b`` with ``a + b == total`` and ``a <= most``."""
        high = min(most, total - 1)
        low = (total + 1) // 2
        if high < low:
            return None
        larger = self.available[low : high + 1]
        smaller = self.available[total - high : total - low + 1][::-1]
        both = (larger > 0) & (smaller > 0)
        if total % 2 == 0:  # the same length twice
            both[0] = larger[0] > 1
        found = np.flatnonzero(both)
        return (low + int(found[-1]), total - low - int(found[-1])) if len(found) else None

    def fill(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that make up ``gap``."""
        if self.available[gap]:
            return (gap,)
        if pair := self.pair(gap, gap):
            return pair
        for a in np.flatnonzero(self.available[: gap - 1])[::-1].tolist():
            if 3 * a < gap:
                return None
            self.available[a] -= 1
            pair = self.pair(gap - a, a)
            self.available[a] += 1
            if pair:
                return (a, *pair)
        return None


    def largest(self, room: int) -> int:
        """The largest available length of at most ``room``, or 0."""
        found = np.flatnonzero(self.available[1 : room + 1])
        return int(found[-1]) + 1 if len(found) else 0

    def exact(self, length: int, capacity: int) -> tuple[int, ...] | None:
        """A pattern around ``length`` without room to spare. Where no complement of three
        reaches, the largest items are added until one does."""
        taken, room = [length], capacity - length
        self.available[length] -= 1
        rest: tuple[int, ...] | None = ()
        while room and not (rest := self.fill(room)):
            largest = self.largest(room)
            if not largest:
                break
            self.available[largest] -= 1
            taken.append(largest)
            room -= largest
        for x in taken:
            self.available[x] += 1
        return None if room and not rest else (*taken, *(rest or ()))


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """How to pack ``counts[x]`` items of each length x: patterns and how often each is used.

    From the largest length down: as long as available lengths fill the gap beside it
    exactly, that pattern is used as often as the counts allow. What has no complement is
    a residual. Residuals are packed best fit, largest first, all bins with the same room
    at once. The work depends on the number of lengths, not of items.
    """
    index = Complements(np.asarray(counts, dtype=np.int64))
    available = index.available
    used: list[tuple[tuple[int, ...], int]] = []
    residual: list[tuple[int, int]] = []
    for length in range(capacity, 0, -1):
        while available[length]:
            pattern = index.exact(length, capacity)
            if pattern is None:
                residual.append((length, int(available[length])))
                available[length] = 0
                break
            times = min(int(available[x]) // pattern.count(x) for x in set(pattern))
            for x in pattern:
                available[x] -= times
            used.append((pattern, times))
    return used + _best_fit(residual, capacity)


def _best_fit(residual: list[tuple[int, int]], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """``residual``: lengths, largest first, with their counts."""
    bins: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    rooms = np.zeros(capacity + 1, dtype=np.int64)  # bins by the room they have left

    def put(pattern: tuple[int, ...], room: int, n: int) -> None:
        bins[room][pattern] += n
        rooms[room] += n

    for length, n in residual:
        while n:
            fitting = np.flatnonzero(rooms[length:])
            if not len(fitting):
                each = min(capacity // length, n)
                put((length,) * each, capacity - each * length, n // each)
                n %= each
                continue
            room = length + int(fitting[0])
            pattern, there = next(iter(bins[room].items()))
            times = min(n, there)
            bins[room][pattern] -= times
            if not bins[room][pattern]:
                del bins[room][pattern]
            rooms[room] -= times
            put((*pattern, length), room - length, times)
            n -= times
    return [(p, n) for patterns in bins.values() for p, n in patterns.items() if n]


class Places:
    """Where the nth item of a length goes, from the plan: intervals of ranks by length."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]], capacity: int) -> None:
        taken = np.zeros(capacity + 1, dtype=np.int64)
        lengths, ranks, sequences, offsets = [], [], [], []
        sequence = 0
        for pattern, times in patterns:
            offset = 0
            for x in pattern:
                lengths.append(x)
                ranks.append(int(taken[x]))
                sequences.append(sequence)
                offsets.append(offset)
                taken[x] += times
                offset += x
            sequence += times
        order = np.lexsort((np.array(ranks, dtype=np.int64), np.array(lengths, dtype=np.int64)))
        self.lengths = np.array(lengths, dtype=np.int64)[order]
        self.ranks = np.array(ranks, dtype=np.int64)[order]
        self.sequences = np.array(sequences, dtype=np.int64)[order]
        self.offsets = np.array(offsets, dtype=np.int64)[order]
        self.first = np.searchsorted(self.lengths, np.arange(capacity + 2))

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.empty(len(lengths), dtype=np.int64)
        for x in np.unique(lengths):
            here = lengths == x
            low, high = self.first[x], self.first[x + 1]
            at[here] = low + np.searchsorted(self.ranks[low:high], ranks[here], "right") - 1
        return self.sequences[at] + ranks - self.ranks[at], self.offsets[at]


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise each text where it is read, end it with ``END_OF_TEXT``, and cut what is
    longer than ``capacity``. ``task`` and ``nth`` number the pieces of each length."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = word_encoder(tokenizer_path)
        task = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        end = END_OF_TEXT.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = encoder.ids(text) + end
                step = 4 * capacity
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    n = len(part) // 4
                    rows.append((doc_id, piece, at // 4, n, zlib.crc32(part), task, seen[n]))
                    seen[n] += 1
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"],
            )

    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return map_batches(narrow, work, PIECES)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack all of ``docs`` (doc_id, text) into few sequences of at most ``capacity`` tokens.

    1. Texts are tokenised and cut where they are read; one narrow row per piece is stored.
    2. Pieces are counted by length. The driver plans on those counts, at most ``capacity``
       numbers however many documents there are.
    3. A piece's rank among those of its length (its number in its task, plus what earlier
       tasks have) finds its place in the plan. No text, and no piece, meets another in a
       task, so no length or document can be too frequent.

    Returned: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A missing or
    empty text is the single token ``END_OF_TEXT``. Only documents longer than
    ``capacity`` are cut. Repeated rows are packed each. An empty table gives no rows.
    Other columns of ``docs`` are not read, whatever their names.
    """
    pieces = stored(pieces_of(docs, tokenizer_path, capacity))
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(
        Window.unboundedPreceding, -1
    )
    bases = stored(
        by_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    )
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in bases.groupBy("length").agg(F.sum("n")).collect():  # capacity rows at most
        counts[length] = n
    places = docs.sparkSession.sparkContext.broadcast(Places(plan(counts, capacity), capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sequence, offset = places.value.find(
                    batch["length"].to_numpy(), batch["rank"].to_numpy()
                )
                kept = [batch[i] for i in range(5)]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(sequence), pa.array(offset)],
                    names=[*batch.schema.names[:5], "sequence_id", "offset"],
                )

    ranked = pieces.join(bases.drop("n"), ["length", "task"]).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("base") + F.col("nth")).alias("rank"),
    )
    return map_batches(
        ranked,
        place,
        "doc_id long, piece int, start long, length long, ids_crc32 long, "
        "sequence_id long, offset long",
    )
