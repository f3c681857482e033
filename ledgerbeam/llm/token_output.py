"""Token ids as packed matrices, by best-fit-decreasing with a segment tree over room."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerbeam.llm.common import map_batches, text_of
from ledgerbeam.llm.words import Remembered

CAPACITY = 2048
WINDOW_TOKENS = 2_000_000  # tokens packed at once by a task; 8 MB
# Fixed value: the pattern that splits text before the merges of the rank files.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# White space goes with the word behind it: the pattern never joins a word to white space
# that follows it. The separators 1c to 1f are white space to Python alone.
_CHUNK = re.compile(r"\s*\S+|\s+")
_ODD = re.compile("[\x1c-\x1f]")


class RankEncoder:
    """Ids of a byte-level rank vocabulary; each chunk is merged once and remembered."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.end = max(ranks.values()) + 1  # the free id that ends a document
        self.encoding = tiktoken.Encoding(
            path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}
        )
        self.known = Remembered(250_000)

    def _chunk(self, chunk: str) -> bytes:
        found = self.known.old.get(chunk)
        if found is None:
            found = np.array(self.encoding.encode_ordinary(chunk), dtype="<i4").tobytes()
        self.known.put(chunk, found)
        return found

    def ids(self, text: str) -> np.ndarray:
        """The text's ids and the id that ends it."""
        text = text.encode("utf-8", "replace").decode()
        if _ODD.search(text):
            ids = np.array(self.encoding.encode_ordinary(text), dtype="<i4")
        else:
            known, chunk = self.known.young.get, self._chunk
            found = b"".join([known(c) or chunk(c) for c in _CHUNK.findall(text)])
            ids = np.frombuffer(found, dtype="<i4")
        return np.append(ids, np.int32(self.end))


@cache
def rank_encoder(path: str) -> RankEncoder:
    """One per Python worker and file; ``path`` is a file that every executor has."""
    return RankEncoder(path)


class RoomTree:
    """Bins by the room they have left: a segment tree finds the least room that suffices."""

    def __init__(self, capacity: int) -> None:
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)  # bins in the range of rooms below each node
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        at = room + self.width
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, room: int, index: int) -> None:
        self.bins[room].append(index)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return a bin with the least room of at least ``need``, and its room."""
        at = need + self.width
        if not self.count[at]:
            while at & 1 or not self.count[at + 1]:  # up, until the right neighbour has some
                at >>= 1
                if at <= 1:
                    return None
            at += 1
            while at < self.width:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.width
        self._add(room, -1)
        return self.bins[room].pop(), room


def best_fit_decreasing(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Positions of ``lengths`` by bin: longest first, each to the fullest bin that takes it."""
    tree, bins = RoomTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[i])
        if found is None:
            index, room = len(bins), capacity
            bins.append([])
        else:
            index, room = found
        bins[index].append(i)
        if room > lengths[i]:
            tree.put(room - lengths[i], index)
    return bins


SEQUENCES = (
    "sequence_id long, n_tokens int, ids binary, cu_seqlens array<int>, positions binary, "
    "doc_ids array<long>, starts array<long>"
)


def packed_matrices(docs: DataFrame, ranks_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Rows of ``capacity`` ids, packed from all of ``docs`` (doc_id, text).

    Each task tokenises its documents, cuts those longer than ``capacity`` without loss,
    and packs every ``WINDOW_TOKENS`` tokens best-fit-decreasing. Nothing is shuffled and
    memory is bounded by the window; the price is ill-filled rows in every window.
    A task that is run again gives the same rows.

    Returned: sequence_id, n_tokens, ids (``capacity`` little-endian 32-bit ids, the unused
    end filled with the end-of-document id), cu_seqlens (0 and the end of each piece),
    positions (32-bit, from 0 again at each piece and in the unused end), doc_ids and
    starts (of each piece: its document, and how many of its ids come before). A missing
    or empty text is one end-of-document id. Repeated rows are packed each; an empty table
    gives no rows. Other columns are not read, whatever their names.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = rank_encoder(ranks_path)
        numbered = TaskContext.get().partitionId() << 33
        held: list[tuple[int | None, int, np.ndarray]] = []
        tokens = 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal numbered, held, tokens
            bins = best_fit_decreasing([len(p[2]) for p in held], capacity)
            for at in range(0, len(bins), 512):
                rows = []
                for chosen in bins[at : at + 512]:
                    pieces = [held[i] for i in chosen]
                    sizes = [len(p[2]) for p in pieces]
                    used = sum(sizes)
                    ids = np.full(capacity, encoder.end, dtype="<i4")
                    ids[:used] = np.concatenate([p[2] for p in pieces])
                    ends = np.cumsum([0, *sizes])
                    firsts = np.repeat(
                        np.append(ends[:-1], used), [*sizes, capacity - used]
                    )
                    positions = (np.arange(capacity) - firsts).astype("<i4")
                    rows.append(
                        {
                            "sequence_id": numbered,
                            "n_tokens": used,
                            "ids": ids.tobytes(),
                            "cu_seqlens": ends.tolist(),
                            "positions": positions.tobytes(),
                            "doc_ids": [p[0] for p in pieces],
                            "starts": [p[1] for p in pieces],
                        }
                    )
                    numbered += 1
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
            held, tokens = [], 0

        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = encoder.ids(text)
                for start in range(0, len(ids), capacity):
                    held.append((doc_id, start, ids[start : start + capacity]))
                    tokens += len(held[-1][2])
                    if tokens >= WINDOW_TOKENS:
                        yield from packed()
        yield from packed()

    schema = pa.schema(
        [
            ("sequence_id", pa.int64()),
            ("n_tokens", pa.int32()),
            ("ids", pa.binary()),
            ("cu_seqlens", pa.list_(pa.int32())),
            ("positions", pa.binary()),
            ("doc_ids", pa.list_(pa.int64())),
            ("starts", pa.list_(pa.int64())),
        ]
    )
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return map_batches(narrow, work, SEQUENCES)


def write_matrices(packed: DataFrame, path: str) -> None:
    """Write what ``packed_matrices`` returns as Parquet, to any storage that Spark reaches.

    Every row's ``ids`` and ``positions`` have the same size, so a reader can view a column
    chunk as one matrix: ``np.frombuffer(b"".join(ids), "<i4").reshape(-1, capacity)``.
    """
    packed.write.parquet(path)
