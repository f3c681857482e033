"""Fill-in-middle: cut texts at line boundaries that memoised chunk summaries locate."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerbeam.llm.common import map_batches, text_of

# What marks the parts in the output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))

SEED = 7
RATE = 100  # per cent of texts that are transformed
SUFFIX_FIRST = 50  # per cent of these in the form ``spm``

WINDOW = 16  # bytes that the rolling hash sees
MEAN_BITS = 10  # a boundary every 2^10 bytes on average
LEAST, MOST = 256, 8192  # bytes of a chunk
MEMORY = 16 << 20  # bytes of chunks that a generation remembers; a task keeps two

_BASE = np.uint32(0x01000193)
_SPREAD = np.uint32(0x9E3779B1)


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """The polynomial hash of the ``WINDOW`` bytes that end at each byte (fewer at the
    start), in log2(WINDOW) steps: a window is two halves."""
    h, power, width = data.astype(np.uint32) + np.uint32(1), _BASE, 1
    while width < WINDOW:
        longer = h.copy()
        longer[width:] += h[:-width] * power
        h, power, width = longer, power * power, 2 * width
    return h


def boundaries(data: np.ndarray) -> list[int]:
    """Where chunks end. A boundary depends on the bytes before it alone, so texts that
    share a passage of several chunks share chunks, wherever the passage stands."""
    if not len(data):
        return []
    with np.errstate(over="ignore"):
        marked = (rolling_hash(data) * _SPREAD) >> np.uint32(32 - MEAN_BITS) == 0
    ends, last = [], 0
    for end in (np.flatnonzero(marked) + 1).tolist():
        while end - last > MOST:
            last += MOST
            ends.append(last)
        if end - last >= LEAST:
            ends.append(end)
            last = end
    while len(data) - last > MOST:
        last += MOST
        ends.append(last)
    if last < len(data):
        ends.append(len(data))
    return ends


@dataclass(frozen=True)
class Summary:
    """What a chunk tells about boundaries: its length in code points, and for each of its
    line ends the byte and the code point after it. Counts of neighbours add up, also where
    a chunk ends inside a character."""

    points: int
    line_ends: np.ndarray
    points_at: np.ndarray

    @classmethod
    def of(cls, chunk: bytes) -> Summary:
        data = np.frombuffer(chunk, dtype=np.uint8)
        starts = (data & 0xC0) != 0x80  # first bytes of characters
        ends = np.flatnonzero(data == 10) + 1
        if len(ends):
            return cls(int(starts.sum()), ends, np.cumsum(starts)[ends - 1])
        return cls(int(starts.sum()), ends, ends)


class Summaries:
    """Summaries by content. A chunk is looked up by its hash and then compared byte by
    byte, which is what a dict does, so equal hashes cannot mix chunks up. Of two
    generations the old one goes when the young one holds ``MEMORY`` bytes."""

    def __init__(self, memory: int = MEMORY) -> None:
        self.memory, self.held = memory, 0
        self.young: dict[bytes, Summary] = {}
        self.old: dict[bytes, Summary] = {}
        self.made = self.met = 0

    def of(self, chunk: bytes) -> Summary:
        found = self.young.get(chunk)
        if found is not None:
            self.met += 1
            return found
        found = self.old.get(chunk)
        if found is None:
            found = Summary.of(chunk)
            self.made += 1
        else:
            self.met += 1
        if self.held >= self.memory:
            self.young, self.old, self.held = {}, self.young, 0
        self.young[chunk] = found
        self.held += len(chunk) + 16 * len(found.line_ends)
        return found


class Located:
    """A text's lines, counted from its chunks' summaries without a look at the text."""

    def __init__(self, text: bytes, summaries: Summaries) -> None:
        ends = boundaries(np.frombuffer(text, dtype=np.uint8))
        self.starts = [0, *ends]
        self.chunks = [summaries.of(text[a:b]) for a, b in zip(self.starts, ends, strict=False)]
        self.lines_before = np.cumsum([0] + [len(c.line_ends) for c in self.chunks])
        self.points_before = np.cumsum([0] + [c.points for c in self.chunks])
        unended = bool(text) and not text.endswith(b"\n")
        self.lines = int(self.lines_before[-1]) + unended

    def after(self, lines: int) -> tuple[int, int]:
        """Bytes and code points of the first ``lines`` lines."""
        if lines == 0:
            return 0, 0
        if lines > self.lines_before[-1]:  # the last line, which has no line end
            return self.starts[-1], int(self.points_before[-1])
        at = int(np.searchsorted(self.lines_before, lines)) - 1
        chunk, inside = self.chunks[at], lines - int(self.lines_before[at]) - 1
        return (
            self.starts[at] + int(chunk.line_ends[inside]),
            int(self.points_before[at]) + int(chunk.points_at[inside]),
        )


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers that depend on the seed and the id alone."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def rearranged(
    doc_id: int | None, text: bytes, summaries: Summaries, seed: int, rate: int, suffix_first: int
) -> tuple[int, str, int | None, int | None, bytes]:
    """Lines, form, code points of prefix and middle, and output of one text."""
    found = Located(text, summaries)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= rate or any(m in text for m in MARKS):
        return found.lines, "plain", None, None, text
    low, high = sorted((h1 % (found.lines + 1), h2 % (found.lines + 1)))
    (a, points_a), (b, points_b) = found.after(low), found.after(high)
    p, s, m = MARKS
    if h4 % 100 < suffix_first:
        form, parts = "spm", (s, text[b:], p, text[:a], m, text[a:b])
    else:
        form, parts = "psm", (p, text[:a], s, text[b:], m, text[a:b])
    return found.lines, form, points_a, points_b - points_a, b"".join(parts)


def fill_in_middle(
    docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST
) -> DataFrame:
    """Rearrange each text of ``docs`` (doc_id, text) for infilling, cut between lines.

    1. A rolling hash cuts the text into chunks whose ends depend on content. Chunks that
       occurred before, in this text or another of the task, are not read again: their
       summary is found by their content.
    2. The chunks' line counts are added up, so the chunk of any cut is found by a search
       over them, and the place inside it in its summary.
    3. Prefix, middle and suffix are put in the order of the form that the draws choose.

    Returned, one row per row of ``docs``: doc_id, n (lines; a last one without a line end
    counts), form (``plain``, ``psm``, ``spm``), prefix_chars and middle_chars (code points,
    NULL if plain) and output. ``restored`` gives the text back.

    Rows are independent and stay where they are read; nothing is shuffled, so no key, copy
    or passage can be hot, and a lost task is done again with the same result. A chunk is at
    most ``MOST`` bytes and the memory of chunks is bounded, so a task holds little beside
    its batch. A missing or empty text is plain and has no lines, its output is empty; a
    text that holds a mark is plain. A missing doc_id is drawn for as empty text. Equal
    texts under one id get equal outputs. Other columns are not read, whatever their names.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summaries = Summaries()
        for batch in batches:
            rows = [
                rearranged(doc_id, text, summaries, seed, rate, suffix_first)
                for doc_id, text in zip(
                    batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True
                )
            ]
            n, form, prefix, middle, output = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array(n, pa.int64()),
                    pa.array(form, pa.string()),
                    pa.array(prefix, pa.int64()),
                    pa.array(middle, pa.int64()),
                    pa.array(output, pa.binary()),
                ],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    narrow = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).cast("binary").alias("text")
    )
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"
    return map_batches(narrow, work, schema).withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Texts with a mark are plain, so each mark
    occurs once in the others, and a cut cannot make one: it leaves whole parts."""

    def before(mark: str, text: Column) -> Column:
        return F.substring_index(text, mark, 1)

    def after(mark: str, text: Column) -> Column:
        return F.substring_index(text, mark, -1)

    middle = after(MIDDLE, output)
    psm = F.concat(
        after(PREFIX, before(SUFFIX, output)), middle, after(SUFFIX, before(MIDDLE, output))
    )
    spm = F.concat(
        after(PREFIX, before(MIDDLE, output)), middle, after(SUFFIX, before(PREFIX, output))
    )
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
