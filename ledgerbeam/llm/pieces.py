"""SentencePiece encoding by streaming Viterbi, and decoding."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerbeam.llm.common import map_batches, text_of
from ledgerbeam.llm.words import Remembered

SPACE = "▁"  # how the vocabulary writes a space
UNKNOWN_PENALTY = 10.0  # fixed value: what the format takes off for an unknown character
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message, undecoded."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield tag >> 3, data[at : at + size]
            at += size


class PieceModel:
    """Pieces, scores and settings of a model file.

    Unigram models: the best segmentation has the highest sum of scores. Merge models
    (BPE): scores rank merges, and the right segmentation is the one in which every two
    neighbours are what merging makes of their joint text; exactly one segmentation of
    each prefix has that property, so the same lattice is walked with that test in place
    of the sum.
    """

    NORMAL, USER, BYTE = 1, 4, 6  # fixed values of the file format

    def __init__(self, path: str) -> None:
        import struct

        with open(path, "rb") as f:
            data = f.read()
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.merges = False
        self.dummy_prefix, self.tidy, charsmap = True, True, b""
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                self.kinds.append(piece.get(3, self.NORMAL))
            elif field == 2:
                self.merges = dict(_fields(value)).get(3, 1) == 2
            elif field == 3:
                norm = dict(_fields(value))
                self.dummy_prefix = bool(norm.get(3, 1))
                self.tidy = bool(norm.get(4, 1))
                charsmap = norm.get(2, b"")
        if charsmap:
            raise ValueError("models that rewrite characters are not supported")
        self.ids = {
            p: i
            for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True))
            if k in (self.NORMAL, self.USER)
        }
        self.bytes = {
            int(p[3:5], 16): i
            for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True))
            if k == self.BYTE
        }
        self.unknown = self.kinds.index(2)
        self.longest = max(map(len, self.ids))
        self.worst = min(s for s, k in zip(self.scores, self.kinds, strict=True) if k == 1)
        # Without a piece that goes on behind a space, every word starts a new piece.
        self.word_bound = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.spanned = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.fits: dict[tuple[str, str], bool] = {}

    def normalised(self, text: str) -> str:
        if self.tidy:
            text = re.sub(" +", " ", text).strip(" ")
        if self.dummy_prefix and text:
            text = " " + text
        return text.replace(" ", SPACE)

    def merged(self, text: str) -> list[str]:
        """Merge the characters of a short text, best score first, then leftmost."""
        parts = list(text)
        while True:
            best = None
            for i in range(len(parts) - 1):
                found = self.ids.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or self.scores[found] > best[0]):
                    best = self.scores[found], i
            if best is None:
                return parts
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def neighbours(self, left: str, right: str) -> bool:
        """Whether merging their joint text gives back these two pieces."""
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) > 500_000:
                self.fits.clear()
            known = self.fits[left, right] = self.merged(left + right) == [left, right]
        return known


    def segments(self, word: str) -> list[str]:
        """``word`` cut where no piece has both neighbouring characters: all paths meet."""
        spanned, found, start = self.spanned, [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in spanned:
                found.append(word[start:i])
                start = i
        found.append(word[start:])
        return found


class StreamingEncoder:
    """Viterbi over a stream of characters with a bounded window.

    Behind each position only the best piece that ends there is kept, for as many
    positions as the longest piece has characters: no later piece starts further back.
    Their backpointers are followed until they meet. What lies before that boundary can
    not change any more, so its pieces are given out and the characters forgotten. A
    window of text in which paths do not meet is kept until they do; characters that no
    piece spans make them meet at once.
    """

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        self.text = ""  # not yet given out
        self.done = 0  # characters of it that have been looked at
        self.best: list[float | None] = [0.0]  # by position: score of the best path, None: no path
        self.start = [0]  # by position: where its last piece starts
        self.before = ""  # the last piece given out

    def _step(self) -> None:
        """Find the last piece of the text that ends one character further."""
        if self.model.merges:
            self._step_by_merges()
        else:
            self._step_by_scores()

    def _step_by_merges(self) -> None:
        ids, fits, text = self.model.ids, self.model.fits, self.text
        end = self.done + 1
        start = max(0, end - self.model.longest)
        while start < end - 1:
            piece = text[start:end]
            if piece in ids:
                left = text[self.start[start] : start] if start else self.before
                fit = fits.get((left, piece))
                if (self.model.neighbours(left, piece) if fit is None else fit) or not left:
                    break
            start += 1
        self.done = end
        self.best.append(0.0)
        self.start.append(start)

    def _step_by_scores(self) -> None:
        model, end = self.model, self.done + 1
        chosen: tuple[float, int] | None = None
        for start in range(max(0, end - model.longest), end):
            so_far = self.best[start]
            if so_far is None:
                continue
            found = model.ids.get(self.text[start:end])
            single = end - start == 1
            if found is None and not single:
                continue
            gain = model.scores[found] if found is not None else model.worst - UNKNOWN_PENALTY
            if chosen is None or so_far + gain > chosen[0]:
                chosen = so_far + gain, start
        self.done = end
        self.best.append(None if chosen is None else chosen[0])
        self.start.append(end - 1 if chosen is None else chosen[1])

    def _met(self) -> int:
        """The last boundary that all surviving paths go through."""
        low = max(0, self.done + 1 - self.model.longest)
        ends = {e for e in range(low, self.done + 1) if self.best[e] is not None}
        while len(ends) > 1:
            furthest = max(ends)
            ends.remove(furthest)
            ends.add(self.start[furthest])
        return ends.pop()

    def _give(self, upto: int) -> list[str]:
        found = []
        end = upto
        while end:
            found.append(self.text[self.start[end] : end])
            end = self.start[end]
        found.reverse()
        if found:
            self.before = found[-1]
            self.text = self.text[upto:]
            base = self.best[upto]
            self.best = [None if b is None else b - base for b in self.best[upto:]]
            self.start = [max(0, s - upto) for s in self.start[upto:]]
            self.done -= upto
        return found

    def feed(self, text: str) -> list[str]:
        """Take more characters; returned are the pieces that are now certain."""
        given = []
        for at in range(0, len(text), self.model.longest):
            self.text += text[at : at + self.model.longest]
            while self.done < len(self.text):
                self._step()
            given += self._give(self._met())
        return given

    def finish(self) -> list[str]:
        given = self._give(self.done)
        self.best, self.start, self.before = [0.0], [0], ""
        return given

    def whole(self, text: str) -> list[str]:
        """The pieces of a whole text. One within the window ends before it has to move."""
        if len(text) > self.model.longest or not self.model.merges:
            return self.feed(text) + self.finish()
        ids, fits = self.model.ids, self.model.fits
        last, starts = [""], [0]  # by position
        for end in range(1, len(text) + 1):
            for start in range(end):
                piece = text[start:end]
                if piece in ids and start < end - 1:
                    left = last[start]
                    fit = fits.get((left, piece)) if left else True
                    if self.model.neighbours(left, piece) if fit is None else fit:
                        break
            last.append(piece)
            starts.append(start)
        found, end = [], len(text)
        while end:
            found.append(last[end])
            end = starts[end]
        return found[::-1]


class PieceCodec:
    """Ids of texts, and texts of ids. Where no piece goes on behind a space, the paths
    meet at every word's start, so words are encoded one by one and remembered."""

    def __init__(self, path: str) -> None:
        self.model = PieceModel(path)
        self.stream = StreamingEncoder(self.model)
        self.words, self.parts = Remembered(200_000), Remembered(200_000)
        self.texts = [
            b"" if k in (2, 3) else bytes([int(p[3:5], 16)]) if k == 6 else p.replace(SPACE, " ").encode()
            for p, k in zip(self.model.pieces, self.model.kinds, strict=True)
        ]
        self.texts[self.model.unknown] = " ⁇ ".encode()

    def _ids(self, pieces: list[str]) -> bytes:
        ids = array("I")
        for piece in pieces:
            found = self.model.ids.get(piece)
            if found is not None:
                ids.append(found)
            elif self.model.bytes:
                ids.extend(self.model.bytes[b] for b in piece.encode())
            elif not ids or ids[-1] != self.model.unknown:
                ids.append(self.model.unknown)
        return ids.tobytes()

    def _word(self, word: str) -> bytes:
        found = self.words.old.get(word)
        if found is None:
            found = b"".join([self._segment(s) for s in self.model.segments(word)])
        self.words.put(word, found)
        return found

    def _segment(self, segment: str) -> bytes:
        found = self.parts.young.get(segment) or self.parts.old.get(segment)
        if found is None:
            found = self._ids(self.stream.whole(segment))
            self.parts.put(segment, found)
        return found

    def encode(self, text: str) -> bytes:
        """Ids as unsigned 32-bit integers."""
        text = self.model.normalised(text)
        if not self.model.word_bound:
            return self._ids(self.stream.whole(text))
        known = self.words.young.get
        return b"".join([known(w) or self._word(w) for w in _WORD.findall(text)])

    def decode(self, ids: bytes) -> str:
        """The text of the ids, without the space that encoding puts first."""
        texts = self.texts
        joined = b"".join([texts[i] for i in array("I", ids)])
        text = joined.decode(errors="replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


@cache
def piece_codec(path: str) -> PieceCodec:
    """One per Python worker and file; ``path`` is a file that every executor has."""
    return PieceCodec(path)


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """Encode each whole text of ``docs`` (doc_id, text): doc_id, ids (array of int).

    Each text is encoded where it is read; nothing is shuffled. A missing or empty text has
    no ids. Characters outside the vocabulary become byte pieces, where it has them.
    Repeated rows are encoded each. Other columns are not read, whatever their names.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = piece_codec(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                found = [array("i", codec.encode(t)) for t in some["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [some["doc_id"], pa.array([memoryview(f) for f in found], pa.list_(pa.int32()))],
                    names=["doc_id", "ids"],
                )

    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return map_batches(narrow, work, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """The inverse of ``encode``: doc_id, text. Missing ids count as none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = piece_codec(model_path)
        for batch in batches:
            texts = [
                codec.decode(array("i", ids or ()).tobytes()) for ids in batch["ids"].to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"]
            )

    return map_batches(
        encoded.select(encoded["doc_id"].cast("long").alias("doc_id"), "ids"),
        work,
        "doc_id long, text string",
    )


def digest(docs: DataFrame, model_path: str) -> DataFrame:
    """What the round trip of each text gives: doc_id, n_ids, ids_crc32 (of the ids as
    unsigned 32-bit integers), text_crc32 (of the decoded text in UTF-8) and exact
    (whether it is the text that was encoded; a missing one counts as empty)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = piece_codec(model_path)
        for batch in batches:
            rows = []
            for text in batch["text"].to_pylist():
                ids = codec.encode(text)
                back = codec.decode(ids)
                rows.append(
                    (len(ids) // 4, zlib.crc32(ids), zlib.crc32(back.encode()), back == text)
                )
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    *(pa.array(c, pa.int64()) for c in columns[:3]),
                    pa.array(columns[3], pa.bool_()),
                ],
                names=["doc_id", "n_ids", "ids_crc32", "text_crc32", "exact"],
            )

    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return map_batches(
        narrow, work, "doc_id long, n_ids long, ids_crc32 long, text_crc32 long, exact boolean"
    )
