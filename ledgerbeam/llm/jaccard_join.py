"""N-gram Jaccard join by MinHash banding, verified on the full n-gram sets."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerbeam.llm.common import (
    join_groups,
    map_batches,
    row_hash,
    rows_of,
    stored,
    text_of,
    without_repeats,
)
from ledgerbeam.llm.components import connected

N = 5  # words of an n-gram
SIMILARITY = 0.8
RECALL = 0.9999  # of pairs that are just similar enough
MOST_HASHES = 128
MOST_WORDS = 200_000  # hashes of words that a task remembers
CELL = 256  # members of a bucket that meet in one task at once, from each side

_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def banding(similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """Bands and rows for the target recall: a pair meets in some band with probability
    ``1 - (1 - similarity^rows)^bands``. More rows let fewer dissimilar pairs meet, so the
    most that ``MOST_HASHES`` allows are taken."""
    best = None
    for rows in range(1, 17):
        meet = similarity**rows
        bands = math.ceil(math.log(1 - recall) / math.log1p(-meet)) if meet < 1 else 1
        if bands * rows <= MOST_HASHES:
            best = (bands, rows)
    if best is None:
        raise ValueError(f"no banding of {MOST_HASHES} hashes reaches a recall of {recall}")
    return best


class Shingler:
    """Hashes of a text's n-grams: lower-cased runs of letters and digits, ``N`` at a time."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def words(self, text: str) -> np.ndarray:
        known = self.known
        if len(known) > MOST_WORDS:
            known.clear()
        found = _WORD.findall(text.lower())
        try:
            hashes = [known[w] for w in found]
        except KeyError:
            for w in found:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            hashes = [known[w] for w in found]
        return np.array(hashes, dtype=np.uint64)

    @staticmethod
    def ngrams(words: np.ndarray) -> np.ndarray:
        """One hash per position; a text of fewer words is one n-gram, of none has none."""
        if not len(words):
            return words
        width = min(N, len(words))
        count = len(words) - width + 1
        h = np.full(count, width, dtype=np.uint64)
        for i in range(width):
            h = (h ^ words[i : i + count]) * _MIX
            h ^= h >> np.uint64(29)
        h *= _STEP
        return h ^ (h >> np.uint64(32))

    def ngram_set(self, text: str) -> np.ndarray:
        return np.unique(self.ngrams(self.words(text)))


@cache
def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_000)
    a = rng.integers(0, 2**32, size=(count, 1), dtype=np.uint32) | np.uint32(1)
    return a, rng.integers(0, 2**32, size=(count, 1), dtype=np.uint32)


def band_hashes(ngrams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key per band, different for equal minima in different bands."""
    a, b = _permutations(bands * rows)
    folded = (ngrams >> np.uint64(32)).astype(np.uint32)
    least = np.full(bands * rows, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(folded), 2048):
        least = np.minimum(least, (folded[at : at + 2048] * a + b).min(axis=1))
    minima = least.reshape(bands, rows)
    keys = [xxhash.xxh3_64_intdigest(minima[k].tobytes(), seed=k) for k in range(bands)]
    return np.array(keys, dtype=np.uint64).view(np.int64)


def _signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            copies, keys = [], []
            for text in batch["text"].to_pylist():
                words = shingler.words(text)
                if len(words):
                    copies.append(xxhash.xxh3_128_digest(words.tobytes()))
                    keys.append(band_hashes(shingler.ngrams(words), bands, rows))
                else:
                    copies.append(None)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    batch["row_hash"],
                    pa.array(copies, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                names=["doc_id", "row_hash", "copy", "bands"],
            )

    narrow = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        row_hash(docs).alias("row_hash"),
        text_of(docs).alias("text"),
    )
    return map_batches(narrow, work, "doc_id long, row_hash long, copy binary, bands array<long>")


def _cells(members: DataFrame) -> DataFrame:
    """Deal each bucket over cells of two parts of about ``CELL`` members.

    A bucket of up to ``CELL`` is one cell. A larger one is cut into parts by a hash, and
    each pair of parts is a cell, so any two members meet in exactly one cell and no
    bucket, however hot, is ever gathered in a task.
    """
    parts = F.ceil(F.col("n") / CELL).cast("int")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    return (
        members.withColumn("parts", parts)
        .withColumn("part", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            F.struct("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")).alias("cell"),
            "part",
            "node",
        )
    )


def _first_met(bands: np.ndarray, key: int) -> np.ndarray:
    """Which pairs of members meet in the bucket ``key`` and in no earlier band."""
    band = int(np.flatnonzero(bands[0] == key)[0])
    met = np.zeros((len(bands), len(bands)), dtype=bool)
    for k in range(band):
        met |= bands[:, k, None] == bands[None, :, k]
    return ~met


def _pairs(bands: np.ndarray, parts: np.ndarray, key: int) -> np.ndarray:
    """The pairs that a cell has to decide, as the upper half of a matrix."""
    pairs = np.triu(_first_met(bands, key), 1)
    if (parts != parts[0]).any():  # two parts: those within one have a cell of their own
        pairs &= parts[:, None] != parts[None, :]
    return pairs


def _overlaps(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Sizes of the intersections, at least of the pairs asked for."""
    shared = np.zeros(pairs.shape, dtype=np.float32)
    if pairs.sum() <= 2 * len(sets):
        for i, j in np.argwhere(pairs):
            shared[i, j] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return shared
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times[column] > 1  # an n-gram of one text only is in no intersection
    owner, column = owner[common], column[common]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = 4096
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        block = np.zeros((len(sets), width), dtype=np.float32)
        block[owner[a:b], column[a:b] - low] = 1
        shared += block @ block.T
    return shared


def _local_roots(linked: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The least node that each can reach by links inside the cell."""
    both = linked | linked.T
    roots = nodes.copy()
    open_ = np.ones(len(nodes), dtype=bool)
    for start in np.argsort(nodes):
        if not open_[start]:
            continue
        reach = np.zeros(len(nodes), dtype=bool)
        reach[start] = True
        edge = reach
        while edge.any():
            edge = both[edge].any(axis=0) & ~reach
            reach |= edge
        roots[reach], open_[reach] = nodes[start], False
    return roots


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows arrive sorted by cell; a cell may go over the end of a batch."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["cell"] != row["cell"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _by_cells(df: DataFrame) -> DataFrame:
    return df.repartition("cell").sortWithinPartitions("cell")


def _undecided(rows: DataFrame) -> DataFrame:
    """Members of cells that have a pair to decide there: cell, part, node, bands."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _by_cell(batches):
            if len(cell) < 2:
                continue
            bands = np.array([r["bands"] for r in cell], dtype=np.int64)
            parts = np.array([r["part"] for r in cell])
            pairs = _pairs(bands, parts, cell[0]["cell"]["key"])
            used = pairs.any(axis=0) | pairs.any(axis=1)
            if used.any():
                yield pa.RecordBatch.from_pylist(
                    [r for r, u in zip(cell, used, strict=True) if u], schema=schema
                )

    schema = to_arrow_schema(rows.schema)
    return map_batches(_by_cells(rows), work, rows.schema)


def _decided(rows: DataFrame, similarity: float) -> DataFrame:
    """Verify the pairs of each cell on their n-gram sets: node, links, root."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _by_cell(batches):
            if len(cell) < 2:
                continue
            bands = np.array([r["bands"] for r in cell], dtype=np.int64)
            parts = np.array([r["part"] for r in cell])
            nodes = np.array([r["node"] for r in cell], dtype=np.int64)
            sets = [np.frombuffer(r["ngrams"], dtype=np.uint64) for r in cell]
            sizes = np.array([len(s) for s in sets], dtype=np.float64)
            pairs = _pairs(bands, parts, cell[0]["cell"]["key"])
            shared = _overlaps(sets, pairs)
            union = sizes[:, None] + sizes[None, :] - shared
            linked = pairs & (shared >= similarity * union - 1e-9)
            links = linked.sum(axis=0) + linked.sum(axis=1)
            found = links > 0
            if found.any():
                roots = _local_roots(linked, nodes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(nodes[found]),
                        pa.array(links[found].astype(np.int64)),
                        pa.array(roots[found]),
                    ],
                    names=["node", "links", "root"],
                )

    return map_batches(_by_cells(rows), work, "node long, links long, root long")


def _ngram_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The sorted n-gram hashes of each wanted text (node, doc_id, row_hash)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            sets = [shingler.ngram_set(t).tobytes() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["row_hash"], pa.array(sets, pa.binary())],
                names=["doc_id", "row_hash", "ngrams"],
            )

    texts = rows_of(docs, wanted)
    narrow = texts.select(
        texts["doc_id"].cast("long").alias("doc_id"),
        row_hash(texts).alias("row_hash"),
        text_of(texts).alias("text"),
    )
    sets = map_batches(narrow, work, "doc_id long, row_hash long, ngrams binary")
    sets = sets.dropDuplicates(["doc_id", "row_hash"])
    same = wanted["doc_id"].eqNullSafe(sets["doc_id"]) & (wanted["row_hash"] == sets["row_hash"])
    return wanted.join(sets, same).select("node", "ngrams")


def jaccard_join(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """Link the texts of ``docs`` (doc_id, text) whose ``N``-gram sets are similar.

    1. One scan hashes each text's n-grams into ``bands`` keys (``banding``). Texts with
       the same words are copies, represented by the smallest doc_id.
    2. Keys are shuffled. Those that occur once are gone; the other buckets are dealt over
       cells of bounded size, and a pair is decided in the first band that it meets in.
    3. Only texts with a pair to decide are read again. Their full n-gram sets go to the
       cells, which give each text its number of links there and its local root: as many
       rows as members, never a row per pair.
    4. Roots are joined into classes by label propagation.

    Returned, one row per row of ``docs``: doc_id, row_hash, copy_id (smallest doc_id with
    the same words), links (number of other texts, copies counted once, with a Jaccard
    similarity of ``similarity`` or more), class_id (smallest doc_id that links lead to)
    and kept (one row of each class: that of class_id).

    A pair just similar enough is found with probability ``recall``, a more similar one
    with a higher one; no other pair is linked, since all are verified. A text of fewer
    than ``N`` words is one n-gram. A missing or empty text, or one without words, has no
    n-grams: it is a copy of none, a class of its own without links, and is kept. A missing
    doc_id sorts first. Repeated rows are copies; one of them at most is kept. Other columns
    are not read, whatever their names.
    """
    return _joined(docs, _stored_signatures(docs, similarity, recall), similarity)


def _stored_signatures(docs: DataFrame, similarity: float, recall: float) -> DataFrame:
    signed = _signatures(docs, *banding(similarity, recall))
    return stored(signed.withColumn("row", F.monotonically_increasing_id()))


def _joined(docs: DataFrame, signed: DataFrame, similarity: float) -> DataFrame:
    classes = stored(
        signed.filter("copy IS NOT NULL")
        .groupBy("copy")
        .agg(
            F.min(F.struct("doc_id", "row", "row_hash")).alias("best"),
            F.first("bands").alias("bands"),
            F.count("*").alias("n"),
        )
        .select("copy", "best", F.col("best.row").alias("node"), "bands", "n")
    )
    keys = classes.select("node", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = keys.join(buckets, "key")
    undecided = stored(_undecided(_cells(members).join(classes.select("node", "bands"), "node")
                                  .select("cell", "part", "node", "bands")))
    wanted = (
        undecided.select("node")
        .distinct()
        .join(classes, "node")
        .select("node", "best.doc_id", "best.row_hash")
    )
    decided = stored(
        _decided(
            undecided.join(_ngram_sets(docs, wanted), "node").select(
                "cell", "part", "node", "bands", "ngrams"
            ),
            similarity,
        )
    )
    links = decided.groupBy("node").agg(F.sum("links").alias("links"))
    labels = connected(decided.select("node", "root"))
    placed = classes.select("copy", "best", "node", "n").join(
        links.join(labels, "node", "left"), "node", "left"
    )
    placed = placed.withColumn("label", F.coalesce("label", "node"))
    classed = stored(
        placed.groupBy("label").agg(F.min("best").alias("first"), F.count("*").alias("members"))
    )
    known = stored(
        join_groups(placed, classed, ["label"], "members").select("copy", "best", "first", "links", "n")
    )
    alone = F.col("best").isNull()
    copies = join_groups(signed.filter("copy IS NOT NULL"), known, ["copy"], "n")
    rest = signed.filter("copy IS NULL")
    return copies.unionByName(rest, allowMissingColumns=True).select(
        "doc_id",
        "row_hash",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("copy_id"),
        F.coalesce("links", F.lit(0).cast("long")).alias("links"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        (alone | (F.col("first.row") == F.col("row"))).alias("kept"),
    )


def keep_one_of_each_class(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, whole and with all their columns."""
    signed = _stored_signatures(docs, SIMILARITY, RECALL)
    kept = _joined(docs, signed, SIMILARITY).filter("kept")
    return without_repeats(rows_of(docs, kept), signed)
