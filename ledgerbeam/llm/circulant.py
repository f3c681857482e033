"""Near duplicates by circulant MinHash: two permutations, one of them shifted circularly."""

from __future__ import annotations

import math
from collections.abc import Iterator

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

WIDTH = 3  # words of a shingle
PER_CENT = 85  # of the union that the intersection has to reach
BANDS, ROWS = 25, 5  # a pair just similar enough meets with probability 0.9999996
MISSED = 1e-8  # chance that such a pair shows too few equal coordinates

SPLIT = 64  # members that are compared with one hub in one cell
ROUNDS, TRIES = 2, 3  # of further hubs in large open buckets, and hubs of a member in each
LARGE = 64  # members of such a bucket
CELL, CELL_BYTES = 256, 8 << 20  # members and bytes of shingles of each side of a cell
MOST_WORDS = 200_000  # hashes of words that a task remembers
BLOCK = 1024  # shingles whose coordinates are generated at once

_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def least_matches(per_cent: int = PER_CENT, coordinates: int = BANDS * ROWS) -> int:
    """Equal coordinates that all but ``MISSED`` of the pairs just similar enough have."""
    p, below = per_cent / 100, 0.0
    for k in range(coordinates + 1):
        below += math.comb(coordinates, k) * p**k * (1 - p) ** (coordinates - k)
        if below > MISSED:
            return k
    return coordinates


class Shingles:
    """Sorted 64-bit hashes of a text's shingles: ``WIDTH`` words in a row, A-Z lowered."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def words(self, text: bytes) -> np.ndarray:
        known = self.known
        if len(known) > MOST_WORDS:
            known.clear()
        found = text.lower().split()  # of bytes: A-Z, and the six white spaces of ASCII
        try:
            hashes = [known[w] for w in found]
        except KeyError:
            for w in found:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            hashes = [known[w] for w in found]
        return np.array(hashes, dtype=np.uint64)

    def of(self, text: bytes) -> np.ndarray:
        """Fewer words than ``WIDTH`` are one shingle together; no words have none."""
        words = self.words(text)
        width = min(WIDTH, len(words))
        if not width:
            return words
        count = len(words) - width + 1
        h = np.full(count, width, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in range(width):
                h = (h ^ words[i : i + count]) * _MIX
                h ^= h >> np.uint64(29)
            h *= _STEP
        return np.unique(h ^ (h >> np.uint64(32)))


def sigma(x: np.ndarray) -> np.ndarray:
    """The first permutation of the 32-bit numbers, which breaks up any structure."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint32(16))
        x = x * np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        return x ^ (x >> np.uint32(16))


def pi(x: np.ndarray) -> np.ndarray:
    """The second permutation of the 32-bit numbers, in place. Every step has an inverse."""
    with np.errstate(over="ignore"):
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x7FEB352D)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        return x


def signature(shingles: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """Coordinate k is the least value of ``pi`` shifted circularly by k over the set's
    places under ``sigma``: the same two permutations serve all coordinates."""
    places = sigma((shingles >> np.uint64(32)).astype(np.uint32))
    shifts = np.arange(coordinates, dtype=np.uint32)[:, None]
    least = np.full(coordinates, 0xFFFFFFFF, dtype=np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(places), BLOCK):
            np.minimum(least, pi(places[at : at + BLOCK] + shifts).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> list[int]:
    """A 64-bit key per band, different for equal coordinates in different bands."""
    rows = least.reshape(BANDS, ROWS)
    keys = [xxhash.xxh3_64_intdigest(rows[k].tobytes(), seed=k) for k in range(BANDS)]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def coordinate_bytes(least: np.ndarray) -> bytes:
    """One byte of each coordinate, enough to tell most unequal ones apart."""
    return (least >> np.uint32(8)).astype(np.uint8).tobytes()


def _signed(docs: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in batches:
            sizes, digests, keys, coordinates = [], [], [], []
            for text in batch["text"].to_pylist():
                found = shingles.of(text)
                sizes.append(len(found))
                if len(found):
                    least = signature(found)
                    digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                    keys.append(band_keys(least))
                    coordinates.append(coordinate_bytes(least))
                else:
                    digests.append(None)
                    keys.append(None)
                    coordinates.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    batch["row_hash"],
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(coordinates, pa.binary()),
                ],
                names=["doc_id", "row_hash", "size", "digest", "bands", "coordinates"],
            )

    narrow = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        row_hash(docs).alias("row_hash"),
        text_of(docs).cast("binary").alias("text"),
    )
    return map_batches(
        narrow,
        work,
        "doc_id long, row_hash long, size long, digest binary, bands array<long>, coordinates binary",
    )


def _shingle_sets(docs: DataFrame, signed: DataFrame, wanted: DataFrame) -> DataFrame:
    """The full sets of the wanted classes (cid, doc_id, row_hash): cid, shingles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in batches:
            sets = [shingles.of(t).tobytes() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["cid"], pa.array(sets, pa.binary())], names=["cid", "shingles"]
            )

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    texts = without_repeats(texts, signed)
    keys = wanted.select(
        "cid", F.col("doc_id").alias("chosen_id"), F.col("row_hash").alias("chosen_hash")
    )
    same = (texts["doc_id"] == F.col("chosen_id")) & (row_hash(texts) == F.col("chosen_hash"))
    chosen = texts.join(keys.hint("shuffle_hash"), same)
    return map_batches(
        chosen.select("cid", text_of(texts).cast("binary").alias("text")),
        work,
        "cid long, shingles binary",
    )


def _linked(shared, size_a, size_b, per_cent: int):
    return 100 * shared >= per_cent * (size_a + size_b - shared)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _with_hubs(star: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """Verify each class (cid) with its hub: node, root of the pairs that are linked.

    A hub's members are dealt over cells, each of which gets the hub's set once. A cell's
    hub comes first and members follow one by one, so a task holds two sets and a batch."""
    hubs = stored(star.groupBy("hub").agg(F.count("*").alias("n")))
    splits = F.ceil(F.col("n") / SPLIT).cast("int")
    members = (
        join_groups(star, hubs, ["hub"], "n")
        .withColumn("split", F.pmod(F.xxhash64("cid"), splits).cast("int"))
        .join(sets, "cid")
        .select("hub", "split", "cid", "shingles")
    )
    leads = (
        hubs.select("hub", F.explode(F.sequence(F.lit(0), splits - 1)).alias("split"))
        .join(sets.withColumnRenamed("cid", "hub"), "hub")
        .select("hub", "split", F.col("hub").alias("cid"), "shingles")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, lead = None, None
        for batch in batches:
            nodes, roots = [], []
            columns = (batch[c].to_pylist() for c in ("hub", "cid", "shingles"))
            for at, cid, shingles in zip(*columns, strict=True):
                found = np.frombuffer(shingles, dtype=np.uint64)
                if at == cid:
                    hub, lead = at, found
                elif at == hub and _linked(_shared(found, lead), len(found), len(lead), per_cent):
                    nodes.append(cid)
                    roots.append(hub)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], names=["node", "root"]
            )

    cells = (
        members.unionByName(leads)
        .repartition("hub", "split")
        .sortWithinPartitions("hub", "split", F.col("hub") != F.col("cid"))
    )
    return map_batches(cells, work, "node long, root long")


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members (key, cid, size) of buckets that hold several components, with their
    label, and per bucket the number of members and the label that most of them have."""
    labelled = stored(
        members.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select(
            "key", "cid", "size", F.coalesce("label", "cid").alias("label")
        )
    )
    buckets = stored(
        labelled.groupBy("key", "label")
        .agg(F.count("*").alias("times"))
        .groupBy("key")
        .agg(
            F.sum("times").alias("n"),
            F.count("*").alias("labels"),
            F.max(F.struct("times", "label")).alias("most"),
        )
        .filter("labels > 1")
        .select("key", "n", F.col("most.label").alias("main"))
    )
    return stored(join_groups(labelled, buckets, ["key"], "n"))


def _further_hubs(open_: DataFrame, turn: int) -> DataFrame:
    """For members of large open buckets a few hubs of other components: cid, hub. Buckets
    have hubs of their own, drawn by a hash, so the members of a group try different ones."""
    large = open_.filter(F.col("n") > LARGE)
    drawn = F.xxhash64("cid", "key", F.lit(turn))
    hubs = stored(
        large.groupBy("key")
        .agg(F.min(F.struct(drawn.alias("drawn"), "cid", "label")).alias("hub"), F.first("n").alias("n"))
        .select("key", "n", F.col("hub.cid").alias("hub"), F.col("hub.label").alias("hub_label"))
    )
    apart = join_groups(large.drop("n"), hubs, ["key"], "n").filter("label <> hub_label")
    # a member is in at most BANDS buckets, so this set is small
    some = F.array_sort(F.collect_set(F.struct(F.xxhash64("hub", "cid").alias("drawn"), "hub")))
    tries = apart.groupBy("cid").agg(F.slice(some, 1, TRIES).alias("tries"))
    return tries.select("cid", F.explode("tries.hub").alias("hub"))


def _cells(open_: DataFrame, per_cent: int) -> DataFrame:
    """Deal the open buckets over cells in which any two members that can be linked meet.

    ``open_``: key, cid, size, label, n, main. A bucket of up to ``CELL`` members and
    ``CELL_BYTES`` is one cell. A larger one is cut into classes of size, such that sizes
    beyond the similarity lie more than one class apart, these into the members of the
    bucket's main component and the others, and these by a hash into parts of bounded
    members and bytes. Two parts of one class or of neighbours share a cell, unless both
    are of the main component. Returned: cell, part (of the two of a cell), cid, label, size.
    """
    step = F.floor(F.log(F.col("size").cast("double")) / -math.log(per_cent / 100)).cast("int")
    sided = open_.withColumn("step", step).withColumn("side", (F.col("label") != F.col("main")).cast("int"))
    facts = sided.groupBy("key", "step", "side").agg(
        F.count("*").alias("n"), F.sum(F.col("size") * 8).alias("bytes")
    )
    parts_of = F.greatest(F.ceil(F.col("n") / CELL), F.ceil(F.col("bytes") / CELL_BYTES)).cast("int")
    buckets = stored(
        facts.groupBy("key").agg(
            F.sum("n").alias("n"),
            ((F.sum("n") <= CELL) & (F.sum("bytes") <= CELL_BYTES)).alias("small"),
            # one entry per class of size and side: sizes are bounded, so these are some dozens
            F.map_from_entries(F.collect_list(F.struct(F.struct("step", "side"), parts_of))).alias("parts"),
        )
    )

    def count(at, side):
        at = F.struct(at.alias("step"), side.alias("side"))
        return F.coalesce(F.element_at("parts", at), F.lit(0))

    def part(at, side, split):
        return F.struct(at.alias("step"), side.alias("side"), split.alias("split"))

    def parts(at, side):
        """The parts of a class and side that a member has to meet."""
        met = (count(at, side) > 0) & ((F.col("side") == 1) | (side == 1))
        every = F.sequence(F.lit(0), count(at, side) - 1)
        return F.transform(F.when(met, every).otherwise(F.array().cast("array<int>")), lambda i: part(at, side, i))

    own = F.pmod(F.xxhash64("cid"), count(F.col("step"), F.col("side"))).cast("int")
    single = F.struct(F.lit(0).alias("step"), F.lit(0).alias("side"), F.lit(0).alias("split"))
    others = F.concat(
        *(parts(F.col("step") + d, F.lit(side)) for d in (-1, 0, 1) for side in (0, 1))
    )
    met = (
        join_groups(sided.drop("n"), buckets, ["key"], "n")
        .withColumn("mine", F.when(F.col("small"), single).otherwise(part(F.col("step"), F.col("side"), own)))
        .withColumn("other", F.explode(F.when(F.col("small"), F.array(single)).otherwise(others)))
    )
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    return met.select(
        F.struct("key", low.alias("low"), high.alias("high")).alias("cell"),
        (low != F.col("mine")).cast("int").alias("part"),
        "cid",
        "label",
        "size",
    )


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


def _pairs(rows: list[dict], per_cent: int, least: int) -> np.ndarray:
    """The pairs that a cell has to decide, as the upper half of a matrix: of two parts if
    it has two, of different labels, of sizes and coordinates that can be similar enough,
    and in no earlier band together."""
    parts = np.array([r["part"] for r in rows])
    labels = np.array([r["label"] for r in rows], dtype=np.int64)
    sizes = np.array([r["size"] for r in rows], dtype=np.int64)
    bands = np.array([r["bands"] for r in rows], dtype=np.int64)
    marks = np.frombuffer(b"".join(r["coordinates"] for r in rows), dtype=np.uint8)
    marks = marks.reshape(len(rows), -1)
    pairs = np.triu(labels[:, None] != labels[None, :], 1)
    cell = rows[0]["cell"]
    if cell["low"] != cell["high"]:
        pairs &= parts[:, None] != parts[None, :]
    pairs &= 100 * np.minimum.outer(sizes, sizes) >= per_cent * np.maximum.outer(sizes, sizes)
    band = int(np.flatnonzero(bands[0] == cell["key"])[0])
    for k in range(band):
        pairs &= bands[:, k, None] != bands[None, :, k]
    for i in np.flatnonzero(pairs.any(axis=1)):
        pairs[i] &= (marks == marks[i]).sum(axis=1) >= least
    return pairs


def _undecided(cells: DataFrame, per_cent: int) -> DataFrame:
    """The members of cells that have a pair to decide there."""
    least = least_matches(per_cent)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for members in _by_cell(batches):
            if len(members) < 2:
                continue
            pairs = _pairs(members, per_cent, least)
            used = pairs.any(axis=0) | pairs.any(axis=1)
            if used.any():
                yield pa.RecordBatch.from_pylist(
                    [r for r, u in zip(members, used, strict=True) if u], schema=schema
                )

    rows = cells.select("cell", "part", "cid", "label", "size", "bands", "coordinates")
    schema = to_arrow_schema(rows.schema)
    return map_batches(rows.repartition("cell").sortWithinPartitions("cell"), work, rows.schema)


def _decided(undecided: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """Verify the pairs of each cell on the full sets: node, root of those linked."""
    least = least_matches(per_cent)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_cell(batches):
            sets = [np.frombuffer(r["shingles"], dtype=np.uint64) for r in rows]
            nodes, roots = [], []
            for i, j in np.argwhere(_pairs(rows, per_cent, least)):
                if _linked(_shared(sets[i], sets[j]), len(sets[i]), len(sets[j]), per_cent):
                    nodes.append(rows[i]["cid"])
                    roots.append(rows[j]["cid"])
            if nodes:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())],
                    names=["node", "root"],
                )

    rows = undecided.join(sets, "cid").repartition("cell").sortWithinPartitions("cell")
    return map_batches(rows, work, "node long, root long")


def _one_document(signed: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Edges between the classes of rows that share a doc_id, if there are any."""
    several = stored(
        signed.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("digest").alias("least"), F.max("digest").alias("most"))
        .filter("least <> most")
    )
    if several.isEmpty():
        return None
    pairs = signed.join(several, "doc_id").select("digest", "least").distinct()
    ids = classes.select("digest", "cid")
    firsts = ids.select(F.col("digest").alias("least"), F.col("cid").alias("root"))
    return (
        pairs.join(ids, "digest").join(firsts, "least").select(F.col("cid").alias("node"), "root")
    )


def _as_edges(labels: DataFrame) -> DataFrame:
    return labels.select("node", F.col("label").alias("root"))


def near_duplicates(docs: DataFrame, per_cent: int = PER_CENT) -> DataFrame:
    """Components of the texts of ``docs`` (doc_id, text) whose shingle sets are similar.

    Two documents are linked when ``100 * intersection >= per_cent * union`` of their sets
    of ``WIDTH``-word shingles; words are what stands between the white space of ASCII, A-Z
    lowered.

    1. One scan gives each text its signature: ``sigma`` permutes its shingles, and all
       coordinates come from shifting ``pi`` circularly. Rows with the same set are one class.
    2. Band keys are shuffled. Each class is first compared with one hub, the least class
       that shares a bucket with it, on full sets, and then, in large buckets that still
       hold several components, with a few hubs of other components. Large groups of near
       copies are mostly one component after that, at the cost of a few rows per class.
    3. Buckets that still hold several components are dealt over cells bounded in members
       and bytes. Pairs of one component, of sizes or signatures too far apart, or met in
       an earlier band are left out there, the others verified on full sets.
    4. Links become components by label propagation.

    Returned, one row per row of ``docs``: doc_id, row_hash, n_shingles, component_id (the
    smallest doc_id reachable by links) and kept (doc_id is component_id).

    A pair just similar enough meets in a bucket with probability 0.9999996, a more similar
    one with a higher; what is linked is exact. No pair is ever a row unless it is linked or
    a class and its hub; no bucket is gathered. A missing or empty text, or one without
    words, has the empty set and no link: it is its own component and kept. Rows that share
    a doc_id are one document: what one of them reaches, all reach. A row without doc_id
    could not be named by its component: it has no link, a component_id of NULL, and is
    kept. Repeated rows are copies. Other columns are not read, whatever their names.
    """
    signed = stored(_signed(docs))
    linkable = signed.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = stored(
        linkable.groupBy("digest")
        .agg(
            F.min(F.struct("doc_id", "row_hash")).alias("best"),
            F.count("*").alias("n"),
            F.first("size").alias("size"),
            F.first("bands").alias("bands"),
            F.first("coordinates").alias("coordinates"),
        )
        .withColumn("cid", F.monotonically_increasing_id())
    )
    keys = classes.select("cid", "size", F.explode("bands").alias("key"))
    buckets = stored(
        keys.groupBy("key").agg(F.count("*").alias("n"), F.min("cid").alias("hub")).filter("n > 1")
    )
    members = stored(join_groups(keys, buckets, ["key"], "n").select("key", "cid", "size", "hub"))
    star = stored(members.filter("hub < cid").groupBy("cid").agg(F.min("hub").alias("hub")))
    met = star.select("cid").union(star.select("hub")).distinct()
    wanted = met.join(classes, "cid").select("cid", "best.doc_id", "best.row_hash")
    sets = stored(_shingle_sets(docs, signed, wanted))
    labels = connected(stored(_with_hubs(star, sets, per_cent)))
    left = _open(members, labels)
    for turn in range(ROUNDS):
        star = stored(_further_hubs(left, turn))
        if star.isEmpty():
            break
        more = _with_hubs(star, sets, per_cent)
        labels = connected(stored(_as_edges(labels).unionByName(more)))
        left = _open(members, labels)
    marks = classes.select("cid", "bands", "coordinates")
    undecided = stored(_undecided(_cells(left, per_cent).join(marks, "cid"), per_cent))
    more = stored(_decided(undecided, sets, per_cent))
    same = _one_document(signed, classes)
    if same is not None:
        more = more.unionByName(same)
    if not more.isEmpty():
        labels = connected(stored(_as_edges(labels).unionByName(more)))

    placed = classes.select("cid", "digest", "n", "best").join(
        labels.withColumnRenamed("node", "cid"), "cid", "left"
    )
    placed = placed.withColumn("label", F.coalesce("label", "cid"))
    components = stored(
        placed.groupBy("label").agg(
            F.min("best.doc_id").alias("component_id"), F.count("*").alias("members")
        )
    )
    placed = stored(
        join_groups(placed, components, ["label"], "members").select("digest", "n", "component_id")
    )
    linked = join_groups(linkable.select("digest", "doc_id", "row_hash", "size"), placed, ["digest"], "n")
    alone = signed.filter("digest IS NULL OR doc_id IS NULL").withColumn("component_id", F.col("doc_id"))
    columns = ("doc_id", "row_hash", F.col("size").alias("n_shingles"), "component_id")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    return linked.select(*columns, kept).unionByName(alone.select(*columns, kept))


def keep_one_of_each_component(docs: DataFrame, per_cent: int = PER_CENT) -> DataFrame:
    """The rows of ``docs`` that are kept, whole and with all their columns."""
    return rows_of(docs, near_duplicates(docs, per_cent).filter("kept"))
