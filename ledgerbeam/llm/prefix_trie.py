"""A trie of conversations' prefixes, with count-min screening before the exact grouping."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerbeam.llm.common import join_groups, map_batches, stored

GROUP = 5  # conversations in a row that share a first part
MOST_SHARED = 9  # the shared part has fewer turns than this
SEGMENT = 4096  # turns of a conversation that a running value is taken over at once

DEPTH = 3  # rows of the count-min sketch
CELLS_PER_PREFIX = 4
LEAST_BITS, MOST_BITS = 16, 27  # of the number of cells in a row: 8 KB to 16 MB as bits
BLOCK = 32_768  # ids of ends that are joined into one text

NO_ENDS = hashlib.sha256(b"").hexdigest()


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, bytes, turn_hash: what stands for a turn from here on. No text is
    shuffled; equal hashes are equal roles and texts, as SHA-256 has no known collision."""
    role, text = (F.coalesce(conversations[c], F.lit("")) for c in ("role", "text"))
    spelt = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.filter(conversations["conv_id"].isNotNull()).select(
        conversations["conv_id"].cast("long").alias("conv_id"),
        conversations["turn"].alias("turn"),
        F.octet_length(text).cast("long").alias("bytes"),
        F.sha2(spelt, 256).alias("turn_hash"),
    )


def _numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns with their place in the conversation (``pos``, from 1), and ``runs``: how
    many turns of a conversation lie in each range.

    Turns are sorted over all tasks by ranges, so a conversation that is long may lie in
    several; a place is the place in its range and the number in earlier ranges."""
    by = ["conv_id", "turn", "turn_hash"]
    order = [F.col(c).asc_nulls_first() for c in by]
    laid = stored(
        turns.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("at", F.monotonically_increasing_id())
    )
    part = F.shiftright("at", 33).alias("part")  # the upper bits of such an id
    runs = stored(
        laid.groupBy("conv_id", part).agg(F.min("at").alias("start"), F.count("*").alias("n"))
    )
    # a conversation has at most one run in each range, so this window is small
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    starts = runs.select("conv_id", "part", (F.col("start") - before).alias("zero"))
    placed = laid.withColumn("part", part).join(starts, ["conv_id", "part"])
    return placed.withColumn("pos", F.col("at") - F.col("zero") + 1), runs


def _conversations(runs: DataFrame, group: int, most_shared: int) -> DataFrame:
    """conv_id, base, shared (turns after which its own begin), lead (turns that it takes
    over from its base), depth (turns when rebuilt), n."""
    own = runs.groupBy("conv_id").agg(F.sum("n").alias("n"))
    own = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).withColumn(
        "shared", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most_shared
    )
    bases = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    lead = F.least("shared", F.coalesce("base_n", F.lit(0)))
    rest = F.greatest(F.lit(0).cast("long"), F.col("n") - F.col("shared"))
    return (
        own.join(bases, "base", "left")
        .withColumn("lead", lead)
        .select("conv_id", "base", "shared", "lead", (F.col("lead") + rest).alias("depth"), "n")
    )


def _rebuilt(placed: DataFrame, convs: DataFrame, most_shared: int) -> DataFrame:
    """conv_id, pos, bytes, turn_hash, depth of each turn of the rebuilt conversations."""
    facts = convs.select("conv_id", "shared", "lead", "depth", "n")
    own = (
        join_groups(placed.select("conv_id", "pos", "bytes", "turn_hash"), facts, ["conv_id"], "n")
        .filter("pos > shared")
        .withColumn("pos", F.col("pos") - F.col("shared") + F.col("lead"))
    )
    first = placed.filter((F.col("pos") < most_shared)).select(
        F.col("conv_id").alias("base"), "pos", "bytes", "turn_hash"
    )
    # a base has few conversations and fewer than most_shared such turns
    taken = first.join(convs.filter("lead > 0"), "base").filter("pos <= lead")
    columns = ("conv_id", "pos", "bytes", "turn_hash", "depth")
    return own.select(*columns).unionByName(taken.select(*columns))


def running(
    df: DataFrame, group: str, pos: str, backwards: bool, **values: tuple[Column, str]
) -> DataFrame:
    """Running values along ``pos`` in each group; a value is a column and ``sum`` or
    ``bit_xor``.

    A group is cut into segments of ``SEGMENT`` places. What a segment adds up to is handed
    to the segments behind it, and inside them rows are added up one by one, so of a long
    group a task gets one segment at a time, or one row per segment."""
    joined = {"sum": lambda a, b: a + b, "bit_xor": lambda a, b: a.bitwiseXOR(b)}
    df = df.withColumns({f"in_{name}": value for name, (value, _) in values.items()})
    df = df.withColumn("segment", F.floor(F.col(pos) / SEGMENT))

    def order(column: str) -> Column:
        return F.col(column).desc() if backwards else F.col(column).asc()

    sums = df.groupBy(group, "segment").agg(
        *(getattr(F, how)(f"in_{name}").alias(name) for name, (_, how) in values.items())
    )
    ahead = Window.partitionBy(group).orderBy(order("segment")).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(
        group,
        "segment",
        *(getattr(F, how)(name).over(ahead).alias(f"from_{name}") for name, (_, how) in values.items()),
    )
    long_ones = carried.filter(" OR ".join(f"from_{name} IS NOT NULL" for name in values))
    inside = Window.partitionBy(group, "segment").orderBy(order(pos)).rowsBetween(Window.unboundedPreceding, 0)
    added = df.withColumns(
        {f"in_{name}": getattr(F, how)(f"in_{name}").over(inside) for name, (_, how) in values.items()}
    ).join(long_ones, [group, "segment"], "left")
    return added.select(
        *(c for c in df.columns if c not in {"segment", *(f"in_{name}" for name in values)}),
        *(
            joined[how](F.col(f"in_{name}"), F.coalesce(f"from_{name}", F.lit(0).cast("long"))).alias(name)
            for name, (_, how) in values.items()
        ),
    )


def _prefixes(rebuilt: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per prefix of each rebuilt conversation, the empty one included: conv_id,
    pos (its depth), d1, d2 (128-bit digest), p1, p2 (its parent's), bytes, is_end.

    A prefix is the set of its numbered turns, so its digest is the sum, without carry, of
    a 128-bit hash of each: that can be added up in segments."""
    hashes = rebuilt.withColumns(
        {f"h{i}": F.xxhash64(F.lit(i), "pos", "turn_hash") for i in (1, 2)}
    )
    chained = running(
        hashes, "conv_id", "pos", False, d1=(F.col("h1"), "bit_xor"), d2=(F.col("h2"), "bit_xor")
    )
    nothing = F.lit(0).cast("long")
    columns = ["conv_id", "pos", "d1", "d2", "p1", "p2", "bytes", "is_end"]
    turns = chained.withColumns(
        {
            "p1": F.col("d1").bitwiseXOR(F.col("h1")),
            "p2": F.col("d2").bitwiseXOR(F.col("h2")),
            "is_end": F.col("pos") == F.col("depth"),
        }
    )
    roots = convs.withColumns(
        {c: nothing for c in ("pos", "d1", "d2", "p1", "p2", "bytes")}
    ).withColumn("is_end", F.col("depth") == 0)
    return turns.select(*columns).unionByName(roots.select(*columns))


def _cell_numbers(d1: np.ndarray, d2: np.ndarray, bits: int) -> list[np.ndarray]:
    """A prefix's cell in each row of the sketch, from bits of the digest of its own."""
    low = np.uint64((1 << bits) - 1)
    one, two = d1.view(np.uint64), d2.view(np.uint64)
    return [(word & low).astype(np.int64) for word in (one, one >> np.uint64(32), two)]


def _sketch(prefixes: DataFrame, bits: int) -> list[np.ndarray]:
    """The count-min sketch, as far as it is needed: a bit per cell, set where more than one
    prefix counts. Tasks count their own cells and Spark adds up; what comes to the driver
    is ``DEPTH << bits`` bits at most, 48 MB, whatever the size of the data."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = (batch[c].to_numpy(zero_copy_only=False) for c in ("d1", "d2"))
            rows = [(c + (i << bits)) for i, c in enumerate(_cell_numbers(*digests, bits))]
            cells, times = np.unique(np.concatenate(rows), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells), pa.array(times.astype(np.int64))], names=["cell", "times"]
            )

    counted = map_batches(prefixes.select("d1", "d2"), work, "cell long, times long")
    crowded = counted.groupBy("cell").agg(F.sum("times").alias("times")).filter("times > 1")
    blocks = (
        crowded.select(F.expr("bitmap_bucket_number(cell + 1)").alias("block"), F.expr("bitmap_bit_position(cell + 1)").alias("bit"))
        .groupBy("block")
        .agg(F.expr("bitmap_construct_agg(bit)").alias("bits"))
    )
    whole = np.zeros((DEPTH << bits) // 8, dtype=np.uint8)
    for row in blocks.toLocalIterator():
        found = np.frombuffer(row["bits"], dtype=np.uint8)
        at = (row["block"] - 1) * len(found)
        whole[at : at + len(found)] = found[: len(whole) - at]
    return np.split(whole, DEPTH)


def sketch_bits(prefixes: int) -> int:
    """A row of the sketch has ``CELLS_PER_PREFIX`` cells per prefix, within its bounds.

    Beyond the upper one, at some 30 million prefixes, estimates grow coarser and more
    prefixes go through the exact grouping; results are the same."""
    wanted = max(1, prefixes * CELLS_PER_PREFIX - 1).bit_length()
    return min(MOST_BITS, max(LEAST_BITS, wanted))


def _screened(prefixes: DataFrame) -> DataFrame:
    """The prefixes with ``single`` (the estimate is one, which proves that no other
    conversation has this prefix) and ``parent_single``. An estimate is the least of a
    prefix's cells and never below the truth. The root is not estimated."""
    bits = sketch_bits(prefixes.count())
    shared = prefixes.sparkSession.sparkContext.broadcast(_sketch(prefixes.filter("pos > 0"), bits))

    def proven(d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
        single = np.zeros(len(d1), dtype=bool)
        for row, cells in zip(shared.value, _cell_numbers(d1, d2, bits), strict=True):
            single |= (row[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 0
        return single

    names = prefixes.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, d1, d2, p1, p2 = (
                batch[c].to_numpy(zero_copy_only=False) for c in ("pos", "d1", "d2", "p1", "p2")
            )
            arrays = [pa.array(proven(d1, d2) & (pos > 0)), pa.array(proven(p1, p2) & (pos > 1))]
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in names), *arrays], names=[*names, "single", "parent_single"]
            )

    schema = ", ".join(f"{n} {t}" for n, t in prefixes.dtypes) + ", single boolean, parent_single boolean"
    return map_batches(prefixes, work, schema)


KEY = ["pos", "d1", "d2"]


def _end_hashes(ends: DataFrame) -> DataFrame:
    """pos, d1, d2, ends_sha256 of the conversations (conv_id) that end in each node.

    Ids are sorted over all tasks by ranges and joined into texts of ``BLOCK`` ids where
    they lie; a node's texts are then hashed one after the other, never held together."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, ids, out = None, None, [], []

        def closed():
            return {**dict(zip(KEY, at, strict=True)), "first": first, "ids": ",".join(ids)}

        for batch in batches:
            columns = [batch[c].to_pylist() for c in (*KEY, "conv_id")]
            for pos, d1, d2, conv in zip(*columns, strict=True):
                if ids and (at != (pos, d1, d2) or len(ids) >= BLOCK):
                    out.append(closed())
                    ids = []
                if not ids:
                    at, first = (pos, d1, d2), conv
                ids.append(str(conv))
            if out:
                yield pa.RecordBatch.from_pylist(out)
                out = []
        if ids:
            yield pa.RecordBatch.from_pylist([closed()])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for batch in batches:
            out = []
            columns = [batch[c].to_pylist() for c in (*KEY, "ids")]
            for pos, d1, d2, ids in zip(*columns, strict=True):
                if at == (pos, d1, d2):
                    digest.update(b"," + ids.encode())
                    continue
                if at is not None:
                    out.append({**dict(zip(KEY, at, strict=True)), "ends_sha256": digest.hexdigest()})
                at, digest = (pos, d1, d2), hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_pylist(out)
        if at is not None:
            yield pa.RecordBatch.from_pylist(
                [{**dict(zip(KEY, at, strict=True)), "ends_sha256": digest.hexdigest()}]
            )

    key = "pos long, d1 long, d2 long"
    laid = ends.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    blocks = map_batches(laid, joined, f"{key}, first long, ids string")
    dealt = blocks.repartition(*KEY).sortWithinPartitions(*KEY, "first")
    return map_batches(dealt.select(*KEY, "first", "ids"), hashed, f"{key}, ends_sha256 string")


def prefix_trie(
    conversations: DataFrame, group: int = GROUP, most_shared: int = MOST_SHARED
) -> DataFrame:
    """The trie of all prefixes of rebuilt conversations (conv_id, turn, role, text).

    Conversation c takes its first h = crc32(c) % ``most_shared`` turns from conversation
    c - c % ``group``, and what follows from itself. Each distinct sequence of first turns
    is a node.

    1. Turns are numbered and hashed, and prefixes get digests that add up over segments.
    2. A count-min sketch of the digests is made in one pass and broadcast. An estimate of
       one proves that a prefix belongs to a single conversation: its node is complete
       where the row lies, but for the parent's name at the top of such a tail.
    3. Only prefixes that may be shared are grouped by their digests. A false alarm is a
       group of one there and changes nothing; where its parent was proven single, which is
       no group, the parent is of the same conversation.
    4. A node is owned by its smallest member, which owns all nodes below it on its path.
       So leaves and savings of a subtree are sums over the members of what they own from
       that depth on, which is a running sum along each conversation.

    Returned, one row per node: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves (childless nodes in the subtree), saved_tokens (over the subtree,
    (members - 1) times the bytes of the last text), ends_sha256 (of the ids of members
    that end here, joined by commas), and screened (whether the sketch proved it single).

    Missing roles and texts are empty. A missing turn comes first; turns of equal number
    are ordered by the hash of role and text, so repeated rows are repeated turns. Rows
    without a conv_id belong to no conversation and are left out; other columns are not
    read. No conversation, node or parent is gathered in one task: hot ones are looked up
    by broadcast of fewer than ``HOT_SHARE`` rows, conversations are cut into segments. A
    table without conversations has no nodes.
    """
    placed, runs = _numbered(_turns(conversations))
    placed, convs = stored(placed), stored(_conversations(runs, group, most_shared))
    prefixes = stored(_prefixes(_rebuilt(placed, convs, most_shared), convs))
    screened = stored(_screened(prefixes))

    maybe = screened.filter("NOT single")
    nodes = stored(
        maybe.groupBy(*KEY).agg(
            F.min("conv_id").alias("owner"),
            F.count("*").alias("n_convs"),
            F.count_if("is_end").alias("n_ends"),
            F.first("bytes").alias("node_bytes"),
            F.first("p1").alias("p1"),
            F.first("p2").alias("p2"),
            F.first("parent_single").alias("parent_single"),
        )
    )
    facts = nodes.select(*KEY, "owner", "n_convs", "n_ends", "node_bytes")
    zero = F.lit(0).cast("long")
    owned = join_groups(maybe.select("conv_id", *KEY), facts, KEY, "n_convs")
    mine = F.col("conv_id") == F.col("owner")
    owned = owned.select(
        "conv_id",
        *KEY,
        F.when(mine, (F.col("n_convs") - 1) * F.col("node_bytes")).otherwise(0).alias("saved"),
        F.when(mine & (F.col("n_convs") == F.col("n_ends")), 1).otherwise(0).cast("long").alias("leaf"),
    )
    tips = screened.filter("single AND is_end").select(
        "conv_id", *KEY, zero.alias("saved"), F.lit(1).cast("long").alias("leaf")
    )
    below = running(
        owned.withColumn("grouped", F.lit(True)).unionByName(tips.withColumn("grouped", F.lit(False))),
        "conv_id",
        "pos",
        True,
        saved_tokens=(F.col("saved"), "sum"),
        n_leaves=(F.col("leaf"), "sum"),
    )
    subtrees = (
        below.filter("grouped")
        .groupBy(*KEY)
        .agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))
    )

    tops = screened.filter("single AND NOT parent_single")
    inner = [(F.col("pos") - 1).alias("pos"), F.col("p1").alias("d1"), F.col("p2").alias("d2")]
    children = (
        nodes.filter("pos > 0")
        .select(*inner)
        .unionByName(tops.select(*inner))
        .groupBy(*KEY)
        .agg(F.count("*").alias("n_children"))
    )
    ends = _end_hashes(maybe.filter("is_end").select(*KEY, "conv_id"))
    whole = stored(
        nodes.join(subtrees, KEY)
        .join(children, KEY, "left")
        .join(ends, KEY, "left")
        .withColumn("n_children", F.coalesce("n_children", zero))
    )
    parents = whole.filter("n_children > 0").select(
        *KEY, F.col("owner").alias("parent_conv_id"), "n_children"
    )

    group_facts = [
        F.col("owner").alias("conv_id"), "n_convs", F.col("n_children").alias("children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
        F.lit(False).alias("screened"),
    ]
    grouped = whole.filter("pos > 0 AND NOT parent_single").select(*inner, *group_facts)
    # a parent proven single is no group; it is of the false alarm's own conversation
    alarms = whole.filter("pos > 0 AND parent_single").select(
        (F.col("pos") - 1).alias("pos"), *group_facts, F.col("owner").alias("parent_conv_id")
    )

    def tail(parent: list[Column]) -> list[Column]:
        one = F.lit(1).cast("long")
        own_id = F.sha2(F.col("conv_id").cast("string"), 256)
        return [
            *parent, F.col("conv_id"), one.alias("n_convs"),
            F.when(F.col("is_end"), zero).otherwise(one).alias("children"), one.alias("n_leaves"),
            zero.alias("saved_tokens"),
            F.when(F.col("is_end"), own_id).otherwise(NO_ENDS).alias("ends_sha256"),
            F.lit(True).alias("screened"),
        ]

    named = join_groups(grouped.unionByName(tops.select(*tail(inner))), parents, KEY, "n_children")
    inside = screened.filter("single AND parent_single").select(
        *tail([(F.col("pos") - 1).alias("pos")]), F.col("conv_id").alias("parent_conv_id")
    )
    root = whole.filter("pos = 0").select(
        F.lit(-1).cast("long").alias("pos"), *group_facts,
        F.lit(None).cast("long").alias("parent_conv_id"),
    )
    columns = [
        "conv_id", (F.col("pos") + 1).alias("depth"), "parent_conv_id", "n_convs",
        F.col("children").alias("n_children"), "n_leaves", "saved_tokens", "ends_sha256", "screened",
    ]
    alone = inside.select(*columns).unionByName(alarms.select(*columns))
    return named.select(*columns).unionByName(alone).unionByName(root.select(*columns))
