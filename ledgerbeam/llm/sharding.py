"""Shard placement by a permutation-filled lookup table of prime size."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerbeam.llm.common import column

TABLE_SIZE = 65537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def preference(shard: str, table_size: int) -> tuple[int, int]:
    """Where a shard's preference order starts and by how much it steps."""
    digest = hashlib.md5(shard.encode()).digest()
    offset = int.from_bytes(digest[:8], "big") % table_size
    skip = int.from_bytes(digest[8:], "big") % (table_size - 1) + 1
    return offset, skip


def lookup_table(shards: Sequence[str], table_size: int = TABLE_SIZE) -> list[int]:
    """The position in ``shards`` that each slot belongs to.

    Shards take turns; in its turn each claims the first free slot in its own order of
    preference, which visits every slot once because the size is prime. All shards so
    get an equal share to within one slot, and adding or removing a shard moves few
    slots beside its own.
    """
    if not _is_prime(table_size):
        raise ValueError(f"the table size must be prime, {table_size} is not")
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be named, each by a name of its own")
    if len(shards) > table_size:
        raise ValueError(f"{len(shards)} shards do not fit {table_size} slots")
    orders = [preference(s, table_size) for s in shards]
    tried = [0] * len(shards)
    slots = [-1] * table_size
    claimed = 0
    while True:
        for i, (offset, skip) in enumerate(orders):
            while slots[slot := (offset + tried[i] * skip) % table_size] >= 0:
                tried[i] += 1
            slots[slot] = i
            tried[i] += 1
            claimed += 1
            if claimed == table_size:
                return slots


def slot_of(key: Column, table_size: int = TABLE_SIZE) -> Column:
    """60 bits of the key's MD5, folded into the table. A missing key counts as empty text."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15)
    return (F.conv(digits, 16, 10).cast("long") % table_size).cast("int")


def place(
    df: DataFrame, key: str, shards: Sequence[str], table_size: int = TABLE_SIZE
) -> DataFrame:
    """Each row's key with its slot and shard: ``key``, slot, shard_index, shard.

    The table is broadcast. It has ``table_size`` rows whatever the size of the data, and
    each row finds its place in constant time where it is read: nothing is shuffled, so
    a key that holds a third of all rows costs nothing extra. Equal keys get equal
    places; rows are neither merged nor dropped. Use a key per row (not e.g. the source)
    for even shards. Other columns of ``df`` are not read, whatever their names.
    """
    slots = df.sparkSession.createDataFrame(
        [(s, i, shards[i]) for s, i in enumerate(lookup_table(shards, table_size))],
        "slot int, shard_index int, shard string",
    )
    keyed = df.select(F.col(key), slot_of(F.col(key), table_size).alias("slot"))
    return keyed.join(F.broadcast(slots), "slot").select(key, "slot", "shard_index", "shard")


def write_shards(
    df: DataFrame,
    key: str,
    shards: Sequence[str],
    path: str,
    splits: int = 8,
    table_size: int = TABLE_SIZE,
) -> None:
    """Write all columns of ``df`` as Parquet, one folder per shard under ``path``.

    A shard's rows are dealt over ``splits`` tasks by a hash of the whole row, so neither
    a large shard nor a hot key ends in one task. ``df`` must not have a column named
    ``shard``, which is the folders' name; other names are free.
    """
    if "shard" in df.columns:
        raise ValueError("the data has a column 'shard' of its own; rename it")
    own = _free_names(df.columns, "slot", "index", "split")
    slot, index, split = own
    names = F.element_at(F.array(*(F.lit(s) for s in shards)), F.col(index) + 1)
    slots = df.sparkSession.createDataFrame(
        list(enumerate(lookup_table(shards, table_size))), f"{slot} int, {index} int"
    )
    placed = (
        df.withColumn(slot, slot_of(column(df, key), table_size))
        .withColumn(split, F.pmod(F.xxhash64(*(column(df, c) for c in df.columns)), F.lit(splits)))
        .join(F.broadcast(slots), slot)
        .withColumn("shard", names)
    )
    (
        placed.repartition(len(shards) * splits, "shard", split)
        .drop(*own)
        .write.partitionBy("shard")
        .parquet(path)
    )


def _free_names(taken: Sequence[str], *wanted: str) -> list[str]:
    """A name for each column of ours that none of the table's has, whatever the case."""
    lead = "placed"
    while any(c.lower().startswith(lead) for c in taken):
        lead += "_"
    return [f"{lead}_{name}" for name in wanted]
