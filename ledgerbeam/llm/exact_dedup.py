"""Exact deduplication by progressive refinement: length, prefix hash, full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerbeam.llm.common import (
    join_groups,
    row_hash,
    rows_of,
    stored,
    text_of,
    without_repeats,
)

PREFIX_CHARS = 64

# The characters that do not count when texts are compared.
IGNORED = ("\x20", "\x09", "\x0a", "\x0b", "\x0c", "\x0d")


def normalised(text: Column) -> Column:
    """``text`` without white space. Plain replacements are several times faster here
    than a regular expression over every character."""
    for char in IGNORED:
        text = F.replace(text, F.lit(char), F.lit(""))
    return text


def _keys(docs: DataFrame, hash_all: bool) -> DataFrame:
    plain = normalised(text_of(docs))
    columns = [
        docs["doc_id"],
        row_hash(docs).alias("row_hash"),
        F.length(text_of(docs)).cast("long").alias("points"),
        F.octet_length(plain).alias("bytes"),
        F.xxhash64(F.substring(plain, 1, PREFIX_CHARS)).alias("prefix"),
    ]
    if hash_all:
        columns.append(F.sha2(plain, 256).alias("text_sha256"))
    return docs.select(*columns)


def progressive_dedup(docs: DataFrame, hash_all: bool = False) -> DataFrame:
    """Decide for each row of ``docs`` (doc_id, text) whether it stays.

    Texts are equal when they are the same without white space. The row with the most
    code points in its original text stays, then the smallest doc_id.

    1. One scan takes each row's length and the hash of its first characters.
    2. One aggregate counts lengths and, within them, prefixes. Rows whose length occurs
       once are settled, as are those whose prefix occurs once within its length.
    3. Only the content of what is left is hashed in full (``hash_all`` publishes the hash
       of every row, so the scan takes it along), and equal hashes are groups.

    Every aggregate sums partially before it shuffles, and all but the full hash of survivors
    works on rows of a few dozen bytes. No group is ever gathered: its best row is an
    aggregate, and rows find their group through ``join_groups``, which broadcasts the few
    large groups of a length, prefix or hash instead of shuffling their rows to one task.

    Returned: doc_id, row_hash, keep_id, group_size, kept, text_sha256 (NULL where
    ``hash_all`` is off and the row was settled before its content was read).

    A missing text counts as empty; empty texts are equal to each other. A missing doc_id
    sorts first. Rows that repeat both id and text are rows of their own, and one of them
    at most is kept. Other columns of ``docs`` are not read, whatever their names.
    """
    return _decide(docs, _stored_keys(docs, hash_all), hash_all)


def _stored_keys(docs: DataFrame, hash_all: bool) -> DataFrame:
    """The numbers given to rows break ties between repeated rows, so they are frozen."""
    return stored(_keys(docs, hash_all).withColumn("row", F.monotonically_increasing_id()))


def _decide(docs: DataFrame, keys: DataFrame, hash_all: bool) -> DataFrame:
    open_ = stored(
        keys.groupBy("bytes", "prefix").agg(F.count("*").alias("n")).filter("n > 1")
    )
    survivors = join_groups(keys, open_, ["bytes", "prefix"], "n").drop("n")
    if hash_all:
        hashed = survivors
    else:
        texts = rows_of(docs, survivors)
        full = texts.select(
            "doc_id",
            row_hash(texts).alias("row_hash"),
            F.sha2(normalised(text_of(texts)), 256).alias("text_sha256"),
        ).dropDuplicates(["doc_id", "row_hash"])
        same = survivors["doc_id"].eqNullSafe(full["doc_id"])
        hashed = survivors.join(full, same & (survivors["row_hash"] == full["row_hash"])).select(
            survivors["*"], full["text_sha256"]
        )
        hashed = stored(hashed)  # read twice below, and made from texts
    group = ["bytes", "prefix", "text_sha256"]
    groups = stored(
        hashed.groupBy(*group)
        .agg(
            F.count("*").alias("group_size"),
            F.min(F.struct((-F.col("points")).alias("shorter"), "doc_id", "row")).alias("best"),
        )
        .filter("group_size > 1")
    )
    if hash_all:
        settled = join_groups(keys, groups, group, "group_size", "left")
    else:
        found = join_groups(hashed, groups, group, "group_size")
        settled = keys.join(found.select("row", "text_sha256", "group_size", "best"), "row", "left")
    alone = F.col("best").isNull()
    return settled.select(
        "doc_id",
        "row_hash",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("best.row") == F.col("row"))).alias("kept"),
        "text_sha256",
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, whole and with all their columns."""
    keys = _stored_keys(docs, hash_all=False)
    kept = _decide(docs, keys, hash_all=False).filter("kept")
    return without_repeats(rows_of(docs, kept), keys)
