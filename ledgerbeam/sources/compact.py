"""The stored ledger summed to what queries tell apart, kept up to date month by month."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerbeam.functions import month_number
from ledgerbeam.sources.books import Books, ledger_files
from ledgerbeam.sources.schemas import MONEY, STORED, table_schemas

# A partition's folder below the ledger, as it is spelled there.
_PARTITION = r"(fiscal_year=[^/]*/posting_month=[^/]*)/[^/]*$"

_STATE = "part string, files long, mark long, version long, filled boolean"


def _wide(money: T.DecimalType) -> T.DecimalType:
    """Room for the sum of ten thousand million amounts."""
    return T.DecimalType(min(38, money.precision + 10), money.scale)


def _schema(money: T.DecimalType) -> T.StructType:
    return T.StructType([*table_schemas(money)["gl_entry"], *STORED["gl_entry"]])


def compacted(ledger: DataFrame, money: T.DecimalType = MONEY) -> DataFrame:
    """A ledger with the same answers and fewer rows.

    Entries that no query tells apart are summed: those of one account, day, year, party and
    voucher type with the same sides given. An entry with one side NULL is skipped by some
    totals and not by others, so it is only added to its like, and its missing side stays
    NULL. Partial sums precede the shuffle, so a hot account or day sends few rows.
    """
    sides = {"debit": F.col("debit").isNull(), "credit": F.col("credit").isNull()}
    keys = [c for c in table_schemas(money)["gl_entry"].names if c not in sides]
    sums = (F.sum(side).cast(_wide(money)).alias(side) for side in sides)
    return (
        ledger.groupBy(*keys, *(missing.alias(f"no_{side}") for side, missing in sides.items()))
        .agg(*sums)
        .select(*table_schemas(money)["gl_entry"].names)
    )


def _files(spark: SparkSession, path: str) -> DataFrame:
    """One row per partition that has files: part, files, mark. Files are listed, not read."""
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(path)
        .select("path", "length", "modificationTime")
    )
    return listed.groupBy(F.regexp_extract("path", _PARTITION, 1).alias("part")).agg(
        F.count("*").alias("files"),
        F.bit_xor(F.xxhash64("path", "length", "modificationTime")).alias("mark"),
    )


def _state(spark: SparkSession, base: str, version: int) -> list[T.Row]:
    """The partitions of a version, a row for each month of the ledger."""
    if version == 0:
        return []
    return spark.read.schema(_STATE).parquet(f"{base}/state/{version}").collect()


def _last_version(spark: SparkSession, base: str) -> int:
    """The last version whose state was written whole, 0 if there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/state/*/_SUCCESS")
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return max((int(f.getPath().getParent().getName()) for f in files.globStatus(place) or ()), default=0)


def refresh(spark: SparkSession, books: str, base: str, money: T.DecimalType = MONEY) -> list[str]:
    """Bring the compacted ledger at ``base`` up to the ledger stored at ``books``.

    The files of each month's partition are compared, by name, size and time, with those
    that its sums were made of. Only months that differ are read and summed again, whether
    entries came late, were corrected or are gone; returned are their partitions. If nothing
    changed, no entry is read.

    New sums go to a folder of a new version, and a small table that names each month's
    version is written last. Until then readers see the version before, so a refresh that
    fails half way, or loses executors, leaves nothing to repair: the next one does it again.
    Folders of old versions are not removed, since queries may still read them. One refresh
    of a ``base`` may run at a time.
    """
    version = _last_version(spark, base)
    before = {r["part"]: r for r in _state(spark, base, version)}
    now = {r["part"]: r for r in _files(spark, ledger_files(books)).collect()}
    changed = sorted(
        part
        for part, r in now.items()
        if part not in before or (r["files"], r["mark"]) != (before[part]["files"], before[part]["mark"])
    )
    gone = sorted(before.keys() - now.keys())
    if version and not changed and not gone:
        return []
    version += 1
    target = f"{base}/data/{version}"
    filled: set[str] = set()
    if changed:
        folders = [f"{ledger_files(books)}/{part}" for part in changed]
        entries = (
            spark.read.schema(_schema(money)).option("basePath", ledger_files(books)).parquet(*folders)
        )
        (
            compacted(entries, money)
            .withColumn("posting_month", month_number("posting_date"))
            .hint("rebalance", "fiscal_year", "posting_month")
            .sortWithinPartitions("fiscal_year", "posting_month", "posting_date")
            .write.mode("overwrite")
            .partitionBy("fiscal_year", "posting_month")
            .parquet(target)
        )
        filled = {r["part"] for r in _files(spark, target).collect()}
    rows = [
        (part, r["files"], r["mark"], version, part in filled)
        if part in changed
        else (part, r["files"], r["mark"], before[part]["version"], before[part]["filled"])
        for part, r in now.items()
    ]
    spark.createDataFrame(rows, _STATE).coalesce(1).write.mode("overwrite").parquet(
        f"{base}/state/{version}"
    )
    return sorted({*changed, *gone})


def compact_ledger(spark: SparkSession, base: str, money: T.DecimalType = MONEY) -> DataFrame:
    """The ledger that the last ``refresh`` left at ``base``, with the columns of the stored
    one and room for sums; filters prune its months in the same way."""
    schema = _schema(_wide(money))
    version = _last_version(spark, base)
    if version == 0:
        raise FileNotFoundError(f"no refresh has been completed at {base}")
    folders: dict[int, list[str]] = {}
    for r in _state(spark, base, version):
        if r["filled"]:
            folders.setdefault(r["version"], []).append(f"{base}/data/{r['version']}/{r['part']}")
    whole = None
    for number, parts in sorted(folders.items()):
        one = spark.read.schema(schema).option("basePath", f"{base}/data/{number}").parquet(*parts)
        whole = one if whole is None else whole.unionByName(one)
    return spark.createDataFrame([], schema) if whole is None else whole


def with_compact_ledger(
    spark: SparkSession, books: Books, base: str, money: T.DecimalType = MONEY
) -> Books:
    """``books`` with the compacted ledger; every operator and plan works on them as before."""
    wide = _wide(money)
    tables = books.tables() | {"gl_entry": compact_ledger(spark, base, money)}
    return Books.of(tables, wide, books.chart.broadcast_limit_bytes)
