"""A stored layout that joins the ledger to a large chart of accounts without a shuffle."""

from __future__ import annotations

from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerbeam.functions import month_number, text_key
from ledgerbeam.sources.books import Books
from ledgerbeam.sources.chart import NAME_PART, PART
from ledgerbeam.sources.schemas import MONEY, STORED, table_schemas

# Parts of a hot account for each bucket that its entries would fill: buckets get parts by a
# hash, and many small parts fill them more evenly than few large ones.
_FINENESS = 4


def _hot_accounts(ledger: DataFrame, buckets: int) -> DataFrame:
    """``(hot, parts)`` of the accounts that hold more than a bucket's fair share of all
    entries. There are fewer than ``buckets`` of them in any ledger."""
    total = ledger.count()
    found = (
        ledger.groupBy(F.col("account").alias("hot"))
        .agg(F.count("*").alias("entries"))
        .filter(F.col("entries") * buckets > F.lit(total))
        .select("hot", F.ceil(F.col("entries") * _FINENESS * buckets / total).cast("int"))
        .collect()
    )
    names, parts = ([r[i] for r in found] for i in (0, 1))
    table = pa.table({"hot": pa.array(names, pa.string()), "parts": pa.array(parts, pa.int32())})
    return ledger.sparkSession.createDataFrame(table, "hot string, parts int")


def write_books_by_account(books: Books, database: str, buckets: int = 256) -> None:
    """Store the books as tables of ``database``, ledger and chart bucketed by the account.

    With a chart too large to be copied, every query on ``write_books``' layout shuffles
    ledger entries or their sums by account. Here they lie in ``buckets`` buckets by a hash
    of the account and its part, the chart likewise, so Spark joins bucket with bucket where
    they are read. Inside a bucket the ledger is partitioned by fiscal year and month as in
    the other layout, and queries prune by them.

    An account with more than 1/``buckets`` of all entries is cut into parts by a hash of the
    whole entry; the chart repeats it once for each part. So no bucket, and no task, gets much
    more than its share, whatever an account holds, unless entries repeat one another in every
    column. Entries without an account are cut in the same way and join nothing.

    Spark keeps the buckets in its catalog, so the tables are opened by name
    (``open_books_by_account``), and the catalog has to outlive the session for them to do so.
    Choose ``buckets`` so that the ledger's share of one fits a task. The database must exist
    and have none of the tables. To add entries, write the tables anew: parts follow from the
    number of entries.
    """
    ledger = books.gl_entry.drop(*STORED["gl_entry"].names, PART)
    hot = F.broadcast(_hot_accounts(ledger, buckets))
    whole = F.xxhash64(*ledger.columns)
    dealt = (
        ledger.join(hot, F.col("account").eqNullSafe(F.col("hot")), "left")
        .withColumn(PART, F.coalesce(F.pmod(whole, F.col("parts")), F.lit(0)).cast("int"))
        .withColumn("posting_month", month_number("posting_date"))
        .drop("hot", "parts")
    )
    (
        dealt.repartition(buckets, "account", PART)
        .write.partitionBy("fiscal_year", "posting_month")
        .bucketBy(buckets, "account", PART)
        .sortBy("account", PART)
        .saveAsTable(f"{database}.gl_entry")
    )
    last = F.coalesce(F.col("parts"), F.lit(1)) - 1
    parts = (
        books.chart.df.join(hot, F.col("name") == F.col("hot"), "left")
        .withColumn(NAME_PART, F.explode(F.sequence(F.lit(0), last)))
        .drop("hot", "parts")
    )
    (
        parts.repartition(buckets, "name", NAME_PART)
        .write.bucketBy(buckets, "name", NAME_PART)
        .sortBy("name", NAME_PART)
        .saveAsTable(f"{database}.account_parts")
    )
    for name, df in books.tables().items():
        if name == "gl_entry":
            continue
        df = df.drop(*STORED.get(name, T.StructType()).names)
        if name in STORED:
            df = df.withColumn("status_key", text_key("status"))
        df.write.saveAsTable(f"{database}.{name}")


def open_books_by_account(
    spark: SparkSession, database: str, money: T.DecimalType = MONEY
) -> Books:
    """Open what ``write_books_by_account`` stored. Results are those of the other layouts."""
    books = Books.of(
        {name: spark.table(f"{database}.{name}") for name in table_schemas(money)}, money
    )
    parts = spark.table(f"{database}.account_parts")
    return replace(books, chart=replace(books.chart, parts=parts))
