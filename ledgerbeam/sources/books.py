from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ledgerbeam.functions import month_number, text_key
from ledgerbeam.sources.chart import BROADCAST_LIMIT_BYTES, PART, ChartOfAccounts
from ledgerbeam.sources.schemas import MONEY, STORED, conform, table_schemas
from ledgerbeam.sources.splits import SPLIT_TABLES, split_reader

# The table names under which the ERP stores its documents.
ERP_TABLES = {
    "sales_invoice": "tabSales Invoice",
    "purchase_invoice": "tabPurchase Invoice",
    "gl_entry": "tabGL Entry",
    "account": "tabAccount",
    "employee": "tabEmployee",
}


@dataclass(frozen=True)
class Books:
    """The five tables that the dashboard reads."""

    sales_invoice: DataFrame
    purchase_invoice: DataFrame
    gl_entry: DataFrame
    chart: ChartOfAccounts
    employee: DataFrame

    @classmethod
    def of(
        cls,
        tables: dict[str, DataFrame],
        money: T.DecimalType = MONEY,
        broadcast_limit_bytes: int = BROADCAST_LIMIT_BYTES,
        exact_floats: bool = False,
    ) -> Books:
        """Take the tables by name, check their types, and verify the account table."""
        shaped = {
            name: conform(
                tables[name], schema, exact_floats, (*STORED.get(name, T.StructType()).names, PART)
            )
            for name, schema in table_schemas(money).items()
        }
        return cls(
            sales_invoice=shaped["sales_invoice"],
            purchase_invoice=shaped["purchase_invoice"],
            gl_entry=shaped["gl_entry"],
            chart=ChartOfAccounts.verified(shaped["account"], broadcast_limit_bytes),
            employee=shaped["employee"],
        )

    def with_broadcast_limit(
        self, limit_bytes: int, filter_limit_bytes: int | None = None
    ) -> Books:
        return replace(
            self, chart=self.chart.with_broadcast_limit(limit_bytes, filter_limit_bytes)
        )

    def tables(self) -> dict[str, DataFrame]:
        return {
            "sales_invoice": self.sales_invoice,
            "purchase_invoice": self.purchase_invoice,
            "gl_entry": self.gl_entry,
            "account": self.chart.df,
            "employee": self.employee,
        }


def books_from_erp(
    read: Callable[[str], DataFrame], money: T.DecimalType = MONEY, exact_floats: bool = False
) -> Books:
    """Read the ERP's own tables through any Spark reader.

    ``read`` gets a table name, e.g. ``lambda t: spark.table(f"erp.`{t}`")`` for a
    catalog (a lake table format or Spark's JDBC catalog), or
    ``lambda t: spark.read.jdbc(url, f"`{t}`", properties=p)``. Amounts must be decimals
    that ``money`` holds in full; ``exact_floats`` is explained at ``conform``.
    """
    return Books.of(
        {name: read(table) for name, table in ERP_TABLES.items()}, money, exact_floats=exact_floats
    )


def books_from_sql(
    read: Callable[[str], DataFrame],
    read_where: Callable[[str, list[str]], DataFrame],
    splits: int = 64,
    money: T.DecimalType = MONEY,
    exact_floats: bool = False,
) -> Books:
    """Read the ERP's tables from an SQL database, the large ones in about ``splits`` tasks.

    ``read`` gets a table or a query in parentheses with an alias; ``read_where`` a table and
    disjoint conditions, one for each task: with Spark's JDBC reader
    ``lambda t: spark.read.jdbc(url, t, properties=p)`` and
    ``lambda t, where: spark.read.jdbc(url, t, predicates=where, properties=p)``.

    The database counts the rows of each posting date; ranges of dates with like numbers of
    rows follow from that, and a crowded day is cut by a checksum of the primary key
    (``date_splits``). Every row is read by exactly one task, also one without a date or of a
    day that came later. A query that filters by date has its filter pushed into every split.
    """
    table = split_reader(read, read_where, splits)
    return Books.of(
        {name: table(erp, SPLIT_TABLES.get(name)) for name, erp in ERP_TABLES.items()},
        money,
        exact_floats=exact_floats,
    )


def ledger_files(path: str) -> str:
    """Where ``write_books`` puts the ledger."""
    return f"{path}/gl_entry"


def _write_ledger(ledger: DataFrame, path: str, mode: str) -> None:
    (
        ledger.withColumn("posting_month", month_number("posting_date"))
        .hint("rebalance", "fiscal_year", "posting_month")
        .sortWithinPartitions("fiscal_year", "posting_month", "posting_date")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("fiscal_year", "posting_month")
        .parquet(path)
    )


def write_books(books: Books, path: str) -> None:
    """Store the tables as Parquet in a layout made for the dashboard's filters.

    Ledger entries are partitioned by fiscal year and by the month of their date, and
    sorted by date inside each file, so a filter by year, by month number or by calendar
    month opens the files of those months alone. The rebalance hint lets adaptive execution
    cut a month that holds much of the data into many files, and gather small ones.
    Invoices get their status as it is compared, which Parquet can then skip by.
    """
    for name, df in books.tables().items():
        target = f"{path}/{name}"
        df = df.drop(*STORED.get(name, T.StructType()).names, PART)
        if name == "gl_entry":
            _write_ledger(df, target, "error")
        elif name in STORED:
            df.withColumn("status_key", text_key("status")).write.parquet(target)
        else:
            df.write.parquet(target)


def rewrite_months(ledger: DataFrame, path: str) -> None:
    """Replace the months of the stored ledger that ``ledger`` has entries of; others stay.

    Give all entries of such a month, with what came late or was corrected. Partitions are
    overwritten one by one, so nothing else is read or written; ``ledger`` must not read
    the files that it replaces. A month that has no entries left is not touched: keep an
    entry of no amount, or remove its folder."""
    _write_ledger(ledger.drop(*STORED["gl_entry"].names, PART), ledger_files(path), "overwrite")


def open_books(spark: SparkSession, path: str, money: T.DecimalType = MONEY) -> Books:
    """Open what ``write_books`` stored. The explicit schemas keep ``fiscal_year`` text
    and save the read of file footers. Books stored before months were partitioned have to
    be written again."""
    return Books.of(
        {
            name: spark.read.schema(
                T.StructType([*schema, *STORED.get(name, T.StructType())])
            ).parquet(f"{path}/{name}")
            for name, schema in table_schemas(money).items()
        },
        money,
    )
