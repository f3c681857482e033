"""Small hand-made books and ways to look at results and plans."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from ledgerbeam.plans import DashboardParams
from ledgerbeam.sources import Books
from ledgerbeam.sources.schemas import table_schemas

TESTDATA = "/root/testdata"

PARAMS = DashboardParams(
    income_parent="INC",
    cash_categories=("CASH", "DEPOSIT", "BANK"),
    expense_categories=("SELL", "PAY", "OTHER"),
    fiscal_year="2020",
    prior_fiscal_year="2019",
    as_of=date(2020, 3, 15),
)

# Chart used by the hand-made cases: name, parent, root type.
CHART = [
    ("till", "CASH", "Asset"),
    ("safe", "CASH", "Asset"),
    ("bank", "BANK", "Asset"),
    ("sales", "INC", "Income"),
    ("refunds", "INC", "Income"),
    ("ads", "SELL", "Expense"),
    ("wages", "PAY", "Expense"),
    ("misc", "OTHER", "Expense"),
    ("loan", "DEBT", "Liability"),
]


def money(value) -> Decimal | None:
    return None if value is None else Decimal(str(value)).quantize(Decimal("0.01"))


def entry(
    account,
    debit,
    credit,
    day=date(2020, 3, 1),
    year="2020",
    party=None,
    party_type=None,
    voucher_type="Journal Entry",
):
    return (account, day, money(debit), money(credit), year, party, party_type, voucher_type)


def payment(party, credit):
    return entry("AR", 0, credit, party=party, party_type="Customer", voucher_type="Payment Entry")


def frame(spark: SparkSession, table: str, rows) -> DataFrame:
    return spark.createDataFrame(list(rows), table_schemas()[table])


def make_books(spark, entries=(), chart=CHART, sales=(), purchases=(), employees=()) -> Books:
    return Books.of(
        {
            "sales_invoice": frame(spark, "sales_invoice", sales),
            "purchase_invoice": frame(spark, "purchase_invoice", purchases),
            "gl_entry": frame(spark, "gl_entry", entries),
            "account": frame(spark, "account", chart),
            "employee": frame(spark, "employee", employees),
        }
    )


def rows(df: DataFrame) -> list[tuple]:
    return [tuple(r) for r in df.collect()]


def by_value(records) -> list[tuple]:
    """Rows in one fixed order, whatever their types and NULLs."""
    return sorted(map(tuple, records), key=lambda r: tuple((v is None, str(v)) for v in r))


def plan_of(df: DataFrame) -> str:
    """The physical plan; run the query first to see what was really executed."""
    return df._jdf.queryExecution().executedPlan().toString()


@contextmanager
def jobs(spark: SparkSession):
    """Counts the jobs that are started inside; call the result after the block."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    found: list[int] = []
    try:
        yield lambda: len(found)
    finally:
        found += spark.sparkContext.statusTracker().getJobIdsForGroup(group)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
