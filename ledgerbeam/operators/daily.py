"""Values per day, oldest day first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerbeam.functions import net_amount, same_text
from ledgerbeam.sources.chart import ChartOfAccounts, account_key


def total_per_day(
    invoices: DataFrame,
    status: str,
    name: str,
    date_col: str = "posting_date",
    value_col: str = "total",
) -> DataFrame:
    """``daily_total`` without its sort, for use inside a larger plan."""
    return (
        invoices.filter(same_text("status", status, invoices))
        .groupBy(date_col)
        .agg(F.sum(value_col).alias(name))
    )


def daily_total(
    invoices: DataFrame,
    status: str,
    name: str,
    date_col: str = "posting_date",
    value_col: str = "total",
) -> DataFrame:
    """Sum of ``value_col`` per day over invoices in the given status."""
    return total_per_day(invoices, status, name, date_col, value_col).orderBy(date_col)


def count_per_day(df: DataFrame, date_col: str, id_col: str, name: str) -> DataFrame:
    """``daily_count`` without its sort, for use inside a larger plan."""
    return df.groupBy(date_col).agg(F.count(id_col).alias(name))


def daily_count(df: DataFrame, date_col: str, id_col: str, name: str) -> DataFrame:
    """Number of rows per day whose ``id_col`` is known."""
    return count_per_day(df, date_col, id_col, name).orderBy(date_col)


def ledger_per_day(
    gl: DataFrame, chart: ChartOfAccounts, parents: Sequence[str], name: str
) -> DataFrame:
    """``ledger_daily`` without its sort, for use inside a larger plan."""
    entries = gl.select(*account_key(gl), "posting_date", net_amount().alias(name))
    return (
        chart.attach(entries, chart.under(parents), sums=[name])
        .groupBy("posting_date", F.col("parent_account").alias("account_parent"))
        .agg(F.sum(name).alias(name))
    )


def ledger_daily(
    gl: DataFrame, chart: ChartOfAccounts, parents: Sequence[str], name: str
) -> DataFrame:
    """Net amount per day and parent over the accounts below ``parents``."""
    return ledger_per_day(gl, chart, parents, name).orderBy("posting_date", "account_parent")


def account_daily_credit(gl: DataFrame, account: str, name: str) -> DataFrame:
    """Credits per day of one account, without regard to its place in the chart."""
    return (
        gl.filter(F.col("account") == account)
        .groupBy("posting_date")
        .agg(F.sum("credit").alias(name))
        .orderBy("posting_date")
    )
