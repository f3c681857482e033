"""Net amount per account, largest first."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerbeam.functions import in_calendar_month, in_month_of_year, net_amount
from ledgerbeam.sources.chart import ChartOfAccounts, account_key


def _balances(
    gl: DataFrame, chart: ChartOfAccounts, parents: Sequence[str], rows: Column, name: str
) -> DataFrame:
    entries = gl.filter(rows).select(*account_key(gl), net_amount().alias(name))
    return (
        chart.attach(entries, chart.under(parents), sums=[name])
        .groupBy(
            F.col("account").alias("account_type"),
            F.col("parent_account").alias("account_parent"),
        )
        .agg(F.sum(name).alias(name))
        .orderBy(F.col(name).desc_nulls_last(), "account_type")
    )


def account_balance(
    gl: DataFrame,
    chart: ChartOfAccounts,
    parents: Sequence[str],
    fiscal_year: str,
    name: str = "total",
) -> DataFrame:
    """Balance of one fiscal year for each account below ``parents``."""
    return _balances(gl, chart, parents, F.col("fiscal_year") == fiscal_year, name)


def account_balance_month(
    gl: DataFrame,
    chart: ChartOfAccounts,
    parents: Sequence[str],
    as_of: date | None = None,
    offset: int = 0,
    name: str = "total_kas",
) -> DataFrame:
    """Balance of one month number for each account below ``parents``.

    All years are added together, and the month before January is empty; see
    ``account_balance_calendar_month`` for a true month.
    """
    return _balances(gl, chart, parents, in_month_of_year("posting_date", as_of, offset, gl), name)


def account_balance_calendar_month(
    gl: DataFrame,
    chart: ChartOfAccounts,
    parents: Sequence[str],
    as_of: date | None = None,
    offset: int = 0,
    name: str = "total_kas",
) -> DataFrame:
    """Balance of one calendar month of one year for each account below ``parents``."""
    return _balances(gl, chart, parents, in_calendar_month("posting_date", as_of, offset, gl), name)
