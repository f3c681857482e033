"""One-row totals by root type of the chart of accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerbeam.functions import net_of_sums
from ledgerbeam.sources.chart import ChartOfAccounts, account_key


def _entries_of_year(gl: DataFrame, fiscal_year: str) -> DataFrame:
    rows = gl.filter(F.col("fiscal_year") == fiscal_year)
    return rows.select(*account_key(gl), "debit", "credit")


def root_type_totals(
    gl: DataFrame, chart: ChartOfAccounts, root_type: str, fiscal_year: str
) -> DataFrame:
    """Total debit, credit and net of one root type; one row of NULLs without entries."""
    entries = chart.attach(
        _entries_of_year(gl, fiscal_year),
        chart.of_root_types([root_type]),
        sums=["debit", "credit"],
    )
    return entries.agg(
        F.sum("debit").alias("debit"),
        F.sum("credit").alias("credit"),
        net_of_sums(entries).alias("net"),
    )


def income_vs_expense(
    gl: DataFrame,
    chart: ChartOfAccounts,
    fiscal_year: str,
    income_root: str = "Income",
    expense_root: str = "Expense",
) -> DataFrame:
    """Net income and net expense of a year side by side, 0 without entries.

    Conditional sums without a group key: Spark keeps those in local variables, where a
    grouped decimal sum would be written back to a hash map row by row.
    """
    entries = chart.attach(
        _entries_of_year(gl, fiscal_year),
        chart.of_root_types([income_root, expense_root]),
        sums=["debit", "credit"],
    )

    def net_of(root_type: str):
        net = net_of_sums(entries, where=F.col("root_type") == root_type)
        return F.coalesce(net, F.lit(0))

    return entries.agg(net_of(income_root).alias("pendapatan"), net_of(expense_root).alias("beban"))
