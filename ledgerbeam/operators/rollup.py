"""Totals of a fixed, ordered list of categories; a category without entries shows 0."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerbeam.functions import net_amount
from ledgerbeam.sources.chart import ChartOfAccounts, account_key


def check_categories(categories: Sequence[str]) -> None:
    if not categories:
        raise ValueError("no categories given")
    if len(set(categories)) != len(categories):
        raise ValueError(f"categories repeat: {list(categories)}")


def category_frame(spark: SparkSession, categories: Sequence[str]) -> DataFrame:
    """``(ord, parent_account)``, one row per category, held in a single partition."""
    check_categories(categories)
    rows = pa.table({"ord": range(1, len(categories) + 1), "parent_account": list(categories)})
    return spark.createDataFrame(rows, "ord int, parent_account string").coalesce(1)


def category_totals(
    gl: DataFrame,
    chart: ChartOfAccounts,
    categories: Sequence[str],
    measures: Mapping[str, Column],
) -> DataFrame:
    """Net amount per category that has entries, with one column for each measure."""
    names = list(measures)
    entries = gl.filter(reduce(or_, measures.values())).select(
        *account_key(gl), *(F.when(rows, net_amount()).alias(name) for name, rows in measures.items())
    )
    return (
        chart.attach(entries, chart.under(categories), sums=names)
        .groupBy("parent_account")
        .agg(*(F.sum(name).alias(name) for name in names))
    )


def category_rollup(
    gl: DataFrame,
    chart: ChartOfAccounts,
    categories: Sequence[str],
    measures: Mapping[str, Column],
) -> DataFrame:
    """Net amount of every category, in the given order, with one column for each measure.

    A measure is a condition on ledger rows, e.g. ``{"total": fiscal_year == "2020"}``.
    All measures come from the same pass over the ledger. The ledger is reduced to one
    row per category before it meets the category list, which keeps the outer join
    (and with it the zero fill) off the large side.
    """
    totals = category_totals(gl, chart, categories, measures)
    # totals has at most one row per category, so copying it is safe at any data size
    return (
        category_frame(gl.sparkSession, categories)
        .join(F.broadcast(totals), "parent_account", "left")
        .select(
            "ord",
            "parent_account",
            *(F.coalesce(F.col(name), F.lit(0)).alias(name) for name in measures),
        )
        .orderBy("ord")
    )
