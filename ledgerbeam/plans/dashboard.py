"""All eleven series of the dashboard in one plan.

Seven of the series come from the ledger joined to the chart of accounts. When the
accounts they need fit a broadcast, they share one scan: ``ledger_base`` reduces the
ledger to a small table from which all seven are read. Otherwise there are two passes:
the six series without a date need nothing but sums by account, which go through the
shuffle as one row each; only income per day sends its entries through it.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerbeam.functions import (
    day_label,
    in_calendar_month,
    in_month_of_year,
    money_scale,
    net_amount,
)
from ledgerbeam.operators.daily import count_per_day, ledger_per_day, total_per_day
from ledgerbeam.operators.parties import top_parties
from ledgerbeam.plans.params import DashboardParams
from ledgerbeam.sources.books import Books
from ledgerbeam.sources.chart import Selection, account_key

# The ledger series, and the labels of those with a single net amount.
_CATEGORY_SERIES = ("cash_cur", "cash_prev", "expense_cur", "expense_prev")
_NET_LABELS = {"net_income": "income", "net_expense": "expense"}
_SERIES = ("income", *_CATEGORY_SERIES, *_NET_LABELS)
_BIT = {series: 1 << i for i, series in enumerate(_SERIES)}


def _bits(*series: str) -> int:
    return sum(_BIT[s] for s in series)


def _either(*choices: tuple[Column, int]) -> Column:
    """The bits of all choices whose condition holds."""
    return reduce(Column.bitwiseOR, (F.when(rows, bits).otherwise(0) for rows, bits in choices))


def _listed_parents(params: DashboardParams) -> list[str]:
    return [params.income_parent, *params.cash_categories, *params.expense_categories]


def _wanted_accounts(params: DashboardParams) -> Selection:
    """``(name, label)`` of the accounts that any ledger series reads.

    ``label.parent_no`` is the place of the parent among the listed ones, 0 for any other;
    ``label.may_feed`` has a bit for each series that the account counts towards.
    """
    parent, root = F.col("parent_account"), F.col("root_type")
    listed = _listed_parents(params)
    may_feed = _either(
        (parent == params.income_parent, _bits("income")),
        (parent.isin(list(params.cash_categories)), _bits("cash_cur", "cash_prev")),
        (parent.isin(list(params.expense_categories)), _bits("expense_cur", "expense_prev")),
        (root == params.income_root, _bits("net_income")),
        (root == params.expense_root, _bits("net_expense")),
    )
    parent_no = F.coalesce(F.array_position(F.lit(listed), parent).cast("int"), F.lit(0))
    roots = sorted((params.income_root, params.expense_root))
    return Selection(
        ("dashboard", tuple(listed), *roots),
        parent.isin(listed) | root.isin(roots),
        F.struct(parent_no.alias("parent_no"), may_feed.alias("may_feed")).alias("label"),
    )


def _expense_months(books: Books, params: DashboardParams) -> tuple[Column, Column]:
    """This month's entries and the month's before, by number or by calendar."""
    month = in_calendar_month if params.calendar_months else in_month_of_year
    return (
        month("posting_date", params.as_of, 0, books.gl_entry),
        month("posting_date", params.as_of, -1, books.gl_entry),
    )


def ledger_base(books: Books, params: DashboardParams) -> DataFrame:
    """The ledger summed to what the dashboard needs of it, in one pass.

    A row counts towards a series when its account and its own date and year both
    qualify; ``feeds`` has one bit for each such series. The group key holds nothing
    that no series reads: the date is kept only for the income parent, the parent only
    when it is listed, the account not at all. So the table has a few rows per day,
    whatever the number of accounts and entries, and every task hands the shuffle no
    more than that.

    ``known`` tells which sides of an entry are given (1 debit, 2 credit). With it in
    the key one sum of ``amount``, where a missing side counts as 0, serves both the
    series that skip entries with a missing side and those that total the sides apart.

    The wanted accounts have to fit a broadcast.
    """
    year = F.col("fiscal_year")
    this_month, month_before = _expense_months(books, params)
    row_feeds = _either(
        (F.lit(True), _bits("income")),
        (year == params.fiscal_year, _bits("cash_cur", "net_income", "net_expense")),
        (year == params.prior_fiscal_year, _bits("cash_prev")),
        (this_month, _bits("expense_cur")),
        (month_before, _bits("expense_prev")),
    )
    entries = books.gl_entry.select(
        "account", "posting_date", "debit", "credit", row_feeds.alias("row_feeds")
    )
    return (
        books.chart.label(entries, _wanted_accounts(params).of(books.chart))
        .select("*", "label.parent_no")
        .withColumn("feeds", F.col("row_feeds").bitwiseAND(F.col("label.may_feed")))
        .filter("feeds != 0")
        .selectExpr(
            "feeds",
            "parent_no",
            f"if(feeds & {_bits('income')} != 0, posting_date, null) as posting_date",
            "if(debit is null, 0, 1) + if(credit is null, 0, 2) as known",
            "coalesce(debit, 0) - coalesce(credit, 0) as amount",
        )
        .groupBy("feeds", "parent_no", "posting_date", "known")
        .agg(F.sum("amount").alias("amount"))
    )


def _from_shared_pass(books: Books, params: DashboardParams) -> DataFrame:
    """``(series, day, label, value)``: each row of the base goes to the series it feeds."""
    fed = ", ".join(f"if(feeds & {bit} != 0, '{series}', null)" for series, bit in _BIT.items())
    parent = F.get(F.lit(_listed_parents(params)), F.col("parent_no") - 1)
    label = F.when(F.col("series").isin(list(_CATEGORY_SERIES)), parent)
    for series, name in _NET_LABELS.items():
        label = label.when(F.col("series") == series, name)
    is_net = F.col("series").isin(list(_NET_LABELS))
    return (
        ledger_base(books, params)
        .selectExpr(f"explode(array_compact(array({fed}))) as series", "*")
        .withColumn("label", label)
        .groupBy("series", F.expr("if(series = 'income', posting_date, null) as day"), "label")
        .agg(
            F.sum("amount").alias("of_sides"),
            F.expr("sum(amount) filter (where known = 3)").alias("of_rows"),
            F.expr("bit_or(known) = 3").alias("both_sides"),
        )
        .withColumn(
            "value",
            F.when(is_net, F.expr("if(both_sides, of_sides, null)")).otherwise(F.col("of_rows")),
        )
        .select("series", "day", "label", "value")
    )


def _from_two_passes(books: Books, params: DashboardParams) -> DataFrame:
    """``(series, day, label, value)`` with the ledger summed by account before its join."""
    gl, chart, year = books.gl_entry, books.chart, F.col("fiscal_year")
    this_month, month_before = _expense_months(books, params)
    net_rows = {
        "cash_cur": year == params.fiscal_year,
        "cash_prev": year == params.prior_fiscal_year,
        "expense_cur": this_month,
        "expense_prev": month_before,
    }
    entries = gl.filter(reduce(Column.__or__, net_rows.values())).select(
        *account_key(gl),
        *(F.when(rows, net_amount()).alias(series) for series, rows in net_rows.items()),
        *(F.when(year == params.fiscal_year, F.col(side)).alias(side) for side in ("debit", "credit")),
    )
    sums = [*net_rows, "debit", "credit"]
    small = (
        chart.attach(entries, _wanted_accounts(params), sums)
        .groupBy("label")
        .agg(*(F.sum(c).alias(c) for c in sums))
    )
    listed = F.get(F.lit(_listed_parents(params)), F.col("label.parent_no") - 1)
    nothing = F.lit(None).cast(small.schema["cash_cur"].dataType)

    def point(series: str, label: Column, value: Column, debit: Column, credit: Column) -> Column:
        fed = F.col("label.may_feed").bitwiseAND(F.lit(_BIT[series])) != 0
        parts = {"series": F.lit(series), "label": label, "value": value, "debit": debit, "credit": credit}
        return F.when(fed, F.struct(*(c.alias(name) for name, c in parts.items())))

    points = [point(s, listed, F.col(s), nothing, nothing) for s in net_rows]
    points += [
        point(s, F.lit(name), nothing, F.col("debit"), F.col("credit"))
        for s, name in _NET_LABELS.items()
    ]
    side = T.DecimalType(37, money_scale(gl))
    net = F.sum("point.debit").cast(side) - F.sum("point.credit").cast(side)
    undated = (
        small.select(F.explode(F.array_compact(F.array(*points))).alias("point"))
        .groupBy("point.series", "point.label")
        .agg(F.sum("point.value").alias("value"), net.alias("net"))
        .select(
            "series",
            "label",
            F.when(F.col("series").isin(list(_NET_LABELS)), F.col("net"))
            .otherwise(F.col("value"))
            .alias("value"),
        )
    )
    income = ledger_per_day(gl, chart, [params.income_parent], "value").selectExpr(
        "'income' as series", "posting_date as day", "value"
    )
    return undated.unionByName(income, allowMissingColumns=True)


def _ledger_series(books: Books, params: DashboardParams) -> DataFrame:
    """``(series, place, day, label, value)`` of the seven ledger series.

    One empty row per fixed label joins the points before a last sum over this small
    table. It gives the label its place and, where there were no entries, its 0.
    """
    wanted = _wanted_accounts(params)
    books.chart.measure(wanted, books.chart.under([params.income_parent]))
    if books.chart.fits_broadcast(wanted):
        points = _from_shared_pass(books, params)
    else:
        points = _from_two_passes(books, params)
    fixed_labels = {
        "cash_cur": params.cash_categories,
        "cash_prev": params.cash_categories,
        "expense_cur": params.expense_categories,
        "expense_prev": params.expense_categories,
        **{series: (label,) for series, label in _NET_LABELS.items()},
    }
    places = pa.Table.from_pylist(
        [
            {"series": series, "place": place, "label": label}
            for series, labels in fixed_labels.items()
            for place, label in enumerate(labels, start=1)
        ]
    )
    empty = points.sparkSession.createDataFrame(places, "series string, place int, label string")
    return (
        points.unionByName(empty.coalesce(1), allowMissingColumns=True)
        .groupBy("series", "day", "label")
        .agg(F.max("place").alias("place"), F.sum("value").alias("value"))
        .withColumn("value", F.expr("if(place is null, value, coalesce(value, 0))"))
    )


def dashboard_series(books: Books, params: DashboardParams) -> DataFrame:
    """Every published series in long form: ``(series, ord, label, value)``.

    ``ord`` counts from 1 within a series: by date, by fixed place, or by rank. A
    series has at most one row per calendar day, category or top party, so the window
    that numbers it never holds more than that.
    """
    sales = total_per_day(books.sales_invoice, params.paid_status, "value")
    purchases = total_per_day(books.purchase_invoice, params.paid_status, "value")
    joiners = count_per_day(books.employee, "date_of_joining", "name", "value")
    payers = top_parties(books.gl_entry, params.party_type, params.voucher_type, params.top_k)

    amount = T.DecimalType(38, money_scale(books.gl_entry)).simpleString()
    value = f"cast(value as {amount}) as value"
    by_rank = f"cast(total_annual as {amount})"
    parts = [
        _ledger_series(books, params).selectExpr("series", "place", "day", "label", value),
        sales.selectExpr("'sales_paid' as series", "posting_date as day", value),
        purchases.selectExpr("'purchase_paid' as series", "posting_date as day", value),
        joiners.selectExpr("'headcount' as series", "date_of_joining as day", value),
        payers.selectExpr(
            "'top_customers' as series",
            "customer as label",
            f"{by_rank} as value",
            f"{by_rank} as rank_by",
        ),
    ]
    points = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    in_order = Window.partitionBy("series").orderBy(
        F.col("place").asc_nulls_first(),
        F.col("day").asc_nulls_first(),
        F.col("rank_by").desc_nulls_last(),
        F.col("label").asc_nulls_last(),
    )
    return points.select(
        "series",
        F.row_number().over(in_order).alias("ord"),
        F.coalesce(F.col("label"), day_label("day")).alias("label"),
        "value",
    )


def as_lists(series: DataFrame) -> DataFrame:
    """The page's own form: per series, its labels and its values as parallel lists."""
    return (
        series.groupBy("series")
        .agg(F.array_sort(F.collect_list(F.struct("ord", "label", "value"))).alias("points"))
        .selectExpr(
            "series",
            "transform(points, p -> p.label) as labels",
            "transform(points, p -> p.value) as values",
        )
    )
