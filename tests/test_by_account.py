"""Ledger and chart stored by the account: no shuffle, no bucket larger than others."""

from __future__ import annotations

import uuid
from datetime import date

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from ledgerbeam.operators import account_balance, ledger_daily
from ledgerbeam.sources import open_books_by_account, write_books_by_account
from tests.helpers import by_value, entry, make_books, plan_of, rows

LARGE = [name for name in driver.PLANS if name.endswith("_large_chart")]


def by_account(spark, books, buckets):
    database = f"books_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database}")
    write_books_by_account(books, database, buckets)
    return open_books_by_account(spark, database)


@pytest.fixture(scope="module")
def star_by_account(spark, star_books):
    return by_account(spark, star_books, 8)


@pytest.mark.parametrize("limits", [(None, None), (0, None), (0, 0)], ids=["small", "filter", "bare"])
@pytest.mark.parametrize("name", sorted(driver.PLANS))
def test_every_query_gives_what_it_gives_on_plain_tables(star_books, star_by_account, name, limits):
    books = star_by_account
    if limits[0] is not None:
        books = books.with_broadcast_limit(*limits)
    want = driver.PLANS[name](star_books, driver.PARAMS)
    got = driver.PLANS[name](books, driver.PARAMS)
    assert got.columns == want.columns
    assert by_value(rows(got)) == by_value(rows(want))


def ledger_side(plan):
    """The lines from each join with the chart down to the scan of the ledger."""
    out = []
    for below in plan.split("SortMergeJoin")[1:]:
        assert below.index("/gl_entry") < below.index("/account_parts")  # the ledger is on the left
        out.append(below[: below.index("/gl_entry")])
    return out


@pytest.mark.parametrize("filter_bytes", [None, 0], ids=["filter", "bare"])
@pytest.mark.parametrize("name", LARGE)
def test_the_ledger_is_joined_where_it_is_read(spark, star_by_account, name, filter_bytes):
    plain = name.removesuffix("_large_chart")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        books = star_by_account.with_broadcast_limit(0, filter_bytes)
        plan = plan_of(driver.PLANS[plain](books, driver.PARAMS))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    sides = ledger_side(plan)
    assert len(sides) == (2 if plain == "dashboard_series" else 1)
    for side in sides:
        assert "Exchange hashpartitioning" not in side
    assert plan.count("Bucketed: true") == 2 * len(sides)


def test_months_still_prune(spark, star_by_account):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        books = star_by_account.with_broadcast_limit(0, 0)
        plan = plan_of(driver.PLANS["expense_by_account_prev_month_calendar"](books, driver.PARAMS))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    [scan] = [line for line in plan.splitlines() if "FileScan" in line and "/gl_entry" in line]
    assert "posting_month" in scan.split("PartitionFilters: ")[1].split("PushedFilters")[0]


def test_a_hot_account_lies_in_many_buckets(spark):
    day = [date(2020, 1 + i % 12, 1 + i % 28) for i in range(336)]
    entries = [entry("ads", i, 0, day=day[i % 336]) for i in range(6000)]
    entries += [entry(f"a{i % 600}", i, None if i % 7 else 1) for i in range(6000)]
    entries += [entry(None, i, 0, day=None, year=None) for i in range(3000)]
    chart = [("ads", "SELL", "Expense")] + [(f"a{i}", "SELL", "Expense") for i in range(600)]
    books = make_books(spark, entries, chart)
    dealt = by_account(spark, books, 16)
    ledger = dealt.gl_entry
    bucket = F.regexp_extract(F.input_file_name(), r"_(\d{5})\.c", 1).alias("bucket")
    filled = rows(ledger.groupBy(bucket).count())
    assert len(filled) == 16 and sum(n for _, n in filled) == 15000
    assert max(n for _, n in filled) < 2 * 15000 / 16
    hot = rows(ledger.filter("account = 'ads'").groupBy(bucket).count())
    assert len(hot) >= 8 and max(n for _, n in hot) < 6000 / 4
    assert dealt.chart.parts.filter("name = 'a1'").count() == 1
    large = dealt.with_broadcast_limit(0, 0)
    for operator, args in ((ledger_daily, ("v",)), (account_balance, ("2020",))):
        want = operator(books.gl_entry, books.chart, ["SELL"], *args)
        got = operator(large.gl_entry, large.chart, ["SELL"], *args)
        assert by_value(rows(got)) == by_value(rows(want))


def test_empty_books_and_a_ledger_of_one_account(spark):
    for entries in ([], [entry("ads", 5, 0)] * 50):
        books = make_books(spark, entries)
        large = by_account(spark, books, 4).with_broadcast_limit(0, 0)
        got = account_balance(large.gl_entry, large.chart, ["SELL"], "2020")
        assert rows(got) == rows(account_balance(books.gl_entry, books.chart, ["SELL"], "2020"))
