"""Every registered query against plain SQL in another engine, and against known results."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as driver
from ledgerbeam.plans import published
from ledgerbeam.sources import open_books, write_books
from tests.helpers import TESTDATA, by_value, rows

# Rows and sum of the last column of each query at scale 0.001.
KNOWN = {
    "sales_paid_daily": (446, 122816833.29),
    "purchase_paid_daily": (1766, 159193618.75),
    "income_daily": (223, -3824565.16),
    "top_customers_by_payment": (5, 10915549.35),
    "cash_balance_by_account": (31, -1673732.21),
    "cash_balance_by_account_prev": (31, -3274307.25),
    "cash_category_rollup": (3, -3274307.25),
    "expense_by_account_month": (71, -3899211.44),
    "expense_by_account_prev_month": (68, -3022935.28),
    "expense_by_account_prev_month_calendar": (19, -414664.72),
    "expense_category_rollup": (9, -3022935.28),
    "headcount_by_join_date": (30, 199),
    "income_totals_cur": (1, -7097858.29),
    "expense_totals_cur": (1, -1962383.85),
    "income_totals_prev": (1, -5055296.37),
    "expense_totals_prev": (1, -5853739.42),
    "income_vs_expense": (1, -1962383.85),
    "dashboard_series": (2496, 268171206.91),
}
KNOWN |= {
    f"{name}_large_chart": KNOWN[name]
    for name in ("income_daily", "expense_category_rollup", "dashboard_series")
}
KNOWN["dashboard_series_compact"] = KNOWN["dashboard_series"]
KNOWN["top_customers_by_payment_pruned"] = KNOWN["top_customers_by_payment"]
LISTS = "dashboard_lists"


@pytest.fixture(scope="module")
def other_engine():
    con = duckdb.connect()
    for table in ("part", "lineitem", "orders", "events"):
        con.execute(
            f"create view {table} as select * from read_parquet('{TESTDATA}/sf0.001/{table}.parquet')"
        )
    yield con
    con.close()


def test_every_query_has_sql_and_a_known_result():
    names = set(driver.PLANS)
    assert names == set(KNOWN) | {LISTS}
    assert names <= set(driver.queries()) and names <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", KNOWN)
def test_equal_to_sql(spark, other_engine, name):
    got = driver.queries()[name](spark, f"{TESTDATA}/sf0.001")
    found = other_engine.execute(driver.oracle_sql()[name])
    assert got.columns == [c[0] for c in found.description]
    result = rows(got)
    assert by_value(result) == by_value(found.fetchall())
    count, total = KNOWN[name]
    assert len(result) == count
    last = list(zip(*result))[len(got.columns) - 1]
    assert round(sum(last), 2) == total


def test_lists_equal_sql(spark, other_engine):
    got = {s: (a, b) for s, a, b in rows(driver.queries()[LISTS](spark, f"{TESTDATA}/sf0.001"))}
    found = other_engine.execute(driver.oracle_sql()[LISTS])
    assert [c[0] for c in found.description] == ["series", "labels", "values"]
    assert got == {s: (list(a), list(b)) for s, a, b in found.fetchall()}
    assert len(got) == 11 and all(len(a) == len(b) > 0 for a, b in got.values())


@pytest.fixture(scope="module")
def stored_books(spark, star_books, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("parity") / "books")
    write_books(star_books, path)
    return open_books(spark, path)


@pytest.mark.parametrize("name", [*KNOWN, LISTS])
def test_same_result_on_the_stored_layout(star_books, stored_books, name):
    plan = driver.PLANS[name]
    star = published(plan(star_books, driver.PARAMS))
    stored = published(plan(stored_books, driver.PARAMS))
    assert star.dtypes == stored.dtypes
    assert by_value(star.collect()) == by_value(stored.collect())


@pytest.mark.parametrize("name", KNOWN)
def test_same_result_when_the_chart_is_too_large_to_broadcast(star_books, name):
    plan = driver.PLANS[name]
    small = published(plan(star_books, driver.PARAMS))
    large = published(plan(star_books.with_broadcast_limit(0), driver.PARAMS))
    assert small.dtypes == large.dtypes
    assert by_value(small.collect()) == by_value(large.collect())


def test_entry(spark):
    assert [r[0] for r in rows(driver.entry(spark))] == [1, 2, 3]
