"""Relations that must hold between the registered queries, whatever the data."""

from __future__ import annotations

import pytest

import __spark_entry__ as driver
from tests.helpers import rows


@pytest.fixture(scope="module")
def result(star_books):
    done = {}

    def get(name):
        if name not in done:
            done[name] = rows(driver.PLANS[name](star_books, driver.PARAMS))
        return done[name]

    return get


def per_parent(balances):
    sums = {}
    for _, parent, value in balances:
        sums[parent] = sums.get(parent, 0) + value
    return sums


@pytest.mark.parametrize(
    "rollup, cur, prev",
    [
        ("cash_category_rollup", "cash_balance_by_account", "cash_balance_by_account_prev"),
        (
            "expense_category_rollup",
            "expense_by_account_month",
            "expense_by_account_prev_month",
        ),
    ],
)
def test_rollup_is_the_sum_of_its_accounts(result, rollup, cur, prev):
    assert {c: v for _, c, v, _ in result(rollup)} == per_parent(result(cur))
    assert {c: v for _, c, _, v in result(rollup)} == per_parent(result(prev))


def test_income_vs_expense_is_the_pair_of_nets(result):
    [(income, expense)] = result("income_vs_expense")
    assert income == result("income_totals_cur")[0][2]
    assert expense == result("expense_totals_cur")[0][2]


def test_accounts_of_the_calendar_month_are_among_those_of_the_month_number(result):
    calendar = {a for a, *_ in result("expense_by_account_prev_month_calendar")}
    assert calendar <= {a for a, *_ in result("expense_by_account_prev_month")}
