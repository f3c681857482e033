"""Rows that are easy to get wrong, one test for each rule."""

from __future__ import annotations

from dataclasses import replace
from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerbeam import operators as op
from ledgerbeam.functions import in_month_of_year
from ledgerbeam.plans import as_lists, dashboard_series
from ledgerbeam.sources import Books
from ledgerbeam.sources.schemas import table_schemas
from tests.helpers import CHART, PARAMS, entry, frame, make_books, payment, rows

MARCH = date(2020, 3, 1)


@pytest.fixture(params=[True, False], ids=["broadcast", "shuffle"])
def books_of(request, spark):
    """Builds books whose chart joins in one or the other way."""

    def build(entries, **other):
        books = make_books(spark, entries, **other)
        return books if request.param else books.with_broadcast_limit(0)

    return build


def test_status_ignores_case_and_trailing_spaces(spark):
    states = ["Paid", "paid", "PAID ", " paid", "Unpaid", None]
    df = frame(spark, "sales_invoice", [(MARCH, D(1), s) for s in states])
    assert rows(op.daily_total(df, "paid", "total_si")) == [(MARCH, D(3))]


def test_days_come_oldest_first(spark):
    days = [date(2020, 2, 1), None, date(2019, 12, 31), date(2020, 1, 5)]
    df = frame(spark, "sales_invoice", [(d, D(1), "Paid") for d in days])
    assert [r[0] for r in rows(op.daily_total(df, "paid", "t"))] == [
        None,
        date(2019, 12, 31),
        date(2020, 1, 5),
        date(2020, 2, 1),
    ]


def test_net_of_a_row_with_one_side_missing(books_of):
    b = books_of([entry("till", 1, None), entry("till", 2, 1)])
    assert rows(op.account_balance(b.gl_entry, b.chart, ["CASH"], "2020")) == [
        ("till", "CASH", D(1))
    ]


def test_totals_keep_the_known_side(books_of):
    b = books_of([entry("sales", 1, None), entry("refunds", 2, 1)])
    got = rows(op.root_type_totals(b.gl_entry, b.chart, "Income", "2020"))
    assert got == [(D(3), D(1), D(2))]
    assert rows(op.income_vs_expense(b.gl_entry, b.chart, "2020")) == [(D(2), D(0))]


def test_totals_without_entries(books_of):
    b = books_of([entry("till", 1, 0)])
    assert rows(op.root_type_totals(b.gl_entry, b.chart, "Income", "2020")) == [(None, None, None)]
    assert rows(op.income_vs_expense(b.gl_entry, b.chart, "2020")) == [(0, 0)]


def test_totals_with_a_side_that_is_never_known(books_of):
    b = books_of([entry("sales", 5, None)])
    assert rows(op.root_type_totals(b.gl_entry, b.chart, "Income", "2020")) == [(D(5), None, None)]
    assert rows(op.income_vs_expense(b.gl_entry, b.chart, "2020")) == [(0, 0)]


@pytest.mark.parametrize("limit", [10**6, 0])
def test_no_decimal_place_is_lost(spark, limit):
    cent, fine = D("0.000000001"), T.DecimalType(21, 9)
    day, schemas = MARCH, table_schemas(fine)
    ledger = [
        (a, day, D(10**11) + cent, cent * 3, "2020", "p", "Customer", "Payment Entry")
        for a in ("till", "sales", "ads")
    ]
    data = {"gl_entry": ledger, "account": CHART}
    b = Books.of({t: spark.createDataFrame(data.get(t, []), s) for t, s in schemas.items()}, fine, limit)
    want = D(10**11) - 2 * cent
    assert rows(op.root_type_totals(b.gl_entry, b.chart, "Income", "2020"))[0][2] == want
    assert rows(op.income_vs_expense(b.gl_entry, b.chart, "2020")) == [(want, want)]
    assert rows(op.account_balance(b.gl_entry, b.chart, ["CASH"], "2020"))[0][2] == want
    assert _rollup(b)[0][2] == want
    shown = {v for s, _, _, v in rows(dashboard_series(b, PARAMS)) if v}
    assert shown == {want, cent * 9}


def _rollup(b, categories=PARAMS.cash_categories):
    year = F.col("fiscal_year")
    return rows(
        op.category_rollup(
            b.gl_entry, b.chart, categories, {"cur": year == "2020", "prev": year == "2019"}
        )
    )


def test_category_without_accounts_or_entries_shows_zero(books_of):
    b = books_of([entry("till", 5, 2), entry("safe", 1, 0), entry("till", 7, 0, year="2019")])
    assert _rollup(b) == [
        (1, "CASH", D(4), D(7)),
        (2, "DEPOSIT", 0, 0),
        (3, "BANK", 0, 0),
    ]


def test_category_order_is_the_given_one(books_of):
    b = books_of([entry("till", 5, 0), entry("bank", 1, 0)])
    assert [r[:3] for r in _rollup(b, ["BANK", "CASH"])] == [(1, "BANK", D(1)), (2, "CASH", D(5))]


def test_category_whose_sums_are_unknown_shows_zero(books_of):
    assert _rollup(books_of([entry("till", None, None)]))[0] == (1, "CASH", 0, 0)


def test_repeated_category_is_refused(spark):
    b = make_books(spark)
    with pytest.raises(ValueError, match="repeat"):
        _rollup(b, ["CASH", "CASH"])


@pytest.mark.parametrize("bad", [(), ("CASH", "BANK", "CASH")])
def test_dashboard_refuses_category_lists_it_could_not_show(bad):
    from dataclasses import replace

    for field in ("cash_categories", "expense_categories"):
        with pytest.raises(ValueError, match="categories"):
            replace(PARAMS, **{field: bad})


def test_entries_without_an_account_are_dropped(books_of):
    b = books_of([entry("nowhere", 1, 0), entry(None, 1, 0), entry("till", 2, 0)])
    assert rows(op.account_balance(b.gl_entry, b.chart, ["CASH"], "2020")) == [
        ("till", "CASH", D(2))
    ]


def test_balances_come_largest_first_and_unknown_last(books_of):
    b = books_of(
        [entry("bank", None, 1), entry("till", 2, 0), entry("safe", 9, 0), entry("till", 1, 0)]
    )
    got = rows(op.account_balance(b.gl_entry, b.chart, ["CASH", "BANK"], "2020"))
    assert got == [("safe", "CASH", D(9)), ("till", "CASH", D(3)), ("bank", "BANK", None)]


def test_ties_go_to_the_lower_name(spark):
    b = make_books(spark, [payment(p, v) for p, v in zip("ABCDFE", [9, 8, 7, 6, 5, 5])])
    got = rows(op.top_parties(b.gl_entry, "Customer", "Payment Entry"))
    assert got == [("A", D(9)), ("B", D(8)), ("C", D(7)), ("D", D(6)), ("E", D(5))]


def test_unknown_party_is_a_party(spark):
    b = make_books(spark, [payment(None, 4), payment(None, 4), payment("A", 5)])
    got = rows(op.top_parties(b.gl_entry, "Customer", "Payment Entry", k=2))
    assert got == [(None, D(8)), ("A", D(5))]


def test_only_matching_vouchers_count(spark):
    b = make_books(
        spark,
        [
            payment("A", 1),
            entry("AR", 0, 9, party="A", party_type="Supplier", voucher_type="Payment Entry"),
            entry("AR", 0, 9, party="A", party_type="Customer", voucher_type="Sales Invoice"),
        ],
    )
    assert rows(op.top_parties(b.gl_entry, "Customer", "Payment Entry")) == [("A", D(1))]


def test_month_number_adds_all_years(books_of):
    b = books_of([entry("ads", 1, 0, day=date(y, 3, 9)) for y in (2018, 2019, 2020)])
    got = rows(op.account_balance_month(b.gl_entry, b.chart, ["SELL"], date(2020, 3, 15)))
    assert got == [("ads", "SELL", D(3))]


def test_month_number_before_january_is_empty(books_of):
    b = books_of([entry("ads", 1, 0, day=date(2019, 12, 9)), entry("ads", 1, 0, day=date(2020, 1, 9))])
    jan = date(2020, 1, 15)
    assert rows(op.account_balance_month(b.gl_entry, b.chart, ["SELL"], jan, offset=-1)) == []
    rollup = op.category_rollup(
        b.gl_entry,
        b.chart,
        ["SELL"],
        {
            "cur": in_month_of_year("posting_date", jan),
            "prev": in_month_of_year("posting_date", jan, -1),
        },
    )
    assert rows(rollup) == [(1, "SELL", D(1), 0)]


def test_calendar_month_before_january_is_december(books_of):
    days = [date(2019, 11, 30), date(2019, 12, 1), date(2019, 12, 31), date(2020, 1, 1), date(2018, 12, 5)]
    b = books_of([entry("ads", 10**i, 0, day=d) for i, d in enumerate(days)])
    got = rows(
        op.account_balance_calendar_month(
            b.gl_entry, b.chart, ["SELL"], date(2020, 1, 15), offset=-1
        )
    )
    assert got == [("ads", "SELL", D(110))]


def test_month_of_today_by_default(spark, books_of):
    today = spark.sql("select current_date()").first()[0]  # the session's zone, not the host's
    b = books_of([entry("ads", 3, 0, day=today)])
    for operator in (op.account_balance_month, op.account_balance_calendar_month):
        assert rows(operator(b.gl_entry, b.chart, ["SELL"])) == [("ads", "SELL", D(3))]


def test_counts_known_names_and_keeps_the_unknown_day(spark):
    df = frame(
        spark,
        "employee",
        [("a", MARCH), (None, MARCH), ("b", MARCH), ("c", None), (None, date(2020, 3, 2))],
    )
    got = rows(op.daily_count(df, "date_of_joining", "name", "n"))
    assert got == [(None, 1), (MARCH, 2), (date(2020, 3, 2), 0)]


def test_fiscal_year_is_text(books_of):
    b = books_of([entry("till", 1, 0, year=y) for y in ("FY20-21", "2020", "2020 ", None)])
    assert rows(op.account_balance(b.gl_entry, b.chart, ["CASH"], "2020")) == [("till", "CASH", D(1))]
    assert rows(op.account_balance(b.gl_entry, b.chart, ["CASH"], "FY20-21")) == [
        ("till", "CASH", D(1))
    ]


def test_fiscal_year_is_not_the_year_of_the_date(books_of):
    b = books_of([entry("till", 1, 0, day=date(2021, 2, 1), year="2020")])
    assert rows(op.account_balance(b.gl_entry, b.chart, ["CASH"], "2020")) == [("till", "CASH", D(1))]


def test_income_per_day_and_parent(books_of):
    b = books_of(
        [
            entry("sales", 0, 5),
            entry("refunds", 2, 0),
            entry("sales", 0, 1, day=date(2020, 2, 1)),
            entry("loan", 0, 8),
        ]
    )
    got = rows(op.ledger_daily(b.gl_entry, b.chart, ["INC", "DEBT"], "total"))
    assert got == [
        (date(2020, 2, 1), "INC", D(-1)),
        (MARCH, "DEBT", D(-8)),
        (MARCH, "INC", D(-3)),
    ]


def test_credits_of_one_account(spark):
    b = make_books(spark, [entry("sales", 3, 5), entry("sales", 0, 1), entry("refunds", 0, 9)])
    assert rows(op.account_daily_credit(b.gl_entry, "sales", "total")) == [(MARCH, D(6))]


def test_parents_are_matched_exactly(books_of):
    b = books_of([entry("x", 1, 0), entry("till", 2, 0)], chart=[("x", "cash", "Asset"), ("till", "CASH", "Asset")])
    assert _rollup(b)[0] == (1, "CASH", D(2), 0)


def test_dashboard_of_hand_made_books(books_of):
    b = books_of(
        [
            entry("sales", 0, 50),
            entry("sales", 0, 20, day=None, year="2018"),
            entry("refunds", 5, None),
            entry("till", 30, 10),
            entry("till", 4, 0, year="2019"),
            entry("ads", 7, 0),
            entry("wages", 9, 0, day=date(2019, 2, 3), year="2019"),
            entry("nowhere", 99, 0),
            payment("Zed", 40),
            payment("Amy", 40),
            payment(None, 1),
        ],
        sales=[(MARCH, D(11), "Paid"), (date(2019, 1, 1), D(2), "paid "), (MARCH, D(5), "Draft")],
        purchases=[],
        employees=[("e1", None), ("e2", MARCH), ("e3", date(2019, 6, 30))],
    )
    got = {}
    for series, place, label, value in sorted(rows(dashboard_series(b, PARAMS))):
        got.setdefault(series, []).append((place, label, value))
    assert got == {
        "sales_paid": [(1, "01/01/2019", 2), (2, "01/03/2020", 11)],
        "income": [(1, None, -20), (2, "01/03/2020", -50)],
        "headcount": [(1, None, 1), (2, "30/06/2019", 1), (3, "01/03/2020", 1)],
        "top_customers": [(1, "Amy", 40), (2, "Zed", 40), (3, None, 1)],
        "cash_cur": [(1, "CASH", 20), (2, "DEPOSIT", 0), (3, "BANK", 0)],
        "cash_prev": [(1, "CASH", 4), (2, "DEPOSIT", 0), (3, "BANK", 0)],
        "expense_cur": [(1, "SELL", 7), (2, "PAY", 0), (3, "OTHER", 0)],
        "expense_prev": [(1, "SELL", 0), (2, "PAY", 9), (3, "OTHER", 0)],
        "net_income": [(1, "income", -45)],
        "net_expense": [(1, "expense", 7)],
    }


def test_dashboard_of_empty_books_has_its_fixed_labels(books_of):
    b = books_of([], chart=[])
    got = rows(dashboard_series(b, PARAMS))
    assert len(got) == 3 + 3 + 3 + 3 + 1 + 1
    assert {value for *_, value in got} == {0}


def test_a_parent_may_be_listed_in_several_places(books_of):
    from dataclasses import replace

    p = replace(PARAMS, income_parent="CASH", expense_categories=("CASH",), prior_fiscal_year="2020")
    b = books_of([entry("till", 5, 1)])
    got = {(s, label): v for s, _, label, v in rows(dashboard_series(b, p)) if v}
    assert got == {
        ("income", "01/03/2020"): 4,
        ("cash_cur", "CASH"): 4,
        ("cash_prev", "CASH"): 4,
        ("expense_cur", "CASH"): 4,
    }


def test_lists_run_in_step(books_of):
    b = books_of([entry("till", 30, 10), payment("B", 1), payment("A", 2)])
    got = {s: (labels, values) for s, labels, values in rows(as_lists(dashboard_series(b, PARAMS)))}
    assert got["cash_cur"] == (["CASH", "DEPOSIT", "BANK"], [D(20), D(0), D(0)])
    assert got["top_customers"] == (["A", "B"], [D(2), D(1)])


@pytest.mark.parametrize("limit", [None, 0], ids=["shared pass", "two passes"])
def test_dashboard_by_calendar_month_knows_december(books_of, limit):
    days = [date(2019, 12, 1), date(2019, 12, 31), date(2020, 1, 1), date(2018, 12, 5), date(2018, 1, 9)]
    b = books_of([entry("ads", 10**i, 0, day=d) for i, d in enumerate(days)])
    b = b if limit is None else b.with_broadcast_limit(limit)

    def expenses(p):
        return {
            s: v
            for s, _, label, v in rows(dashboard_series(b, p))
            if s.startswith("expense") and label == "SELL"
        }

    january = replace(PARAMS, as_of=date(2020, 1, 15))
    assert expenses(january) == {"expense_cur": D(10100), "expense_prev": 0}
    by_calendar = replace(january, calendar_months=True)
    assert expenses(by_calendar) == {"expense_cur": D(100), "expense_prev": D(11)}
