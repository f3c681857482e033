"""All operators on random, heavily skewed ledgers, against plain Python sums."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import date, timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerbeam import operators as op
from ledgerbeam.plans import dashboard_series
from tests.helpers import CHART, PARAMS, by_value, entry, make_books, rows

PARENT = {name: parent for name, parent, _ in CHART}
ROOT = {name: root for name, _, root in CHART}


def add(values):
    known = [v for v in values if v is not None]
    return sum(known, D(0)) if known else None


def net(e):
    return None if e[2] is None or e[3] is None else e[2] - e[3]


def grouped(entries, key, value):
    groups = defaultdict(list)
    for e in entries:
        groups[key(e)].append(value(e))
    return {k: add(v) for k, v in groups.items()}


def random_entries(seed: int, size: int = 600):
    """One account, day and party each hold about a third of all rows."""
    rng = random.Random(seed)

    def amount():
        return rng.choice([None, 0, rng.randrange(1, 10**9) / 100, rng.randrange(1, 10**4) / 100])

    entries = []
    for _ in range(size):
        pays = rng.random() < 0.4
        entries.append(
            entry(
                "till" if rng.random() < 0.33 else rng.choice([*PARENT, "nowhere", None]),
                amount(),
                amount(),
                day=date(2020, 3, 1)
                if rng.random() < 0.33
                else rng.choice([None, date(2018, 1, 1) + timedelta(days=rng.randrange(1200))]),
                year=rng.choice(["2018", "2019", "2020", "FY20", None]),
                party="hot" if rng.random() < 0.33 else rng.choice([None, *"ABCDEFGH"]),
                party_type="Customer" if pays else rng.choice([None, "Supplier"]),
                voucher_type="Payment Entry" if rng.random() < 0.7 else "Journal Entry",
            )
        )
    return entries


@pytest.fixture(scope="module", params=[(1, None), (2, (0, 0)), (3, None), (3, (0,))], ids=str)
def case(request, spark):
    seed, limits = request.param
    entries = random_entries(seed)
    books = make_books(spark, entries)
    books = books if limits is None else books.with_broadcast_limit(*limits)
    return entries, books


def joined(entries, parents):
    return [e for e in entries if PARENT.get(e[0]) in parents]


def test_balances(case):
    entries, b = case
    parents = PARAMS.cash_categories
    for year in ("2020", "2019", "FY20", "1900"):
        want = grouped([e for e in joined(entries, parents) if e[4] == year], lambda e: e[0], net)
        got = rows(op.account_balance(b.gl_entry, b.chart, parents, year))
        assert {(a, p): v for a, p, v in got} == {(a, PARENT[a]): v for a, v in want.items()}
        values = [v for *_, v in got if v is not None]
        assert values == sorted(values, reverse=True)


def test_months(case):
    entries, b = case
    parents = PARAMS.expense_categories
    of = joined(entries, parents)
    for as_of, offset in ((date(2020, 3, 15), 0), (date(2020, 3, 15), -1), (date(2020, 1, 1), -1)):
        want = grouped([e for e in of if e[1] and e[1].month == as_of.month + offset], lambda e: e[0], net)
        got = rows(op.account_balance_month(b.gl_entry, b.chart, parents, as_of, offset))
        assert {a: v for a, _, v in got} == want
        number = as_of.year * 12 + as_of.month - 1 + offset
        in_month = [e for e in of if e[1] and e[1].year * 12 + e[1].month - 1 == number]
        got = rows(op.account_balance_calendar_month(b.gl_entry, b.chart, parents, as_of, offset))
        assert {a: v for a, _, v in got} == grouped(in_month, lambda e: e[0], net)


def test_rollup(case):
    entries, b = case
    year = F.col("fiscal_year")
    got = rows(
        op.category_rollup(
            b.gl_entry,
            b.chart,
            PARAMS.cash_categories,
            {"cur": year == "2020", "prev": year == "2019"},
        )
    )
    sums = {
        y: grouped([e for e in entries if e[4] == y], lambda e: PARENT.get(e[0]), net)
        for y in ("2020", "2019")
    }
    assert got == [
        (i, c, sums["2020"].get(c) or 0, sums["2019"].get(c) or 0)
        for i, c in enumerate(PARAMS.cash_categories, 1)
    ]


def test_income_per_day(case):
    entries, b = case
    got = rows(op.ledger_daily(b.gl_entry, b.chart, ["INC"], "v"))
    assert {d: v for d, _, v in got} == grouped(joined(entries, ["INC"]), lambda e: e[1], net)


def test_top_parties(case):
    entries, b = case
    sums = grouped(
        [e for e in entries if e[6] == "Customer" and e[7] == "Payment Entry"], lambda e: e[5], lambda e: e[3]
    )
    order = sorted(
        sums.items(), key=lambda kv: (kv[1] is None, -(kv[1] or 0), kv[0] is None, kv[0] or "")
    )
    for k in (1, 5, 100):
        assert rows(op.top_parties(b.gl_entry, "Customer", "Payment Entry", k)) == order[:k]


def test_totals(case):
    entries, b = case
    nets = []
    for root in ("Income", "Expense"):
        of = [e for e in entries if ROOT.get(e[0]) == root and e[4] == "2020"]
        debit, credit = add(e[2] for e in of), add(e[3] for e in of)
        nets.append(debit - credit)
        assert rows(op.root_type_totals(b.gl_entry, b.chart, root, "2020")) == [
            (debit, credit, debit - credit)
        ]
    assert rows(op.income_vs_expense(b.gl_entry, b.chart, "2020")) == [tuple(nets)]


def test_dashboard_equals_its_parts(case):
    _, b = case
    p = PARAMS
    got = defaultdict(list)
    for series, _, label, value in sorted(rows(dashboard_series(b, p)), key=lambda r: (r[0], r[1])):
        got[series].append((label, value))

    def label(day):
        return None if day is None else day.strftime("%d/%m/%Y")

    assert got["income"] == [
        (label(d), v) for d, _, v in rows(op.ledger_daily(b.gl_entry, b.chart, [p.income_parent], "v"))
    ]
    assert got["top_customers"] == rows(op.top_parties(b.gl_entry, p.party_type, p.voucher_type, p.top_k))
    year = F.col("fiscal_year")
    cash = rows(
        op.category_rollup(
            b.gl_entry,
            b.chart,
            p.cash_categories,
            {"cur": year == p.fiscal_year, "prev": year == p.prior_fiscal_year},
        )
    )
    assert got["cash_cur"] == [(c, cur) for _, c, cur, _ in cash]
    assert got["cash_prev"] == [(c, prev) for _, c, _, prev in cash]
    [(income, expense)] = rows(op.income_vs_expense(b.gl_entry, b.chart, p.fiscal_year))
    assert got["net_income"] == [("income", income)]
    assert got["net_expense"] == [("expense", expense)]


def test_partitioning_of_the_input_does_not_matter(case):
    from dataclasses import replace

    _, b = case
    scattered = replace(b, gl_entry=b.gl_entry.repartition(7, F.rand(3)))
    assert by_value(rows(dashboard_series(scattered, PARAMS))) == by_value(rows(dashboard_series(b, PARAMS)))
