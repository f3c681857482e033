from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerbeam import operators as op
from ledgerbeam.plans import RUPIAH_2020, dashboard_series
from ledgerbeam.sources import (
    ChartOfAccounts,
    DuplicateAccounts,
    books_from_erp,
    open_books,
    write_books,
)
from ledgerbeam.sources.books import ERP_TABLES
from ledgerbeam.sources.schemas import conform, table_schemas
from tests.helpers import (
    PARAMS,
    by_value,
    entry,
    frame,
    jobs,
    make_books,
    payment,
    plan_of,
    rows,
)


def test_duplicate_account_is_refused(spark):
    chart = [("till", "CASH", "Asset"), ("till", "BANK", "Asset"), ("safe", "CASH", "Asset")]
    with pytest.raises(DuplicateAccounts, match="'till'"):
        make_books(spark, chart=chart)


def test_unnamed_accounts_are_not_duplicates(spark):
    chart = ChartOfAccounts.verified(
        frame(spark, "account", [(None, "CASH", "Asset"), (None, "CASH", "Asset"), ("a", None, None)])
    )
    assert chart.rows == 1
    assert rows(chart.df) == [("a", None, None)]


def test_broadcast_is_bounded_by_the_selected_bytes(spark):
    accounts = [(f"acc{i:04}", "RARE" if i < 3 else "COMMON", "Asset") for i in range(500)]
    chart = ChartOfAccounts.verified(frame(spark, "account", accounts))
    chart = chart.with_broadcast_limit(10 * 130)
    assert chart.fits_broadcast(chart.under(["RARE"]))
    assert not chart.fits_broadcast(chart.under(["COMMON"]))
    assert not chart.fits_broadcast(chart.under(["RARE", "COMMON"]))


def test_size_is_counted_in_bytes(spark):
    chart = ChartOfAccounts.verified(frame(spark, "account", [("é" * 10, "p", None), ("a", "b", "c")]))
    assert chart.size_bytes == 2 * 100 + 20 + 1 + 3


def test_one_long_name_does_not_make_a_small_chart_large(spark):
    accounts = [("x" * 2000, "P", "Asset")] + [(f"a{i}", "P", "Asset") for i in range(1000)]
    chart = ChartOfAccounts.verified(frame(spark, "account", accounts), 150_000)
    assert chart.size_bytes < 150_000 < chart.rows * 2100
    assert chart.fits_broadcast(chart.under(["P"]))


def test_selections_are_measured_once_and_in_one_job(spark):
    accounts = [(f"a{i}", f"P{i % 5}", "Asset") for i in range(1000)]
    chart = ChartOfAccounts.verified(frame(spark, "account", accounts), 50_000)
    with jobs(spark) as started:
        chart.measure(chart.under(["P1"]), chart.under(["P2"]), chart.of_root_types(["Asset"]))
    assert started() <= 2  # one action; adaptive execution submits its two stages one by one
    with jobs(spark) as started:
        assert chart.fits_broadcast(chart.under(["P1"]))
        assert not chart.with_broadcast_limit(49_000).fits_broadcast(chart.of_root_types(["Asset"]))
    assert started() == 0
    plan = plan_of(chart.df.agg(F.sum(F.octet_length("name"))))
    assert "LocalLimit" not in plan and "CollectLimit" not in plan


def test_conform_gives_types_and_drops_other_columns(spark):
    df = spark.createDataFrame(
        [(datetime(2020, 3, 1, 13), D("1.25"), "Paid", 7)],
        "posting_date timestamp, total decimal(9,2), status string, other int",
    )
    got = conform(df, table_schemas()["sales_invoice"])
    assert got.schema == table_schemas()["sales_invoice"]
    assert rows(got) == [(date(2020, 3, 1), D("1.25"), "Paid")]


def test_conform_refuses_to_round(spark):
    df = spark.createDataFrame(
        [(date(2020, 3, 1), D("1.123456"), "Paid")],
        "posting_date date, total decimal(18,6), status string",
    )
    with pytest.raises(ValueError, match="6 decimal places"):
        conform(df, table_schemas()["sales_invoice"])
    exact = conform(df, table_schemas(T.DecimalType(18, 6))["sales_invoice"])
    assert rows(op.daily_total(exact, "paid", "t")) == [(date(2020, 3, 1), D("1.123456"))]


@pytest.fixture(params=["true", "false"], ids=["ansi", "not ansi"])
def ansi(spark, request):
    spark.conf.set("spark.sql.ansi.enabled", request.param)
    yield request.param
    spark.conf.unset("spark.sql.ansi.enabled")


@pytest.mark.parametrize(
    "kind", ["double", "float", "string", "bigint", "decimal(21,2)", "decimal(18,6)", "boolean"]
)
def test_types_that_could_lose_money_are_refused(spark, ansi, kind):
    df = spark.createDataFrame([], f"posting_date date, total {kind}, status string")
    with pytest.raises(ValueError, match="total is"):
        conform(df, table_schemas()["sales_invoice"])


@pytest.mark.parametrize("kind", ["int", "smallint", "decimal(10,0)", "decimal(18,2)", "decimal(12,1)"])
def test_types_that_fit_are_exact(spark, ansi, kind):
    df = spark.sql(f"select date'2020-03-01' posting_date, cast(-120 as {kind}) total, 'Paid' status")
    [(_, total, _)] = rows(conform(df, table_schemas()["sales_invoice"]))
    assert total == D("-120.00")


@pytest.mark.parametrize("kind", ["double", "float"])
def test_floats_are_taken_on_request_if_exact(spark, ansi, kind):
    def total(value):
        df = spark.sql(f"select date'2020-03-01' posting_date, cast({value} as {kind}) total, 'x' status")
        return rows(conform(df, table_schemas()["sales_invoice"], exact_floats=True))[0][1]

    assert total("1.25") == D("1.25")
    assert total("null") is None
    assert total("-3") == D("-3.00")
    for lost in ("0.004", "1.005", "1e17", "'NaN'", "'Infinity'"):
        with pytest.raises(Exception, match="not exactly"):
            total(lost)


def test_doubles_that_are_the_nearest_to_a_decimal_are_exact(spark):
    df = spark.sql("select date'2020-03-01' posting_date, 0.1D + 0D total, 'x' status")
    assert rows(conform(df, table_schemas()["sales_invoice"], exact_floats=True))[0][1] == D("0.10")


def test_dates_come_from_dates_alone(spark):
    df = spark.createDataFrame([], "posting_date string, total decimal(18,2), status string")
    with pytest.raises(ValueError, match="posting_date is string"):
        conform(df, table_schemas()["sales_invoice"])


def test_sums_beyond_their_type_raise(spark):
    kind = T.DecimalType(38, 2)
    huge = D("9" * 35 + ".00")
    books = make_books(spark)
    sales = spark.createDataFrame(
        [(date(2020, 3, 1), huge, "Paid")] * 50, table_schemas(kind)["sales_invoice"]
    )
    with pytest.raises(Exception, match="(?i)overflow|NUMERIC_VALUE_OUT_OF_RANGE|cannot be represented"):
        rows(op.daily_total(sales, "paid", "t"))
    assert books.chart.rows


def test_a_missing_column_is_reported(spark):
    df = spark.createDataFrame([], "posting_date date, total decimal(18,2)")
    with pytest.raises(KeyError, match="status"):
        conform(df, table_schemas()["sales_invoice"])


def _some_books(spark):
    return make_books(
        spark,
        [
            entry("till", 5, 1, year="2020"),
            entry("till", 2, 0, year="2019"),
            entry("ads", 1, None, year="FY20-21"),
            entry("sales", 0, 9, year=None, day=None),
            payment("A", 3),
        ],
        sales=[(date(2020, 3, 1), D(4), "Paid")],
        purchases=[(date(2020, 3, 1), D(6), "Paid")],
        employees=[("e", date(2020, 1, 1))],
    )


def test_stored_books_come_back_unchanged(spark, tmp_path):
    books = _some_books(spark)
    write_books(books, str(tmp_path / "books"))
    again = open_books(spark, str(tmp_path / "books"))
    for name, df in books.tables().items():
        assert dict(df.dtypes).items() <= dict(again.tables()[name].dtypes).items(), name
        stored = again.tables()[name].select(df.columns)  # without what the layout adds
        assert by_value(rows(stored)) == by_value(rows(df)), name
    assert by_value(rows(dashboard_series(again, PARAMS))) == by_value(
        rows(dashboard_series(books, PARAMS))
    )


def test_stored_books_are_not_overwritten(spark, tmp_path):
    books = _some_books(spark)
    write_books(books, str(tmp_path / "books"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        write_books(books, str(tmp_path / "books"))


def test_erp_tables_through_a_catalog(spark):
    """The original chart and parameters, with amounts of six decimal places."""
    p = RUPIAH_2020
    cash, _, bank = p.cash_categories
    money = T.DecimalType(21, 9)
    chart = [
        ("1111.001 - Kas Kecil - RE", cash, "Asset"),
        ("1121.001 - Bank A - RE", bank, "Asset"),
        ("4110.000 - Penjualan - RE", p.income_parent, "Income"),
    ]
    day = date(2020, 5, 17)
    ledger = [
        ("1111.001 - Kas Kecil - RE", day, D("10.5"), D(0), "2020", None, None, "Journal Entry"),
        ("1121.001 - Bank A - RE", day, D("0.000000001"), D(0), "2019", None, None, "Journal Entry"),
        ("4110.000 - Penjualan - RE", day, D(0), D(7), "2020", "PT Maju", "Customer", "Payment Entry"),
    ]
    data = {
        "account": chart,
        "gl_entry": ledger,
        "sales_invoice": [(day, D(3), "Paid")],
        "purchase_invoice": [(day, D(2), "Overdue")],
        "employee": [("HR-1", day)],
    }
    for name, schema in table_schemas(money).items():
        spark.createDataFrame(data[name], schema).createOrReplaceTempView(f"`{ERP_TABLES[name]}`")
    books = books_from_erp(lambda table: spark.table(f"`{table}`"), money)
    got = {
        (series, label): value
        for series, _, label, value in rows(dashboard_series(books, p))
        if value
    }
    label = "17/05/2020"
    assert got == {
        ("sales_paid", label): D(3),
        ("income", label): D(-7),
        ("top_customers", "PT Maju"): D(7),
        ("cash_cur", cash): D("10.5"),
        ("cash_prev", bank): D("0.000000001"),
        ("headcount", label): D(1),
        ("net_income", "income"): D(-7),
    }


def test_accounts_with_equal_hashes_stay_apart(spark, monkeypatch):
    from ledgerbeam.sources import chart

    monkeypatch.setattr(chart.F, "xxhash64", lambda column: F.length(column).cast("bigint"))
    books = make_books(
        spark,
        [entry("till", 5, 0), entry("safe", 2, 0), entry("bank", 1, 0), entry("none", 9, 0)],
    )
    got = rows(op.account_balance(books.gl_entry, books.chart, ["CASH", "BANK"], "2020"))
    assert got == [("till", "CASH", D(5)), ("safe", "CASH", D(2)), ("bank", "BANK", D(1))]
