"""The five accounting tables, derived from a TPC-H-like star schema.

Every part becomes an account below its brand, every line item a journal entry, every
order a sales invoice with a customer entry, every signup event an employee.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerbeam.sources.books import Books


def _account(part: DataFrame) -> DataFrame:
    return part.selectExpr(
        "cast(p_partkey as string) as name",
        "p_brand as parent_account",
        """case when p_type in ('ECONOMY', 'PROMO') then 'Income'
                when p_type in ('LARGE', 'MEDIUM') then 'Expense'
                when p_type = 'SMALL' then 'Asset'
                else 'Liability' end as root_type""",
    )


def _journal_entries(lineitem: DataFrame) -> DataFrame:
    return lineitem.selectExpr(
        "cast(l_partkey as string) as account",
        "cast(l_shipdate as date) as posting_date",
        "if(l_returnflag = 'R', cast(l_extendedprice as decimal(18,2)), 0bd) as debit",
        "if(l_returnflag <> 'R', cast(l_extendedprice as decimal(18,2)), 0bd) as credit",
        "cast(year(l_shipdate) as string) as fiscal_year",
        "cast(null as string) as party",
        "cast(null as string) as party_type",
        "'Journal Entry' as voucher_type",
    )


def _customer_entries(orders: DataFrame) -> DataFrame:
    # 'AR' is not in the account table: these are entries without an account.
    return orders.selectExpr(
        "'AR' as account",
        "cast(o_orderdate as date) as posting_date",
        "cast(0 as decimal(18,2)) as debit",
        "cast(o_totalprice as decimal(18,2)) as credit",
        "cast(year(o_orderdate) as string) as fiscal_year",
        "cast(o_custkey as string) as party",
        "'Customer' as party_type",
        "if(o_orderstatus = 'F', 'Payment Entry', 'Sales Invoice') as voucher_type",
    )


def _sales_invoice(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        "cast(o_orderdate as date) as posting_date",
        "cast(o_totalprice as decimal(18,2)) as total",
        """case o_orderstatus when 'F' then 'Paid' when 'P' then 'Overdue'
                else 'Unpaid' end as status""",
    )


def _purchase_invoice(lineitem: DataFrame) -> DataFrame:
    return lineitem.selectExpr(
        "cast(l_shipdate as date) as posting_date",
        "cast(l_extendedprice as decimal(18,2)) as total",
        "if(l_linestatus = 'F', 'Paid', 'Unpaid') as status",
    )


def _employee(events: DataFrame) -> DataFrame:
    return events.filter("event_type = 'signup'").selectExpr(
        "cast(event_id as string) as name",
        "cast(ts as date) as date_of_joining",
    )


def books_from_star(spark: SparkSession, directory: str) -> Books:
    part, lineitem, orders, events = (
        spark.read.parquet(f"{directory}/{table}.parquet")
        for table in ("part", "lineitem", "orders", "events")
    )
    return Books.of(
        {
            "sales_invoice": _sales_invoice(orders),
            "purchase_invoice": _purchase_invoice(lineitem),
            "gl_entry": _journal_entries(lineitem).unionByName(_customer_entries(orders)),
            "account": _account(part),
            "employee": _employee(events),
        }
    )
